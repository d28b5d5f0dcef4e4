"""The queries registered for the subpackage, the pipeline's stages, and their SQL."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from questmill.llm import queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda f: sorted((tuple(None if x != x else x for x in r) for r in f[order].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        after = after.cache()
        assert 0 < after.count() < kept.count() + 1
        kept = after
    norm = lambda t: "".join((t or "").split())
    assert len({norm(r.text) for r in kept.collect()}) == kept.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in kept.collect()}
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).count() == 0, name


def odd_docs(spark):
    """Repeated ids and rows, ties, nulls in any column, empty and long texts, and columns named as the stages' own."""
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, c, z, long = text(60), text(50), text(40), text(20_000)
    rows = [(3, a), (5, a), (5, c), (7, z), (7, z), (8, z + " "), (9, a + " x y"), (None, a), (None, text(30)), (None, "q"), (None, "q")]
    rows += [(10, None), (11, ""), (12, " \n"), (13, long), (14, long + " end"), (5, c + " more"), (2, c + "  more"), (15, "a b"), (16, "A b"), (16, "A b")]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", k if k % 5 else None) for k, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({"n": F.lit("n"), "kept": F.lit(None).cast("string"), "a": F.lit(1), "key": F.lit("k"), "c": F.lit(0)}).repartition(3)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_keeps_one_row_of_each_text(spark):
    docs = odd_docs(spark)
    got = corpus_pipeline.exact(spark, docs, SF)
    assert got.columns == docs.columns
    best = {}
    for x in docs.collect():
        rank = (-len(x.text or ""), x.doc_id is None, x.doc_id or 0)
        best[norm(x.text)] = min(best.get(norm(x.text), rank), rank)
    got = got.collect()
    assert len(got) == len(best)
    assert all((-len(x.text or ""), x.doc_id is None, x.doc_id or 0) == best[norm(x.text)] for x in got)


def test_near_keeps_one_row_of_each_group(spark):
    docs = odd_docs(spark)
    got = corpus_pipeline.near(spark, docs, SF)
    assert got.columns == docs.columns
    rows = docs.collect()

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = [shingles(x.text) for x in rows], list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, j in itertools.combinations(range(len(rows)), 2):
        o = len(sets[i] & sets[j])
        if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
            root[find(j)] = find(i)
    groups = {}
    for i, x in enumerate(rows):
        groups.setdefault(find(i), []).append((x.doc_id is None, x.doc_id or 0))
    got = got.collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == sorted(min(g) for g in groups.values())
    kept = [sets.index(shingles(x.text)) for x in got if shingles(x.text)]
    assert len({find(i) for i in kept}) == len(kept)


def test_quality_and_packing_take_odd_rows(spark):
    docs = odd_docs(spark)
    got = corpus_pipeline.quality(spark, docs, SF)
    assert got.columns == docs.columns
    assert {x.doc_id for x in got.where("coalesce(text, '') = ''").collect()} == {10, 11}
    pieces = corpus_pipeline.packing(spark, docs, SF).toPandas()
    encoder = tokens.encoder(queries.BYTE_BPE)
    want = sorted(len(encoder.ids(x.text)) + 1 for x in docs.collect())
    whole = pieces.groupby(["doc_id", "start", "length", "ids_crc32"], dropna=False).size()
    assert pieces.length.sum() == sum(want) and len(whole) <= len(pieces)
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()


def test_the_entry_lists_all_operators():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
