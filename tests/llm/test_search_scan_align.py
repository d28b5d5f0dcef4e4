"""Lexical search, licence scan and token alignment against brute-force versions, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from questmill.llm import lexical, license_scan, token_align
from questmill.llm.common import terms_of
from questmill.llm.queries import BYTE_BPE, PIECE_BPE

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_texts():
    r = random.Random(3)
    out = [None, "", " \n\t", "x", "A a-a É é 漢字,漢字 42", "\x1c\x1d", "long " * 30_000, "'s 'll  it's", "a b c"]
    out += [" ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(r.randrange(1, 60))) for _ in range(300)]
    return out + out[20:60] * 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k") for i, t in enumerate(odd_texts())] + [(None, "w1 w2 w3 without id", "k"), (12, "w1 w2", "k")]
    # Columns whose names operators use inside.
    extra = {c: F.lit("own") for c in ("block", "terms", "score", "item", "rank", "d", "w", "pair", "count", "label")}
    return spark.createDataFrame(rows, "doc_id long, text string, key string").withColumns(extra).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_terms():
    import pyarrow as pa

    texts = odd_texts()
    flat, sizes = terms_of(pa.array(texts).slice(2, 60))
    want = [TERM.findall((t or "").translate(LOWER)) for t in texts[2:62]]
    assert flat.to_pylist() == [t for w in want for t in w] and sizes.tolist() == [len(w) for w in want]
    assert terms_of(pa.array([], pa.string()))[0].to_pylist() == []


def ranked(rows, items, k):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in rows]
    n, total, df = sum(map(bool, terms)), sum(map(len, terms)), Counter(t for w in terms for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, own in asked.items():
        found = []
        for (doc, _), w in zip(rows, terms, strict=True):
            tf, m = Counter(w), 100 - 90 + (90 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in own if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(i, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch_terms", [1_000_000, 10])
def test_search(spark, docs, rows, batch_terms):
    items = [(i, f"W{i} w{i + 1} w1 w1 absent") for i in range(8)] + [(20, None), (21, "nothing-here"), (3, "w40"), (None, "w2 w5"), (None, "w9"), (30, "long x"), (8, "É 漢字")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    got = lexical.search(lexical.build_index(docs), asked, batch_terms=batch_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, items, 10)


def test_search_passes_blocks_over(monkeypatch):
    """Blocks whose bound is below the threshold are not scored, and none of the best is lost."""
    import pyarrow as pa

    r = random.Random(1)
    texts = [f"{'rare ' * 3 if i == 300 else ''}w{r.randrange(9)} w{r.randrange(99)} rare{'' if i % 50 else 's'} pad" for i in range(640)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(640), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    made = list(lexical._rows(iter([batch])))
    items = lexical._Items([(7, "rares"), (7, "w3")])
    items.weights[:] = [5000, 300]
    cut = list(lexical._cut_down(iter(made), items, 640, sum(b.column("total")[0].as_py() for b in made)))
    scored = []
    plain = lexical._Stretch.scores
    monkeypatch.setattr(lexical._Stretch, "scores", lambda self, b, w: scored.append(b) or plain(self, b, w))
    (best,) = lexical._search(iter(cut), items, 5, np.ones(1, np.int64), False)
    assert 0 < len(scored) < 40 and all("rares" in texts[i] for i in best.column("doc_id").to_pylist())


def test_the_index_is_read_in_small_parts(spark, tmp_path, monkeypatch):
    """A row group of the index, which a scan decodes at once, stays small however much a task writes."""
    import pyarrow.parquet as pq

    monkeypatch.setattr("questmill.llm.common.shared_dir", lambda _: str(tmp_path))
    text = F.expr("array_join(transform(sequence(1, 300), k -> cast(pmod(xxhash64(id, k), 50000) as string)), ' ')")
    docs = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    items = spark.createDataFrame([(0, " ".join(map(str, range(50_000))))], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs), items).count() == 10
    for name in ("lexical", "lexical-cut"):
        of = [f for f in tmp_path.glob(f"*/{name}-*/part-*.parquet") if len(f.parent.name) == len(name) + 33]
        sizes = [g.total_byte_size for m in map(pq.read_metadata, of) for g in map(m.row_group, range(m.num_row_groups))]
        assert sum(sizes) > 10 << 20 and max(sizes) < 9 << 20, name


def test_search_of_nothing(spark, docs):
    none, item = spark.createDataFrame([], docs.schema), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), item).count() == 0
    assert lexical.search(lexical.build_index(docs), item.limit(0)).count() == 0


def brute_cover(words, template, max_gap, least):
    """The most words of the template that a chain of common runs covers, by all starts of all runs."""
    runs = []
    for a in range(len(words)):
        for b in range(len(template)):
            n = 0
            while a + n < len(words) and b + n < len(template) and words[a + n] == template[b + n]:
                n += 1
                if n >= least:
                    runs.append((a, b, n))
    runs.sort(key=lambda r: (r[0] + r[2], r[1]))
    best = []
    for a, b, n in runs:
        before = [best[k] for k, (c, d, m) in enumerate(runs[: len(best)]) if c + m <= a and d + m <= b and a - c - m <= max_gap]
        best.append(n + max(before, default=0))
    return max(best, default=0)


def test_license_chains():
    r = random.Random(2)
    template = [f"t{k % 23}" for k in range(40)]
    scanner = license_scan.Scanner({"t": ("lab", " ".join(template)), "u": ("other", " ".join(template[5:12] + ["z"]))}, {"t3 t4": "pair"})
    for _ in range(150):
        words = list(template)
        for _ in range(r.randrange(6)):
            k = r.randrange(len(words))
            words[k : k + r.randrange(3)] = [r.choice(["new", "t1", "t2", "more"]) for _ in range(r.randrange(3))]
        words = ["some"] * r.randrange(3) + words + ["tail"] + words[: r.randrange(8)]
        number = {w: i for i, w in enumerate(scanner.vocabulary.to_pylist())}
        coded = np.array([number.get(w, len(number)) for w in words])
        places, spans, covered = scanner.scan(coded, [(0, len(coded))])
        want = max(brute_cover(words, t, license_scan.MAX_GAP, license_scan.LEAST_RUN) / len(t) for t in (template, template[5:12] + ["z"]))
        assert covered == (1.0 if places else pytest.approx(want))
        assert [p[1] for p in places] == [k for k in range(len(words) - 1) if words[k : k + 2] == ["t3", "t4"]]
        assert all(s[5] >= license_scan.COVERED for s in spans)


def test_license_scan(spark, docs):
    mit = license_scan.TEMPLATES["mit"][1]
    edited = mit.replace("free of charge", "without cost").replace("\n", " ").replace("merge, ", "").upper()
    texts = [
        None, "", "plain text of the rights to use", f"// {mit}\n" * 2, " * ".join(edited.split(" ")), "CC-BY and cc by-sa, Apache  LICENSE. The MIT\nLicense; gnu general public",
        "mit " * 500 + "license", "MIT licenses", "All rights reserved.", mit[: len(mit) // 5],
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_words": F.lit("own"), "spans": F.lit(0)})
    got = {r.doc_id: r for r in license_scan.scan_licenses(table, license_scan.TEMPLATES, license_scan.PHRASES).collect()}
    assert [got[i].n_words for i in (0, 1, 2, 7)] == [0, 0, 7, 2]
    assert [(p.label, p.first) for p in got[5].places] == [("cc-by", 0), ("cc-by", 3), ("apache", 6), ("mit", 9)]
    assert [(s.label, s.coverage) for s in got[3].spans] == [("mit", 1.0)] * 2 and [s.label for s in got[4].spans] == ["mit"]
    assert got[3].spans[1].first == got[3].spans[0].last + 1 and got[4].spans[0].coverage > 0.8
    assert [(p.label, p.first, p.last) for p in got[6].places] == [("mit", 499, 500)]
    assert not got[2].spans and not got[2].places and not got[7].places and not got[9].spans and 0 < got[9].coverage < 0.5
    assert [s.label for s in got[8].spans] == ["all-rights-reserved"]
    assert license_scan.scan_licenses(table.limit(0), license_scan.TEMPLATES, license_scan.PHRASES).count() == 0
    assert license_scan.scan_licenses(docs, license_scan.TEMPLATES, license_scan.PHRASES).count() == docs.count()


def aligned(rows):
    """Both libraries on whole texts, and all links one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    of_a = token_align.byte_tokens(BYTE_BPE)
    of_b = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]]
    kept, df = [], Counter()
    for i, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        if not text or any(b"".join(map(of.__getitem__, ids)) != (" " + text).encode() for of, ids in ((of_a, a), (of_b, b))):
            kept.append((i, [], Counter()))
            continue
        ends = [np.cumsum([len(of[k]) for k in ids]) for of, ids in ((of_a, a), (of_b, b))]
        cuts = np.intersect1d(*ends)
        groups = [([], []) for _ in cuts]
        for side, (ids, e) in enumerate(zip((a, b), ends, strict=True)):
            for k, g in zip(ids, np.searchsorted(cuts, e), strict=True):
                groups[g][side].append(k)
        links = Counter((x, y) for u, v in groups for x in u for y in v)
        df.update(links.keys())
        kept.append((i, groups, links))
    top = {}
    for (x, _), n in df.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, groups, links in kept:
        said = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        best = sum(n for p, n in links.items() if df[p] == top[p[0]])
        sizes = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        out.append((i, *sizes, len(groups), sum(links.values()), best, sum(n * df[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), df, top


def test_token_align(spark, rows, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 3_000)
    odd = ["a ", "a  ", " a", "a  b", "a\n b\n", "x▁y", "<|endoftext|> in <s> it </s>", "<0x41>", "é́ü 😀😀", "tab\t tab \t x", " " * 100, "a" * 3000, "\r\n } );\r", "\x00 \x01", "a\u0085 b", "ſ ﬁ Ⅷ"]
    rows = [(i, t) for i, t in rows if len(t or "") < 100_000][:150] + [(1000 + i, t) for i, t in enumerate(odd)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("own"), "a": F.lit(1)}).repartition(4)
    got, pairs = token_align.align(table, BYTE_BPE, PIECE_BPE)
    want, df, top = aligned(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in df.items()}
    none, _ = token_align.align(table.limit(0), BYTE_BPE, PIECE_BPE)
    assert none.count() == 0
    nulls, _ = token_align.align(table.select("doc_id", F.lit(None).cast("string").alias("text")), BYTE_BPE, PIECE_BPE)
    assert {tuple(r)[1:] for r in nulls.collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_words_do_not_reach_over_their_ends():
    """What the cut at spaces rests on: no piece of B holds a space behind anything else, and A's words split there."""
    both = token_align.tokenizers(BYTE_BPE, PIECE_BPE)
    assert not [p for p in both.of_b if b" " in p.lstrip(b" ")]
    texts = ["one two  three\n four \t five. six's (7) 8,9", "é à 漢 字  x"]
    for t in texts:
        words = token_align._BOUNDARY.split(f" {t}")
        words[0] = words[0][1:]
        assert both.encode_a(words).tolist() == both.a.encode_ordinary(f" {t}")
        assert both.encode_b(words)[0].tolist() == both.b.encode(t)
