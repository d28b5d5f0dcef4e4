"""Columns of the user that bear the names of steps keep their values in the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from questmill.llm import quality

NAMES = ["_sum", "_n", "_nll", "_mean", "_model", "_low", "_high", "_group", "_groups", "_id", "_sha", "_row", "_first", "_stays", "_c", "own", "kept", "c", "x", "fold", "s", "n", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words of text number {i} and then a few more of them here {i * i}", "en", "s", 5) for i in range(60)]
    rows += [(60, rows[0][1], "en", "s", 5), (61, None, None, None, None), (None, rows[3][1] + " ", "xx", "s", 1), (5, rows[5][1], "en", "s", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return table.withColumns({name: F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for name in NAMES})


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def kept_own(table):
    for r in table.collect():
        assert all(r[name] == f"{name}{'-' if r.doc_id is None else r.doc_id}" for name in NAMES)


def test_quality(spark, docs, labels):
    model = quality.train(docs, spark.read.parquet(f"{labels}/labels.parquet"))
    scored = quality.score(docs, model)
    assert scored.columns == [*docs.columns, "nll", "perplexity", "n_symbols", "good"] and scored.count() == docs.count()
    kept_own(scored)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, docs, labels, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, labels)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept_own(out)


def test_exact_keeps_one_of_equal_rows(spark, docs, labels):
    ids = [r.doc_id for r in dict(corpus_pipeline.STAGES)["exact"](spark, docs, labels).collect()]
    assert ids.count(5) == 1 and 60 not in ids and 61 in ids and None in ids
