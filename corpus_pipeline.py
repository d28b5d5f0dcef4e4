"""The training-data pipeline: quality classifier, exact dedup, near dedup, packing.

Each stage works on what its predecessor kept and returns the columns of
documents; the last one returns the packed pieces. Between stages the documents
are written as Parquet in the shared folder, so a lost executor costs no more
than the stage it was lost in. Executors collect their garbage before each stage, as what
one has left takes memory from the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.llm.common import ASCII_SPACE, collect_executors, fenced, small, table, written, written_with
from questmill.llm.exact_dedup import exact_dedup
from questmill.llm.ngram_join import ngram_components
from questmill.llm.packing import pack_sequences, pieces_of
from questmill.llm.quality import score, train
from questmill.llm.queries import BYTE_BPE, END


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's quantiles; a null or empty text passes."""
    collect_executors(spark)
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).where("good").select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then that with the smallest id, then the smallest row.

    Decisions hold for an id with a text, so a row that shares just its id with a
    copy stays. Rows without an id are copies like others, and come last.
    """
    collect_executors(spark)
    key = ["_id", "_sha"]
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), ASCII_SPACE, ""), 256)
    inner, back = fenced(docs, doc_id="doc_id", text="text")
    keyed = inner.withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "_sha": sha})
    judged = exact_dedup(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    counts = judged.groupBy(*key, "kept").agg(F.count("*").alias("c"))
    leave, total = written_with(counts.where("not kept or c > 1"), "leave", {"n": F.count("*"), "repeated": F.count_if("kept")})
    kept = keyed.join(small(leave.select(*key), total["n"]), key, "left_anti").select(*back)
    if not total["repeated"]:
        return kept
    # Rows with equal ids and texts: one of them.
    again = keyed.join(leave.where("kept").select(*key), key)
    first = F.min(F.struct((-F.length("text")).alias("_n"), *inner.columns)).alias("_first")
    return kept.union(again.groupBy(*key).agg(first).select("_first.*").select(*back))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group linked by shingle similarity; rows without an id come last.

    Rows get numbers of their own, so rows that share an id are told apart.
    """
    collect_executors(spark)
    inner, back = fenced(docs, doc_id="doc_id", text="text")
    rows = written(inner.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = ngram_components(rows, id_col="_row").select("_row", F.col("component_id").alias("_group"))
    groups = groups.join(rows.select("_row", "doc_id"), "_row")
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_row")).alias("_stays")
    stays = groups.groupBy("_group").agg(stays, F.count("*").alias("_c")).where("_c > 1")
    goes = groups.join(written(stays, "stays"), "_group").where("_row != _stays._row").select("_row")
    goes, total = written_with(goes, "goes", {"n": F.count("*")})
    return rows.join(small(goes, total["n"]), "_row", "left_anti").select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    collect_executors(spark)
    return pack_sequences(pieces_of(docs, BYTE_BPE, END))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]

#: SQL has no tokenizer and no trained model; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
