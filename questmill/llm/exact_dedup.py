"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text without its white space is cut where its own content says so (at the first
sentence mark behind CHUNK_MIN characters that follows one of a few characters,
after CHUNK_MAX characters at the latest), so cuts meet again soon after a change. Chunks are deduplicated by content to identifiers: the 64-bit hash,
and for different chunks that share a hash (found by comparing their contents)
also the chunk's rank among them. A document's recipe is its ordered list of
identifiers; two texts are equal exactly when their recipes are. Only recipes
(8 bytes a chunk) are grouped and joined, so a long text moves once, chunk by
chunk, however many copies it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questmill.llm.common import ASCII_SPACE, written

CHUNK_MIN, CHUNK_MAX = 128, 8192
#: A cut lies behind these: rare enough that two texts fall into step again.
CUT = r"[a-fA-F0-2à-é\u4e00-\u62ff][.!?;。！？]"


def chunks_of(norm: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The content-defined chunks of a text, in order; none of an empty text."""
    pattern = rf"(?s).{{{least - 2},{most - 2}}}?{CUT}|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; of equal texts the
    one with the most code points stays, then the smallest id. A null text is an
    empty one; all empty texts are one group. Rows that repeat an id are rows of
    their own: each counts in group_size, and all with keep_id's id are kept. A
    null id stays only in a group that has no other. Other columns of docs are
    ignored. An empty table gives an empty one.
    """
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    norm = text.select("_id", F.length("_text").alias("_n"), F.regexp_replace("_text", ASCII_SPACE, "").alias("_norm"))
    cut = norm.select("_id", "_n", F.sha2("_norm", 256).alias("_sha"), chunks_of(F.col("_norm")).alias("_chunks"))
    recipes = written(
        cut.select("_id", "_n", "_sha", F.transform("_chunks", lambda c: fingerprint(c)).alias("_recipe")), "recipes"
    ).withColumn("_ranks", F.array().cast("array<int>"))

    # Every distinct chunk meets the others of its fingerprint here, by content.
    distinct = norm.select(F.explode(chunks_of(F.col("_norm"))).alias("_chunk")).distinct()
    clashes = written(
        distinct.withColumn("_fp", fingerprint(F.col("_chunk"))).groupBy("_fp").agg(F.count("*").alias("_c")).where("_c > 1"),
        "clashes",
    )
    if clashes.take(1):
        recipes = _ranked(cut, recipes, clashes.select("_fp"), fingerprint)

    best = F.max(F.struct(F.col("_n"), F.col("_id").isNotNull(), (-F.col("_id")).alias("_neg"))).alias("_best")
    groups = recipes.groupBy("_recipe", "_ranks").agg(best, F.count("*").alias("group_size"))
    groups = groups.select("_recipe", "_ranks", (-F.col("_best._neg")).alias("keep_id"), "group_size")
    return recipes.join(groups, ["_recipe", "_ranks"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _ranked(cut: DataFrame, recipes: DataFrame, clashes: DataFrame, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """Recipes whose clashing chunks also carry their rank among the contents of their fingerprint."""
    at = cut.withColumn("_row", F.xxhash64("_sha", "_id", "_n"))
    at = at.select("_id", "_n", "_sha", F.posexplode_outer("_chunks").alias("_pos", "_chunk"))
    at = at.withColumn("_fp", fingerprint(F.col("_chunk")))
    hit = at.join(clashes, "_fp", "left_semi")
    rank = F.dense_rank().over(Window.partitionBy("_fp").orderBy("_chunk"))
    ids = hit.select("_fp", "_chunk").distinct().withColumn("_rank", rank)
    ranked = hit.join(ids, ["_fp", "_chunk"]).select("_sha", "_pos", "_rank").distinct()
    ranks = ranked.groupBy("_sha").agg(F.sort_array(F.collect_list(F.struct("_pos", "_rank"))).alias("_found"))
    ranks = ranks.select("_sha", F.col("_found._rank").alias("_got"))
    return recipes.join(ranks, "_sha", "left").withColumn("_ranks", F.coalesce("_got", "_ranks")).drop("_got")
