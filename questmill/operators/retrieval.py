"""Scopes, top-k and fallback retrieval over the question index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("standard_id", "subject_id", "stream_id", "skill_type", "pattern_subtype", "document_id")


def scope_filter(scope: dict[str, object], is_mock: bool | None = None, kinds: Sequence[str] = ()) -> Column:
    """All given equalities; a value that is None or empty is a wildcard."""
    out = F.lit(True)
    for name in SCOPE:
        if scope.get(name) not in (None, ""):
            out = out & (F.col(name) == scope[name])
    if is_mock is not None:
        out = out & (F.col("is_mock") == int(is_mock))
    return out & F.col("kind").isin(*kinds) if kinds else out


def learned_skills(index: DataFrame) -> DataFrame:
    """Counts of source and mock questions per scope, skill and subtype, and when one was last seen."""
    return (
        index.where("skill_type is not null")
        .groupBy("standard_id", "subject_id", "stream_id", "skill_type", "pattern_subtype")
        .agg(
            F.count_if(F.col("is_mock") == 0).alias("source_count"),
            F.count_if(F.col("is_mock") == 1).alias("mock_count"),
            F.max("created_at").alias("last_seen_at"),
        )
    )


def exemplars(index: DataFrame, limit: int) -> DataFrame:
    """The newest questions, sources before mocks; ties go by id."""
    return index.orderBy("is_mock", F.desc_nulls_last("created_at"), "question_id").limit(max(1, int(limit)))


def top_per(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | Column) -> DataFrame:
    """The first rows of each group; the limit may be a column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def ladder(requests: DataFrame, index: DataFrame, levels: Sequence[Sequence[str]], key: str, limit: int) -> DataFrame:
    """For each request the top rows of the strictest level that has any.

    levels: the columns that must agree, from strict to loose, each set within the
    one before; a null in a request is a wildcard. The loosest level's first column
    must be given. What a request asks at a level is a set of columns with values:
    the index keeps its first rows for each set of columns in use (at most two to
    the power of the columns) and its values, and requests meet these few rows, not
    the index.
    """
    columns, base = list(levels[0]), levels[-1][0]
    bit = {c: 1 << i for i, c in enumerate(columns)}
    given = lambda cs: sum(F.when(F.col(c).isNotNull(), bit[c]).otherwise(0) for c in cs)
    at = F.array(*[F.struct(F.lit(i).alias("level"), given(cs).alias("mask")) for i, cs in enumerate(levels)])
    asked = requests.where(F.col(base).isNotNull()).select("request_id", *columns, F.explode(at).alias("at")).select("request_id", *columns, "at.*")
    masks = [r.mask for r in asked.select("mask").distinct().collect()]  # sets of columns

    def masked(c: str) -> Column:
        return F.when(F.col("mask").bitwiseAND(F.lit(bit[c])) > 0, F.col(c))

    asked = asked.select("request_id", "level", F.col("mask").alias("_mask"), *[masked(c).alias(f"_{c}") for c in columns])
    each = index.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))) if masks else index.withColumn("mask", F.lit(0)).where("false")
    for c in columns:  # a value that is asked for is never null
        each = each.where((F.col("mask").bitwiseAND(F.lit(bit[c])) == 0) | F.col(c).isNotNull())
    each = each.withColumns({f"_k{c}": masked(c) for c in columns})
    order = [F.col("is_mock"), F.desc("created_at"), F.col(key)]
    few = top_per(each, ["mask", *[f"_k{c}" for c in columns]], order, limit)
    same = F.col("mask") == F.col("_mask")
    for c in columns:
        same = same & F.col(f"_k{c}").eqNullSafe(F.col(f"_{c}"))
    hit = few.join(asked, same).withColumn("_best", F.min("level").over(Window.partitionBy("request_id"))).where("level = _best")
    return hit.drop("_best", "mask", "_mask", *[f"_{c}" for c in columns], *[f"_k{c}" for c in columns])


def latest(frame: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The value of the last row of each key."""
    return frame.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
