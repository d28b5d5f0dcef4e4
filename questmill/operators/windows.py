"""Numbering, gaps and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questmill.sources.shared import shared_path


def number_gaps(frame: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of missing positive integers between those of each key: 34-35, or 87."""
    n = frame.select(key, number).where(F.col(number) >= 1).distinct()
    before = F.lag(number).over(Window.partitionBy(key).orderBy(number))
    gap = n.withColumn("_b", before).where(F.col(number) > F.col("_b") + 1)
    start, end = F.col("_b") + 1, F.col(number) - 1
    return gap.select(key, F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end)).alias("gap"))


def gap_flags(frame: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """frame with number_gap: whether a hole in the numbers stands before the row; repeated numbers are no hole."""
    before = F.lag(number).over(Window.partitionBy(key).orderBy(number, order))
    return frame.withColumn("number_gap", F.coalesce(F.col(number) - before > 1, F.lit(False)))


def first_of_number(frame: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """The first row of every printed number; rows without one stay."""
    rank = F.row_number().over(Window.partitionBy(key, number).orderBy(order))
    blank = F.coalesce(F.col(number).cast("string"), F.lit("")) == ""
    return frame.withColumn("_r", rank).where((F.col("_r") == 1) | blank).drop("_r")


def lost_images(frame: DataFrame, file: str, page: str, tie: str) -> DataFrame:
    """Rows that share a file with a later page and so have lost their image."""
    rank = F.row_number().over(Window.partitionBy(file).orderBy(F.desc(page), F.desc(tie)))
    return frame.withColumn("_r", rank).where("_r > 1").drop("_r")


def renumbered(frame: DataFrame, key: str, order: list[Column], name: str = "page_index") -> DataFrame:
    """frame with places from 0 in the order given."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def capped(frame: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Rows of each key up to a running count; the cap is the feature."""
    return renumbered(frame, key, order, "_n").where(F.col("_n") < most).drop("_n")


def chunks(frame: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """frame with batch: fixed-size groups in order."""
    return renumbered(frame, key, order, "_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")


def first_seen_order(frame: DataFrame, key: str, value: str, order: str, default: str) -> DataFrame:
    """key, value and the place from 1 at which the value was first seen."""
    seen = frame.groupBy(key, F.coalesce(value, F.lit(default)).alias(value)).agg(F.min(order).alias("_first"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_first"))).drop("_first")


def next_top(frame: DataFrame, keys: list[str], top: str, order: str) -> DataFrame:
    """frame with bottom: where the next row of the column begins."""
    return frame.withColumn("bottom", F.lead(top).over(Window.partitionBy(*keys).orderBy(top, order)))


def two_columns(frame: DataFrame, key: str, x: str, gap: float) -> DataFrame:
    """frame with side: 1 right of the widest gap in x of its key, if that is wide and each side has two of four or more."""
    w = Window.partitionBy(key).orderBy(x, "ord")
    step = frame.withColumn("_n", F.row_number().over(w)).withColumn("_gap", F.col(x) - F.lag(x).over(w))
    best = step.groupBy(key).agg(F.max(F.struct(F.col("_gap"), (-F.col("_n")).alias("_m"))).alias("_best"), F.count("*").alias("_all"))
    at = -F.col("_best._m")
    wide = (F.col("_all") >= 4) & (F.col("_best._gap") >= gap) & (at - 1 >= 2) & (F.col("_all") - at + 1 >= 2)
    out = step.join(best, key).withColumn("side", F.when(wide & (F.col("_n") >= at), 1).otherwise(0))
    return out.drop("_n", "_gap", "_best", "_all")


def running_place(frame: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """frame with each row's place, from 1, in the order of all rows. No task holds more than its range of the order.

    Rows are dealt by ranges of the order and counted within each; what stands
    before a range comes from the counts of the ranges, one row each. The order must
    tell all rows apart.
    """
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # A row's range and its place there are kept with it, so both uses below see the same ranges.
    path = shared_path(frame.sparkSession, "ranges")
    ranged.withColumns({"_part": F.shiftright("_id", 33), "_own": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id").write.parquet(path)
    part = frame.sparkSession.read.parquet(path)
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return part.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_part", "_own", "_before")


def cases_of_run(cases: DataFrame, skills: DataFrame, each: int, most: int) -> DataFrame:
    """The cases of a run: of each skill the first `each` by rank, skills in their order, and over all skills no more than `most`.

    cases: skill, rank, case_id; skills: skill, place. The caps are the feature.
    Returns skill, case_id, index (in its skill) and place (in the run), from 1.
    """
    own = F.row_number().over(Window.partitionBy("skill").orderBy("rank", "case_id"))
    few = cases.withColumn("index", own).where(F.col("index") <= each)
    placed = running_place(few.join(skills, "skill").select("skill", "case_id", "index", F.col("place").alias("_skill")), [F.col("_skill"), F.col("index")])
    return placed.where(F.col("place") <= most).select("skill", "case_id", "index", "place")
