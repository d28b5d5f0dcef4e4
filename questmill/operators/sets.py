"""Merges, differences and replacements without a table format: each returns the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new rows replace old ones of the same key; the others stay."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new rows whose key is not there yet are added."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def merge_columns(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge in which a new value that is not null wins."""
    values = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    return old.join(n, list(keys), "full").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def unique_rows(frame: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each id; rows without an id go."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return frame.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("_r", rank).where("_r = 1").drop("_r")


def replace_where(old: DataFrame, new: DataFrame, column: str, value: object) -> DataFrame:
    """Rows with the value go, new ones come; a null value means rows without one."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def without(frame: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.join(gone, list(keys), "left_anti")


def replace_document(index: DataFrame, rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Derived rows of whole documents are replaced."""
    return index.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def needs_push(units: DataFrame, ledger: DataFrame, presence: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """units with needs_push and why: changed against the ledger's hash, missing remotely, or drifted in a row count."""
    led = ledger.select(key, F.col("content_hash").alias("_hash"))
    here = presence.select(key, F.lit(True).alias("_linked"), *[F.col(c).alias(f"_{c}") for c in counts])
    both = units.join(led, key, "left").join(here, key, "left")
    drift = F.lit(False)
    for c in counts:
        drift = drift | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    why = F.when(~F.col("_hash").eqNullSafe(F.col("content_hash")), "changed").when(F.col("_linked").isNull(), "missing").when(drift, "drifted")
    return both.select(*units.columns, why.isNotNull().alias("needs_push"), why.alias("why"))
