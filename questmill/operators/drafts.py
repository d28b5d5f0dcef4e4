"""Drafts of questions over what was saved meanwhile: a three-way merge by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(base: DataFrame, local: DataFrame, saved: DataFrame, key: str, columns: Sequence[str], at_once: Sequence[str] = ()) -> DataFrame:
    """Each saved row with the draft's edits: key, columns, dirty, clashes, flush.

    base is what the draft began from, local the draft, saved the newest state; each
    has one row for a key. A column that local changed against base is dirty and
    keeps the draft's value, null included; all others are the saved ones. dirty and
    clashes name columns in order; a clash is a dirty column that was saved with
    another value meanwhile. flush says whether a dirty column must be saved at once.
    A row without a draft stays as saved, a draft whose row is gone has none; a
    draft without base counts as edited in all columns.
    """
    mine = local.select(key, F.struct(*columns).alias("_local"))
    began = base.select(key, F.struct(*columns).alias("_base"))
    both = saved.select(key, F.struct(*columns).alias("_saved")).join(mine, key, "left").join(began, key, "left")
    drafted = F.col("_local").isNotNull()
    edited = {n: drafted & (F.col("_base").isNull() | ~F.col(f"_local.{n}").eqNullSafe(F.col(f"_base.{n}"))) for n in columns}
    moved = {n: ~F.col(f"_saved.{n}").eqNullSafe(F.col(f"_base.{n}")) & ~F.col(f"_saved.{n}").eqNullSafe(F.col(f"_local.{n}")) for n in columns}
    named = lambda tests: F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))
    values = [F.when(edited[n], F.col(f"_local.{n}")).otherwise(F.col(f"_saved.{n}")).alias(n) for n in columns]
    flush = F.arrays_overlap(named(edited), F.array(*map(F.lit, at_once))) if at_once else F.lit(False)
    clashes = named({n: edited[n] & F.col("_base").isNotNull() & moved[n] for n in columns})
    return both.select(key, *values, named(edited).alias("dirty"), clashes.alias("clashes"), flush.alias("flush"))
