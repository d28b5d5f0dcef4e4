"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Deletes the white space of the contracts: space, tab, newline, vertical tab, form feed, carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]"
#: Rows of short keys (about 100 bytes each) that may be broadcast, checked by count.
FEW_ROWS = 200_000
#: Seconds between two collections of the executors' garbage, at least.
COLLECT_S = 5
# Bytes that are part of a term, A-Z lower-cased; all others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _alone(spark: SparkSession) -> bool:
    """Whether the driver's process runs the tasks too."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a folder of this machine serves where it is the only one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not _alone(spark):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "questmill-shared")
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared one."""
    return f"{shared_dir(spark)}/questmill-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound what one Arrow batch holds, for the time of one write; the session's own settings come back."""
    own = {f"spark.sql.execution.arrow.{k}": v for k, v in (("maxRecordsPerBatch", "500"), ("maxBytesPerBatch", str(8 << 20)))}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder, with the options of Parquet's writer, and read it back."""
    path = fresh_path(df.sparkSession, name)
    with _small_batches(df.sparkSession):
        df.write.options(**(options or {})).parquet(path)
    # The step's shuffle files are no longer needed. Spark drops them once the driver has collected
    # its own garbage, which a driver with little to do may not do for hours.
    gc.collect()  # Python's references to the step's objects first
    give_back()
    df.sparkSession.sparkContext._jvm.System.gc()
    collect_executors(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_collected: dict[str, float] = {}


def collect_executors(spark: SparkSession) -> None:
    """Have the executors collect their garbage now, unless they did so within COLLECT_S seconds.

    An executor takes new heap for the pages of sorts and aggregations sooner than
    it reuses old ones, and keeps it, with the buffers outside the heap that dead
    objects hold. What lives between two steps is small, and a whole collection gives
    the rest back to the machine.
    """
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if _alone(spark) or now - _collected.get(app, -np.inf) < COLLECT_S:
        return
    n = spark.sparkContext.defaultParallelism  # a task for each core, so that every executor has one
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
    _collected[app] = time.monotonic()


def written_with(df: DataFrame, name: str, totals: dict[str, Column], options: dict[str, int] | None = None) -> tuple[DataFrame, dict]:
    """As written, and totals over the rows that were written."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(k) for k, c in totals.items()]), name, options)
    return out, seen.get


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast where its counted rows are few; else it is joined as any table."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def fenced(docs: DataFrame, **used: str) -> tuple[DataFrame, list[Column]]:
    """docs with the used columns under our names and all others in one struct, own; and the columns that bring the user's back.

    So no column that a step adds meets one of the user's.
    """
    ours = {name: k for k, name in used.items()}
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ours]
    inner = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in ours.items()], (F.struct(*others) if others else F.lit(0)).alias("own"))
    return inner, [(F.col(ours[c]) if c in ours else F.col(f"own.`{c}`")).alias(c) for c in docs.columns]


def give_back() -> None:
    """Return this process's free memory to the machine."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, to bound what a Python worker makes of one. Behind the last, the worker gives free memory back."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, as one array of strings, and the number of each text's.

    A term is a longest run of digits, letters and characters beyond ASCII; only A-Z are lower-cased. A null text has none.
    """
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = bytes(memoryview(raw.buffers()[2] or b"")[ends[0] : ends[-1]]).translate(_FOLD)
    folded = pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(data)])
    parts = pc.ascii_split_whitespace(folded)
    flat, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    some = pc.greater(pc.binary_length(flat), 0)  # white space at an end gives an empty part
    number = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), np.diff(number[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what a task's edges connect, at most one a vertex: each vertex to its root."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := up.setdefault(v, v)) != v:
            up[v] = up[p]
            v = p
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    pairs = [(v, r) for v in list(up) if (r := find(v)) != v]
    columns = zip(*pairs, strict=True) if pairs else ([], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by local forests and pointer jumping.

    edges: columns a and b (long), any direction, repeats and loops allowed.
    Returns one row per vertex that has an edge to another one: id, component_id
    (the smallest vertex reachable). Edges lead from the greater to the smaller
    vertex and are dealt by the greater, so a hub, which is small once it is a
    root, is no key of a shuffle; each task leaves out edges that its others make
    needless. Then edges to a vertex that has a parent itself are led to that
    parent: only such vertices are joined, and those of a star are none.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        now = written(now.repartition("a").mapInArrow(_forest, "a long, b long"), name)
        up = now.groupBy("a").agg(F.min("b").alias("to"), F.max("b").alias("most"))
        below = now.groupBy(F.col("b").alias("a")).agg(F.lit(True).alias("has_children"))
        inner = up.join(below, "a", "left").where("has_children or to < most").select(F.col("a").alias("b"), "to")
        inner, total = written_with(inner, name, {"n": F.count("*")})
        if not total["n"]:
            # Every vertex with a parent has one, and that is a root.
            return up.select(F.col("a").alias("id"), F.col("to").alias("component_id")).union(below.select("a", "a"))
        now = now.join(small(inner, total["n"]), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
