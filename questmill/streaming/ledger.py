"""Incremental push as a stream: an extension, as the library itself pushes in one serial chain.

Each micro-batch keeps the newest version of every question, drops those whose
content hash the ledger already holds, hands the rest to a writer and then replaces
the ledger. A batch that is run again after a failure finds its hashes confirmed
and writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from questmill.functions.ids import content_hash
from questmill.operators.sets import upsert


def push_batch(batch: DataFrame, ledger: DataFrame, key: str, version: str, content: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch to push, and the ledger afterwards (key, content_hash)."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    rows = batch.withColumn("_r", newest).where("_r = 1").drop("_r").withColumn("content_hash", content_hash(list(content)))
    todo = rows.join(ledger.select(key, F.col("content_hash").alias("_known")), key, "left").where(~F.col("content_hash").eqNullSafe(F.col("_known"))).drop("_known")
    return todo, upsert(ledger, todo.select(key, "content_hash"), [key])


def push_stream(
    source: DataFrame, key: str, version: str, content: Sequence[str], ledger_path: str, checkpoint: str, write: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Start the push of a streaming source. The ledger is a folder of Parquet tables, one a batch; the last one counts."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            ledger = spark.read.parquet(f"{ledger_path}/{number - 1}")
        else:
            ledger = spark.createDataFrame([], batch.select(key).schema.add("content_hash", "string"))
        todo, after = push_batch(batch, ledger, key, version, content)
        write(todo, number)
        after.write.mode("overwrite").parquet(f"{ledger_path}/{number}")

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
