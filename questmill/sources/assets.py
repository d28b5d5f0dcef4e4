"""A store of assets by content: each distinct content is one row of a table, each asset points to its content.

Below the store's folder lie contents (checksum, bytes), to which a put adds only
checksums that it lacks, and a log of references, to which it adds the assets that
are new or changed, under a number of its own. An asset's newest reference counts.
Contents go first: a put that dies in between leaves contents that no asset names
yet, and the next try finds them there. A put that is repeated writes no row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTENTS = "checksum string, bytes binary"
REFS = "asset_id string, kind string, role string, mime_type string, storage_key string, size_bytes long, checksum string, version int"


def extension(mime: Column) -> Column:
    return F.when(mime == "image/svg+xml", ".svg").when(mime == "image/png", ".png").when(mime == "image/webp", ".webp").otherwise(".jpg")


def storage_key(kind: Column, document: Column, question: Column, asset: Column, mime: Column) -> Column:
    """Where an asset belongs: generated ones below their question, others below the document's source."""
    name = F.concat(asset, extension(mime))
    return F.when(kind == "generated", F.concat_ws("/", document, F.lit("generated"), question, name)).otherwise(F.concat_ws("/", document, F.lit("source"), name))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store, empty before the first put."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The newest reference of every asset."""
    log = _read(spark, f"{root}/log", REFS)
    newest = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("version")))
    return log.withColumn("_r", newest).where("_r = 1").drop("_r")


def contents(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/contents", CONTENTS)


def put_assets(writes: DataFrame, root: str) -> DataFrame:
    """Put assets (asset_id, kind, role, mime_type, document_id, question_id, bytes) into the store; returns the manifest.

    An asset whose kind and checksum are known stays as it is. ValueError, before
    anything is written, where an id is null or repeated, a generated asset has no
    question, or one would replace a source asset. One writer at a time.
    """
    spark = writes.sparkSession
    new = writes.select(
        "asset_id", "kind", "role", "mime_type", F.octet_length("bytes").cast("long").alias("size_bytes"), F.sha2("bytes", 256).alias("checksum"), "bytes",
        storage_key(F.col("kind"), F.col("document_id"), F.col("question_id"), F.col("asset_id"), F.col("mime_type")).alias("storage_key"),
        ((F.col("kind") == "generated") & F.col("question_id").isNull()).alias("lost"),
    )
    known = manifest(spark, root).select("asset_id", F.col("kind").alias("_kind"), F.col("checksum").alias("_checksum"), F.col("version").alias("_version"))
    both = new.join(known, "asset_id", "left")
    covers = (F.col("_kind") == "source") & (F.col("kind") == "generated")
    bad = both.agg(
        F.count_if("lost").alias("lost"), F.count_if(covers).alias("covers"), F.count_if(F.col("asset_id").isNull()).alias("nameless"),
        (F.count("asset_id") - F.count_distinct("asset_id")).alias("repeated"), F.max("_version").alias("newest"),
    ).first()
    for count, message in ((bad.lost, "a generated asset needs a question id"), (bad.covers, "generated writes cannot overwrite a source asset"), (bad.nameless, "an asset needs an id"), (bad.repeated, "an asset is put twice")):
        if count:
            raise ValueError(f"{message}: {count} rows")
    changed = both.where(~(F.col("kind").eqNullSafe(F.col("_kind")) & F.col("checksum").eqNullSafe(F.col("_checksum"))))
    # Equal contents of one put are written once.
    fresh = changed.groupBy("checksum").agg(F.first("bytes").alias("bytes")).join(contents(spark, root), "checksum", "left_anti")
    fresh.where("bytes is not null").write.mode("append").parquet(f"{root}/contents")
    number = (manifest(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    refs = changed.select("asset_id", "kind", "role", "mime_type", "storage_key", "size_bytes", "checksum", F.lit(number).alias("version"))
    refs.write.mode("append").parquet(f"{root}/log")
    return manifest(spark, root)
