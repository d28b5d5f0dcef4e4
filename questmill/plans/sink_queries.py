"""Queries for sinks, with the DuckDB SQL of what they hold afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from questmill.sources.assets import contents, put_assets
from questmill.sources.driver_tables import table
from questmill.sources.paged import read_paged, sqlite, write_paged
from questmill.sources.shared import shared_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "snk_remote_paged",
    """SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN c_name || ' new' ELSE c_name END AS name,
  CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 WHEN c_nationkey = 4 THEN 0.5 ELSE c_acctbal END AS balance, c_nationkey AS nation FROM customer WHERE c_nationkey <> 5""",
)
def snk_remote_paged(s, d):
    """Customers in a remote table: inserted, some replaced, some deleted, some changed in one column, then read in pages."""
    path = shared_path(s, "remote").removeprefix("file://") + ".db"
    con = _opened(path)
    con.execute("CREATE TABLE customers (id INTEGER PRIMARY KEY, name TEXT, balance REAL, nation INTEGER)")
    con.commit()
    con.close()
    at = {"connect": "questmill.sources.paged:sqlite", "target": path, "dbtable": "customers", "key": "id"}
    rows = table(s, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_acctbal").alias("balance"), c("c_nationkey").alias("nation"))
    write_paged(rows, **at)
    write_paged(rows.where("nation = 3").withColumns({"name": F.concat("name", F.lit(" new")), "balance": c("balance") + 1}), **at)
    write_paged(rows.withColumn("name", F.lit("ignored")), mode="ignore", **at)
    write_paged(rows.where("nation = 5").select("id"), mode="delete", **at)
    write_paged(rows.where("nation = 4").select("id", F.lit(0.5).alias("balance")), mode="update", **at)
    return read_paged(s, "id bigint, name string, balance double, nation bigint", **at)


def _opened(path: str):
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    return sqlite(path)


@query(
    "snk_asset_store",
    """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'generated' END AS kind, doc_id % 3 < 2 AS first_put,
  doc_id % 3 = 2 OR doc_id % 5 = 0 AS changed, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS body FROM documents)
SELECT 'a' || doc_id AS asset_id, kind, CASE WHEN kind = 'generated' THEN (doc_id % 7) || '/generated/q' || doc_id || '/a' ELSE (doc_id % 7) || '/source/a' END || doc_id || '.png' AS storage_key,
  sha256(body) AS checksum, strlen(body) AS size_bytes, CASE WHEN changed THEN 2 ELSE 1 END AS version, 1::BIGINT AS copies FROM p""",
)
def snk_asset_store(s, d):
    """Two thirds of the documents as assets, then all with some changed; each content lies there once."""
    root = shared_path(s, "assets")
    k = c("doc_id")
    kind = F.when(k % 2 == 0, "source").otherwise("generated")
    asset = F.concat(F.lit("a"), k.cast("string")).alias("asset_id")
    document, question = (k % 7).cast("string").alias("document_id"), F.concat(F.lit("q"), k.cast("string")).alias("question_id")
    whole = table(s, d, "documents").select("doc_id", asset, kind.alias("kind"), F.lit("figure").alias("role"), F.lit("image/png").alias("mime_type"), document, question, "text")
    put_assets(whole.where("doc_id % 3 < 2").withColumn("bytes", c("text").cast("binary")), root)
    body = F.when(k % 5 == 0, F.concat("text", F.lit("!"))).otherwise(c("text"))
    now = put_assets(whole.withColumn("bytes", body.cast("binary")), root)
    copies = contents(s, root).groupBy("checksum").agg(F.count("*").alias("copies"))
    return now.join(copies, "checksum").select("asset_id", "kind", "storage_key", "checksum", "size_bytes", "version", "copies")
