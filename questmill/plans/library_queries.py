"""Queries for retrieval, aggregation, windows, order, merges and joins, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from questmill.operators import retrieval, sets, windows
from questmill.sources.driver_tables import PAGE_LINES_SQL, QUESTION_INDEX_SQL, page_lines, question_index, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query with its SQL; {qi} and {lines} stand for the library's views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        ORACLE_SQL[name] = sql.replace("{qi}", QUESTION_INDEX_SQL).replace("{lines}", PAGE_LINES_SQL)
        return f

    return add


# Projections and filters.


@query("flt_scope", "WITH {qi} SELECT question_id, document_id FROM qi WHERE subject_id = 1 AND skill_type = 'view' AND is_mock = 1 AND kind IN ('paper', 'test')")
def flt_scope(s, d):
    scope = {"subject_id": 1, "skill_type": "view", "standard_id": None, "pattern_subtype": ""}
    return question_index(s, d).where(retrieval.scope_filter(scope, True, ("paper", "test"))).select("question_id", "document_id")


@query("flt_in_other", "SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_orderkey <> 7")
def flt_in_other(s, d):
    return table(s, d, "lineitem").where("l_orderkey != 7").select(c("l_partkey").alias("path")).distinct()


@query("flt_visible", "WITH {qi} SELECT question_id FROM qi WHERE skill_type = 'click' AND approved = 0")
def flt_visible(s, d):
    return question_index(s, d).where("skill_type = 'click' and approved = 0").select("question_id")


@query("flt_catalog_child", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 OR n_regionkey IS NULL")
def flt_catalog_child(s, d):
    return table(s, d, "nation").where("n_regionkey = 2 or n_regionkey is null").select("n_nationkey", "n_name")


@query("flt_point_lookup", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42")
def flt_point_lookup(s, d):
    return table(s, d, "orders").where("o_orderkey = 42").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("flt_ledger_read", "SELECT o_orderkey AS question_id, md5(o_orderstatus) AS content_hash FROM orders WHERE o_custkey = 11")
def flt_ledger_read(s, d):
    return table(s, d, "orders").where("o_custkey = 11").select(c("o_orderkey").alias("question_id"), F.md5("o_orderstatus").alias("content_hash"))


@query("src_query_all", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000.5")
def src_query_all(s, d):
    found = s.sql("SELECT c_custkey, c_name FROM {t} WHERE c_mktsegment = :seg AND c_acctbal > :least", args={"seg": "BUILDING", "least": 1000.5}, t=table(s, d, "customer"))
    return found


@query("src_query_one", "SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def src_query_one(s, d):
    return table(s, d, "orders").where("o_orderpriority = '2-HIGH'").select("o_orderkey").orderBy("o_orderkey").limit(1)


@query("src_json_column", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events")
def src_json_column(s, d):
    return table(s, d, "events").select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(0)).alias("k"))


@query("src_json_questions", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN event_id % 5 > 0 THEN event_id + 1 END AS last_id FROM events")
def src_json_questions(s, d):
    raw = F.when(c("event_id") % 5 == 0, F.lit("[{broken")).otherwise(F.format_string('[{"id":%d,"marks":"x"},{"id":%d}]', "event_id", c("event_id") + 1))
    parsed = F.coalesce(F.from_json(raw, "array<struct<id:bigint,marks:double>>"), F.from_json(F.lit("[]"), "array<struct<id:bigint,marks:double>>"))
    rows = table(s, d, "events").select("event_id", F.filter(parsed, lambda q: q["id"].isNotNull()).alias("q"))
    return rows.select("event_id", F.size("q").alias("n"), F.try_element_at("q", F.lit(-1))["id"].alias("last_id"))


@query("src_row_decode", "SELECT o_orderkey, coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS INT), 0) AS rank, o_orderstatus <> 'P' AS flag FROM orders")
def src_row_decode(s, d):
    return table(s, d, "orders").select("o_orderkey", F.coalesce(F.substring("o_orderpriority", 1, 1).try_cast("int"), F.lit(0)).alias("rank"), F.coalesce(c("o_orderstatus") != "P", F.lit(True)).alias("flag"))


@query("src_seed_default", "SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT * FROM (VALUES (3, 'seed three'), (77, 'seed')) v(id, name) WHERE id NOT IN (SELECT r_regionkey FROM region)")
def src_seed_default(s, d):
    seeds = s.createDataFrame([(3, "seed three"), (77, "seed")], "id int, name string")
    return sets.insert_ignore(table(s, d, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("name")), seeds, ["id"])


@query("snk_paper_json", "SELECT o_custkey AS document_id, '{\"version\":1,\"question_count\":' || count(*) || '}' AS doc FROM orders GROUP BY o_custkey")
def snk_paper_json(s, d):
    n = table(s, d, "orders").groupBy(c("o_custkey").alias("document_id")).agg(F.count("*").alias("question_count"))
    return n.select("document_id", F.to_json(F.struct(F.lit(1).alias("version"), "question_count")).alias("doc"))


@query("prj_row_policy", "SELECT event_id FROM events WHERE user_id = 12")
def prj_row_policy(s, d):
    return table(s, d, "events").where("user_id = 12").select("event_id")


@query("prj_null_images", "SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS image_path FROM part")
def prj_null_images(s, d):
    return table(s, d, "part").select("p_partkey", "p_name").withColumn("image_path", F.lit(None).cast("string"))


@query("prj_catalog_inherit", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN c_nationkey END, CASE WHEN o_orderkey % 2 = 0 THEN 99 END, -1) AS subject_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def prj_catalog_inherit(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), c("o_custkey") == c("c_custkey"), "left")
    return o.select("o_orderkey", F.coalesce(F.when(c("o_orderkey") % 3 == 0, c("c_nationkey")), F.when(c("o_orderkey") % 2 == 0, 99), F.lit(-1)).alias("subject_id"))


# Aggregations.


@query(
    "agg_learned_skills",
    "WITH {qi} SELECT standard_id, subject_id, stream_id, skill_type, pattern_subtype, CAST(sum(1 - is_mock) AS BIGINT) AS source_count, CAST(sum(is_mock) AS BIGINT) AS mock_count, max(created_at) AS last_seen_at FROM qi WHERE skill_type IS NOT NULL GROUP BY ALL",
)
def agg_learned_skills(s, d):
    return retrieval.learned_skills(question_index(s, d))


@query("agg_page_counts", "SELECT l_orderkey AS document_id, count(*) AS page_count FROM lineitem GROUP BY l_orderkey")
def agg_page_counts(s, d):
    return table(s, d, "lineitem").groupBy(c("l_orderkey").alias("document_id")).agg(F.count("*").alias("page_count"))


@query("agg_distinct_skills", "WITH {qi} SELECT DISTINCT document_id, skill_type FROM qi WHERE approved = 1 AND is_mock = 0 AND skill_type IS NOT NULL")
def agg_distinct_skills(s, d):
    return question_index(s, d).where("approved = 1 and is_mock = 0 and skill_type is not null").select("document_id", "skill_type").distinct()


@query("agg_open_alerts", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def agg_open_alerts(s, d):
    return table(s, d, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("n"))


@query("agg_override_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE value > 20 GROUP BY user_id")
def agg_override_latest(s, d):
    return retrieval.latest(table(s, d, "events").where("value > 20"), "user_id", "event_type", ["ts", "event_id"])


@query("agg_type_counts", "WITH {qi} SELECT kind, count(*) AS n FROM qi GROUP BY kind")
def agg_type_counts(s, d):
    return question_index(s, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "agg_paper_totals",
    "WITH {qi} SELECT document_id, round(sum(coalesce(CASE WHEN question_id % 6 > 0 THEN marks END, 1)), 4) AS marks, CAST(sum(approved) AS BIGINT) AS approved, count(DISTINCT coalesce(skill_type, 'General')) AS sections FROM qi GROUP BY document_id",
)
def agg_paper_totals(s, d):
    marks = F.coalesce(F.when(c("question_id") % 6 > 0, c("marks")), F.lit(1.0))
    return question_index(s, d).groupBy("document_id").agg(F.round(F.sum(marks), 4).alias("marks"), F.count_if(c("approved") == 1).alias("approved"), F.count_distinct(F.coalesce("skill_type", F.lit("General"))).alias("sections"))


@query("agg_train_skills", "WITH {qi} SELECT skill_type, count(*) AS n FROM qi WHERE approved = 1 AND skill_type IN ('view', 'click', 'error') GROUP BY skill_type")
def agg_train_skills(s, d):
    known = s.createDataFrame([("view",), ("click",), ("error",)], "skill_type string")
    return question_index(s, d).where("approved = 1").join(F.broadcast(known), "skill_type", "left_semi").groupBy("skill_type").agg(F.count("*").alias("n"))


@query("agg_cases_by_skill", "SELECT d.lang AS skill, count(*) AS cases, CAST(sum(quality) AS BIGINT) AS passed FROM documents d JOIN labels USING (doc_id) GROUP BY d.lang")
def agg_cases_by_skill(s, d):
    return _cases(s, d).groupBy("skill").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))


def _cases(s, d):
    """Calibration cases: labelled documents by language and source."""
    docs = table(s, d, "documents").select("doc_id", c("lang").alias("skill"), "source", "n_chars")
    return docs.join(table(s, d, "labels"), "doc_id").select("*", (c("quality") == 1).alias("passed"), (c("toxic") == 1).alias("failed"))


@query(
    "agg_blueprint",
    "WITH {qi}, f AS (SELECT document_id, skill_type, question_id, row_number() OVER (PARTITION BY document_id, CAST(marks AS INT) ORDER BY question_id) AS r FROM qi), n AS (SELECT document_id, skill_type, count(*) AS n, min(question_id) AS f FROM f WHERE r = 1 AND skill_type IS NOT NULL GROUP BY ALL) SELECT document_id, skill_type, n, row_number() OVER (PARTITION BY document_id ORDER BY f) AS place FROM n".replace("CAST(marks AS INT)", "CAST(floor(marks) AS INT)"),
)
def agg_blueprint(s, d):
    q = question_index(s, d).withColumn("number", F.floor("marks"))
    once = windows.first_of_number(q, "document_id", "number", "question_id").where("skill_type is not null")
    n = once.groupBy("document_id", "skill_type").agg(F.count("*").alias("n"), F.min("question_id").alias("f"))
    return n.select("document_id", "skill_type", "n", F.row_number().over(Window.partitionBy("document_id").orderBy("f")).alias("place"))


@query(
    "agg_progress",
    "WITH g AS (SELECT o_custkey AS job, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS pending, bool_or(o_orderpriority = '1-URGENT') AS running FROM orders GROUP BY o_custkey) SELECT job, total, completed AS done, pending, running, CAST(least(100, floor(completed * 100.0 / total)) AS BIGINT) AS percent FROM g",
)
def agg_progress(s, d):
    g = table(s, d, "orders").groupBy(c("o_custkey").alias("job")).agg(
        F.count("*").alias("total"), F.count_if(c("o_orderstatus") == "F").alias("done"), F.count_if(c("o_orderstatus") == "P").alias("pending"), F.bool_or(c("o_orderpriority") == "1-URGENT").alias("running"),
    )
    return g.withColumn("percent", F.least(F.lit(100).cast("long"), F.floor(c("done") * 100 / c("total"))))


@query("agg_syllabus_totals", "SELECT r_name AS subject, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'all', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey")
def agg_syllabus_totals(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return n.rollup("r_name").agg(F.count("*").alias("n")).select(F.coalesce("r_name", F.lit("all")).alias("subject"), "n")


@query("agg_plan_total", "SELECT p_brand AS slot, count(*) AS n, (SELECT count(*) FROM part) AS total FROM part GROUP BY p_brand")
def agg_plan_total(s, d):
    slots = table(s, d, "part").groupBy(c("p_brand").alias("slot")).agg(F.count("*").alias("n"))
    return slots.withColumn("total", slots.agg(F.sum("n")).scalar())


@query(
    "agg_skill_score",
    "SELECT lang AS skill, count(*) AS cases, CAST(sum(quality) AS BIGINT) AS passed, round(sum(quality) / count(*), 6) AS score, CAST(sum(toxic) AS BIGINT) AS structural_failures FROM documents JOIN labels USING (doc_id) GROUP BY lang",
)
def agg_skill_score(s, d):
    return _cases(s, d).groupBy("skill").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.round(F.try_divide(F.count_if("passed"), F.count("*")), 6).alias("score"), F.count_if("failed").alias("structural_failures"))


@query(
    "agg_difficulty_bias",
    "WITH g AS (SELECT source, avg(CASE WHEN quality = 1 THEN least(2, n_chars // 1500) END) AS gen, avg(least(2, n_chars // 2000)) AS ref FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, CASE WHEN gen < ref - 0.25 THEN 1 WHEN gen > ref + 0.25 THEN -1 ELSE 0 END AS bias FROM g",
)
def agg_difficulty_bias(s, d):
    rank = lambda k: F.least(F.lit(2), F.floor(c("n_chars") / k))
    g = _cases(s, d).groupBy("source").agg(F.avg(F.when(c("passed"), rank(1500))).alias("gen"), F.avg(rank(2000)).alias("ref"))
    return g.select("source", F.when(c("gen") < c("ref") - 0.25, 1).when(c("gen") > c("ref") + 0.25, -1).otherwise(0).alias("bias"))


@query(
    "agg_top_failures",
    "WITH n AS (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS place FROM n) SELECT lang AS skill, source AS note, n, place FROM r WHERE place <= 2",
)
def agg_top_failures(s, d):
    n = _cases(s, d).where("not passed").groupBy("skill", c("source").alias("note")).agg(F.count("*").alias("n"), F.min("doc_id").alias("f"))
    place = F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("n"), "f"))
    return n.withColumn("place", place).where("place <= 2").drop("f")


@query("agg_run_summary", "SELECT count(*) AS cases, CAST(sum(quality) AS BIGINT) AS passed, CAST(sum(toxic) AS BIGINT) AS failures FROM documents JOIN labels USING (doc_id)")
def agg_run_summary(s, d):
    return _cases(s, d).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if("failed").alias("failures"))


@query("agg_marks_default", "SELECT o_custkey AS document_id, round(coalesce(CASE WHEN o_custkey % 2 = 0 THEN 100.0 END, sum(o_totalprice)), 2) AS total FROM orders GROUP BY o_custkey")
def agg_marks_default(s, d):
    g = table(s, d, "orders").groupBy(c("o_custkey").alias("document_id")).agg(F.sum("o_totalprice").alias("t"))
    return g.select("document_id", F.round(F.coalesce(F.when(c("document_id") % 2 == 0, 100.0), c("t")), 2).alias("total"))


@query("agg_image_paths", "SELECT DISTINCT path FROM (SELECT unnest(['fig-' || l_partkey, 'page-' || l_suppkey]) AS path FROM lineitem)")
def agg_image_paths(s, d):
    both = F.array(F.concat(F.lit("fig-"), c("l_partkey").cast("string")), F.concat(F.lit("page-"), c("l_suppkey").cast("string")))
    return table(s, d, "lineitem").select(F.explode(both).alias("path")).distinct()


@query(
    "agg_median_mode",
    "WITH n AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, max(n) AS m FROM n GROUP BY 1), o AS (SELECT n.l_orderkey, CASE WHEN count(*) = 1 THEN min(v) END AS mode FROM n JOIN m ON n.l_orderkey = m.l_orderkey AND n.n = m.m GROUP BY 1), d AS (SELECT l_orderkey, median(CAST(l_quantity AS BIGINT)) AS med FROM lineitem GROUP BY 1) SELECT d.l_orderkey, CASE WHEN med = floor(med) THEN CAST(med AS BIGINT) END AS median, mode FROM d JOIN o USING (l_orderkey)",
)
def agg_median_mode(s, d):
    t = table(s, d, "lineitem").select("l_orderkey", c("l_quantity").cast("long").alias("v"))
    med = t.groupBy("l_orderkey").agg(F.median("v").alias("m"))
    n = t.groupBy("l_orderkey", "v").agg(F.count("*").alias("n"))
    top = n.withColumn("top", F.max("n").over(Window.partitionBy("l_orderkey"))).where("n = top")
    mode = top.groupBy("l_orderkey").agg(F.when(F.count("*") == 1, F.min("v")).alias("mode"))
    return med.join(mode, "l_orderkey").select("l_orderkey", F.when(c("m") == F.floor("m"), c("m").cast("long")).alias("median"), "mode")


@query("agg_next_number", "SELECT l_orderkey, coalesce(max(l_linenumber), 0) + 1 AS next FROM lineitem GROUP BY l_orderkey")
def agg_next_number(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg((F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).alias("next"))


@query("agg_correct_count", "SELECT l_orderkey, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY l_orderkey")
def agg_correct_count(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(F.when(c("l_returnflag") == "R", c("l_partkey"))).alias("n"))


# Windows.


@query(
    "win_number_gaps",
    "WITH n AS (SELECT DISTINCT user_id, event_id AS n FROM events WHERE event_id >= 1), l AS (SELECT user_id, n, lag(n) OVER (PARTITION BY user_id ORDER BY n) AS b FROM n) SELECT user_id, CASE WHEN b + 1 = n - 1 THEN CAST(b + 1 AS VARCHAR) ELSE (b + 1) || '-' || (n - 1) END AS gap FROM l WHERE n > b + 1",
)
def win_number_gaps(s, d):
    return windows.number_gaps(table(s, d, "events"), "user_id", "event_id")


@query("win_gap_flag", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) > 1, FALSE) AS number_gap FROM lineitem")
def win_gap_flag(s, d):
    flagged = windows.gap_flags(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return flagged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "number_gap")


@query("win_first_number", "SELECT event_id FROM (SELECT event_id, number, row_number() OVER (PARTITION BY user_id, number ORDER BY event_id) AS r FROM (SELECT event_id, user_id, CASE WHEN event_id % 9 > 0 THEN event_type END AS number FROM events)) WHERE r = 1 OR number IS NULL")
def win_first_number(s, d):
    e = table(s, d, "events").withColumn("number", F.when(c("event_id") % 9 > 0, c("event_type")))
    return windows.first_of_number(e, "user_id", "number", "event_id").select("event_id")


@query("win_lost_pages", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 1")
def win_lost_pages(s, d):
    return windows.lost_images(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey")


@query("win_reindex_pages", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page_index FROM orders WHERE o_orderkey % 5 > 0")
def win_reindex_pages(s, d):
    return windows.renumbered(table(s, d, "orders").where("o_orderkey % 5 > 0"), "o_custkey", [c("o_orderkey")]).select("o_orderkey", "page_index")


@query("win_shift_page", "SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber > 3 THEN l_linenumber - 1 ELSE l_linenumber END AS page FROM lineitem")
def win_shift_page(s, d):
    page = F.when(c("l_linenumber") == 3, None).when(c("l_linenumber") > 3, c("l_linenumber") - 1).otherwise(c("l_linenumber"))
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", page.alias("page"))


@query(
    "win_sort_questions",
    "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY TRY_CAST(nullif(regexp_extract(p_brand, '\\d+'), '') AS BIGINT) NULLS LAST, p_name, p_size, p_partkey) AS place FROM part",
)
def win_sort_questions(s, d):
    order = [F.asc_nulls_last(F.nullif(F.regexp_extract("p_brand", r"\d+", 0), F.lit("")).try_cast("long")), c("p_name"), c("p_size"), c("p_partkey")]
    return windows.renumbered(table(s, d, "part"), "p_type", order, "i").select("p_partkey", (c("i") + 1).alias("place"))


@query("win_sort_pairs", "SELECT l_orderkey, l_partkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY p_size NULLS LAST, l_partkey) AS place FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def win_sort_pairs(s, d):
    pairs = table(s, d, "lineitem").join(table(s, d, "part").select("p_partkey", "p_size"), c("l_partkey") == c("p_partkey"), "left")
    return pairs.select("l_orderkey", "l_partkey", "l_linenumber", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("p_size"), "l_partkey")).alias("place"))


@query("win_section_order", "SELECT user_id, coalesce(t, 'General') AS section, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS place FROM (SELECT user_id, event_id, CASE WHEN event_id % 8 > 0 THEN event_type END AS t FROM events) GROUP BY user_id, coalesce(t, 'General')")
def win_section_order(s, d):
    e = table(s, d, "events").withColumn("section", F.when(c("event_id") % 8 > 0, c("event_type")))
    return windows.first_seen_order(e, "user_id", "section", "event_id", "General")


@query("win_ring_buffer", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 200")
def win_ring_buffer(s, d):
    return windows.capped(table(s, d, "events"), "event_type", [F.desc("event_id")], 200).select("event_id")


@query("win_next_head", "SELECT l_orderkey, l_partkey, l_extendedprice, lead(l_extendedprice) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice, l_partkey) AS bottom FROM lineitem")
def win_next_head(s, d):
    return windows.next_top(table(s, d, "lineitem"), ["l_orderkey", "l_returnflag"], "l_extendedprice", "l_partkey").select("l_orderkey", "l_partkey", "l_extendedprice", "bottom")


@query(
    "win_number_columns",
    "WITH h AS (SELECT user_id, event_id AS ord, value / 500 AS x FROM events), g AS (SELECT *, row_number() OVER w AS n, x - lag(x) OVER w AS gap FROM h WINDOW w AS (PARTITION BY user_id ORDER BY x, ord)), b AS (SELECT user_id, max(gap) AS gap, arg_max(n, (gap, -n)) FILTER (gap IS NOT NULL) AS pos, count(*) AS c FROM g GROUP BY user_id) SELECT ord, CASE WHEN c >= 4 AND b.gap >= 0.02 AND pos - 1 >= 2 AND c - pos + 1 >= 2 AND n >= pos THEN 1 ELSE 0 END AS side FROM g JOIN b USING (user_id)",
)
def win_number_columns(s, d):
    heads = table(s, d, "events").select("user_id", c("event_id").alias("ord"), (c("value") / 500).alias("x"))
    return windows.two_columns(heads, "user_id", "x", 0.02).select("ord", "side")


@query("win_chunks", "SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 20) AS BIGINT) AS batch FROM orders")
def win_chunks(s, d):
    return windows.chunks(table(s, d, "orders"), "o_orderstatus", [c("o_orderkey")], 20).select("o_orderkey", "batch")


# Top-k and fallback retrieval.


@query("top_exemplars", "WITH {qi} SELECT question_id, is_mock, created_at FROM qi WHERE skill_type = 'purchase' ORDER BY is_mock, created_at DESC, question_id LIMIT 25")
def top_exemplars(s, d):
    return retrieval.exemplars(question_index(s, d).where("skill_type = 'purchase'"), 25).select("question_id", "is_mock", "created_at")


@query("top_references", "WITH {qi} SELECT question_id, created_at FROM qi WHERE approved = 1 AND is_mock = 0 ORDER BY created_at DESC, question_id LIMIT 10")
def top_references(s, d):
    return question_index(s, d).where("approved = 1 and is_mock = 0").orderBy(F.desc("created_at"), "question_id").limit(10).select("question_id", "created_at")


@query("top_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 15")
def top_runs(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(15).select("o_orderkey", "o_orderdate")


@query("ord_simple_lists", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def ord_simple_lists(s, d):
    return table(s, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("place"))


def _requests(s, d):
    """One retrieval request a customer."""
    q = table(s, d, "customer")
    skills = F.expr("element_at(array('view', 'click', 'error', 'signup', 'purchase'), cast(c_custkey % 5 as int) + 1)")
    return q.select(
        c("c_custkey").alias("request_id"), skills.alias("skill_type"), F.when(c("c_custkey") % 3 > 0, (c("c_custkey") % 6).cast("string")).alias("pattern_subtype"),
        (c("c_custkey") % 9).cast("int").alias("standard_id"), F.when(c("c_custkey") % 2 > 0, (c("c_custkey") % 5).cast("int")).alias("subject_id"),
    )


REQUESTS = "r AS (SELECT c_custkey AS request_id, ['view', 'click', 'error', 'signup', 'purchase'][c_custkey % 5 + 1] AS skill_type, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 6 AS VARCHAR) END AS pattern_subtype, CAST(c_custkey % 9 AS INT) AS standard_id, CASE WHEN c_custkey % 2 > 0 THEN CAST(c_custkey % 5 AS INT) END AS subject_id FROM customer)"
LEVELS = [["skill_type", "standard_id", "subject_id", "pattern_subtype"], ["skill_type", "standard_id", "subject_id"], ["skill_type", "standard_id"], ["skill_type"]]


def _ladder_sql(levels: int, k: int) -> str:
    same = {x: f"(r.{x} IS NULL OR q.{x} IS NOT DISTINCT FROM r.{x})" for x in LEVELS[0]}
    cases = " ".join(f"WHEN {' AND '.join(same[x] for x in LEVELS[i])} THEN {i}" for i in range(levels))
    return (
        f"WITH {{qi}}, {REQUESTS}, p AS (SELECT r.request_id, q.question_id, q.is_mock, q.created_at, CASE {cases} END AS level FROM r JOIN qi q ON q.skill_type = r.skill_type), "
        "b AS (SELECT *, min(level) OVER (PARTITION BY request_id) AS best FROM p WHERE level IS NOT NULL), "
        f"t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY is_mock, created_at DESC, question_id) AS k FROM b WHERE level = best) SELECT request_id, question_id, level FROM t WHERE k <= {k}"
    )


@query("top_ladder_exemplar", _ladder_sql(4, 3))
def top_ladder_exemplar(s, d):
    scopes = LEVELS[0]
    asked = _requests(s, d)
    distinct = asked.select(*scopes).distinct().withColumn("request_id", F.xxhash64(*scopes))
    found = retrieval.ladder(distinct, question_index(s, d), LEVELS, "question_id", 3).select(c("request_id").alias("scope"), "question_id", "level")
    return asked.withColumn("scope", F.xxhash64(*scopes)).join(found, "scope").select("request_id", "question_id", "level")


@query("top_ladder_reference", _ladder_sql(3, 5).replace("ON q.skill_type = r.skill_type)", "ON q.skill_type = r.skill_type AND q.approved = 1 AND q.is_mock = 0)"))
def top_ladder_reference(s, d):
    scopes = LEVELS[0]
    asked = _requests(s, d)
    index = question_index(s, d).where("approved = 1 and is_mock = 0")
    distinct = asked.select(*scopes).distinct().withColumn("request_id", F.xxhash64(*scopes))
    found = retrieval.ladder(distinct, index, LEVELS[:3], "question_id", 5).select(c("request_id").alias("scope"), "question_id", "level")
    return asked.withColumn("scope", F.xxhash64(*scopes)).join(found, "scope").select("request_id", "question_id", "level")


@query("top_profile_limit", "WITH {qi}, t AS (SELECT question_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY is_mock, created_at DESC, question_id) AS k FROM qi) SELECT question_id FROM t WHERE k <= CASE WHEN document_id % 4 = 0 THEN 5 ELSE 3 END")
def top_profile_limit(s, d):
    limit = F.coalesce(F.when(c("document_id") % 4 == 0, 5), F.lit(3))
    return retrieval.top_per(question_index(s, d), ["document_id"], [c("is_mock"), F.desc("created_at"), c("question_id")], limit).select("question_id")


@query("top_bias_lookup", "SELECT c_custkey, coalesce(CASE WHEN n_regionkey IN (1, 3) THEN n_regionkey - 2 END, 0) AS bias FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def top_bias_lookup(s, d):
    profile = table(s, d, "nation").where("n_regionkey in (1, 3)").select("n_nationkey", (c("n_regionkey") - 2).alias("difficulty_bias"))
    return table(s, d, "customer").join(profile, c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", F.coalesce("difficulty_bias", F.lit(0)).alias("bias"))


@query("top_one_crop", "SELECT l_orderkey, arg_max(l_partkey, (CAST(l_returnflag = 'R' AS INT), l_quantity, l_extendedprice, -l_partkey)) AS best FROM lineitem GROUP BY l_orderkey")
def top_one_crop(s, d):
    order = F.struct((c("l_returnflag") == "R").cast("int").alias("m"), "l_quantity", "l_extendedprice", (-c("l_partkey")).alias("t"))
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", order).alias("best"))


@query("ord_expand_slots", "SELECT p_partkey, unnest(generate_series(1, p_size % 4)) AS n FROM part WHERE p_size % 4 > 0")
def ord_expand_slots(s, d):
    return table(s, d, "part").where("p_size % 4 > 0").select("p_partkey", F.explode(F.expr("sequence(1, p_size % 4)")).alias("n"))


@query("ord_drill", "SELECT o_orderkey, CAST(greatest(1, least(80, floor(o_totalprice / 3000))) AS BIGINT) AS n FROM orders")
def ord_drill(s, d):
    return table(s, d, "orders").select("o_orderkey", F.greatest(F.lit(1).cast("long"), F.least(F.lit(80).cast("long"), F.floor(c("o_totalprice") / 3000))).alias("n"))


@query("top_snippets", "SELECT conv_id, array_to_string(list(role || ': ' || length(text) ORDER BY turn)[:5], chr(10)) AS v FROM conversations GROUP BY conv_id")
def top_snippets(s, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(c("role"), F.lit(": "), F.length("text").cast("string")).alias("v"))))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.slice(rows, 1, 5), lambda x: x["v"]), "\n").alias("v"))


# Set operations.


@query("set_dropped_paths", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber <= 3 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber > 5")
def set_dropped_paths(s, d):
    t = table(s, d, "lineitem")
    return t.where("l_linenumber <= 3").select("l_partkey").subtract(t.where("l_linenumber > 5").select("l_partkey"))


@query("set_in_use", "SELECT p_partkey AS path FROM part WHERE p_size > 40 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_in_use(s, d):
    return table(s, d, "part").where("p_size > 40").select(c("p_partkey").alias("path")).union(table(s, d, "lineitem").where("l_quantity > 45").select("l_partkey")).distinct()


@query("set_delete_document", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def set_delete_document(s, d):
    gone = table(s, d, "customer").where("c_nationkey = 3").select(c("c_custkey").alias("o_custkey"))
    return sets.without(table(s, d, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("set_read_plan", "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'missing_image' WHEN o_orderstatus = 'F' AND o_orderkey % 10 > 0 THEN 'skipped' ELSE 'to_read' END AS plan FROM orders")
def set_read_plan(s, d):
    plan = F.when(c("o_orderpriority") == "5-LOW", "missing_image").when((c("o_orderstatus") == "F") & (c("o_orderkey") % 10 > 0), "skipped").otherwise("to_read")
    return table(s, d, "orders").select("o_orderkey", plan.alias("plan"))


@query("set_replace_page", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <> 2 UNION ALL SELECT o_orderkey, 2, 0.5 FROM orders")
def set_replace_page(s, d):
    fresh = table(s, d, "orders").select(c("o_orderkey").alias("l_orderkey"), F.lit(2).alias("l_linenumber"), F.lit(0.5).alias("l_quantity"))
    return sets.replace_where(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), fresh, "l_linenumber", 2)


@query("set_unique_rows", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def set_unique_rows(s, d):
    return sets.unique_rows(table(s, d, "events"), "user_id", ["event_id"]).select("user_id", "event_id")


@query("set_ids", "SELECT n_regionkey AS id FROM nation UNION SELECT c_nationkey FROM customer")
def set_ids(s, d):
    return table(s, d, "nation").select(c("n_regionkey").alias("id")).union(table(s, d, "customer").select("c_nationkey")).distinct()


@query("set_calibratable", "SELECT event_type AS skill FROM events WHERE value > 300 UNION SELECT 'grammar'")
def set_calibratable(s, d):
    return table(s, d, "events").where("value > 300").select(c("event_type").alias("skill")).union(s.createDataFrame([("grammar",)], "skill string")).distinct()


NEW_CUSTOMERS = "n AS (SELECT c_custkey + 700 AS id, upper(c_name) AS name FROM customer WHERE c_custkey % 2 = 0)"


def _new(s, d):
    return table(s, d, "customer").where("c_custkey % 2 = 0").select((c("c_custkey") + 700).alias("id"), F.upper("c_name").alias("name"))


def _old(s, d):
    return table(s, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"))


@query("set_upsert_ledger", f"WITH {NEW_CUSTOMERS} SELECT coalesce(n.id, c_custkey) AS id, coalesce(n.name, c_name) AS name FROM customer FULL JOIN n ON n.id = c_custkey")
def set_upsert_ledger(s, d):
    return sets.merge_columns(_old(s, d), _new(s, d), ["id"])


@query("set_insert_ignore", f"WITH {NEW_CUSTOMERS} SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT id, name FROM n WHERE id NOT IN (SELECT c_custkey FROM customer)")
def set_insert_ignore(s, d):
    return sets.insert_ignore(_old(s, d), _new(s, d), ["id"])


@query("set_replace_row", f"WITH {NEW_CUSTOMERS} SELECT id, name FROM n UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT id FROM n)")
def set_replace_row(s, d):
    return sets.upsert(_old(s, d), _new(s, d), ["id"])


@query("set_reindex_document", "SELECT user_id AS document_id, event_id FROM events WHERE user_id % 10 <> 1 UNION ALL SELECT user_id, event_id + 1000000 FROM events WHERE user_id % 10 = 1 AND event_type = 'view'")
def set_reindex_document(s, d):
    e = table(s, d, "events").select(c("user_id").alias("document_id"), "event_id", "event_type")
    gone = e.where("document_id % 10 = 1")
    rows = gone.where("event_type = 'view'").select("document_id", (c("event_id") + 1000000).alias("event_id"))
    # A document whose new rows are none is emptied too, so its id is listed with them.
    return e.select("document_id", "event_id").join(gone.select("document_id").distinct(), "document_id", "left_anti").unionByName(rows)


@query("set_append_page", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS page_index FROM orders")
def set_append_page(s, d):
    n = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(s, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("page_index"))


@query("set_ledger_delete", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE NOT (l_orderkey % 2 = 0 AND l_linenumber IN (1, 4)) GROUP BY ALL")
def set_ledger_delete(s, d):
    gone = s.createDataFrame([(0, 1), (0, 4)], "even int, l_linenumber int")
    t = table(s, d, "lineitem").withColumn("even", (c("l_orderkey") % 2).cast("int"))
    return sets.without(t, F.broadcast(gone), ["even", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("set_create_document", "SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderpriority END), ''), 'Untitled') AS title FROM orders")
def set_create_document(s, d):
    title = F.trim(F.when(c("o_orderkey") % 3 == 0, "  ").otherwise(c("o_orderpriority")))
    return table(s, d, "orders").select("o_orderkey", F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")).alias("title"))


@query("set_mark_ocr", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS read_mode FROM orders")
def set_mark_ocr(s, d):
    return table(s, d, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "F", c("o_orderpriority")).alias("read_mode"))


@query("set_resolve", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'earlier' END, 'now') AS resolved_at FROM orders")
def set_resolve(s, d):
    return table(s, d, "orders").select("o_orderkey", F.coalesce(F.when(c("o_orderkey") % 4 == 0, "earlier"), F.lit("now")).alias("resolved_at"))


@query("set_remove_page", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS page FROM lineitem WHERE l_linenumber <> 2")
def set_remove_page(s, d):
    t = table(s, d, "lineitem").where("l_linenumber != 2")
    return windows.renumbered(t, "l_orderkey", [c("l_linenumber"), c("l_partkey"), c("l_extendedprice")], "page").select("l_orderkey", "l_partkey", "page")


@query("set_manifest_prune", "SELECT p_partkey FROM part WHERE NOT (starts_with(p_name, 'red') OR p_brand = 'Brand#4') OR p_size = 7")
def set_manifest_prune(s, d):
    return table(s, d, "part").where(~(c("p_name").startswith("red") | (c("p_brand") == "Brand#4")) | (c("p_size") == 7)).select("p_partkey")


@query("set_preserve_published", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN TRUE END, FALSE) AS is_published, o_orderstatus AS status FROM orders")
def set_preserve_published(s, d):
    remote = table(s, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(True).alias("was"))
    new = table(s, d, "orders").select("o_orderkey", F.lit(False).alias("is_published"), c("o_orderstatus").alias("status"))
    return new.join(remote, "o_orderkey", "left").select("o_orderkey", F.coalesce("was", "is_published").alias("is_published"), "status")


@query("set_seed_remote", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 0)")
def set_seed_remote(s, d):
    have = table(s, d, "customer").where("c_custkey % 50 = 0").select(c("c_nationkey").alias("n_nationkey"))
    return sets.without(table(s, d, "nation").select("n_nationkey"), have, ["n_nationkey"])


@query("set_unlink_removed", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05) AS active FROM part")
def set_unlink_removed(s, d):
    kept = table(s, d, "lineitem").where("l_discount > 0.05").select(c("l_partkey").alias("p_partkey")).distinct().withColumn("k", F.lit(True))
    return table(s, d, "part").select("p_partkey").join(kept, "p_partkey", "left").select("p_partkey", c("k").isNotNull().alias("active"))


@query("set_checkpoint_upsert", f"WITH {NEW_CUSTOMERS} SELECT coalesce(c_custkey, n.id) AS id, coalesce(n.name, c_name) AS name, coalesce(c_custkey, n.id + 1000000) AS ord FROM customer FULL JOIN n ON n.id = c_custkey")
def set_checkpoint_upsert(s, d):
    old = _old(s, d).withColumn("ord", c("id"))
    new = _new(s, d).select("id", c("name").alias("new_name"))
    return old.join(new, "id", "full").select("id", F.coalesce("new_name", "name").alias("name"), F.coalesce("ord", c("id") + 1000000).alias("ord"))


@query("set_detach_lost", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 1 THEN 'pending' ELSE o_orderstatus END AS status FROM orders")
def set_detach_lost(s, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(s, d, "orders").select("o_orderkey", F.when(rank > 1, "pending").otherwise(c("o_orderstatus")).alias("status"))


# Joins.


@query(
    "jn_list_documents",
    "SELECT o_orderkey, coalesce(p.n, 0) AS page_count, CASE WHEN o_orderkey % 4 = 0 THEN 'complete' WHEN o_orderkey % 4 = 1 THEN 'in_progress' ELSE 'never' END AS push_status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) p ON l_orderkey = o_orderkey",
)
def jn_list_documents(s, d):
    pages = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    push = table(s, d, "orders").where("o_orderkey % 4 < 3").select("o_orderkey", F.expr("element_at(array('complete', 'in_progress', 'odd'), cast(o_orderkey % 4 as int) + 1)").alias("status"))
    out = table(s, d, "orders").select("o_orderkey").join(pages, "o_orderkey", "left").join(push, "o_orderkey", "left")
    known = F.when(c("status").isin("in_progress", "incomplete", "complete"), c("status")).otherwise("never")
    return out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("page_count"), known.alias("push_status"))


@query("jn_index_to_question", "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'")
def jn_index_to_question(s, d):
    refs = table(s, d, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_partkey")
    return refs.join(table(s, d, "part").select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey")).drop("p_partkey")


@query("jn_skill_dim", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn_skill_dim(s, d):
    return table(s, d, "customer").join(table(s, d, "nation"), c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "n_name")


@query("jn_catalog_name", "SELECT p_partkey, min(n_nationkey) AS id FROM (SELECT p_partkey, 'nation_' || (p_partkey % 30) AS name FROM part) JOIN (SELECT n_nationkey, unnest([lower(trim(n_name)), 'nation_' || n_nationkey]) AS alias FROM nation) ON lower(trim(name)) = alias GROUP BY p_partkey")
def jn_catalog_name(s, d):
    aliases = F.array(F.lower(F.trim("n_name")), F.concat(F.lit("nation_"), c("n_nationkey").cast("string")))
    names = table(s, d, "nation").select("n_nationkey", F.explode(aliases).alias("alias"))
    asked = table(s, d, "part").select("p_partkey", F.concat(F.lit("nation_"), (c("p_partkey") % 30).cast("string")).alias("name"))
    return asked.join(names, F.lower(F.trim("name")) == c("alias")).groupBy("p_partkey").agg(F.min("n_nationkey").alias("id"))


@query("jn_assert_ids", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 5)")
def jn_assert_ids(s, d):
    known = table(s, d, "supplier").where("s_nationkey != 5").select(c("s_suppkey").alias("l_suppkey"))
    return table(s, d, "lineitem").select("l_suppkey").distinct().join(known, "l_suppkey", "left_anti")


@query("jn_stale_links", "SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 10)")
def jn_stale_links(s, d):
    plan = table(s, d, "lineitem").where("l_quantity > 10").select(c("l_partkey").alias("p_partkey"))
    return table(s, d, "part").select("p_partkey").join(plan, "p_partkey", "left_anti").distinct()


@query("jn_stale_sections", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def jn_stale_sections(s, d):
    n = table(s, d, "nation").select("n_nationkey")
    n = n.join(table(s, d, "supplier").select(c("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_anti")
    return n.join(table(s, d, "customer").where("c_acctbal > 9000").select(c("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_anti")


@query("jn_retired_groups", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'keep' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'retire' ELSE 'delete' END AS outcome FROM customer")
def jn_retired_groups(s, d):
    o = table(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.bool_or(c("o_orderstatus") == "P").alias("wanted"))
    out = table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return out.select("c_custkey", F.when(c("wanted"), "keep").when(~c("wanted"), "retire").otherwise("delete").alias("outcome"))


@query(
    "jn_needs_push",
    "WITH u AS (SELECT o_orderkey AS id, md5(o_orderstatus || o_orderpriority) AS content_hash, CAST(o_orderkey % 3 AS INT) AS options FROM orders) SELECT id, CASE WHEN id % 7 = 0 OR id % 13 = 0 THEN 'changed' WHEN id % 5 = 0 THEN 'missing' WHEN id % 11 = 0 THEN 'drifted' END AS why FROM u",
)
def jn_needs_push(s, d):
    u = table(s, d, "orders").select(c("o_orderkey").alias("id"), F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("content_hash"), (c("o_orderkey") % 3).cast("int").alias("options"))
    ledger = u.where("id % 7 != 0").select("id", F.when(c("id") % 13 == 0, "old").otherwise(c("content_hash")).alias("content_hash"))
    here = u.where("id % 5 != 0").select("id", (c("options") + F.when(c("id") % 11 == 0, 1).otherwise(0)).alias("options"))
    return sets.needs_push(u, ledger, here, "id", ["options"]).select("id", "why")


@query("jn_learned_extras", "WITH {qi} SELECT DISTINCT a.subject_id, a.skill_type, a.pattern_subtype FROM qi a WHERE NOT EXISTS (SELECT 1 FROM qi b WHERE b.standard_id = 5 AND b.subject_id IS NOT DISTINCT FROM a.subject_id AND b.skill_type IS NOT DISTINCT FROM a.skill_type AND b.pattern_subtype IS NOT DISTINCT FROM a.pattern_subtype AND b.marks > 60)")
def jn_learned_extras(s, d):
    keys = ["subject_id", "skill_type", "pattern_subtype"]
    a = question_index(s, d).select(*keys).distinct()
    b = question_index(s, d).where("standard_id = 5 and marks > 60").select(*[c(k).alias(f"b_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"b_{k}"))
    return a.join(b, same, "left_anti")


# Page geometry: boxes from line items of an order, a page each.

BOXES = "b AS (SELECT l_orderkey AS page, l_partkey AS id, l_linenumber AS kind, l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem)"


def _boxes(s, d):
    return table(s, d, "lineitem").select(c("l_orderkey").alias("page"), c("l_partkey").alias("id"), c("l_linenumber").alias("kind"), (c("l_quantity") / 50).alias("x"), (c("l_extendedprice") / 100000).alias("y"))


@query(
    "jn_figure_owner",
    f"WITH {BOXES}, p AS (SELECT f.page, f.id AS figure, a.id AS anchor, a.y, row_number() OVER (PARTITION BY f.page, f.id, f.x, f.y ORDER BY CAST((a.x < 0.5) = (f.x < 0.5) AS INT) DESC, a.y DESC, a.id) AS r, bool_or((a.x < 0.5) = (f.x < 0.5)) OVER (PARTITION BY f.page, f.id, f.x, f.y) AS has FROM b f JOIN b a ON a.page = f.page AND a.kind <= 3 WHERE f.kind > 5) SELECT page, figure, anchor FROM (SELECT f.page, f.id AS figure, arg_max(a.id, (a.y, -a.id)) AS anchor FROM (SELECT DISTINCT page, id, x, y FROM b WHERE kind > 5) f JOIN b a ON a.page = f.page AND a.kind <= 3 AND a.y <= f.y + 0.04 AND ((a.x < 0.5) = (f.x < 0.5) OR NOT EXISTS (SELECT 1 FROM b z WHERE z.page = f.page AND z.kind <= 3 AND (z.x < 0.5) = (f.x < 0.5))) GROUP BY f.page, f.id, f.x, f.y)",
)
def jn_figure_owner(s, d):
    b = _boxes(s, d)
    f = b.where("kind > 5").select("page", c("id").alias("figure"), c("x").alias("fx"), c("y").alias("fy")).distinct()
    pairs = f.join(b.where("kind <= 3"), "page").withColumn("same", (c("x") < 0.5) == (c("fx") < 0.5))
    any_same = F.max("same").over(Window.partitionBy("page", "figure", "fx", "fy"))
    pool = pairs.withColumn("any", any_same).where((c("same") | ~c("any")) & (c("y") <= c("fy") + 0.04))
    best = pool.groupBy("page", "figure", "fx", "fy").agg(F.max_by("id", F.struct("y", (-c("id")).alias("t"))).alias("anchor"))
    return best.select("page", "figure", "anchor")


@query("jn_line_in_block", f"WITH {BOXES} SELECT k.page, k.id AS block, l.id AS line FROM b k JOIN b l ON l.page = k.page AND l.x BETWEEN k.x AND k.x + 0.3 AND l.y BETWEEN k.y AND k.y + 0.2 WHERE k.kind = 1")
def jn_line_in_block(s, d):
    b = _boxes(s, d)
    k = b.where("kind = 1").select("page", c("id").alias("block"), c("x").alias("kx"), c("y").alias("ky"))
    inside = c("x").between(c("kx"), c("kx") + 0.3) & c("y").between(c("ky"), c("ky") + 0.2)
    return k.join(b, "page").where(inside).select("page", "block", c("id").alias("line"))


@query("jn_stacked_pairs", f"WITH {BOXES} SELECT u.page, u.id AS above, v.id AS below FROM b u JOIN b v ON u.page = v.page AND v.y > u.y AND v.y - u.y < 0.1 AND abs(v.x - u.x) < 0.2")
def jn_stacked_pairs(s, d):
    b = _boxes(s, d)
    u = b.select("page", c("id").alias("above"), c("x").alias("ux"), c("y").alias("uy"))
    v = b.select("page", c("id").alias("below"), c("x").alias("vx"), c("y").alias("vy"))
    close = (c("vy") > c("uy")) & (c("vy") - c("uy") < 0.1) & (F.abs(c("vx") - c("ux")) < 0.2)
    return u.join(v, "page").where(close).select("page", "above", "below")


@query(
    "jn_attach_blocks",
    "WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE event_id % 2 = 1) SELECT a.event_id AS question, b.event_id AS block FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.r = b.r",
)
def jn_attach_blocks(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "event_id", F.row_number().over(Window.partitionBy("user_id", "event_type", c("event_id") % 2).orderBy("event_id")).alias("r"))
    a, b = (e.where(f"event_id % 2 = {k}").select("user_id", "event_type", "r", c("event_id").alias(n)) for k, n in ((0, "question"), (1, "block")))
    return a.join(b, ["user_id", "event_type", "r"], "full").select("question", "block")


@query("jn_option_figure", "SELECT p_partkey, n_nationkey FROM part JOIN nation ON regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') = 'BRAND' || n_nationkey")
def jn_option_figure(s, d):
    token = F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    n = table(s, d, "nation").select("n_nationkey", F.concat(F.lit("BRAND"), c("n_nationkey").cast("string")).alias("t"))
    return table(s, d, "part").join(n, token == c("t")).select("p_partkey", "n_nationkey")


@query("fn_clamp_box", f"WITH {BOXES} SELECT page, id, floor(greatest(0.0, least(1.0, y * 3 - 0.5)) * 10000 + 0.5) / 10000 AS y FROM b")
def fn_clamp_box(s, d):
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("y") * 3 - 0.5))
    return _boxes(s, d).select("page", "id", (F.floor(y * 10000 + 0.5) / 10000).alias("y"))


@query("src_tesseract_tsv", "SELECT l_orderkey, l_returnflag, min(l_quantity) AS x0, max(l_quantity) AS x1, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS text, round(avg(l_discount), 6) AS confidence FROM lineitem WHERE l_tax > 0 GROUP BY l_orderkey, l_returnflag")
def src_tesseract_tsv(s, d):
    words = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda w: w["l_partkey"].cast("string"))
    return table(s, d, "lineitem").where("l_tax > 0").groupBy("l_orderkey", "l_returnflag").agg(
        F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.array_join(words, " ").alias("text"), F.round(F.avg("l_discount"), 6).alias("confidence"),
    )


# Calibration.


@query(
    "val_alerts",
    "WITH g AS (SELECT source, count(*) AS cases, CAST(sum(quality) AS BIGINT) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY source), a AS (SELECT source, source || ' passed only ' || passed || '/' || cases AS reason, CASE WHEN passed / cases < 0.8 THEN 'high' ELSE 'low' END AS severity FROM g WHERE passed / cases < 0.9) SELECT * FROM a WHERE source NOT IN ('src1', 'src3')",
)
def val_alerts(s, d):
    g = _cases(s, d).groupBy("source").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))
    score = c("passed") / c("cases")
    reason = F.concat(c("source"), F.lit(" passed only "), c("passed").cast("string"), F.lit("/"), c("cases").cast("string"))
    raised = g.where(score < 0.9).select("source", reason.alias("reason"), F.when(score < 0.8, "high").otherwise("low").alias("severity"))
    open_ = s.createDataFrame([("src1",), ("src3",)], "source string")
    return raised.join(F.broadcast(open_), "source", "left_anti")


@query("val_train_pass", "SELECT source, sum(quality) / count(*) >= 0.6 AS passed FROM documents JOIN labels USING (doc_id) GROUP BY source")
def val_train_pass(s, d):
    return _cases(s, d).groupBy("source").agg((F.try_divide(F.count_if("passed"), F.count("*")) >= 0.6).alias("passed"))


@query("gen_syllabus_slots", "SELECT r_name AS subject, n_name AS section, c_mktsegment AS skill, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def gen_syllabus_slots(s, d):
    t = table(s, d, "customer").join(table(s, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(table(s, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return t.groupBy(c("r_name").alias("subject"), c("n_name").alias("section"), c("c_mktsegment").alias("skill")).agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback retrieval for every request, joined to how often its skill was learned."""
    skills = QUERIES["agg_learned_skills"](spark, sf_dir).groupBy("skill_type").agg(F.sum("source_count").alias("sources"), F.sum("mock_count").alias("mocks"))
    found = QUERIES["top_ladder_exemplar"](spark, sf_dir)
    index = question_index(spark, sf_dir).select("question_id", "skill_type", "created_at")
    return found.join(index, "question_id").join(skills, "skill_type", "left")
