"""Queries for checks, scores, settings and generation jobs, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.functions import ids
from questmill.operators import export, jobs, validation
from questmill.plans.export_queries import FLAT_SQL, _uuid
from questmill.plans.text_queries import NAMESPACE, norm
from questmill.sources.driver_tables import QUESTIONS_SQL, questions, table
from questmill.sources.question_trees import library_documents, library_questions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "val_combine",
    """WITH g AS (SELECT l_orderkey, list({'s': CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'N' THEN 'needs_review' ELSE 'passed' END, 'd': l_linestatus || l_linenumber} ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag) AS x FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN len([y FOR y IN x IF y.s = 'failed']) > 0 THEN 'failed' WHEN len([y FOR y IN x IF y.s = 'needs_review']) > 0 THEN 'needs_review' ELSE 'passed' END AS status, array_to_string([y.d FOR y IN x IF y.s <> 'passed'], ',') AS errors FROM g""",
)
def val_combine(s, d):
    status = F.when(c("l_returnflag") == "R", "failed").when(c("l_returnflag") == "N", "needs_review").otherwise("passed")
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", c("l_partkey").cast("string").alias("name"), status.alias("status"), F.concat("l_linestatus", c("l_linenumber").cast("string")).alias("details"))
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("checks"))
    g = g.select("l_orderkey", validation.combined(c("checks")).alias("v"))
    return g.select("l_orderkey", "v.status", F.array_join("v.errors", ",").alias("errors"))


@query(
    "val_grammar",
    f"""WITH {QUESTIONS_SQL}, b AS (SELECT q.*, CAST(doc_id % 3 AS INT) AS marked, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN stem || ' and more words besides these here now' ELSE 'something else' END AS source FROM q),
x AS (SELECT doc_id, kind = 'mcq' AND trim(stem) <> '' AS schema_ok, trim(stem) <> '' AS has_stem, len(options) AS n, marked, source, {norm('stem')} AS a, string_split({norm('source')}, ' ') AS w FROM b),
y AS (SELECT *, length(a) >= 40 AND len([i FOR i IN generate_series(1, len(w) - 7) IF length(array_to_string(w[i:i + 7], ' ')) >= 24 AND contains(a, array_to_string(w[i:i + 7], ' '))]) > 0 AS copied FROM x)
SELECT doc_id, CASE WHEN NOT schema_ok OR n <> 4 OR marked <> 1 THEN 'failed' WHEN source IS NOT NULL AND copied THEN 'needs_review' ELSE 'passed' END AS status,
  array_to_string(list_filter([CASE WHEN NOT schema_ok THEN CASE WHEN has_stem THEN 'Grammar item has a stem.' ELSE 'Grammar item is missing a stem.' END END, CASE WHEN n <> 4 THEN 'Expected 4 options, found ' || n || '.' END,
    CASE WHEN marked <> 1 THEN 'Expected one answer, found ' || marked || '.' END, CASE WHEN source IS NOT NULL AND copied THEN 'The stem repeats a long phrase from the source.' END], lambda e: e IS NOT NULL), ' ') AS errors FROM y""",
)
def val_grammar(s, d):
    source = F.when(c("doc_id") % 4 == 1, F.concat(c("stem"), F.lit(" and more words besides these here now"))).when(c("doc_id") % 4 > 1, "something else")
    checks = validation.grammar_checks(c("kind"), c("stem"), c("options"), (c("doc_id") % 3).cast("int"), source)
    v = questions(s, d).select("doc_id", validation.combined(checks).alias("v"))
    return v.select("doc_id", "v.status", F.array_join("v.errors", " ").alias("errors"))


@query(
    "val_score",
    """WITH x AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS a, o_orderkey % 3 > 0 AS b, o_orderkey % 5 > 0 AS e, o_orderkey % 7 > 0 AS f, o_orderkey % 11 = 0 AS copied, o_custkey % 4 = 0 AS solver, o_custkey % 3 = 0 AS solved, o_custkey % 2 = 0 AS judged, o_orderstatus = 'F' AS eq, (o_custkey % 16) / 15 AS m FROM orders),
y AS (SELECT *, a AND b AND e AND f AND NOT copied AS fine, (a::INT + b::INT + e::INT + f::INT + (NOT copied)::INT) / 5 AS share FROM x)
SELECT o_orderkey, round(CASE WHEN solver THEN CASE WHEN NOT fine THEN 0 WHEN solved THEN 1 ELSE 0.4 END WHEN judged THEN 0.5 * share + 0.5 * m ELSE share END, 9) AS score,
  CASE WHEN solver THEN fine AND solved WHEN judged THEN fine AND eq AND m >= 0.6 ELSE fine END AS passed FROM y""",
)
def val_score(s, d):
    k = c("o_orderkey")
    structural = {"schema_valid": k % 2 == 0, "has_answers": k % 3 > 0, "option_count_ok": k % 5 > 0, "skill_match": k % 7 > 0, "copied_reference": k % 11 == 0}
    structural["passed"] = structural["schema_valid"] & structural["has_answers"] & structural["option_count_ok"] & structural["skill_match"] & ~structural["copied_reference"]
    u = c("o_custkey")
    v = validation.case_score(structural, u % 4 == 0, u % 3 == 0, u % 2 == 0, c("o_orderstatus") == "F", F.lit(True), (u % 16) / F.lit(15))
    return table(s, d, "orders").select("o_orderkey", F.round(v["score"], 9).alias("score"), v["passed"].alias("passed"))


@query(
    "val_profile",
    """WITH x AS (SELECT c_nationkey || ':' || c_mktsegment AS scope_key, c_mktsegment AS skill_type, count(*) AS cases, count_if(c_acctbal > 3000) AS passed, bool_and(c_custkey % 2 = 0) AS unjudged, count_if(c_custkey % 5 = 0) AS refs, avg(c_custkey % 3) AS g, avg(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END) AS r FROM customer GROUP BY c_nationkey, c_mktsegment),
y AS (SELECT *, passed / cases AS score, NOT unjudged AND (cases = 0 OR passed / cases < 0.6) AS weak, CASE WHEN g < r - 0.25 THEN 1 WHEN g > r + 0.25 THEN -1 ELSE 0 END AS bias FROM x)
SELECT scope_key, skill_type, CAST(CASE WHEN weak THEN 5 ELSE 3 END AS INT) AS exemplar_limit, CASE WHEN refs > 0 THEN 'exact' ELSE 'skill' END AS exemplar_scope, CAST(bias AS INT) AS difficulty_bias FROM y""",
)
def val_profile(s, d):
    k = c("c_custkey")
    g = table(s, d, "customer").groupBy("c_nationkey", c("c_mktsegment").alias("skill_type")).agg(
        F.count("*").alias("cases"), F.count_if(c("c_acctbal") > 3000).alias("passed"), F.bool_and(k % 2 == 0).alias("unjudged"), F.count_if(k % 5 == 0).alias("references"),
        F.avg(k % 3).alias("generated"), F.avg(F.when(k % 4 > 0, k % 4)).alias("reference"),
    )
    g = g.withColumns({"score": c("passed") / c("cases"), "scope_key": F.concat(c("c_nationkey").cast("string"), F.lit(":"), c("skill_type"))})
    return validation.tuned(g).drop("rationale")


_ID = f"CASE WHEN id LIKE '%0' THEN id ELSE {_uuid('id')} END"
_NAME = "'Question ' || id || "


@query(
    "val_export",
    f"""WITH {FLAT_SQL}, x AS (SELECT {_ID} AS id, CASE WHEN id LIKE '%3' THEN 'essay' ELSE exam_type END AS t, CASE WHEN id LIKE '%4' THEN 'odd' ELSE coalesce(difficulty, 'medium') END AS f, CASE WHEN id LIKE '%7' THEN 0.25 ELSE m END AS m, neg FROM flat),
y AS (SELECT id, unnest(list_filter(CASE WHEN id LIKE 'q%' THEN ['Question "' || id || '" is not a UUID.'] ELSE [CASE WHEN t = 'essay' THEN {_NAME}' has unsupported type "essay".' END, CASE WHEN f = 'odd' THEN {_NAME}' has unsupported difficulty "odd".' END,
  CASE WHEN m = 0.25 THEN {_NAME}' has marks outside the numeric(4,1) range.' END, CASE WHEN neg = 0.25 THEN {_NAME}' has negative marks outside the numeric(4,1) range.' END] END, lambda e: e IS NOT NULL)) AS error FROM x),
k AS (SELECT {_ID} AS id, CASE WHEN o.key = 'D' THEN 'C' WHEN o.key = 'B' AND id LIKE '%2' THEN '' ELSE o.key END AS key FROM opts),
z AS (SELECT id, key, count(*) AS n FROM k WHERE id NOT LIKE 'q%' GROUP BY ALL)
SELECT id AS question_id, error FROM y UNION ALL SELECT id, {_NAME}' has an option without a key.' FROM z WHERE key = '' UNION ALL SELECT id, {_NAME}' has duplicate option key ' || key || '.' FROM z WHERE key <> '' AND n > 1""",
)
def val_export(s, d):
    tables = export.export_tables(library_documents(s, d), library_questions(s, d), NAMESPACE)
    named = lambda i: F.when(i.endswith("0"), i).otherwise(ids.stable_uuid(NAMESPACE, i))
    q = tables["questions"].select(
        named(c("id")).alias("id"), F.when(c("id").endswith("3"), "essay").otherwise(c("question_type")).alias("question_type"), F.when(c("id").endswith("4"), "odd").otherwise(c("difficulty")).alias("difficulty"),
        F.when(c("id").endswith("7"), 0.25).otherwise(c("marks")).alias("marks"), "negative_marks",
    )
    key = F.when(c("option_key") == "D", "C").when((c("option_key") == "B") & c("question_id").endswith("2"), "").otherwise(c("option_key"))
    return validation.export_errors(q, tables["question_options"].select(named(c("question_id")).alias("question_id"), key.alias("option_key")))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    """A job a customer: some follow sources, and some have items already."""
    k = c("c_custkey")
    item = F.struct(
        F.lit("old").alias("item_id"), F.lit(0).alias("sequence"), F.lit(None).cast("string").alias("source_question_id"), F.lit("review").alias("stage"), F.lit("done").alias("status"), F.lit(1).alias("attempt_count"),
        F.lit(None).cast("string").alias("last_error"), F.array(F.lit("analysis"), F.lit("review")).alias("completed_stages"),
    )
    return table(s, d, "customer").select(
        "c_custkey", F.concat(F.lit("j"), k.cast("string")).alias("job_id"), F.when(k % 3 == 0, "from_source").otherwise("drill").alias("mode"), F.when(k % 4 > 0, (k % 4).cast("int")).alias("planned_count"),
        F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("source_question_ids"), F.when(k % 5 == 0, F.array(item)).otherwise(F.array().cast(f"array<{jobs.ITEM}>")).alias("items"),
        F.element_at(F.array(F.lit("completed"), F.lit("in_progress"), F.lit(None)), (k % 3 + 1).cast("int")).alias("status"),
    )


_JOBS_SQL = """j AS (SELECT c_custkey, 'j' || c_custkey AS job_id, c_custkey % 3 = 0 AS sourced, CASE WHEN c_custkey % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END AS src, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 ELSE 0 END AS planned, c_custkey % 5 = 0 AS old FROM customer),
n AS (SELECT *, greatest(CASE WHEN old THEN 1 ELSE 0 END, CASE WHEN sourced THEN len(src) ELSE planned END) AS n FROM j), i AS (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM n)"""


@query("st_ensure_items", f"WITH {_JOBS_SQL} SELECT c_custkey, CASE WHEN old AND k = 0 THEN 'old' ELSE job_id || ':' || k END AS item_id, CAST(k AS INT) AS sequence, CASE WHEN sourced AND NOT (old AND k = 0) THEN src[k + 1] END AS source_question_id, CASE WHEN old AND k = 0 THEN 'review' ELSE 'analysis' END AS stage FROM i")
def st_ensure_items(s, d):
    return jobs.ensure_items(_jobs(s, d)).select("c_custkey", F.explode("items").alias("i")).select("c_custkey", "i.item_id", "i.sequence", "i.source_question_id", "i.stage")


@query("st_with_stage", f"WITH {_JOBS_SQL} SELECT c_custkey, CAST(k AS INT) AS sequence, 'review' AS stage, CASE WHEN old AND k = 0 THEN 'analysis,review' ELSE 'review' END AS completed FROM i")
def st_with_stage(s, d):
    moved = F.transform("items", lambda i: jobs.with_stage(i, F.lit("review")))
    return jobs.ensure_items(_jobs(s, d)).select("c_custkey", F.explode(moved).alias("i")).select("c_custkey", "i.sequence", "i.stage", F.array_join("i.completed_stages", ",").alias("completed"))


@query("st_fail", f"WITH {_JOBS_SQL} SELECT c_custkey, CAST(k AS INT) AS sequence, CAST(CASE WHEN old AND k = 0 THEN 2 ELSE 1 END AS INT) AS attempt_count, CASE WHEN old AND k = 0 THEN 'failed' ELSE 'pending' END AS status, 'timed out' AS last_error FROM i")
def st_fail(s, d):
    tried = F.transform("items", lambda i: jobs.failed(i, F.lit("timed out")))
    return jobs.ensure_items(_jobs(s, d)).select("c_custkey", F.explode(tried).alias("i")).select("c_custkey", "i.sequence", "i.attempt_count", "i.status", "i.last_error")


@query("st_in_progress", "SELECT c_custkey, c_custkey % 3 = 1 AS open FROM customer")
def st_in_progress(s, d):
    return _jobs(s, d).select("c_custkey", jobs.incomplete().alias("open"))
