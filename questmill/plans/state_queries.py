"""Queries for states, replies in loose JSON, drafts and runs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from questmill.functions import loose
from questmill.operators import drafts, jobs, windows
from questmill.plans.text_queries import lit
from questmill.sources.driver_tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


#: JSON of job states, # is the row's number: whole, sparse, wrongly typed, of unknown mode, broken, empty, none.
STATES = [
    '{"mode":"from_source","status":"in_progress","instructions":"do #","planned_count":#,"source_question_ids":["a#",7,null,"b"],"cursor":2,"last_error":"late","pairs":[{"source_question_id":"s","mock_question_id":"m#"},{"mock_question_id":""},{"mock_question_id":"n","source_question_id":3},5,null],"job_id":"j#","items":[{"item_id":"j#:0","idempotency_key":"k","sequence":0,"stage":"review","status":"running","attempt_count":1,"validation_status":"passed","completed_stages":["analysis","odd",3,"asset"]},{"item_id":"j#:1"},{"item_id":"x","idempotency_key":"y","stage":"nope","status":8,"attempt_count":"2","validation_status":"maybe","completed_stages":"review"}],"strategy":"rewrite","agent":"past_paper"}',
    '{"mode":"from_instructions","blueprint":[{"skill":"s","count":2},{"skill":"t"},{"count":1},[],{"skill":5,"count":1},{"skill":"u","count":1.5}],"difficulty_step":-1,"drill_skill":"d#","figure_skills":{"a":"b","c":1,"d":null,"e":"f"},"plan":[{"skill":"p","topic":9,"count":3,"subject_id":4},{"topic":"no skill"},{"skill":"q","pattern_subtype":"ps","subject_key":"k","topic":"t","difficulty_step":1}],"generation_target":"topic","agent":"else"}',
    '{"mode":"from_source","status":"odd","instructions":5,"planned_count":"7","source_question_ids":"a","cursor":"1","last_error":{},"pairs":{"a":1},"job_id":9,"items":7,"blueprint":{},"strategy":"none","difficulty_step":"1","drill_skill":null,"figure_skills":[],"plan":[{"skill":1}],"generation_target":1}',
    '{"mode":"from_source"}',
    '{"mode":"other","cursor":1}',
    '{"cursor":1}',
    '["from_source"]',
    '{"mode":"from_source",',
    "",
    '"from_source"',
    None,
]


def _raw(texts: list[str | None], key: Column) -> Column:
    found = F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int"))
    return F.replace(found, F.lit("#"), key.cast("string"))


def _raw_sql(texts: list[str | None], key: str) -> str:
    return f"replace([{', '.join('NULL' if t is None else lit(t) for t in texts)}][{key} % {len(texts)} + 1], '#', CAST({key} AS VARCHAR))"


# Typed access in DuckDB: a text, a number, the elements of an array.
def _t(j: str, p: str = "$") -> str:
    return f"CASE WHEN json_type({j}, '{p}') = 'VARCHAR' THEN json_extract_string({j}, '{p}') END"


def _n(j: str, p: str) -> str:
    return f"CASE WHEN json_type({j}, '{p}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract({j}, '{p}') AS DOUBLE) END"


def _a(j: str, p: str) -> str:
    return f"CASE WHEN json_type({j}, '{p}') = 'ARRAY' THEN CAST(json_extract({j}, '{p}') AS JSON[]) ELSE [] END"


def _in(value: str, known: tuple[str, ...], otherwise: str = "NULL") -> str:
    return f"CASE WHEN {value} IN ({', '.join(map(lit, known))}) THEN {value} ELSE {otherwise} END"


_ITEM = (
    f"({_t('x', '$.item_id')}) || ':' || {_in(_t('x', '$.stage'), loose.STAGES, lit('analysis'))} || ':' || {_in(_t('x', '$.status'), loose.ITEM_STATUSES, lit('pending'))} || ':' || "
    f"CAST(coalesce({_n('x', '$.attempt_count')}, 0) AS BIGINT) || ':' || coalesce({_in(_t('x', '$.validation_status'), loose.VERDICTS)}, '-') || ':' || "
    f"array_to_string([{_t('y')} FOR y IN {_a('x', '$.completed_stages')} IF {_t('y')} IN ({', '.join(map(lit, loose.STAGES))})], '+')"
)
_SLOT = (
    f"({_t('x', '$.skill')}) || ':' || coalesce({_t('x', '$.pattern_subtype')}, '-') || ':' || coalesce(CAST(CAST({_n('x', '$.subject_id')} AS BIGINT) AS VARCHAR), '-') || ':' || coalesce({_t('x', '$.subject_key')}, '')"
    f" || ':' || coalesce({_t('x', '$.topic')}, '') || ':' || CAST(coalesce({_n('x', '$.count')}, 1) AS BIGINT) || ':' || CAST(coalesce({_n('x', '$.difficulty_step')}, 0) AS BIGINT)"
)


@query(
    "prj_parse_generation",
    f"""WITH r AS (SELECT o_orderkey, {_raw_sql(STATES, 'o_orderkey')} AS raw FROM orders),
s AS (SELECT o_orderkey, CAST(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS JSON) AS j FROM r)
SELECT o_orderkey, {_t('j', '$.mode')} AS mode, {_in(_t('j', '$.status'), loose.STATUSES, lit('pending'))} AS status, {_t('j', '$.instructions')} AS instructions,
  {_n('j', '$.planned_count')} AS planned_count, array_to_string([{_t('x')} FOR x IN {_a('j', '$.source_question_ids')} IF {_t('x')} IS NOT NULL], '|') AS sources,
  coalesce({_n('j', '$.cursor')}, 0) AS cursor, {_t('j', '$.last_error')} AS last_error,
  array_to_string([coalesce({_t('x', '$.source_question_id')}, '-') || '>' || ({_t('x', '$.mock_question_id')}) FOR x IN {_a('j', '$.pairs')} IF coalesce({_t('x', '$.mock_question_id')}, '') <> ''], '|') AS pairs,
  {_t('j', '$.job_id')} AS job_id,
  array_to_string([{_ITEM} FOR x IN {_a('j', '$.items')} IF coalesce({_t('x', '$.item_id')}, '') <> '' AND coalesce({_t('x', '$.idempotency_key')}, '') <> ''], '|') AS items,
  CASE WHEN json_type(j, '$.blueprint') = 'ARRAY' THEN array_to_string([({_t('x', '$.skill')}) || '=' || CAST(floor(10 * ({_n('x', '$.count')})) AS BIGINT) FOR x IN {_a('j', '$.blueprint')} IF {_t('x', '$.skill')} IS NOT NULL AND {_n('x', '$.count')} IS NOT NULL], '|') END AS blueprint,
  {_in(_t('j', '$.strategy'), loose.STRATEGIES)} AS strategy, {_n('j', '$.difficulty_step')} AS difficulty_step, {_t('j', '$.drill_skill')} AS drill_skill,
  CASE WHEN json_type(j, '$.figure_skills') = 'OBJECT' THEN array_to_string([k || '=' || json_extract_string(j, '$.figure_skills.' || k) FOR k IN list_sort(json_keys(j, '$.figure_skills')) IF json_type(j, '$.figure_skills.' || k) = 'VARCHAR'], '|') END AS figure_skills,
  nullif(array_to_string([{_SLOT} FOR x IN {_a('j', '$.plan')} IF {_t('x', '$.skill')} IS NOT NULL], '|'), '') AS plan,
  {_in(_t('j', '$.generation_target'), loose.TARGETS)} AS target, {_in(_t('j', '$.agent'), loose.AGENTS)} AS agent
FROM s WHERE json_type(j) = 'OBJECT' AND {_t('j', '$.mode')} IN ('from_source', 'from_instructions')""",
)
def prj_parse_generation(s, d):
    g = table(s, d, "orders").select("o_orderkey", loose.generation_state(_raw(STATES, c("o_orderkey"))).alias("g")).where("g is not null")
    whole = lambda x: x.cast("long").cast("string")
    said = lambda name, make: F.array_join(F.transform(f"g.{name}", make), "|")
    dash = lambda x: F.coalesce(x, F.lit("-"))
    item = lambda x: F.concat_ws(":", x["item_id"], x["stage"], x["status"], whole(x["attempt_count"]), dash(x["validation_status"]), F.array_join(x["completed_stages"], "+"))
    slot = lambda x: F.concat_ws(":", x["skill"], dash(x["pattern_subtype"]), dash(whole(x["subject_id"])), x["subject_key"], x["topic"], whole(x["count"]), whole(x["difficulty_step"]))
    skills = F.array_join(F.transform(F.array_sort(F.map_entries("g.figure_skills")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return g.select(
        "o_orderkey", "g.mode", "g.status", "g.instructions", "g.planned_count", F.array_join("g.source_question_ids", "|").alias("sources"), "g.cursor", "g.last_error",
        said("pairs", lambda p: F.concat(dash(p["source_question_id"]), F.lit(">"), p["mock_question_id"])).alias("pairs"), "g.job_id", said("items", item).alias("items"),
        said("blueprint", lambda b: F.concat(b["skill"], F.lit("="), whole(F.floor(b["count"] * 10)))).alias("blueprint"), "g.strategy", "g.difficulty_step", "g.drill_skill",
        skills.alias("figure_skills"), said("plan", slot).alias("plan"), c("g.generation_target").alias("target"), "g.agent",
    )


#: Replies of a search: both places of the list, all names, too many results, empty ones, wrong types, broken.
SEARCHES = [
    '{"data":{"results":[{"title":" T# ","url":" u ","snippet":" s "},{"title":"","snippet":" "},{"title":4,"content":"c"},7,{"description":"d","link":"l"},{"title":"a"},{"title":"b"},{"title":"c"},{"title":"d"}]}}',
    '{"results":[{"title":"T#","url":3,"link":"l","snippet":null,"content":"c","description":"d"}]}',
    '{"data":{"x":1},"results":[{"title":"outer #"}]}',
    '{"organic":[{"title":"o#"}],"items":[{"title":"i"}]}',
    '{"data":{"items":[{"snippet":"i#"}]},"items":[{"snippet":"outer"}]}',
    '{"data":[1],"items":[{"snippet":"j#"}]}',
    '{"results":{"title":"no list"}}',
    "[]",
    "{broken",
    None,
]


@query(
    "src_search_body",
    f"""WITH r AS (SELECT event_id, {_raw_sql(SEARCHES, 'event_id')} AS raw FROM events),
s AS (SELECT event_id, CAST(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS JSON) AS j FROM r),
x AS (SELECT event_id, j, CASE WHEN json_type(j, '$.data') = 'OBJECT' THEN json_extract(j, '$.data') ELSE j END AS y FROM s),
l AS (SELECT event_id, CASE WHEN json_type(j) <> 'OBJECT' THEN [] WHEN json_type(y, '$.results') = 'ARRAY' THEN {_a('y', '$.results')} WHEN json_type(y, '$.organic') = 'ARRAY' THEN {_a('y', '$.organic')}
  WHEN json_type(j, '$.results') = 'ARRAY' THEN {_a('j', '$.results')} ELSE {_a('y', '$.items')} END AS l FROM x),
o AS (SELECT event_id, [{{'t': coalesce(trim({_t('z', '$.title')}), ''), 'u': coalesce(trim({_t('z', '$.url')}), trim({_t('z', '$.link')}), ''),
  's': coalesce(trim({_t('z', '$.snippet')}), trim({_t('z', '$.content')}), trim({_t('z', '$.description')}), '')}} FOR z IN l IF json_type(z) = 'OBJECT'] AS o FROM l)
SELECT event_id, array_to_string([z.t || '|' || z.u || '|' || z.s FOR z IN [z FOR z IN o IF z.t <> '' OR z.s <> ''][:5]], ';') AS snippets FROM o""",
)
def src_search_body(s, d):
    found = F.transform(loose.search_snippets(_raw(SEARCHES, c("event_id"))), lambda x: F.concat_ws("|", x["title"], x["url"], x["snippet"]))
    return table(s, d, "events").select("event_id", F.array_join(found, ";").alias("snippets"))


#: Replies of a chat: streams with pieces, parts, reasoning, errors and junk; single objects; broken ones.
CHATS = [
    'data: {"choices":[{"delta":{"content":"Hel"}}]}\n: note\n\ndata:{"choices":[{"delta":{"content":"lo #"}}]}\ndata: {bad\ndata: [DONE]',
    'data: {"choices":[{"delta":{"reasoning_content":"so \\"hint\\": 1"}}]}\r\ndata: {"choices":[{"delta":{"reasoning":"!"}}]}',
    'data: {"choices":[{"delta":{"reasoning":"no use"}}]}\nevent: data: {"choices":[{"delta":{"content":"x"}}]}',
    'data: {"choices":[{"message":{"content":[{"text":"a"},"b",3,{"text":4},{"text":"#"}]}}]}\ndata: {"choices":[]}\ndata: {"choices":7}\ndata: 5',
    'data: {"choices":[{"delta":{"content":"a"}}]}\ndata: {"error":{"message":" over # "}}\ndata: {"error":"second"}',
    '{"choices":[{"message":{"content":"whole #","reasoning":"r"}}]}',
    '{"choices":[{"message":{"content":null},"delta":{"content":"from delta"}}]}',
    '{"choices":[{"message":{"content":" ","reasoning_content":"\\"explanation\\" : #"}}]}',
    '{"error":"plain #"}',
    '{"error":null,"choices":[{"message":{"content":"fine"}}]}',
    '{"error":{"message":"' + "long " * 90 + '"}}',
    '{"choices":',
    "no stream at all",
    "  ",
    None,
]
_M = lambda p, m: f"$.choices[0].{m}.{p}"


def _said(j: str, p: str) -> str:
    parts = f"array_to_string([coalesce({_t('q')}, {_t('q', '$.text')}, '') FOR q IN {_a(j, p)}], '')"
    return f"CASE WHEN json_type({j}, '{p}') = 'VARCHAR' THEN json_extract_string({j}, '{p}') WHEN json_type({j}, '{p}') = 'ARRAY' THEN {parts} ELSE '' END"


def _firstly(j: str, *paths: str) -> str:
    return "CASE " + " ".join(f"WHEN coalesce(json_type({j}, '{p}'), 'NULL') <> 'NULL' THEN {_said(j, p)}" for p in paths) + " ELSE '' END"


def _failed(j: str) -> str:
    message = f"coalesce(trim({_t(j, '$.error')}), trim({_t(j, '$.error.message')}), trim({_t(j, '$.message')}), CAST({j} AS VARCHAR))"
    return f"CASE WHEN coalesce(json_type({j}, '$.error'), 'NULL') <> 'NULL' THEN CASE WHEN {message} <> '' AND length({message}) <= 400 THEN {message} ELSE 'The AI provider failed (200). Try again.' END END"


@query(
    "src_sse",
    f"""WITH r AS (SELECT doc_id, coalesce({_raw_sql(CHATS, 'doc_id')}, '') AS raw FROM documents), b AS (SELECT doc_id, trim(raw, ' ' || chr(10) || chr(13)) AS raw FROM r),
w AS (SELECT doc_id, CAST(CASE WHEN json_valid(raw) THEN raw END AS JSON) AS j FROM b WHERE raw LIKE '{{%'),
w2 AS (SELECT doc_id, {_firstly('j', _M('content', 'message'), _M('content', 'delta'))} AS content,
  {_firstly('j', *[_M(p, m) for m in ('message', 'delta') for p in ('reasoning_content', 'reasoning')])} AS reasoning,
  CASE WHEN j IS NULL THEN 'The reply is no JSON.' ELSE {_failed('j')} END AS error FROM w),
l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, trim(unnest(x), ' ' || chr(13)) AS line FROM (SELECT doc_id, string_split(raw, chr(10)) AS x FROM b WHERE raw NOT LIKE '{{%')),
p AS (SELECT doc_id, i, CAST(CASE WHEN line LIKE 'data:%' AND json_valid(trim(line[6:])) THEN trim(line[6:]) END AS JSON) AS j FROM l),
p2 AS (SELECT doc_id, i, {_said('j', _M('content', 'delta'))} || {_said('j', _M('content', 'message'))} AS content,
  {_firstly('j', _M('reasoning_content', 'delta'), _M('reasoning', 'delta'))} || {_firstly('j', _M('reasoning_content', 'message'), _M('reasoning', 'message'))} AS reasoning, {_failed('j')} AS error FROM p WHERE json_type(j) = 'OBJECT'),
p3 AS (SELECT l.doc_id, coalesce(string_agg(content, '' ORDER BY l.i), '') AS content, coalesce(string_agg(reasoning, '' ORDER BY l.i), '') AS reasoning, arg_min(error, l.i) FILTER (error IS NOT NULL) AS error
  FROM l LEFT JOIN p2 ON p2.doc_id = l.doc_id AND p2.i = l.i GROUP BY l.doc_id),
u AS (SELECT * FROM w2 UNION ALL SELECT * FROM p3)
SELECT doc_id, CASE WHEN error IS NULL THEN CASE WHEN trim(content) <> '' THEN content WHEN regexp_matches(reasoning, '"hint"\\s*:|"explanation"\\s*:') THEN reasoning ELSE '' END END AS text, error FROM u""",
)
def src_sse(s, d):
    return table(s, d, "documents").select("doc_id", loose.chat_answer(_raw(CHATS, c("doc_id"))).alias("a")).select("doc_id", "a.text", "a.error")


# Drafts: each column is left, changed by one side, by both or alike; rows without draft, base or saved state.
@query(
    "prj_overlay_dirty",
    """WITH b AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation FROM customer),
l AS (SELECT k, CASE WHEN k % 14 = 0 THEN NULL WHEN k % 2 = 0 THEN 'local' ELSE segment END AS segment, CASE WHEN k % 3 = 0 THEN balance + 1 ELSE balance END AS balance,
  CASE WHEN k % 5 = 0 THEN nation + 1 ELSE nation END AS nation FROM b WHERE k % 13 <> 0),
s AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'local' WHEN k % 3 = 0 THEN 'saved' WHEN k % 7 = 0 THEN NULL ELSE segment END AS segment, CASE WHEN k % 4 < 2 THEN balance - 1 ELSE balance END AS balance,
  CASE WHEN k % 6 = 0 THEN nation + 1 WHEN k % 10 = 5 THEN nation + 2 ELSE nation END AS nation FROM b WHERE k % 11 <> 0),
o AS (SELECT * FROM b WHERE k % 17 <> 0),
j AS (SELECT s.*, l.k IS NOT NULL AS drafted, o.k IS NULL AS fresh, l.segment AS l1, l.balance AS l2, l.nation AS l3, o.segment AS o1, o.balance AS o2, o.nation AS o3 FROM s LEFT JOIN l ON l.k = s.k LEFT JOIN o ON o.k = s.k),
d AS (SELECT *, drafted AND (fresh OR l1 IS DISTINCT FROM o1) AS d1, drafted AND (fresh OR l2 IS DISTINCT FROM o2) AS d2, drafted AND (fresh OR l3 IS DISTINCT FROM o3) AS d3 FROM j)
SELECT k, CASE WHEN d1 THEN l1 ELSE segment END AS segment, CASE WHEN d2 THEN l2 ELSE balance END AS balance, CASE WHEN d3 THEN l3 ELSE nation END AS nation,
  concat_ws(',', CASE WHEN d1 THEN 'segment' END, CASE WHEN d2 THEN 'balance' END, CASE WHEN d3 THEN 'nation' END) AS dirty,
  concat_ws(',', CASE WHEN d1 AND NOT fresh AND segment IS DISTINCT FROM o1 AND segment IS DISTINCT FROM l1 THEN 'segment' END,
    CASE WHEN d2 AND NOT fresh AND balance IS DISTINCT FROM o2 AND balance IS DISTINCT FROM l2 THEN 'balance' END,
    CASE WHEN d3 AND NOT fresh AND nation IS DISTINCT FROM o3 AND nation IS DISTINCT FROM l3 THEN 'nation' END) AS clashes, d3 AS flush FROM d""",
)
def prj_overlay_dirty(s, d):
    k = c("k")
    base = table(s, d, "customer").select(c("c_custkey").alias("k"), c("c_mktsegment").alias("segment"), c("c_acctbal").alias("balance"), c("c_nationkey").alias("nation"))
    local = base.where("k % 13 != 0").withColumns(
        {
            "segment": F.when(k % 14 == 0, None).when(k % 2 == 0, "local").otherwise(c("segment")),
            "balance": F.when(k % 3 == 0, c("balance") + 1).otherwise(c("balance")),
            "nation": F.when(k % 5 == 0, c("nation") + 1).otherwise(c("nation")),
        }
    )
    saved = base.where("k % 11 != 0").withColumns(
        {
            "segment": F.when(k % 4 == 0, "local").when(k % 3 == 0, "saved").when(k % 7 == 0, None).otherwise(c("segment")),
            "balance": F.when(k % 4 < 2, c("balance") - 1).otherwise(c("balance")),
            "nation": F.when(k % 6 == 0, c("nation") + 1).when(k % 10 == 5, c("nation") + 2).otherwise(c("nation")),
        }
    )
    merged = drafts.overlay(base.where("k % 17 != 0"), local, saved, "k", ["segment", "balance", "nation"], at_once=["nation"])
    return merged.withColumns({"dirty": F.array_join("dirty", ","), "clashes": F.array_join("clashes", ",")})


# Users are the skills, in an order of their own; a skill's cases are its events by value.
@query(
    "win_case_cap",
    """WITH s AS (SELECT user_id, row_number() OVER (ORDER BY sha1(CAST(user_id AS VARCHAR))) AS place FROM (SELECT DISTINCT user_id FROM events)),
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS i FROM events)
SELECT skill, case_id, CAST(i AS INT) AS index, p AS place FROM (SELECT e.user_id AS skill, event_id AS case_id, i, row_number() OVER (ORDER BY s.place, i) AS p FROM e JOIN s ON s.user_id = e.user_id WHERE i <= 3) WHERE p <= 40""",
)
def win_case_cap(s, d):
    e = table(s, d, "events").select(c("user_id").alias("skill"), (-c("value")).alias("rank"), c("event_id").alias("case_id"))
    order = F.sha1(c("skill").cast("string").cast("binary"))
    skills = windows.running_place(e.select("skill").distinct(), [order])
    return windows.cases_of_run(e, skills, 3, 40)


# Customers are jobs of up to four questions; replies come for most attempts, in any order and some twice.
_VERDICTS = ["passed", "failed", "needs_review", "failed", "error", "passed"]
_JOBS_SQL = f"""j AS (SELECT c_custkey AS k, CAST(c_custkey % 5 AS INT) AS total FROM customer),
i AS (SELECT k, total, CAST(n AS INT) AS seq FROM j, range(4) r(n) WHERE n < total),
r AS (SELECT *, CASE WHEN (k + seq) % 7 > 0 THEN [{", ".join(map(lit, _VERDICTS))}][(k + seq * 3) % 6 + 1] END AS r0, CASE WHEN (k + seq + 1) % 7 > 0 THEN [{", ".join(map(lit, _VERDICTS))}][(k + seq * 3 + 2) % 6 + 1] END AS r1 FROM i),
o AS (SELECT *, CASE WHEN r0 IS NULL THEN 'pending' WHEN r0 = 'passed' THEN 'completed' WHEN r0 = 'needs_review' THEN r0 WHEN r1 IS NULL THEN CASE r0 WHEN 'error' THEN 'pending' ELSE 'retryable' END
    WHEN r1 = 'error' THEN 'failed' WHEN r1 = 'passed' THEN 'completed' ELSE 'needs_review' END AS st,
  CASE WHEN r0 IS NULL THEN 0 WHEN r0 IN ('passed', 'needs_review') OR r1 IS NULL THEN 1 ELSE 2 END AS tries FROM r),
f AS (SELECT k, total, min(seq) FILTER (st NOT IN ('completed', 'needs_review')) AS stop FROM o GROUP BY k, total)"""


def _jobs(s, d):
    k = c("c_custkey")
    base = table(s, d, "customer").select(
        k.cast("string").alias("job_id"), F.when(k % 2 == 0, "from_source").otherwise("from_instructions").alias("mode"), (k % 5).cast("int").alias("planned_count"),
        F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k % 5), lambda i: F.concat(F.lit("s"), i.cast("string"))).alias("source_question_ids"), F.array().cast(f"array<{jobs.ITEM}>").alias("items"),
    )
    tries = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((i % 4).alias("sequence"), F.floor(i / 4).cast("int").alias("attempt")))
    each = table(s, d, "customer").select(k, F.explode(F.concat(tries, F.slice(tries, 3, 2))).alias("t")).select("c_custkey", "t.*")
    verdict = F.element_at(F.array(*map(F.lit, _VERDICTS)), ((k + c("sequence") * 3 + c("attempt") * 2) % 6 + 1).cast("int"))
    given = each.where((k + c("sequence") + c("attempt")) % 7 > 0).select(
        k.cast("string").alias("job_id"), "sequence", "attempt", verdict.alias("verdict"), F.concat_ws("-", F.lit("q"), "sequence", "attempt").alias("question_id"),
        F.when(verdict == "error", "no reply").alias("error"),
    )
    return jobs.run_items(jobs.ensure_items(base), given)


@query(
    "st_run_item",
    f"""WITH {_JOBS_SQL}, x AS (SELECT o.*, o.seq <= coalesce(f.stop, o.total) AS ran FROM o JOIN f ON f.k = o.k)
SELECT CAST(k AS VARCHAR) AS job_id, seq AS sequence, CASE WHEN ran THEN st ELSE 'pending' END AS status, CASE WHEN ran THEN CAST(tries AS INT) ELSE 0 END AS attempt_count,
  CASE WHEN ran THEN CASE WHEN st = 'completed' THEN 'passed' WHEN st = 'needs_review' THEN st WHEN r0 = 'failed' THEN r0 END END AS validation_status,
  CASE WHEN ran AND st IN ('completed', 'needs_review') THEN 'q-' || seq || '-' || (tries - 1) END AS question_id,
  CASE WHEN ran AND (st = 'failed' OR st = 'pending' AND r0 = 'error') THEN 'no reply' END AS last_error,
  CASE WHEN ran AND st IN ('completed', 'needs_review') THEN 'analysis+generation+validation+asset+review' ELSE '' END AS stages FROM x""",
)
def st_run_item(s, d):
    x = _jobs(s, d).select("job_id", F.explode("items").alias("x"))
    return x.select("job_id", "x.sequence", "x.status", "x.attempt_count", "x.validation_status", c("x.candidate_question_id").alias("question_id"), "x.last_error", F.array_join("x.completed_stages", "+").alias("stages"))


@query(
    "st_advance",
    f"""WITH {_JOBS_SQL}, g AS (SELECT j.k, j.total, coalesce(f.stop, j.total) AS cursor FROM j LEFT JOIN f ON f.k = j.k),
p AS (SELECT k, string_agg(CASE WHEN k % 2 = 0 THEN 's' || seq ELSE '-' END || '>q-' || seq || '-' || (tries - 1), '|' ORDER BY seq) AS pairs FROM o JOIN g USING (k) WHERE seq < cursor GROUP BY k)
SELECT CAST(g.k AS VARCHAR) AS job_id, CAST(cursor AS INT) AS cursor, CASE WHEN cursor >= g.total THEN 'completed' WHEN o.st = 'failed' THEN 'failed' ELSE 'in_progress' END AS status, coalesce(pairs, '') AS pairs,
  CASE WHEN o.st = 'failed' OR o.st = 'pending' AND o.r0 = 'error' THEN 'no reply' END AS last_error FROM g LEFT JOIN p ON p.k = g.k LEFT JOIN o ON o.k = g.k AND o.seq = g.cursor""",
)
def st_advance(s, d):
    pairs = F.transform("pairs", lambda p: F.concat(F.coalesce(p["source_question_id"], F.lit("-")), F.lit(">"), p["question_id"]))
    return _jobs(s, d).select("job_id", "cursor", "status", F.array_join(pairs, "|").alias("pairs"), "last_error")
