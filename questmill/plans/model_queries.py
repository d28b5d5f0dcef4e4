"""Queries for the question model, structure and review, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from questmill.functions import rules, text
from questmill.operators import questions as model, reading
from questmill.operators import structure
from questmill.plans.library_queries import BOXES, _boxes
from questmill.plans.text_queries import SKILL, _skill_sql, norm
from questmill.sources.driver_tables import PAGE_LINES_SQL, QUESTIONS_SQL, page_lines, questions, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.replace("{q}", QUESTIONS_SQL).replace("{lines}", PAGE_LINES_SQL)
        return f

    return add


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Loose question JSON of every document: odd types, marks and states, and now and then no JSON at all."""
    q = questions(s, d)
    options = F.transform("options", lambda o, i: F.struct(F.when(i > 0, F.lit(None)).otherwise(F.lit("K")).cast("string").alias("key"), o.alias("text"), (i == 1).alias("is_correct")))
    json = F.to_json(
        F.struct(
            "number", F.when(c("doc_id") % 7 == 0, "odd").otherwise(c("kind")).alias("type"), F.concat(F.lit("  "), c("stem")).alias("stem"),
            F.when(c("doc_id") % 5 == 0, "many").otherwise((c("doc_id") % 4).cast("string")).alias("marks"),
            F.when(c("doc_id") % 3 == 0, "hard").otherwise("tough").alias("difficulty"), F.when(c("doc_id") % 2 == 0, "reviewed").alias("approval_status"),
            options.alias("options"),
        )
    )
    return q.select("doc_id", F.when(c("doc_id") % 13 == 0, "{broken").otherwise(json).alias("json"))


@query(
    "prj_normalize",
    "WITH {q} SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN nullif(trim(number), '') END AS number, CASE WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 THEN 'unknown' ELSE kind END AS type, CASE WHEN doc_id % 13 = 0 THEN '' ELSE trim(stem) END AS stem, CASE WHEN doc_id % 13 > 0 AND doc_id % 5 > 0 THEN CAST(doc_id % 4 AS DOUBLE) END AS marks, CASE WHEN doc_id % 13 > 0 AND doc_id % 3 = 0 THEN 'hard' END AS difficulty, doc_id % 13 > 0 AND doc_id % 2 = 0 AS approved, CASE WHEN doc_id % 13 = 0 OR len(options) = 0 THEN '' ELSE 'K' || array_to_string(['', 'B', 'C', 'D'][2:len(options)], '') END AS keys FROM q".replace("['', 'B', 'C', 'D'][2:len(options)]", "(['', 'B', 'C', 'D'])[2:len(options)]"),
)
def prj_normalize(s, d):
    fields = model.normalized(c("json"))
    keys = F.array_join(F.transform(fields.pop("options"), lambda o: o["key"]), "").alias("keys")
    return _raw(s, d).select("doc_id", *[v.alias(k) for k, v in fields.items()], keys)


ANSWERS = "a AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'B' ELSE ' ' END AS key1, CASE WHEN doc_id % 3 = 0 THEN 'text' END AS answer_text, CASE WHEN doc_id % 2 = 0 THEN TRUE END AS answer_boolean FROM q)"
HAS_SQL = "CASE WHEN kind = 'true_false' THEN answer_boolean IS NOT NULL WHEN kind = 'fill_blank' THEN trim(key1) <> '' WHEN kind IN ('short_answer', 'long_answer', 'numerical') THEN answer_text IS NOT NULL WHEN kind IN ('mcq', 'multi_select', 'assertion_reason') THEN trim(key1) <> '' ELSE trim(key1) <> '' OR answer_text IS NOT NULL OR answer_boolean IS NOT NULL END"


def _answers(s, d):
    key = F.when(c("doc_id") % 4 == 0, "B").otherwise(" ")
    return questions(s, d).withColumns({"keys": F.array(key), "answer_text": F.when(c("doc_id") % 3 == 0, "text"), "answer_boolean": F.when(c("doc_id") % 2 == 0, True)})


def _has():
    return model.has_answer(c("kind"), c("keys"), F.lit(0), c("answer_text"), c("answer_boolean"), c("keys"))


@query("prj_has_answer", f"WITH {{q}}, {ANSWERS} SELECT doc_id, {HAS_SQL} AS v FROM a")
def prj_has_answer(s, d):
    return _answers(s, d).select("doc_id", _has().alias("v"))


@query("prj_missing_answers", f"WITH {{q}}, {ANSWERS} SELECT doc_id FROM a WHERE NOT ({HAS_SQL})")
def prj_missing_answers(s, d):
    return _answers(s, d).where(~_has()).select("doc_id")


@query("prj_solution_incomplete", f"WITH {{q}}, {ANSWERS} SELECT doc_id, answer_text IS NULL OR NOT ({HAS_SQL}) AS v FROM a")
def prj_solution_incomplete(s, d):
    return _answers(s, d).select("doc_id", (c("answer_text").isNull() | ~_has()).alias("v"))


@query("prj_targets", "SELECT conv_id, turn AS target, CASE WHEN n > 2 THEN first_text END AS passage FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, first(text) OVER (PARTITION BY conv_id ORDER BY turn) AS first_text FROM conversations) WHERE n <= 2 AND turn = 0 OR n > 2")
def prj_targets(s, d):
    t = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    many = F.size("t") > 2
    subs = t.select("conv_id", F.when(many, F.get("t", 0)["text"]).alias("passage"), F.explode(F.when(many, c("t")).otherwise(F.filter("t", lambda x: x["turn"] == 0))).alias("x"))
    return subs.select("conv_id", c("x.turn").alias("target"), "passage")


@query("prj_solution_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'hint ' || o_orderkey END AS hint, 'new ' || o_orderstatus AS explanation FROM orders")
def prj_solution_merge(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 3 == 0, c("o_orderpriority")).otherwise(" ").alias("hint"), c("o_orderstatus").alias("explanation"))
    new = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("hint "), c("o_orderkey").cast("string")).alias("h"), F.concat(F.lit("new "), c("o_orderstatus")).alias("e"))
    return o.join(new, "o_orderkey").select("o_orderkey", model.filled(c("hint"), c("h"), False).alias("hint"), model.filled(c("explanation"), c("e"), True).alias("explanation"))


@query("prj_fold_solutions", "SELECT o_custkey, count(*) AS n, bool_and(o_orderkey % 3 = 0 OR o_orderstatus <> 'P') AS approved FROM orders GROUP BY o_custkey")
def prj_fold_solutions(s, d):
    new = table(s, d, "orders").where("o_orderstatus != 'P'").select("o_orderkey", F.lit("x").alias("e"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.when(c("o_orderkey") % 3 == 0, "old").alias("explanation")).join(new, "o_orderkey", "left")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("explanation", "e").isNotNull()).alias("approved"))


@query("prj_with_type", "WITH {q} SELECT doc_id, CASE WHEN kind = 'mcq' AND len(options) = 0 THEN 4 ELSE len(options) END AS n FROM q")
def prj_with_type(s, d):
    four = F.array(*[F.lit("")] * 4)
    return questions(s, d).select("doc_id", F.size(F.when((c("kind") == "mcq") & (F.size("options") == 0), four).otherwise(c("options"))).cast("long").alias("n"))


@query("prj_generated_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'reviewed' ELSE 'generated' END AS approval_status, o_orderstatus = 'F' AS approved FROM orders")
def prj_generated_status(s, d):
    status = F.when(c("o_orderstatus") == "F", "reviewed").otherwise("generated")
    return table(s, d, "orders").select("o_orderkey", status.alias("approval_status"), status.isin("reviewed", "published").alias("approved"))


@query("prj_source_block", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'broken_math' ELSE '' END AS flags, CAST(least(3, greatest(1, o_custkey % 6)) AS INT) AS passes FROM orders")
def prj_source_block(s, d):
    flags = F.filter(F.array(F.when(c("o_orderkey") % 2 == 0, "broken_math").otherwise("nonsense")), lambda f: f.isin("options_in_stem", "missing_options", "broken_math", "suspicious_currency", "partial_stem", "number_gap"))
    return table(s, d, "orders").select("o_orderkey", F.array_join(flags, ",").alias("flags"), F.least(F.lit(3), F.greatest(F.lit(1), (c("o_custkey") % 6).cast("int"))).alias("passes"))


@query("prj_source_record", "WITH {q} SELECT doc_id, stem, len(options) AS n_options FROM q WHERE length(stem) > 0")
def prj_source_record(s, d):
    return questions(s, d).where(F.length("stem") > 0).select("doc_id", "stem", F.size("options").cast("long").alias("n_options"))


@query("prj_strip_prompt", "WITH {q} SELECT doc_id, '{\"stem\":' || to_json(stem) || ',\"options\":' || to_json(options) || '}' AS prompt FROM q")
def prj_strip_prompt(s, d):
    return questions(s, d).select("doc_id", F.to_json(F.struct("stem", "options")).alias("prompt"))


@query("prj_strip_figures", "WITH {q} SELECT doc_id, stem, 0 AS figures FROM q")
def prj_strip_figures(s, d):
    return questions(s, d).select("doc_id", "stem", "figures").withColumn("figures", F.lit(0))


@query("prj_create", "SELECT p_partkey, 'short_answer' AS type, '' AS stem, FALSE AS approved FROM part")
def prj_create(s, d):
    return table(s, d, "part").select("p_partkey", F.lit("short_answer").alias("type"), F.lit("").alias("stem"), F.lit(False).alias("approved"))


@query("prj_question_write", "SELECT o_orderkey, o_orderstatus, '2024-01-01' AS updated_at FROM orders")
def prj_question_write(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").drop("o_orderdate").withColumn("updated_at", F.lit("2024-01-01"))


@query("prj_paste_figure", "WITH {q} SELECT doc_id, len(options) + 1 AS n FROM q")
def prj_paste_figure(s, d):
    return questions(s, d).select("doc_id", F.size(F.array_append("options", F.lit("fig"))).cast("long").alias("n"))


@query("prj_line_boxes", "WITH {lines} SELECT doc_id, ord, line FROM lines WHERE trim(line) <> ''")
def prj_line_boxes(s, d):
    return page_lines(s, d).select("doc_id", c("ord").cast("long").alias("ord"), "line").where(F.trim("line") != "")


@query("prj_repair_merge", "SELECT o_orderkey, CAST(least(3, 1 + o_custkey % 4) AS INT) AS passes FROM orders")
def prj_repair_merge(s, d):
    return table(s, d, "orders").select("o_orderkey", F.least(F.lit(3), (c("o_custkey") % 4 + 1).cast("int")).alias("passes"))


@query("jn_copied_options", f"WITH {{q}} SELECT doc_id, len(list_filter(options, lambda o: {norm('o')} <> '' AND list_contains(list_transform(['18', 'true', 'poet', 'A'], lambda r: {norm('r')}), {norm('o')}))) AS n FROM q")
def jn_copied_options(s, d):
    refs = F.array(*[F.lit(x) for x in ("18", "true", "poet", "A")])
    return questions(s, d).select("doc_id", F.size(F.filter("options", lambda o: F.exists(refs, lambda r: text.is_copied(o, r)))).cast("long").alias("n"))


@query("fn_clean_stem", "WITH {q} SELECT doc_id, trim(regexp_replace(regexp_replace(stem, '(?i)\\b(?:question figures?|answer figures?|fig\\.? ?\\d*)', ' ', 'g'), '\\s+', ' ', 'g')) AS v FROM q")
def fn_clean_stem(s, d):
    clean = F.trim(F.regexp_replace(F.regexp_replace("stem", r"(?i)\b(?:question figures?|answer figures?|fig\.? ?\d*)", " "), r"\s+", " "))
    return questions(s, d).select("doc_id", clean.alias("v"))


@query("fn_block_text", "WITH b AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'formula' WHEN 1 THEN 'text' ELSE 'title' END AS kind, CASE WHEN p_partkey % 5 > 0 THEN ' ' || p_name || ' ' END AS t, CASE p_partkey % 4 WHEN 0 THEN ' x^2 ' WHEN 1 THEN '$y$' WHEN 2 THEN '  ' END AS l FROM part), c AS (SELECT p_partkey, kind, nullif(trim(coalesce(t, '')), '') AS t, nullif(trim(coalesce(l, '')), '') AS l FROM b) SELECT p_partkey, CASE WHEN kind = 'formula' THEN CASE WHEN starts_with(coalesce(l, t), '$') THEN coalesce(l, t) ELSE '$' || coalesce(l, t) || '$' END ELSE coalesce(t, l) END AS v FROM c")
def fn_block_text(s, d):
    k = c("p_partkey")
    kind = F.when(c("p_size") % 3 == 0, "formula").when(c("p_size") % 3 == 1, "text").otherwise("title")
    latex = F.when(k % 4 == 0, " x^2 ").when(k % 4 == 1, "$y$").when(k % 4 == 2, "  ")
    return table(s, d, "part").select("p_partkey", reading.block_text(kind, F.when(k % 5 > 0, F.concat(F.lit(" "), c("p_name"), F.lit(" "))), latex).alias("v"))


HEADS_SQL = "len(list_filter(string_split({0}, chr(10)), lambda l: regexp_matches(l, '^\\s*\\(?\\d{{1,3}}\\s*[.)]')))"
_TAKE = "CASE WHEN {1} <> '' AND length({1}) >= 0.6 * length({0}) AND " + HEADS_SQL.format("{1}").replace("{1,3}", "{{1,3}}") + " >= " + HEADS_SQL.format("{0}").replace("{1,3}", "{{1,3}}") + " THEN {1} ELSE {0} END"


@query("fn_choose_transcript", "WITH b AS (SELECT doc_id, coalesce(text, '') AS p, CASE doc_id % 4 WHEN 0 THEN '1. ' || text WHEN 1 THEN substr(text, 1, 30) WHEN 2 THEN NULL ELSE text || chr(10) || '2) more' END AS o, CASE doc_id % 3 WHEN 0 THEN text || ' +' WHEN 1 THEN '3. ' || text || chr(10) || '4. ' ELSE '' END AS r FROM documents), x AS (SELECT doc_id, " + _TAKE.format("p", "o") + " AS p, r FROM b) SELECT doc_id, md5(" + _TAKE.format("p", "r") + ") AS h FROM x")
def fn_choose_transcript(s, d):
    k, t = c("doc_id"), c("text")
    ordered = F.when(k % 4 == 0, F.concat(F.lit("1. "), t)).when(k % 4 == 1, F.substring(t, 1, 30)).when(k % 4 == 3, F.concat(t, F.lit("\n2) more")))
    recovered = F.when(k % 3 == 0, F.concat(t, F.lit(" +"))).when(k % 3 == 1, F.concat(F.lit("3. "), t, F.lit("\n4. "))).otherwise("")
    return table(s, d, "documents").select("doc_id", F.md5(text.choose_transcript(F.coalesce(t, F.lit("")), ordered, recovered)).alias("h"))


@query(
    "fn_accept_repair",
    "WITH w AS (SELECT a.conv_id, regexp_extract_all(lower(a.text), '[a-z]{3,}') AS x, regexp_extract_all(lower(coalesce(b.text, '')), '[a-z]{3,}') AS y FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 2 WHERE a.turn = 0), x AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(x) AS w FROM w) GROUP BY ALL), y AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(y) AS w FROM w) GROUP BY ALL), r AS (SELECT x.conv_id, sum(least(x.n, coalesce(y.n, 0))) AS kept, sum(x.n) AS need FROM x LEFT JOIN y ON x.conv_id = y.conv_id AND x.w = y.w GROUP BY 1) SELECT w.conv_id, coalesce(kept / need >= 0.8, TRUE) AS v FROM (SELECT DISTINCT conv_id FROM w) w LEFT JOIN r USING (conv_id)",
)
def fn_accept_repair(s, d):
    """Multiset recall of the first turn's words in the third's."""
    t = table(s, d, "conversations")
    words = lambda turn: t.where(f"turn = {turn}").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("w")).groupBy("conv_id", "w").agg(F.count("*").alias(f"n{turn}"))
    kept = words(0).join(words(2), ["conv_id", "w"], "left").groupBy("conv_id").agg((F.sum(F.least("n0", F.coalesce("n2", F.lit(0)))) / F.sum("n0") >= 0.8).alias("ok"))
    return t.where("turn = 0").select("conv_id").distinct().join(kept, "conv_id", "left").select("conv_id", F.coalesce("ok", F.lit(True)).alias("v"))


@query("fn_elide", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"u\":\"[image elided]\",\"k\":1}' WHEN 1 THEN '[{\"image_url\":{\"url\":\"[image elided]\"}},\"[image elided]\"]' WHEN 2 THEN '{\"data:x\":\"say \\\"data:y\\\"\"}' ELSE props END AS v FROM events")
def fn_elide(s, d):
    k = c("event_id") % 4
    raw = F.when(k == 0, '{"u":"data:image/png;base64,AA\\"A","k":1}').when(k == 1, '[{"image_url":{"url":"http://x/y.png","detail":"low"}},"data:,"]').when(k == 2, '{"data:x":"say \\"data:y\\""}').otherwise(c("props"))
    return table(s, d, "events").select("event_id", text.elided(raw).alias("v"))


@query("fn_data_url", "SELECT p_partkey, 'image/png' AS kind, p_name AS content FROM part")
def fn_data_url(s, d):
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("p_name", "UTF-8")))
    return table(s, d, "part").select("p_partkey", F.regexp_extract(url, r"^data:([^;]+);base64,", 1).alias("kind"), F.decode(F.unbase64(F.regexp_extract(url, r"base64,(.*)$", 1)), "UTF-8").alias("content"))


@query("cls_index_row", f"WITH {{q}} SELECT doc_id, nullif({_skill_sql()}, 'unsupported') AS skill_type FROM q")
def cls_index_row(s, d):
    return questions(s, d).select("doc_id", F.nullif(SKILL(), F.lit("unsupported")).alias("skill_type"))


@query("cls_focus", "WITH {q} SELECT doc_id, CASE WHEN regexp_matches(stem, '(?i)tense') THEN 'tense' WHEN regexp_matches(stem, '(?i)noun') THEN 'parts_of_speech' WHEN regexp_matches(stem, '(?i)opposite|antonym') THEN 'antonym' ELSE 'general' END AS v FROM q")
def cls_focus(s, d):
    has = lambda p: c("stem").rlike(f"(?i){p}")
    return questions(s, d).select("doc_id", rules.first_hit([("tense", has("tense")), ("parts_of_speech", has("noun")), ("antonym", has("opposite|antonym"))], "general").alias("v"))


@query("cls_auto_generatable", "SELECT p_partkey, p_size > 10 AND p_size % 2 = 0 AND p_retailprice > 950 AS v FROM part")
def cls_auto_generatable(s, d):
    return table(s, d, "part").select("p_partkey", ((c("p_size") > 10) & (c("p_size") % 2 == 0) & (c("p_retailprice") > 950)).alias("v"))


@query("cls_author_plan", "SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'vision' WHEN p_type = 'ECONOMY' THEN 'language' ELSE 'none' END AS v FROM part")
def cls_author_plan(s, d):
    return table(s, d, "part").select("p_partkey", F.when(c("p_type").isin("SMALL", "LARGE"), "vision").when(c("p_type") == "ECONOMY", "language").otherwise("none").alias("v"))


@query("cls_source_agent", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'paper_reader' WHEN 'O' THEN 'test_reader' ELSE 'mock_writer' END AS v FROM orders")
def cls_source_agent(s, d):
    return table(s, d, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "F", "paper_reader").when(c("o_orderstatus") == "O", "test_reader").otherwise("mock_writer").alias("v"))


@query("cls_layout_region", f"WITH {BOXES} SELECT page, id, CASE WHEN kind <= 2 THEN 'figure' ELSE 'table' END AS type, floor(least(1, x) * 10000 + 0.5) / 10000 AS x FROM b WHERE kind <= 4")
def cls_layout_region(s, d):
    label = F.when(c("kind") <= 2, "figure").when(c("kind") <= 4, "table")
    return _boxes(s, d).withColumn("type", label).where("type is not null").select("page", "id", "type", (F.floor(F.least(F.lit(1.0), c("x")) * 10000 + 0.5) / 10000).alias("x"))


@query("cls_layout_parse", f"WITH {BOXES} SELECT page, id, (['text', 'title', 'figure', 'table'])[kind % 4 + 1] AS label FROM b WHERE y >= 0.5")
def cls_layout_parse(s, d):
    names = F.array(*[F.lit(x) for x in ("text", "title", "figure", "table")])
    return _boxes(s, d).where("y >= 0.5").select("page", "id", F.element_at(names, c("kind") % 4 + 1).alias("label"))


PAGE_TEXT = "p AS (SELECT doc_id, ord, CASE WHEN ord % 4 = 0 THEN (ord // 4 + 1) || '. ' || line ELSE line END AS line FROM lines), g AS (SELECT *, nullif(regexp_extract(line, '^\\s*\\(?(\\d{1,3})\\s*[.)]\\s+', 1), '') AS head FROM p), h AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM g)"


@query("gen_structure", f"WITH {{lines}}, {PAGE_TEXT} SELECT doc_id, max(head) AS number, md5(trim(regexp_replace(string_agg(CASE WHEN head IS NOT NULL THEN regexp_replace(line, '^\\s*\\(?\\d{{1,3}}\\s*[.)]\\s+', '') ELSE line END, ' ' ORDER BY ord), '\\s+', ' ', 'g'))) AS h FROM h WHERE grp > 0 GROUP BY doc_id, grp")
def gen_structure(s, d):
    lines = page_lines(s, d).select("doc_id", "ord", F.when(c("ord") % 4 == 0, F.concat((F.floor(c("ord") / 4) + 1).cast("string"), F.lit(". "), c("line"))).otherwise(c("line")).alias("line"))
    return structure.numbered(lines).select("doc_id", "number", F.md5("body").alias("h"))


@query("gen_structure_page")
def gen_structure_page(s, d):
    """Sections, directions and numbers, over every document: its sentences under a section and a number."""
    numbered = F.transform(F.split(F.coalesce("text", F.lit("")), r"\. "), lambda x, k: F.when(k % 3 == 0, F.concat((k / 3 + 1).cast("int").cast("string"), F.lit(". "), x)).otherwise(x))
    page = F.concat(F.lit("Section B\nDIRECTIONS (2-4): Read on\n"), F.array_join(numbered, "\n"))
    return structure.structured(table(s, d, "documents").select("doc_id", page.alias("text")))


@query("gen_unnumbered")
def gen_unnumbered(s, d):
    """Pages without numbers, one a document: of its sentences each fifth is a stem, the others are choices."""
    mark = lambda k: F.concat(F.lit("("), F.element_at(F.array(*map(F.lit, "abcd")), k % 5), F.lit(") "))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\. "), lambda x, k: F.when(k % 5 == 0, F.concat(x, F.lit("?"))).otherwise(F.concat(F.when(k % 5 > 0, mark(F.greatest(k % 5, F.lit(1)))), x, F.lit("."))))
    return structure.structured(table(s, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text")))


def _sentences(s, d, kind):
    """Every document's sentences as blocks of a page."""
    each = spread(s, d, "documents", "doc_id").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ")).alias("ord", "text"))
    return each.select("doc_id", "ord", kind.alias("type"), F.concat(F.when(c("ord") % 4 == 0, F.concat((c("ord") / 4 + 1).cast("int").cast("string"), F.lit(". "))).otherwise(""), "text").alias("text"), F.lit(None).cast("string").alias("latex"))


@query("gen_from_blocks")
def gen_from_blocks(s, d):
    """A page a document: its sentences as blocks of text, formulas and figures, every fourth with a number."""
    return reading.from_blocks(_sentences(s, d, F.element_at(F.array(*map(F.lit, ("text", "text", "formula", "figure"))), c("ord") % 4 + 1)))


@query("gen_crop_text")
def gen_crop_text(s, d):
    return reading.from_crops(questions(s, d).select("doc_id", c("stem").alias("text"), F.nullif(F.regexp_extract("number", r"\d+", 0), F.lit("")).alias("number")))


@query("gen_release_swallowed", "WITH {q} SELECT doc_id, CASE WHEN length(trim(regexp_replace(stem, '\\s{2,}', ' ', 'g'))) >= 8 THEN trim(regexp_replace(stem, '\\s{2,}', ' ', 'g')) ELSE stem || ' How far is the moon from here?' END AS stem FROM q")
def gen_release_swallowed(s, d):
    """Each question has swallowed the next of its page, which was read again."""
    q = questions(s, d)
    swallowed = q.select("doc_id", F.lit(0).alias("ord"), F.concat("stem", F.lit(" How far is the moon from here?")).alias("stem"), F.lit(False).alias("extra"))
    again = q.select("doc_id", F.lit(1).alias("ord"), F.lit("How far is the moon from here?").alias("stem"), F.lit(True).alias("extra"))
    return reading.release_swallowed(swallowed.union(again)).where("not extra").select("doc_id", "stem")


@query("gen_clean_page")
def gen_clean_page(s, d):
    """Pages of sentences with numbers, some of which a model has read as well."""
    pages = _sentences(s, d, F.lit("text")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    modeled = questions(s, d).where("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("ord"), "number", c("stem").alias("body"))
    return reading.clean_pages(pages, modeled, c("doc_id") % 2 == 0)


@query("win_row_cluster")
def win_row_cluster(s, d):
    b = _boxes(s, d).select("page", c("id").alias("ord"), F.lit("x").alias("text"), "x", "y", F.lit(0.1).alias("w"), F.lit(0.02).alias("h"))
    return structure.reading_order(b)


@query("gen_blocks", f"WITH {BOXES}, h AS (SELECT page, id, y, coalesce(lead(y) OVER (PARTITION BY page ORDER BY y, id), 2) AS bottom FROM b WHERE kind <= 2) SELECT h.page, h.id AS head, h.y, count(*) AS lines FROM h JOIN b ON b.page = h.page AND b.y >= h.y AND b.y < h.bottom GROUP BY h.page, h.id, h.y")
def gen_blocks(s, d):
    from questmill.operators.windows import next_top

    b = _boxes(s, d)
    heads = next_top(b.where("kind <= 2").select("page", c("id").alias("head"), "y"), ["page"], "y", "head").select("page", "head", "y", F.coalesce("bottom", F.lit(2.0)).alias("bottom"))
    lines = b.select("page", c("y").alias("ly"))
    return heads.join(lines, "page").where("ly >= y and ly < bottom").groupBy("page", "head", "y").agg(F.count("*").alias("lines"))


@query("gen_match_pairs", "WITH {lines} SELECT doc_id, ord, trim(regexp_split_to_array(line, ' \\| ')[1]) AS l, trim(regexp_split_to_array(line, ' \\| ')[2]) AS r FROM lines WHERE len(regexp_split_to_array(line, ' \\| ')) = 2")
def gen_match_pairs(s, d):
    parts = page_lines(s, d).select("doc_id", c("ord").cast("long").alias("ord"), F.split("line", r" \| ").alias("p")).where(F.size("p") == 2)
    return parts.select("doc_id", "ord", F.trim(F.get("p", 0)).alias("l"), F.trim(F.get("p", 1)).alias("r"))


@query(
    "val_structure",
    f"WITH {{q}}, {ANSWERS}, x AS (SELECT doc_id, kind <> 'unknown' AND trim(stem) <> '' AS schema_valid, {HAS_SQL} AS has_answers, kind <> 'mcq' OR len(options) = 4 AS option_count_ok, ({_skill_sql()}) <> 'unsupported' AS skill_match, {norm('stem')} = {norm(chr(39) + 'Find the average of 12, 18 and 24' + chr(39))} AS copied_reference FROM a) SELECT *, schema_valid AND has_answers AND option_count_ok AND skill_match AND NOT copied_reference AS passed FROM x",
)
def val_structure(s, d):
    none = F.array().cast("array<string>")
    checks = model.structural(c("stem"), c("kind"), c("options"), _has(), SKILL() != "unsupported", F.lit("Find the average of 12, 18 and 24"), none)
    return _answers(s, d).select("doc_id", *[v.alias(k) for k, v in checks.items()])


@query(
    "val_verdict",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN CAST(least(5, o_custkey % 9) AS INT) END AS skill_match, CASE WHEN o_orderkey % 6 > 0 THEN 0 END AS difficulty_match, CASE WHEN o_orderkey % 6 > 0 THEN 3 END AS past_paper_like, CASE WHEN o_orderkey % 6 > 0 THEN o_orderstatus = 'F' END AS equivalent, CASE WHEN o_orderkey % 6 > 0 THEN TRUE END AS answerable, CASE WHEN o_orderkey % 6 > 0 THEN (least(5, o_custkey % 9) + 3) / 15 END AS judge_score FROM orders",
)
def val_verdict(s, d):
    body = F.format_string('```json\n{"skill_match": %d, "difficulty_match": "x", "past_paper_like": 2.5, "equivalent": %s}\n```', (c("o_custkey") % 9).cast("int"), F.when(c("o_orderstatus") == "F", "true").otherwise("false"))
    raw = F.when(c("o_orderkey") % 6 == 0, "no verdict").otherwise(body)
    return table(s, d, "orders").select("o_orderkey", *[v.alias(k) for k, v in model.verdict(raw).items()])


@query("val_comprehension", "SELECT conv_id, count(*) > 1 AND bool_or(turn = 0 AND length(text) > 0) AS ok FROM conversations GROUP BY conv_id")
def val_comprehension(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(((F.count("*") > 1) & F.bool_or((c("turn") == 0) & (F.length("text") > 0))).alias("ok"))


@query("val_finalize_mock", "SELECT conv_id, turn, (conv_id + 1) || CASE WHEN p <= 26 THEN chr(CAST(96 + p AS INT)) ELSE '.' || p END AS label FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)")
def val_finalize_mock(s, d):
    """Parts of a set are numbered 12a, 12b, and from the 27th on 12.27."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(s, d, "conversations").select("conv_id", "turn", place.alias("p"))
    part = F.when(c("p") <= 26, F.char(c("p") + 96)).otherwise(F.concat(F.lit("."), c("p").cast("string")))
    return t.select("conv_id", "turn", F.concat((c("conv_id") + 1).cast("string"), part).alias("label"))


@query("set_replace_batch", "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_orderkey % 20 = 0 AND l_returnflag = 'A') GROUP BY ALL UNION ALL SELECT o_orderkey, 'A', 7 FROM orders WHERE o_orderkey % 20 = 0")
def set_replace_batch(s, d):
    kept = table(s, d, "lineitem").where("not (l_orderkey % 20 = 0 and l_returnflag = 'A')").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return kept.union(table(s, d, "orders").where("o_orderkey % 20 = 0").select("o_orderkey", F.lit("A"), F.lit(7).cast("long")))


@query("set_optimistic_rev", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = o_custkey % 3 THEN o_orderkey % 3 + 1 ELSE o_orderkey % 3 END AS rev FROM orders")
def set_optimistic_rev(s, d):
    rev, seen = c("o_orderkey") % 3, c("o_custkey") % 3
    return table(s, d, "orders").select("o_orderkey", F.when(rev == seen, rev + 1).otherwise(rev).alias("rev"))


@query("src_catalog_import", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 6 > 0")
def src_catalog_import(s, d):
    """A dump whose rows use either of two key names; rows without id or name go."""
    a = F.to_json(F.struct(c("p_partkey").alias("id"), c("p_name").alias("name")))
    b = F.to_json(F.struct(c("p_partkey").alias("topic_id"), c("p_name").alias("title")))
    raw = table(s, d, "part").select(F.when(c("p_partkey") % 6 == 0, "{}").when(c("p_partkey") % 2 == 0, a).otherwise(b).alias("j"))
    j = F.from_json("j", "id long, topic_id long, name string, title string")
    return raw.select(F.coalesce(j["id"], j["topic_id"]).alias("id"), F.coalesce(j["name"], j["title"]).alias("name")).where("id is not null and name is not null")


@query("src_json_fence", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def src_json_fence(s, d):
    fenced = F.concat(F.lit("Sure:\n```json\n"), c("props"), F.lit("\n```"))
    return table(s, d, "events").select("event_id", F.get_json_object(F.regexp_extract(fenced, r"(?s)(\{.*\})", 1), "$.k").cast("int").alias("k"))


@query("src_ocr_overlay", f"WITH {BOXES} SELECT page, id, x, y FROM b WHERE x > 0.1 AND y > 0.01")
def src_ocr_overlay(s, d):
    j = F.from_json(F.to_json(F.struct("x", "y")), "x double, y double")
    return _boxes(s, d).select("page", "id", j["x"].alias("x"), j["y"].alias("y")).where("x > 0.1 and y > 0.01")


@query("src_openocr_payload", f"WITH {BOXES} SELECT page, id, greatest(0.0, least(1.0, y * 2)) AS y FROM b WHERE kind <> 3")
def src_openocr_payload(s, d):
    kinds = F.when(c("kind") == 3, "odd").otherwise("text")
    return _boxes(s, d).withColumn("type", kinds).where(c("type").isin("text", "formula", "figure", "table")).select("page", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("y") * 2)).alias("y"))


@query("src_syllabus", "SELECT r_name AS subject, n_name AS section FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 3")
def src_syllabus(s, d):
    """A nested syllabus, loaded and filtered by standard, then flattened."""
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("sections"))
    nested = table(s, d, "region").join(n, c("n_regionkey") == c("r_regionkey"))
    return nested.where("r_regionkey < 3").select(c("r_name").alias("subject"), F.explode("sections").alias("section"))


@query("src_sqlite_open", "SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'nation', count(*) FROM nation")
def src_sqlite_open(s, d):
    out = None
    for name in ("orders", "part", "nation"):
        n = table(s, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = n if out is None else out.union(n)
    return out
