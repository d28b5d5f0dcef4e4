"""Queries for the text functions and rule cascades, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.functions import ids, rules, text
from questmill.sources.driver_tables import QUESTIONS_SQL, questions, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
TRIM = "regexp_replace({0}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')"
HEADER = text.HEADER
SHAPE = text.HEADER_SHAPE


def norm(x: str) -> str:
    return NORM.format(x)


def trim(x: str) -> str:
    return TRIM.format(x)


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def on_questions(name: str, sql: str, **columns: Callable[[], Column]) -> None:
    """A query that computes columns of every question."""
    QUERIES[name] = lambda s, d: questions(s, d).select("doc_id", *[f().alias(n) for n, f in columns.items()])
    ORACLE_SQL[name] = f"WITH {QUESTIONS_SQL} SELECT doc_id, {sql} FROM q"


def on_documents(name: str, sql: str, **columns: Callable[[], Column]) -> None:
    QUERIES[name] = lambda s, d: table(s, d, "documents").select("doc_id", *[f().alias(n) for n, f in columns.items()])
    ORACLE_SQL[name] = f"SELECT doc_id, {sql} FROM documents"


c = F.col
TOK = "list_distinct(list_filter(string_split({0}, ' '), lambda x: length(x) > 1))"

on_documents("fn_normalize_text", f"md5({norm('text')}) AS h", h=lambda: F.md5(text.normalize_text(c("text"))))
on_documents("fn_token_set", f"len({TOK.format(norm('text'))}) AS n", n=lambda: F.size(text.token_set(c("text"))).cast("long"))


def _with_item(s: SparkSession, d: str) -> DataFrame:
    """Each document with the benchmark item its id points to."""
    items = table(s, d, "benchmark").select("item_id", c("text").alias("item"))
    n = items.agg(F.max("item_id")).first()[0] + 1
    return spread(s, d, "documents", "doc_id").select("doc_id", "text", (c("doc_id") % n).alias("item_id")).join(items, "item_id")


WITH_ITEM = "w AS (SELECT d.doc_id, d.text, b.text AS item FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))"


def on_pairs(name: str, sql: str, column: Callable[[], Column]) -> None:
    QUERIES[name] = lambda s, d: _with_item(s, d).select("doc_id", column().alias("v"))
    ORACLE_SQL[name] = f"WITH {WITH_ITEM}, n AS (SELECT doc_id, {norm('text')} AS a, {norm('item')} AS b FROM w), t AS (SELECT *, {TOK.format('a')} AS x, {TOK.format('b')} AS y FROM n) SELECT doc_id, {sql} AS v FROM t"


JAC = "CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END"
on_pairs("fn_jaccard", JAC, lambda: text.jaccard(text.token_set(c("text")), text.token_set(c("item"))))
on_pairs(
    "fn_is_copied",
    f"a <> '' AND b <> '' AND (a = b OR (length(a) >= 24 AND contains(b, a)) OR (length(b) >= 24 AND contains(a, b)) OR {JAC} >= 0.85)",
    lambda: text.is_copied(c("text"), c("item")),
)
on_pairs(
    "fn_copied_phrase",
    "length(a) >= 40 AND len(list_filter([array_to_string(list_filter(string_split(b, ' '), lambda z: z <> '')[i:i + 7], ' ') FOR i IN generate_series(1, len(list_filter(string_split(b, ' '), lambda z: z <> '')) - 7)], lambda p: length(p) >= 24 AND contains(a, p))) > 0",
    lambda: text.copies_phrase(c("item"), c("text")),
)

on_questions("fn_option_token", "upper(regexp_replace(coalesce(options[1], ''), '[^A-Za-z0-9]', '', 'g')) AS v", v=lambda: text.option_token(F.get("options", 0)))
on_questions("fn_parse_order", "TRY_CAST(nullif(regexp_extract(number, '(\\d+)', 1), '') AS BIGINT) AS v", v=lambda: text.printed_order(c("number")))
on_questions(
    "fn_question_key",
    "CASE WHEN regexp_extract(coalesce(number, ''), '\\d{1,3}') <> '' THEN CAST(CAST(regexp_extract(number, '\\d{1,3}') AS INT) AS VARCHAR) ELSE coalesce(number, '') END AS v",
    v=lambda: text.question_key(c("number")),
)
NAMES = "element_at(array('Class 6', 'grade-11', 'Std. 9', '7th standard', 'Level 4', 'Class 15', 'plain', ''), cast(p_partkey % 8 as int) + 1)"
NAMES_SQL = "['Class 6', 'grade-11', 'Std. 9', '7th standard', 'Level 4', 'Class 15', 'plain', ''][p_partkey % 8 + 1]"
QUERIES["fn_parse_grade"] = lambda s, d: table(s, d, "part").select("p_partkey", text.parse_grade(F.expr(NAMES)).alias("grade"))
_g = [f"TRY_CAST(nullif(regexp_extract(n, '{p}', 1), '') AS INT)" for p in (r"(?i)\b(?:class|grade|std\.?|standard)\s*[-:]?\s*(\d{1,2})\b", r"(?i)\b(\d{1,2})\s*(?:st|nd|rd|th)\s*(?:class|grade|std\.?|standard)?\b", r"\b(\d{1,2})\b")]
ORACLE_SQL["fn_parse_grade"] = f"SELECT p_partkey, coalesce({', '.join(f'CASE WHEN {g} BETWEEN 1 AND 12 THEN {g} END' for g in _g)}) AS grade FROM (SELECT p_partkey, {NAMES_SQL} AS n FROM part)"

ins = "coalesce(instructions, '')"
on_questions("fn_direction_start", f"regexp_matches({trim(ins)}, {lit(f'(?i)^{HEADER}' + chr(92) + 'b')}) AS v", v=lambda: text.direction_start(F.coalesce("instructions", F.lit(""))))
RANGE = r"(?i)(\d{1,3})\s*(?:[-–—]|to)\s*(\d{1,3})"
_rng = [f"TRY_CAST(nullif(regexp_extract({ins}, '{RANGE}', {i}), '') AS INT)" for i in (1, 2)]
on_questions("fn_direction_range", f"CASE WHEN {_rng[1]} >= {_rng[0]} THEN {_rng[0]} END AS a, CASE WHEN {_rng[1]} >= {_rng[0]} THEN {_rng[1]} END AS b", a=lambda: text.direction_range(F.coalesce("instructions", F.lit("")))[0], b=lambda: text.direction_range(F.coalesce("instructions", F.lit("")))[1])
glued = lambda: F.concat(c("stem"), F.lit(". "), F.coalesce("instructions", F.lit("")), F.lit(" 12. Then go"))
GLUED = f"(stem || '. ' || {ins} || ' 12. Then go')"
CUT = rf"(?i)(?:^|\n)\s*{HEADER}\b|\b{SHAPE}"
HEAD = rf"(?is)^(.*?)(?:(?:^|\n)\s*{HEADER}\b|\b{SHAPE})"
on_questions("fn_cut_directions", f"CASE WHEN regexp_matches({GLUED}, {lit(CUT)}) THEN regexp_replace(regexp_extract({GLUED}, {lit(HEAD)}, 1), '[.;,\\s]+$', '') ELSE {GLUED} END AS v", v=lambda: text.cut_direction_tail(glued()))
on_questions("fn_split_glued", f"regexp_replace({GLUED}, {lit(rf'(?i)([^\n])[ \t]+({SHAPE})')}, '\\1' || chr(10) || '\\2', 'g') AS v", v=lambda: text.split_glued(glued()))
SEPARATE = r"""([^\n])[ \t]+(\d{1,3})\s*[.)]\s+([A-Za-z"'(])"""
on_questions(
    "fn_separate_numbers",
    f"regexp_replace(regexp_replace({GLUED}, {lit(SEPARATE)}, '\\1' || chr(10) || '\\2. \\3', 'g'), {lit(rf'(?i)([^\n])[ \t]+({SHAPE})')}, '\\1' || chr(10) || '\\2', 'g') AS v",
    v=lambda: text.separate_numbers(glued()),
)
_clean = f"regexp_replace({trim('instructions')}, '(?i)^(?:directions?|instructions?)\\s*(?:\\([^)]*\\))?\\s*[-:.]?\\s*', '')"
on_questions("fn_printed_instruction", f"CASE WHEN {trim('instructions')} = '' THEN NULL WHEN {trim(_clean)} = '' THEN {trim('instructions')} ELSE {trim(_clean)} END AS v", v=lambda: text.printed_instruction(c("instructions")))
_starters = ", ".join(lit(w) for w in text.STEM_STARTERS)
on_questions("fn_is_direction", f"{ins} <> '' AND NOT contains({ins}, '?') AND regexp_extract({ins}, '[A-Za-z]+') <> '' AND lower(regexp_extract({ins}, '[A-Za-z]+')) NOT IN ({_starters}) AS v", v=lambda: text.is_direction(c("instructions")))

PATHS = ["d1/fig-2.png", "/etc/passwd", "a/../b.png", "x\\y.png", "d2/generated/z.svg", "d3/_manifest.json", "d4/q-block.jpg", "c d/e.png", "d5/page-1.jpg", " d6/fig-1.webp "]
PATH = lambda: F.expr(f"element_at(array({', '.join(repr(p) for p in PATHS)}), cast(o_orderkey % {len(PATHS)} as int) + 1)")
PATH_SQL = "[" + ", ".join(lit(p) for p in PATHS) + f"][o_orderkey % {len(PATHS)} + 1]"
QUERIES["fn_safe_path"] = lambda s, d: table(s, d, "orders").select("o_orderkey", text.stored_path(PATH()).alias("v"))
ORACLE_SQL["fn_safe_path"] = f"SELECT o_orderkey, CASE WHEN regexp_full_match(p, '[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*') AND NOT regexp_matches(p, '(^|/)_manifest\\.json$') THEN p END AS v FROM (SELECT o_orderkey, trim({PATH_SQL}) AS p FROM orders)"
QUERIES["fn_loadable_image"] = lambda s, d: table(s, d, "orders").select("o_orderkey", text.loadable_image(F.trim(PATH())).alias("v"))
ORACLE_SQL["fn_loadable_image"] = f"SELECT o_orderkey, regexp_matches(p, '(?i)\\.(jpe?g|png|webp|svg)$') AND (contains(p, '/generated/') OR regexp_matches(p, '(fig-|-block\\.)[^/]*$')) AS v FROM (SELECT o_orderkey, trim({PATH_SQL}) AS p FROM orders)"
QUERIES["fn_page_path"] = lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%d/page-%d.jpg", "l_orderkey", "l_linenumber").alias("v"))
ORACLE_SQL["fn_page_path"] = "SELECT l_orderkey, l_linenumber, l_orderkey || '/page-' || l_linenumber || '.jpg' AS v FROM lineitem"
on_documents("fn_numbered_heads", "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\(?\\d{1,3}\\s*[.)]'))) AS n", n=lambda: text.numbered_heads(c("text")).cast("long"))
MARKER = text.OPTION_MARKER
on_questions("fn_marker_count", f"len(regexp_extract_all(stem, {lit(MARKER)})) AS n", n=lambda: text.marker_count(c("stem")).cast("long"))
opts = "array_to_string(options, ' ')"
on_questions("fn_unclosed_math", f"(length(replace({opts}, '$$', '')) - length(replace(replace({opts}, '$$', ''), '$', ''))) % 2 = 1 AS v", v=lambda: text.unclosed_math(F.array_join("options", " ")))
_odd = "regexp_matches({0}, '\\b(?:7s|R5)\\b') OR regexp_matches({0}, '(?:^|[^\\d])7\\s+\\d{{2,}}(?:\\.\\d+)?\\b') OR regexp_matches({0}, '(?:^|[^\\d])7\\.\\d{{2}}\\b')"
_combined = "concat_ws(chr(10), nullif(stem, ''), nullif(array_to_string(options, chr(10)), ''))"
_money = f"regexp_matches({_combined}, {lit(text.MONEY_WORD)}) AND ({_odd.format(_combined)})"
on_questions("fn_currency_suspect", f"{_money} AS v", v=lambda: text.currency_suspect(F.concat_ws("\n", F.nullif("stem", F.lit("")), F.nullif(F.array_join("options", "\n"), F.lit("")))))
_partial = "trim(coalesce(number, '')) <> '' AND (regexp_matches(trim(stem), '[A-Za-z]-$') OR (length(trim(stem)) < 8 AND NOT regexp_matches(trim(stem), '[.?!]$') AND NOT (regexp_matches(trim(stem), '^[\\d\\s.+\\-×xX÷=/?()]+$') AND length(trim(stem)) >= 3)))"
on_questions("fn_partial_stem", f"{_partial} AS v", v=lambda: text.partial_stem(c("number"), c("stem")))
_missing = f"len(list_filter(options, lambda o: trim(o) <> '')) < 2 AND (kind IN ('mcq', 'multi_select') OR regexp_matches(stem, {lit(text.MCQ_PROMPT)}) OR len(regexp_extract_all(stem, {lit(MARKER)})) >= 2)"
on_questions("fn_missing_options", f"{_missing} AS v", v=lambda: text.missing_options(c("kind"), c("stem"), c("options")))
_smashed = "(len(list_filter(regexp_split_to_array(stem, '\\([A-Ha-h]\\)\\s*')[2:], lambda b: regexp_matches(b, '\\d\\s*[,'']\\s*\\d'))) >= 2 OR len(list_filter(string_split(stem, chr(10)), lambda x: len(regexp_extract_all(x, '\\b\\d{1,2}\\b')) >= 4 AND regexp_matches(x, '[+×xX÷=]'))) > 0)"
on_questions("fn_math_smashed", f"{_smashed} AS v", v=lambda: text.math_smashed(c("stem")))
on_questions(
    "fn_audit",
    "array_to_string(list_filter([" + f"CASE WHEN len(regexp_extract_all(stem, {lit(MARKER)})) >= 2 THEN 'options_in_stem' END, CASE WHEN {_missing} THEN 'missing_options' END, "
    f"CASE WHEN {_smashed} OR (length(replace({_combined}, '$$', '')) - length(replace(replace({_combined}, '$$', ''), '$', ''))) % 2 = 1 THEN 'broken_math' END, "
    f"CASE WHEN {_money} THEN 'suspicious_currency' END, CASE WHEN {_partial} THEN 'partial_stem' END], lambda x: x IS NOT NULL), ',') AS v",
    v=lambda: F.array_join(text.audit_flags(c("kind"), c("number"), c("stem"), c("options")), ","),
)
QUERIES["fn_scope_key"] = lambda s, d: table(s, d, "customer").select("c_custkey", text.scope_key(c("c_mktsegment"), F.when(c("c_custkey") % 3 > 0, c("c_nationkey")), c("c_custkey") % 7).alias("v"))
ORACLE_SQL["fn_scope_key"] = "SELECT c_custkey, c_mktsegment || ':' || coalesce(CAST(CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS VARCHAR), '-') || ':' || (c_custkey % 7) AS v FROM customer"
REASONS = ["No approved past-paper questions for x", "x produced no questions today", "x passed only 1/3", "it could not be judged", "fetch failed", "other"]
REASON = lambda: F.expr(f"element_at(array({', '.join(repr(r) for r in REASONS)}), cast(c_custkey % 6 as int) + 1)")
REASON_SQL = "[" + ", ".join(lit(r) for r in REASONS) + "][c_custkey % 6 + 1]"
QUERIES["fn_alert_kind"] = lambda s, d: table(s, d, "customer").select("c_custkey", text.alert_kind(REASON()).alias("v"))
ORACLE_SQL["fn_alert_kind"] = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'no_references' WHEN 1 THEN 'no_cases' WHEN 2 THEN 'low_pass_rate' WHEN 3 THEN 'judge_unavailable' END AS v FROM customer"
QUERIES["fn_transient_error"] = lambda s, d: table(s, d, "customer").select("c_custkey", text.transient_error(REASON()).alias("v"))
ORACLE_SQL["fn_transient_error"] = "SELECT c_custkey, c_custkey % 6 = 4 AS v FROM customer"
on_documents("fn_truncate", "md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '…[truncated ' || (length(text) - 2000) || ' chars]' ELSE text END) AS h", h=lambda: F.md5(text.truncated(c("text"), 2000)))
on_documents("fn_sha1", "sha1(text) AS h", h=lambda: F.sha1("text"))
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
on_documents(
    "fn_uuid5",
    f"substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS v",
    v=lambda: ids.uuid5(NAMESPACE, c("text")),
)
ORACLE_SQL["fn_uuid5"] = ORACLE_SQL["fn_uuid5"].replace("FROM documents", f"FROM (SELECT doc_id, sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(text)) AS h FROM documents)")
QUERIES["fn_content_hash"] = lambda s, d: table(s, d, "customer").select("c_custkey", ids.content_hash(["c_name", "c_custkey", "c_nationkey"]).alias("h"))
ORACLE_SQL["fn_content_hash"] = """SELECT c_custkey, sha1('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS h FROM customer"""
QUERIES["fn_fnv1a"] = lambda s, d: table(s, d, "part").select("p_partkey", ids.fnv1a(c("p_name")).alias("v"))
_fnv = "list_reduce(list_prepend(2166136261::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(p_name, '')]), lambda h, u: ((xor(h, u) * 16777619) & 4294967295))"
ORACLE_SQL["fn_fnv1a"] = f"SELECT p_partkey, {_fnv} AS v FROM part"
QUERIES["fn_asset_id"] = lambda s, d: table(s, d, "part").select("p_partkey", ids.asset_id(c("p_name")).alias("v"))
ORACLE_SQL["fn_asset_id"] = f"SELECT p_partkey, 'a' || lpad(lower(hex({_fnv})), 8, '0') AS v FROM part"

# Rule cascades.
_low = "lower(stem)"
_ow = "[lower(trim(o)) FOR o IN options]"
TYPE_SQL = f"""CASE WHEN len(options) = 2 AND list_contains({_ow}, 'true') AND list_contains({_ow}, 'false') THEN 'true_false'
 WHEN regexp_matches({_low}, 'true or false|state whether') AND len(options) = 0 THEN 'true_false'
 WHEN contains({_low}, 'assertion') AND contains({_low}, 'reason') THEN 'assertion_reason'
 WHEN regexp_matches({_low}, 'match the following|match column') THEN 'match_the_following' WHEN len(options) > 1 THEN 'mcq'
 WHEN regexp_matches({_low}, '_{{2,}}|fill in the blank') THEN 'fill_blank' WHEN regexp_matches({_low}, 'draw|figure|diagram|shown below') THEN 'diagram'
 WHEN regexp_matches({_low}, 'calculate|find the value|evaluate|solve') THEN 'numerical' WHEN length(stem) > 180 THEN 'long_answer' ELSE 'short_answer' END"""
on_questions("cls_question_type", f"{TYPE_SQL} AS v", v=lambda: rules.question_type(c("stem"), c("options")))


def _skill_sql() -> str:
    t = "concat_ws(chr(10), nullif(instructions, ''), nullif(stem, ''))"
    s = "trim(regexp_replace(stem, '\\s+', ' ', 'g'))"
    has = lambda p: f"regexp_matches({t}, {lit('(?i)' + p)})"
    tag = f"lower(regexp_extract({t}, '(?i)\\[skill:([a-z0-9_]+)\\]', 1))"
    out = [f"WHEN {tag} IN ({', '.join(map(lit, rules.CATALOGUE))}) THEN {tag}"]
    own = {
        "figure_identity": f"(kind = 'diagram' OR figures > 0) AND (length({s}) < 12 OR regexp_matches({s}, '(?i)^question figures?$'))",
        "printed_series": f"len(regexp_extract_all({s}, '-?\\d+(?:\\.\\d+)?')) >= 4 AND regexp_matches({s}, '[,;]|…|\\.\\.\\.')",
        "parts_of_speech": "regexp_matches(lower(array_to_string(options, ' ')), '\\b(adverb|verb|noun|adjective|preposition|conjunction)\\b')",
        "lone_word": "len(options) >= 3",
        "jumbled_sentences": f"length({s}) - length(replace({s}, '/', '')) >= 3",
    }
    for name, patterns, of_stem, figures in rules.SKILL_RULES:
        tests = [has(p) for p in patterns] + ([f"regexp_matches({s}, {lit('(?i)' + of_stem)})"] if of_stem else [])
        tests += [] if figures is None else ["figures > 0" if figures else "figures = 0"]
        tests += [f"({own[name]})"] if name in own else []
        out.append(f"WHEN {' AND '.join(tests)} THEN '{rules.RENAMED.get(name, name)}'")
    return "CASE " + " ".join(out) + " ELSE 'unsupported' END"


SKILL = lambda: rules.skill(c("stem"), c("instructions"), F.lit(None).cast("string"), c("figures"), c("options"), c("kind"))
on_questions("cls_skill", f"{_skill_sql()} AS v", v=SKILL)
on_questions("cls_number_series", "len(regexp_extract_all(stem, '-?\\d+(?:\\.\\d+)?')) >= 4 AND regexp_matches(stem, '[,;]|…|\\.\\.\\.') AS v", v=lambda: rules.is_number_series(c("stem")))
_nums = "[CAST(x AS DOUBLE) FOR x IN regexp_extract_all(regexp_replace(stem, '(?i)\\d+\\s*(?:st|nd|rd|th)\\b', ' ', 'g'), '-?\\d+(?:\\.\\d+)?')]"
SUB_SQL = """CASE WHEN len(n) < 4 THEN 'number_series' WHEN len([i FOR i IN generate_series(2, len(n)) IF abs((n[i] - n[i - 1]) - (n[2] - n[1])) >= 1e-9]) = 0 THEN 'arithmetic'
 WHEN NOT list_contains(n, 0.0) AND len([i FOR i IN generate_series(2, len(n)) IF abs(n[i] / n[i - 1] - n[2] / n[1]) >= 1e-9]) = 0 THEN 'geometric' ELSE 'two_step' END"""
on_questions("cls_series_subtype", f"{SUB_SQL} AS v", v=lambda: rules.series_subtype(c("stem")))
ORACLE_SQL["cls_series_subtype"] = f"WITH {QUESTIONS_SQL}, x AS (SELECT doc_id, {_nums} AS n FROM q) SELECT doc_id, {SUB_SQL} AS v FROM x"
SKILL_NAMES = ["mirror_image", "number_series", "letter_series", "coding_decoding", "general_knowledge", "percentage", "grammar", "ranking", "", "oddity"]
FAMILIES = ["figure", "math", "intelligence", "intelligence", "textual", "math", "textual", "intelligence", "math", None]
_pick = lambda xs: F.expr(f"element_at(array({', '.join('null' if x is None else repr(x) for x in xs)}), cast(p_partkey % {len(xs)} as int) + 1)")
QUERIES["cls_pattern_type"] = lambda s, d: table(s, d, "part").select("p_partkey", rules.pattern_type(_pick(SKILL_NAMES), _pick(FAMILIES)).alias("v"))
ORACLE_SQL["cls_pattern_type"] = "SELECT p_partkey, ['figure_pattern', 'number_series', 'letter_series', 'coding', 'knowledge', 'arithmetic', 'language', 'verbal_reasoning', 'unknown', 'unknown'][p_partkey % 10 + 1] AS v FROM part"
_sk = "['mirror_image', 'water_image', 'synonym_antonym', 'figure_pattern', 'ranking'][doc_id % 5 + 1]"
_sks = lambda: F.expr("element_at(array('mirror_image', 'water_image', 'synonym_antonym', 'figure_pattern', 'ranking'), cast(doc_id % 5 as int) + 1)")
_tx = "lower(stem || chr(10) || coalesce(instructions, ''))"
on_questions(
    "cls_pattern_subtype",
    f"""CASE {_sk} WHEN 'mirror_image' THEN CASE WHEN contains({_tx}, 'water') THEN 'water' ELSE 'vertical' END WHEN 'water_image' THEN 'water'
 WHEN 'synonym_antonym' THEN CASE WHEN regexp_matches({_tx}, 'opposite|antonym') THEN 'antonym' WHEN regexp_matches({_tx}, 'synonym|same meaning|similar meaning|same in meaning') THEN 'synonym' ELSE 'synonym_antonym' END
 WHEN 'figure_pattern' THEN CASE WHEN regexp_matches({_tx}, 'mirror|reflection') THEN 'mirror' WHEN regexp_matches({_tx}, 'embedded|hidden') THEN 'embedded' WHEN contains({_tx}, 'missing number') THEN 'missing'
   WHEN regexp_matches({_tx}, 'rotat|turned') THEN 'rotation' WHEN regexp_matches({_tx}, 'complete the pattern|pattern completion') THEN 'completion' ELSE 'figure_pattern' END ELSE {_sk} END AS v""",
    v=lambda: rules.pattern_subtype(_sks(), c("stem"), c("instructions")),
)
on_questions(
    "fn_map_type",
    "CASE WHEN kind = 'mcq' THEN 'mcq_single' WHEN kind IN ('true_false', 'fill_blank', 'assertion_reason', 'comprehension') THEN kind WHEN kind = 'multi_select' THEN 'mcq_multi' WHEN kind = 'match_the_following' THEN 'matching' WHEN kind IN ('short_answer', 'long_answer', 'numerical') THEN 'short_answer' WHEN len(options) > 0 THEN 'mcq_single' ELSE 'short_answer' END AS v",
    v=lambda: rules.export_type(c("kind"), c("options")),
)
on_questions("flt_usable_stems", f"length({trim('stem')}) >= 8 AS v", v=lambda: F.length(text.trimmed(c("stem"))) >= 8)
QUERIES["prj_parse_page"] = lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.trim("p_brand").rlike("#[1-9][0-9]*$"), F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int") - 1).alias("page"))
ORACLE_SQL["prj_parse_page"] = "SELECT p_partkey, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) - 1 AS page FROM part"
QUERIES["gen_options"] = lambda s, d: questions(s, d).select("doc_id", F.posexplode(text.option_bodies(c("stem"))).alias("ord", "body"))
ORACLE_SQL["gen_options"] = f"WITH {QUESTIONS_SQL}, x AS (SELECT doc_id, [trim(b) FOR b IN regexp_split_to_array(stem, '\\([A-Ha-h]\\)\\s*')[2:]] AS b FROM q) SELECT doc_id, unnest(generate_series(0, len(b) - 1)) AS ord, unnest(b) AS body FROM x WHERE len(b) >= 2"
