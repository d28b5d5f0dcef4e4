"""Queries for cropped questions, their figures and the text of pages, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.operators import blocks, crops, figures, page_text
from questmill.plans.library_queries import BOXES, _boxes
from questmill.plans.text_queries import CUT, HEAD, TYPE_SQL, lit, trim
from questmill.sources.driver_tables import PAGE_LINES_SQL, QUESTIONS_SQL, questions, spread
from questmill.sources.question_trees import LIBRARY_QUESTIONS_SQL, library_questions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


def _crops(s: SparkSession, d: str) -> DataFrame:
    """The sample questions as crops in every layout and in none, their documents' whole texts behind them."""
    layout = F.element_at(F.array(*map(F.lit, (*crops.LAYOUTS, None))), (c("doc_id") % 9 + 1).cast("int"))
    each = lambda f: F.array_join(F.transform("options", f), "")
    marked = each(lambda o, i: F.concat(F.lit(" ("), F.substring(F.lit("abcdefgh"), i + 1, F.lit(1)), F.lit(") "), o))
    lettered = each(lambda o, i: F.concat(F.lit(" "), F.char(i + 65), F.lit(". "), o, F.lit(";")))
    table = each(lambda o, i: F.concat(F.lit("\n"), o, F.lit("\tright "), i.cast("string")))
    again = F.when(c("doc_id") % 4 == 0, " (a) again (B)").otherwise("")
    body = (
        F.when(c("layout") == "letters", F.concat("stem", lettered))
        .when(c("layout") == "match", F.concat("stem", table))
        .when(c("layout") == "fill_blank", F.concat("stem", F.lit(" _____ and  ___")))
        .when(c("layout") == "assertion_reason", F.concat(F.lit("Assertion (A): "), "stem", F.lit(" Reason (R): so it is"), marked))
        .otherwise(F.concat("stem", marked, again))
    )
    text = F.concat(F.when(c("number").isNull(), "").otherwise(F.concat("number", F.lit(". "))), body, F.lit("\n"), "passage")
    return questions(s, d).withColumn("layout", layout).select("doc_id", "layout", text.alias("text"), (c("doc_id") % 50).cast("string").alias("number"))


# The texts as above, then each layout's reading over three parts: the source's choices, the columns, the assertion.
_LAYOUTS = "[" + ", ".join(map(lit, crops.LAYOUTS)) + ", NULL]"
_MARKED = "array_to_string([' (' || 'abcdefgh'[i] || ') ' || options[i] FOR i IN range(1, len(options) + 1)], '')"
_CROPS_SQL = f"""{QUESTIONS_SQL},
c0 AS (SELECT doc_id, number, stem, options, passage, {_LAYOUTS}[doc_id % 9 + 1] AS layout FROM q),
c1 AS (SELECT doc_id, layout, CAST(doc_id % 50 AS VARCHAR) AS given, coalesce(number || '. ', '') || CASE layout
    WHEN 'letters' THEN stem || array_to_string([' ' || chr(CAST(i + 64 AS INT)) || '. ' || options[i] || ';' FOR i IN range(1, len(options) + 1)], '')
    WHEN 'match' THEN stem || array_to_string([chr(10) || options[i] || chr(9) || 'right ' || (i - 1) FOR i IN range(1, len(options) + 1)], '')
    WHEN 'fill_blank' THEN stem || ' _____ and  ___'
    WHEN 'assertion_reason' THEN 'Assertion (A): ' || stem || ' Reason (R): so it is' || {_MARKED}
    ELSE stem || {_MARKED} || CASE WHEN doc_id % 4 = 0 THEN ' (a) again (B)' ELSE '' END END || chr(10) || passage AS text FROM c0),
c2 AS (SELECT doc_id, layout, given, {trim("text")} AS own FROM c1),
c3 AS (SELECT doc_id, layout, coalesce(nullif(regexp_extract(own, {lit(crops.LEADING)}, 1), ''), given) AS number,
  {trim(f"regexp_replace(own, {lit(crops.LEADING)}, '')")} AS body FROM c2 WHERE own <> '')"""
_LINES = "string_split(body, chr(10))"
_CELLS = f"[[y FOR y IN [{trim('z')} FOR z IN regexp_split_to_array(x, '\\t+|\\s{{2,}}')] IF y <> ''] FOR x IN {_LINES}]"
_N_PAIRS = f"len([1 FOR y IN [[z FOR z IN regexp_split_to_array({trim('x')}, '\\t+|\\s{{2,}}') IF z <> ''] FOR x IN {_LINES}] IF len(y) = 2])"
_COUNT = lambda p: f"len(regexp_extract_all(body, {lit(p)}))"
_TRUE_FALSE = "regexp_matches(body, '(?i)\\(a\\)\\s*true\\b') AND regexp_matches(body, '(?i)\\(b\\)\\s*false\\b')"
_LIKELY = f"""c4 AS (SELECT *, [CASE WHEN regexp_matches(body, {lit(crops.ASSERTION)}) THEN 9 ELSE 0 END, CASE WHEN {_TRUE_FALSE} AND par = 2 THEN 3 ELSE 0 END,
  CASE WHEN len(regexp_extract_all(body, '/')) >= 2 AND par >= 2 THEN par + 1 ELSE 0 END, CASE WHEN np >= 2 THEN np ELSE 0 END,
  CASE WHEN par >= 2 THEN par ELSE 0 END, CASE WHEN let >= 2 THEN let ELSE 0 END, len(regexp_extract_all(body, '_{{2,}}'))] AS seen
  FROM (SELECT *, {_N_PAIRS} AS np, {_COUNT(crops.IN_PARENTHESES)} AS par, {_COUNT(crops.LETTERS)} AS let FROM c3)),
c5 AS (SELECT doc_id, number, body, coalesce(layout, CASE WHEN list_max(seen) = 0 THEN 'plain' ELSE
  ['assertion_reason', 'true_false', 'jumble', 'match', 'parentheses', 'letters', 'fill_blank'][list_position(seen, list_max(seen))] END) AS layout FROM c4)"""
_ASSERTED = f"layout = 'assertion_reason' AND regexp_matches(body, {lit(crops.ASSERTION)})"
_CUT_SQL = f"CASE WHEN regexp_matches(x, {lit(CUT)}) THEN regexp_replace(regexp_extract(x, {lit(HEAD)}, 1), '[.;,\\s]+$', '') ELSE x END"
_MARK = lambda p: f"regexp_replace(source, {lit(p)}, chr(1) || '\\1' || chr(2), 'g')"
_KEYED = """list_reduce([[o] FOR o IN drafts], lambda done, o: list_append(done, {'key': CASE WHEN list_contains([z.key FOR z IN done], o[1].key)
  THEN coalesce([k FOR k IN ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'] IF NOT list_contains([z.key FOR z IN done], k)][1], o[1].key) ELSE o[1].key END, 'text': o[1].text}),
  []::STRUCT("key" VARCHAR, "text" VARCHAR)[])"""
_READ_SQL = f"""c6 AS (SELECT *, {_ASSERTED} AS asserted, CASE WHEN {_ASSERTED} THEN {trim(f"regexp_extract(body, {lit(crops.ASSERTION)}, 2)")} ELSE body END AS x FROM c5),
c7 AS (SELECT *, {_CUT_SQL} AS source FROM c6),
c8 AS (SELECT *, string_split(CASE WHEN layout = 'letters' THEN {_MARK(crops.LETTERS)} ELSE {_MARK(crops.IN_PARENTHESES)} END, chr(1)) AS parts FROM c7),
c9 AS (SELECT *, layout NOT IN ('fill_blank', 'match', 'plain') AND len(parts) > 2 AS several,
  [o FOR o IN [{{'key': upper(p[1]), 'text': regexp_replace({trim("p[3:]")}, '[.;,]$', '')}} FOR p IN parts[2:]] IF o.text <> ''] AS drafts FROM c8),
c10 AS (SELECT *, CASE WHEN several THEN {_KEYED} ELSE [] END AS options, {trim("CASE WHEN several THEN parts[1] ELSE source END")} AS head, {_CELLS} AS cells FROM c9),
c11 AS (SELECT *, CASE WHEN asserted THEN {trim(f"regexp_extract(body, {lit(crops.ASSERTION)}, 1)")}
    WHEN layout IN ('fill_blank', 'plain') THEN {trim("regexp_replace(CASE WHEN layout = 'plain' THEN body ELSE regexp_replace(body, '_{2,}', '____', 'g') END, '\\s+', ' ', 'g')")}
    WHEN layout = 'match' THEN coalesce(nullif({trim(f"regexp_replace(array_to_string([{trim('k')} FOR k IN [{_LINES}[i] FOR i IN range(1, len(cells) + 1) IF len(cells[i]) <> 2] IF {trim('k')} <> ''], ' '), '\\s+', ' ', 'g')")}, ''), '{crops.MATCH_STEM}')
    WHEN layout = 'jumble' THEN {trim("regexp_replace(coalesce(nullif(head, ''), body), '[ \\t]+', ' ', 'g')")}
    ELSE coalesce(nullif(head, ''), body) END AS stem FROM c10),
c12 AS (SELECT doc_id, layout, number, asserted, head, cells, stem, [o.text FOR o IN options] AS options, [o.key FOR o IN options] AS keys FROM c11 WHERE stem <> '')
SELECT doc_id, layout, number, CASE layout WHEN 'match' THEN 'match_the_following' WHEN 'jumble' THEN CASE WHEN len(options) > 1 THEN 'mcq' ELSE 'short_answer' END
    WHEN 'true_false' THEN layout WHEN 'assertion_reason' THEN layout WHEN 'fill_blank' THEN layout ELSE {TYPE_SQL} END AS type,
  stem, array_to_string(keys, '') AS keys, array_to_string(options, '|') AS options,
  CASE WHEN layout = 'fill_blank' THEN greatest(1, len(regexp_extract_all(stem, '____'))) ELSE 0 END AS blanks,
  CASE WHEN layout = 'match' THEN array_to_string([x[1] || '=' || x[2] FOR x IN cells IF len(x) = 2], '|') ELSE '' END AS pairs,
  CASE WHEN asserted THEN nullif(head, '') END AS reason FROM c12"""


@query("gen_crop", f"WITH {_CROPS_SQL},\n{_LIKELY},\n{_READ_SQL}")
def gen_crop(s, d):
    read = crops.read_crops(_crops(s, d))
    return read.select(
        "doc_id", "layout", "number", "type", "stem", F.array_join(F.transform("options", lambda o: o["key"]), "").alias("keys"),
        F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"), "blanks",
        F.array_join(F.transform("pairs", lambda p: F.concat(p["left"], F.lit("="), p["right"])), "|").alias("pairs"), "reason",
    )



def _page_parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, figures and numbered lines of pages of boxes: three figures a box, choices of four kinds, pages with one question or with placed figures."""
    b = _boxes(s, d).groupBy("page", "kind").agg(*[F.min(x).alias(x) for x in ("id", "x", "y")])
    b = b.withColumns({"of": c("kind").cast("long"), "k": c("id") * 10 + c("kind")})
    option = lambda key, text: F.struct(F.lit(key).alias("key"), F.lit(text).alias("text"), F.lit(None).cast("boolean").alias("is_correct"))
    none = F.array().cast("array<struct<key:string,text:string,is_correct:boolean>>")
    choices = (
        F.when(c("page") % 4 == 0, none).when(c("page") % 4 == 1, F.array(*[option(k, k.lower()) for k in "ABCD"]))
        .when(c("page") % 4 == 2, F.array(option("A", "a long text"), option("C", "another"))).otherwise(F.array(option("B", "x")))
    )
    own = F.struct(F.lit("old").alias("description"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("role"), *[F.lit(0.5).alias(x) for x in "xywh"])
    asked = b.where("kind <= 3 and k % 5 > 0").select(
        "page", c("of").alias("ord"), F.concat(F.lit("Q"), c("of").cast("string")).alias("number"), F.lit("mcq").alias("type"),
        F.concat(F.lit("Look at Question  Figure "), F.lit("question figure "), c("k").cast("string")).alias("stem"), choices.alias("options"),
        F.when((c("page") % 13 == 0) & (c("of") == 1), F.array(own)).otherwise(F.array().cast(f"array<{figures.FIGURE}>")).alias("figures"),
    )
    boxes = b.where("kind > 3").select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    drawn = boxes.select("page", (c("k") * 10 + c("n")).alias("id"), (c("x") * 0.4 + c("n") * 0.2).alias("x"), "y", F.lit(0.1).alias("w"), (c("k") % 7 / 100).alias("h"))
    lines = b.where("kind <= 3 and page % 3 > 0").select("page", c("of").alias("ord"), F.concat(c("of").cast("string"), F.lit(" . line")).alias("text"), "x", "y", F.lit(0.1).alias("w"))
    return asked, drawn, lines


# Owners by the nearest number above, figure by figure; rows by folding each question's figures.
_DECORATE_SQL = f"""WITH {BOXES}, k AS (SELECT page, kind, min(x) AS x, min(y) AS y, min(id) * 10 + kind AS k FROM b GROUP BY page, kind),
q AS (SELECT page, CAST(kind AS BIGINT) AS ord, k, CASE page % 4 WHEN 0 THEN []
    WHEN 1 THEN [{{'key': 'A', 'text': 'a'}}, {{'key': 'B', 'text': 'b'}}, {{'key': 'C', 'text': 'c'}}, {{'key': 'D', 'text': 'd'}}]
    WHEN 2 THEN [{{'key': 'A', 'text': 'a long text'}}, {{'key': 'C', 'text': 'another'}}] ELSE [{{'key': 'B', 'text': 'x'}}] END AS options,
  page % 13 = 0 AND kind = 1 AS placed FROM k WHERE kind <= 3 AND k % 5 > 0),
p AS (SELECT page, count(*) AS n, min(ord) AS first, bool_or(placed) AS done FROM q GROUP BY page),
l AS (SELECT page, CAST(kind AS BIGINT) AS ord, x + 0.1 / 2 < 0.5 AS lft, y FROM k WHERE kind <= 3 AND page % 3 > 0),
f AS (SELECT page, k * 10 + n AS id, x * 0.4 + n * 0.2 AS x, y, k % 7 / 100 AS h FROM k, range(3) r(n) WHERE kind > 3),
g AS (SELECT f.*, p.first, p.n > 1 AND EXISTS (SELECT 1 FROM l WHERE l.page = f.page) AS numbered FROM f JOIN p ON p.page = f.page WHERE NOT p.done),
a AS (SELECT l.page, l.ord, l.lft, l.y FROM l WHERE EXISTS (SELECT 1 FROM q WHERE q.page = l.page AND q.ord = l.ord)),
h AS (SELECT g.*, EXISTS (SELECT 1 FROM a WHERE a.page = g.page AND a.lft = (g.x + 0.1 / 2 < 0.5)) AS has FROM g WHERE numbered),
o AS (SELECT h.page, arg_max(a.ord, (a.y, -a.ord)) AS ord, h.id, h.x, h.y, h.h FROM h JOIN a ON a.page = h.page AND a.y <= h.y + h.h / 2 + 0.04 AND (NOT has OR a.lft = (h.x + 0.1 / 2 < 0.5)) GROUP BY ALL
  UNION ALL SELECT page, first, id, x, y, h FROM g WHERE NOT numbered),
r AS (SELECT page, ord, list_reduce([[z] FOR z IN list_sort(list({{'y': y, 'x': x, 'id': id, 'h': h, 'line': 0, 'bottom': 0.0::DOUBLE}}))],
  lambda u, z: list_append(u, {{'y': z[1].y, 'x': z[1].x, 'id': z[1].id, 'h': z[1].h, 'line': CASE WHEN len(u) = 0 THEN 0 ELSE u[-1].line + CASE WHEN z[1].y > u[-1].bottom + greatest(0.008, z[1].h * 0.35) THEN 1 ELSE 0 END END,
    'bottom': CASE WHEN len(u) = 0 OR z[1].y > u[-1].bottom + greatest(0.008, z[1].h * 0.35) THEN z[1].y + z[1].h ELSE u[-1].bottom END}}),
  []::STRUCT(y DOUBLE, x DOUBLE, id BIGINT, h DOUBLE, line INTEGER, bottom DOUBLE)[]) AS z FROM o GROUP BY page, ord),
e AS (SELECT page, ord, unnest(z, recursive := true) FROM r),
n AS (SELECT page, ord, line, count(*) AS n, list(id ORDER BY x, id) AS ids FROM e GROUP BY ALL),
m AS (SELECT page, ord, max((n, line)) AS best, count(*) AS lines FROM n GROUP BY ALL),
t AS (SELECT n.page, n.ord, list(ids ORDER BY n.line) FILTER (n.line <> best[2] OR best[1] < CASE WHEN lines > 1 THEN 2 ELSE 4 END) AS shown,
  coalesce(any_value(ids) FILTER (n.line = best[2] AND best[1] >= CASE WHEN lines > 1 THEN 2 ELSE 4 END), []) AS drawn FROM n JOIN m ON m.page = n.page AND m.ord = n.ord GROUP BY n.page, n.ord),
v AS (SELECT q.*, t.page IS NOT NULL AS has, coalesce(flatten(shown), []) AS shown, coalesce(drawn, []) AS drawn, [chr(CAST(i + 64 AS INT)) FOR i IN range(1, len(coalesce(drawn, [])) + 1)] AS keys FROM q LEFT JOIN t ON t.page = q.page AND t.ord = q.ord)
SELECT page, ord, CASE WHEN has THEN 'diagram' ELSE 'mcq' END AS type, CASE WHEN has THEN 'Look at Question Figure ' || k ELSE 'Look at Question  Figure question figure ' || k END AS stem,
  array_to_string([o.key || '=' || o.text FOR o IN CASE WHEN len(drawn) >= 2 AND len([1 FOR o IN options IF length(o.text) > 2]) = 0
    THEN [{{'key': key, 'text': coalesce([o.text FOR o IN options IF o.key = key][1], '')}} FOR key IN keys]
    ELSE options || [{{'key': key, 'text': ''}} FOR key IN keys IF NOT list_contains([o.key FOR o IN options], key)] END], '|') AS options,
  CASE WHEN placed THEN 'old@0.5' WHEN has THEN array_to_string(['question@' || (len(drawn) + i - i) FOR i IN range(len(shown))] || ['option' || keys[i] FOR i IN range(1, len(drawn) + 1)], '|') ELSE '' END AS figures FROM v"""


@query("gen_decorate", _DECORATE_SQL)
def gen_decorate(s, d):
    asked, drawn, lines = _page_parts(s, d)
    size = F.size(F.filter("figures", lambda f: f["role"] == "option_figure"))
    said = lambda f: F.when(f["role"].isNull(), F.concat(f["description"], F.lit("@"), f["x"].cast("string"))).when(f["role"] == "question_figure", F.concat(F.lit("question@"), size.cast("string"))).otherwise(F.concat(F.lit("option"), f["caption"]))
    return figures.decorate(asked, drawn, lines).select(
        "page", "ord", "type", "stem", F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit("="), o["text"])), "|").alias("options"),
        F.array_join(F.transform("figures", said), "|").alias("figures"),
    )


# Every document is a block whose sentences got numbers; the SQL cuts off one piece at a time.
_P = lit(blocks.SWALLOWED)
_R = lambda v: f"floor(({v}) * 10000 + 0.5) / 10000"
_IN = lambda v: f"greatest(0.0, least(1.0, {v}))"
_HEIGHT = lambda v: _R(f"greatest(0.01, {_IN(v)})")


@query(
    "gen_split_swallowed",
    rf"""WITH RECURSIVE {PAGE_LINES_SQL},
b AS (SELECT doc_id, CAST(doc_id % 4 AS VARCHAR) AS number, list({{'text': regexp_replace(line, '\. ([A-Z])', ' ' || (ord % 3 + 1) || '. \1', 'g'), 'y': 0.05 + ord * 0.013}} ORDER BY ord) AS l FROM lines GROUP BY doc_id),
r(doc_id, part, number, l, top, height) AS (SELECT doc_id, 0, number, l, CAST(0.05 AS DOUBLE), CAST(0.9 AS DOUBLE) FROM b
  UNION ALL SELECT doc_id, part + 1, regexp_extract(t, {_P}, 2), [{{'text': regexp_extract(t, {_P}, 2) || '. ' || {trim(f"regexp_extract(t, {_P}, 3)")}, 'y': l[i].y}}] || l[i + 1:],
    {_R(_IN("l[i].y"))}, {_HEIGHT("least(top + height - l[i].y, 1 - " + _IN("l[i].y") + ")")}
  FROM (SELECT *, {trim("l[i].text")} AS t FROM (SELECT *, list_min([k FOR k IN range(1, len(l) + 1) IF regexp_matches({trim("l[k].text")}, {_P}) AND NOT (k = 1 AND regexp_extract({trim("l[k].text")}, {_P}, 2) = number)]) AS i FROM r)) WHERE i IS NOT NULL),
w AS (SELECT *, lead(l[1].y) OVER (PARTITION BY doc_id ORDER BY part) AS cut, list_min([k FOR k IN range(1, len(l) + 1) IF regexp_matches({trim("l[k].text")}, {_P}) AND NOT (k = 1 AND regexp_extract({trim("l[k].text")}, {_P}, 2) = number)]) AS i FROM r)
SELECT doc_id, part, number, CASE WHEN i IS NULL THEN top ELSE {_R(_IN("top"))} END AS y, CASE WHEN i IS NULL THEN height ELSE {_HEIGHT("least(cut - top, 1 - " + _IN("top") + ")")} END AS h,
  array_to_string(CASE WHEN i IS NULL THEN [z.text FOR z IN l] ELSE [z.text FOR z IN l[:i - 1]] || [{trim("regexp_extract(" + trim("l[i].text") + f", {_P}, 1)")}] END, chr(10)) AS text FROM w""",
)
def gen_split_swallowed(s, d):
    def line(text, i):
        said = F.regexp_replace(text, F.lit(r"\. ([A-Z])"), F.concat(F.lit(" "), (i % 3 + 1).cast("string"), F.lit(". $1")))
        return F.struct(said.alias("text"), F.lit(0.1).alias("x"), (i * 0.013 + 0.05).alias("y"), F.lit(0.5).alias("w"), F.lit(0.01).alias("h"))

    docs = spread(s, d, "documents", "doc_id").where("text is not null")
    whole = docs.select(c("doc_id").alias("page"), F.transform(F.split("text", "\n"), line).alias("lines"))
    box = {"x": 0.1, "y": 0.05, "w": 0.8, "h": 0.9}
    cut = blocks.split_swallowed(whole.withColumns({"block": F.lit(0), "number": (c("page") % 4).cast("string")} | {k: F.lit(v) for k, v in box.items()}))
    return cut.select(c("page").alias("doc_id"), "part", "number", "y", "h", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def _page_lines(s: SparkSession, d: str) -> DataFrame:
    """Boxes of pages as lines: numbered heads, numbers alone and words, some without text or extent."""
    k = c("id") * 10 + c("kind")
    text = F.when(c("kind") <= 5, F.concat(c("kind").cast("string"), F.lit(".  head "), k.cast("string"))).when(c("kind") == 6, " (7) ").when(k % 11 == 0, " ").otherwise(F.concat(F.lit("w "), k.cast("string")))
    return _boxes(s, d).select("page", k.cast("long").alias("ord"), text.alias("text"), (c("x") * 0.9).alias("x"), "y", F.when(k % 13 == 0, 0.0).otherwise(0.1).alias("w"), (k % 5 / 100 + 0.01).alias("h"))


@query(
    "gen_ordered_text",
    rf"""WITH {BOXES}, k AS (SELECT *, id * 10 + kind AS k FROM b),
l AS (SELECT page, k AS ord, trim(CASE WHEN kind <= 5 THEN kind || '.  head ' || k WHEN kind = 6 THEN ' (7) ' WHEN k % 11 = 0 THEN ' ' ELSE 'w ' || k END) AS text, x * 0.9 AS x, y,
  k % 5 / 100 + 0.01 AS h FROM k WHERE k % 13 <> 0),
u AS (SELECT * FROM l WHERE text <> ''),
n AS (SELECT *, row_number() OVER w AS r, x - lag(x) OVER w AS gap, count(*) OVER (PARTITION BY page) AS n FROM u WHERE regexp_matches(text, {lit(page_text.NUMBER_HEAD)}) WINDOW w AS (PARTITION BY page ORDER BY x, ord)),
g AS (SELECT page, n, arg_max(r, (gap, -r)) AS r, max(gap) AS gap FROM n WHERE gap IS NOT NULL GROUP BY page, n),
m AS (SELECT n.page, greatest(0, least(1, (greatest(0, max(x + 0.1) FILTER (n.r < g.r)) + least(1, min(x) FILTER (n.r >= g.r))) / 2)) AS mid FROM n JOIN g ON g.page = n.page
  WHERE g.n >= 4 AND g.gap >= 0.18 AND g.r > 2 AND g.n - g.r >= 1 GROUP BY n.page),
s AS (SELECT u.*, coalesce(x + 0.1 / 2 >= mid, false) AS side FROM u LEFT JOIN m ON m.page = u.page),
p AS (SELECT page, side, list_reduce([[z] FOR z IN list_sort(list({{'y': y, 'x': x, 'ord': ord, 'h': h, 'text': text, 'line': 0, 'top': 0.0::DOUBLE, 'low': 0.0::DOUBLE}}))], lambda a, z: list_append(a,
    CASE WHEN len(a) > 0 AND z[1].y + z[1].h / 2 BETWEEN a[-1].top - greatest(a[-1].low - a[-1].top, z[1].h, 0.01) * 0.25 AND a[-1].low + greatest(a[-1].low - a[-1].top, z[1].h, 0.01) * 0.25
    THEN {{'y': z[1].y, 'x': z[1].x, 'ord': z[1].ord, 'h': z[1].h, 'text': z[1].text, 'line': a[-1].line, 'top': least(a[-1].top, z[1].y), 'low': greatest(a[-1].low, z[1].y + z[1].h)}}
    ELSE {{'y': z[1].y, 'x': z[1].x, 'ord': z[1].ord, 'h': z[1].h, 'text': z[1].text, 'line': CASE WHEN len(a) = 0 THEN 0 ELSE a[-1].line + 1 END, 'top': z[1].y, 'low': z[1].y + z[1].h}} END),
  []::STRUCT(y DOUBLE, x DOUBLE, ord BIGINT, h DOUBLE, "text" VARCHAR, line INTEGER, top DOUBLE, low DOUBLE)[]) AS a FROM s GROUP BY page, side),
e AS (SELECT page, side, unnest(a, recursive := true) FROM p),
r AS (SELECT page, side, line, list(text ORDER BY x, y, ord) AS t FROM e GROUP BY ALL),
q AS (SELECT page, side, line, trim(regexp_replace(CASE WHEN len(t) > 1 AND regexp_matches(t[1], {{number}}) THEN regexp_extract(t[1], {{number}}, 1) || '. ' || array_to_string(t[2:], ' ') ELSE array_to_string(t, ' ') END, '\s+', ' ', 'g')) AS said FROM r)
SELECT page, string_agg(said, chr(10) ORDER BY side, line) AS text FROM q GROUP BY page""".replace("{number}", lit(page_text.NUMBER_ALONE)),
)
def gen_ordered_text(s, d):
    return page_text.page_texts(_page_lines(s, d))


@query("gen_fractions", "")
def gen_fractions(s, d):
    """Boxes as words, most of them numbers, on a page of closer words."""
    k = c("id") * 10 + c("kind")
    text = F.when(k % 4 == 0, "word").otherwise((k % 97 + 1).cast("string"))
    words = _boxes(s, d).select("page", k.cast("long").alias("ord"), text.alias("text"), (c("x") * 0.1).alias("x"), (c("y") * 0.1).alias("y"), F.lit(0.02).alias("w"), F.lit(0.02).alias("h"))
    found = page_text.stacked_fractions(words)
    return found.select("page", "text", F.size("fractions").alias("n"))


del ORACLE_SQL["gen_fractions"]


# Every question of the library is read again: in other words, some without a number, some as comprehension, every fourth in graphics mode.
@query(
    "prj_apply_crop",
    f"""WITH {LIBRARY_QUESTIONS_SQL}, k AS (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM lib)
SELECT id, page, CASE WHEN k % 2 = 0 THEN number ELSE '9' END AS number, CASE WHEN k % 3 = 0 THEN 'comprehension' ELSE 'mcq' END AS type, upper(stem) AS stem, NULL::VARCHAR AS instructions,
  array_to_string([o.key || '=' || o.text || CASE WHEN k % 4 = 0 THEN '@new.png' ELSE '' END FOR o IN options], '|') AS options,
  CASE WHEN k % 4 = 0 THEN least(len(figures), 1) ELSE 0 END AS figures, CASE WHEN k % 3 = 0 THEN len(sub_questions) ELSE 0 END AS parts, CASE WHEN k % 5 > 0 THEN 0.5 ELSE 0.25 END AS confidence,
  false AS approved, NULL::VARCHAR AS approval_status, NULL::VARCHAR AS hint, NULL::VARCHAR AS explanation, tags FROM k""",
)
def prj_apply_crop(s, d):
    k = F.substr(c("id"), F.lit(2)).cast("bigint")
    q = library_questions(s, d).withColumns({"k": k, "confidence": F.lit(0.25), "approved": F.lit(True)})
    now = F.struct(*[c(x) for x in q.columns])
    options = F.transform("options", lambda o: o.withField("image_path", F.lit("new.png")))
    read = {
        "id": F.lit("other"), "number": F.when(c("k") % 2 == 0, " ").otherwise("9"), "type": F.when(c("k") % 3 == 0, "comprehension").otherwise("mcq"), "stem": F.upper("stem"),
        "instructions": F.lit(None).cast("string"), "options": options, "figures": F.slice("figures", 1, 1), "sub_questions": F.slice("sub_questions", 1, 0),
        "confidence": F.when(c("k") % 5 > 0, 0.5), "hint": F.lit("read"), "approved": F.lit(True),
    }
    reading = F.struct(*[read.get(x, c(x)).alias(x) for x in q.columns])
    done = q.select("k", now.alias("now"), reading.alias("reading")).select("k", crops.apply_reading(c("now"), c("reading"), c("k") % 4 == 0).alias("q"))
    said = F.transform("q.options", lambda o: F.concat(o["key"], F.lit("="), o["text"], F.coalesce(F.concat(F.lit("@"), o["image_path"]), F.lit(""))))
    return done.select(
        "q.id", "q.page", "q.number", "q.type", "q.stem", "q.instructions", F.array_join(said, "|").alias("options"), F.size("q.figures").alias("figures"), F.size("q.sub_questions").alias("parts"),
        "q.confidence", "q.approved", "q.approval_status", "q.hint", "q.explanation", "q.tags",
    )
