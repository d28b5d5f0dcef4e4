"""The export's fifteen tables and the question-tree edits, with their DuckDB SQL over the same nested library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.operators import push
from questmill.operators import export, trees
from questmill.plans.text_queries import NAMESPACE
from questmill.sources.shared import shared_path
from questmill.sources.question_trees import LIBRARY_DOCUMENTS_SQL, LIBRARY_QUESTIONS_SQL, library_documents, library_questions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _uuid(*parts: str) -> str:
    """SQL of the UUID of parts, each a SQL text."""
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({' || chr(31) || '.join(parts)}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h}, 17, 1)), 1)"
        f" || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


_PLAIN = "id number type stem instructions options figures answer_keys answer_text answer_boolean blanks explanation hint marks negative_marks".split()
_RANK = "coalesce(try_cast(nullif(regexp_extract(number, '(\\d+)', 1), '') AS BIGINT), 9007199254740992) AS rn, coalesce(page, 0) AS pg, id AS pid"
_NO_PAIRS = """[]::STRUCT("left" VARCHAR, "right" VARCHAR)[]"""
FLAT_SQL = f"""{LIBRARY_DOCUMENTS_SQL}, {LIBRARY_QUESTIONS_SQL}, seen AS (SELECT * FROM lib WHERE approval_status IN ('reviewed', 'published')),
sets AS (SELECT document_id, {_RANK}, {_uuid("'question-group'", 'id')} AS group_id, passage, section AS outer_section, unnest(sub_questions) AS s, unnest(generate_series(0, len(sub_questions) - 1)) AS pos FROM seen WHERE len(sub_questions) > 0),
e AS (SELECT document_id, {_RANK}, NULL::VARCHAR AS group_id, 0 AS pos, passage, assertion, reason, match_pairs, tags, section, {', '.join(_PLAIN)} FROM seen WHERE len(sub_questions) = 0
  UNION ALL SELECT document_id, rn, pg, pid, group_id, pos, passage, NULL, NULL, {_NO_PAIRS}, []::VARCHAR[], coalesce(s.section, outer_section), {', '.join('s.' + c for c in _PLAIN)} FROM sets),
flat AS (SELECT e.*, row_number() OVER (PARTITION BY document_id ORDER BY rn, pg, pid, pos) AS position, CASE WHEN group_id IS NOT NULL THEN pos + 1 END AS group_order, coalesce(nullif(trim(section), ''), 'General') AS section_name,
  list_filter(figures, lambda f: coalesce(f.svg, f.image_path) IS NOT NULL)[1] AS figure,
  CASE WHEN type = 'mcq' THEN 'mcq_single' WHEN type IN ('true_false', 'fill_blank', 'assertion_reason', 'comprehension') THEN type WHEN type = 'match_the_following' THEN 'matching'
    WHEN type IN ('short_answer', 'long_answer', 'numerical') THEN 'short_answer' WHEN len(options) > 0 THEN 'mcq_single' ELSE 'short_answer' END AS exam_type,
  coalesce(e.marks, d.default_marks, 1.0) AS m, coalesce(e.negative_marks, d.default_negative_marks, 0.0) AS neg, d.kind <> 'past_paper' AS test,
  list_sort(list_distinct(list_filter([trim(t) FOR t IN tags], lambda t: t <> ''))) AS labels, d.subject_id, d.topic_id, d.standard_id, d.stream_id, d.difficulty, d.year, coalesce(d.source, d.exam) AS source, d.created_at, d.updated_at, d.default_marks, d.default_negative_marks
  FROM e JOIN docs d ON d.id = e.document_id),
own AS (SELECT d.*, coalesce(d.total_marks, x.s, 0.0) AS total FROM docs d LEFT JOIN (SELECT document_id, sum(m) AS s FROM flat GROUP BY 1) x ON x.document_id = d.id),
opts AS (SELECT id, answer_keys, unnest(o) AS o, unnest(generate_series(0, len(o) - 1)) AS pos FROM (SELECT id, answer_keys, CASE WHEN type = 'true_false' AND len(options) = 0 AND answer_boolean IS NOT NULL
  THEN [{{'key': 'A', 'text': 'True', 'is_correct': answer_boolean, 'image_path': NULL::VARCHAR}}, {{'key': 'B', 'text': 'False', 'is_correct': NOT answer_boolean, 'image_path': NULL::VARCHAR}}] ELSE options END AS o FROM flat)),
opt AS (SELECT *, {_uuid("'question-option'", 'id', 'o.key', 'pos::VARCHAR')} AS option_id FROM opts),
pairs AS (SELECT id, unnest(match_pairs) AS p, unnest(generate_series(0, len(match_pairs) - 1)) AS pos FROM flat WHERE exam_type = 'matching')"""
_SECTION = _uuid("'test-section'", "document_id", "section_name")
_TEXT = "CASE WHEN type = 'assertion_reason' THEN concat_ws(chr(10), 'Assertion: ' || nullif(assertion, ''), 'Reason: ' || nullif(reason, ''), nullif(stem, '')) ELSE stem END"
_FILLED = "array_to_string(list_filter([trim(b) FOR b IN blanks], lambda b: b <> ''), ', ')"
_item = lambda side: _uuid("'matching-item'", "id", f"'{side}'", "pos::VARCHAR")
EXPORT_SQL = {
    "papers": "SELECT id, title, standard_id, stream_id, total AS total_marks, year, difficulty, created_at, FALSE AS is_published FROM own WHERE kind = 'past_paper'",
    "tests": "SELECT id, title, standard_id, stream_id, total AS total_marks, coalesce(description, notes) AS description, created_at, 'manual' AS creation_mode, FALSE AS is_published FROM own WHERE kind <> 'past_paper'",
    "test_sections": f"SELECT {_SECTION} AS id, document_id AS test_id, section_name AS name, row_number() OVER (PARTITION BY document_id ORDER BY min(position)) AS section_order, coalesce(any_value(default_marks), 1.0) AS default_marks, coalesce(any_value(default_negative_marks), 0.0) AS default_negative_marks FROM flat WHERE test GROUP BY document_id, section_name",
    "test_questions": f"SELECT document_id AS test_id, {_SECTION} AS section_id, id AS question_id, position AS question_order, m AS marks, neg AS negative_marks FROM flat WHERE test",
    "paper_questions": "SELECT document_id AS paper_id, section_name AS section, id AS question_id, position AS question_order, m AS marks, neg AS negative_marks FROM flat WHERE NOT test",
    "questions": "SELECT id, exam_type AS question_type, subject_id, topic_id, standard_id, stream_id, coalesce(difficulty, 'medium') AS difficulty, len(figures) > 0 AS has_diagram, figure.image_path AS diagram_path, figure.svg AS diagram_svg, m AS marks, neg AS negative_marks, year, source, array_to_string(labels, ',') AS tags, TRUE AS is_active, created_at, updated_at FROM flat",
    "question_translations": f"SELECT {_uuid(chr(39) + 'question-translation' + chr(39), 'id', chr(39) + 'en' + chr(39))} AS id, id AS question_id, 'en' AS language_code, CASE WHEN coalesce(trim(instructions), '') <> '' AND NOT contains(t, trim(instructions)) THEN trim(trim(instructions) || chr(10) || chr(10) || t, ' ' || chr(10)) ELSE t END AS question_text, nullif(concat_ws(chr(10) || chr(10), nullif(told, ''), filled, CASE WHEN trim(answer_text) <> '' AND NOT contains(concat_ws(chr(10), told, filled), trim(answer_text)) THEN trim(answer_text) END), '') AS explanation, hint FROM (SELECT *, {_TEXT} AS t, coalesce(trim(explanation), '') AS told, CASE WHEN type = 'fill_blank' AND {_FILLED} <> '' THEN 'Answers: ' || {_FILLED} END AS filled FROM flat)",
    "question_options": "SELECT option_id AS id, id AS question_id, o.key AS option_key, coalesce(o.is_correct, FALSE) OR list_contains(answer_keys, o.key) AS is_correct, pos + 1 AS display_order FROM opt",
    "option_translations": f"SELECT {_uuid(chr(39) + 'option-translation' + chr(39), 'option_id', chr(39) + 'en' + chr(39))} AS id, option_id, 'en' AS language_code, o.text AS option_text, o.image_path AS option_image_path FROM opt",
    "question_tags": "SELECT id AS question_id, unnest(labels) AS tag FROM flat",
    "question_groups": "SELECT group_id AS id, 'comprehension' AS group_type, subject_id, standard_id, figure.image_path AS shared_image_path, figure.svg AS shared_image_svg, created_at FROM flat WHERE group_order = 1",
    "question_group_translations": f"SELECT {_uuid(chr(39) + 'group-translation' + chr(39), 'group_id', chr(39) + 'en' + chr(39))} AS id, group_id, 'en' AS language_code, passage AS shared_text FROM flat WHERE group_order = 1 AND passage <> ''",
    "group_questions": "SELECT group_id, id AS question_id, group_order AS question_order FROM flat WHERE group_id IS NOT NULL",
    "matching_items": f"SELECT {_item('left')} AS id, id AS question_id, 'left' AS side, chr(CAST(65 + pos AS INT)) AS item_key, p.left AS item_text, pos + 1 AS display_order FROM pairs UNION ALL SELECT {_item('right')}, id, 'right', (pos + 1)::VARCHAR, p.right, pos + 1 FROM pairs",
    "matching_pairs": f"SELECT id AS question_id, {_item('left')} AS left_item_id, {_item('right')} AS right_item_id FROM pairs WHERE p.left <> '' AND p.right <> ''",
}


def _exported(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: export.export_tables(library_documents(s, d), library_questions(s, d), NAMESPACE)[name]


for _name, _sql in EXPORT_SQL.items():
    QUERIES[f"gen_export_{_name}"] = _exported(_name)
    ORACLE_SQL[f"gen_export_{_name}"] = f"WITH {FLAT_SQL} {_sql}"


def _counts(s: SparkSession, d: str) -> DataFrame:
    """The export's tables by their rows."""
    out = None
    for name, t in export.export_tables(library_documents(s, d), library_questions(s, d), NAMESPACE).items():
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = n if out is None else out.union(n)
    return out


QUERIES["gen_export_tables"] = _counts
ORACLE_SQL["gen_export_tables"] = f"WITH {FLAT_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS t, count(*) AS n FROM ({q})" for n, q in EXPORT_SQL.items())
QUERIES["gen_flatten_export"] = lambda s, d: export.flattened(export.learner_facing(library_questions(s, d)), NAMESPACE).select("document_id", "position", "id", "group_id", F.col("group_order").cast("long").alias("group_order"), "section", "passage")
ORACLE_SQL["gen_flatten_export"] = f"WITH {FLAT_SQL} SELECT document_id, position, id, group_id, group_order, section, passage FROM flat"
QUERIES["gen_matching_items"] = QUERIES["gen_export_matching_items"]
ORACLE_SQL["gen_matching_items"] = ORACLE_SQL["gen_export_matching_items"]
QUERIES["prj_learner_facing"] = lambda s, d: export.learner_facing(library_questions(s, d)).select("id", "approval_status")
ORACLE_SQL["prj_learner_facing"] = f"WITH {LIBRARY_QUESTIONS_SQL} SELECT id, approval_status FROM lib WHERE approval_status IN ('reviewed', 'published')"


def _of_question(column: Callable[[dict], object]) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        q = library_questions(s, d)
        return q.select("id", column({c: F.col(c) for c in q.columns}).alias("v"))

    return run


_told = "coalesce(trim(explanation), '')"
QUERIES["fn_question_text"] = _of_question(export.question_text)
ORACLE_SQL["fn_question_text"] = f"WITH {LIBRARY_QUESTIONS_SQL}, x AS (SELECT *, CASE WHEN type = 'comprehension' AND passage <> '' THEN concat_ws(chr(10) || chr(10), passage, nullif(stem, '')) ELSE {_TEXT} END AS t FROM lib) SELECT id, CASE WHEN coalesce(trim(instructions), '') <> '' AND NOT contains(t, trim(instructions)) THEN trim(trim(instructions) || chr(10) || chr(10) || t, ' ' || chr(10)) ELSE t END AS v FROM x"
QUERIES["fn_solution_text"] = _of_question(export.solution_text)
ORACLE_SQL["fn_solution_text"] = f"WITH {LIBRARY_QUESTIONS_SQL}, x AS (SELECT *, {_told} AS told, CASE WHEN type = 'fill_blank' AND {_FILLED} <> '' THEN 'Answers: ' || {_FILLED} END AS filled FROM lib) SELECT id, nullif(concat_ws(chr(10) || chr(10), nullif(told, ''), filled, CASE WHEN trim(answer_text) <> '' AND NOT contains(told, trim(answer_text)) THEN trim(answer_text) END), '') AS v FROM x"
QUERIES["gen_learner_options"] = lambda s, d: (q := library_questions(s, d)).select("id", F.posexplode(export.learner_options({c: F.col(c) for c in q.columns})).alias("pos", "o")).select("id", "pos", "o.key", "o.text", "o.is_correct")
ORACLE_SQL["gen_learner_options"] = f"WITH {LIBRARY_QUESTIONS_SQL}, x AS (SELECT id, CASE WHEN type = 'true_false' AND len(options) = 0 AND answer_boolean IS NOT NULL THEN [{{'key': 'A', 'text': 'True', 'is_correct': answer_boolean, 'image_path': NULL::VARCHAR}}, {{'key': 'B', 'text': 'False', 'is_correct': NOT answer_boolean, 'image_path': NULL::VARCHAR}}] ELSE options END AS o FROM lib), y AS (SELECT id, unnest(o) AS o, unnest(generate_series(0, len(o) - 1)) AS pos FROM x) SELECT id, pos, o.key, o.text, o.is_correct FROM y"


# Edits of question trees: the target is one of a question's parts, named by an id.
_target = lambda: F.concat(F.lit("q"), (F.col("document_id").substr(2, 9).cast("long") - 1).cast("string"), F.lit("s1"))
_TARGET_SQL = "('q' || (substr(document_id, 2)::BIGINT - 1) || 's1')"
_IDS = "array_to_string([x.id || ':' || x.stem FOR x IN sub_questions], ',')"


def _tree(s: SparkSession, d: str) -> DataFrame:
    return library_questions(s, d).withColumn("target", _target())


def _shown(q: DataFrame) -> DataFrame:
    return q.select("id", "stem", F.array_join(F.transform("sub_questions", lambda x: F.concat(x["id"], F.lit(":"), x["stem"])), ",").alias("parts"))


QUERIES["tree_find"] = lambda s, d: trees.find(_tree(s, d), F.col("target")).select("document_id", F.col("found.id").alias("id"), F.col("found.stem").alias("stem"))
ORACLE_SQL["tree_find"] = f"WITH {LIBRARY_QUESTIONS_SQL}, t AS (SELECT document_id, id, stem, {_TARGET_SQL} AS target, sub_questions FROM lib), x AS (SELECT document_id, target, unnest(sub_questions) AS s FROM t) SELECT document_id, id, stem FROM t WHERE id = target UNION ALL SELECT document_id, s.id, s.stem FROM x WHERE s.id = target"
QUERIES["tree_update"] = lambda s, d: _shown(trees.update(_tree(s, d), F.col("target"), {"stem": F.lit("edited")}))
ORACLE_SQL["tree_update"] = f"WITH {LIBRARY_QUESTIONS_SQL}, t AS (SELECT *, {_TARGET_SQL} AS target FROM lib) SELECT id, CASE WHEN id = target THEN 'edited' ELSE stem END AS stem, array_to_string([x.id || ':' || CASE WHEN x.id = target THEN 'edited' ELSE x.stem END FOR x IN sub_questions], ',') AS parts FROM t"
QUERIES["tree_remove"] = lambda s, d: _shown(trees.remove(_tree(s, d), F.col("target")))
ORACLE_SQL["tree_remove"] = f"WITH {LIBRARY_QUESTIONS_SQL}, t AS (SELECT *, {_TARGET_SQL} AS target FROM lib) SELECT id, stem, array_to_string([x.id || ':' || x.stem FOR x IN sub_questions IF x.id <> target], ',') AS parts FROM t WHERE id <> target"
_images = "array_to_string(list_transform({0}, lambda f: coalesce(f.image_path, '-')), ',')"
_count = lambda q: q.select("id", *[F.array_join(F.transform(c, lambda f: F.coalesce(f["image_path"], F.lit("-"))), ",").alias(c) for c in ("figures", "options")], F.coalesce(F.array_join(F.transform(F.flatten(F.transform("sub_questions", lambda x: x["figures"])), lambda f: F.coalesce(f["image_path"], F.lit("-"))), ","), F.lit("")).alias("parts"))
_path = lambda: F.concat(F.lit("img/q"), F.col("id").substr(2, 9), F.lit("-1.png"))
QUERIES["tree_detach_image"] = lambda s, d: _count(trees.detach_image(library_questions(s, d).withColumn("path", F.when(F.col("id").endswith("0"), F.concat(F.lit("img/o"), F.col("id").substr(2, 9), F.lit(".png"))).otherwise(_path())), F.col("path")))
ORACLE_SQL["tree_detach_image"] = f"""WITH {LIBRARY_QUESTIONS_SQL}, t AS (SELECT *, CASE WHEN id LIKE '%0' THEN 'img/o' || substr(id, 2) || '.png' ELSE 'img/q' || substr(id, 2) || '-1.png' END AS path FROM lib)
SELECT id, {_images.format("list_filter(figures, lambda f: f.image_path IS DISTINCT FROM path)")} AS figures, array_to_string([CASE WHEN o.image_path = path THEN '-' ELSE coalesce(o.image_path, '-') END FOR o IN options], ',') AS options,
{_images.format("list_filter(flatten([x.figures FOR x IN sub_questions]), lambda f: f.image_path IS DISTINCT FROM path)")} AS parts FROM t"""
QUERIES["tree_remove_option"] = lambda s, d: trees.remove_option(library_questions(s, d), F.lit("B")).select("id", F.array_join(F.transform("options", lambda o: F.concat(o["key"], o["text"])), ",").alias("options"), F.array_join("answer_keys", ",").alias("answer_keys"))
ORACLE_SQL["tree_remove_option"] = f"WITH {LIBRARY_QUESTIONS_SQL} SELECT id, array_to_string([o.key || o.text FOR o IN options IF o.key <> 'B'], ',') AS options, array_to_string([k FOR k IN answer_keys IF k <> 'B'], ',') AS answer_keys FROM lib"


# Units of a push, from the export's tables as they are written; the remote side lacks some rows and has others in Hindi.
def _export_written(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The export's tables as a push reads them: written first, as each serves several joins."""
    root = shared_path(s, "export")
    for name, t in export.export_tables(library_documents(s, d), library_questions(s, d), NAMESPACE).items():
        t.write.parquet(f"{root}/{name}")
    return {name: s.read.parquet(f"{root}/{name}") for name in EXPORT_SQL}


def _push_unit(s: SparkSession, d: str) -> DataFrame:
    units = push.checked(push.push_units(_export_written(s, d)))
    return units.select("question_id", "link.kind", "counts.*", F.col("group.id").alias("group_id"), F.col("question.diagram_path").isNull().alias("bare"))


def _presence(s: SparkSession, d: str) -> DataFrame:
    tables = _export_written(s, d)
    twice = lambda t: t.union(t.withColumn("language_code", F.lit("hi")))
    remote = tables | {
        "question_translations": twice(tables["question_translations"]), "question_options": tables["question_options"].where("display_order != 2"),
        "option_translations": twice(tables["option_translations"].where("option_text != 'a'")), "question_tags": tables["question_tags"].where("tag != 'age'"),
        "paper_questions": tables["paper_questions"].where("question_order % 3 > 0"), "question_group_translations": twice(tables["question_group_translations"]),
    }
    return push.presence(push.push_units(tables), remote)


_PUSH_SQL = f"WITH {FLAT_SQL}, " + ", ".join(f"x_{name} AS ({sql})" for name, sql in EXPORT_SQL.items())
_N = lambda name, where="true", alias="n": f"(SELECT question_id, count(*) AS {alias} FROM x_{name} WHERE {where} GROUP BY question_id)"
QUERIES["jn_push_unit"] = _push_unit
ORACLE_SQL["jn_push_unit"] = f"""{_PUSH_SQL},
ot AS (SELECT o.question_id, count(*) AS n FROM x_option_translations t JOIN x_question_options o ON o.id = t.option_id GROUP BY o.question_id),
gt AS (SELECT g.question_id, g.group_id, count(t.group_id) > 0 AS said FROM x_group_questions g LEFT JOIN x_question_group_translations t ON t.group_id = g.group_id GROUP BY ALL)
SELECT q.id AS question_id, CASE WHEN EXISTS (SELECT 1 FROM x_paper_questions p WHERE p.question_id = q.id) THEN 'paper' ELSE 'test' END AS kind, 1 AS translations,
  coalesce(o.n, 0)::INT AS options, coalesce(ot.n, 0)::INT AS option_translations, coalesce(t.n, 0)::INT AS tags, coalesce(mi.n, 0)::INT AS matching_items, coalesce(mp.n, 0)::INT AS matching_pairs,
  CASE WHEN gt.group_id IS NULL THEN 0 ELSE 1 END AS group_links, CASE WHEN coalesce(gt.said, false) THEN 1 ELSE 0 END AS group_translations, gt.group_id, true AS bare
FROM x_questions q LEFT JOIN {_N("question_options")} o ON o.question_id = q.id LEFT JOIN ot ON ot.question_id = q.id LEFT JOIN {_N("question_tags")} t ON t.question_id = q.id
LEFT JOIN {_N("matching_items")} mi ON mi.question_id = q.id LEFT JOIN {_N("matching_pairs")} mp ON mp.question_id = q.id LEFT JOIN gt ON gt.question_id = q.id"""
QUERIES["jn_presence"] = _presence
ORACLE_SQL["jn_presence"] = f"""{_PUSH_SQL},
ot AS (SELECT o.question_id, count(*) AS n FROM x_option_translations t JOIN x_question_options o ON o.id = t.option_id WHERE t.option_text <> 'a' GROUP BY o.question_id),
gt AS (SELECT g.question_id, count(t.group_id) AS n FROM x_group_questions g LEFT JOIN x_question_group_translations t ON t.group_id = g.group_id GROUP BY g.question_id),
l AS (SELECT question_id FROM x_paper_questions WHERE question_order % 3 > 0 UNION SELECT question_id FROM x_test_questions)
SELECT q.id AS question_id, q.id IN (SELECT question_id FROM l) AS linked, 1 AS translations, coalesce(o.n, 0) AS options, coalesce(ot.n, 0) AS option_translations, coalesce(t.n, 0) AS tags,
  coalesce(mi.n, 0) AS matching_items, coalesce(mp.n, 0) AS matching_pairs, coalesce(g.n, 0) AS group_links, coalesce(gt.n, 0) AS group_translations
FROM x_questions q LEFT JOIN {_N("question_options", "display_order <> 2")} o ON o.question_id = q.id LEFT JOIN ot ON ot.question_id = q.id LEFT JOIN {_N("question_tags", "tag <> 'age'")} t ON t.question_id = q.id
LEFT JOIN {_N("matching_items")} mi ON mi.question_id = q.id LEFT JOIN {_N("matching_pairs")} mp ON mp.question_id = q.id LEFT JOIN {_N("group_questions")} g ON g.question_id = q.id LEFT JOIN gt ON gt.question_id = q.id"""
