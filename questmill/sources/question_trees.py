"""A library of documents with nested questions, over the test tables: sample wordings with options, figures, pairs and sub-questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.sources.driver_tables import QUESTIONS_SQL, questions, table

#: Documents of the library; a question belongs to the one its id names.
DOCUMENTS = 40


def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: what its questions fall back on."""
    part = table(spark, sf_dir, "part").where(F.col("p_partkey") <= DOCUMENTS)
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("past_paper"), F.lit("practice_test"), F.lit("ai_mock")), (k % 3 + 1).cast("int"))
    return part.select(
        F.concat(F.lit("d"), k.cast("string")).alias("id"), kind.alias("kind"), F.col("p_name").alias("title"), F.col("p_type").alias("notes"), F.lit(None).cast("string").alias("description"),
        (k % 12 + 1).alias("standard_id"), F.when(k % 2 == 0, k % 4).alias("stream_id"), (k % 5).alias("subject_id"), F.lit(None).cast("long").alias("topic_id"),
        F.when(k % 4 == 0, F.lit(100.0)).alias("total_marks"), F.when(k % 5 == 0, F.lit(2.0)).alias("default_marks"), F.when(k % 6 == 0, F.lit(0.25)).alias("default_negative_marks"),
        (F.lit(2000) + k % 25).alias("year"), F.when(k % 3 == 0, F.lit("board")).alias("source"), F.lit("exam").alias("exam"), F.when(k % 2 == 1, F.lit("hard")).alias("difficulty"),
        F.lit("2024-01-01").alias("created_at"), F.lit("2024-02-01").alias("updated_at"),
    )


LIBRARY_DOCUMENTS_SQL = f"""docs AS (SELECT 'd' || k AS id, ['past_paper', 'practice_test', 'ai_mock'][k % 3 + 1] AS kind, p_name AS title, p_type AS notes, NULL::VARCHAR AS description,
  k % 12 + 1 AS standard_id, CASE WHEN k % 2 = 0 THEN k % 4 END AS stream_id, k % 5 AS subject_id, NULL::BIGINT AS topic_id, CASE WHEN k % 4 = 0 THEN 100.0::DOUBLE END AS total_marks,
  CASE WHEN k % 5 = 0 THEN 2.0::DOUBLE END AS default_marks, CASE WHEN k % 6 = 0 THEN 0.25::DOUBLE END AS default_negative_marks, 2000 + k % 25 AS year, CASE WHEN k % 3 = 0 THEN 'board' END AS source,
  'exam' AS exam, CASE WHEN k % 2 = 1 THEN 'hard' END AS difficulty, '2024-01-01' AS created_at, '2024-02-01' AS updated_at FROM (SELECT *, p_partkey AS k FROM part WHERE p_partkey <= {DOCUMENTS}))"""


def _leaf(id_: Column, kind: Column, stem: Column, number: Column) -> list[Column]:
    """The fields that questions and their sub-questions share."""
    k = F.col("doc_id")
    options = F.transform(
        "options",
        lambda o, i: F.struct(F.char(i + 65).alias("key"), o.alias("text"), F.when(k % 3 == 0, i == k % 4).alias("is_correct"), F.when((k % 9 == 0) & (i == 1), F.concat(F.lit("img/o"), k.cast("string"), F.lit(".png"))).alias("image_path")),
    )
    figures = F.transform(
        F.when(F.col("figures") > 0, F.sequence(F.lit(1), F.greatest("figures", F.lit(1)))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat(F.lit("fig "), i.cast("string")).alias("description"), F.when(k % 2 == 0, F.concat(F.lit("img/q"), k.cast("string"), F.lit("-"), i.cast("string"), F.lit(".png"))).alias("image_path"), F.when(k % 4 == 1, F.lit("<svg/>")).alias("svg")),
    )
    return [
        id_.alias("id"), number.alias("number"), kind.alias("type"), stem.alias("stem"), F.col("instructions").alias("instructions"), options.alias("options"), figures.alias("figures"),
        F.when(k % 3 == 1, F.array(F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("answer_keys"), F.when(k % 5 == 0, F.lit(" because ")).alias("answer_text"),
        F.when(k % 4 == 0, k % 8 == 0).alias("answer_boolean"), F.when(k % 6 == 1, F.array(F.lit("one "), F.lit(""), F.lit("two"))).otherwise(F.array().cast("array<string>")).alias("blanks"),
        F.when(k % 5 < 2, F.lit("It is so because of it.")).alias("explanation"), F.when(k % 7 == 0, F.lit("look")).alias("hint"), F.when(k % 3 == 0, (k % 5).cast("double")).alias("marks"),
        F.when(k % 10 == 0, F.lit(1.0)).alias("negative_marks"), F.when(k % 4 == 0, F.lit(" Part A ")).when(k % 4 == 1, F.lit("Part B")).alias("section"),
    ]


def library_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a question: its fields, and sub-questions for every seventh."""
    q = questions(spark, sf_dir)
    k = F.col("doc_id")
    sub = lambda i: F.struct(*_leaf(F.concat(F.lit(f"q"), k.cast("string"), F.lit(f"s{i}")), F.lit("mcq" if i == 1 else "short_answer"), F.concat(F.lit(f"Part {i}: "), F.col("stem")), F.lit(str(i))))
    subs = F.when(k % 7 == 3, F.array(sub(1), sub(2)))
    pairs = F.when(F.col("kind") == "match_the_following", F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in (("Ganga", "north"), ("Kaveri", "south"), ("Tapi", ""))]))
    return q.select(
        F.concat(F.lit("d"), (k % DOCUMENTS + 1).cast("string")).alias("document_id"),
        *_leaf(F.concat(F.lit("q"), k.cast("string")), F.when(k % 7 == 3, "comprehension").otherwise(F.col("kind")), F.col("stem"), F.col("number")),
        F.when(k % 7 == 3, F.concat(F.lit("Passage "), k.cast("string"))).alias("passage"), F.when(F.col("kind") == "mcq", F.lit(None)).otherwise(F.lit("ice floats")).alias("assertion"), F.lit(None).cast("string").alias("reason"),
        F.coalesce(subs, F.array().cast(subs_type())).alias("sub_questions"), F.coalesce(pairs, F.array().cast("array<struct<left:string,right:string>>")).alias("match_pairs"),
        F.array(F.lit(" algebra "), F.when(k % 2 == 0, F.lit("age")).otherwise(F.lit("algebra")), F.lit("")).alias("tags"), (k % 6).cast("int").alias("page"),
        F.element_at(F.array(*map(F.lit, ("draft", "generated", "reviewed", "published", "rejected"))), (k % 5 + 1).cast("int")).alias("approval_status"),
    )


def subs_type() -> str:
    """The type of sub_questions."""
    option = "struct<key:string,text:string,is_correct:boolean,image_path:string>"
    return (
        f"array<struct<id:string,number:string,type:string,stem:string,instructions:string,options:array<{option}>,figures:array<struct<description:string,image_path:string,svg:string>>,"
        "answer_keys:array<string>,answer_text:string,answer_boolean:boolean,blanks:array<string>,explanation:string,hint:string,marks:double,negative_marks:double,section:string>>"
    )


def _leaf_sql(id_: str, kind: str, stem: str, number: str, as_struct: bool) -> str:
    fields = {
        "id": id_, "number": number, "type": kind, "stem": stem, "instructions": "instructions",
        "options": "[{'key': chr(CAST(64 + i AS INT)), 'text': options[i], 'is_correct': CASE WHEN doc_id % 3 = 0 THEN i - 1 = doc_id % 4 END, 'image_path': CASE WHEN doc_id % 9 = 0 AND i = 2 THEN 'img/o' || doc_id || '.png' END} FOR i IN generate_series(1, len(options))]",
        "figures": "[{'description': 'fig ' || i, 'image_path': CASE WHEN doc_id % 2 = 0 THEN 'img/q' || doc_id || '-' || i || '.png' END, 'svg': CASE WHEN doc_id % 4 = 1 THEN '<svg/>' END} FOR i IN generate_series(1, figures)]",
        "answer_keys": "CASE WHEN doc_id % 3 = 1 THEN ['B'] ELSE []::VARCHAR[] END", "answer_text": "CASE WHEN doc_id % 5 = 0 THEN ' because ' END", "answer_boolean": "CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 = 0 END",
        "blanks": "CASE WHEN doc_id % 6 = 1 THEN ['one ', '', 'two'] ELSE []::VARCHAR[] END", "explanation": "CASE WHEN doc_id % 5 < 2 THEN 'It is so because of it.' END", "hint": "CASE WHEN doc_id % 7 = 0 THEN 'look' END",
        "marks": "CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5)::DOUBLE END", "negative_marks": "CASE WHEN doc_id % 10 = 0 THEN 1.0::DOUBLE END", "section": "CASE WHEN doc_id % 4 = 0 THEN ' Part A ' WHEN doc_id % 4 = 1 THEN 'Part B' END",
    }
    if as_struct:
        return "{" + ", ".join(f"'{n}': {v}" for n, v in fields.items()) + "}"
    return ", ".join(f"{v} AS {n}" for n, v in fields.items())


_SUBS = [_leaf_sql(f"'q' || doc_id || 's{i}'", f"'{'mcq' if i == 1 else 'short_answer'}'", f"'Part {i}: ' || stem", f"'{i}'", True) for i in (1, 2)]
LIBRARY_QUESTIONS_SQL = f"""{QUESTIONS_SQL}, lib AS (SELECT 'd' || (doc_id % {DOCUMENTS} + 1) AS document_id,
  {_leaf_sql("'q' || doc_id", "CASE WHEN doc_id % 7 = 3 THEN 'comprehension' ELSE kind END", "stem", "number", False)},
  CASE WHEN doc_id % 7 = 3 THEN 'Passage ' || doc_id END AS passage, CASE WHEN kind <> 'mcq' THEN 'ice floats' END AS assertion, NULL::VARCHAR AS reason,
  CASE WHEN doc_id % 7 = 3 THEN [{_SUBS[0]}, {_SUBS[1]}] ELSE [] END AS sub_questions,
  CASE WHEN kind = 'match_the_following' THEN [{{'left': 'Ganga', 'right': 'north'}}, {{'left': 'Kaveri', 'right': 'south'}}, {{'left': 'Tapi', 'right': ''}}] ELSE [] END AS match_pairs,
  [' algebra ', CASE WHEN doc_id % 2 = 0 THEN 'age' ELSE 'algebra' END, ''] AS tags, CAST(doc_id % 6 AS INT) AS page, ['draft', 'generated', 'reviewed', 'published', 'rejected'][doc_id % 5 + 1] AS approval_status FROM q)"""
