"""The library's tables over the test tables, and question-like samples for the text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt by its key, for much work on each row: a file with one row group is read by one task."""
    return table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def question_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denormalised question index: one row a question, from events."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("question_id"),
        F.col("user_id").alias("document_id"),
        F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("event_type")).alias("skill_type"),
        F.when(k % 5 == 0, None).otherwise((k % 5).cast("string")).alias("pattern_subtype"),
        F.when(k % 7 == 0, None).otherwise(k % 3 + 5).alias("standard_id"),
        (F.col("user_id") % 4).cast("int").alias("subject_id"),
        F.when(F.col("user_id") % 3 == 0, None).otherwise((F.col("user_id") % 2).cast("int")).alias("stream_id"),
        F.when(F.col("event_id") % 4 == 0, "paper").when(F.col("event_id") % 4 == 1, "test").otherwise("mock").alias("kind"),
        (F.col("value") < 100).cast("int").alias("is_mock"),
        (k % 2).alias("approved"),
        F.col("value").alias("marks"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("created_at"),
    )


QUESTION_INDEX_SQL = """
qi AS (SELECT event_id AS question_id, user_id AS document_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS skill_type,
  CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k % 5 AS VARCHAR) END AS pattern_subtype, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 + 5 END AS standard_id,
  CAST(user_id % 4 AS INT) AS subject_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 2 AS INT) END AS stream_id,
  CASE event_id % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'test' ELSE 'mock' END AS kind, CAST(value < 100 AS INT) AS is_mock, k % 2 AS approved,
  value AS marks, strftime(ts, '%Y-%m-%d %H:%M') AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""

#: number, kind, stem, instructions, figures, options: wordings that the rules tell apart.
SAMPLES: list[tuple[str | None, str, str, str | None, int, list[str]]] = [
    ("1", "mcq", "Find the next number: 4, 8, 12, 16, ...", None, 0, ["18", "20", "22", "24"]),
    ("02.", "mcq", "What comes next: 3, 9, 27, 81; ?", "Directions (1-5): Choose the right term.", 0, ["90", "162", "243", "270"]),
    ("3", "mcq", "Which water image fits the card?", None, 1, ["a", "b", "c", "d"]),
    ("4", "diagram", "Fig. 3", None, 1, []),
    ("5", "mcq", "A dealer bought a pen for 7 45 and sold it at a profit. Find the gain.", None, 0, ["7s", "R5", "9", "10"]),
    ("Q. 6", "true_false", "State whether the sum of two odd numbers is even.", None, 0, []),
    ("7a", "mcq", "Pick the word opposite in meaning to brave.", "INSTRUCTIONS (Q. Nos. 7-9) - Read with care.", 0, ["timid", "bold", "calm", "rash"]),
    ("8", "fill_blank", "The bird ____ in the tree.", None, 0, []),
    ("9", "short_answer", "Calculate 3/4 of 60 and simplify.", None, 0, []),
    ("10", "mcq", "The cost is 7.50 rupees (A) 3,5 (B) 2'7 (C) 4 (D) 6", None, 0, []),
    (None, "mcq", "In which direction is the sun setting", "This is what you must see", 0, ["east", "west"]),
    ("12", "mcq", "He is the brother of my aunt.", None, 0, ["uncle", "cousin", "son", "none"]),
    ("13", "mcq", "Syllogism: all cats are dogs; what definitely follows?", None, 0, ["i", "ii", "both", "none"]),
    ("14", "mcq", "In a code language SUN is coded as TVO", "Directions: Study the code", 0, ["x", "y", "z", "w"]),
    ("15", "numerical", "Find the average of 12, 18 and 24", None, 0, []),
    ("16", "mcq", "Complete the pattern shown below", None, 2, ["1", "2", "3", "4"]),
    ("17", "mcq", "Assertion: ice floats. Reason: it is light.", None, 0, ["A", "B", "C", "D"]),
    ("18", "match_the_following", "Match the following rivers and states", None, 0, []),
    ("19", "mcq", "Tick the noun", None, 0, ["noun", "verb", "adverb", "none"]),
    ("20", "mcq", "What is the compound interest on 900 at 10 percent?", None, 0, ["$90", "$189", "$$", "$1"]),
    ("21", "mcq", "A clock shows the minute hand at six", None, 0, ["1", "2"]),
    ("22", "mcq", "Rahul is sitting to the left of Meena", None, 0, ["true", "false"]),
    ("23", "long_answer", "Explain " + "how a seed becomes a plant and why light matters " * 4, None, 0, []),
    ("24", "mcq", "Who wrote the national song?", "section B", 0, ["p", "q", "r", "s"]),
    ("25", "mcq", "brisk", None, 0, ["slow", "quick", "dull", "weak"]),
    ("26", "mcq", "the / cat / on / mat / sat", None, 0, ["1", "2"]),
    ("27", "mcq", "The 5th, 10th and 15th terms: 2, 5, 11, 23", None, 0, ["30", "47"]),
    ("28", "mcq", "Area of a triangle with sides 3, 4", None, 0, ["6", "7", "8", "9"]),
    ("29", "mcq", "[skill:ranking] Tom stands seventh", None, 0, ["7", "8"]),
    ("30", "mcq", "How many Mondays are there in May?", "DIRECTIONS (30 to 33) Look at the month", 0, ["4", "5"]),
    ("31", "mcq", "Largest 4 digit number", None, 0, ["9999", "1000"]),
    ("32", "mcq", "One who writes plays", None, 0, ["poet", "dramatist"]),
    ("33", "short_answer", "3 + 4 = ? 12 + 9 + 8 + 7", None, 0, []),
    ("34", "mcq", "simple words only (a) ab (b) cd", None, 0, []),
    ("35", "short_answer", "half-", None, 0, []),
    ("", "short_answer", "Why", None, 0, []),
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question a document: its sample's fields, and the document's whole text as passage."""
    fields = "k long, number string, kind string, stem string, instructions string, figures int, options array<string>"
    samples = spark.createDataFrame([(k, *row) for k, row in enumerate(SAMPLES)], fields)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("passage"), (F.col("doc_id") % len(SAMPLES)).alias("k"))
    return docs.join(F.broadcast(samples), "k")


def sql_text(value: object) -> str:
    """A value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(map(sql_text, value)) + "]::VARCHAR[]"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


QUESTIONS_SQL = (
    "q AS (SELECT d.doc_id, d.text AS passage, s.* FROM documents d JOIN (VALUES "
    + ", ".join("(" + ", ".join(map(sql_text, (k, *row))) + ")" for k, row in enumerate(SAMPLES))
    + f") s(k, number, kind, stem, instructions, figures, options) ON d.doc_id % {len(SAMPLES)} = s.k)"
)


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document, with their place."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


PAGE_LINES_SQL = "lines AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS ord, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
