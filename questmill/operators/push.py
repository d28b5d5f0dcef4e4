"""What of an export goes to the remote library: one unit a question with the rows of ten child tables, and what of it is there already."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGLISH = "en"
#: Columns with local image paths, which never go out; fixed values.
LOCAL = {
    "questions": ["diagram_path"], "question_translations": ["explanation_diagram_path"], "option_translations": ["option_image_path"], "question_groups": ["shared_image_path"],
}
FIELDS = ("translations", "options", "option_translations", "tags", "matching_items", "matching_pairs", "group_links", "group_translations")


def outward(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without local image paths."""
    bare = lambda name, t: t.withColumns({c: F.lit(None).cast(t.schema[c].dataType) for c in LOCAL.get(name, []) if c in t.columns})
    return {name: bare(name, t) for name, t in tables.items()}


def _rows(table: DataFrame, key: str, name: str) -> DataFrame:
    """All rows of a key as a sorted array of structs."""
    return table.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias(name))


def _first(table: DataFrame, key: str, name: str) -> DataFrame:
    return table.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*table.columns)).alias(name))


def push_units(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row a question: question_id, its rows as structs and arrays of structs, counts, content_hash and missing.

    tables: the export's tables by name. Rows: question, translation, link (to its
    paper or test), options, option_translations, tags, matching_items,
    matching_pairs, group, group_translation, group_link. missing says what a unit
    cannot go without, its English text or its link, and is null if it has both. A
    question's rows are one group, bounded by the question.
    """
    t = outward(tables)
    options = t["question_options"]
    translated = t["option_translations"].join(options.select(F.col("id").alias("option_id"), F.col("question_id").alias("_q")), "option_id")
    links = t["paper_questions"].select(F.lit("paper").alias("kind"), "question_id", F.to_json(F.struct(*t["paper_questions"].columns)).alias("row"))
    links = links.union(t["test_questions"].select(F.lit("test"), "question_id", F.to_json(F.struct(*t["test_questions"].columns))))
    grouped = _first(t["group_questions"], "question_id", "group_link")
    groups = t["question_groups"].select(F.col("id").alias("_group"), F.struct(*t["question_groups"].columns).alias("group"))
    said = _first(t["question_group_translations"], "group_id", "group_translation").withColumnRenamed("_key", "_group")
    grouped = grouped.withColumn("_group", F.col("group_link.group_id")).join(groups, "_group", "left").join(said, "_group", "left").drop("_group")

    units = t["questions"].select(F.col("id").alias("_key"), F.struct(*t["questions"].columns).alias("question"))
    for part in (
        _first(t["question_translations"], "question_id", "translation"), _first(links, "question_id", "link"), _rows(options, "question_id", "options"),
        _rows(translated, "_q", "option_translations"), _rows(t["question_tags"], "question_id", "tags"), _rows(t["matching_items"], "question_id", "matching_items"),
        _rows(t["matching_pairs"], "question_id", "matching_pairs"), grouped,
    ):
        units = units.join(part, "_key", "left")
    held = [c for c in units.columns if c != "_key"]
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    one = lambda name: F.col(name).isNotNull().cast("int")
    counts = {
        "translations": one("translation"), **{n: size(n) for n in ("options", "option_translations", "tags", "matching_items", "matching_pairs")},
        "group_links": one("group_link"), "group_translations": one("group_translation"),
    }
    missing = F.when(F.col("translation").isNull(), "English text").when(F.col("link").isNull(), "link")
    return units.select(
        F.col("_key").alias("question_id"), *held, F.struct(*[c.alias(k) for k, c in counts.items()]).alias("counts"),
        F.sha1(F.to_json(F.struct(*sorted(held))).cast("binary")).alias("content_hash"), missing.alias("missing"),
    )


def checked(units: DataFrame) -> DataFrame:
    """The units; the first that misses something ends the job."""
    error = F.concat(F.lit("question "), F.col("question_id"), F.lit(" is without its "), F.col("missing"))
    return units.withColumn("question_id", F.when(F.col("missing").isNull(), F.col("question_id")).otherwise(F.raise_error(error)))


def presence(units: DataFrame, remote: Mapping[str, DataFrame]) -> DataFrame:
    """How many rows of each unit's kinds the remote tables hold: question_id, linked, and the eight FIELDS.

    Translations count in English only. Those of options belong to the unit whose
    option they name, those of a group to every unit in it. Everything is counted in
    one pass over pairs of question and field.
    """
    english = F.col("language_code") == ENGLISH

    def of(name: str, field: str, keep: Column | None = None) -> DataFrame:
        rows = remote[name] if keep is None else remote[name].where(keep)
        return rows.select("question_id", F.lit(field).alias("field"))

    own = units.select("question_id", F.explode(F.transform("options", lambda o: o["id"])).alias("option_id"))
    in_group = units.where("group is not null").select("question_id", F.col("group.id").alias("group_id"))
    pairs = [
        of("question_translations", "translations", english), of("question_options", "options"), of("question_tags", "tags"), of("matching_items", "matching_items"),
        of("matching_pairs", "matching_pairs"), of("group_questions", "group_links"), of("paper_questions", "linked"), of("test_questions", "linked"),
        remote["option_translations"].where(english).join(own, "option_id").select("question_id", F.lit("option_translations").alias("field")),
        remote["question_group_translations"].where(english).join(in_group, "group_id").select("question_id", F.lit("group_translations").alias("field")),
    ]
    seen = pairs[0]
    for more in pairs[1:]:
        seen = seen.union(more)
    counted = seen.groupBy("question_id").pivot("field", ["linked", *FIELDS]).count()
    found = units.select("question_id").join(counted, "question_id", "left")
    return found.select("question_id", (F.coalesce("linked", F.lit(0)) > 0).alias("linked"), *[F.coalesce(f, F.lit(0)).alias(f) for f in FIELDS])
