"""The relational export of documents with nested questions: fifteen tables, each a projection of one flattened table.

documents: id, kind, title, notes, ids, marks and dates of each document.
questions: one row a question with document_id, its fields, and arrays of options,
figures, match_pairs, tags and sub_questions, whose elements have the fields of a
question without further nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questmill.functions.ids import stable_uuid
from questmill.functions.rules import export_type
from questmill.functions.text import printed_order, trimmed

#: States in which learners may see a question; fixed values.
LEARNER_STATES = ["reviewed", "published"]


def learner_facing(questions: DataFrame) -> DataFrame:
    """Reviewed and published questions."""
    return questions.where(F.col("approval_status").isin(LEARNER_STATES))


def question_text(q: dict[str, Column]) -> Column:
    """What the learner reads: assertion and reason or passage before the stem, and instructions that it does not hold yet."""
    labelled = [F.concat(F.lit(f"{name.capitalize()}: "), F.nullif(q[name], F.lit(""))) for name in ("assertion", "reason")]
    paired = F.concat_ws("\n", *labelled, F.nullif(q["stem"], F.lit("")))
    text = F.when((q["type"] == "assertion_reason") & (paired != ""), paired).when(
        (q["type"] == "comprehension") & (F.coalesce(q["passage"], F.lit("")) != ""), F.concat_ws("\n\n", q["passage"], F.nullif(q["stem"], F.lit("")))
    )
    text = F.coalesce(text, q["stem"])
    above = trimmed(F.coalesce(q["instructions"], F.lit("")))
    return F.when((above != "") & ~F.contains(text, above), trimmed(F.concat(above, F.lit("\n\n"), text))).otherwise(text)


def solution_text(q: dict[str, Column]) -> Column:
    """The explanation with the answers it does not hold yet; null if there is nothing."""
    told = trimmed(F.coalesce(q["explanation"], F.lit("")))
    filled = F.array_join(F.filter(F.transform(q["blanks"], trimmed), lambda b: b != ""), ", ")
    blanks = F.when((q["type"] == "fill_blank") & (filled != "") & ~F.contains(told, filled), F.concat(F.lit("Answers: "), filled))
    both = F.concat_ws("\n", told, blanks)
    written = trimmed(F.coalesce(q["answer_text"], F.lit("")))
    own = F.when((written != "") & ~F.contains(both, written), written)
    return F.nullif(F.concat_ws("\n\n", F.nullif(told, F.lit("")), blanks, own), F.lit(""))


def learner_options(q: dict[str, Column]) -> Column:
    """The options, and for a bare true-or-false question with an answer its two."""
    option = lambda key, text, right: F.struct(F.lit(key).alias("key"), F.lit(text).alias("text"), right.alias("is_correct"), F.lit(None).cast("string").alias("image_path"))
    made = F.array(option("A", "True", q["answer_boolean"]), option("B", "False", ~q["answer_boolean"]))
    return F.when((q["type"] == "true_false") & (F.size(q["options"]) == 0) & q["answer_boolean"].isNotNull(), made).otherwise(q["options"])


def flattened(questions: DataFrame, namespace: str) -> DataFrame:
    """Questions in printed order; a comprehension with sub-questions gives way to these, in a group.

    Adds position (from 1 in its document), group_id and group_order (from 1).
    Order is the printed number, then the page, then the id.
    """
    leaf = [f.name for f in questions.schema["sub_questions"].dataType.elementType.fields]
    grouped = (F.col("type") == "comprehension") & (F.size("sub_questions") > 0)
    own = F.struct(*[F.col(c).alias(c) for c in leaf])
    rank = F.struct(F.coalesce(printed_order(F.col("number")), F.lit(1 << 53)).alias("n"), F.coalesce("page", F.lit(0)).alias("page"), F.col("id").alias("id"))
    each = questions.select(
        "document_id", rank.alias("rank"), F.when(grouped, stable_uuid(namespace, F.lit("question-group"), F.col("id"))).alias("group_id"), "passage", "assertion", "reason", "match_pairs", "tags",
        F.col("section").alias("_section"), grouped.alias("_grouped"), F.posexplode(F.when(grouped, F.col("sub_questions")).otherwise(F.array(own))).alias("_at", "q"),
    )
    empty = lambda c: F.when(F.col("_grouped"), F.array().cast(questions.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    alone = lambda c: F.when(~F.col("_grouped"), F.col(c)).alias(c)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("rank", "_at"))
    return each.select(
        "document_id", place.alias("position"), "group_id", F.when(F.col("_grouped"), F.col("_at") + 1).alias("group_order"), "passage", alone("assertion"), alone("reason"), empty("match_pairs"), empty("tags"),
        *[F.coalesce("q.section", "_section").alias("section") if c == "section" else F.col(f"q.{c}").alias(c) for c in leaf],
    )


def export_tables(documents: DataFrame, questions: DataFrame, namespace: str) -> dict[str, DataFrame]:
    """The tables of the export by name; only questions that learners may see go out. Ids follow from the questions' ids."""
    uuid = lambda *parts: stable_uuid(namespace, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    is_test = F.col("kind").isin("practice_test", "ai_mock")
    flat = flattened(learner_facing(questions), namespace)
    meta = documents.select(*[F.col(c).alias(f"d_{c}") for c in documents.columns])
    flat = flat.join(meta, F.col("document_id") == F.col("d_id"))
    named = F.coalesce(F.nullif(trimmed(F.col("section")), F.lit("")), F.lit("General"))
    figure = F.get(F.filter("figures", lambda f: F.coalesce(f["svg"], f["image_path"]).isNotNull()), 0)
    flat = flat.withColumns(
        {
            "section_name": named, "figure": figure, "exam_type": export_type(F.col("type"), F.col("options")), "marks_": F.coalesce("marks", "d_default_marks", F.lit(1.0)),
            "negative_": F.coalesce("negative_marks", "d_default_negative_marks", F.lit(0.0)), "test": F.col("d_kind").isin("practice_test", "ai_mock"),
            "labels": F.array_sort(F.array_distinct(F.filter(F.transform("tags", trimmed), lambda t: t != ""))),
        }
    )
    fields = {c: F.col(c) for c in flat.columns}
    total = flat.groupBy("document_id").agg(F.sum("marks_").alias("summed"))
    own = documents.join(total, F.col("id") == F.col("document_id"), "left").withColumn("total", F.coalesce("total_marks", "summed", F.lit(0.0)))
    container = ["id", "title", "standard_id", "stream_id", F.col("total").alias("total_marks")]

    first = flat.where("test").groupBy("document_id", "section_name").agg(F.min("position").alias("first"), F.first("d_default_marks").alias("m"), F.first("d_default_negative_marks").alias("n"))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("first"))
    section_id = uuid("test-section", F.col("document_id"), F.col("section_name"))
    options = flat.select("id", "answer_keys", F.posexplode(learner_options(fields)).alias("at", "o")).withColumn("option_id", uuid("question-option", F.col("id"), F.col("o.key"), F.col("at")))
    right = F.coalesce(F.col("o.is_correct"), F.lit(False)) | F.array_contains("answer_keys", F.col("o.key"))
    pairs = flat.select("id", F.posexplode(F.when(F.col("type") == "match_the_following", F.col("match_pairs"))).alias("at", "p"))
    item = lambda side: uuid("matching-item", F.col("id"), side, F.col("at"))
    items = pairs.select("id", "at", F.explode(F.array(*[F.struct(item(s).alias("item"), F.lit(s).alias("side"), key.alias("item_key"), F.col(f"p.{s}").alias("text")) for s, key in (("left", F.char(F.col("at") + 65)), ("right", (F.col("at") + 1).cast("string")))])).alias("i"))
    groups = flat.where("group_order = 1")
    placed = ["question_id", F.col("position").alias("question_order"), F.col("marks_").alias("marks"), F.col("negative_").alias("negative_marks")]
    each = flat.withColumn("question_id", F.col("id"))
    return {
        "papers": own.where(~is_test).select(*container, "year", "difficulty", "created_at", F.lit(False).alias("is_published")),
        "tests": own.where(is_test).select(*container, F.coalesce("description", "notes").alias("description"), "created_at", F.lit("manual").alias("creation_mode"), F.lit(False).alias("is_published")),
        "test_sections": first.select(section_id.alias("id"), F.col("document_id").alias("test_id"), F.col("section_name").alias("name"), order.alias("section_order"), F.coalesce("m", F.lit(1.0)).alias("default_marks"), F.coalesce("n", F.lit(0.0)).alias("default_negative_marks")),
        "test_questions": each.where("test").select(F.col("document_id").alias("test_id"), section_id.alias("section_id"), *placed),
        "paper_questions": each.where("not test").select(F.col("document_id").alias("paper_id"), F.col("section_name").alias("section"), *placed),
        "questions": flat.select(
            "id", F.col("exam_type").alias("question_type"), F.col("d_subject_id").alias("subject_id"), F.col("d_topic_id").alias("topic_id"), F.col("d_standard_id").alias("standard_id"), F.col("d_stream_id").alias("stream_id"),
            F.coalesce("d_difficulty", F.lit("medium")).alias("difficulty"), (F.size("figures") > 0).alias("has_diagram"), F.col("figure.image_path").alias("diagram_path"), F.col("figure.svg").alias("diagram_svg"),
            F.col("marks_").alias("marks"), F.col("negative_").alias("negative_marks"), F.col("d_year").alias("year"), F.coalesce("d_source", "d_exam").alias("source"), F.array_join("labels", ",").alias("tags"),
            F.lit(True).alias("is_active"), F.col("d_created_at").alias("created_at"), F.col("d_updated_at").alias("updated_at"),
        ),
        "question_translations": flat.select(uuid("question-translation", F.col("id"), "en").alias("id"), F.col("id").alias("question_id"), F.lit("en").alias("language_code"), question_text(fields).alias("question_text"), solution_text(fields).alias("explanation"), "hint"),
        "question_options": options.select(F.col("option_id").alias("id"), F.col("id").alias("question_id"), F.col("o.key").alias("option_key"), right.alias("is_correct"), (F.col("at") + 1).alias("display_order")),
        "option_translations": options.select(uuid("option-translation", F.col("option_id"), "en").alias("id"), "option_id", F.lit("en").alias("language_code"), F.col("o.text").alias("option_text"), F.col("o.image_path").alias("option_image_path")),
        "question_tags": flat.select(F.col("id").alias("question_id"), F.explode("labels").alias("tag")),
        "question_groups": groups.select(F.col("group_id").alias("id"), F.lit("comprehension").alias("group_type"), F.col("d_subject_id").alias("subject_id"), F.col("d_standard_id").alias("standard_id"), F.col("figure.image_path").alias("shared_image_path"), F.col("figure.svg").alias("shared_image_svg"), F.col("d_created_at").alias("created_at")),
        "question_group_translations": groups.where("passage != ''").select(uuid("group-translation", F.col("group_id"), "en").alias("id"), "group_id", F.lit("en").alias("language_code"), F.col("passage").alias("shared_text")),
        "group_questions": flat.where("group_id is not null").select("group_id", F.col("id").alias("question_id"), F.col("group_order").alias("question_order")),
        "matching_items": items.select(F.col("i.item").alias("id"), F.col("id").alias("question_id"), "i.side", "i.item_key", F.col("i.text").alias("item_text"), (F.col("at") + 1).alias("display_order")),
        "matching_pairs": pairs.where("p.left != '' and p.right != ''").select(F.col("id").alias("question_id"), item("left").alias("left_item_id"), item("right").alias("right_item_id")),
    }
