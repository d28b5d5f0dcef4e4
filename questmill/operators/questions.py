"""The question model: decoding, answers, merges and review, as projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from questmill.functions.rules import question_type
from questmill.functions.text import is_copied, trimmed

#: Question types; fixed values. Anything else is unknown.
TYPES = (
    "mcq multi_select true_false fill_blank assertion_reason comprehension match_the_following short_answer long_answer numerical diagram"
).split()
OPTION = "struct<key:string,text:string,is_correct:string>"
RAW = f"struct<number:string,type:string,stem:string,marks:string,difficulty:string,approval_status:string,approved:string,options:array<{OPTION}>,answer_keys:array<string>>"


def text_or_null(c: Column) -> Column:
    """A trimmed text, or null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def normalized(json: Column) -> dict[str, Column]:
    """The canonical fields of a loose question JSON: bad values become null or their default, bad JSON an empty question."""
    q = F.from_json(json, RAW)
    status = F.when(q["approval_status"].isin("draft", "generated", "reviewed", "rejected", "published"), q["approval_status"])
    options = F.transform(
        F.coalesce(q["options"], F.array().cast(f"array<{OPTION}>")),
        lambda o, i: F.struct(
            F.coalesce(text_or_null(o["key"]), F.char(i + 65)).alias("key"), F.coalesce(text_or_null(o["text"]), F.lit("")).alias("text"),
            F.when(o["is_correct"].isin("true", "false"), o["is_correct"] == "true").alias("is_correct"),
        ),
    )
    return {
        "number": text_or_null(q["number"]),
        "type": F.when(q["type"].isin(TYPES), q["type"]).otherwise("unknown"),
        "stem": F.coalesce(text_or_null(q["stem"]), F.lit("")),
        "marks": q["marks"].try_cast("double"),
        "difficulty": F.when(q["difficulty"].isin("easy", "medium", "hard"), q["difficulty"]),
        "approved": F.when(status.isNotNull(), status.isin("reviewed", "published")).otherwise(F.coalesce(q["approved"] == "true", F.lit(False))),
        "options": options,
    }


def has_answer(kind: Column, keys: Column, marked: Column, answer_text: Column, answer_boolean: Column, blanks: Column) -> Column:
    """Whether the right answer is known, by what the type needs."""
    some = lambda xs: F.exists(xs, lambda x: trimmed(x) != "")
    written = trimmed(F.coalesce(answer_text, F.lit(""))) != ""
    chosen = some(keys) | (marked > 0)
    return (
        F.when(kind == "true_false", answer_boolean.isNotNull())
        .when(kind == "fill_blank", some(blanks))
        .when(kind.isin("short_answer", "long_answer", "numerical"), written)
        .when(kind.isin("mcq", "multi_select", "assertion_reason"), chosen)
        .otherwise(chosen | written | answer_boolean.isNotNull())
    )


def filled(current: Column, new: Column, force: bool) -> Column:
    """The new text where forced or where the current one is blank."""
    return new if force else F.when(trimmed(F.coalesce(current, F.lit(""))) == "", new).otherwise(current)


def structural(stem: Column, kind: Column, options: Column, answers: Column, skill_match: Column, reference: Column, reference_options: Column) -> dict[str, Column]:
    """The structural checks of a generated question against its reference."""
    copied = F.size(F.filter(options, lambda o: F.exists(reference_options, lambda r: is_copied(o, r))))
    checks = {
        "schema_valid": (kind != "unknown") & (trimmed(stem) != ""),
        "has_answers": answers,
        "option_count_ok": (kind != "mcq") | (F.size(options) == 4),
        "skill_match": skill_match,
        "copied_reference": is_copied(stem, reference) | (copied >= 2),
    }
    passed = checks["schema_valid"] & checks["has_answers"] & checks["option_count_ok"] & checks["skill_match"] & ~checks["copied_reference"]
    return checks | {"passed": passed}


def verdict(raw: Column) -> dict[str, Column]:
    """A judge's rubric JSON, fences and chatter aside: clamped marks and their share of fifteen; null if there is no JSON."""
    clean = F.regexp_replace(F.regexp_replace(raw, r"(?i)^\s*```(?:json)?", ""), r"```\s*$", "")
    body = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    v = F.from_json(F.nullif(body, F.lit("")), "struct<equivalent:string,answerable:string,skill_match:string,difficulty_match:string,past_paper_like:string>")
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(5), F.floor(F.coalesce(c.try_cast("double"), F.lit(0.0)) + 0.5))).cast("int")
    marks = {k: clamp(v[k]) for k in ("skill_match", "difficulty_match", "past_paper_like")}
    known = F.coalesce(v["equivalent"], v["answerable"], v["skill_match"], v["difficulty_match"], v["past_paper_like"]).isNotNull()
    out = marks | {"equivalent": F.coalesce(v["equivalent"] == "true", F.lit(False)), "answerable": F.coalesce(v["answerable"] != "false", F.lit(True)), "judge_score": sum(marks.values()) / 15}
    return {k: F.when(known, c) for k, c in out.items()}


__all__ = ["TYPES", "filled", "has_answer", "normalized", "question_type", "structural", "text_or_null", "verdict"]
