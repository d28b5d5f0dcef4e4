"""Checks of generated questions and of exports, their verdicts, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questmill.functions.text import copies_phrase, trimmed

#: The types and difficulties of the export, and how its ids look; fixed values.
EXPORT_TYPES = "mcq_single mcq_multi true_false fill_blank short_answer matching comprehension assertion_reason".split()
DIFFICULTIES = ["easy", "medium", "hard"]
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: From this score on a case or a skill passes; and the difference of difficulties that counts; fixed values.
PASS, BIAS = 0.6, 0.25


def check(name: str, ok: Column, good: Column | str, bad: Column | str, worse: str = "failed") -> Column:
    """One check: name, status and details."""
    text = lambda t: F.lit(t) if isinstance(t, str) else t
    return F.struct(F.lit(name).alias("name"), F.when(ok, "passed").otherwise(worse).alias("status"), F.when(ok, text(good)).otherwise(text(bad)).alias("details"))


def combined(checks: Column) -> Column:
    """The verdict over an array of checks: failed before needs_review before passed, and the details of those that are not well."""
    some = lambda status: F.exists(checks, lambda x: x["status"] == status)
    wrong = F.filter(checks, lambda x: x["status"].isin("failed", "needs_review"))
    errors = F.transform(wrong, lambda x: F.coalesce(F.nullif(x["details"], F.lit("")), x["name"]))
    status = F.when(some("failed"), "failed").when(some("needs_review"), "needs_review").otherwise("passed")
    return F.struct(status.alias("status"), errors.alias("errors"))


def grammar_checks(kind: Column, stem: Column, options: Column, answers: Column, source: Column) -> Column:
    """The checks of a grammar question: its stem, four options, one right answer, and no long phrase of its source."""
    n, has_stem = F.size(options), trimmed(stem) != ""
    told = F.concat(F.lit("Expected 4 options, found "), n.cast("string"), F.lit("."))
    marked = F.concat(F.lit("Expected one answer, found "), answers.cast("string"), F.lit("."))
    schema = F.struct(F.lit("schema").alias("name"), F.when((kind == "mcq") & has_stem, "passed").otherwise("failed").alias("status"), F.when(has_stem, "Grammar item has a stem.").otherwise("Grammar item is missing a stem.").alias("details"))
    compared = check("originality", ~copies_phrase(source, stem), "No long copied phrase detected.", "The stem repeats a long phrase from the source.", "needs_review")
    alone = F.struct(F.lit("originality").alias("name"), F.lit("skipped").alias("status"), F.lit("No source stem to compare.").alias("details"))
    original = F.when(trimmed(F.coalesce(source, F.lit(""))) != "", compared).otherwise(alone)
    return F.array(schema, check("options", n == 4, "Four options.", told), check("answer", answers == 1, "One answer is marked.", marked), original)


def case_score(structural: dict[str, Column], oracle_skill: Column, oracle_passed: Column, judged: Column, equivalent: Column, answerable: Column, marks: Column) -> dict[str, Column]:
    """Score and pass of a case: a solver decides where there is one, else structure and judge count half each, or structure alone."""
    good = [structural[c] for c in ("schema_valid", "has_answers", "option_count_ok", "skill_match")] + [~structural["copied_reference"]]
    share = sum((g.cast("int") for g in good[1:]), good[0].cast("int")) / F.lit(len(good))
    fine = structural["passed"]
    score = F.when(oracle_skill, F.when(fine, F.when(oracle_passed, 1.0).otherwise(0.4)).otherwise(0.0)).when(judged, 0.5 * share + 0.5 * marks).otherwise(share)
    passed = F.when(oracle_skill, fine & oracle_passed).when(judged, fine & equivalent & answerable & (marks >= PASS)).otherwise(fine)
    return {"score": score, "passed": passed}


def tuned(skills: DataFrame) -> DataFrame:
    """skills (scope_key, skill_type, score, cases, passed, unjudged, references, generated, reference) with their retrieval settings.

    A weak skill, one without cases or below the pass, gets more exemplars unless no
    case was judged; difficulty moves against a difference of the mean difficulties.
    """
    weak = ~F.col("unjudged") & ((F.col("cases") == 0) | (F.col("score") < PASS))
    apart = F.col("generated") - F.col("reference")
    bias = F.when(apart < -BIAS, 1).when(apart > BIAS, -1).otherwise(0)
    limit = F.when(weak, 5).otherwise(3)
    told = F.format_string(
        "Calibration pass %d/%d (score %s). Retrieval limit %d, difficulty bias %s%d.", "passed", "cases", F.format_number("score", 2), limit, F.when(bias >= 0, "+").otherwise(""), bias
    )
    return skills.select("scope_key", "skill_type", limit.alias("exemplar_limit"), F.when(F.col("references") > 0, "exact").otherwise("skill").alias("exemplar_scope"), bias.alias("difficulty_bias"), told.alias("rationale"))


def fits_numeric(value: Column) -> Column:
    """Null, or a number of at most three digits before the point and one behind it."""
    return value.isNull() | ((F.abs(value) <= 999.9) & (F.abs(value * 10 - F.round(value * 10)) < 1e-6))


def export_errors(questions: DataFrame, options: DataFrame) -> DataFrame:
    """question_id and error, a row for each thing that keeps an export's questions and options from being written."""
    q = questions.select("id", "question_type", "difficulty", "marks", "negative_marks")
    place = F.row_number().over(Window.partitionBy("id").orderBy("question_type", "difficulty", "marks", "negative_marks"))
    name = F.concat(F.lit("Question "), F.col("id"))
    own = F.array(
        F.when(F.col("place") > 1, F.concat(name, F.lit(" is listed more than once."))),
        F.when(~F.coalesce(F.col("question_type").isin(EXPORT_TYPES), F.lit(False)), F.concat(name, F.lit(' has unsupported type "'), F.coalesce("question_type", F.lit("")), F.lit('".'))),
        F.when(~F.col("difficulty").isin(DIFFICULTIES), F.concat(name, F.lit(' has unsupported difficulty "'), F.col("difficulty"), F.lit('".'))),
        F.when(~fits_numeric(F.col("marks")), F.concat(name, F.lit(" has marks outside the numeric(4,1) range."))),
        F.when(~fits_numeric(F.col("negative_marks")), F.concat(name, F.lit(" has negative marks outside the numeric(4,1) range."))),
    )
    sound = F.coalesce(F.col("id").rlike(UUID), F.lit(False))
    bad = F.array(F.concat(F.lit('Question "'), F.coalesce(F.nullif("id", F.lit("")), F.lit("(missing id)")), F.lit('" is not a UUID.')))
    found = q.withColumn("place", place).select(F.col("id").alias("question_id"), F.explode(F.array_compact(F.when(sound, own).otherwise(bad))).alias("error"))
    keys = options.join(q.where(sound).select(F.col("id").alias("question_id")).distinct(), "question_id", "left_semi").groupBy("question_id", F.coalesce("option_key", F.lit("")).alias("key")).agg(F.count("*").alias("n"))
    said = F.when(F.col("key") == "", F.concat(F.lit("Question "), F.col("question_id"), F.lit(" has an option without a key."))).otherwise(F.concat(F.lit("Question "), F.col("question_id"), F.lit(" has duplicate option key "), F.col("key"), F.lit(".")))
    times = F.col("n") - F.when(F.col("key") == "", 0).otherwise(1)
    return found.union(keys.where(times > 0).select("question_id", F.explode(F.array_repeat(said, times.cast("int")))))
