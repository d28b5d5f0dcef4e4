"""Edits of question trees: a question's row holds its parts in the array sub_questions, one level deep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find(questions: DataFrame, target: Column) -> DataFrame:
    """questions with found: the question or the part that has the target's id; rows without one go."""
    part = [f.name for f in questions.schema["sub_questions"].dataType.elementType.fields]
    whole = F.struct(*[F.col(c).alias(c) for c in part])
    inside = F.get(F.filter("sub_questions", lambda x: x["id"] == target), 0)
    return questions.withColumn("found", F.when(F.col("id") == target, whole).otherwise(inside)).where("found is not null")


def update(questions: DataFrame, target: Column, values: dict[str, Column]) -> DataFrame:
    """questions where the fields of the one with the target's id, question or part, have these values."""
    hit = F.coalesce(F.col("id") == target, F.lit(False))

    def changed(x: Column) -> Column:
        for name, value in values.items():
            x = x.withField(name, F.when(x["id"] == target, value).otherwise(x[name]))
        return x

    own = {name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()}
    return questions.withColumns(own | {"sub_questions": F.transform("sub_questions", changed)})


def remove(questions: DataFrame, target: Column) -> DataFrame:
    """questions without the question or part that has the target's id."""
    kept = questions.where(~F.coalesce(F.col("id") == target, F.lit(False)))
    return kept.withColumn("sub_questions", F.filter("sub_questions", lambda x: x["id"] != target))


def detach_image(questions: DataFrame, path: Column) -> DataFrame:
    """questions without the figures of this image path, and with options that no longer show it; parts too."""
    other = lambda f: ~F.coalesce(f["image_path"] == path, F.lit(False))
    bare = lambda o: o.withField("image_path", F.when(other(o), o["image_path"]))
    return _everywhere(questions, {"figures": lambda c: F.filter(c, other), "options": lambda c: F.transform(c, bare)})


def remove_option(questions: DataFrame, key: Column) -> DataFrame:
    """questions without the option of this key, nor the key among the answers; parts keep theirs."""
    return questions.withColumns({"options": F.filter("options", lambda o: o["key"] != key), "answer_keys": F.filter("answer_keys", lambda k: k != key)})


def _everywhere(questions: DataFrame, edits: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The edits on fields of questions and of their parts."""

    def part(x: Column) -> Column:
        for name, edit in edits.items():
            x = x.withField(name, edit(x[name]))
        return x

    return questions.withColumns({name: edit(F.col(name)) for name, edit in edits.items()} | {"sub_questions": F.transform("sub_questions", part)})
