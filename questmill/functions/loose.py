"""Tolerant decoding of JSON that others wrote: a value of the wrong type counts as absent, and only broken JSON loses the rest.

JSON is parsed once to a VARIANT; each value is taken only if its own type fits, so
a number is no text and a text no number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from questmill.functions.text import let, trimmed

#: Names that job states know, and the most snippets of a search; fixed values.
MODES = ("from_source", "from_instructions")
STATUSES = ("pending", "in_progress", "completed", "failed")
STAGES = ("analysis", "generation", "validation", "asset", "review", "completed")
ITEM_STATUSES = ("pending", "running", "retryable", "needs_review", "completed", "failed")
VERDICTS = ("passed", "failed", "needs_review")
STRATEGIES, TARGETS, AGENTS = ("rewrite", "write_new"), ("instructions", "topic", "syllabus"), ("past_paper", "practice_test")
MOST_SNIPPETS = 5
#: Longest error of a provider that is shown; longer ones are often the prompt; a fixed value.
LONGEST_ERROR = 400


def kind(v: Column, path: str = "$") -> Column:
    """The type of what stands at a path: STRING, BIGINT, ARRAY<...>; null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str = "$") -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def number(v: Column, path: str = "$") -> Column:
    k = kind(v, path)
    return F.when((k == "BIGINT") | (k == "DOUBLE") | k.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))


def items(v: Column, path: str) -> Column:
    """The elements of an array, as variants; null if there is none."""
    return F.when(kind(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path).startswith("OBJECT"), F.lit(False))


def one_of(value: Column, known: tuple[str, ...], otherwise: str | None = None) -> Column:
    return F.when(value.isin(*known), value).otherwise(F.lit(otherwise))


def _each(v: Column, path: str, keep: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
    """make of the elements that keep holds for; an empty list if there is no array."""
    kept = F.filter(items(v, path), lambda x: F.coalesce(keep(x), F.lit(False)))
    made = F.transform(kept, make)
    return F.coalesce(made, F.slice(F.transform(F.array(v), make), 1, 0))


def _texts(v: Column, path: str) -> Column:
    return _each(v, path, lambda x: text(x).isNotNull(), lambda x: text(x))


def generation_item(x: Column) -> Column:
    """An item of a job, of which only the ids must be there."""
    return F.struct(
        text(x, "$.item_id").alias("item_id"), F.coalesce(number(x, "$.sequence"), F.lit(0.0)).alias("sequence"),
        text(x, "$.source_question_id").alias("source_question_id"), one_of(text(x, "$.stage"), STAGES, "analysis").alias("stage"),
        one_of(text(x, "$.status"), ITEM_STATUSES, "pending").alias("status"), F.coalesce(number(x, "$.attempt_count"), F.lit(0.0)).alias("attempt_count"),
        text(x, "$.candidate_question_id").alias("candidate_question_id"), one_of(text(x, "$.validation_status"), VERDICTS).alias("validation_status"),
        text(x, "$.last_error").alias("last_error"), text(x, "$.idempotency_key").alias("idempotency_key"),
        F.filter(_texts(x, "$.completed_stages"), lambda s: s.isin(*STAGES)).alias("completed_stages"),
    )


def generation_state(raw: Column) -> Column:
    """A job's state from its JSON; null where it is no object of a known mode.

    Optional parts (blueprint, plan, figure_skills) are null where they are absent,
    the plan also where none of its slots names a skill.
    """

    def state(v: Column) -> Column:
        some = lambda path: kind(v, path).startswith("ARRAY")
        pair = lambda x: F.struct(text(x, "$.source_question_id").alias("source_question_id"), text(x, "$.mock_question_id").alias("mock_question_id"))
        share = lambda x: F.struct(text(x, "$.skill").alias("skill"), number(x, "$.count").alias("count"))
        slot = lambda x: F.struct(
            text(x, "$.skill").alias("skill"), text(x, "$.pattern_subtype").alias("pattern_subtype"), number(x, "$.subject_id").alias("subject_id"),
            F.coalesce(text(x, "$.subject_key"), F.lit("")).alias("subject_key"), F.coalesce(text(x, "$.topic"), F.lit("")).alias("topic"),
            F.coalesce(number(x, "$.count"), F.lit(1.0)).alias("count"), F.coalesce(number(x, "$.difficulty_step"), F.lit(0.0)).alias("difficulty_step"),
        )
        filled = lambda x, path: F.coalesce(text(x, path), F.lit("")) != ""
        plan = _each(v, "$.plan", lambda x: text(x, "$.skill").isNotNull(), slot)
        skills = F.map_filter(F.try_variant_get(v, "$.figure_skills", "map<string,variant>"), lambda _, x: text(x).isNotNull())
        fields = {
            "mode": text(v, "$.mode"),
            "status": one_of(text(v, "$.status"), STATUSES, "pending"),
            "instructions": text(v, "$.instructions"),
            "planned_count": number(v, "$.planned_count"),
            "source_question_ids": _texts(v, "$.source_question_ids"),
            "cursor": F.coalesce(number(v, "$.cursor"), F.lit(0.0)),
            "last_error": text(v, "$.last_error"),
            "pairs": _each(v, "$.pairs", lambda x: filled(x, "$.mock_question_id"), pair),
            "job_id": text(v, "$.job_id"),
            "items": _each(v, "$.items", lambda x: filled(x, "$.item_id") & filled(x, "$.idempotency_key"), generation_item),
            "blueprint": F.when(some("$.blueprint"), _each(v, "$.blueprint", lambda x: text(x, "$.skill").isNotNull() & number(x, "$.count").isNotNull(), share)),
            "strategy": one_of(text(v, "$.strategy"), STRATEGIES),
            "difficulty_step": number(v, "$.difficulty_step"),
            "drill_skill": text(v, "$.drill_skill"),
            "figure_skills": F.when(is_object(v, "$.figure_skills"), F.transform_values(skills, lambda _, x: text(x))),
            "plan": F.when(F.size(plan) > 0, plan),
            "generation_target": one_of(text(v, "$.generation_target"), TARGETS),
            "agent": one_of(text(v, "$.agent"), AGENTS),
        }
        return F.when(is_object(v) & text(v, "$.mode").isin(*MODES), F.struct(*[c.alias(k) for k, c in fields.items()]))

    return let(F.try_parse_json(raw), state)


def search_snippets(body: Column) -> Column:
    """title, url and snippet of a search's first results, from the first list that is there under the usual names.

    A result without title and snippet is passed over.
    """

    def found(v: Column) -> Column:
        inner = is_object(v, "$.data")
        at = lambda name: F.when(inner, items(v, f"$.data.{name}")).otherwise(items(v, f"$.{name}"))
        listed = F.coalesce(at("results"), at("organic"), items(v, "$.results"), at("items"))
        first = lambda x, *names: F.coalesce(*[trimmed(text(x, f"$.{n}")) for n in names], F.lit(""))
        rows = F.transform(F.filter(listed, lambda x: is_object(x)), lambda x: F.struct(first(x, "title").alias("title"), first(x, "url", "link").alias("url"), first(x, "snippet", "content", "description").alias("snippet")))
        return F.when(is_object(v), F.slice(F.filter(rows, lambda r: (r["title"] != "") | (r["snippet"] != "")), 1, MOST_SNIPPETS))

    none = F.array().cast("array<struct<title:string,url:string,snippet:string>>")
    return F.coalesce(let(F.try_parse_json(body), found), none)


def _content(v: Column, path: str) -> Column:
    """A message's content: a text, or the texts of its parts; empty if it is neither."""
    parts = F.transform(items(v, path), lambda x: F.coalesce(text(x), text(x, "$.text"), F.lit("")))
    return F.coalesce(text(v, path), F.array_join(parts, ""), F.lit(""))


def _first_present(v: Column, *paths: str) -> Column:
    """The content at the first path that holds anything but null."""
    out = F.lit("")
    for path in reversed(paths):
        out = F.when(F.coalesce(kind(v, path), F.lit("VOID")) != "VOID", _content(v, path)).otherwise(out)
    return out


def _error(v: Column) -> Column:
    """The error that a provider's reply holds, null if none."""
    message = F.coalesce(trimmed(text(v, "$.error")), trimmed(text(v, "$.error.message")), trimmed(text(v, "$.message")), F.to_json(v))
    short = (message != "") & (F.length(message) <= LONGEST_ERROR)
    there = F.coalesce(kind(v, "$.error"), F.lit("VOID")) != "VOID"
    return F.when(there, F.when(short, message).otherwise("The AI provider failed (200). Try again."))


def chat_answer(body: Column) -> Column:
    """text and error of a chat completion: one JSON object, or a stream of data: lines.

    A stream's pieces are put together in order; broken ones and [DONE] are passed
    over. Reasoning serves as the answer only where there is no other and it holds a
    hint or an explanation. The first error counts, and a body that should be one
    object and is none is one.
    """
    said, thought = "$.choices[0].{}.content", ("$.choices[0].{}.reasoning_content", "$.choices[0].{}.reasoning")

    def whole(v: Column) -> Column:
        content = _first_present(v, said.format("message"), said.format("delta"))
        reasoning = _first_present(v, *[p.format(m) for m in ("message", "delta") for p in thought])
        return F.struct(content.alias("content"), reasoning.alias("reasoning"), F.when(v.isNull(), "The reply is no JSON.").otherwise(_error(v)).alias("error"))

    def piece(v: Column) -> Column:
        content = F.concat(_content(v, said.format("delta")), _content(v, said.format("message")))
        reasoning = F.concat(*[_first_present(v, *[p.format(m) for p in thought]) for m in ("delta", "message")])
        return F.struct(content.alias("content"), reasoning.alias("reasoning"), _error(v).alias("error"))

    def streamed(s: Column) -> Column:
        data = F.filter(F.transform(F.split(s, "\n"), trimmed), lambda x: x.startswith("data:"))
        parsed = F.transform(data, lambda x: F.try_parse_json(trimmed(F.substr(x, F.lit(6)))))
        return let(F.transform(F.filter(parsed, lambda v: v.isNotNull() & is_object(v)), piece), joined)

    def joined(pieces: Column) -> Column:
        take = lambda name: F.array_join(F.transform(pieces, lambda p: p[name]), "")
        return F.struct(take("content").alias("content"), take("reasoning").alias("reasoning"), F.get(F.filter(F.transform(pieces, lambda p: p["error"]), lambda e: e.isNotNull()), 0).alias("error"))

    def answer(r: Column) -> Column:
        useful = r["reasoning"].rlike(r'"hint"\s*:|"explanation"\s*:')
        chosen = F.when(trimmed(r["content"]) != "", r["content"]).when(useful, r["reasoning"]).otherwise("")
        return F.struct(F.when(r["error"].isNull(), chosen).alias("text"), r["error"].alias("error"))

    trimmed_body = trimmed(F.coalesce(body, F.lit("")))
    return let(trimmed_body, lambda s: let(F.when(s.startswith("{"), let(F.try_parse_json(s), whole)).otherwise(streamed(s)), answer))
