"""One cropped question's text to a question, by how its words are laid out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questmill.functions.rules import question_type
from questmill.functions.text import cut_direction_tail, let, trimmed

#: Layouts, and how choices, numbers and assertions are printed; fixed values.
LAYOUTS = ("parentheses", "letters", "true_false", "assertion_reason", "fill_blank", "match", "jumble", "plain")
IN_PARENTHESES = r"\(([A-Ha-h])\)\s*"
LETTERS = r"(?:^|\s)([A-Ha-h])[.)]\s+"
LEADING = r"^\s*\(?(\d{1,3})\s*[.)]\s+"
ASSERTION = r"(?is)assertion\s*(?:\([A-Za-z]\))?\s*[:\-.]?\s*(.*?)\s+reason\s*(?:\([A-Za-z]\))?\s*[:\-.]?\s*(.*)"
KEYS = "ABCDEFGH"
#: Stem of a matching question that prints none; a fixed value.
MATCH_STEM = "Match the following."

OPTION = "array<struct<key:string,text:string>>"
PAIR = "array<struct<left:string,right:string>>"
_GOES, _ENDS = "\x01", "\x02"


def _spaced(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, r"\s+", " "))


def free_keys(options: Column) -> Column:
    """Options whose repeated keys give way to the first free one of A to H, in order; a key stays where all are taken."""

    def add(done: Column, o: Column) -> Column:
        used = F.transform(done, lambda x: x["key"])
        free = F.get(F.array_except(F.array(*[F.lit(k) for k in KEYS]), used), 0)
        key = F.when(F.array_contains(used, o["key"]), F.coalesce(free, o["key"])).otherwise(o["key"])
        return F.concat(done, F.array(F.struct(key.alias("key"), o["text"].alias("text"))))

    return F.aggregate(options, F.array().cast(OPTION), add)


def choices(text: Column, marker: str = IN_PARENTHESES) -> Column:
    """stem and options (key, text) of a text: what stands before the first marker, and behind each; no options where there are fewer than two.

    The text ends where printed directions begin. Choices without text are none.
    """

    def split(source: Column) -> Column:
        parts = F.split(F.regexp_replace(F.translate(source, _GOES + _ENDS, ""), marker, f"{_GOES}$1{_ENDS}"), _GOES)
        drafts = F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p: F.struct(F.upper(F.substring(p, 1, 1)).alias("key"), F.regexp_replace(trimmed(F.substr(p, F.lit(3))), "[.;,]$", "").alias("text")),
        )
        several = F.size(parts) > 2
        return F.struct(
            trimmed(F.when(several, F.get(parts, 0)).otherwise(source)).alias("stem"),
            F.when(several, free_keys(F.filter(drafts, lambda o: o["text"] != ""))).otherwise(F.array().cast(OPTION)).alias("options"),
        )

    return let(cut_direction_tail(text), split)


def pairs_of(text: Column) -> Column:
    """stem and pairs of a text in two columns: a line that a tab or wide gap cuts in two is a pair, the others are the stem."""
    cells = lambda line: F.filter(F.transform(F.split(line, r"\t+|\s{2,}"), trimmed), lambda x: x != "")
    lines = F.transform(F.split(text, "\n"), lambda s: F.struct(trimmed(s).alias("line"), cells(s).alias("cells")))
    pairs = F.transform(F.filter(lines, lambda x: F.size(x["cells"]) == 2), lambda x: F.struct(F.get(x["cells"], 0).alias("left"), F.get(x["cells"], 1).alias("right")))
    other = F.transform(F.filter(lines, lambda x: (F.size(x["cells"]) != 2) & (x["line"] != "")), lambda x: x["line"])
    stem = F.nullif(_spaced(F.array_join(other, " ")), F.lit(""))
    return F.struct(F.coalesce(stem, F.lit(MATCH_STEM)).alias("stem"), pairs.alias("pairs"))


def likely_layout(text: Column) -> Column:
    """The layout whose marks a text shows most of; of equals the one that says more. Two marks at least, or one blank, else plain."""
    lines = F.split(text, "\n")
    paired = F.size(F.filter(lines, lambda s: F.size(F.filter(F.split(trimmed(s), r"\t+|\s{2,}"), lambda x: x != "")) == 2))
    parens, letters = (F.regexp_count(text, F.lit(p)) for p in (IN_PARENTHESES, LETTERS))
    both = text.rlike(r"(?i)\(a\)\s*true\b") & text.rlike(r"(?i)\(b\)\s*false\b")
    seen = {
        "assertion_reason": F.when(text.rlike(ASSERTION), F.lit(9)).otherwise(0),
        "true_false": F.when(both & (parens == 2), F.lit(3)).otherwise(0),
        "jumble": F.when((F.regexp_count(text, F.lit("/")) >= 2) & (parens >= 2), parens + 1).otherwise(0),
        "match": F.when(paired >= 2, paired).otherwise(0),
        "parentheses": F.when(parens >= 2, parens).otherwise(0),
        "letters": F.when(letters >= 2, letters).otherwise(0),
        "fill_blank": F.regexp_count(text, F.lit("_{2,}")),
        "plain": F.lit(0),
    }
    most = F.greatest(*seen.values())
    first = F.coalesce(*[F.when((n == most) & (n > 0), name) for name, n in seen.items()])
    return F.coalesce(first, F.lit("plain"))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often later ones name them: as a generator's row, which the optimizer doesn't write out at each use."""
    row = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], row)


def read_crops(crops: DataFrame) -> DataFrame:
    """crops (doc_id, text, layout, number) to the question of each: doc_id, layout, number, type, stem, options, blanks, pairs, assertion, reason.

    A number printed first goes before the given one. A layout that is null is told
    from the text, an unknown one is read as parentheses. A crop whose text or stem
    is empty has no question.
    """
    read = _held(crops.select("doc_id", "layout", "number", "text"), own=trimmed(F.coalesce("text", F.lit("")))).where("own != ''")
    printed = F.nullif(F.regexp_extract("own", LEADING, 1), F.lit(""))
    read = _held(read, number=F.coalesce(printed, "number"), body=trimmed(F.regexp_replace("own", LEADING, ""))).drop("own", "text")
    known = F.coalesce("layout", likely_layout(F.col("body")))
    read = _held(read, layout=F.when(known.isin(*LAYOUTS), known).otherwise("parentheses"))

    layout, body = F.col("layout"), F.col("body")
    asserted = (layout == "assertion_reason") & body.rlike(ASSERTION)
    read = _held(read, asserted=asserted, source=F.when(asserted, trimmed(F.regexp_extract(body, ASSERTION, 2))).otherwise(body))
    chosen = F.when(layout == "letters", choices(F.col("source"), LETTERS)).when(~layout.isin("fill_blank", "match", "plain"), choices(F.col("source")))
    read = _held(read, read=chosen, matched=F.when(layout == "match", pairs_of(body)))
    options = F.coalesce("read.options", F.array().cast(OPTION))
    head = F.coalesce(F.nullif(F.col("read.stem"), F.lit("")), body)
    stem = (
        F.when(F.col("asserted"), trimmed(F.regexp_extract(body, ASSERTION, 1)))
        .when(layout == "fill_blank", _spaced(F.regexp_replace(body, "_{2,}", "____")))
        .when(layout == "match", F.col("matched.stem"))
        .when(layout == "jumble", trimmed(F.regexp_replace(head, r"[ \t]+", " ")))
        .when(layout == "plain", _spaced(body))
        .otherwise(head)
    )
    read = _held(read, options=options, stem=stem).where("stem != ''")
    kind = (
        F.when(layout == "match", "match_the_following")
        .when(layout == "jumble", F.when(F.size("options") > 1, "mcq").otherwise("short_answer"))
        .when(layout.isin("parentheses", "letters", "plain"), question_type(F.col("stem"), F.transform("options", lambda o: o["text"])))
        .otherwise(layout)
    )
    blanks = F.when(layout == "fill_blank", F.greatest(F.lit(1), F.regexp_count("stem", F.lit("____")))).otherwise(0)
    return read.select(
        "doc_id", "layout", "number", kind.alias("type"), "stem", "options", blanks.alias("blanks"),
        F.coalesce("matched.pairs", F.array().cast(PAIR)).alias("pairs"),
        F.when(F.col("asserted"), F.col("stem")).alias("assertion"),
        F.when(F.col("asserted"), F.nullif(F.col("read.stem"), F.lit(""))).alias("reason"),
    )


def apply_reading(current: Column, reading: Column, graphics: Column) -> Column:
    """A question (struct) with what was read of its crop.

    Id, page and catalogue fields stay, fields of the wording are the reading's.
    Images of options and figures hold in graphics mode only, parts only for
    comprehension. Hint, explanation and approval described the old wording and go.
    """
    own = lambda name: F.coalesce(reading[name], current[name])
    bare = F.transform(reading["options"], lambda o: o.withField("image_path", F.lit(None).cast("string")))
    empty = lambda name: F.slice(reading[name], 1, 0)
    parts = F.when(reading["type"] != "comprehension", F.slice(current["sub_questions"], 1, 0)).when(F.size(reading["sub_questions"]) > 0, reading["sub_questions"]).otherwise(current["sub_questions"])
    fields = {
        "number": F.coalesce(F.nullif(trimmed(reading["number"]), F.lit("")), current["number"]),
        "options": F.when(graphics, reading["options"]).otherwise(bare),
        "figures": F.when(graphics, reading["figures"]).otherwise(empty("figures")),
        "sub_questions": parts,
        "confidence": own("confidence"),
        "approved": F.lit(False),
        "approval_status": F.lit(None).cast("string"),
        "hint": F.lit(None).cast("string"),
        "explanation": F.lit(None).cast("string"),
    } | {name: reading[name] for name in ("type", "stem", "instructions", "passage", "assertion", "reason", "answer_keys", "answer_text")}
    return reduce(lambda q, x: q.withField(*x), fields.items(), current)
