"""Text functions of the question library, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header words of printed directions, and their full shape; fixed values.
HEADER = r"(?:DIRECTIONS?|INSTRUCTIONS?)"
HEADER_SHAPE = HEADER + r"\s*(?:\(\s*[^)\n]{0,48}\)|for questions\b)"
#: First words of a question, where a printed direction starts with a command; fixed values.
STEM_STARTERS = (
    "a an the this that these those who whose whom what which when where why how is are was were "
    "do does did can could will would should may might"
).split()
#: Words of money, prompts of choices and their printed marks; fixed values.
MONEY_WORD = r"(?i)\b(?:cost|price|priced|rupee|rupees|bought|sold|costs|pays|paid|spend|spent)\b"
MCQ_PROMPT = r"(?i)which of the following|choose the correct|select the (?:right|correct)"
OPTION_MARKER = r"\([A-Ha-h]\)|(?:^|\s)[A-Ha-h][.)]\s+\S"


#: The characters with Unicode's White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(s: Column) -> Column:
    """s without white space at its ends, no-break spaces included."""
    return F.btrim(s, F.lit(SPACES))


def normalize_text(s: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and white space as a space, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often and deep in lambdas body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _tokens(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: F.length(t) > 1))


def token_set(s: Column) -> Column:
    """Distinct normalised tokens of more than one character."""
    return _tokens(normalize_text(s))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct tokens, 0 if either is empty. Each array is made once."""

    def alike(x: Column, y: Column) -> Column:
        both = let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both)

    return let(a, lambda x: let(b, lambda y: alike(x, y)))


def is_copied(candidate: Column, reference: Column) -> Column:
    """Equal, or one contains the other's 24 characters and more, or token sets 85 % alike. Each text is normalised once."""

    def copied(a: Column, b: Column) -> Column:
        near = (a == b) | ((F.length(a) >= 24) & F.contains(b, a)) | ((F.length(b) >= 24) & F.contains(a, b))
        return (a != "") & (b != "") & (near | (jaccard(_tokens(a), _tokens(b)) >= 0.85))

    return let(normalize_text(candidate), lambda a: let(normalize_text(reference), lambda b: copied(a, b)))


def copies_phrase(source: Column, generated: Column, words: int = 8) -> Column:
    """Whether so many successive words of the source, 24 characters or more, stand in the generated text (of 40 or more).

    A phrase may begin and end within words of the generated text, but its inner
    words are words there too. So only phrases whose inner words occur there, by
    their hash, are looked for.
    """
    starts = lambda parts, n: F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - (n - 1))).otherwise(F.array().cast("array<int>"))
    inner = lambda parts, i: F.xxhash64(F.slice(parts, i, words - 2))
    phrase = lambda parts, i: F.array_join(F.slice(parts, i, words), " ")
    split = lambda s: F.filter(F.split(normalize_text(s), " "), lambda w: w != "")

    def found(left: Column, right: Column, whole: Column) -> Column:
        mine = F.transform(starts(left, words), lambda i: inner(left, i + 1))
        met = F.array_intersect(mine, F.transform(starts(right, words - 2), lambda i: inner(right, i)))
        hits = lambda shared: F.filter(starts(left, words), lambda i: F.array_contains(shared, inner(left, i + 1)))
        stands = lambda i: (F.length(phrase(left, i)) >= 24) & F.contains(whole, phrase(left, i))
        return let(met, lambda shared: (F.size(shared) > 0) & F.exists(hits(shared), stands))

    return let(split(source), lambda left: let(split(generated), lambda right: let(F.array_join(right, " "), lambda whole: (F.length(whole) >= 40) & found(left, right, whole))))


def option_token(s: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^A-Za-z0-9]", ""))


def printed_order(number: Column) -> Column:
    """The first run of digits as a number; null sorts last."""
    return F.expr("try_cast(null as bigint)") if number is None else F.nullif(F.regexp_extract(number, r"(\d+)", 1), F.lit("")).try_cast("bigint")


def question_key(number: Column) -> Column:
    """The first one to three digits without leading zeros, else the text itself."""
    digits = F.regexp_extract(F.coalesce(number, F.lit("")), r"\d{1,3}", 0)
    return F.when(digits != "", digits.try_cast("int").cast("string")).otherwise(F.coalesce(number, F.lit("")))


def natural_key(s: Column) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda p: F.when(p.rlike(r"^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def parse_grade(name: Column) -> Column:
    """The class from 1 to 12 that a standard's name states, by three patterns in order."""
    text = trimmed(F.coalesce(name, F.lit("")))
    found = [
        F.regexp_extract(text, p, 1).try_cast("int")
        for p in (
            r"(?i)\b(?:class|grade|std\.?|standard)\s*[-:]?\s*(\d{1,2})\b",
            r"(?i)\b(\d{1,2})\s*(?:st|nd|rd|th)\s*(?:class|grade|std\.?|standard)?\b",
            r"\b(\d{1,2})\b",
        )
    ]
    return F.coalesce(*[F.when(g.between(1, 12), g) for g in found])


def direction_start(line: Column) -> Column:
    return trimmed(line).rlike(rf"(?i)^{HEADER}\b")


def direction_range(text: Column) -> tuple[Column, Column]:
    """First and last number of a printed range such as (21-25) or 21 to 25; null where there is none."""
    pattern = r"(?i)(\d{1,3})\s*(?:[-–—]|to)\s*(\d{1,3})"
    start, end = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
    return F.when(end >= start, start), F.when(end >= start, end)


def cut_direction_tail(text: Column) -> Column:
    """The text before a directions header; empty if it begins with one."""
    head = F.regexp_extract(text, rf"(?is)^(.*?)(?:(?:^|\n)\s*{HEADER}\b|\b{HEADER_SHAPE})", 1)
    has = text.rlike(rf"(?i)(?:^|\n)\s*{HEADER}\b|\b{HEADER_SHAPE}")
    return F.when(has, F.regexp_replace(head, r"[.;,\s]+$", "")).otherwise(text)


def split_glued(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?i)([^\n])[ \t]+({HEADER_SHAPE})", "$1\n$2")


def separate_numbers(text: Column) -> Column:
    """A line break before a question number that stands inside a line, and before a glued header."""
    text = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"""([^\n])[ \t]+(\d{1,3})\s*[.)]\s+(?=[A-Za-z"'(])""", "$1\n$2. ")
    return split_glued(text)


def printed_instruction(value: Column) -> Column:
    """An instruction without its header and leading range of numbers; the text itself if nothing else is left."""
    text = trimmed(value)
    cleaned = F.regexp_replace(text, r"(?i)^(?:directions?|instructions?)\s*(?:\([^)]*\))?\s*[-:.]?\s*", "")
    lead = F.regexp_extract(cleaned, r"^\(([^)]*)\)", 1)
    ranged = cleaned.rlike(r"^\([^)]*\)") & (trimmed(lead).rlike(r"^\d") | trimmed(lead).rlike(r"(?i)^qs?\.?\s*nos?"))
    cleaned = trimmed(F.when(ranged, F.regexp_replace(cleaned, r"^\([^)]*\)[-:.]?\s*", "")).otherwise(cleaned))
    return F.when(text == "", None).when(cleaned == "", text).otherwise(cleaned)


def is_direction(value: Column) -> Column:
    """Whether a text reads like a direction: no question mark, and no first word that opens a question."""
    text = trimmed(F.coalesce(value, F.lit("")))
    first = F.lower(F.regexp_extract(text, r"[A-Za-z]+", 0))
    return (text != "") & ~F.contains(text, F.lit("?")) & (first != "") & ~first.isin(STEM_STARTERS)


def stored_path(value: Column) -> Column:
    """A relative storage key, or null for absolute paths, traversal and odd characters."""
    p = trimmed(value)
    safe = F.forall(F.split(p, "/"), lambda s: s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"))
    return F.when((p != "") & safe & (F.element_at(F.split(p, "/"), -1) != "_manifest.json"), p)


def loadable_image(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    figure = F.contains(path, F.lit("/generated/")) | F.contains(name, F.lit("fig-")) | F.contains(name, F.lit("-block."))
    return name.rlike(r"(?i)\.(jpe?g|png|webp|svg)$") & figure


def numbered_heads(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*\(?\d{1,3}\s*[.)]")))


def marker_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(OPTION_MARKER))


def unclosed_math(text: Column) -> Column:
    return F.regexp_count(F.replace(text, F.lit("$$"), F.lit("")), F.lit(r"\$")) % 2 == 1


def currency_suspect(text: Column) -> Column:
    odd = text.rlike(r"\b(?:7s|R5)\b") | text.rlike(r"(?:^|[^\d])7\s+\d{2,}(?:\.\d+)?\b") | text.rlike(r"(?:^|[^\d])7\.\d{2}\b")
    return text.rlike(MONEY_WORD) & odd


def partial_stem(number: Column, stem: Column) -> Column:
    s = trimmed(stem)
    short = (F.length(s) < 8) & ~s.rlike(r"[.?!]$") & ~(s.rlike(r"^[\d\s.+\-×xX÷=/?()]+$") & (F.length(s) >= 3))
    return (trimmed(F.coalesce(number, F.lit(""))) != "") & (s.rlike(r"[A-Za-z]-$") | short)


def option_bodies(text: Column) -> Column:
    """What stands behind each (a) to (h), if there are two or more."""
    parts = F.split(text, r"\([A-Ha-h]\)\s*")
    bodies = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), trimmed)
    return F.when(F.size(parts) >= 3, bodies).otherwise(F.array().cast("array<string>"))


def math_smashed(text: Column) -> Column:
    """Options like 3,5 or 3'5 twice, or a line with four small integers and an operator."""
    messy = F.size(F.filter(option_bodies(text), lambda b: b.rlike(r"\d\s*[,']\s*\d")))
    lines = F.exists(F.split(text, "\n"), lambda s: (F.regexp_count(s, F.lit(r"\b\d{1,2}\b")) >= 4) & s.rlike(r"[+×xX÷=]"))
    return (messy >= 2) | lines


def missing_options(kind: Column, stem: Column, options: Column) -> Column:
    """Fewer than two filled options where the question shows signs of being multiple choice."""
    filled = F.size(F.filter(options, lambda o: trimmed(o) != ""))
    return (filled < 2) & (kind.isin("mcq", "multi_select") | stem.rlike(MCQ_PROMPT) | (marker_count(stem) >= 2))


def audit_flags(kind: Column, number: Column, stem: Column, options: Column) -> Column:
    """The names of the checks that a question fails, in their fixed order."""
    combined = F.concat_ws("\n", F.nullif(stem, F.lit("")), F.nullif(F.array_join(options, "\n"), F.lit("")))
    keyed = F.transform(options, lambda o, i: F.concat(F.lit("("), F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(") "), o))
    math = F.concat_ws("\n", stem, F.array_join(keyed, "\n"))
    flags = F.array(
        F.when(marker_count(stem) >= 2, "options_in_stem"),
        F.when(missing_options(kind, stem, options), "missing_options"),
        F.when(math_smashed(math) | unclosed_math(combined), "broken_math"),
        F.when(currency_suspect(combined), "suspicious_currency"),
        F.when(partial_stem(number, stem), "partial_stem"),
    )
    return F.array_compact(flags)


def scope_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def alert_kind(reason: Column) -> Column:
    return (
        F.when(F.contains(reason, F.lit("No approved past-paper questions")), "no_references")
        .when(F.contains(reason, F.lit("produced no questions")), "no_cases")
        .when(F.contains(reason, F.lit("passed only")), "low_pass_rate")
        .when(F.contains(reason, F.lit("could not be judged")), "judge_unavailable")
    )


def truncated(s: Column, most: int = 60_000) -> Column:
    n = F.length(s)
    note = F.concat(F.lit("\n…[truncated "), (n - most).cast("string"), F.lit(" chars]"))
    return F.when(n > most, F.concat(F.substring(s, 1, most), note)).otherwise(s)


#: Words of errors that a new try may mend; fixed values.
TRANSIENT = r"(?i)fetch failed|network|ECONNRESET|ECONNREFUSED|ETIMEDOUT|EAI_AGAIN|socket hang up|und_err|aborted|timed?\s*out"


def transient_error(message: Column) -> Column:
    return message.rlike(TRANSIENT)


def choose_transcript(plain: Column, *others: Column) -> Column:
    """The last of the readings that is no thinner than six tenths of the one chosen before it and loses no numbered head; else the plain one."""
    chosen = plain
    for other in others:
        fuller = (F.coalesce(other, F.lit("")) != "") & (F.length(other) >= 0.6 * F.length(chosen)) & (numbered_heads(other) >= numbered_heads(chosen))
        chosen = F.when(fuller, other).otherwise(chosen)
    return chosen


def elided(json: Column) -> Column:
    """A JSON text with data urls and the urls of images replaced, so that no image is stored with it."""
    images = F.regexp_replace(json, r'"image_url"\s*:\s*\{[^{}]*"url"[^{}]*\}', '"image_url":{"url":"[image elided]"}')
    return F.regexp_replace(images, r'(?<!\\)"data:(?:[^"\\]|\\.)*"(?!\s*:)', '"[image elided]"')
