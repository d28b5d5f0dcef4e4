"""Ordered rule tables for question types, skills and patterns.

A rule table is data: outcome and condition, first hit wins. Rules are folded into
CASE expressions in chunks, so no generated method grows too long.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_hit(rules: Sequence[tuple[str, Column]], otherwise: str | None = None, chunk: int = 12) -> Column:
    """The outcome of the first rule whose condition holds."""
    parts = []
    for i in range(0, len(rules), chunk):
        part = F.when(rules[i][1], rules[i][0])
        for outcome, condition in rules[i + 1 : i + chunk]:
            part = part.when(condition, outcome)
        parts.append(part)
    return F.coalesce(*parts, F.lit(otherwise))


def question_type(stem: Column, options: Column) -> Column:
    """One of ten types from the wording and the options."""
    low, n = F.lower(stem), F.size(options)
    words = F.transform(options, lambda o: F.lower(F.trim(o)))
    return first_hit(
        [
            ("true_false", (n == 2) & F.array_contains(words, "true") & F.array_contains(words, "false")),
            ("true_false", low.rlike("true or false|state whether") & (n == 0)),
            ("assertion_reason", low.rlike("assertion") & low.rlike("reason")),
            ("match_the_following", low.rlike("match the following|match column")),
            ("mcq", n > 1),
            ("fill_blank", low.rlike("_{2,}|fill in the blank")),
            ("diagram", low.rlike("draw|figure|diagram|shown below")),
            ("numerical", low.rlike("calculate|find the value|evaluate|solve")),
            ("long_answer", F.length(stem) > 180),
        ],
        "short_answer",
    )


#: Words of language lessons; fixed values.
GRAMMAR = (
    r"\bgrammar\b|\btenses?\b|\bprepositions?\b|\barticles?\b|\bactive and passive\b|\breported speech\b|\bparts of speech\b"
    r"|\bsynonyms?\b|\bantonyms?\b|\bsubject[- ]verb\b|\b(?:idiom|phrase)\b"
)
#: The skill rules from the top: skill, patterns that the whole text must all hold, a pattern of the stem, and whether
#: figures must be there (True), must not (False) or do not matter. Fixed values. A few rules have a test of their own besides.
SKILL_RULES: list[tuple[str, tuple[str, ...], str | None, bool | None]] = [
    ("water_image", (r"\bwater\s+image\b|\bwater\s+reflection\b|\breflection\s+in\s+water\b|\breflected\s+in\s+water\b",), None, None),
    ("mirror_image", (r"\bmirror(?:\s|-)?image\b|\bwater\s+image\b|\breflection of the figure\b",), None, None),
    ("mirror_image", (r"\bmirror\b",), None, True),
    ("embedded_figure", (r"exactly embedded",), None, None),
    ("figure_pattern", (r"complete the pattern",), None, None),
    ("figure_analogy", (r"first two question figures",), None, None),
    ("figure_series", (r"option figure that will replace|following series",), None, True),
    ("venn_diagram", (r"relationship between the following elements|\bvenn\b",), None, None),
    ("missing_number_figure", (r"missing number",), None, True),
    ("figure_identity", (), None, None),
    ("matrix_coding", (r"position in the alphabet|matrix coding",), None, None),
    ("syllogism", (r"syllogism|definitely follows",), None, None),
    ("letter_series", (r"letter series|gaps in the given letter|set of letters when sequentially",), None, None),
    ("coding_decoding", (r"coded as|code language|code for|means ['\"]?\d",), None, None),
    ("symbol_operations", (r"means\s*['\"]?[+÷\-x×]",), None, None),
    ("clock_direction", (r"clock", r"minute hand|hour hand"), None, None),
    ("meaningful_order", (r"most meaningful arrangement",), None, None),
    ("blood_relations", (r"brother of|sister of|how is .+ related|female members",), None, None),
    ("symbol_arrangement", (r"consonants and the numbers|study the following arrangement",), None, None),
    ("dictionary_order", (r"order as found in the dictionary|dictionary order",), None, None),
    ("calendar", (r"how many (?:mondays|tuesdays|wednesdays|thursdays|fridays|saturdays|sundays)",), None, None),
    ("odd_one_out", (r"odd element|odd one out",), None, None),
    ("number_analogy", (r"related number",), None, None),
    ("word_analogy", (r"related word",), None, None),
    ("word_formation", (r"cannot be formed using the letters",), None, None),
    ("direction_sense", (r"facing towards|becomes north|in which direction",), None, None),
    ("seating_arrangement", (r"sitting to the|sits second|who is sitting",), None, None),
    ("date_puzzle", (r"birthday|born before|born after",), None, None),
    ("ranking", (r"in a row of \d+",), None, None),
    ("number_series", (r"\bnumber\s+series\b|\bfind the next\b|\bwhat comes next\b|\bmissing number\b",), None, False),
    ("printed_series", (), None, False),
    ("jumbled_sentences", (), r"/[^/]*/[^/]*/", None),
    ("cloze", (), r"__", None),
    ("spelling", (), r"^correct spelling$", None),
    ("one_word_substitution", (), r"^(one who|someone who|one whom)\b", None),
    ("comprehension", (r"who said these words|what lesson did|came to the help",), None, None),
    ("parts_of_speech", (), None, None),
    ("idioms", (GRAMMAR,), r"\bidiom|piece of one's mind|kill two birds|fool's paradise", None),
    ("synonym_antonym", (GRAMMAR, r"\bsynonym|\bantonym|\bopposite to\b|\bopposite in meaning\b"), None, None),
    ("grammar", (GRAMMAR,), None, None),
    ("lone_word", (), r"^\p{L}[\p{L}\s'-]{2,40}$", None),
    (
        "synonym_antonym",
        (
            r"\bopposite (?:word|word to|to|in meaning)\b|\bantonym\b|\bsynonym\b|\bsame meaning\b|\bsame in meaning\b|\bsimilar in meaning\b"
            r"|\bcloses?t in meaning\b",
        ),
        None,
        None,
    ),
    ("compound_interest", (r"compound interest",), None, None),
    ("discount", (r"discount|marked price",), None, None),
    ("probability", (r"probability",), None, None),
    ("statistics", (r"\bmean of\b|\bmedian\b|\bmode of\b",), None, None),
    ("triangle_properties", (r"hypotenuse|pythagoras",), None, None),
    ("quadrilaterals", (r"quadrilateral",), None, None),
    ("parallel_lines", (r"parallel lines|co-interior|transversal",), None, None),
    ("euler_formula", (r"euler",), None, None),
    ("surface_area_volume", (r"surface area|volume of",), None, None),
    ("squares_roots", (r"square root|squared|²",), None, None),
    ("cubes_roots", (r"cube root|cubed|³",), None, None),
    ("rational_numbers", (r"rational number",), None, None),
    ("factorization", (r"factorise|factorize|factorisation",), None, None),
    ("proportion", (r"directly proportional|inversely proportional|inverse proportion|direct proportion",), None, None),
    ("algebraic_identities", (r"suitable identity|\bidentity\b",), None, None),
    ("exponents", (r"\bexponent|\^",), None, None),
    ("graphs", (r"line graph|graph represents|graph of",), None, None),
    ("profit_loss", (r"profit|loss|selling price|cost price",), None, None),
    ("division", (r"dividend|divisor|quotient|remainder",), None, None),
    ("fractions", (r"\bfraction\b",), None, None),
    ("mensuration", (r"rectangle|perimeter|fencing",), None, None),
    ("percentage", (r"percentage|\bpercent\b|% of",), None, None),
    ("ratio_hcf", (r"h\.?c\.?f|ratio of three|simplest form",), None, None),
    ("triangle_area", (r"triangle", r"area|sides"), None, None),
    ("speed_time", (r"km/h|speed of|train leaves|crosses a bridge",), None, None),
    ("factors", (r"factors of|sum of all factors",), None, None),
    ("divisibility", (r"divisible by",), None, None),
    ("average", (r"\baverage\b",), None, None),
    ("simple_interest", (r"simple interest|\bs\.?\s*i\.?\b",), None, None),
    ("angles", (r"quadrilateral|supplementary angle",), None, None),
    ("linear_equation", (r"value of x|equation",), None, None),
    ("work_rate", (r"cows|graze a field",), None, None),
    ("unitary_method", (r"weighs|uniform rod",), None, None),
    ("mean_proportion", (r"mean proportion",), None, None),
    ("rounding", (r"round off|nearest ten",), None, None),
    ("number_formation", (r"largest \d+ digit",), None, None),
    ("metric_measures", (r"metric|decagram|kilogram",), None, None),
    ("general_knowledge", (), r"^(which|who|where|when|what)\b", None),
]
#: Outcomes of rules that go by another name in the table.
RENAMED = {"printed_series": "number_series", "lone_word": "synonym_antonym"}
#: The skills there are; fixed values.
CATALOGUE = (
    "algebraic_identities angles arithmetic average blood_relations bodmas calendar circle clock_direction cloze coding_decoding compound_interest "
    "comprehension counting_triangles critical_thinking cubes_roots data_interpretation date_puzzle decimals dictionary_order direction_sense discount "
    "divisibility division embedded_figure euler_formula exponents factorization factors figure_analogy figure_identity figure_pattern figure_series "
    "fractions general_knowledge grammar graphs idioms jumbled_sentences lcm_hcf letter_series linear_equation matrix_coding mean_proportion "
    "meaningful_order mensuration metric_measures mirror_image missing_number missing_number_figure multiplication number_analogy number_figure "
    "number_formation number_properties number_series odd_one_out one_word_substitution parallel_lines parts_of_speech percentage probability "
    "profit_loss proportion quadrilaterals question_tags ranking ratio_hcf rational_numbers roman_numerals rounding seating_arrangement "
    "sentence_completion simple_interest speed_time spelling spotting_errors squares_roots statistics surface_area_volume syllogism symbol_arrangement "
    "symbol_operations synonym_antonym temperature_conversion triangle_area triangle_properties unitary_method venn_diagram vocabulary volume_solid "
    "water_image word_analogy word_formation work_rate"
).split()
#: Skills that count as figures, and as codes; fixed values.
FIGURE_SKILLS = (
    "mirror_image water_image embedded_figure figure_pattern figure_analogy figure_series figure_identity missing_number_figure "
    "venn_diagram number_figure counting_triangles"
).split()
CODING_SKILLS = "coding_decoding symbol_operations matrix_coding".split()


def is_number_series(stem: Column) -> Column:
    """Four numbers or more and a separator."""
    return (F.regexp_count(stem, F.lit(r"-?\d+(?:\.\d+)?")) >= 4) & stem.rlike(r"[,;]|…|\.\.\.")


def skill(stem: Column, instructions: Column, passage: Column, figures: Column, options: Column, kind: Column) -> Column:
    """The skill a question tests: the first rule that holds, else unsupported. A [skill:x] tag goes first, if the catalogue has x."""
    text = F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (instructions, stem, passage)])
    s = F.trim(F.regexp_replace(F.coalesce(stem, F.lit("")), r"\s+", " "))
    special = {
        "figure_identity": ((kind == "diagram") | (figures > 0)) & (s.rlike("(?i)^question figures?$") | (F.length(s) < 12)),
        "printed_series": is_number_series(s),
        "parts_of_speech": F.lower(F.array_join(options, " ")).rlike(r"\b(adverb|verb|noun|adjective|preposition|conjunction)\b"),
        "lone_word": F.size(options) >= 3,
    }
    rules = []
    for name, patterns, of_stem, with_figures in SKILL_RULES:
        tests = [text.rlike(f"(?i){p}") for p in patterns]
        tests += [s.rlike(f"(?i){of_stem}")] if of_stem else []
        tests += [] if with_figures is None else [figures > 0 if with_figures else figures == 0]
        tests += [special[name]] if name in special else []
        rules.append((RENAMED.get(name, name), reduce(and_, tests)))
    tag = F.lower(F.regexp_extract(text, r"(?i)\[skill:([a-z0-9_]+)\]", 1))
    return F.coalesce(F.when(tag.isin(CATALOGUE), tag), first_hit(rules, "unsupported"))


def pattern_type(skill_type: Column, family: Column) -> Column:
    """The coarse kind of a skill, by sets and then by the skill's family."""
    return first_hit(
        [
            ("unknown", F.coalesce(skill_type, F.lit("")) == ""),
            ("figure_pattern", skill_type.isin(FIGURE_SKILLS)),
            ("number_series", skill_type == "number_series"),
            ("letter_series", skill_type == "letter_series"),
            ("coding", skill_type.isin(CODING_SKILLS)),
            ("knowledge", skill_type == "general_knowledge"),
            ("arithmetic", family == "math"),
            ("language", family == "textual"),
            ("verbal_reasoning", family == "intelligence"),
        ],
        "unknown",
    )


def series_subtype(stem: Column) -> Column:
    """arithmetic, geometric or two_step for four numbers or more, ordinals aside; else number_series."""
    clean = F.regexp_replace(F.coalesce(stem, F.lit("")), r"(?i)\d+\s*(?:st|nd|rd|th)\b", " ")
    n = F.transform(F.regexp_extract_all(clean, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    later = F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(1)))
    before = F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(1)))
    diffs = F.zip_with(later, before, lambda a, b: a - b)
    ratios = F.zip_with(later, before, lambda a, b: F.try_divide(a, b))
    level = lambda x: F.forall(x, lambda d: F.abs(d - F.get(x, 0)) < 1e-9)
    return (
        F.when(F.size(n) < 4, "number_series")
        .when(level(diffs), "arithmetic")
        .when(F.forall(n, lambda v: v != 0) & level(ratios), "geometric")
        .otherwise("two_step")
    )


def pattern_subtype(skill_type: Column, stem: Column, instructions: Column) -> Column:
    """The fine variant of a skill's pattern, by its wording."""
    s = F.coalesce(skill_type, F.lit("unknown"))
    text = F.lower(F.concat(F.coalesce(stem, F.lit("")), F.lit("\n"), F.coalesce(instructions, F.lit(""))))
    pair, figure = s == "synonym_antonym", s.isin("figure_pattern", "missing_number_figure")
    return F.coalesce(
        F.when(s == "mirror_image", F.when(F.contains(text, F.lit("water")), "water").otherwise("vertical"))
        .when(s == "water_image", "water")
        .when(s == "number_series", series_subtype(stem))
        .when(pair & text.rlike("opposite|antonym"), "antonym")
        .when(pair & text.rlike("synonym|same meaning|similar meaning|same in meaning"), "synonym")
        .when(figure & text.rlike("mirror|reflection"), "mirror")
        .when(figure & text.rlike("embedded|hidden"), "embedded")
        .when(figure & text.rlike("missing number"), "missing")
        .when(figure & text.rlike("rotat|turned"), "rotation")
        .when(figure & text.rlike("complete the pattern|pattern completion"), "completion")
        .when(figure, "figure_pattern"),
        s,
    )


def export_type(kind: Column, options: Column) -> Column:
    """The eight types of the export."""
    fixed = {
        "mcq": "mcq_single", "multi_select": "mcq_multi", "true_false": "true_false", "fill_blank": "fill_blank", "assertion_reason": "assertion_reason",
        "comprehension": "comprehension", "match_the_following": "matching", "short_answer": "short_answer", "long_answer": "short_answer", "numerical": "short_answer",
    }
    return first_hit([(out, kind == k) for k, out in fixed.items()] + [("mcq_single", F.size(options) > 0)], "short_answer")
