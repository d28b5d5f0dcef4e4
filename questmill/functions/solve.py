"""Closed-form solvers for arithmetic, reasoning and language specs, as Column expressions.

A spec is a JSON text with a skill and its numbers. Each solver reads what it needs
and yields null for specs it cannot answer exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from questmill.functions.ids import gcd, is_prime, lcm, roman

RUPEE, DEGREE = "₹", "°"


class Spec:
    """The fields of a spec, parsed once to a map of texts."""

    def __init__(self, fields: Column):
        self.fields = fields

    def text(self, key: str) -> Column:
        return F.try_element_at(self.fields, F.lit(key))

    def n(self, key: str) -> Column:
        """An integer field; null for anything else."""
        return F.when(self.text(key).rlike(r"^-?\d+$"), self.text(key).try_cast("bigint"))

    def ns(self, key: str) -> Column:
        return F.from_json(self.text(key), "array<bigint>")

    def words(self, key: str) -> Column:
        return F.from_json(self.text(key), "array<string>")


def _s(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def _whole(a: Column, b: Column) -> Column:
    """a / b where it divides."""
    return F.when((b != 0) & (F.try_mod(a, b) == 0), F.try_divide(a, b).cast("bigint"))


def fraction(top: Column, bottom: Column) -> Column:
    """A reduced fraction; whole numbers without a denominator. The sign is the numerator's."""
    g = F.greatest(gcd(F.abs(top), F.abs(bottom)), F.lit(1))
    t, b = F.floor(top / g), F.floor(F.abs(bottom) / g)
    t = F.when(top < 0, -F.floor(F.abs(top) / g)).otherwise(t)
    return F.when(bottom != 0, F.when(b == 1, _s(t)).otherwise(F.concat(_s(t), F.lit("/"), _s(b))))


def _root(x: Column) -> Column:
    r = F.round(F.sqrt(x.cast("double"))).cast("bigint")
    return F.when((x >= 0) & (r * r == x), r)


def _cube_root(x: Column) -> Column:
    r = F.round(F.cbrt(x.cast("double"))).cast("bigint")
    return F.when(r * r * r == x, r)


def _unit(x: Column, after: str = "", before: str = "") -> Column:
    return F.concat(F.lit(before), _s(x), F.lit(after))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _shifted(word: Column, by: Column) -> Column:
    letters = F.filter(F.split(word, ""), lambda x: x != "")
    return F.array_join(F.transform(letters, lambda x: F.char(F.pmod(F.ascii(x) - 65 + by, F.lit(26)) + 65)), "")


def _share(spec: Spec, whole: int) -> Column:
    ratio = spec.ns("ratio")
    return _unit(_whole(F.array_max(ratio) * whole, _sum(ratio)), DEGREE)


def _power(base: Column, n: Column) -> Column:
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>")), F.lit(1).cast("bigint"), lambda a, _: a * base)


def _mode(xs: Column) -> Column:
    """The value that occurs most often, if it is one."""
    distinct = F.array_distinct(xs)
    counts = F.transform(distinct, lambda v: F.struct(F.size(F.filter(xs, lambda x: x == v)).alias("n"), v.alias("v")))
    top = F.array_max(F.transform(counts, lambda c: c["n"]))
    best = F.filter(counts, lambda c: c["n"] == top)
    return F.when(F.size(best) == 1, F.get(best, 0)["v"])


def _median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    mid = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, mid)).otherwise(_whole(F.get(s, mid) + F.get(s, mid - 1), F.lit(2)))


def _single(xs: Column) -> Column:
    return F.when(F.size(xs) == 1, _s(F.get(xs, 0)))


def _by(spec: Spec, key: str, cases: dict[str, Column], otherwise: Column | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for value, column in cases.items():
        out = out.when(spec.text(key) == value, column)
    return out if otherwise is None else out.otherwise(otherwise)


#: Tags of the numbered statements; fixed values.
QUESTION_TAGS = ("isn't she", "haven't they", "can't he", "don't you", "isn't it", "shouldn't we")


def _clock(hour: Column) -> Column:
    """Where an hour hand points: the four quarters, and the ways between."""
    between = F.get(F.array(*map(F.lit, ("NE", "SE", "SW", "NW"))), F.floor(hour / 3).cast("int"))
    straight = F.get(F.array(*map(F.lit, ("North", "East", "South", "West"))), F.floor(F.pmod(hour, F.lit(12)) / 3).cast("int"))
    return F.when(hour.between(1, 12), F.when(hour % 3 == 0, straight).otherwise(between))


def _odd_one(xs: Column, rule: Column) -> Column:
    """The one of four different numbers that is no multiple of 2 or 3, where the others are."""
    odd = F.filter(xs, lambda x: x % rule != 0)
    return F.when(rule.isin(2, 3) & (F.size(xs) == 4) & (F.size(F.array_distinct(xs)) == 4), _single(odd))


SOLVERS: dict[str, Callable[[Spec], Column]] = {
    "letter_series": lambda s: F.char(F.pmod(F.ascii(s.text("start")) - 65 + s.n("step") * s.n("shown"), F.lit(26)) + 65),
    "coding_decoding": lambda s: _shifted(s.text("word"), s.n("shift")),
    "calendar": lambda s: F.date_format(F.make_date(s.n("year").cast("int"), s.n("month").cast("int"), s.n("day").cast("int")), "EEEE"),
    "ranking": lambda s: _s(s.n("total") - s.n("fromLeft") + 1),
    "symbol_operations": lambda s: _s(s.n("left") + s.n("right") + s.n("add")),
    "percentage": lambda s: _s(_whole(s.n("whole") * s.n("percent"), F.lit(100))),
    "profit_loss": lambda s: _s(s.n("cost") + _whole(s.n("cost") * s.n("gain"), F.lit(100))),
    "average": lambda s: _s(_whole(_sum(s.ns("values")), F.size(s.ns("values")))),
    "simple_interest": lambda s: _s(_whole(s.n("principal") * s.n("rate") * s.n("years"), F.lit(100))),
    "fractions": lambda s: fraction(s.n("n1") * s.n("d2") + s.n("n2") * s.n("d1"), s.n("d1") * s.n("d2")),
    "rational_numbers": lambda s: fraction(s.n("n1") * s.n("d2") + s.n("n2") * s.n("d1"), s.n("d1") * s.n("d2")),
    "division": lambda s: _s(_whole(s.n("dividend"), s.n("divisor"))),
    "number_formation": lambda s: F.array_join(F.sort_array(s.ns("digits"), False).cast("array<string>"), ""),
    "multiplication": lambda s: _s(s.n("left") * s.n("right")),
    "rounding": lambda s: F.when(s.n("place") != 0, _s(F.floor(s.n("value") / s.n("place") + 0.5) * s.n("place"))),
    "speed_time": lambda s: _unit(s.n("speed") * s.n("hours"), " km"),
    "unitary_method": lambda s: _unit(_whole(s.n("cost"), s.n("items")), before=RUPEE),
    "factors": lambda s: F.when(s.n("value") >= 1, _s(_sum(F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(s.n("value"), F.lit(1))), lambda k: s.n("value") % k == 0)))),
    "divisibility": lambda s: F.when(s.n("divisor") != 0, _s(F.try_mod(s.n("value"), s.n("divisor")))),
    "mensuration": lambda s: _unit(s.n("length") * s.n("width"), " sq cm"),
    "angles": lambda s: _unit(180 - s.n("angle"), DEGREE),
    "parallel_lines": lambda s: _unit(180 - s.n("angle"), DEGREE),
    "linear_equation": lambda s: _s(_whole(s.n("total") - s.n("added"), s.n("coefficient"))),
    "work_rate": lambda s: fraction(s.n("used"), s.n("days")),
    "mean_proportion": lambda s: _s(_root(s.n("left") * s.n("right"))),
    "metric_measures": lambda s: _s(s.n("kilograms") * 1000),
    "ratio_hcf": lambda s: _s(F.greatest(gcd(F.abs(s.n("left")), F.abs(s.n("right"))), F.lit(1))),
    "triangle_area": lambda s: _unit(_whole(s.n("base") * s.n("height"), F.lit(2)), " sq cm"),
    "date_puzzle": lambda s: F.when(s.n("day") > s.n("before"), F.concat(_s(s.n("day") - s.n("before")), F.lit(" "), F.date_format(F.make_date(F.lit(2024), s.n("month").cast("int"), F.lit(1)), "MMMM"))),
    "dictionary_order": lambda s: F.when((F.size(F.array_distinct(s.words("words"))) == 4) & F.forall(s.words("words"), lambda w: w.rlike("^[a-z]+$")), F.array_join(F.array_sort(s.words("words")), ", ")),
    "number_properties": lambda s: _single(F.filter(s.ns("values"), lambda v: is_prime(v) == (s.text("wantPrime") == "true"))),
    "roman_numerals": lambda s: F.when(s.n("value") >= 1, roman(s.n("value"))),
    "lcm_hcf": lambda s: _s(_by(s, "rule", {"lcm": lcm(s.n("left"), s.n("right")).cast("string")}, gcd(s.n("left"), s.n("right")).cast("string"))),
    "bodmas": lambda s: _s(s.n("a") + s.n("b") * s.n("c") - _whole(s.n("d"), s.n("e"))),
    "decimals": lambda s: F.format_string("%.2f", (s.n("aCents") + s.n("bCents")) / 100.0),
    "circle": lambda s: F.when(s.n("radius") % 7 == 0, _by(s, "rule", {"area": _unit(22 * s.n("radius") * s.n("radius") / 7, " sq cm")}, _unit(44 * s.n("radius") / 7, " cm"))),
    "volume_solid": lambda s: _by(s, "solid", {"cube": _unit(s.n("side") * s.n("side") * s.n("side"), " cu cm")}, _unit(s.n("length") * s.n("breadth") * s.n("height"), " cu cm")),
    "temperature_conversion": lambda s: _by(s, "direction", {"c2f": F.concat(F.regexp_replace((s.n("value") * 9 / 5 + 32).cast("string"), r"\.0$", ""), F.lit("°F")), "f2c": _unit(_whole((s.n("value") - 32) * 5, F.lit(9)), "°C")}),
    "squares_roots": lambda s: _s(_by(s, "rule", {"sqrt": _root(s.n("value")).cast("string")}, (s.n("value") * s.n("value")).cast("string"))),
    "cubes_roots": lambda s: _s(_by(s, "rule", {"cbrt": _cube_root(s.n("value")).cast("string")}, (s.n("value") * s.n("value") * s.n("value")).cast("string"))),
    "algebraic_identities": lambda s: _s(_by(s, "rule", {"diff_squares": (s.n("base") * s.n("base") - 1).cast("string")}, ((s.n("base") + s.n("delta")) * (s.n("base") + s.n("delta"))).cast("string"))),
    "factorization": lambda s: F.concat(F.lit("(x + "), _s(s.n("p")), F.lit(")(x + "), _s(s.n("q")), F.lit(")")),
    "exponents": lambda s: _s(_power(s.n("base"), _by(s, "rule", {"multiply": _s(s.n("m") + s.n("n")), "divide": F.when(s.n("m") >= s.n("n"), _s(s.n("m") - s.n("n")))}, _s(s.n("m") * s.n("n"))).cast("bigint"))),
    "proportion": lambda s: _by(s, "rule", {"direct": F.when(s.n("c") != 0, _unit(s.n("b") * s.n("c"), before=RUPEE))}, _unit(_whole(s.n("a") * s.n("b"), s.n("c")), " days")),
    "quadrilaterals": lambda s: _share(s, 360),
    "triangle_properties": lambda s: _by(s, "rule", {"angle_ratio": _share(s, 180)}, _unit(_root(s.n("a") * s.n("a") + s.n("b") * s.n("b")), " cm")),
    "euler_formula": lambda s: _s(s.n("faces") + s.n("vertices") - 2),
    "surface_area_volume": lambda s: _by(
        s, "solid",
        {"cube": _by(s, "rule", {"volume": _unit(s.n("side") * s.n("side") * s.n("side"), " cu cm")}, _unit(6 * s.n("side") * s.n("side"), " sq cm"))},
        _by(s, "rule", {"volume": _unit(s.n("length") * s.n("breadth") * s.n("height"), " cu cm")}, _unit(2 * (s.n("length") * s.n("breadth") + s.n("breadth") * s.n("height") + s.n("height") * s.n("length")), " sq cm")),
    ),
    "discount": lambda s: F.concat(F.lit(RUPEE), F.regexp_replace((s.n("marked") - s.n("marked") * s.n("percent") / 100).cast("string"), r"\.0$", "")),
    "compound_interest": lambda s: F.when(s.n("years") >= 1, _unit(_whole(s.n("principal") * _power(100 + s.n("rate"), s.n("years")), _power(F.lit(100).cast("bigint"), s.n("years"))) - s.n("principal"), before=RUPEE)),
    "statistics": lambda s: _by(s, "rule", {"mean": _s(_whole(_sum(s.ns("values")), F.size(s.ns("values")))), "median": _s(_median(s.ns("values")))}, _s(_mode(s.ns("values")))),
    "probability": lambda s: fraction(s.n("red"), s.n("red") + s.n("blue")),
    "data_interpretation": lambda s: _by(s, "rule", {"total": _s(_sum(s.ns("values")))}, F.get(s.words("labels"), F.array_position(s.ns("values"), F.array_max(s.ns("values"))).cast("int") - 1)),
    "graphs": lambda s: _s(s.n("slope") * s.n("x") + s.n("intercept")),
    "matrix_coding": lambda s: F.when(s.text("word").rlike("^[A-Z]+$"), F.array_join(F.transform(F.filter(F.split(s.text("word"), ""), lambda x: x != ""), lambda x: (F.ascii(x) - 64).cast("string")), "-")),
    "clock_direction": lambda s: _clock(s.n("hour")),
    "odd_one_out": lambda s: _odd_one(s.ns("values"), s.n("rule")),
    "question_tags": lambda s: F.get(F.array(*map(F.lit, QUESTION_TAGS)), s.n("index").cast("int")),
    "syllogism": lambda s: F.concat(F.lit("All "), s.text("a"), F.lit(" are "), s.text("c"), F.lit(".")),
}


def solve(fields: Column, skills: list[str] | None = None) -> Column:
    """The answer to a spec given as a map of texts (see parsed), or null. Only the named skills are compiled in, if given."""
    s = Spec(fields)
    skill = s.text("skill")
    names = list(SOLVERS) if skills is None else skills
    parts = []
    for i in range(0, len(names), 6):
        part = F.when(skill == names[i], SOLVERS[names[i]](s))
        for name in names[i + 1 : i + 6]:
            part = part.when(skill == name, SOLVERS[name](s))
        parts.append(part)
    return F.coalesce(*parts)


def parsed(spec: Column) -> Column:
    """A JSON spec as a map of texts; null if it is no object."""
    return F.from_json(spec, "map<string,string>")
