"""Seeded questions for every skill that has a solver, as Column expressions.

Each builder draws its numbers from a stream of its row's seed, so a seed gives the
same question wherever and whenever it runs. Most draw the answer first and make the
numbers from it, so that the answer is whole; it is not taken from the solver, which
checks it afterwards. Wrong options are drawn from near values or from a pool, without
clashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from questmill.functions.ids import lcm, roman
from questmill.functions.solve import DEGREE, QUESTION_TAGS, RUPEE, _power, fraction
from questmill.functions.text import let

WORDS = ["TABLE", "RIVER", "STONE", "CLOUD", "BRICK", "PLANT", "HORSE", "LEMON", "TIGER", "BREAD"]
PLAIN_WORDS = ["anchor", "basket", "candle", "dragon", "engine", "forest", "garden", "hammer", "island", "jungle", "kettle", "ladder"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WINDS = ["North", "East", "South", "West", "NE", "SE", "SW", "NW"]
GROUPS = [("roses", "flowers", "plants"), ("sparrows", "birds", "animals"), ("squares", "rectangles", "figures"), ("violins", "instruments", "objects")]
STATEMENTS = dict(enumerate(("She is a doctor", "They have finished", "He can swim", "You like tea", "It is raining", "We should rest now")))


@dataclass
class Built:
    """A question before it has options: fields of the spec, stem, answer, and what wrong options are drawn from if not from near numbers."""

    fields: dict[str, Column | str | int]
    stem: Column
    answer: Column
    pool: Column | None = None


class Stream:
    """Draws of one row: the k-th is the same for the same seed."""

    def __init__(self, seed: Column):
        self.seed, self.k = seed, 0

    def n(self, low: int, high: int) -> Column:
        """A whole number from low to high."""
        self.k += 1
        return F.pmod(F.xxhash64(self.seed, F.lit(self.k)), F.lit(high - low + 1)).cast("bigint") + low

    def one(self, values: list[str]) -> Column:
        return F.get(F.array(*map(F.lit, values)), self.n(0, len(values) - 1).cast("int"))

    def several(self, values: list[str], count: int) -> Column:
        """Some of the values, none twice, in an order of the seed."""
        self.k += 1
        k = self.k
        ranked = F.array_sort(F.transform(F.array(*map(F.lit, values)), lambda v: F.struct(F.xxhash64(self.seed, F.lit(k), v).alias("h"), v.alias("v"))))
        return F.slice(F.transform(ranked, lambda x: x["v"]), 1, count)


def t(x: Column | str | int) -> Column:
    """A value as text, arrays as JSON."""
    return F.lit(str(x)) if isinstance(x, (str, int)) else x.cast("string")


def js(*xs: Column) -> Column:
    return F.to_json(F.array(*xs))


def say(template: str, **values: Column | str | int) -> Column:
    """A text with values in their places."""
    parts, rest = [], template
    while rest:
        head, _, rest = rest.partition("{")
        parts.append(F.lit(head))
        if rest:
            name, _, rest = rest.partition("}")
            parts.append(t(values[name]))
    return F.concat(*parts)


def _listed(xs: Column, by: str = ", ") -> Column:
    return F.array_join(xs, by)


def _letter(start: Column, k: Column) -> Column:
    return F.char(F.pmod(start + k, F.lit(26)) + 65)


def _moved(word: Column, by: Column) -> Column:
    """A word of capitals whose letters move on in the alphabet."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letters = F.filter(F.split(word, ""), lambda x: x != "")
    return F.array_join(F.transform(letters, lambda x: F.substr(F.lit(alphabet * 2), (F.instr(F.lit(alphabet), x) + F.pmod(by, F.lit(26))).cast("int"), F.lit(1))), "")


def letter_series(r: Stream) -> Built:
    start, step = r.n(0, 9), r.n(1, 4)
    at = lambda k: _letter(start, step * k)
    pool = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: _letter(start, step * 4 + k))
    return Built({"start": _letter(start, F.lit(0)), "step": step, "shown": 4}, say("Which letter continues {a}, {b}, {c}, {d}, ___?", a=at(F.lit(0)), b=at(F.lit(1)), c=at(F.lit(2)), d=at(F.lit(3))), at(F.lit(4)), pool)


def coding_decoding(r: Stream) -> Built:
    word, shift = r.one(WORDS), r.n(1, 5)
    pool = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: _moved(word, shift + k))
    return Built({"word": word, "shift": shift}, say("A code moves every letter on by {s}. How is {w} written in it?", s=shift, w=word), _moved(word, shift), pool)


def calendar(r: Stream) -> Built:
    year, month, day = r.n(2001, 2099), r.n(1, 12), r.n(1, 28)
    date = F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))
    monday = F.lit("1900-01-01").cast("date")  # a Monday
    answer = F.get(F.array(*map(F.lit, WEEKDAYS)), F.pmod(F.date_diff(date, monday), F.lit(7)))
    return Built({"year": year, "month": month, "day": day}, say("Which weekday is {d}?", d=F.date_format(date, "d MMMM yyyy")), answer, F.array(*map(F.lit, WEEKDAYS)))


def ranking(r: Stream) -> Built:
    left, right = r.n(2, 20), r.n(2, 20)
    return Built({"total": left + right - 1, "fromLeft": left}, say("Of {n} children in a row, Asha has {k} before her on the left. Which place is hers from the right?", n=left + right - 1, k=left - 1), t(right))


def symbol_operations(r: Stream) -> Built:
    a, b, c = r.n(2, 30), r.n(2, 30), r.n(1, 9)
    return Built({"left": a, "right": b, "add": c}, say("If p # q means p + q + {c}, what is {a} # {b}?", a=a, b=b, c=c), t(a + b + c))


def percentage(r: Stream) -> Built:
    unit, percent = r.n(1, 20), r.n(1, 19) * 5
    return Built({"whole": unit * 20, "percent": percent}, say("What is {p}% of {w}?", p=percent, w=unit * 20), t((unit * percent / 5).cast("bigint")))


def profit_loss(r: Stream) -> Built:
    unit, gain = r.n(2, 30), r.n(1, 12) * 5
    return Built({"cost": unit * 20, "gain": gain}, say("A lamp bought for {r}{c} is sold at a gain of {g}%. For how many rupees?", r=RUPEE, c=unit * 20, g=gain), t((unit * (100 + gain) / 5).cast("bigint")))


def average(r: Stream) -> Built:
    mean, a, b = r.n(20, 60), r.n(1, 15), r.n(1, 15)
    xs = [mean - a, mean + a + b, mean - b, mean]
    return Built({"values": js(*xs)}, say("Find the average of {xs}.", xs=_listed(F.array(*xs).cast("array<string>"))), t(mean))


def simple_interest(r: Stream) -> Built:
    hundreds, rate, years = r.n(2, 40), r.n(2, 12), r.n(1, 6)
    return Built({"principal": hundreds * 100, "rate": rate, "years": years}, say("Find the simple interest on {r}{p} at {q}% a year for {y} years.", r=RUPEE, p=hundreds * 100, q=rate, y=years), t(hundreds * rate * years))


def _sum_of_fractions(r: Stream, low: int) -> Built:
    n1, d1, n2, d2 = r.n(low, 9), r.n(2, 9), r.n(1, 9), r.n(2, 9)
    common = lcm(d1, d2)
    top = (n1 * common / d1 + n2 * common / d2).cast("bigint")
    return Built({"n1": n1, "d1": d1, "n2": n2, "d2": d2}, say("Add {a}/{b} and {c}/{d}.", a=n1, b=d1, c=n2, d=d2), fraction(top, common))


def division(r: Stream) -> Built:
    q, d = r.n(3, 99), r.n(2, 19)
    return Built({"dividend": q * d, "divisor": d}, say("Divide {a} by {b}.", a=q * d, b=d), t(q))


def number_formation(r: Stream) -> Built:
    digits = r.several([str(k) for k in range(1, 10)], 4)
    down = F.reverse(F.array_sort(digits))
    pool = F.array(F.array_join(F.reverse(down), ""), *[F.array_join(F.array(*[F.get(down, k) for k in order]), "") for order in ((0, 1, 3, 2), (1, 0, 2, 3), (0, 2, 1, 3), (3, 0, 1, 2))])
    return Built({"digits": F.to_json(digits.cast("array<bigint>"))}, say("Form the greatest number from the digits {d}, each used once.", d=_listed(digits)), F.array_join(down, ""), pool)


def multiplication(r: Stream) -> Built:
    a, b = r.n(6, 60), r.n(3, 30)
    return Built({"left": a, "right": b}, say("Multiply {a} by {b}.", a=a, b=b), t(F.aggregate(F.sequence(F.lit(1).cast("bigint"), b), F.lit(0).cast("bigint"), lambda x, _: x + a)))


def rounding(r: Stream) -> Built:
    tens, rest, place = r.n(10, 900), r.n(0, 9), F.lit(10).cast("bigint")
    return Built({"value": tens * 10 + rest, "place": 10}, say("Round {v} to the nearest ten.", v=tens * 10 + rest), t((tens + (rest >= 5).cast("bigint")) * place))


def speed_time(r: Stream) -> Built:
    v, h = r.n(20, 90), r.n(2, 9)
    return Built({"speed": v, "hours": h}, say("How far does a bus go in {h} hours at {v} km an hour?", h=h, v=v), say("{d} km", d=v * h))


def unitary_method(r: Stream) -> Built:
    each, items = r.n(4, 60), r.n(3, 15)
    return Built({"items": items, "cost": each * items}, say("{n} pencils cost {r}{c}. What does one cost?", n=items, r=RUPEE, c=each * items), say("{r}{e}", r=RUPEE, e=each))


def factors(r: Stream) -> Built:
    p, q = F.get(F.array(*[F.lit(k).cast("bigint") for k in (2, 3, 5, 7)]), r.n(0, 3).cast("int")), F.get(F.array(*[F.lit(k).cast("bigint") for k in (11, 13, 17, 19)]), r.n(0, 3).cast("int"))
    return Built({"value": p * q}, say("What is the sum of all factors of {v}?", v=p * q), t((p + 1) * (q + 1)))


def divisibility(r: Stream) -> Built:
    d, q = r.n(3, 12), r.n(5, 90)
    rest = F.pmod(r.n(0, 999), d)
    return Built({"value": d * q + rest, "divisor": d}, say("What remains when {v} is divided by {d}?", v=d * q + rest, d=d), t(rest))


def mensuration(r: Stream) -> Built:
    a, b = r.n(4, 40), r.n(3, 30)
    return Built({"length": a, "width": b}, say("Find the area of a rectangle of {a} cm by {b} cm.", a=a, b=b), say("{x} sq cm", x=a * b))


def _supplement(r: Stream, text: str) -> Built:
    other = r.n(15, 165)
    return Built({"angle": 180 - other}, say(text, a=180 - other, d=DEGREE), say("{x}{d}", x=other, d=DEGREE))


def linear_equation(r: Stream) -> Built:
    x, k, c = r.n(2, 30), r.n(2, 9), r.n(1, 40)
    return Built({"coefficient": k, "added": c, "total": k * x + c}, say("Solve {k}x + {c} = {s} for x.", k=k, c=c, s=k * x + c), t(x))


def work_rate(r: Stream) -> Built:
    used, more = r.n(1, 8), r.n(1, 12)
    return Built({"days": used + more, "used": used}, say("A tank is filled in {n} days. Which part is full after {k} days?", n=used + more, k=used), fraction(used, used + more))


def mean_proportion(r: Stream) -> Built:
    a, b, k = r.n(2, 9), r.n(2, 9), r.n(1, 5)
    return Built({"left": a * a * k, "right": b * b * k}, say("Find the mean proportional of {a} and {b}.", a=a * a * k, b=b * b * k), t(a * b * k))


def metric_measures(r: Stream) -> Built:
    kg = r.n(2, 60)
    return Built({"kilograms": kg}, say("How many grams are {k} kg?", k=kg), F.concat(t(kg), F.lit("000")))


def ratio_hcf(r: Stream) -> Built:
    g, a = r.n(2, 20), r.n(2, 9)
    return Built({"left": g * a, "right": g * (a + 1)}, say("By which greatest number can both terms of {a} : {b} be divided?", a=g * a, b=g * (a + 1)), t(g))


def triangle_area(r: Stream) -> Built:
    half, h = r.n(2, 25), r.n(3, 30)
    return Built({"base": half * 2, "height": h}, say("A triangle has a base of {b} cm and a height of {h} cm. Find its area.", b=half * 2, h=h), say("{x} sq cm", x=half * h))


MONTHS = "January February March April May June July August September October November December".split()


def date_puzzle(r: Stream) -> Built:
    answer, before, month = r.n(1, 14), r.n(1, 14), r.n(1, 12)
    name = F.get(F.array(*map(F.lit, MONTHS)), (month - 1).cast("int"))
    return Built({"day": answer + before, "before": before, "month": month}, say("Ravi was born {b} days before {d} {m}. When?", b=before, d=answer + before, m=name), say("{a} {m}", a=answer, m=name))


def clock_direction(r: Stream) -> Built:
    quarter, way = r.n(0, 3), r.n(0, 2)
    hour = quarter * 3 + way
    straight = F.get(F.array(*map(F.lit, WINDS[:4])), quarter.cast("int"))
    between = F.get(F.array(*map(F.lit, WINDS[4:])), quarter.cast("int"))
    hour = F.when(hour == 0, F.lit(12).cast("bigint")).otherwise(hour)
    return Built({"hour": hour}, say("On a clock 12 is north and 3 is east. Where does the hour hand point at {h} o'clock?", h=hour), F.when(way == 0, straight).otherwise(between), F.array(*map(F.lit, WINDS)))


def dictionary_order(r: Stream) -> Built:
    words = r.several(PLAIN_WORDS, 4)
    up = F.array_sort(words)
    pool = F.array(*[_listed(F.array(*[F.get(up, k) for k in order])) for order in ((3, 2, 1, 0), (1, 0, 2, 3), (0, 2, 1, 3), (0, 1, 3, 2))])
    return Built({"words": F.to_json(words)}, say("Put in dictionary order: {w}.", w=_listed(words)), _listed(up), pool)


def odd_one_out(r: Stream) -> Built:
    rule, start, k, slot = r.n(2, 3), r.n(2, 20), r.n(0, 9), r.n(0, 3)
    odd = rule * (start + 7 + k) + 1
    shared = [rule * (start + i) for i in range(3)]
    values = F.concat(F.slice(F.array(*shared), F.lit(1), slot.cast("int")), F.array(odd), F.slice(F.array(*shared), slot.cast("int") + 1, 3))
    return Built({"values": F.to_json(values), "rule": rule}, say("Which number is no multiple of {k} as the others are: {v}?", k=rule, v=_listed(values.cast("array<string>"))), t(odd), F.transform(F.array(*shared), lambda x: x.cast("string")))


def number_properties(r: Stream) -> Built:
    prime = F.get(F.array(*[F.lit(k).cast("bigint") for k in (11, 13, 17, 19, 23, 29, 31, 37, 41, 43)]), r.n(0, 9).cast("int"))
    others = [r.n(2, 12) * 4, r.n(3, 12) * 6 + 3, r.n(5, 9) * 5]
    slot = r.n(0, 3).cast("int")
    values = F.concat(F.slice(F.array(*others), F.lit(1), slot), F.array(prime), F.slice(F.array(*others), slot + 1, 3))
    pool = F.concat(F.transform(F.array(*others), lambda x: x.cast("string")), F.array(*map(F.lit, ("49", "51", "57"))))
    return Built({"values": F.to_json(values), "wantPrime": "true"}, say("Which of {v} is prime?", v=_listed(values.cast("array<string>"))), t(prime), pool)


def roman_numerals(r: Stream) -> Built:
    n = r.n(4, 400)
    return Built({"value": n}, say("Write {n} in Roman numerals.", n=n), roman(n), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: roman(n + k)))


def lcm_hcf(r: Stream) -> Built:
    g, a, which = r.n(2, 12), r.n(2, 9), r.n(0, 1)
    lowest = which == 0
    return Built(
        {"left": g * a, "right": g * (a + 1), "rule": F.when(lowest, "lcm").otherwise("hcf")},
        say("Find the {w} of {a} and {b}.", w=F.when(lowest, "least common multiple").otherwise("highest common factor"), a=g * a, b=g * (a + 1)), t(F.when(lowest, g * a * (a + 1)).otherwise(g)),
    )


def bodmas(r: Stream) -> Built:
    a, b, c, q, e = r.n(20, 90), r.n(2, 9), r.n(2, 9), r.n(1, 9), r.n(2, 9)
    return Built({"a": a, "b": b, "c": c, "d": q * e, "e": e}, say("Work out {a} + {b} × {c} − {d} ÷ {e}.", a=a, b=b, c=c, d=q * e, e=e), t(a + b * c - q))


def decimals(r: Stream) -> Built:
    a, b = r.n(101, 999), r.n(101, 999)
    point = lambda x: F.concat(F.floor(x / 100).cast("string"), F.lit("."), F.lpad(F.pmod(x, F.lit(100)).cast("string"), 2, "0"))
    return Built({"aCents": a, "bCents": b}, say("Add {a} and {b}.", a=point(a), b=point(b)), point(a + b))


def circle(r: Stream) -> Built:
    k, which = r.n(1, 6), r.n(0, 1)
    area = which == 0
    return Built(
        {"radius": k * 7, "rule": F.when(area, "area").otherwise("circumference")},
        say("Find the {w} of a circle of radius {r} cm. Take 22/7 for π.", w=F.when(area, "area").otherwise("circumference"), r=k * 7), F.when(area, say("{x} sq cm", x=k * k * 154)).otherwise(say("{x} cm", x=k * 44)),
    )


def volume_solid(r: Stream) -> Built:
    a, b, h, which = r.n(2, 12), r.n(2, 12), r.n(2, 12), r.n(0, 1)
    cube = which == 0
    return Built(
        {"solid": F.when(cube, "cube").otherwise("cuboid"), "side": a, "length": a, "breadth": b, "height": h},
        F.when(cube, say("Find the volume of a cube of side {a} cm.", a=a)).otherwise(say("Find the volume of a box of {a} cm by {b} cm by {h} cm.", a=a, b=b, h=h)),
        say("{x} cu cm", x=F.when(cube, _power(a, F.lit(3).cast("bigint"))).otherwise(a * b * h)),
    )


def temperature_conversion(r: Stream) -> Built:
    fives, which = r.n(1, 16), r.n(0, 1)
    up = which == 0
    c, f = fives * 5, fives * 9 + 32
    return Built({"direction": F.when(up, "c2f").otherwise("f2c"), "value": F.when(up, c).otherwise(f)}, F.when(up, say("Change {c}°C to Fahrenheit.", c=c)).otherwise(say("Change {f}°F to Celsius.", f=f)), F.when(up, say("{f}°F", f=f)).otherwise(say("{c}°C", c=c)))


def _roots(r: Stream, power: int, name: str, high: int) -> Built:
    base, which = r.n(3, high), r.n(0, 1)
    raised, down = _power(base, F.lit(power).cast("bigint")), which == 0
    rule, word = ("sqrt", "square") if power == 2 else ("cbrt", "cube")
    return Built(
        {"rule": F.when(down, rule).otherwise(word), "value": F.when(down, raised).otherwise(base)},
        F.when(down, say("Find the {n} root of {v}.", n=name, v=raised)).otherwise(say("Find the {n} of {v}.", n=name, v=base)), t(F.when(down, base).otherwise(raised)),
    )


def algebraic_identities(r: Stream) -> Built:
    base, delta, which = r.n(11, 60), r.n(1, 9), r.n(0, 1)
    squares = which == 0
    return Built(
        {"rule": F.when(squares, "diff_squares").otherwise("square_sum"), "base": base, "delta": delta},
        F.when(squares, say("Find {a} × {b} by an identity.", a=base - 1, b=base + 1)).otherwise(say("Find ({a} + {b})² by an identity.", a=base, b=delta)),
        t(F.when(squares, (base - 1) * (base + 1)).otherwise(base * base + base * delta * 2 + delta * delta)),
    )


def factorization(r: Stream) -> Built:
    p, q = r.n(1, 9), r.n(1, 9)
    pair = lambda a, b: say("(x + {a})(x + {b})", a=a, b=b)
    return Built({"p": p, "q": q}, say("Factorise x² + {s}x + {m}.", s=p + q, m=p * q), pair(p, q), F.array(pair(p + 1, q), pair(p, q + 2), pair(p + 1, q + 3), pair(p + 4, q + 2)))


def exponents(r: Stream) -> Built:
    base, m, n, which = r.n(2, 4), r.n(2, 4), r.n(1, 2), r.n(0, 2)
    rule = F.get(F.array(*map(F.lit, ("multiply", "divide", "power"))), which.cast("int"))
    a, b = _power(base, m), _power(base, n)
    shown = F.when(which == 0, say("{b}^{m} × {b}^{n}", b=base, m=m, n=n)).when(which == 1, say("{b}^{m} ÷ {b}^{n}", b=base, m=m, n=n)).otherwise(say("({b}^{m})^{n}", b=base, m=m, n=n))
    return Built({"base": base, "m": m, "n": n, "rule": rule}, say("Find the value of {x}.", x=shown), t(F.when(which == 0, a * b).when(which == 1, (a / b).cast("bigint")).otherwise(_power(a, n))))


def proportion(r: Stream) -> Built:
    a, b, c, which = r.n(2, 12), r.n(2, 12), r.n(2, 9), r.n(0, 1)
    direct = which == 0
    return Built(
        {"rule": F.when(direct, "direct").otherwise("inverse"), "a": a * c, "b": b, "c": c},
        F.when(direct, say("One ticket costs {r}{b}. What do {c} cost?", r=RUPEE, b=b, c=c)).otherwise(say("{a} men finish in {b} days. How long do {c} men take?", a=a * c, b=b, c=c)),
        F.when(direct, say("{r}{x}", r=RUPEE, x=b * c)).otherwise(say("{x} days", x=a * b)),
    )


def _shares(r: Stream, whole: int, text: str, sides: int) -> tuple[dict, Column, Column]:
    """A ratio whose parts share the whole without rest: even parts, one of which gives one to another."""
    unit = r.n(1, 3)
    base = F.when(unit == 1, F.lit(2)).when(unit == 2, F.lit(3)).otherwise(F.lit(5)).cast("bigint")
    parts = [base - 1, *[base] * (sides - 2), base + 1]
    total = base * sides
    largest = (F.lit(whole) * (base + 1) / total).cast("bigint")
    return {"ratio": js(*parts)}, say(text, x=_listed(F.array(*parts).cast("array<string>"), " : ")), say("{x}{d}", x=largest, d=DEGREE)


def quadrilaterals(r: Stream) -> Built:
    fields, stem, answer = _shares(r, 360, "The angles of a quadrilateral are as {x}. Find the largest.", 4)
    return Built(fields, stem, answer)


def triangle_properties(r: Stream) -> Built:
    which, k = r.n(0, 1), r.n(1, 9)
    fields, stem, answer = _shares(r, 180, "The angles of a triangle are as {x}. Find the largest.", 3)
    ratio = which == 0
    return Built(
        fields | {"rule": F.when(ratio, "angle_ratio").otherwise("pythagoras"), "a": k * 3, "b": k * 4},
        F.when(ratio, stem).otherwise(say("The legs of a right triangle are {a} cm and {b} cm. Find the hypotenuse.", a=k * 3, b=k * 4)), F.when(ratio, answer).otherwise(say("{c} cm", c=k * 5)),
    )


def euler_formula(r: Stream) -> Built:
    sides = r.n(3, 14)
    return Built({"faces": sides + 2, "vertices": sides * 2}, say("A solid has {f} faces and {v} corners. How many edges?", f=sides + 2, v=sides * 2), t(sides * 3))


def surface_area_volume(r: Stream) -> Built:
    a, b, h, which, what = r.n(2, 12), r.n(2, 12), r.n(2, 12), r.n(0, 1), r.n(0, 1)
    cube, volume = which == 0, what == 0
    b, h = F.when(cube, a).otherwise(b), F.when(cube, a).otherwise(h)
    return Built(
        {"solid": F.when(cube, "cube").otherwise("cuboid"), "rule": F.when(volume, "volume").otherwise("surface"), "side": a, "length": a, "breadth": b, "height": h},
        say("Find the {w} of a block of {a} cm by {b} cm by {h} cm.", w=F.when(volume, "volume").otherwise("surface"), a=a, b=b, h=h),
        F.when(volume, say("{x} cu cm", x=a * b * h)).otherwise(say("{x} sq cm", x=a * b * 2 + (a + b) * h * 2)),
    )


def discount(r: Stream) -> Built:
    unit, percent = r.n(2, 40), r.n(1, 12) * 5
    return Built({"marked": unit * 20, "percent": percent}, say("A coat is marked {r}{m} and sold at {p}% off. What is paid?", r=RUPEE, m=unit * 20, p=percent), say("{r}{x}", r=RUPEE, x=(unit * (100 - percent) / 5).cast("bigint")))


def compound_interest(r: Stream) -> Built:
    unit, tens = r.n(1, 20), r.n(1, 2)
    first = unit * tens * 100
    return Built({"principal": unit * 1000, "rate": tens * 10, "years": 2}, say("Find the compound interest on {r}{p} at {q}% for 2 years.", r=RUPEE, p=unit * 1000, q=tens * 10), say("{r}{x}", r=RUPEE, x=first * 2 + (first * tens / 10).cast("bigint")))


def statistics(r: Stream) -> Built:
    mid, a, more, which = r.n(20, 50), r.n(1, 9), r.n(1, 9), r.n(0, 2)
    b = a + more
    rule = F.get(F.array(*map(F.lit, ("mean", "median", "mode"))), which.cast("int"))
    # Mean and median are mid, and mid stands there twice.
    xs = [mid + a, mid - b, mid, mid + b, mid - a, mid]
    return Built({"values": js(*xs), "rule": rule}, say("Find the {w} of {xs}.", w=rule, xs=_listed(F.array(*xs).cast("array<string>"))), t(mid))


def probability(r: Stream) -> Built:
    red, blue = r.n(1, 12), r.n(1, 12)
    return Built({"red": red, "blue": blue}, say("A bag holds {a} red and {b} blue balls. How likely is a red one?", a=red, b=blue), fraction(red, red + blue))


def data_interpretation(r: Stream) -> Built:
    base, a, b, which = r.n(10, 50), r.n(1, 9), r.n(10, 19), r.n(0, 1)
    total = which == 0
    names = F.array(*map(F.lit, ("Ali", "Bina", "Chen", "Dora")))
    return Built(
        {"values": js(base, base + a, base + b, base - 1), "labels": F.to_json(names), "rule": F.when(total, "total").otherwise("highest")},
        say("Ali sold {a}, Bina {b}, Chen {c} and Dora {d} books. {q}?", a=base, b=base + a, c=base + b, d=base - 1, q=F.when(total, "How many in all").otherwise("Who sold most")),
        F.when(total, t(base * 4 + a + b - 1)).otherwise("Chen"), F.when(total, F.lit(None).cast("array<string>")).otherwise(names),
    )


def graphs(r: Stream) -> Built:
    m, c, x = r.n(2, 9), r.n(1, 20), r.n(2, 15)
    return Built({"slope": m, "intercept": c, "x": x}, say("What is y on the line y = {m}x + {c} at x = {x}?", m=m, c=c, x=x), t(c + m * x))


def matrix_coding(r: Stream) -> Built:
    word = r.one(WORDS)
    places = lambda w: F.array_join(F.transform(F.filter(F.split(w, ""), lambda x: x != ""), lambda x: F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), x).cast("string")), "-")
    return Built({"word": word}, say("With A as 1 and Z as 26, how is {w} written?", w=word), places(word), F.transform(F.filter(F.array(*map(F.lit, WORDS)), lambda w: w != word), places))


def syllogism(r: Stream) -> Built:
    k = r.n(0, len(GROUPS) - 1).cast("int")
    a, b, c = (F.get(F.array(*[F.lit(g[i]) for g in GROUPS]), k) for i in range(3))
    said = lambda text: say(text, a=a, b=b, c=c)
    return Built({"a": a, "b": b, "c": c}, said("All {a} are {b}. All {b} are {c}. What follows?"), said("All {a} are {c}."), F.array(said("No {a} are {c}."), said("All {c} are {a}."), said("All {b} are {a}."), said("Some {a} are not {c}.")))


def question_tags(r: Stream) -> Built:
    k = r.n(0, len(STATEMENTS) - 1)
    statement = F.get(F.array(*map(F.lit, STATEMENTS.values())), k.cast("int"))
    tags = list(QUESTION_TAGS[: len(STATEMENTS)])
    return Built({"index": k}, say("Which tag fits: {s}, ___?", s=statement), F.get(F.array(*map(F.lit, tags)), k.cast("int")), F.array(*map(F.lit, tags)))


BUILDERS: dict[str, Callable[[Stream], Built]] = {
    f.__name__: f
    for f in (
        letter_series, coding_decoding, calendar, ranking, symbol_operations, percentage, profit_loss, average, simple_interest, division, number_formation, multiplication,
        rounding, speed_time, unitary_method, factors, divisibility, mensuration, linear_equation, work_rate, mean_proportion, metric_measures, ratio_hcf, triangle_area,
        date_puzzle, clock_direction, dictionary_order, odd_one_out, number_properties, roman_numerals, lcm_hcf, bodmas, decimals, circle, volume_solid, temperature_conversion,
        algebraic_identities, factorization, exponents, proportion, quadrilaterals, triangle_properties, euler_formula, surface_area_volume, discount, compound_interest, statistics,
        probability, data_interpretation, graphs, matrix_coding, syllogism, question_tags,
    )
} | {
    "fractions": lambda r: _sum_of_fractions(r, 1),
    "rational_numbers": lambda r: _sum_of_fractions(r, -9),
    "angles": lambda r: _supplement(r, "Two angles on a line: one is {a}{d}. Find the other."),
    "parallel_lines": lambda r: _supplement(r, "A line cuts two parallel lines. One inner angle is {a}{d}. Find the other on the same side."),
    "squares_roots": lambda r: _roots(r, 2, "square", 40),
    "cubes_roots": lambda r: _roots(r, 3, "cube", 15),
}


def near(answer: Column) -> Column:
    """Texts like the answer with another first number: close ones, then further ones, none below zero where the answer is not."""
    number = F.regexp_extract(answer, r"-?\d+", 0)
    steps = F.array(*[F.lit(k) for k in (1, -1, 2, -2, 10, -10, 3, 5, 4, 7)])
    value = number.try_cast("bigint")
    others = F.filter(F.transform(steps, lambda k: value + k), lambda v: (value < 0) | (v >= 0))
    head, tail = F.substr(answer, F.lit(1), F.instr(answer, number) - 1), F.substr(answer, F.instr(answer, number) + F.length(number))
    return F.transform(others, lambda v: F.concat(head, v.cast("string"), tail))


def wrong_options(answer: Column, pool: Column, seed: Column, count: int = 3) -> Column:
    """Options of the pool that differ from the answer and each other, drawn by the seed; near numbers where there is no pool."""
    given = F.filter(F.array_distinct(F.coalesce(pool, F.slice(near(answer), 1, 6))), lambda x: x != answer)
    ranked = F.array_sort(F.transform(given, lambda x: F.struct(F.xxhash64(seed, x).alias("h"), x.alias("x"))))
    return F.slice(F.transform(ranked, lambda x: x["x"]), 1, count)


def built(skill: Column, seed: Column, skills: list[str] | None = None) -> Column:
    """spec (a map of texts), stem, answer, options and correct slot (from 0) of the question for a skill and seed; null for unknown skills."""

    def question(name: str) -> Column:
        b = BUILDERS[name](Stream(seed))
        fields = F.create_map(F.lit("skill"), F.lit(name), *[x for k, v in b.fields.items() for x in (F.lit(k), t(v))])
        return F.struct(fields.alias("spec"), b.stem.alias("stem"), b.answer.alias("answer"), (F.lit(None).cast("array<string>") if b.pool is None else b.pool).alias("pool"))

    names = list(BUILDERS) if skills is None else skills
    parts = []
    for i in range(0, len(names), 6):
        part = F.when(skill == names[i], question(names[i]))
        for name in names[i + 1 : i + 6]:
            part = part.when(skill == name, question(name))
        parts.append(part)

    def whole(q: Column) -> Column:
        slot = F.pmod(F.xxhash64(seed, F.lit("slot")), F.lit(4)).cast("int")
        return let(
            wrong_options(q["answer"], q["pool"], seed),
            lambda wrong: F.struct(
                q["spec"].alias("spec"), q["stem"].alias("stem"), q["answer"].alias("answer"), slot.alias("slot"),
                F.concat(F.slice(wrong, F.lit(1), slot), F.array(q["answer"]), F.slice(wrong, slot + 1, F.lit(3))).alias("options"),
            ),
        )

    return let(F.coalesce(*parts), lambda q: F.when(q.isNotNull(), whole(q)))
