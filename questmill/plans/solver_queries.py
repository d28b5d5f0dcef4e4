"""Queries for the solvers and for checking marked answers, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.functions.build import BUILDERS, built
from questmill.functions.solve import SOLVERS, parsed, solve
from questmill.sources.driver_tables import spread, table

#: Skill, JSON fields in terms of a, b and e (three numbers of an event), and the answer in SQL.
CASES: list[tuple[str, str, str]] = [
    ("letter_series", '"start":"C","step":{b},"shown":{e}', "chr(CAST((2 + b * e) % 26 + 65 AS INT))"),
    ("coding_decoding", '"word":"MANGO","shift":{b}', "array_to_string([chr(CAST((ascii(x) - 65 + b) % 26 + 65 AS INT)) FOR x IN string_split('MANGO', '')], '')"),
    ("calendar", '"year":2024,"month":{b1},"day":{e1}', "dayname(make_date(2024, b1, e1))"),
    ("ranking", '"total":{a},"fromLeft":{b}', "CAST(a - b + 1 AS VARCHAR)"),
    ("symbol_operations", '"left":{a},"right":{b},"add":{e}', "CAST(a + b + e AS VARCHAR)"),
    ("percentage", '"whole":{a},"percent":{b}', "CASE WHEN a * b % 100 = 0 THEN CAST(a * b // 100 AS VARCHAR) END"),
    ("profit_loss", '"cost":{a}0,"gain":{b}', "CASE WHEN a * 10 * b % 100 = 0 THEN CAST(a * 10 + a * 10 * b // 100 AS VARCHAR) END"),
    ("average", '"values":[{a},{b},{e}]', "CASE WHEN (a + b + e) % 3 = 0 THEN CAST((a + b + e) // 3 AS VARCHAR) END"),
    ("simple_interest", '"principal":{a}00,"rate":{b},"years":{e}', "CAST(a * b * e AS VARCHAR)"),
    ("fractions", '"n1":1,"d1":{b},"n2":{a},"d2":{e}', "CASE WHEN b * e // gcd(e + a * b, b * e) = 1 THEN CAST((e + a * b) // gcd(e + a * b, b * e) AS VARCHAR) ELSE ((e + a * b) // gcd(e + a * b, b * e)) || '/' || (b * e // gcd(e + a * b, b * e)) END"),
    ("division", '"dividend":{a},"divisor":{b}', "CASE WHEN a % b = 0 THEN CAST(a // b AS VARCHAR) END"),
    ("multiplication", '"left":{a},"right":{b}', "CAST(a * b AS VARCHAR)"),
    ("rounding", '"value":{a}5,"place":10', "CAST((a + 1) * 10 AS VARCHAR)"),
    ("speed_time", '"speed":{a},"hours":{b}', "(a * b) || ' km'"),
    ("unitary_method", '"items":{b},"cost":{a}', "CASE WHEN a % b = 0 THEN '₹' || (a // b) END"),
    ("factors", '"value":{a}', "CAST(list_sum([k FOR k IN generate_series(1, a) IF a % k = 0]) AS BIGINT)::VARCHAR"),
    ("divisibility", '"value":{a},"divisor":{b}', "CAST(a % b AS VARCHAR)"),
    ("angles", '"angle":{a}', "(180 - a) || '°'"),
    ("linear_equation", '"coefficient":{b},"added":{e},"total":{a}', "CASE WHEN (a - e) % b = 0 THEN CAST(CAST((a - e) / b AS BIGINT) AS VARCHAR) END"),
    ("mean_proportion", '"left":{a},"right":{b}', "CASE WHEN CAST(round(sqrt(a * b)) AS BIGINT) * CAST(round(sqrt(a * b)) AS BIGINT) = a * b THEN CAST(CAST(round(sqrt(a * b)) AS BIGINT) AS VARCHAR) END"),
    ("ratio_hcf", '"left":{a},"right":{b}', "CAST(gcd(a, b) AS VARCHAR)"),
    ("triangle_area", '"base":{a},"height":{b}', "CASE WHEN a * b % 2 = 0 THEN (a * b // 2) || ' sq cm' END"),
    ("number_properties", '"values":[4,{a},9],"wantPrime":true', "CASE WHEN a >= 2 AND len([k FOR k IN generate_series(2, a - 1) IF a % k = 0]) = 0 THEN CAST(a AS VARCHAR) END"),
    ("lcm_hcf", '"left":{a},"right":{b},"rule":"lcm"', "CAST(lcm(a, b) AS VARCHAR)"),
    ("bodmas", '"a":{a},"b":{b},"c":2,"d":{a},"e":{b}', "CASE WHEN a % b = 0 THEN CAST(a + b * 2 - a // b AS VARCHAR) END"),
    ("squares_roots", '"value":{a},"rule":"sqrt"', "CASE WHEN CAST(round(sqrt(a)) AS BIGINT) ** 2 = a THEN CAST(CAST(round(sqrt(a)) AS BIGINT) AS VARCHAR) END"),
    ("cubes_roots", '"value":{b},"rule":"cube"', "CAST(b * b * b AS VARCHAR)"),
    ("algebraic_identities", '"base":{a},"delta":{b}', "CAST((a + b) * (a + b) AS VARCHAR)"),
    ("factorization", '"p":{a},"q":{b}', "'(x + ' || a || ')(x + ' || b || ')'"),
    ("exponents", '"base":2,"m":{b},"n":3,"rule":"multiply"', "CAST(CAST(2 ** (b + 3) AS BIGINT) AS VARCHAR)"),
    ("euler_formula", '"faces":{a},"vertices":{b}', "CAST(a + b - 2 AS VARCHAR)"),
    ("surface_area_volume", '"solid":"cuboid","length":{a},"breadth":{b},"height":{e},"rule":"area"', "(2 * (a * b + b * e + e * a)) || ' sq cm'"),
    ("compound_interest", '"principal":{a}0000,"rate":{b},"years":2', "'₹' || (a * (100 + b) * (100 + b) - a * 10000)"),
    ("statistics", '"values":[{a},{b},{e}],"rule":"median"', "CAST(list_sort([a, b, e])[2] AS VARCHAR)"),
    ("probability", '"red":{b},"blue":{a}', "CASE WHEN (a + b) // gcd(b, a + b) = 1 THEN CAST(b // gcd(b, a + b) AS VARCHAR) ELSE (b // gcd(b, a + b)) || '/' || ((a + b) // gcd(b, a + b)) END"),
    ("data_interpretation", '"values":[{a},{b},{e}],"labels":["x","y","z"]', "CASE WHEN a >= b AND a >= e THEN 'x' WHEN b >= e THEN 'y' ELSE 'z' END"),
    ("graphs", '"slope":{b},"intercept":{e},"x":{a}', "CAST(b * a + e AS VARCHAR)"),
    ("matrix_coding", '"word":"CAB"', "'3-1-2'"),
    ("syllogism", '"a":"cats","c":"pets"', "'All cats are pets.'"),
]
SKILLS = [name for name, *_ in CASES]


def _numbers(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(
        "event_id", (F.col("event_id") % 97 + 1).alias("a"), (F.col("user_id") % 12 + 1).alias("b"), (F.floor(F.col("value")).cast("bigint") % 20 + 1).alias("e"),
        (F.col("event_id") % len(CASES)).alias("k"),
    )


NUMBERS_SQL = f"n AS (SELECT *, CAST(b AS INT) AS b1, CAST(e AS INT) AS e1 FROM (SELECT event_id, event_id % 97 + 1 AS a, user_id % 12 + 1 AS b, CAST(floor(value) AS BIGINT) % 20 + 1 AS e, event_id % {len(CASES)} AS k FROM events))"


def _spec() -> Column:
    """The JSON spec of an event."""
    out = None
    for k, (skill, fields, _) in enumerate(CASES):
        text = '{"skill":"' + skill + '",' + fields.replace("{b1}", "{b}").replace("{e1}", "{e}") + "}"
        parts, rest = [], text
        while rest:
            at = min((rest.find(m) for m in ("{a}", "{b}", "{e}") if m in rest), default=-1)
            if at < 0:
                parts.append(F.lit(rest))
                break
            parts += [F.lit(rest[:at]), F.col(rest[at + 1]).cast("string")]
            rest = rest[at + 3 :]
        value = F.concat(*parts)
        out = F.when(F.col("k") == k, value) if out is None else out.when(F.col("k") == k, value)
    return out


def fn_solve_checked(s: SparkSession, d: str) -> DataFrame:
    return _numbers(s, d).select("event_id", parsed(_spec()).alias("spec")).select("event_id", solve(F.col("spec"), SKILLS).alias("answer"))


_ANSWER_SQL = "CASE k " + " ".join(f"WHEN {k} THEN {sql}" for k, (*_, sql) in enumerate(CASES)) + " END"


def val_checked(s: SparkSession, d: str) -> DataFrame:
    """Whether the marked option is what the solver finds; every third is marked wrong on purpose."""
    solved = fn_solve_checked(s, d)
    marked = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("answer"), F.lit("?"))).otherwise(F.col("answer"))
    status = F.when(F.col("answer").isNull(), "needs_review").when(marked == F.col("answer"), "passed").otherwise("failed")
    return solved.select("event_id", status.alias("status"))


def fn_local_solution(s: SparkSession, d: str) -> DataFrame:
    """The explanation that a solved spec yields."""
    return fn_solve_checked(s, d).select("event_id", F.concat(F.lit("The answer is "), F.col("answer"), F.lit(".")).alias("explanation"))


def cls_oracle_skill(s: SparkSession, d: str) -> DataFrame:
    """Whether an independent solver exists for an event's skill; every fifth has none."""
    skill = F.when(F.col("k") % 5 == 0, "idioms").otherwise(F.get(F.array(*map(F.lit, SKILLS)), F.col("k").cast("int")))
    return _numbers(s, d).select("event_id", skill.isin(*SOLVERS, "number_series", "mirror_image", "water_image", "grammar").alias("oracle"))


def _series(s: SparkSession, d: str) -> DataFrame:
    """Seeded series of six terms: arithmetic for even seeds, geometric for odd ones."""
    n = _numbers(s, d)
    terms = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(F.col("event_id") % 2 == 0, F.col("a") + F.col("b") * i).otherwise(F.col("e") * F.shiftleft(F.lit(1), 1) ** i))
    return n.select("event_id", terms.cast("array<bigint>").alias("terms"))


def gen_series(s: SparkSession, d: str) -> DataFrame:
    return _series(s, d).select("event_id", F.array_join(F.slice(F.col("terms").cast("array<string>"), 1, 5), ", ").alias("stem"), F.element_at("terms", 6).alias("answer"))


def val_series(s: SparkSession, d: str) -> DataFrame:
    """Which rule the shown terms follow and what it gives next, against the marked answer."""
    t = _series(s, d).withColumn("shown", F.slice("terms", 1, 5))
    step = F.get("shown", 1) - F.get("shown", 0)
    level = F.forall(F.sequence(F.lit(1), F.lit(4)), lambda i: F.get("shown", i) - F.get("shown", i - 1) == step)
    ratio = F.forall(F.sequence(F.lit(1), F.lit(4)), lambda i: F.get("shown", i) * F.get("shown", 0) == F.get("shown", i - 1) * F.get("shown", 1))
    rule = F.when(level, "arithmetic").when(ratio, "geometric")
    nxt = F.when(level, F.get("shown", 4) + step).when(ratio, F.floor(F.get("shown", 4) * F.get("shown", 1) / F.get("shown", 0)))
    return t.select("event_id", rule.alias("rule"), (nxt == F.element_at("terms", 6)).alias("passed"))


_BUILT = sorted(BUILDERS)


def gen_checked(s: SparkSession, d: str) -> DataFrame:
    """A seeded question for every event, of all skills in turn; what the solver says of it, and how many options differ."""
    skill = F.get(F.array(*map(F.lit, _BUILT)), (F.col("event_id") % len(_BUILT)).cast("int"))
    e = spread(s, d, "events", "event_id").select("event_id", skill.alias("skill"))
    made = e.select("event_id", "skill", F.inline(F.array(built(F.col("skill"), F.col("event_id")))))
    checked = made.select("*", F.inline(F.array(F.struct(solve(F.col("spec")).alias("solved")))))
    return checked.select(
        "event_id", "skill", (F.length("stem") > 10).alias("asked"), (F.col("solved") == F.col("answer")).alias("confirmed"),
        F.size(F.array_distinct("options")).alias("options"), (F.get("options", F.col("slot")) == F.col("answer")).alias("placed"),
    )


QUERIES = {f.__name__: f for f in (gen_checked, fn_solve_checked, val_checked, fn_local_solution, cls_oracle_skill, gen_series, val_series)}
_TERMS = "CASE WHEN event_id % 2 = 0 THEN [a + b * i FOR i IN generate_series(0, 5)] ELSE [CAST(e * 2 ** i AS BIGINT) FOR i IN generate_series(0, 5)] END"
ORACLE_SQL = {
    # The draws cannot be said in DuckDB; its SQL states what holds for every question.
    "gen_checked": f"SELECT event_id, [{', '.join(repr(n) for n in _BUILT)}][event_id % {len(_BUILT)} + 1] AS skill, true AS asked, true AS confirmed, 4 AS options, true AS placed FROM events",
    "fn_solve_checked": f"WITH {NUMBERS_SQL} SELECT event_id, {_ANSWER_SQL} AS answer FROM n",
    "val_checked": f"WITH {NUMBERS_SQL}, x AS (SELECT event_id, {_ANSWER_SQL} AS answer FROM n) SELECT event_id, CASE WHEN answer IS NULL THEN 'needs_review' WHEN event_id % 3 = 0 THEN 'failed' ELSE 'passed' END AS status FROM x",
    "fn_local_solution": f"WITH {NUMBERS_SQL}, x AS (SELECT event_id, {_ANSWER_SQL} AS answer FROM n) SELECT event_id, 'The answer is ' || answer || '.' AS explanation FROM x",
    "cls_oracle_skill": f"SELECT event_id, (event_id % {len(CASES)}) % 5 > 0 AS oracle FROM events",
    "gen_series": f"WITH {NUMBERS_SQL}, x AS (SELECT event_id, {_TERMS} AS t FROM n) SELECT event_id, array_to_string(t[1:5], ', ') AS stem, t[6] AS answer FROM x",
    "val_series": f"WITH {NUMBERS_SQL} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'arithmetic' ELSE 'geometric' END AS rule, TRUE AS passed FROM n",
}
