"""Every builder's question: its own answer is what the solver finds, four options differ, and a seed gives the same question again."""

from pyspark.sql import functions as F

from questmill.functions.build import BUILDERS, built
from questmill.functions.solve import SOLVERS, solve

SEEDS = 150


def test_builders_agree_with_solvers(spark):
    assert set(BUILDERS) == set(SOLVERS) and len(BUILDERS) == 59
    names = sorted(BUILDERS)
    seeds = spark.range(SEEDS * len(names)).select("id", F.get(F.array(*map(F.lit, names)), (F.col("id") % len(names)).cast("int")).alias("skill"))
    made = seeds.select("id", "skill", F.inline(F.array(built(F.col("skill"), F.col("id")))))
    seen = {}
    for r in made.select("*", F.inline(F.array(F.struct(solve(F.col("spec")).alias("solved"))))).collect():
        assert r.solved == r.answer, r
        assert len(set(r.options)) == 4 and r.options[r.slot] == r.answer, r
        seen.setdefault(r.skill, set()).add(r.stem)
    assert set(seen) == set(names) and all(len(s) >= 3 for s in seen.values())


def test_unknown_skill_and_same_seed(spark):
    few = ["ranking", "calendar"]
    seeds = spark.createDataFrame([(5, "ranking"), (5, "ranking"), (6, "idioms"), (7, None)], "seed long, skill string")
    got = [r.q for r in seeds.select(built(F.col("skill"), F.col("seed"), few).alias("q")).collect()]
    assert got[0] == got[1] and got[2] is None and got[3] is None
