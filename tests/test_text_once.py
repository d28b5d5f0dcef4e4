"""Work on each row is done once, and by more than one task where a table is one file."""

import pytest
from pyspark.sql import functions as F

from questmill.functions import text
from questmill.plans import solver_queries, text_queries


@pytest.mark.parametrize("name", ["fn_jaccard", "fn_is_copied"])
def test_each_text_is_normalised_once(spark, name):
    plan = text_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4  # two for each of the two texts


@pytest.mark.parametrize("queries, name", [(text_queries.QUERIES, "fn_is_copied"), (text_queries.QUERIES, "fn_jaccard"), (solver_queries.QUERIES, "gen_checked")])
def test_one_file_is_dealt_to_several_tasks(spark, queries, name):
    assert queries[name](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_trimmed_takes_every_white_space(spark):
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace() and not 0x1C <= ord(c) <= 0x1F]
    rows = [(f"{c}a{c}b{c}{c}", f"a{c}b") for c in spaces] + [("​a\u001c", "​a\u001c"), ("".join(spaces), ""), ("", ""), (None, None)]
    out = spark.createDataFrame(rows, "s string, want string").select("want", text.trimmed(F.col("s")).alias("got"), F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("regex")).collect()
    assert all(r.got == r.want == r.regex for r in out)
