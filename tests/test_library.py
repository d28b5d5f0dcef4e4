"""Every query of the question library against its SQL, and its functions against cases worked out by hand."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from questmill import catalog
from questmill.functions import ids, rules, text
from questmill.operators import sets, windows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cells(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return None
        if isinstance(v, float) and v != v:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        return float(f"{v:.9g}") if isinstance(v, float) else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first()["v"]


def test_texts(spark):
    assert one(spark, text.normalize_text(F.col("s")), s=" The  C-3PO\tunit! ") == "the c 3po unit"
    assert one(spark, text.parse_grade(F.col("s")), s="Std. 9 B") == 9
    assert one(spark, text.question_key(F.col("s")), s="Q. 007") == "7"
    assert one(spark, text.natural_key(F.col("s")), s="q10") > one(spark, text.natural_key(F.col("s")), s="q2")
    assert one(spark, text.stored_path(F.col("s")), s="a/../b.png") is None
    assert one(spark, text.cut_direction_tail(F.col("s")), s="5 apples. Directions (6-9): look") == "5 apples"


def test_rules(spark):
    options = F.array(*[F.lit(x) for x in ("a", "b", "c", "d")])
    skill = lambda s: one(spark, rules.skill(F.col("s"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0), options, F.lit("mcq")), s=s)
    assert skill("Find the next: 1, 2, 4, 8") == "number_series"
    assert skill("The hour hand of a clock points east") == "clock_direction"
    assert skill("Nothing here fits any rule at all, surely not one") == "unsupported"
    assert one(spark, rules.series_subtype(F.col("s")), s="3, 9, 27, 81") == "geometric"


def test_identities(spark):
    import uuid

    assert one(spark, ids.uuid5(str(uuid.NAMESPACE_URL), F.col("s")), s="ä name") == str(uuid.uuid5(uuid.NAMESPACE_URL, "ä name"))
    assert one(spark, ids.gcd(F.col("a"), F.col("b")), a=48, b=18) == 6
    assert one(spark, ids.roman(F.col("a")), a=494) == "CCCCXCIV"
    assert one(spark, ids.is_prime(F.col("a")), a=97) and not one(spark, ids.is_prime(F.col("a")), a=91)


def test_merges_and_order_do_not_depend_on_partitions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert {tuple(r) for r in sets.merge_columns(old, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in sets.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, None), (3, "c")}
    n = spark.createDataFrame([("p", k) for k in (1, 2, 5, 9, 9)], "k string, n int")
    for parts in (1, 7):
        assert {r.gap for r in windows.number_gaps(n.repartition(parts), "k", "n").collect()} == {"3-4", "6-8"}
