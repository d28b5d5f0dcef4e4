"""The paged remote table, the asset store, drafts, running places and cut blocks, against cases written by hand."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from questmill.functions import loose
from questmill.operators import blocks, drafts, windows
from questmill.sources import paged
from questmill.sources.assets import contents, manifest, put_assets
from questmill.sources.shared import shared_path


@pytest.fixture
def remote(spark, tmp_path):
    path = str(tmp_path / "remote.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (a INTEGER, b TEXT, v REAL, PRIMARY KEY (a, b))")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i // 3, "xyz"[i % 3], i / 2) for i in range(300)])
    con.commit()
    con.close()
    return {"connect": "questmill.sources.paged:sqlite", "target": path, "dbtable": "t", "key": "a,b"}


def rows(options):
    con = sqlite3.connect(options["target"])
    found = con.execute("SELECT a, b, v FROM t ORDER BY a, b").fetchall()
    tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
    con.close()
    assert tables == ["t"], "staging is left behind"
    return found


SCHEMA = "a bigint, b string, v double"


@pytest.mark.parametrize("parts", [1, 7])
def test_paged_read(spark, remote, parts):
    got = paged.read_paged(spark, SCHEMA, page="11", partitions=str(parts), **remote)
    assert sorted(map(tuple, got.collect())) == rows(remote) and got.rdd.getNumPartitions() == parts
    assert paged.read_paged(spark, "v double", **remote).agg(F.count("*")).first()[0] == 300


def test_paged_read_takes_filters_along(spark, remote):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda: paged.read_paged(spark, SCHEMA, page="7", **remote)
        assert sorted(r.a for r in read().where("b = 'x'").collect()) == list(range(100))
        many = read().where(F.col("a").isin(*range(0, 190, 2)) & (F.col("v") > 100))
        assert sorted((r.a, r.b) for r in many.collect()) == [(a, b) for a, b, v in rows(remote) if a % 2 == 0 and v > 100]
        assert many.rdd.getNumPartitions() == 2  # chunks of the list
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_paged_write(spark, remote):
    frame = lambda found, schema=SCHEMA: spark.createDataFrame(found, schema).repartition(3)
    new = [(k, "x", None) for k in range(90, 110)]
    before = {r[:2]: r[2] for r in rows(remote)}
    paged.write_paged(frame(new), mode="ignore", chunk="2", **remote)
    want = {**{r[:2]: r[2] for r in new}, **before}
    assert {r[:2]: r[2] for r in rows(remote)} == want
    paged.write_paged(frame(new), chunk="2", **remote)
    want.update({r[:2]: r[2] for r in new})
    assert {r[:2]: r[2] for r in rows(remote)} == want
    paged.write_paged(frame([(0, "x"), (0, "z"), (999, "q")], "a bigint, b string"), mode="delete", **remote)
    paged.write_paged(frame([(1, "x", 7.5), (998, "q", 1.0)]), mode="update", **remote)
    del want[0, "x"], want[0, "z"]
    want[1, "x"] = 7.5
    assert {r[:2]: r[2] for r in rows(remote)} == want
    paged.write_paged(frame([]), **remote)
    with pytest.raises(Exception, match="mode"):
        paged.write_paged(frame(new), mode="replace", **remote)


def test_a_repeated_write_changes_no_row(spark, remote):
    con = sqlite3.connect(remote["target"])
    con.executescript("CREATE TABLE changes (n INTEGER); CREATE TRIGGER c AFTER UPDATE ON t BEGIN INSERT INTO changes VALUES (1); END")
    frame = spark.createDataFrame([(5, "x", 1.0), (6, "x", 2.0)], SCHEMA)
    counts = []
    for _ in range(2):
        paged.write_paged(frame, **remote)
        counts.append(con.execute("SELECT count(*) FROM changes").fetchone()[0])
    con.close()
    assert counts == [2, 2]


def test_a_failed_task_leaves_nothing(spark, remote):
    before = rows(remote)
    bad = spark.range(40).repartition(4).select("id", F.lit("new").alias("b"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit(1.0)).cast("double").alias("v"))
    with pytest.raises(Exception, match="lost"):
        paged.write_paged(bad.withColumnRenamed("id", "a"), chunk="1", **remote)
    assert rows(remote) == before


def test_retry():
    waits, tries = [], []

    def run():
        tries.append(1)
        if len(tries) < 4:
            raise ConnectionError("socket hang up")
        return "done"

    assert paged.with_retry(run, sleep=waits.append) == "done" and len(waits) == 3 and waits[0] < waits[1] < waits[2]
    with pytest.raises(ValueError):
        paged.with_retry(lambda: (_ for _ in ()).throw(ValueError("wrong column")), sleep=waits.append)
    assert len(waits) == 3


def test_asset_store(spark):
    root = shared_path(spark, "assets-test")
    fields = "asset_id string, kind string, role string, mime_type string, document_id string, question_id string, bytes binary"
    put = lambda *found: {r.asset_id: r for r in put_assets(spark.createDataFrame([(*r[:-1], bytearray(r[-1])) for r in found], fields), root).collect()}
    one = ("a", "source", "figure", "image/png", "d1", None, b"same"), ("b", "generated", "figure", "image/svg+xml", "d1", "q1", b"same"), ("c", "source", "figure", "x/y", "d2", None, b"other")
    for _ in range(2):
        got = put(*one)
        assert {k: (r.storage_key, r.version, r.size_bytes) for k, r in got.items()} == {
            "a": ("d1/source/a.png", 1, 4), "b": ("d1/generated/q1/b.svg", 1, 4), "c": ("d2/source/c.jpg", 1, 5),
        }
        assert contents(spark, root).count() == 2 and spark.read.parquet(f"{root}/log").count() == 3
    got = put(("a", "source", "figure", "image/png", "d1", None, b"new"), one[1])
    assert (got["a"].version, got["b"].version) == (2, 1) and contents(spark, root).count() == 3
    for bad, message in ((("a", "generated", "f", "m", "d", "q", b"z"), "overwrite"), (("n", "generated", "f", "m", "d", None, b"z"), "question"), ((None, "source", "f", "m", "d", None, b"z"), "needs an id")):
        with pytest.raises(ValueError, match=message):
            put(bad)
    with pytest.raises(ValueError, match="twice"):
        put(one[2], one[2])
    assert manifest(spark, root).count() == 3 and contents(spark, root).count() == 3


def test_overlay(spark):
    # k, base, local, saved: value of one column; a row is left out where it is "gone".
    cases = [
        (1, 0, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1), (4, 0, 1, 1), (5, 0, 1, 2), (6, 0, None, 2), (7, None, None, 2), (8, None, 1, None),
        (9, 0, "gone", 5), (10, "gone", 3, 5), (11, 0, 1, "gone"),
    ]
    side = lambda n: spark.createDataFrame([(r[0], r[n], r[0]) for r in cases if r[n] != "gone"], "k int, v int, w int")
    got = {r.k: (r.v, r.dirty, r.clashes, r.flush) for r in drafts.overlay(side(1), side(2), side(3), "k", ["v", "w"], at_once=["w"]).collect()}
    assert got == {
        1: (0, [], [], False), 2: (1, ["v"], [], False), 3: (1, [], [], False), 4: (1, ["v"], [], False), 5: (1, ["v"], ["v"], False), 6: (None, ["v"], ["v"], False),
        7: (2, [], [], False), 8: (1, ["v"], [], False), 9: (5, [], [], False), 10: (3, ["v", "w"], [], True),
    }


def test_running_place(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), "id")
    got = windows.running_place(frame, [F.col("x"), F.col("id")]).collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.x, r.id))] == list(range(1, 5001))
    assert windows.running_place(frame.limit(0), [F.col("x")]).count() == 0


def test_split_swallowed(spark):
    line = lambda t, y: (t, 0.1, y, 0.5, 0.02)
    found = [
        (1, 0, "1", 0.1, 0.1, 0.8, 0.5, [line("1. First one 2. second 3. Third) 4) Fourth", 0.2), line("tail", 0.3), line(" x 9. Ninth ", 0.4)]),
        (1, 1, "5", 0.1, 0.6, 0.8, 0.2, [line("word 5. Own number 6. Not cut", 0.6), line("but 5. Here", 0.7)]),
        (1, 2, "7", 0.1, 0.9, 1.5, 0.001, [line("nothing 12 here 3.5 or 4. 5", 0.9), line(None, 0.95)]),
    ]
    table = spark.createDataFrame(found, "page int, block int, number string, x double, y double, w double, h double, lines array<struct<text:string,x:double,y:double,w:double,h:double>>")
    got = sorted((r.block, r.part, r.number, r.y, r.h, [x.text for x in r.lines]) for r in blocks.split_swallowed(table).collect())
    assert got == [
        (0, 0, "1", 0.1, 0.1, ["1. First one"]), (0, 1, "2", 0.2, 0.01, ["2. second"]), (0, 2, "3", 0.2, 0.01, ["3. Third)"]),
        (0, 3, "4", 0.2, 0.2, ["4. Fourth", "tail", "x"]), (0, 4, "9", 0.4, 0.2, ["9. Ninth"]),
        (1, 0, "5", 0.6, 0.1, ["word 5. Own number 6. Not cut", "but"]), (1, 1, "5", 0.7, 0.1, ["5. Here"]),
        (2, 0, "7", 0.9, 0.001, ["nothing 12 here 3.5 or 4. 5", ""]),
    ]


def test_split_swallowed_takes_long_lines_at_once(spark):
    """2,000 numbers in a line, repeated numbers and ends of lines inside one; no part carries its block's other lines along."""
    long = "1. One " + " ".join(f"{k % 900 + 2}. Word" for k in range(2000)) + "  "
    texts = [long, "x 2. A y 2) B 3. C", "a\r5. Foo 6. Bar", "a\rb 5. Foo", "x 3. A y\r5. Foo ( 6. G", "\u00a0 5. Foo", " as it is "]
    rows = [(1, k, "1", 0.1, 0.1, 0.8, 0.5, [(t, 0.1, 0.2, 0.5, 0.02)]) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "page int, block int, number string, x double, y double, w double, h double, lines array<struct<text:string,x:double,y:double,w:double,h:double>>")
    done = blocks.split_swallowed(table)
    got = {}
    for r in sorted(done.collect(), key=lambda r: (r.block, r.part)):
        got.setdefault(r.block, []).append((r.number, *[x.text for x in r.lines]))
    assert got[0] == [("1", "1. One"), *[(str(k % 900 + 2), f"{k % 900 + 2}. Word") for k in range(2000)]]
    assert [got[k] for k in range(1, 7)] == [
        [("1", "x"), ("2", "2. A y 2) B 3. C")], [("1", "a"), ("5", "5. Foo"), ("6", "6. Bar")], [("1", "a\rb 5. Foo")],
        [("1", "x 3. A y"), ("5", "5. Foo ("), ("6", "6. G")], [("1", "\u00a0 5. Foo")], [("1", " as it is ")],
    ]
    above, _, _ = done._jdf.queryExecution().optimizedPlan().toString().partition("Generate posexplode")
    assert above and "_pieces" not in above


def test_chat_answer(spark):
    bodies = {
        'data: {"choices":[{"delta":{"content":"a"}}]}\ndata: [DONE]': ("a", None), '{"choices":[{"message":{"content":["x",{"text":"y"}]}}]}': ("xy", None),
        '{"error":{"message":" late "}}': (None, "late"), "{": (None, "The reply is no JSON."), "": ("", None), 'data: {"choices":[{"delta":{"reasoning":"\\"hint\\":1"}}]}': ('"hint":1', None),
    }
    table = spark.createDataFrame([(k,) for k in bodies], "body string")
    got = {r.body: (r.a.text, r.a.error) for r in table.select("body", loose.chat_answer(F.col("body")).alias("a")).collect()}
    assert got == bodies


def test_staging_takes_few_commits_and_deletes_read_it_once(remote, monkeypatch):
    """1,000 rows in chunks of 2 take no commit a chunk; a delete's plan holds no scan that is repeated for each row."""
    from pyspark.sql.types import StructType

    at = paged._Remote.of(remote)
    writer = paged.PagedWriter(at, StructType().add("a", "long").add("b", "string"), "delete", 2)
    commits = []

    class Counted(sqlite3.Connection):
        def commit(self):
            commits.append(1)
            super().commit()

    with monkeypatch.context() as m:
        m.setattr(paged, "sqlite", lambda path: sqlite3.connect(path, factory=Counted))
        done = writer.write(iter([(i, "x") for i in range(1000)]))
    con = sqlite3.connect(remote["target"])
    assert done.rows == 1000 and len(commits) == 2
    assert con.execute(f'SELECT count(DISTINCT a), count(*) FROM "{at.staging(writer.job)}"').fetchall() == [(1000, 1000)]
    plan = [row[3] for row in con.execute("EXPLAIN QUERY PLAN " + writer._merge("?"), [done.attempt])]
    con.close()
    assert not any("CORRELATED" in line for line in plan), plan
    writer.commit([done])
    assert all(b != "x" for _, b, _ in rows(remote))
