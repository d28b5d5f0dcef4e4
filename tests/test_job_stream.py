"""Jobs as a stream: stopped in the middle and started again, it ends as the batch does; what nobody answers is asked again."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from questmill.operators import jobs
from questmill.streaming.job_items import EVENTS, run_jobs


@pytest.fixture
def plan():
    r = random.Random(6)
    made = [{"job_id": f"j{k}", "total": k % 4, "sources": [f"s{i}" for i in range(k % 4)] if k % 2 else None} for k in range(12)]
    replies = []
    for j in made:
        for seq in range(j["total"]):
            for attempt in (0, 1):
                if r.random() < 0.9:
                    verdict = r.choice(["passed", "failed", "needs_review", "error"])
                    replies.append({"job_id": j["job_id"], "sequence": seq, "attempt": attempt, "verdict": verdict, "question_id": f"q{seq}{attempt}", "error": "lost" if verdict == "error" else None})
    r.shuffle(replies)
    return made, replies + replies[:6]


def test_stream_equals_batch_over_a_restart(spark, plan, tmp_path):
    made, replies = plan
    rows = made[:6] + replies[: len(replies) // 2] + made[6:] + replies[len(replies) // 2 :]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [rows[i : i + 9] for i in range(0, len(rows), 9)]

    def put(n, part):
        spark.createDataFrame([(json.dumps(x),) for x in part], "value string").coalesce(1).write.mode("append").text(f"{source}/{n}")

    def go():
        lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(f"{source}/*")
        events = lines.select(F.from_json("value", EVENTS).alias("e")).select("e.*")

        def keep(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

        query = run_jobs(events).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(keep).start()
        assert query.awaitTermination(180)

    for n, part in enumerate(parts):
        put(n, part)
        if n == len(parts) // 2:
            go()
    go()
    seen = spark.read.parquet(out).where("action = 'item'")
    last = {(r.job_id, r.sequence): r for r in sorted(seen.collect(), key=lambda r: r.attempt_count)}
    items = jobs.ensure_items(spark.createDataFrame([(j["job_id"], "from_source" if j["sources"] else "from_instructions", j["total"], j["sources"], []) for j in made], f"job_id string, mode string, planned_count int, source_question_ids array<string>, items array<{jobs.ITEM}>"))
    given = spark.createDataFrame([tuple(x[k] for k in ("job_id", "sequence", "attempt", "verdict", "question_id", "error")) for x in replies], "job_id string, sequence int, attempt int, verdict string, question_id string, error string")
    for r in jobs.run_items(items, given).collect():
        for x in r["items"]:
            got = last.get((r.job_id, x.sequence))
            if x.attempt_count == 0:
                assert got is None
            else:
                assert (got.attempt_count, got.status, got.validation_status, got.question_id, got.last_error, got.completed_stages) == (
                    x.attempt_count, x.status, x.validation_status, x.candidate_question_id, x.last_error, "+".join(x.completed_stages),
                )
    # Every change came once.
    assert seen.count() == seen.select("job_id", "sequence", "attempt_count").distinct().count()


def test_silence_is_asked_again(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a").write_text(json.dumps({"job_id": "j", "total": 1}))
    events = spark.readStream.format("text").load(str(source)).select(F.from_json("value", EVENTS).alias("e")).select("e.*")
    query = run_jobs(events, timeout_ms=500).writeStream.outputMode("update").format("memory").queryName("asks").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 120
        while time.time() < until and spark.sql("select * from asks where action = 'ask'").count() < 2:
            time.sleep(0.5)
        assert spark.sql("select * from asks where action = 'ask' and sequence = 0 and attempt_count = 0").count() >= 2
    finally:
        query.stop()
