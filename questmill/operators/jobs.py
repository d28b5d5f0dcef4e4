"""Generation jobs as rows: a job's items are an array of structs, one for each question to make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<item_id:string,sequence:int,source_question_id:string,stage:string,status:string,attempt_count:int,last_error:string,completed_stages:array<string>>"


def total() -> Column:
    """How many questions a job makes: its sources where it follows some, else what was planned."""
    return F.when(F.col("mode") == "from_source", F.size("source_question_ids")).otherwise(F.coalesce("planned_count", F.lit(0)))


def ensure_items(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, mode, planned_count, source_question_ids, items) whose items reach their total; those there are stay as they are."""
    def item(k: Column) -> Column:
        of = F.when(F.col("mode") == "from_source", F.get("source_question_ids", k))
        return F.struct(
            F.concat_ws(":", "job_id", k.cast("string")).alias("item_id"), k.alias("sequence"), of.alias("source_question_id"), F.lit("analysis").alias("stage"), F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"),
            F.lit(None).cast("string").alias("last_error"), F.array().cast("array<string>").alias("completed_stages"),
        )

    have, need = F.size("items"), total()
    more = F.when(need > have, F.transform(F.sequence(have, F.greatest(need - 1, have)), item)).otherwise(F.array().cast(f"array<{ITEM}>"))
    return jobs.withColumn("items", F.concat(F.coalesce("items", F.array().cast(f"array<{ITEM}>")), more))


def with_stage(item: Column, stage: Column) -> Column:
    """An item at a stage, which joins the completed ones once."""
    done = F.when(F.array_contains(item["completed_stages"], stage), item["completed_stages"]).otherwise(F.array_append(item["completed_stages"], stage))
    return item.withField("stage", stage).withField("completed_stages", done)


def failed(item: Column, error: Column, most: int = 2) -> Column:
    """An item after a failed attempt: to be tried again until the last."""
    tries = item["attempt_count"] + 1
    return item.withField("attempt_count", tries).withField("last_error", error).withField("status", F.when(tries >= most, "failed").otherwise("pending"))


def incomplete() -> Column:
    """Whether a job is still to be finished; no job is not."""
    return F.coalesce(F.col("status") != "completed", F.lit(False))


#: Attempts of an item, how a finished one stands, and the stages that a failed attempt undoes; fixed values.
MOST_ATTEMPTS = 2
DONE = ("completed", "needs_review")
UNDONE = ("generation", "validation", "asset")
REPLY = "struct<sequence:int,attempt:int,verdict:string,question_id:string,error:string>"


def is_done(item: Column) -> Column:
    return item["status"].isin(*DONE)


def after_reply(item: Column, reply: Column) -> Column:
    """An item after the reply to its current attempt; replies to other attempts, and to a finished item, change nothing.

    A question that passed completes it, one that needs review awaits a person. A
    failed one is asked for again, and after the last attempt awaits a person too. An
    error fails the attempt.
    """
    tries = item["attempt_count"] + 1
    kept = F.filter(item["completed_stages"], lambda s: ~s.isin(*UNDONE))
    again = item.withField("attempt_count", tries).withField("status", F.lit("retryable")).withField("validation_status", F.lit("failed")).withField("completed_stages", kept)
    passed = reply["verdict"] == "passed"
    ended = item
    for stage in ("analysis", "generation", "validation", "asset", "review"):
        ended = with_stage(ended, F.lit(stage))
    ended = ended.withField("attempt_count", tries).withField("candidate_question_id", reply["question_id"]).withField("last_error", F.lit(None).cast("string"))
    ended = ended.withField("validation_status", F.when(passed, "passed").otherwise("needs_review")).withField("status", F.when(passed, "completed").otherwise("needs_review"))
    outcome = (
        F.when(reply["verdict"] == "error", failed(item, reply["error"], MOST_ATTEMPTS))
        .when((reply["verdict"] == "failed") & (tries < MOST_ATTEMPTS), again)
        .otherwise(ended)
    )
    current = ~is_done(item) & (item["status"] != "failed") & (reply["attempt"] == item["attempt_count"])
    return F.when(current, outcome).otherwise(item)


def run_items(jobs: DataFrame, replies: DataFrame) -> DataFrame:
    """jobs with items after all replies (job_id, sequence, attempt, verdict, question_id, error), and their progress.

    Items run in order: replies to items behind one that is not done wait. Adds
    cursor, pairs (source_question_id, question_id), status and last_error; see
    advance. Repeated replies count once. A job's items and replies are one group,
    which its number of questions bounds.
    """
    given = replies.select("job_id", F.struct("sequence", "attempt", "verdict", "question_id", "error").cast(REPLY).alias("r")).where("r.sequence is not null and r.attempt is not null")
    of = given.groupBy("job_id").agg(F.array_sort(F.collect_list("r")).alias("_replies"))
    whole = jobs.join(of, "job_id", "left")
    blank = lambda x: x.withField("candidate_question_id", F.lit(None).cast("string")).withField("validation_status", F.lit(None).cast("string"))
    mine = lambda x: F.filter(F.coalesce("_replies", F.array().cast(f"array<{REPLY}>")), lambda r: r["sequence"] == x["sequence"])
    whole = whole.withColumn("items", F.transform("items", blank))
    whole = whole.withColumn("_ran", F.transform("items", lambda x: F.aggregate(mine(x), x, after_reply)))
    reached = leading_done(F.col("_ran"))
    ran = whole.withColumn("_cursor", reached).withColumn("items", F.transform("items", lambda x, i: F.when(i <= F.col("_cursor"), F.get("_ran", i)).otherwise(x)))
    return advance(ran.drop("_replies", "_ran", "_cursor"))


def leading_done(items: Column) -> Column:
    """How many items are done before the first that is not."""
    return F.coalesce(F.nullif(F.array_position(F.transform(items, is_done), F.lit(False)), F.lit(0)) - 1, F.size(items)).cast("int")


def advance(jobs: DataFrame) -> DataFrame:
    """jobs with cursor (the first item that is not done), pairs of the done ones before it, status and last_error.

    A job is completed behind its last item, failed where the item at its cursor is.
    """
    at = F.get("items", F.col("cursor"))
    pairs = F.transform(F.slice("items", F.lit(1), F.col("cursor")), lambda x: F.struct(x["source_question_id"].alias("source_question_id"), x["candidate_question_id"].alias("question_id")))
    status = F.when(F.col("cursor") >= F.size("items"), "completed").when(at["status"] == "failed", "failed").otherwise("in_progress")
    return jobs.withColumn("cursor", leading_done(F.col("items"))).withColumns({"pairs": pairs, "status": status, "last_error": at["last_error"]})
