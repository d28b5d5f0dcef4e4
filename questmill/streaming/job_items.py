"""Generation jobs as a stream: each job's cursor and items are keyed state, replies are rows, and what is to be asked next comes out.

A reply names the item and the attempt it answers, so one that comes twice, or again
after a restart, changes nothing; one that comes early waits in the state. Without
a reply in time the question is asked again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from questmill.operators.jobs import DONE, MOST_ATTEMPTS, UNDONE

EVENTS = "job_id string, sources array<string>, total int, sequence int, attempt int, verdict string, question_id string, error string"
OUT = "job_id string, action string, sequence int, attempt_count int, status string, validation_status string, question_id string, last_error string, completed_stages string"
_STATE = "state string"


def _item(job: str, k: int, source: str | None) -> dict:
    return {"sequence": k, "source": source, "status": "pending", "attempts": 0, "validation": None, "question": None, "error": None, "stages": []}


def _answered(item: dict, reply: dict) -> dict:
    """An item after the reply to its current attempt, as after_reply has it."""
    tries = item["attempts"] + 1
    if reply["verdict"] == "error":
        return item | {"attempts": tries, "error": reply["error"], "status": "failed" if tries >= MOST_ATTEMPTS else "pending"}
    if reply["verdict"] == "failed" and tries < MOST_ATTEMPTS:
        return item | {"attempts": tries, "status": "retryable", "validation": "failed", "stages": [s for s in item["stages"] if s not in UNDONE]}
    passed = reply["verdict"] == "passed"
    stages = ["analysis", "generation", "validation", "asset", "review"]
    return item | {
        "attempts": tries, "status": "completed" if passed else "needs_review", "validation": "passed" if passed else "needs_review", "question": reply["question_id"], "error": None,
        "stages": item["stages"] + [s for s in stages if s not in item["stages"]],
    }


def _run(job: dict) -> list[tuple[str, dict]]:
    """Use the waiting replies as far as they reach: what changed, and what to ask next."""
    out = []
    while job["cursor"] < len(job["items"]):
        item = job["items"][job["cursor"]]
        reply = job["waiting"].pop(f"{item['sequence']}:{item['attempts']}", None) if item["status"] != "failed" else None
        if reply is None:
            if item["status"] != "failed":
                out.append(("ask", item))
            break
        job["items"][job["cursor"]] = item = _answered(item, reply)
        out.append(("item", item))
        job["cursor"] += item["status"] in DONE
    return out


def _rows(job_id: str, changes: list[tuple[str, dict]]) -> pd.DataFrame:
    rows = [(job_id, a, i["sequence"], i["attempts"], i["status"], i["validation"], i["question"], i["error"], "+".join(i["stages"])) for a, i in changes]
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in OUT.split(", ")])


def _handle(timeout_ms: int):
    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = json.loads(state.get[0]) if state.exists else {"cursor": 0, "items": None, "waiting": {}}
        if state.hasTimedOut:
            changes = [("ask", job["items"][job["cursor"]])]
        else:
            for events in batches:
                for e in events.astype(object).where(events.notna(), None).itertuples(index=False):
                    if e.sequence is None:
                        if job["items"] is None:
                            sources = list(e.sources) if e.sources is not None else [None] * int(e.total or 0)
                            job["items"] = [_item(key[0], k, s) for k, s in enumerate(sources)]
                    else:
                        slot = f"{int(e.sequence)}:{int(e.attempt)}"
                        done = job["items"] is not None and int(e.sequence) < len(job["items"]) and job["items"][int(e.sequence)]["attempts"] > int(e.attempt)
                        if not done:
                            job["waiting"].setdefault(slot, {"verdict": e.verdict, "question_id": e.question_id, "error": e.error})
            changes = _run(job) if job["items"] is not None else []
        state.update((json.dumps(job),))
        open_ = job["items"] is not None and job["cursor"] < len(job["items"]) and job["items"][job["cursor"]]["status"] != "failed"
        if open_ and timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield _rows(key[0], changes)

    return handle


def run_jobs(events: DataFrame, timeout_ms: int = 0) -> DataFrame:
    """events (EVENTS: a job has no sequence, a reply has one) to what they change, as a stream in update mode.

    action is item (an item's new state) or ask (the item's question is to be made,
    attempt_count says which attempt). timeout_ms: after so long without a reply the
    question is asked again; 0 is never.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return events.where("job_id is not null").groupBy("job_id").applyInPandasWithState(_handle(timeout_ms), OUT, _STATE, "update", timeout)
