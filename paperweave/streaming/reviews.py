"""Plans that go on round by round, as keyed state of a stream: what each review means for its plan, however reviews are spread over batches.

A plan's state is its fingerprint, round, stage and the ids of the reviews seen; in a stream that runs on, it goes after a time
without any (an available-now run with such timeouts would never end, as Spark asks for one more batch again and again). A review that was
seen is not counted again, so a batch that is sent twice changes nothing. One whose fingerprint is not the plan's is refused
and leaves the plan as it is, as does one with anything wrong; both may be sent again, mended, under another id.

State is read and written once for each plan and batch, with the rows in Arrow batches; what it holds is one plan's reviews.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import text_of

MOST_ROUNDS, TTL_MS = 4, 30 * 24 * 3600 * 1000
OUTPUT = "plan_id string, review_id string, round int, stage string, follow_ups array<string>"
STATE = "fingerprint string, round int, stage string, seen array<string>"
FOLLOW_UP, COMPLETE, USED = "follow_up", "complete", "rounds_used"


def fingerprint(*parts: Column) -> Column:
    """What a plan is about: its query, claims and scope, white space apart."""
    clean = [F.trim(F.regexp_replace(text_of(p.cast("string")), r"\s+", " ")) for p in parts]
    return F.sha2(F.array_join(F.array(*clean), "\x1f"), 256)


def step(mark: str, number: int, stage: str, review: dict) -> tuple[str, int, str]:
    """What one review of a plan is answered with, and the plan's round and stage after it."""
    if stage in (COMPLETE, USED):
        return "closed", number, stage
    if review["fingerprint"] != mark:
        return "invalid_analysis_context", number, stage
    if review["problem"] is not None:
        return "invalid_review", number, stage
    if not review["open_claims"]:
        return COMPLETE, number, COMPLETE
    if number >= min(MOST_ROUNDS, max(1, review["most_rounds"] or MOST_ROUNDS)):
        return USED, number, USED
    return FOLLOW_UP, number + 1, FOLLOW_UP


def _expiring(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    yield from _answer(key, frames, state)
    state.setTimeoutDuration(TTL_MS)


def _answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mark, number, stage, seen = state.get if state.exists else (None, 1, "started", [])
    known, out = set(seen), []
    rows = pd.concat(list(frames)).astype(object)
    rows = rows.where(rows.notna(), None).to_dict("records")
    for r in sorted(rows, key=lambda r: (r["pos"] is None, r["pos"] or 0, r["review_id"])):
        if r["review_id"] in known:
            continue
        known.add(r["review_id"])
        r["open_claims"] = sorted(r["open_claims"]) if r["open_claims"] is not None else []
        mark = r["fingerprint"] if mark is None else mark
        said, number, stage = step(mark, number, stage, r)
        out.append((key[0], r["review_id"], number, said, r["open_claims"] if said == FOLLOW_UP else []))
    state.update((mark, number, stage, sorted(known)))
    yield pd.DataFrame(out, columns=["plan_id", "review_id", "round", "stage", "follow_ups"])


def continued(reviews: DataFrame, expiring: bool = False) -> DataFrame:
    """(OUTPUT), one row for each review that was not seen before. reviews, a stream: plan_id, review_id, fingerprint, pos (reviews of a batch count in this order, then by id), problem (or null), open_claims array<string>, most_rounds. The state is kept by RocksDB (see events.STATE_STORE). expiring: the state of a plan goes after TTL_MS without a review."""
    return reviews.groupBy("plan_id").applyInPandasWithState(_expiring if expiring else _answer, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expiring else GroupStateTimeout.NoTimeout)
