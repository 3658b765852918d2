"""Batches that go on after a stop: items are worked on stride by stride, each stride one Spark job, and a manifest says what is done.

A manifest names the input (a hash of all rows), the options and the finished strides with the folders of their results; it is published
after each stride, whole or not at all. So a run that was killed goes on with its first unfinished stride, and one that
is resumed with another input or other options is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import manifests
from .lifecycle import blank_safe

STRIDES, VERSION = 20, 1


def input_hash(items: DataFrame) -> str:
    """Equal for equal rows in any order, repeated ones counted."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(items.columns)])
    n, a, b = items.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(h)), F.lit(0))).first()
    return f"{n}-{a}-{b}-{','.join(sorted(items.columns))}"


class Batch:
    """A batch of `items` (row_no, distinct; the key columns; more) in a shared folder."""

    def __init__(self, items: DataFrame, keys: list[str], path: str, options: dict | None = None, strides: int = STRIDES):
        self.items, self.keys, self.path, self.strides = items, keys, path, strides
        self.spark, self.options = items.sparkSession, json.loads(json.dumps(options or {}))

    def _state(self) -> dict:
        low, high = self.items.agg(F.min("row_no"), F.max("row_no")).first()
        width = 1 if low is None else -(-(high - low + 1) // self.strides)
        return {"version": VERSION, "input": input_hash(self.items), "options": self.options, "first": low or 0, "width": width, "done": {}, "stopped": False}

    def results(self) -> DataFrame | None:
        """The results of all finished strides."""
        _, state = manifests.latest(self.spark, self.path)
        return self._read(state) if state and state["done"] else None

    def _read(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{folder}" for folder in state["done"].values()])

    def run(self, work: Callable[[DataFrame], DataFrame], resume: bool = False, stop_on_error: bool = False, most_strides: int | None = None) -> dict:
        """Work on what is not done yet; gives the final manifest.

        work takes items and returns (row_no, ok boolean, status, more), one row each. Items of one key share the work of the first of
        them, and get its result with deduplicated_from_row. With stop_on_error, no stride is begun after one in which something
        failed. ValueError: there is a manifest and resume is not asked, or its input or options are others. most_strides
        ends the run early, as a stop from outside would.
        """
        state = self._state()
        number, before = manifests.latest(self.spark, self.path)
        if before and not resume:
            raise ValueError("this batch was begun before: resume it, or give it another folder")
        if before:
            for what in ("version", "input", "options", "first", "width"):
                if before[what] != state[what]:
                    raise ValueError(f"{what} of the batch has changed: begin it anew in another folder")
            state = {**before, "stopped": False}
        lead = F.min("row_no").over(Window.partitionBy(*blank_safe(self.keys)))
        planned = self.items.withColumn("deduplicated_from_row", F.when(lead != F.col("row_no"), lead))
        stride = F.floor((F.col("row_no") - state["first"]) / state["width"]).cast("int")
        for s in range(self.strides):
            if str(s) in state["done"]:
                continue
            if most_strides is not None and most_strides <= 0:
                break
            mine = planned.where(stride == s)
            folder = f"stride={s}-{uuid.uuid4().hex[:8]}"
            own = work(mine.where("deduplicated_from_row is null").drop("deduplicated_from_row")).withColumn("deduplicated_from_row", F.lit(None).cast("long"))
            own.write.parquet(f"{self.path}/{folder}/own")
            state["done"][str(s)] = f"{folder}/*"
            # The first of a key is in this stride or an earlier one.
            columns = [c for c in own.columns if c not in ("row_no", "deduplicated_from_row")]
            leads = self._read(state).where("deduplicated_from_row is null").select(F.col("row_no").alias("_lead"), *columns)
            shared = mine.where("deduplicated_from_row is not null").select("row_no", F.col("deduplicated_from_row").cast("long").alias("deduplicated_from_row"))
            shared.join(leads, F.col("deduplicated_from_row") == F.col("_lead")).select(own.columns).write.parquet(f"{self.path}/{folder}/shared")
            failed = not self._read({"done": {s: f"{folder}/*"}}).where("not ok").isEmpty()
            state["stopped"] = stop_on_error and failed
            number += 1
            manifests.publish(self.spark, self.path, number, state)
            if state["stopped"]:
                break
            most_strides = None if most_strides is None else most_strides - 1
        return state
