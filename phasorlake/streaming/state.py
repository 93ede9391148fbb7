"""Structured Streaming forms of the stateful operators; each equals its batch twin on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def op_log(ops: DataFrame, time: str, delay: str) -> DataFrame:
    """Each (peer, counter) once, however often it is delivered within the delay."""
    return ops.withWatermark(time, delay).dropDuplicatesWithinWatermark(["peer", "counter"])


def late(ops: DataFrame, trim: DataFrame) -> DataFrame:
    """Ops behind the trim point (peer, counter), to be refused aloud rather than dropped."""
    t = trim.select("peer", F.col("counter").alias("_trim"))
    return ops.join(t, "peer").filter("counter < _trim").drop("_trim")


def running_bundle(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Signed sums by key, for update mode: a retraction is a row of weight -1."""
    return rows.groupBy(*keys).agg(F.sum(F.col(value) * F.col(weight)).alias(value))


def sliding(rows: DataFrame, time: str, delay: str, size: str, slide: str, keys: list[str]) -> DataFrame:
    """Counts by overlapping time tiles, closed by the watermark."""
    w = rows.withWatermark(time, delay).groupBy(F.window(time, size, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), *keys, "n")


def strokes(rows: DataFrame, time: str, delay: str, gap: str, peer: str) -> DataFrame:
    """Epochs by a writer's pauses: session windows."""
    w = rows.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), peer).agg(F.count("*").alias("n"))
    return w.select(peer, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def killed_runs(started: DataFrame, ended: DataFrame, delay: str, patience: str) -> DataFrame:
    """Starts with the end that comes within ``patience``; null once the watermark has passed it."""
    s = started.select("run", F.col("at").alias("started")).withWatermark("started", delay)
    e = ended.select(F.col("run").alias("_run"), F.col("at").alias("ended")).withWatermark("ended", delay)
    on = F.expr(f"run = _run AND ended >= started AND ended <= started + interval {patience}")
    return s.join(e, on, "leftOuter").select("run", "started", "ended")


def observed_remove(ops: DataFrame) -> DataFrame:
    """(name, item, live): each item that a batch speaks of, and whether it is in its set now, for update mode.

    ``ops`` has name, op (add or remove) and item. A remove that comes before its add is
    kept as a tombstone; a new item is live whatever was removed before it. The state is
    two flags for each item, so a set of any size is spread over all tasks."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        added, gone = state.get if state.exists else (False, False)
        for pdf in batches:
            gone = gone or bool((pdf["op"] == "remove").any())
            added = added or bool((pdf["op"] == "add").any())
        state.update((added, gone))
        yield pd.DataFrame({"name": [key[0]], "item": [key[1]], "live": [added and not gone]})

    return ops.groupBy("name", "item").applyInPandasWithState(step, "name string, item string, live boolean", "added boolean, gone boolean", "update", GroupStateTimeout.NoTimeout)
