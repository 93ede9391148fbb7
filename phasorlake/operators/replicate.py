"""Multi-writer state: op logs, version vectors, merge rules, observed-remove sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasorlake.plans import running

PEER, COUNTER = "peer", "counter"


def apply(log: DataFrame, delta: DataFrame) -> DataFrame:
    """Union of ops, each (peer, counter) once: delivering again changes nothing."""
    return log.unionByName(delta).dropDuplicates([PEER, COUNTER])


def version(log: DataFrame) -> DataFrame:
    """(peer, counter): the last op seen of each writer."""
    return log.groupBy(PEER).agg(F.max(COUNTER).alias(COUNTER))


def updates_since(log: DataFrame, seen: DataFrame) -> DataFrame:
    """Ops after a version; a writer not in it is new."""
    v = seen.select(PEER, F.col(COUNTER).alias("_seen"))
    return log.join(v, PEER, "left").filter(F.col(COUNTER) > F.coalesce("_seen", F.lit(-1))).drop("_seen")


def refuse_stale(seen: DataFrame, trim: DataFrame) -> DataFrame:
    """The version, or an error if history before the trim point would be needed."""
    t = trim.select(PEER, F.col(COUNTER).alias("_trim"))
    ok = F.coalesce(F.col(COUNTER), F.lit(-1)) >= F.col("_trim") - 1
    bad = t.join(seen, PEER, "left").agg(F.count_if(~ok).alias("_bad"))
    checked = bad.select(F.assert_true(F.col("_bad") == 0, F.lit("the peer is behind the trim point")).alias("_ok"))
    return seen.crossJoin(F.broadcast(checked)).filter("_ok IS NULL").drop("_ok")


def latest(log: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, peer, value): each writer's latest value."""
    return log.groupBy(*keys, PEER).agg(F.max_by(value, COUNTER).alias(value))


def merged(log: DataFrame, keys: Sequence[str], value: str, rule: str = "sum") -> DataFrame:
    """(keys, value) over writers' latest shards: their sum, mean, or the shard of the lowest peer."""
    how = {"sum": F.sum(value), "mean": F.avg(value), "owner": F.min_by(value, PEER)}[rule]
    return latest(log, keys, value).groupBy(*keys).agg(how.alias(value))


def multi_values(log: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): what any writer last wrote and none of them took back (null)."""
    return latest(log, [key], value).filter(F.col(value).isNotNull()).select(key, value).distinct()


def grow_only(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys).distinct()


def split_point(df: DataFrame, axis: str, mass: str, share: float = 0.5) -> DataFrame:
    """One row, ``cut``: the least value at which the running mass reaches a share."""
    held = running(df, axis, mass)
    return held.filter(F.col("_before") + F.col("_w") >= F.col("_all") * share).agg(F.min(axis).alias("cut"))


def growth(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, ``slope`` of log y against log x."""
    return df.agg(F.regr_slope(F.log(y), F.log(x)).alias("slope"))


# observed-remove sets

def with_epochs(ops: DataFrame, peer: str, order: Sequence[str], size: int) -> DataFrame:
    """Ops with epoch and i: every ``size`` adds of a writer seal an epoch."""
    n = F.row_number().over(Window.partitionBy(peer).orderBy(*order)) - 1
    return ops.withColumn("_n", n).withColumn("epoch", F.floor(F.col("_n") / size).cast("int")).withColumn("i", (F.col("_n") % size).cast("int")).drop("_n")


def observed(adds: DataFrame, removed: DataFrame, removed_epochs: DataFrame | None = None, keys: Sequence[str] = ("peer", "epoch", "i")) -> DataFrame:
    """Adds that no tombstone names, by item or by epoch. An add is new even if an equal one was removed."""
    out = adds.join(removed.select(*keys).distinct(), list(keys), "left_anti")
    if removed_epochs is not None:
        out = out.join(removed_epochs.select("peer", "epoch").distinct(), ["peer", "epoch"], "left_anti")
    return out


def live_sum(live: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Bundles over the live items: no subtraction, so removing twice can't leave a phantom."""
    return live.groupBy(*by).agg(F.sum(value).alias("value"))


def strokes(live: DataFrame) -> DataFrame:
    """(peer, epoch, n): epochs with live items, by peer and number."""
    return live.groupBy("peer", "epoch").agg(F.count("*").alias("n")).orderBy("peer", "epoch")


def state_digest(live: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a hash of the set of rows, the same in any order."""
    h = F.xxhash64(*columns)
    return live.select(h.alias("_h")).distinct().agg(F.count("*").alias("n"), F.bit_xor("_h").alias("digest"))


def containers(log: DataFrame, container: str, prefix: str = "") -> DataFrame:
    return log.filter(F.col(container).startswith(prefix)).select(container).distinct()


def snapshot(log: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, peer, value, counter): each writer's latest of each key, and the op that said so: the whole state without its history."""
    return log.groupBy(*keys, PEER).agg(F.max_by(value, COUNTER).alias(value), F.max(COUNTER).alias(COUNTER))


def trim(log: DataFrame, seen: DataFrame) -> DataFrame:
    """Ops that a reader of the version ``seen`` still needs."""
    return updates_since(log, seen)


def add_wins(adds: DataFrame, removed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): values of live puts; a put that was not seen by a removal stays, whatever came when."""
    return observed(adds, removed).select(key, value).distinct()


def undo(live: DataFrame, peer: str = "peer", epoch: str = "epoch") -> DataFrame:
    """(peer, epoch): the tombstones that undo each writer's last stroke."""
    return live.groupBy(peer).agg(F.max(epoch).alias(epoch))


def known_fields(scores: DataFrame, rec: str, role: str, threshold: float) -> DataFrame:
    """(rec, role, label, score): the fields that a record has, of all roles in the registry: reads at or over a threshold."""
    return scores.filter(F.col("score") >= threshold).select(rec, role, "label", "score")
