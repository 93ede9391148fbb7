"""Compositions of the operators: capacity, two-stage search, change, retrieval, storage, compaction."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasorlake.functions import gauss, text, uniform
from phasorlake.operators import fields, structures
from phasorlake.operators.pairs import best_items
from phasorlake.operators.scenes import cells_in_reach
from phasorlake.plans import first_by, running
from phasorlake.space import Space, pair, scores


def null_share(fraction: float) -> float:
    """Of the squares of normal errors, the share that the largest ``fraction`` holds."""
    z = NormalDist().inv_cdf(1 - fraction / 2)
    return fraction + 2 * z * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def false_positive_rate(members: Column, dim: int, threshold: float = 0.5) -> Column:
    """Chance that a stranger's score passes the threshold: a normal tail of deviation sqrt(members / (2 dim)), by its series of five terms."""
    x = F.lit(threshold) / F.sqrt(members / F.lit(2.0 * dim))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return poly * F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))


def map_capacity(space: Space, spark, loads: Sequence[int], values: int) -> DataFrame:
    """(load, recall): the share of pairs that a map of each load gives back."""
    grid = spark.createDataFrame([(n,) for n in loads], "load int").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("load") - 1)))
    rows = grid.select("load", F.concat(F.lit("key"), "load", F.lit("."), "i").alias("k"), F.concat(F.lit("val"), F.floor(uniform(text("val", F.col("load"), F.col("i"))) * values).cast("int")).alias("v"))
    memory = structures.map_bundle(space, rows, "k", "v", by=("load",))
    asked = structures._coded(space, rows.select("load", "k"), k="k").join(memory, ["load", "j"])
    from phasorlake.space import cleanup, codebook, unbind

    re, im = unbind(pair(), pair("k_re", "k_im"))
    got = cleanup(asked.select("k", "j", re.alias("re"), im.alias("im")), codebook(space, rows, "v"), ["k"], space.dim)
    return rows.join(got, "k").groupBy("load").agg(F.avg((F.col("v") == F.col("label")).cast("double")).alias("recall"))


def coarse_fine(queries: DataFrame, key: str, items: DataFrame, item: str, group: str, vector: str, top: int) -> DataFrame:
    """(key, item, score): the ``top`` groups of nearest centre, then the best item in them."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    centre = items.select(group, F.posexplode(vector).alias("j", "v")).groupBy(group, "j").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centre = centre.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("_c"))
    q = queries.select(key, F.col(vector).alias("_q"))
    near = first_by(q.crossJoin(centre).withColumn("_s", F.round(dot("_q", "_c"), 9)), [key], [F.col("_s").desc(), F.col(group).asc()], top)
    fine = best_items(near.select(key, F.col("_q").alias("_v"), group), key, items.select(F.col(item).alias("item"), group, F.col(vector).alias("_v")), "item", "_v", 1, [group], others=False)
    return fine.select(key, "item", F.col("cos").alias("score"))


def cell_read(space: Space, points: DataFrame, key: str, splats: DataFrame, table: DataFrame, axes: Sequence[str], size: float, reach: float, weight: str) -> DataFrame:
    """(key, value, consulted): each point read from the fields of the cells in reach only, and their number."""
    names = ["ci", "cj", "ck"][: len(axes)]
    bundles = fields.cell_fields(splats, table, axes, size, [weight])
    near = cells_in_reach(points.select(key, *axes), bundles.select(*names).distinct(), axes, names, size, reach)
    read = near.join(bundles, names).join(table, "j").withColumn("_t", fields.phase(axes))
    got = read.groupBy(key).agg((F.sum(F.col(f"{weight}_re") * F.cos("_t") + F.col(f"{weight}_im") * F.sin("_t")) / F.lit(float(space.dim))).alias("value"), F.count_distinct(*names).alias("consulted"))
    return points.select(key).join(got, key, "left").select(key, F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("consulted", F.lit(0)).alias("consulted"))


def drift(points: DataFrame, key: str, axes: Sequence[str], weight: str, sigma: float, gain: float, seed: int = 0) -> DataFrame:
    """Points jittered by hash-derived normal noise, weights by a lognormal gain."""
    out = {a: F.col(a) + F.lit(sigma) * gauss(text(seed, "drift", a, F.col(key))) for a in axes}
    return points.withColumns(out | {weight: F.col(weight) * F.exp(F.lit(gain) * gauss(text(seed, "gain", F.col(key))))})


def split_some(points: DataFrame, key: str, axes: Sequence[str], weight: str, share: float, sigma: float, seed: int = 0) -> DataFrame:
    """Points of which a hash-drawn share are two, side by side, with half the weight each."""
    two = uniform(text(seed, "split", F.col(key))) < share
    rows = points.withColumn("_side", F.explode(F.when(two, F.array(F.lit(-1.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0)))))
    out = {a: F.col(a) + F.col("_side") * F.lit(sigma) * gauss(text(seed, "step", a, F.col(key))) for a in axes}
    return rows.withColumns(out | {weight: F.when(F.col("_side") == 0, F.col(weight)).otherwise(F.col(weight) / 2)}).drop("_side")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The signed difference of two bundles; a dimension missing on a side is 0 there."""
    x, y = a.select("j", F.col("re").alias("_ar"), F.col("im").alias("_ai")), b.select("j", F.col("re").alias("_br"), F.col("im").alias("_bi"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.join(y, "j", "full").select("j", (zero("_ar") - zero("_br")).alias("re"), (zero("_ai") - zero("_bi")).alias("im"))


def retrieval(pairs: DataFrame, query: str, item: str, score: str, positive: Column) -> DataFrame:
    """(query, hit, best_positive, best_negative): whether the best item is a positive; the least item of equals."""
    best = pairs.groupBy(query).agg(F.max_by(positive, F.struct(score, -F.col(item))).alias("hit"), F.max(F.when(positive, F.col(score))).alias("best_positive"), F.max(F.when(~positive, F.col(score))).alias("best_negative"))
    return best


def pair_statistics(pairs: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """(keys, mean, sigma, p95, top) of scored pairs."""
    return pairs.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sigma"), F.percentile(score, F.lit(0.95)).alias("p95"), F.max(score).alias("top"))


def sampled_distances(points: DataFrame, key: str, axes: Sequence[str], pairs: int, seed: int = 0) -> DataFrame:
    """(pair, d): distances of hash-drawn pairs of points, of any distinct keys: drawn by rank, so that gaps lose nothing."""
    ranks = running(points.select(key).withColumn("_1", F.lit(1)), key, "_1").select(key, F.col("_before").cast("long").alias("_r"), F.col("_all").alias("_n"))
    p = points.select(key, *axes).join(ranks, key)
    n = ranks.agg(F.max("_n").alias("_n"))
    draw = points.sparkSession.range(pairs).crossJoin(F.broadcast(n)).filter("_n > 0")  # one row
    draw = draw.select(F.col("id").alias("pair"), *[F.floor(uniform(text(seed, side, F.col("id"))) * F.col("_n")).cast("long").alias(side) for side in ("a", "b")])
    side = lambda s: p.select(F.col("_r").alias(s), *[F.col(x).alias(f"{x}_{s}") for x in axes])
    d2 = sum(((F.col(f"{x}_a") - F.col(f"{x}_b")) * (F.col(f"{x}_a") - F.col(f"{x}_b")) for x in axes), F.lit(0.0))
    return draw.join(side("a"), "a").join(side("b"), "b").select("pair", F.sqrt(d2).alias("d"))


def storage_position(rows: DataFrame, scene: str, splats: Column, cells: Column, band_cells: Column, dim: int, bits: int) -> DataFrame:
    """(scene, bytes, per_splat, ratio, median_ratio): bundle bytes against 16 a splat; cells must be the sum over bands."""
    size = (cells * F.lit(dim * 2 * bits // 8)).cast("double")
    out = rows.select(scene, size.alias("bytes"), (size / splats).alias("per_splat"), (size / (splats * 16)).alias("ratio"), F.assert_true(cells == band_cells, F.lit("cells don't add up over bands")).alias("_ok"))
    middle = out.agg(F.median("ratio").alias("median_ratio"))
    return out.filter("_ok IS NULL").drop("_ok").crossJoin(F.broadcast(middle))


def resume(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned rows that no record names yet."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def compact(adds: DataFrame, removed: DataFrame, keys: Sequence[str] = ("peer", "epoch", "i")) -> tuple[DataFrame, DataFrame]:
    """Adds without the removed ones, and the tombstones that named none of them and so must stay."""
    tombs = removed.select(*keys).distinct()
    return adds.join(tombs, list(keys), "left_anti"), tombs.join(adds.select(*keys).distinct(), list(keys), "left_anti")


def fuzzy_findings(probes: DataFrame, probe: str, cosines: DataFrame, chunk: str, exact: DataFrame | Column, threshold: float, k: int = 3) -> DataFrame:
    """(probe, chunk, cos): the k best chunks at or over a threshold that no exact hit has named.

    Exact hits are rows (probe, chunk), or a condition on the cosines' rows, for which nothing is joined."""
    rows = cosines.filter(F.col("cos") >= threshold)
    rows = rows.filter(~F.coalesce(exact, F.lit(False))) if isinstance(exact, Column) else rows.join(exact.select(probe, chunk).distinct(), [probe, chunk], "left_anti")
    return first_by(rows.join(probes.select(probe).distinct(), probe, "left_semi"), [probe], [F.col("cos").desc(), F.col(chunk).asc()], k)


def group_scores(queries: DataFrame, book: DataFrame, key: str, dim: int, k: int) -> DataFrame:
    """The k nearest codewords of each query."""
    return first_by(scores(queries, book, [key], dim), [key], [F.col("score").desc(), F.col("label").asc()], k)


def first_meeting(rows: DataFrame, by: Sequence[str], size: str, gate: Column) -> DataFrame:
    """(by, size): the least size that passes a gate, such as a crossover of bytes or a knee of recall; null where none does."""
    return rows.groupBy(*by).agg(F.min(F.when(gate, F.col(size))).alias(size))


def refuse_over(rows: DataFrame, size: Column, most: float, what: str) -> DataFrame:
    """The rows, or an error before any work on them if the sum of projected sizes is over a budget."""
    sure = rows.agg(F.sum(size).alias("_s")).select(F.assert_true(F.coalesce(F.col("_s"), F.lit(0)) <= F.lit(most), F.lit(f"{what}: over the budget")).alias("_ok"))
    return rows.crossJoin(F.broadcast(sure)).filter("_ok IS NULL").drop("_ok")


def bundle_bytes(rows: DataFrame, keys: Sequence[str], cells: Sequence[str], dim: int, kinds: dict[str, float]) -> DataFrame:
    """(keys, kind, splats, cells, bytes, per_splat): what a scene's cell bundles take by codec (bytes for a dimension), against its splats."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("splats"), F.count_distinct(*cells).alias("cells"))
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(b)).alias("b")) for k, b in kinds.items()]))
    out = n.withColumn("_k", kind).withColumn("bytes", F.col("cells") * F.lit(dim) * F.col("_k.b"))
    return out.select(*keys, "_k.kind", "splats", "cells", "bytes", (F.col("bytes") / F.col("splats")).alias("per_splat"))
