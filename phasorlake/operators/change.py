"""Scenes compared: frames, insertions, null maps, tiles, turned and shifted copies, spectra under masks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasorlake.operators.analytics import nearest_within
from phasorlake.operators.fields import phase
from phasorlake.operators.scenes import weighted_quantile
from phasorlake.plans import quantile as exact_quantile
from phasorlake.plans import running
from phasorlake.space import Space


def insert(scene: DataFrame, obj: DataFrame, axes: Sequence[str], by: Sequence[float]) -> DataFrame:
    """The scene and, moved, an object."""
    return scene.unionByName(obj.withColumns({a: F.col(a) + F.lit(float(t)) for a, t in zip(axes, by)}))


def fixed_frame(df: DataFrame, axes: Sequence[str], centre: Sequence[float], half: float, floor: float = 1e-12) -> DataFrame:
    """Axes scaled so that a given box is [-1, 1]; rows outside go."""
    out = df
    for a, c in zip(axes, centre):
        out = out.withColumn(f"{a}_n", (F.col(a) - F.lit(float(c))) / F.lit(max(half, floor)))
    return out.filter(" AND ".join(f"abs({a}_n) <= 1" for a in axes))


def core_box(df: DataFrame, axes: Sequence[str], weight: str, share: float) -> DataFrame:
    """One row: the low and high ends, by axis, between which ``share`` of the weight lies."""
    out = None
    for a in axes:
        q = weighted_quantile(df, a, weight, [(1 - share) / 2, (1 + share) / 2])
        one = q.agg(F.min(a).alias(f"{a}_low"), F.max(a).alias(f"{a}_high"))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # a row each
    return out


def null_threshold(maps: Sequence[DataFrame], value: str, quantile: float) -> DataFrame:
    """One row, ``threshold``: a quantile of magnitudes pooled over maps without change."""
    pool = maps[0].select(F.abs(value).alias("_v"))
    for m in maps[1:]:
        pool = pool.unionByName(m.select(F.abs(value).alias("_v")))
    return pool.sparkSession.createDataFrame([(exact_quantile(pool, "_v", quantile),)], "threshold double")


def changed(current: DataFrame, value: str, threshold: DataFrame) -> DataFrame:
    """Rows whose magnitude is over the threshold."""
    return current.crossJoin(F.broadcast(threshold)).filter(F.abs(value) > F.col("threshold")).drop("threshold")


def distance_change(points: DataFrame, key: str, before: DataFrame, after: DataFrame, item: str, axes: Sequence[str], radius: float) -> DataFrame:
    """(key, change): how the distance to the nearest row differs; none within the radius counts as the radius."""
    a = nearest_within(points, key, before, item, axes, radius).select(key, F.coalesce("dist", F.lit(float(radius))).alias("_a"))
    b = nearest_within(points, key, after, item, axes, radius).select(key, F.coalesce("dist", F.lit(float(radius))).alias("_b"))
    return a.join(b, key).select(key, F.abs(F.col("_a") - F.col("_b")).alias("change"))


def tile_change(tiles: DataFrame, keys: Sequence[str], nulls: DataFrame, score: str = "score", before: str = "before", after: str = "after") -> DataFrame:
    """Tiles with ``change``: occupied at one time only, or scoring under the null's mean less three of its deviations.

    ``nulls`` are (keys, score) of pairs without change."""
    stats = nulls.groupBy(*keys).agg((F.avg(score) - 3 * F.stddev_pop(score)).alias("_least"))
    one_sided = (F.col(before) > 0) != (F.col(after) > 0)
    return tiles.join(stats, list(keys), "left").withColumn("change", one_sided | F.coalesce(F.col(score) < F.col("_least"), F.lit(False))).drop("_least")


def yaw(df: DataFrame, x: str, z: str, angle: float) -> DataFrame:
    """Rows turned about the upright axis."""
    c, s = F.lit(float(np.cos(angle))), F.lit(float(np.sin(angle)))
    return df.withColumns({x: c * F.col(x) + s * F.col(z), z: c * F.col(z) - s * F.col(x)})


def scramble(df: DataFrame, key: str, fixed: Sequence[str], moved: Sequence[str], seed: str) -> DataFrame:
    """Rows with the columns ``moved`` dealt out among them by hash: what is there stays, where it is doesn't.

    Keys are distinct, and so are 60 bits of their hashes. Ranks come from running sums by ranges, so no task orders all rows."""
    def ranked(side: str, columns: Sequence[str]) -> DataFrame:
        digest = F.substring(F.md5(F.concat(F.lit(f"{seed}|{side}|"), F.col(key).cast("string"))), 1, 15)
        h = df.select(F.conv(digest, 16, 10).cast("long").alias("_h"), key, *columns).withColumn("_1", F.lit(1))
        return h.join(running(h.select("_h", "_1"), "_h", "_1").select("_h", F.col("_before").alias("_rank")), "_h").drop("_h", "_1")

    return ranked("a", fixed).join(ranked("b", moved).drop(key), "_rank").drop("_rank")


def phase_surrogate(space: Space, field: DataFrame, seed: str) -> DataFrame:
    """The field with the same power and hash-derived phases."""
    m = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    t = space.theta(F.lit(seed), F.col("j"))
    return field.withColumns({"_m": m, "_t": t}).withColumns({"re": F.col("_m") * F.cos("_t"), "im": F.col("_m") * F.sin("_t")}).drop("_m", "_t")


def masked(table: DataFrame, axes: int, share: float) -> DataFrame:
    """Frequencies whose length is at least a share of the longest."""
    r = F.sqrt(sum((F.col(f"w{k}") * F.col(f"w{k}") for k in range(axes)), F.lit(0.0)))
    top = table.agg(F.max(r).alias("_top"))
    return table.crossJoin(F.broadcast(top)).filter(r >= F.lit(share) * F.col("_top")).drop("_top")


def correlate(a: DataFrame, b: DataFrame, table: DataFrame, shifts: DataFrame, axes: Sequence[str], whiten: bool = True) -> DataFrame:
    """(shift columns, score) of all asked shifts: how well b, moved back, lies on a. Shifts have ``t<k>``; no energy scores 0."""
    x = a.select("j", F.col("re").alias("_ar"), F.col("im").alias("_ai")).join(b.select("j", F.col("re").alias("_br"), F.col("im").alias("_bi")), "j")
    cross = x.select("j", (F.col("_br") * F.col("_ar") + F.col("_bi") * F.col("_ai")).alias("_r"), (F.col("_bi") * F.col("_ar") - F.col("_br") * F.col("_ai")).alias("_i"))
    m = F.sqrt(F.col("_r") * F.col("_r") + F.col("_i") * F.col("_i"))
    d = F.when(m > 1e-12, m) if whiten else F.lit(1.0)
    cross = cross.withColumns({"_cr": F.coalesce(F.col("_r") / d, F.lit(0.0)), "_ci": F.coalesce(F.col("_i") / d, F.lit(0.0))}).join(table, "j")
    t = sum((F.col(f"w{k}") * F.col(f"t{k}") for k in range(len(axes))), F.lit(0.0))
    df = shifts.crossJoin(cross).withColumn("_t", t)  # a stated grid against dim rows
    total = F.sum(F.sqrt(F.col("_cr") * F.col("_cr") + F.col("_ci") * F.col("_ci")))
    score = F.sum(F.col("_cr") * F.cos("_t") + F.col("_ci") * F.sin("_t")) / total
    return df.groupBy(*[f"t{k}" for k in range(len(axes))]).agg(F.when(total > 0, score).otherwise(F.lit(0.0)).alias("score"))


def grid_shifts(spark, axes: int, reach: float, steps: int, centre: Sequence[float] | None = None) -> DataFrame:
    """(t0, t1, ...): a grid of shifts around a centre."""
    out = None
    for k in range(axes):
        c = float(centre[k]) if centre is not None else 0.0
        one = spark.range(2 * steps + 1).select((F.lit(c) + (F.col("id") - steps) * F.lit(reach / steps)).alias(f"t{k}"))
        out = one if out is None else out.crossJoin(one)
    return out


def find_shift(a: DataFrame, b: DataFrame, table: DataFrame, axes: Sequence[str], reach: float, steps: int = 8, rounds: int = 3, whiten: bool = True) -> tuple[list[float], float]:
    """The best shift and its score: a coarse grid, then ``rounds`` finer ones around the best so far."""
    spark, centre = table.sparkSession, [0.0] * len(axes)
    score = 0.0
    for _ in range(rounds + 1):
        s = correlate(a, b, table, grid_shifts(spark, len(axes), reach, steps, centre), axes, whiten)
        names = [f"t{k}" for k in range(len(axes))]
        best = s.orderBy(F.round("score", 12).desc(), *names).first()
        if best is None:
            break
        centre, score, reach = [best[n] for n in names], best["score"], reach / steps * 1.5
        steps = 3
    return centre, score


def best_yaw(scene: DataFrame, field: DataFrame, table: DataFrame, axes: Sequence[str], weight: str, angles: Sequence[float]) -> DataFrame:
    """(angle, cos) of the scene turned by each angle against a field: all angles in one pass."""
    from phasorlake.space import cosine

    x, z = axes[0], axes[-1]
    turned = scene.withColumn("angle", F.explode(F.array(*[F.lit(float(a)) for a in angles])))
    c, s = F.cos("angle"), F.sin("angle")
    turned = turned.withColumns({x: c * F.col(x) + s * F.col(z), z: c * F.col(z) - s * F.col(x)})
    df = turned.crossJoin(table).withColumn("_t", phase(axes))
    sums = df.groupBy("angle", "j").agg(F.sum(F.col(weight) * F.cos("_t")).alias("re"), F.sum(F.col(weight) * F.sin("_t")).alias("im"))
    return cosine(sums, field.select("j", F.col("re").alias("bre"), F.col("im").alias("bim")), ["angle"])


def error_decades(df: DataFrame, truth: str, recon: str, least: int = -4) -> DataFrame:
    """(decade, n, median, p90) of relative errors by the power of ten of truth over its largest; zeros are left out."""
    top = df.agg(F.max(F.abs(truth)).alias("_top"))
    out = df.crossJoin(F.broadcast(top)).filter(F.col(truth) != 0)
    decade = F.greatest(F.lit(least), F.floor(F.log10(F.abs(truth) / F.col("_top")))).cast("int")
    e = F.abs(F.col(recon) - F.col(truth)) / F.abs(truth)
    return out.select(decade.alias("decade"), e.alias("_e")).groupBy("decade").agg(F.count("*").alias("n"), F.percentile("_e", F.lit(0.5)).alias("median"), F.percentile("_e", F.lit(0.9)).alias("p90"))


def census(df: DataFrame, scan: str, label: str, least: int) -> DataFrame:
    """One row: scans, classes, and objects in a scan: least, quartiles, 95th percentile, scans with ``least`` or more."""
    n = df.groupBy(scan).agg(F.count("*").alias("_n"))
    stats = n.agg(F.count("*").alias("scans"), F.min("_n").alias("fewest"), *[F.percentile("_n", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.95)], F.count_if(F.col("_n") >= least).alias("rich"))
    return stats.crossJoin(F.broadcast(df.agg(F.count_distinct(label).alias("classes"))))


def weighted_percentiles(df: DataFrame, value: str, weight: Column, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, share, value): percentiles of values repeated as often as a whole weight says."""
    out = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(s)) for s in shares]), weight).alias("_v"))
    return out.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("_v").alias("value"))).alias("x")).select(*by, "x.share", F.col("x.value").alias(value))


def match_metrics(truth: DataFrame, found: DataFrame, key: str, what: str, where: Sequence[str], tolerance: float) -> DataFrame:
    """One row: the shares of true objects whose name, whose place, and whose both some finding of their scene has."""
    f = found.select(key, F.col(what).alias("_w"), *[F.col(a).alias(f"_{a}") for a in where])
    near = F.lit(True)
    for a in where:
        near = near & (F.abs(F.col(a) - F.col(f"_{a}")) <= tolerance)
    both = truth.withColumn("_id", F.struct(key, what, *where)).join(f, key, "left")
    named = F.coalesce(F.col(what) == F.col("_w"), F.lit(False))
    placed = F.coalesce(near, F.lit(False))
    each = both.groupBy("_id").agg(F.bool_or(named).alias("n"), F.bool_or(placed).alias("p"), F.bool_or(named & placed).alias("b"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    return each.agg(share("n").alias("named"), share("p").alias("placed"), share("b").alias("both"))


def object_frames(points: DataFrame, obj: str, axes: Sequence[str], weight: str) -> DataFrame:
    """(obj, <axis>_c, rms): weighted centres, and the root of the weighted mean square distance to them."""
    w = F.sum(weight)
    mean = lambda e: F.sum(F.col(weight) * e) / w
    square = sum((mean(F.col(a) * F.col(a)) - mean(F.col(a)) * mean(F.col(a)) for a in axes), F.lit(0.0))
    return points.groupBy(obj).agg(*[mean(F.col(a)).alias(f"{a}_c") for a in axes], F.sqrt(F.greatest(square, F.lit(0.0))).alias("rms"))


def prototypes(vectors: DataFrame, group: str) -> DataFrame:
    """(group, j, re, im): the instances' sum, each component brought to the unit circle."""
    from phasorlake.space import bundle, normalize

    return normalize(bundle(vectors, [group]))
