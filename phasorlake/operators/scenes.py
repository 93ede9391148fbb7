"""The relational layer of scenes: quantiles, crops, bands, cells, slices, lattices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasorlake.functions import bucket, clip
from phasorlake.plans import cell, neighbours, running


def weighted_quantile(df: DataFrame, value: str, weight: str, q: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q, value): linear between midpoints of the cumulative weights; ends are held.

    Equal values are summed first, and values are ordered by ranges: no task holds a
    group's values."""
    held = running(df.filter(F.col(weight) != 0), value, weight, by).filter(F.col("_w") > 0)
    middle = (F.col("_before") + F.col("_w") / 2) / F.col("_all")
    below = (F.col("_lowbefore") + (F.col("_before") - F.col("_lowbefore")) / 2) / F.col("_all")  # the next lower value's
    held = held.withColumns({"_m": middle, "_pm": below, "_pv": F.col("_low")})
    asked = held.withColumn("q", F.explode(F.array(*[F.lit(float(x)) for x in q])))
    inside = F.col("_pm").isNotNull() & (F.col("q") > F.col("_pm")) & (F.col("q") <= F.col("_m"))
    between = F.col("_pv") + (F.col(value) - F.col("_pv")) * (F.col("q") - F.col("_pm")) / (F.col("_m") - F.col("_pm"))
    v = F.when(inside, between).when(F.col("_pm").isNull() & (F.col("q") <= F.col("_m")), F.col(value)).when(F.col("_last") & (F.col("q") > F.col("_m")), F.col(value))
    return asked.withColumn("_v", v).filter("_v IS NOT NULL").select(*by, "q", F.col("_v").alias(value))


def mass_crop(df: DataFrame, axes: Sequence[str], weight: str, floor: float, keep: float) -> DataFrame:
    """Rows of weight >= floor inside the cube around the weighted median that holds the
    share ``keep`` of the weight, with axes scaled to [-1, 1] in ``<axis>_n``."""
    df = df.filter(F.col(weight) >= floor)
    centre = reduce(DataFrame.crossJoin, [weighted_quantile(df, a, weight, [0.5]).select(F.col(a).alias(f"_c_{a}")) for a in axes])
    df = df.crossJoin(F.broadcast(centre))  # one row
    df = df.withColumn("_r", F.greatest(*[F.abs(F.col(a) - F.col(f"_c_{a}")) for a in axes]))
    radius = weighted_quantile(df, "_r", weight, [keep]).select(F.col("_r").alias("_radius"))
    df = df.crossJoin(F.broadcast(radius)).filter("_r <= _radius")
    for a in axes:
        df = df.withColumn(f"{a}_n", (F.col(a) - F.col(f"_c_{a}")) / F.when(F.col("_radius") > 0, F.col("_radius")).otherwise(F.lit(1.0)))
    return df.drop("_r", "_radius", *[f"_c_{a}" for a in axes])


def band_of(value: Column, caps: Sequence[float]) -> Column:
    """The first band whose cap is not below the value; null above the last."""
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(caps))):
        out = F.when(value <= F.lit(float(c)), F.lit(i)).otherwise(out)
    return out


def uniform_cells(df: DataFrame, axes: Sequence[str], size: float, level: int = 0) -> DataFrame:
    for a, n in zip(axes, ("ci", "cj", "ck")):
        df = df.withColumn(n, cell(F.col(a), size / 2**level))
    return df.withColumn("level", F.lit(level))


def adaptive_cells(df: DataFrame, axes: Sequence[str], size: float, budget: int, levels: int) -> DataFrame:
    """Rows with (level, ci, cj, ck) and ``overflow``: each row's cell at the least level whose
    cell holds at most ``budget`` rows, else at the last.

    Counts of the finest cells are rolled up level by level, so no pass orders or
    gathers the rows of a cell, and rows meet a table of cells once.
    """
    finest = ("_i", "_j", "_k")[: len(axes)]
    scale = size / 2**levels
    for a, n in zip(axes, finest):
        df = df.withColumn(n, cell(F.col(a), scale))
    cells = df.groupBy(*finest).agg(F.count("*").alias("_n"))
    up = lambda n, level: F.floor(F.col(n) / F.lit(float(2 ** (levels - level)))).cast("long")
    plan = cells
    for level in range(levels):
        keys = [f"_{level}{n}" for n in finest]
        plan = plan.withColumns({k: up(n, level) for k, n in zip(keys, finest)})
        sums = plan.groupBy(*keys).agg(F.sum("_n").alias(f"_n{level}"))
        plan = plan.join(sums, keys).drop(*keys)
    fits = F.lit(levels)
    for level in reversed(range(levels)):
        fits = F.when(F.col(f"_n{level}") <= budget, F.lit(level)).otherwise(fits)
    plan = plan.withColumn("level", fits).withColumn("overflow", (F.col("level") == levels) & (F.col("_n") > budget))
    plan = plan.select(*finest, "level", "overflow")
    out = df.join(plan, list(finest))
    for n, name in zip(finest, ("ci", "cj", "ck")):
        out = out.withColumn(name, F.floor(F.col(n) / F.pow(F.lit(2.0), F.lit(levels) - F.col("level"))).cast("long"))
    return out.drop(*finest)


def cell_distance2(axes: Sequence[str], cells: Sequence[str], size: float) -> Column:
    """Squared distance of a point to a cell's box; 0 inside."""
    out = F.lit(0.0)
    for a, c in zip(axes, cells):
        low = F.col(c) * F.lit(size)
        gap = F.col(a) - clip(F.col(a), low, low + F.lit(size))
        out = out + gap * gap
    return out


def cells_in_reach(points: DataFrame, cells: DataFrame, axes: Sequence[str], names: Sequence[str], size: float, reach: float) -> DataFrame:
    """Points with each cell whose box is within ``reach``: an equi-join on the cells around a point, then the exact test."""
    steps = int(-(-reach // size))
    near = neighbours(points, axes, size, steps, names)
    return near.join(cells, list(names)).filter(cell_distance2(axes, names, size) <= F.lit(reach * reach))


def exact_slice(points: DataFrame, key: str, splats: DataFrame, axes: Sequence[str], size: float, reach: float, sigma: float, weight: str = "alpha") -> DataFrame:
    """(key, value): the mixture at each point over the splats of the cells in reach; 0 where none is.

    ``splats`` has <axis>_s. Points without a cell in reach keep a row."""
    names = ["_ci", "_cj", "_ck"][: len(axes)]
    held = splats
    for a, n in zip(axes, names):
        held = held.withColumn(n, cell(F.col(f"{a}_s"), size))
    near = cells_in_reach(points, held, axes, names, size, reach)
    d2 = sum(((F.col(a) - F.col(f"{a}_s")) * (F.col(a) - F.col(f"{a}_s")) for a in axes), F.lit(0.0))
    sums = near.groupBy(key).agg(F.sum(F.col(weight) * F.exp(F.lit(-0.5 / (sigma * sigma)) * d2)).alias("value"))
    return points.select(key).join(sums, key, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def mass_mode(df: DataFrame, value: str, weight: str, low: float, high: float, bins: int = 48, by: Sequence[str] = ()) -> DataFrame:
    """(by, mode): the middle of the heaviest bin; the lowest of equals."""
    b = df.withColumn("_b", bucket(F.col(value), low, high, bins)).filter("_b IS NOT NULL")
    n = b.groupBy(*by, "_b").agg(F.sum(weight).alias("_w"))
    best = n.groupBy(*by).agg(F.max_by("_b", F.struct("_w", -F.col("_b"))).alias("_b"))
    return best.select(*by, (F.lit(low) + (F.col("_b") + 0.5) * F.lit((high - low) / bins)).alias("mode"))


def grid(spark, n: int, extent: float = 1.0) -> DataFrame:
    """(u, v): sample points of a square plane, row by row."""
    t = spark.range(n).select((F.lit(-extent) + F.col("id") * F.lit(2 * extent / (n - 1))).alias("u"))
    return t.crossJoin(t.withColumnRenamed("u", "v"))  # a stated n x n grid


def footprint_blur(var: Sequence[Column], amp: Column, sigma: float) -> tuple[list[Column], Column]:
    """Axis variances grown by sigma^2 and the amplitude that keeps the mass."""
    new = [v + F.lit(sigma * sigma) for v in var]
    ratio = F.lit(1.0)
    for a, b in zip(var, new):
        ratio = ratio * (a / b)
    return new, amp * F.sqrt(ratio)


def tile_starts(low: float, high: float, tile: float, overlap: float) -> list[float]:
    """Starts of overlapping tiles, the last flush with the end."""
    if high - low <= tile:
        return [low]
    step, out, x = tile * (1 - overlap), [], low
    while x + tile < high - 1e-9:
        out.append(x)
        x += step
    return [*out, high - tile] if not out or out[-1] < high - tile - 1e-9 else out


def tile_rows(points: DataFrame, axes: Sequence[str], starts: Sequence[Sequence[float]], tile: float, weight: str, least: float) -> DataFrame:
    """(t0, t1, ..., mass, share): tiles, closed at both ends, that hold at least a share of the weight."""
    total = points.agg(F.sum(weight).alias("_total"))
    df = points
    for i, (a, s) in enumerate(zip(axes, starts)):
        held = [F.when((F.col(a) >= F.lit(float(x))) & (F.col(a) <= F.lit(float(x + tile))), F.lit(float(x))) for x in s]
        df = df.withColumn(f"t{i}", F.explode(F.array_compact(F.array(*held))))
    t = [f"t{i}" for i in range(len(axes))]
    return df.groupBy(*t).agg(F.sum(weight).alias("mass")).crossJoin(F.broadcast(total)).withColumn("share", F.col("mass") / F.col("_total")).filter(F.col("share") >= least).drop("_total")
