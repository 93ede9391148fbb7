"""Views of scenes: cameras, pixel grids, projections of bundles and of the mixture itself."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasorlake.operators import fields
from phasorlake.operators.scenes import band_of
from phasorlake.plans import cell, radius_join
from phasorlake.space import Space

AXES = ("x", "y", "z")


def camera(view: Sequence[float], up: str = "y") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit view direction, and the image plane's axes: the second as near to ``up`` as can be."""
    v = np.asarray(view, float) / np.linalg.norm(view)
    first, other = (np.eye(3)[AXES.index(a)] for a in (up, "z" if up == "y" else "y"))
    u1 = np.cross(other if abs(v @ first) > 0.98 else first, v)
    u1 /= np.linalg.norm(u1)
    return v, u1, np.cross(v, u1)


def pixels(spark: SparkSession, view: Sequence[float], centre: Sequence[float], half: float, res: int, up: str = "y") -> DataFrame:
    """(pixel, u, v, x, y, z): sample points of the image plane through a centre, row by row."""
    _, u1, u2 = camera(view, up)
    at = lambda i: F.lit(-half) + i * F.lit(2.0 * half / (res - 1))
    rows = spark.range(res * res).select(F.col("id").cast("int").alias("pixel"))
    rows = rows.withColumns({"u": at(F.col("pixel") % res), "v": at(F.floor(F.col("pixel") / res))})
    return rows.withColumns({a: F.lit(float(centre[k])) + F.col("u") * F.lit(float(u1[k])) + F.col("v") * F.lit(float(u2[k])) for k, a in enumerate(AXES)})


def orthographic(space: Space, field: DataFrame, table: DataFrame, view: Sequence[float], centre: Sequence[float], half: float, res: int, depth: float, channels: Sequence[str] = ("value",), up: str = "y") -> DataFrame:
    """(pixel, <channel>): rays of length ``depth`` through the field, each one inner product with the view's bundle.

    ``field`` is (j, <channel>_re, <channel>_im)."""
    v, _, _ = camera(view, up)
    a = sum((F.col(f"w{k}") * F.lit(float(x)) for k, x in enumerate(v)), F.lit(0.0))
    gain = F.when(F.abs(a) < 1e-9, F.lit(float(depth))).otherwise(F.lit(2.0) * F.sin(a * F.lit(depth / 2)) / a)
    seen = field.join(table.select("j", gain.alias("_g")), "j")
    seen = seen.select("j", *[(F.col(f"{c}_{p}") * F.col("_g")).alias(f"{c}_{p}") for c in channels for p in ("re", "im")])
    return fields.decode(pixels(field.sparkSession, view, centre, half, res, up).select("pixel", *AXES), "pixel", seen, table, AXES, channels, space.dim)


def _ray(cov: Sequence[str], view: Sequence[float]) -> tuple[list[list[Column]], Column]:
    """M and q of a splat: the inverse covariance with its part along the view taken out, and v' C^-1 v.

    M is positive semi-definite, so the exponent is a sum of like terms and nothing cancels."""
    c = {(0, 0): cov[0], (0, 1): cov[1], (0, 2): cov[2], (1, 1): cov[3], (1, 2): cov[4], (2, 2): cov[5]}
    at = lambda i, j: F.col(c[min(i, j), max(i, j)])
    minor = lambda i, j: at((i + 1) % 3, (j + 1) % 3) * at((i + 2) % 3, (j + 2) % 3) - at((i + 1) % 3, (j + 2) % 3) * at((i + 2) % 3, (j + 1) % 3)
    det = at(0, 0) * minor(0, 0) + at(0, 1) * minor(0, 1) + at(0, 2) * minor(0, 2)
    inverse = [[minor(j, i) / det for j in range(3)] for i in range(3)]
    along = [sum((inverse[i][j] * F.lit(float(view[j])) for j in range(3)), F.lit(0.0)) for i in range(3)]
    q = sum((along[i] * F.lit(float(view[i])) for i in range(3)), F.lit(0.0))
    return [[inverse[i][j] - along[i] * along[j] / q for j in range(3)] for i in range(3)], q


def exact_xray(points: DataFrame, splats: DataFrame, cov: Sequence[str], weight: str, view: Sequence[float], size: float, reach: float, up: str = "y", centre: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(pixel, value): the line integral of splats with covariances of their own, over the cells whose footprint is near the pixel.

    ``points`` are ``pixels``; a cell's footprint is the disc of its half diagonal and ``reach``. Splats are (x, y, z, cov, weight)."""
    v, u1, u2 = camera(view, up)
    m, q = _ray(cov, v)
    names = ("_ci", "_cj", "_ck")
    held = splats.withColumns({n: cell(F.col(a), size) for n, a in zip(names, AXES)} | {"_q": q} | {f"_m{i}{j}": m[i][j] for i in range(3) for j in range(i, 3)})
    middle = [(F.col(n) + 0.5) * F.lit(size) - F.lit(float(c)) for n, c in zip(names, centre)]
    uv = lambda axis: sum((x * F.lit(float(k)) for x, k in zip(middle, axis)), F.lit(0.0))
    cells = held.select(*names).distinct().withColumns({"u_r": uv(u1), "v_r": uv(u2)})
    near = radius_join(points, cells, ["u", "v"], math.sqrt(3) / 2 * size + reach).drop("dist", "u_r", "v_r")
    both = near.join(held.withColumnsRenamed({a: f"{a}_s" for a in AXES}), list(names))
    d = [F.col(a) - F.col(f"{a}_s") for a in AXES]
    form = sum((F.lit(1.0 if i == j else 2.0) * F.col(f"_m{i}{j}") * d[i] * d[j] for i in range(3) for j in range(i, 3)), F.lit(0.0))
    sums = both.groupBy("pixel").agg(F.sum(F.col(weight) * F.sqrt(F.lit(2 * math.pi) / F.col("_q")) * F.exp(F.lit(-0.5) * form)).alias("value"))
    return points.select("pixel").join(sums, "pixel", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def masked_xray(space: Space, points: DataFrame, cells: DataFrame, table: DataFrame, weight: str, view: Sequence[float], depth: float, size: float, reach: float, up: str = "y", centre: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(pixel, value): a view of cell fields (``fields.cell_fields``): each pixel reads the cells whose footprint is near."""
    v, u1, u2 = camera(view, up)
    names = ("ci", "cj", "ck")
    middle = [(F.col(n) + 0.5) * F.lit(size) - F.lit(float(c)) for n, c in zip(names, centre)]
    uv = lambda axis: sum((x * F.lit(float(k)) for x, k in zip(middle, axis)), F.lit(0.0))
    near = radius_join(points, cells.select(*names).distinct().withColumns({"u_r": uv(u1), "v_r": uv(u2)}), ["u", "v"], math.sqrt(3) / 2 * size + reach)
    a = sum((F.col(f"w{k}") * F.lit(float(x)) for k, x in enumerate(v)), F.lit(0.0))
    gain = F.when(F.abs(a) < 1e-9, F.lit(float(depth))).otherwise(F.lit(2.0) * F.sin(a * F.lit(depth / 2)) / a)
    read = near.select("pixel", *AXES, *names).join(cells, list(names)).join(table.withColumn("_g", gain), "j").withColumn("_t", fields.phase(AXES))
    sums = read.groupBy("pixel").agg((F.sum(F.col("_g") * (F.col(f"{weight}_re") * F.cos("_t") + F.col(f"{weight}_im") * F.sin("_t"))) / F.lit(float(space.dim))).alias("value"))
    return points.select("pixel").join(sums, "pixel", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def matched(df: DataFrame, scale: str, caps: Sequence[float], pixel: float) -> tuple[DataFrame, list[float]]:
    """Scales and band caps grown by one pixel's variance alike, so every row keeps its band."""
    var = pixel * pixel / 12
    return df.withColumn(scale, F.sqrt(F.col(scale) * F.col(scale) + F.lit(var))), [math.sqrt(c * c + var) for c in caps]


def band_books(space: Space, spark: SparkSession, ndim: int, floor: float, caps: Sequence[float], steps: int = 3) -> DataFrame:
    """(band, j, w0, ...): each band's frequencies, a mixture of ``steps`` deviations from the global floor to its cap."""
    out = None
    for b, cap in enumerate(caps):
        sigmas = [floor * (cap / floor) ** (i / (steps - 1)) for i in range(steps)]
        part = fields.mixture_frequencies(space, spark, ndim, sigmas, f"book{b}").withColumn("band", F.lit(b))
        out = part if out is None else out.unionByName(part)
    return out


def encode_bands(splats: DataFrame, books: DataFrame, axes: Sequence[str], scale: str, caps: Sequence[float], sizes: Sequence[float], weights: Sequence[str]) -> DataFrame:
    """(band, ci, cj[, ck], j, ...): fields by band and by the band's grid cells. A scale above the last cap is an error."""
    names = ["ci", "cj", "ck"][: len(axes)]
    sure = F.assert_true(F.col(scale) <= F.lit(float(caps[-1])), F.lit("a splat is wider than the last band"))
    df = splats.withColumn("_ok", sure).filter("_ok IS NULL").drop("_ok").withColumn("band", band_of(F.col(scale), caps))
    size = F.element_at(F.array(*[F.lit(float(s)) for s in sizes]), F.col("band") + 1)
    df = df.withColumns({n: F.floor(F.col(a) / size).cast("long") for n, a in zip(names, axes)})
    df = df.join(books, "band").withColumn("_t", fields.phase(axes)).withColumns({"_c": F.cos("_t"), "_s": F.sin("_t")})
    return df.groupBy("band", *names, "j").agg(*[s for w in weights for s in (F.sum(F.col(w) * F.col("_c")).alias(f"{w}_re"), F.sum(F.col(w) * F.col("_s")).alias(f"{w}_im"))])
