"""Continuous fields: Gaussian splats as bundles of position codes, and their exact twins.

A position code is e^{i w.p} for the rows w of a frequency table (j, w0, w1, ...); a
field is the amplitude-weighted sum of codes, read at a point by an inner product. The
frequency table has dim rows; Spark broadcasts it below its threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasorlake.plans import BROADCAST, cell, first_by
from phasorlake.space import Space, bind, bundle, cleanup, codebook, pair, unbind


def phase(axes: Sequence[str]) -> Column:
    return sum((F.col(f"w{k}") * F.col(a) for k, a in enumerate(axes)), F.lit(0.0))


def encode(points: DataFrame, table: DataFrame, axes: Sequence[str], weights: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, j, <weight>_re, <weight>_im): one pass for all channels, the phase computed once."""
    df = points.crossJoin(table).withColumn("_t", phase(axes)).withColumns({"_c": F.cos("_t"), "_s": F.sin("_t")})
    sums = [s for w in weights for s in (F.sum(F.col(w) * F.col("_c")).alias(f"{w}_re"), F.sum(F.col(w) * F.col("_s")).alias(f"{w}_im"))]
    return df.groupBy(*by, "j").agg(*sums)


def decode(points: DataFrame, key: str, field: DataFrame, table: DataFrame, axes: Sequence[str], weights: Sequence[str], dim: int, join: Sequence[str] = (), kernel: str = "native") -> DataFrame:
    """(key, <weight>): Re<e^{iwp}, S> / dim at each point; ``join`` names keys that both sides share.

    ``kernel`` is native (a join on j with partial sums) or arrow (matrix products of
    batches of points with the field, which goes to all tasks after a check of its size)."""
    if kernel == "arrow":
        return _decode_arrow(points, key, field, table, axes, weights, dim)
    df = points.crossJoin(table).withColumn("_t", phase(axes)).join(field, ["j", *join])
    return df.groupBy(key).agg(*[(F.sum(F.col(f"{w}_re") * F.cos("_t") + F.col(f"{w}_im") * F.sin("_t")) / F.lit(float(dim))).alias(w) for w in weights])


def _decode_arrow(points: DataFrame, key: str, field: DataFrame, table: DataFrame, axes: Sequence[str], weights: Sequence[str], dim: int) -> DataFrame:
    held = field.join(table, "j")
    if held.count() * (len(axes) + 2 * len(weights)) * 8 > BROADCAST:
        raise ValueError("the field is too large to go to every task: use the native kernel")
    rows = sorted(held.collect(), key=lambda r: r["j"])
    w = np.array([[r[f"w{k}"] for k in range(len(axes))] for r in rows]).reshape(-1, len(axes))
    s = np.array([[complex(r[f"{c}_re"], r[f"{c}_im"]) for c in weights] for r in rows]).reshape(-1, len(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 2048) for a in range(0, batch.num_rows, 2048)):
                p = np.column_stack([part.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(axes))])
                t = p @ w.T
                out = (np.cos(t) @ s.real + np.sin(t) @ s.imag) / dim
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[:, i]) for i in range(len(weights)))], [key, *weights])

    kinds = ", ".join(f"{c} double" for c in weights)
    rows = points.select(key, *[F.col(a).cast("double") for a in axes])
    return rows.mapInArrow(run, f"{key} {points.schema[key].dataType.simpleString()}, {kinds}")


def exact(points: DataFrame, key: str, splats: DataFrame, axes: Sequence[str], weights: Sequence[str], sigma: float) -> DataFrame:
    """(key, <weight>): the mixture itself, all splats for each of a stated set of points. ``splats`` has <axis>_s."""
    d2 = sum(((F.col(a) - F.col(f"{a}_s")) * (F.col(a) - F.col(f"{a}_s")) for a in axes), F.lit(0.0))
    k = F.exp(F.lit(-0.5 / (sigma * sigma)) * d2)
    return points.select(key, *axes).crossJoin(splats).withColumn("_k", k).groupBy(key).agg(*[F.sum(F.col(w) * F.col("_k")).alias(w) for w in weights])


def cell_fields(splats: DataFrame, table: DataFrame, axes: Sequence[str], size: float, weights: Sequence[str]) -> DataFrame:
    """Fields by grid cell: (ci, cj[, ck], j, ...)."""
    names = ["ci", "cj", "ck"][: len(axes)]
    for a, n in zip(axes, names):
        splats = splats.withColumn(n, cell(F.col(a), size))
    return encode(splats, table, axes, weights, names)


def labelled(space: Space, splats: DataFrame, table: DataFrame, axes: Sequence[str], label: str, weight: str) -> DataFrame:
    """sum of weight e^{iw.mu} bound to the label's codeword."""
    t = phase(axes) + space.theta(F.col(label).cast("string"), F.col("j"))
    df = splats.crossJoin(table)
    return bundle(df, [], F.cos(t), F.sin(t), F.col(weight))


def what_is_at(space: Space, field: DataFrame, points: DataFrame, key: str, table: DataFrame, axes: Sequence[str], labels: DataFrame, label: str) -> DataFrame:
    """(key, label, score): the position unbound, the label cleaned up."""
    df = points.crossJoin(table).join(field, "j")
    re, im = unbind(pair(), (F.cos(phase(axes)), F.sin(phase(axes))))
    return cleanup(df.select(key, "j", re.alias("re"), im.alias("im")), codebook(space, labels, label), [key], space.dim)


def what_is_at_exact(points: DataFrame, key: str, splats: DataFrame, axes: Sequence[str], label: str, weight: str, sigma: float) -> DataFrame:
    """(key, label, score): the kernel-weighted vote."""
    d2 = sum(((F.col(a) - F.col(f"{a}_s")) * (F.col(a) - F.col(f"{a}_s")) for a in axes), F.lit(0.0))
    s = points.select(key, *axes).crossJoin(splats.select(*[f"{a}_s" for a in axes], label, weight)).groupBy(key, label).agg(F.sum(F.col(weight) * F.exp(F.lit(-0.5 / (sigma * sigma)) * d2)).alias("score"))
    return first_by(s, [key], [F.round("score", 9).desc(), F.col(label).asc()])


def where_is(space: Space, field: DataFrame, label: str, points: DataFrame, key: str, table: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(key, score): the label unbound, the field of its class read at the points."""
    t = space.theta(F.lit(label), F.col("j"))
    re, im = unbind(pair(), (F.cos(t), F.sin(t)))
    f = field.select("j", re.alias("score_re"), im.alias("score_im"))
    return decode(points, key, f, table, axes, ["score"], space.dim)


def translate(field: DataFrame, table: DataFrame, by: Sequence[float]) -> DataFrame:
    """The field moved: each component turned by e^{iw.t}."""
    t = sum((F.col(f"w{k}") * F.lit(float(x)) for k, x in enumerate(by)), F.lit(0.0))
    df = field.join(table.withColumn("_t", t).select("j", "_t"), "j")
    re, im = bind(pair(), (F.cos("_t"), F.sin("_t")))
    return df.withColumn("_re", re).withColumn("im", im).withColumn("re", F.col("_re")).drop("_re", "_t")


def spectral(splats: DataFrame, table: DataFrame, axes: Sequence[str], cov: Sequence[Sequence[str]], weights: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each splat's own spectrum: amp (2 pi)^{D/2} sqrt(det cov) e^{-w'cov w/2} e^{-iw.mu}. ``cov`` names its entries, upper triangle by rows."""
    n = len(axes)
    c = {(i, j): F.col(cov[i][j - i]) for i in range(n) for j in range(i, n)}
    at = lambda i, j: c[min(i, j), max(i, j)]
    quad = sum((F.lit(1.0 if i == j else 2.0) * at(i, j) * F.col(f"w{i}") * F.col(f"w{j}") for i in range(n) for j in range(i, n)), F.lit(0.0))
    if n == 1:
        det = at(0, 0)
    elif n == 2:
        det = at(0, 0) * at(1, 1) - at(0, 1) * at(0, 1)
    else:
        det = at(0, 0) * (at(1, 1) * at(2, 2) - at(1, 2) * at(1, 2)) - at(0, 1) * (at(0, 1) * at(2, 2) - at(1, 2) * at(0, 2)) + at(0, 2) * (at(0, 1) * at(1, 2) - at(1, 1) * at(0, 2))
    gain = F.lit((2 * math.pi) ** (n / 2)) * F.sqrt(det) * F.exp(F.lit(-0.5) * quad)
    df = splats.crossJoin(table).withColumns({"_t": phase(axes), "_g": gain})
    sums = [s for w in weights for s in (F.sum(F.col(w) * F.col("_g") * F.cos("_t")).alias(f"{w}_re"), F.sum(-F.col(w) * F.col("_g") * F.sin("_t")).alias(f"{w}_im"))]
    return df.groupBy(*by, "j").agg(*sums)


def decode_weights(table: DataFrame, ndim: int, sigmas: Sequence[float]) -> DataFrame:
    """(j, weight): importance weights of frequencies drawn from a mixture of Gaussians of deviations 1 / sigma."""
    w2 = sum((F.col(f"w{k}") * F.col(f"w{k}") for k in range(ndim)), F.lit(0.0))
    density = sum((F.lit(s**ndim / (2 * math.pi) ** (ndim / 2) / len(sigmas)) * F.exp(F.lit(-0.5 * s * s) * w2) for s in sigmas), F.lit(0.0))
    return table.select("j", (F.lit(1.0) / (F.lit((2 * math.pi) ** ndim) * density)).alias("weight"))


def exact_anisotropic(points: DataFrame, key: str, splats: DataFrame, axes: Sequence[str], cov: Sequence[Sequence[str]], weight: str) -> DataFrame:
    """(key, value) of a two-axis mixture with each splat's own covariance, by the closed inverse."""
    a, b, d = F.col(cov[0][0]), F.col(cov[0][1]), F.col(cov[1][0])
    x, y = (F.col(p) - F.col(f"{p}_s") for p in axes)
    det = a * d - b * b
    q = (d * x * x - F.lit(2.0) * b * x * y + a * y * y) / det
    return points.select(key, *axes).crossJoin(splats).groupBy(key).agg(F.sum(F.col(weight) * F.exp(F.lit(-0.5) * q)).alias("value"))


def kernel_as_of(frames: DataFrame, time: str, value: str, asked: DataFrame, when: str, sigma: float) -> DataFrame:
    """(when, value): kernel-weighted average over stored times; null where all weights vanish."""
    w = F.exp(F.lit(-0.5 / (sigma * sigma)) * (F.col(when) - F.col(time)) * (F.col(when) - F.col(time)))
    df = frames.crossJoin(F.broadcast(asked.select(when)))  # a stated set of times against all frames
    return df.groupBy(when).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"))


def xray(points: DataFrame, key: str, splats: DataFrame, axes: Sequence[str], sigma: float, weight: str) -> DataFrame:
    """(key, value): the line integral along the third axis of isotropic splats, at points of the image plane."""
    d2 = sum(((F.col(a) - F.col(f"{a}_s")) * (F.col(a) - F.col(f"{a}_s")) for a in axes), F.lit(0.0))
    line = F.lit(sigma * math.sqrt(2 * math.pi))
    return points.select(key, *axes).crossJoin(splats).groupBy(key).agg(F.sum(F.col(weight) * line * F.exp(F.lit(-0.5 / (sigma * sigma)) * d2)).alias("value"))


def view_bundle(field: DataFrame, table: DataFrame, view: Sequence[float], half: float) -> DataFrame:
    """The field integrated along a view direction over [-half, half]: each component times sin(a half) / a, or half as a goes to 0, twice."""
    a = sum((F.col(f"w{k}") * F.lit(float(v)) for k, v in enumerate(view)), F.lit(0.0))
    slim = table.withColumn("_a", a).select("j", "_a")
    gain = F.when(F.abs("_a") < 1e-9, F.lit(2.0 * half)).otherwise(F.lit(2.0) * F.sin(F.col("_a") * F.lit(half)) / F.col("_a"))
    return field.join(slim, "j").withColumns({"re": F.col("re") * gain, "im": F.col("im") * gain}).drop("_a")


def is_there(space: Space, field: DataFrame, probes: DataFrame, key: str, table: DataFrame, axes: Sequence[str], label: str) -> DataFrame:
    """(key, score): how much of the label is at the point, one inner product for each probe."""
    df = probes.crossJoin(table).join(field, "j")
    t = phase(axes) + space.theta(F.col(label).cast("string"), F.col("j"))
    return df.groupBy(key).agg((F.sum(F.col("re") * F.cos(t) + F.col("im") * F.sin(t)) / F.lit(float(space.dim))).alias("score"))


def record_field(space: Space, splats: DataFrame, table: DataFrame, axes: Sequence[str], payload: DataFrame, key: str, role: str, filler: str) -> DataFrame:
    """sum of e^{iw.mu} bound to each splat's record; ``payload`` is (key, role, filler)."""
    df = splats.join(payload, key).crossJoin(table)
    j = F.col("j")
    t = phase(axes) + space.theta(F.col(role).cast("string"), j) + space.theta(F.col(filler).cast("string"), j)
    return bundle(df, [], F.cos(t), F.sin(t))


def record_at(space: Space, field: DataFrame, points: DataFrame, key: str, table: DataFrame, axes: Sequence[str], roles: DataFrame, role: str, fillers: DataFrame, filler: str) -> DataFrame:
    """(key, role, label, score): the position unbound, then the role; the filler cleaned up."""
    asked = codebook(space, roles, role).withColumnsRenamed({"label": role})
    df = points.crossJoin(table).join(field, "j").join(asked, "j")
    re, im = unbind(pair(), (F.cos(phase(axes)), F.sin(phase(axes))))
    df = df.withColumns({"_re": re, "_im": im})
    re, im = unbind(pair("_re", "_im"), pair("bre", "bim"))
    return cleanup(df.select(key, role, "j", re.alias("re"), im.alias("im")), codebook(space, fillers, filler), [key, role], space.dim)


def band_tables(space: Space, spark, ndim: int, sigmas: Sequence[float], name: str = "W") -> DataFrame:
    """(band, j, w0, ...): a frequency table for each band's deviation."""
    parts = [space.frequencies(spark, ndim, s, f"{name}{b}").withColumn("band", F.lit(b)) for b, s in enumerate(sigmas)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def encode_by_band(splats: DataFrame, tables: DataFrame, axes: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """(band, j, <weight>_re, <weight>_im): each splat in its band's frequencies."""
    df = splats.join(tables, "band").withColumn("_t", phase(axes)).withColumns({"_c": F.cos("_t"), "_s": F.sin("_t")})
    return df.groupBy("band", "j").agg(*[s for w in weights for s in (F.sum(F.col(w) * F.col("_c")).alias(f"{w}_re"), F.sum(F.col(w) * F.col("_s")).alias(f"{w}_im"))])


def decode_bands(points: DataFrame, key: str, field: DataFrame, tables: DataFrame, axes: Sequence[str], weights: Sequence[str], dim: int) -> DataFrame:
    """(key, <weight>): the sum of the bands' fields at each point."""
    df = points.crossJoin(tables.join(field, ["band", "j"])).withColumn("_t", phase(axes))
    return df.groupBy(key).agg(*[(F.sum(F.col(f"{w}_re") * F.cos("_t") + F.col(f"{w}_im") * F.sin("_t")) / F.lit(float(dim))).alias(w) for w in weights])


def colour_channels(splats: DataFrame, alpha: str, colours: Sequence[str]) -> DataFrame:
    """Splats with amplitudes ``<colour>_a``, premultiplied by alpha."""
    return splats.withColumns({f"{c}_a": F.col(alpha) * F.col(c) for c in colours})


def mixture_frequencies(space: Space, spark, ndim: int, sigmas: Sequence[float], name: str = "mix") -> DataFrame:
    """(j, w0, ...): frequencies of a mixture of Gaussians of deviations 1 / sigma: component j mod n is of the j-th deviation."""
    rows = space.frequencies(spark, ndim, 1.0, name)
    scale = F.element_at(F.array(*[F.lit(1.0 / s) for s in sigmas]), F.pmod(F.col("j"), F.lit(len(sigmas))) + 1)
    return rows.select("j", *[(F.col(f"w{k}") * scale).alias(f"w{k}") for k in range(ndim)])


def weighted_read(points: DataFrame, key: str, field: DataFrame, table: DataFrame, weights: DataFrame, axes: Sequence[str], dim: int) -> DataFrame:
    """(key, value): Re sum of S c e^{iw.p} / dim, with the importance weights ``weight`` by j."""
    df = points.crossJoin(table.join(weights, "j").join(field, "j")).withColumn("_t", phase(axes))
    return df.groupBy(key).agg((F.sum(F.col("weight") * (F.col("re") * F.cos("_t") - F.col("im") * F.sin("_t"))) / F.lit(float(dim))).alias("value"))
