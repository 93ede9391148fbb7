"""Quantisation and shrinkage of complex vectors in the long layout."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasorlake.functions import check_bits, dequantize, quantize


def magnitude():
    return F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def percentile_threshold(df: DataFrame, keys: Sequence[str], percent: float) -> DataFrame:
    """(keys, threshold): a percentile of magnitudes, linear between neighbours."""
    return df.groupBy(*keys).agg(F.percentile(magnitude(), F.lit(percent / 100)).alias("threshold"))


def shrink(df: DataFrame, threshold: str, mode: str = "soft") -> DataFrame:
    """Magnitudes less the threshold (soft) or cut below it (hard); phases stay."""
    m, t = magnitude(), F.col(threshold)
    keep = F.greatest(m - t, F.lit(0.0)) / F.greatest(m, F.lit(1e-30)) if mode == "soft" else (m >= t).cast("double")
    return df.withColumn("_k", keep).withColumns({"re": F.col("re") * F.col("_k"), "im": F.col("im") * F.col("_k")}).drop("_k")


def block_scales(df: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """(keys, block, exponent): the power of two that covers each block of dimensions; null for a zero block."""
    top = F.max(F.greatest(F.abs("re"), F.abs("im")))
    out = df.groupBy(*keys, F.floor(F.col("j") / block).alias("block")).agg(top.alias("_t"))
    return out.withColumn("exponent", F.when(F.col("_t") > 0, F.ceil(F.round(F.log2("_t"), 9)).cast("int"))).drop("_t")


def quant_block(df: DataFrame, keys: Sequence[str], block: int, bits: int) -> DataFrame:
    """Signed integers of ``bits`` bits on each block's scale, and what they stand for. One bit has no codes but 0: it is refused."""
    if check_bits(bits) < 2:
        raise ValueError("signed codes need 2 bits or more")
    top = (1 << bits - 1) - 1
    out = df.withColumn("block", F.floor(F.col("j") / block)).join(block_scales(df, keys, block), [*keys, "block"])
    scale = F.pow(F.lit(2.0), F.col("exponent"))
    for c in ("re", "im"):
        code = F.coalesce(F.rint(F.col(c) / scale * top), F.lit(0.0))
        out = out.withColumn(f"{c}_code", code.cast("int")).withColumn(c, F.coalesce(code / top * scale, F.lit(0.0)))
    return out


def quant_polar(df: DataFrame, keys: Sequence[str], mbits: int, pbits: int, gamma: float) -> DataFrame:
    """Codes m of the companded magnitude (over the vector's largest) and p of the phase, and what they stand for."""
    check_bits(mbits), check_bits(pbits)
    top = df.groupBy(*keys).agg(F.max(magnitude()).alias("_top"))
    n = F.lit(float((1 << mbits) - 1))
    out = df.join(top, list(keys)).withColumn("_m", magnitude())
    out = out.withColumn("m", F.when(F.col("_top") > 0, F.rint(F.pow(F.col("_m") / F.col("_top"), F.lit(gamma)) * n)).otherwise(F.lit(0.0)).cast("int"))
    out = out.withColumn("p", quantize(F.atan2("im", "re"), pbits))
    back, phase = F.col("_top") * F.pow(F.col("m") / n, F.lit(1 / gamma)), dequantize(F.col("p"), pbits)
    return out.withColumns({"re": back * F.cos(phase), "im": back * F.sin(phase)}).drop("_m", "_top")


def quantile_codebook(df: DataFrame, key: str, value: str, codes: int) -> DataFrame:
    """(key, code, level): evenly spaced quantiles as levels, and each value's nearest, the lower of equals."""
    q = df.agg(F.percentile(value, F.array(*[F.lit((i + 0.5) / codes) for i in range(codes)])).alias("_q"))
    out = df.crossJoin(F.broadcast(q))  # one row
    best = F.expr(f"array_min(transform(_q, (x, i) -> named_struct('d', abs(x - {value}), 'i', i)))")
    return out.withColumn("_b", best).select(key, F.col("_b.i").alias("code"), F.expr("_q[_b.i]").alias("level"))


def phase_only(df: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Phases by codes of ``bits`` bits, all magnitudes one gain: that of least squares."""
    check_bits(bits)
    t = dequantize(quantize(F.atan2("im", "re"), bits), bits)
    out = df.withColumns({"_c": F.cos(t), "_s": F.sin(t)})
    gain = out.groupBy(*keys).agg(F.avg(F.col("re") * F.col("_c") + F.col("im") * F.col("_s")).alias("_g"))
    out = out.join(gain, list(keys)) if keys else out.crossJoin(F.broadcast(gain))
    return out.withColumns({"re": F.col("_g") * F.col("_c"), "im": F.col("_g") * F.col("_s")}).drop("_c", "_s", "_g")


def codec_curve(df: DataFrame, keys: Sequence[str], widths: Sequence[int], block: int = 32, gamma: float = 0.5) -> DataFrame:
    """(kind, bits, bytes, rmse) of every codec and width over the same vectors; bytes for each vector's dimension."""
    def row(coded: DataFrame, kind: str, bits: int, size: float) -> DataFrame:
        back = coded.select(*keys, "j", F.col("re").alias("_r"), F.col("im").alias("_i"))
        d = (F.col("re") - F.col("_r")) * (F.col("re") - F.col("_r")) + (F.col("im") - F.col("_i")) * (F.col("im") - F.col("_i"))
        energy = F.col("re") * F.col("re") + F.col("im") * F.col("im")
        return df.join(back, [*keys, "j"]).agg((F.sqrt(F.sum(d)) / F.sqrt(F.sum(energy))).alias("rmse")).select(F.lit(kind).alias("kind"), F.lit(bits).alias("bits"), F.lit(size).alias("bytes"), "rmse")

    out = None
    for b in widths:
        for kind, coded, size in (("phase", phase_only(df, keys, b), b / 8), ("polar", quant_polar(df, keys, b, b, gamma), b / 4), ("block", quant_block(df, keys, block, b) if b > 1 else None, b / 4 + 1 / block)):
            if coded is not None:
                part = row(coded, kind, b, size)
                out = part if out is None else out.unionByName(part)
    return out


def cheapest(curve: DataFrame, most: float) -> DataFrame:
    """The least bytes whose error is at most ``most``: one row, or none."""
    return curve.filter(F.col("rmse") <= most).orderBy("bytes", "rmse", "kind").limit(1)


def half_floats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as half-precision numbers hold them; beyond their range infinite."""
    @F.pandas_udf("double")
    def half(x: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(x.to_numpy(float).astype(np.float16).astype(float))

    return df.withColumns({c: half(c) for c in columns})


def palette(df: DataFrame, columns: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """Rows with ``code``: the nearest of k centres that k-means finds over the columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    packed = df.withColumn("_f", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="code").fit(packed)
    return model.transform(packed).drop("_f")


def raster(df: DataFrame, order: str, width: int) -> DataFrame:
    """Rows with ``line`` and ``col`` of an image that is filled in the order of a distinct key; ranks by ranges, so no task orders all."""
    from phasorlake.plans import running

    one = df.withColumn("_1", F.lit(1))
    rank = running(one, order, "_1").select(order, F.col("_before").alias("_rank"))
    return df.join(rank, order).withColumns({"line": F.floor(F.col("_rank") / width).cast("long"), "col": (F.col("_rank") % width).cast("long")}).drop("_rank")


def image_layout(df: DataFrame, key: str, axes: Sequence[str], codebook: Sequence[str], codes: int, width: int) -> DataFrame:
    """The rows of a compact scene file's images: places ``line`` and ``col`` in Z-order, 16-bit codes
    ``<axis>_code`` of log positions, and ``<column>_code`` of quantile codebooks. Pictures and archive are left to the writer.

    Z-order is of 10 bits an axis; rows of one cell follow each other by key, which is distinct."""
    from phasorlake.functions import morton

    logs = {f"_{a}": F.signum(a) * F.log1p(F.abs(a)) for a in axes}
    rows = df.withColumns(logs)
    ends = rows.agg(*[f(f"_{a}").alias(f"_{a}{n}") for a in axes for n, f in (("low", F.min), ("high", F.max))])
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    share = {a: F.when(F.col(f"_{a}high") > F.col(f"_{a}low"), (F.col(f"_{a}") - F.col(f"_{a}low")) / (F.col(f"_{a}high") - F.col(f"_{a}low"))).otherwise(F.lit(0.0)) for a in axes}
    out = rows.withColumns({f"{a}_code": F.rint(share[a] * 65535).cast("int") for a in axes})
    places = [F.shiftright(F.col(f"{a}_code"), 6) for a in axes]
    z = morton(*places, *[F.lit(0)] * (3 - len(places)))
    cells = out.withColumn("_z", z)
    count = cells.groupBy("_z").agg(F.count("*").alias("_n"))
    from phasorlake.plans import running

    start = running(count, "_z", "_n").select("_z", F.col("_before").alias("_start"))
    w = Window.partitionBy("_z").orderBy(key)
    out = cells.join(start, "_z").withColumn("_rank", F.col("_start") + F.row_number().over(w) - 1)
    out = out.withColumns({"line": F.floor(F.col("_rank") / width).cast("long"), "col": (F.col("_rank") % width).cast("long")})
    keep = [key, "line", "col", *[f"{a}_code" for a in axes]]
    for c in codebook:
        out = out.join(quantile_codebook(df, key, c, codes).select(key, F.col("code").alias(f"{c}_code")), key)
        keep.append(f"{c}_code")
    return out.select(*keep)
