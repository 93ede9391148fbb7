"""Error locality, shapes, change, retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasorlake.functions import bucket
from phasorlake.plans import cell, first_by, keep, radius_join, running

#: Rows of a side of one matrix product.
BLOCK = 1024


def error_shares(df: DataFrame, resid: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, fraction, share): of the squared error, what the worst max(1, floor(n f)) rows hold; 0 without error.

    The k-th largest square is found among distinct squares with counts, ordered by
    ranges, so no task holds all of them."""
    sq = running(df.withColumn("_e", -F.col(resid) * F.col(resid)).withColumn("_1", F.lit(1)), "_e", "_1", by)  # the worst first
    total = df.groupBy(*by).agg(F.sum(F.col(resid) * F.col(resid)).alias("_sum"))
    sq = sq.join(total, list(by)) if by else sq.crossJoin(F.broadcast(total))
    sq = sq.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    k = F.greatest(F.lit(1), F.floor(F.col("_all") * F.col("fraction")))
    taken = F.greatest(F.lit(0), F.least(F.col("_w"), k - F.col("_before")))
    return sq.groupBy(*by, "fraction").agg((F.sum(F.when(F.col("_sum") > 0, -F.col("_e") * taken / F.col("_sum")).otherwise(F.lit(0.0)))).alias("share"))


def enrichment(resid: DataFrame, key: str, error: str, members: DataFrame, cell: str) -> DataFrame:
    """(cell, enrichment): a cell's share of the error over its share of the rows, overlap counted in full; without error none."""
    t = resid.agg(F.sum(error).alias("_te"), F.count("*").alias("_tn"))
    m = members.select(key, cell).distinct().join(resid, key).groupBy(cell).agg(F.sum(error).alias("_e"), F.count("*").alias("_n"))
    return m.crossJoin(F.broadcast(t)).filter("_e > 0").select(cell, ((F.col("_e") / F.col("_te")) / (F.col("_n") / F.col("_tn"))).alias("enrichment"))


def locality(df: DataFrame, truth: str, recon: str, spike: float = 0.9, local: float = 0.5) -> DataFrame:
    """One row: relative error, peak ratio, shares of the worst 1 % and 10 %, and the reading of them."""
    e = df.withColumn("_r", F.col(truth) - F.col(recon))
    s = error_shares(e, "_r", [0.01, 0.1]).groupBy().pivot("fraction", [0.01, 0.1]).agg(F.first("share"))
    s = s.toDF("share_1", "share_10")
    a = e.agg((F.sqrt(F.sum(F.col("_r") * F.col("_r"))) / F.sqrt(F.sum(F.col(truth) * F.col(truth)))).alias("relative"), (F.max(F.abs(recon)) / F.max(F.abs(truth))).alias("peak"))
    reading = F.when(F.col("share_1") >= spike, "spike").when(F.col("share_10") >= local, "localised").otherwise("distributed")
    return a.crossJoin(s).withColumn("reading", reading)  # a row each


def psnr(df: DataFrame, truth: str, recon: str, peak: float) -> DataFrame:
    mse = F.avg((F.col(truth) - F.col(recon)) * (F.col(truth) - F.col(recon)))
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse")).withColumn("psnr", F.lit(10.0) * F.log10(F.lit(peak * peak) / F.col("mse")))


def nearest_within(left: DataFrame, key: str, right: DataFrame, right_key: str, columns: Sequence[str], radius: float) -> DataFrame:
    """(key, nearest, dist): the nearest right row within ``radius``, the least key of equals; -1 and null where none is."""
    names = [f"{c}_r" for c in columns]
    spots = right.groupBy(*columns).agg(F.min(right_key).alias("_k")).select("_k", *[F.col(c).alias(n) for c, n in zip(columns, names)])
    spots = keep(spots.dropna(subset=names), "spots")
    rest = keep(left.select(*columns).distinct().dropna(), "points")
    reach, found = radius, None
    # the largest radius at which a row meets few others in cells of that size; equal rows are one
    for _ in range(10):
        n = spots.groupBy(*[cell(F.col(c), reach) for c in names]).count()
        if (n.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0) <= 4:
            break
        reach /= 2
    # what has a neighbour within a radius has its nearest there; only the rest is looked for within twice of it
    while True:
        near = radius_join(rest, spots, columns, reach).groupBy(*columns).agg(F.min(F.struct("dist", "_k")).alias("_b"))
        near = keep(near, "near")
        found = near if found is None else found.unionByName(near)
        if reach >= radius:
            break
        rest = keep(rest.join(near, list(columns), "left_anti"), "points")
        reach = min(2 * reach, radius)
    best = left.join(found, list(columns), "left").select(key, "_b")
    return best.groupBy(key).agg(F.min("_b").alias("_b")).select(key, F.coalesce("_b._k", F.lit(-1)).alias("nearest"), F.col("_b.dist").alias("dist"))


def remove_subset(parent: DataFrame, key: str, part: DataFrame, part_key: str, columns: Sequence[str], tolerance: float, least: float = 0.99) -> DataFrame:
    """The parent without rows that match the part, which must match by at least a share."""
    hit = nearest_within(part, part_key, parent, key, columns, tolerance)
    share = hit.agg(F.avg((F.col("nearest") != -1).cast("double")).alias("_s"))
    gone = hit.filter("nearest <> -1").select(F.col("nearest").alias(key)).distinct()
    sure = share.select(F.assert_true(F.coalesce(F.col("_s"), F.lit(1.0)) >= least, F.lit("the part isn't of this parent")).alias("_ok"))
    return parent.join(gone, key, "left_anti").crossJoin(F.broadcast(sure)).filter("_ok IS NULL").drop("_ok")


def iou(df: DataFrame, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """Intersection over union of two boolean columns; 1 if both are empty."""
    both, any_ = F.count_if(a & b), F.count_if(a | b)
    return df.groupBy(*by).agg(F.when(any_ > 0, both / any_).otherwise(F.lit(1.0)).alias("iou"))


def flatten(df: DataFrame, voxel: Sequence[str], weight: str, mode: str = "log") -> DataFrame:
    """Rows with ``flat``: weights of each voxel brought to 1 (equal) or log1p(mass / median mass)."""
    mass = df.groupBy(*voxel).agg(F.sum(weight).alias("_m"))
    if mode == "none":
        return df.withColumn("flat", F.col(weight))
    if mode == "equal":
        return df.join(mass, list(voxel)).withColumn("flat", F.when(F.col("_m") > 0, F.col(weight) / F.col("_m")).otherwise(F.lit(0.0))).drop("_m")
    middle = mass.filter("_m > 0").agg(F.median("_m").alias("_mid"))
    out = df.join(mass, list(voxel)).crossJoin(F.broadcast(middle))
    return out.withColumn("flat", F.when(F.col("_m") > 0, F.col(weight) / F.col("_m") * F.log1p(F.col("_m") / F.col("_mid"))).otherwise(F.lit(0.0))).drop("_m", "_mid")


def weighted_histogram(df: DataFrame, value: Column, weight: Column, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, mass, share): the last bin is closed."""
    b = df.select(*by, bucket(value, low, high, bins).alias("bin"), weight.alias("_w")).filter("bin IS NOT NULL")
    out = b.groupBy(*by, "bin").agg(F.sum("_w").alias("mass"))
    total = out.groupBy(*by).agg(F.sum("mass").alias("_t")) if by else out.agg(F.sum("mass").alias("_t"))
    out = out.join(total, list(by)) if by else out.crossJoin(F.broadcast(total))
    return out.withColumn("share", F.col("mass") / F.col("_t")).drop("_t")


def knn_labels(rows: DataFrame, key: str, vector: str, label: str, queries: DataFrame) -> DataFrame:
    """(key, label, nearest, guess, cos): for a stated query set, the label of the row of the best cosine, itself left out; the least key of equals.

    Queries are packed in blocks of BLOCK; each batch of rows meets a block in one matrix
    product, of which the best row of each query goes on: rows x blocks products, and a
    row for each (batch, query).
    """
    pack = F.collect_list(F.struct(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")))
    blocks = queries.select(key, vector).groupBy(F.pmod(F.xxhash64(key), F.lit(max(1, -(-queries.count() // BLOCK)))).alias("_block")).agg(pack.alias("_q"))
    key_type, label_type = rows.schema[key].dataType.simpleString(), rows.schema[label].dataType.simpleString()

    def unit(v: pa.ListArray) -> np.ndarray:
        m = v.flatten().to_numpy().reshape(len(v), -1)
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return m / np.where(n == 0, 1.0, n)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, q in zip(batch.column(0), batch.column(1)):
                ids, names, x = r.values.flatten()
                own, v = q.values.flatten()
                order = np.argsort(ids.to_numpy())  # so that the first of equals has the least key
                cos = np.round(unit(v) @ unit(x)[order].T, 9)
                cos[own.to_numpy()[:, None] == ids.to_numpy()[order][None, :]] = -np.inf
                at = cos.argmax(1)
                found = np.flatnonzero(np.isfinite(cos[np.arange(len(at)), at]))
                at = pa.array(order[at][found])
                yield pa.RecordBatch.from_arrays([own.take(pa.array(found)), ids.take(at), names.take(at), pa.array(cos.max(1)[found])], [key, "nearest", "guess", "cos"])

    wide = max(1, -(-rows.count() // BLOCK))
    dealt = rows.select(key, label, F.transform(vector, lambda x: x.cast("double")).alias("_v")).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(wide)))
    packed = dealt.groupBy("_part").agg(F.collect_list(F.struct(key, label, "_v")).alias("_rows"))
    pairs = packed.select("_rows").crossJoin(blocks.select("_q"))  # about BLOCK rows in each
    near = pairs.mapInArrow(each, f"{key} {key_type}, nearest {key_type}, guess {label_type}, cos double")
    best = near.groupBy(key).agg(F.max_by(F.struct("nearest", "guess", "cos"), F.struct("cos", -F.col("nearest"))).alias("_b"))
    return queries.select(key, label).join(best, key).select(key, label, "_b.nearest", "_b.guess", "_b.cos")


def mass_shares(df: DataFrame, mass: Column, tops: Sequence[int]) -> DataFrame:
    """(top, share): of the whole mass, what the heaviest rows hold; each task keeps its own heaviest first."""
    rows = df.select(mass.alias("_m"))
    total = rows.agg(F.sum("_m").alias("_t"))
    top = rows.orderBy(F.col("_m").desc()).limit(max(tops)).withColumn("_r", F.row_number().over(Window.orderBy(F.col("_m").desc())))
    each = top.withColumn("top", F.explode(F.array(*[F.lit(t) for t in tops]))).filter("_r <= top").groupBy("top").agg(F.sum("_m").alias("_s"))
    return each.crossJoin(F.broadcast(total)).select("top", (F.col("_s") / F.col("_t")).alias("share"))


def percentile_rank(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.withColumn("rank", F.cume_dist().over(Window.partitionBy(*by).orderBy(value)))


def best_per_pair(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    return first_by(df, keys, [F.col(score).desc(), *[F.col(t).asc() for t in tie]])
