"""Fields fitted to samples: ridge regression on cosines and sines of a frequency table.

Gram matrices are sums over rows, so tasks send (features + 1)^2 numbers and no rows;
the solve is on the driver, or, for fits by cell, in the task that has the cell's sums.
With fewer rows than features the same optimum comes from the rows' own Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _table(table: DataFrame, ndim: int) -> np.ndarray:
    """A frequency table as a matrix: dim rows, which are few by its definition."""
    rows = sorted(table.collect(), key=lambda r: r["j"])
    return np.array([[r[f"w{k}"] for k in range(ndim)] for r in rows], float)


def design(points: np.ndarray, w: np.ndarray) -> np.ndarray:
    """[cos Wp, sin Wp, 1] by rows."""
    t = points @ w.T
    return np.hstack([np.cos(t), np.sin(t), np.ones((len(t), 1))])


def fit(samples: DataFrame, axes: Sequence[str], values: Sequence[str], table: DataFrame, lam: float = 1e-3) -> tuple[np.ndarray, DataFrame]:
    """Weights (features x values), and the field (j, <value>_re, <value>_im, <value>_bias); the ridge is ``lam`` times the number of rows."""
    w = _table(table, len(axes))
    m, c = 2 * len(w) + 1, len(values)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((m, m + c))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(axes) + c)]).astype(float)
            for a in range(0, len(x), 4096):
                f = design(x[a : a + 4096, : len(axes)], w)
                g += f.T @ np.hstack([f, x[a : a + 4096, len(axes) :]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size)), pa.array(g.ravel())], ["i", "v"])

    rows = samples.select(*axes, *values).dropna()
    n = rows.count()
    if n >= m:
        sums = np.zeros(m * (m + c))
        for r in rows.mapInArrow(gram, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums[r.i] = r.v
        g = sums.reshape(m, m + c)
        theta = np.linalg.solve(g[:, :m] + lam * n * np.eye(m), g[:, m:])
    else:  # fewer rows than features
        x = np.array([[float(v) for v in r] for r in rows.collect()]).reshape(n, len(axes) + c)
        a = design(x[:, : len(axes)], w)
        theta = a.T @ np.linalg.solve(a @ a.T + lam * n * np.eye(n), x[:, len(axes) :]) if n else np.zeros((m, c))
    d = len(w)
    out = [(j, *[float(v) for k in range(c) for v in (d * theta[j, k], d * theta[d + j, k], theta[-1, k])]) for j in range(d)]
    names = ", ".join(f"{v}_re double, {v}_im double, {v}_bias double" for v in values)
    return theta, samples.sparkSession.createDataFrame(out, f"j int, {names}")


def evaluate(points: DataFrame, key: str, field: DataFrame, table: DataFrame, axes: Sequence[str], values: Sequence[str], dim: int) -> DataFrame:
    """(key, <value>): the field's read at each point, and the bias."""
    from phasorlake.operators.fields import decode

    bias = field.agg(*[F.first(f"{v}_bias").alias(f"_{v}") for v in values])
    got = decode(points.select(key, *axes), key, field, table, axes, values, dim).crossJoin(F.broadcast(bias))  # one row
    return got.select(key, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])


def gradient(samples: DataFrame, axes: Sequence[str], value: str, table: DataFrame, theta: np.ndarray, lam: float, dim: int) -> DataFrame:
    """(feature, gradient) of the penalised mean square at weights: 0 at the fit, whatever solver found it."""
    df = samples.select(*axes, value).dropna().crossJoin(F.broadcast(table)).withColumn("_t", sum((F.col(f"w{k}") * F.col(a) for k, a in enumerate(axes)), F.lit(0.0)))
    weights = samples.sparkSession.createDataFrame([(j, float(theta[j]), float(theta[dim + j])) for j in range(dim)], "j int, _p double, _q double")
    rows = samples.select(*axes, value).dropna().withColumn("_row", F.monotonically_increasing_id())
    fitted = rows.crossJoin(F.broadcast(table.join(weights, "j"))).withColumn("_t", sum((F.col(f"w{k}") * F.col(a) for k, a in enumerate(axes)), F.lit(0.0)))
    resid = fitted.groupBy("_row", *axes, value).agg((F.sum(F.col("_p") * F.cos("_t") + F.col("_q") * F.sin("_t")) + F.lit(float(theta[-1]))).alias("_f")).withColumn("_r", F.col("_f") - F.col(value))
    df = resid.crossJoin(F.broadcast(table)).withColumn("_t", sum((F.col(f"w{k}") * F.col(a) for k, a in enumerate(axes)), F.lit(0.0)))
    each = df.groupBy("j").agg(F.avg(F.col("_r") * F.cos("_t")).alias("c"), F.avg(F.col("_r") * F.sin("_t")).alias("s")).join(weights, "j")
    out = each.select(F.col("j").alias("feature"), (F.col("c") + F.lit(lam) * F.col("_p")).alias("gradient"))
    out = out.unionByName(each.select((F.col("j") + dim).alias("feature"), (F.col("s") + F.lit(lam) * F.col("_q")).alias("gradient")))
    return out.unionByName(resid.agg((F.avg("_r") + F.lit(lam * float(theta[-1]))).alias("gradient")).select(F.lit(2 * dim).alias("feature"), "gradient"))


def fit_by_cell(samples: DataFrame, cells: Sequence[str], features: Sequence[Column], target: Column, lam: float, prior: DataFrame | None = None) -> DataFrame:
    """(cells, n, weights): each cell's ridge fit towards its prior (cells, prior: array), or towards 0; the ridge is ``lam`` times the cell's rows.

    Sums by cell first; no cell's rows meet in a task."""
    m = len(features)
    sums = [F.sum(features[i] * features[j]) for i in range(m) for j in range(i, m)] + [F.sum(f * target) for f in features]
    g = samples.groupBy(*cells).agg(F.count("*").alias("n"), F.array(*sums).alias("_g"))
    g = g.join(prior, list(cells), "left") if prior is not None else g.withColumn("prior", F.lit(None).cast("array<double>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(m)
        for pdf in batches:
            out = []
            for n, s, p in zip(pdf["n"], pdf["_g"], pdf["prior"]):
                s = np.asarray(s, float)
                a = np.zeros((m, m))
                a[upper] = s[: len(upper[0])]
                a = a + np.triu(a, 1).T
                before = np.zeros(m) if p is None else np.asarray(p, float)
                out.append(np.linalg.solve(a + lam * n * np.eye(m), s[len(upper[0]) :] + lam * n * before).tolist())
            yield pd.DataFrame({**{c: pdf[c] for c in cells}, "n": pdf["n"], "weights": out})

    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in cells)
    return g.mapInPandas(run, f"{kinds}, n long, weights array<double>")
