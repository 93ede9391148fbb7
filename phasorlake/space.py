"""A space of phasor codewords, and the algebra on vectors in the long layout.

A vector is rows (key columns, j, re, im) for j in 0 .. dim-1. Codewords are pure
functions of (seed, dim, label, j): no state, no order, the same in any engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasorlake.functions import PI2, gauss, text, uniform
from phasorlake.plans import first_by


@dataclass(frozen=True)
class Space:
    dim: int = 256
    seed: int = 0

    def theta(self, label: Column, j: Column) -> Column:
        return (uniform(text(self.seed, self.dim, label, j)) - F.lit(0.5)) * F.lit(PI2)

    def expand(self, df: DataFrame) -> DataFrame:
        """Each row once for each dimension j."""
        return df.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(self.dim - 1))))

    def codewords(self, df: DataFrame, label: str = "label", re: str = "re", im: str = "im", namespace: str = "") -> DataFrame:
        """Rows with j and the codeword of their label; labels of a namespace differ from those of another."""
        name = F.concat(F.lit(namespace + ":" if namespace else ""), F.col(label).cast("string"))
        out = self.expand(df).withColumn("_t", self.theta(name, F.col("j")))
        return out.withColumn(re, F.cos("_t")).withColumn(im, F.sin("_t")).drop("_t")

    def frequencies(self, spark, ndim: int, sigma: float = 1.0, name: str = "W") -> DataFrame:
        """(j, w0, w1, ...): rows of a Gaussian frequency table of deviation 1 / sigma."""
        rows = self.expand(spark.range(1).select())
        return rows.select("j", *[(gauss(text(self.seed, self.dim, name, F.col("j"), k)) / F.lit(float(sigma))).alias(f"w{k}") for k in range(ndim)])

    def check(self, other: Space) -> None:
        if self != other:
            raise ValueError(f"vectors of {other} don't belong to {self}")


def bind(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def unbind(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """a times the conjugate of b."""
    return a[0] * b[0] + a[1] * b[1], a[1] * b[0] - a[0] * b[1]


def pair(re: str = "re", im: str = "im") -> tuple[Column, Column]:
    return F.col(re), F.col(im)


def bundle(df: DataFrame, keys: Sequence[str], re: Column | str = "re", im: Column | str = "im", weight: Column | None = None) -> DataFrame:
    """Sum of vectors by key: partial sums before the shuffle, which gets keys x dim rows a task."""
    w = F.lit(1.0) if weight is None else weight
    re, im = (F.col(c) if isinstance(c, str) else c for c in (re, im))
    return df.groupBy(*keys, "j").agg(F.sum(re * w).alias("re"), F.sum(im * w).alias("im"))


def normalize(df: DataFrame) -> DataFrame:
    """To the unit circle; 0 stays 0."""
    m = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    d = F.when(m == 0, F.lit(1.0)).otherwise(m)
    return df.withColumn("_d", d).withColumn("re", F.col("re") / F.col("_d")).withColumn("im", F.col("im") / F.col("_d")).drop("_d")


def shift(df: DataFrame, power: int, dim: int) -> DataFrame:
    """rho^power, a cyclic shift: out[j] = in[(j + power) mod dim]."""
    return df.withColumn("j", F.pmod(F.col("j") - F.lit(power), F.lit(dim)))


def dot(a: DataFrame, b: DataFrame, keys: Sequence[str], re: str = "re", im: str = "im", bre: str = "bre", bim: str = "bim") -> DataFrame:
    """Real inner products of rows joined on j, by keys: (keys, dot)."""
    return a.join(b, "j").groupBy(*keys).agg(F.sum(F.col(re) * F.col(bre) + F.col(im) * F.col(bim)).alias("dot"))


def similarity(a: DataFrame, b: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
    """(keys, score): Re<a, b> / dim; b has bre and bim."""
    return dot(a, b, keys).withColumn("score", F.col("dot") / F.lit(float(dim))).drop("dot")


def cosine(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cos): 0 if either norm is 0."""
    out = a.join(b, "j").groupBy(*keys).agg(
        F.sum(F.col("re") * F.col("bre") + F.col("im") * F.col("bim")).alias("_d"),
        F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_a"),
        F.sum(F.col("bre") * F.col("bre") + F.col("bim") * F.col("bim")).alias("_b"),
    )
    norm = F.sqrt("_a") * F.sqrt("_b")
    return out.withColumn("cos", F.when(norm == 0, F.lit(0.0)).otherwise(F.col("_d") / norm)).drop("_d", "_a", "_b")


def codebook(space: Space, labels: DataFrame, label: str = "label", namespace: str = "") -> DataFrame:
    """(label, j, bre, bim) of distinct labels."""
    return space.codewords(labels.select(F.col(label).alias("label")).distinct(), "label", "bre", "bim", namespace)


def scores(queries: DataFrame, book: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
    """(keys, label, score): similarity of each query to every codeword. The book is a table
    of labels; Spark broadcasts it if its size allows, else joins on j with partial sums."""
    return similarity(queries, book, [*keys, "label"], dim)


def cleanup(queries: DataFrame, book: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
    """(keys, label, score): the nearest codeword; the least label of equals."""
    return first_by(scores(queries, book, keys, dim), keys, [F.col("score").desc(), F.col("label").asc()])


def matches(queries: DataFrame, book: DataFrame, keys: Sequence[str], dim: int, threshold: float = 0.5) -> DataFrame:
    return scores(queries, book, keys, dim).filter(F.col("score") >= threshold)
