"""Scenes from hashes: the same rows in any engine, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasorlake.functions import text, uniform


def random_scene(spark: SparkSession, n: int, axes: int = 2, low: float = 0.1, high: float = 0.5, seed: int = 0) -> DataFrame:
    """(id, x, y[, z], scale, alpha): places in [-1, 1], scales spread evenly on a log scale, amplitudes in [0.5, 1)."""
    u = lambda name: uniform(text(seed, "scene", name, F.col("id")))
    rows = spark.range(n)
    places = [(u(a) * 2 - 1).alias(a) for a in "xyz"[:axes]]
    return rows.select("id", *places, F.exp(F.lit(math.log(low)) + u("scale") * F.lit(math.log(high / low))).alias("scale"), (u("alpha") / 2 + 0.5).alias("alpha"))


def trefoil(spark: SparkSession, n: int) -> DataFrame:
    """(id, x, y, z): points along a trefoil knot, within the unit cube."""
    t = F.col("id") * F.lit(2 * math.pi / n)
    return spark.range(n).select("id", ((F.sin(t) + 2 * F.sin(2 * t)) / 3).alias("x"), ((F.cos(t) - 2 * F.cos(2 * t)) / 3).alias("y"), (-F.sin(3 * t) / 3).alias("z"))


def random_quaternions(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, qw, qx, qy, qz): rotations spread evenly, by three uniform numbers."""
    u = [uniform(text(seed, "turn", k, F.col("id"))) for k in range(3)]
    a, b = F.sqrt(1 - u[0]), F.sqrt(u[0])
    s, t = F.lit(2 * math.pi) * u[1], F.lit(2 * math.pi) * u[2]
    return spark.range(n).select("id", (b * F.cos(t)).alias("qw"), (a * F.sin(s)).alias("qx"), (a * F.cos(s)).alias("qy"), (b * F.sin(t)).alias("qz"))
