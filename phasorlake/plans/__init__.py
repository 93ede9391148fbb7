"""Plan shapes that Catalyst has no rule for: bucketed range joins and two-stage top-k."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a table up to which it is broadcast to Python kernels; beyond, joins do the work.
BROADCAST = 64 << 20


def cell(value: Column, size: float) -> Column:
    """Number of the half-open grid cell that a value is in."""
    return F.floor(value / F.lit(float(size))).cast("long")


def neighbours(df: DataFrame, columns: Sequence[str], size: float, reach: int = 1, names: Sequence[str] | None = None) -> DataFrame:
    """Rows once for each grid cell up to ``reach`` cells away: the build side of a range join as an equi-join."""
    names = names or [f"_c{i}" for i in range(len(columns))]
    for c, n in zip(columns, names):
        home = cell(F.col(c), size)
        df = df.withColumn(n, F.explode(F.sequence(home - F.lit(reach), home + F.lit(reach))))
    return df


def radius_join(left: DataFrame, right: DataFrame, columns: Sequence[str], radius: float, right_columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs within ``radius`` by Euclidean distance ``dist``: grid cells of that size, an
    equi-join on the cell, then the exact test. A pair meets in one cell only, as the
    left point is in one. Rows with a null coordinate have no partner."""
    right_columns = right_columns or [f"{c}_r" for c in columns]
    names = [f"_c{i}" for i in range(len(columns))]
    a = left
    for c, n in zip(columns, names):
        a = a.withColumn(n, cell(F.col(c), radius))
    b = neighbours(right, right_columns, radius, 1, names)
    out = a.join(b, names).drop(*names)
    square = sum(((F.col(c) - F.col(r)) * (F.col(c) - F.col(r)) for c, r in zip(columns, right_columns)), F.lit(0.0))
    return out.withColumn("dist", F.sqrt(square)).filter(F.col("dist") <= radius)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; Spark prunes each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).filter(F.col(rank or "_rank") <= k)
    return out if rank else out.drop("_rank")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that the session names in ``spark.checkpoint.dir``. Only where that is
    unset and all tasks run in this process, as in local tests, a folder of this machine
    is taken; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not getattr(spark, "_phasorlake_dir", None):
        spark._phasorlake_dir = tempfile.mkdtemp(prefix="phasorlake-")
    return spark._phasorlake_dir


#: Kept tables that are still there, with what deletes them.
_KEPT: dict[str, object] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is there at the end of the driver's process is removed."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    _KEPT[path] = lambda: where.getFileSystem(conf).delete(where, True)
    return path


#: Whether Spark removes the shuffle files of a query at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, label: str = "kept") -> DataFrame:
    """Write a table to the shared folder and reread it: lineage ends there, and
    a lost executor costs a reread of files instead of the work that made them.

    The shuffle files of the write go at its end; else they would stay on the executors'
    disks until the driver happens to collect its garbage."""
    path = new_path(df.sparkSession, label)
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN)
    conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEAN, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def drop(spark: SparkSession, *paths: str | DataFrame | None) -> None:
    """Remove kept tables that nothing reads any more."""
    for p in paths:
        p = getattr(p, "_kept_path", p) if not isinstance(p, str) else p
        if isinstance(p, str):
            _KEPT.pop(p, None)
            where = spark._jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def drop_all() -> None:
    """Remove all kept tables: once no result is read any more, and at the end of the driver's process."""
    for path, delete in list(_KEPT.items()):
        try:
            delete()
        except Exception:  # the JVM has gone first
            break
        _KEPT.pop(path, None)


def running(df: DataFrame, value: str, weight: str, by: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """Distinct values with running sums of weights, without one task that holds all of a group's.

    Adds, by (by, value) in order of value: ``_before`` (weights of lower values),
    ``_all`` (of the group), and the value and ``_before`` of the next lower value in
    ``_low`` and ``_lowbefore`` (null for the lowest), and ``_last`` (no higher one is).
    Values are cut into ``parts`` ranges by approximate quantiles; sums of ranges, a row
    each, are accumulated first, then each range orders its own values.
    """
    by = list(by)
    held = keep(df.groupBy(*by, value).agg(F.sum(weight).alias("_w")), "values")  # read three times
    cuts = held.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000)).alias("_cuts"))
    held = (held.join(cuts, by) if by else held.crossJoin(F.broadcast(cuts))).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    order = Window.partitionBy(*by).orderBy("_part")
    sums = held.groupBy(*by, "_part").agg(F.sum("_w").alias("_s"), F.max(value).alias("_top"), F.max_by("_w", value).alias("_topw"))
    sums = sums.withColumns({
        "_base": F.coalesce(F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_s").over(Window.partitionBy(*by)),
        "_ptop": F.lag("_top").over(order),
        "_ptopw": F.lag("_topw").over(order),
        "_end": F.lead("_part").over(order).isNull(),
    }).drop("_s", "_top", "_topw")
    w = Window.partitionBy(*by, "_part").orderBy(value)
    out = held.join(sums, [*by, "_part"])
    inner = F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    out = out.withColumn("_before", F.col("_base") + inner)
    low, lowbefore = F.lag(value).over(w), F.lag("_before").over(w)
    out = out.withColumns({
        "_low": F.coalesce(low, "_ptop"),
        "_lowbefore": F.coalesce(lowbefore, F.col("_base") - F.col("_ptopw")),
        "_last": F.col("_end") & F.lead(value).over(w).isNull(),
    })
    return out.drop("_part", "_base", "_ptop", "_ptopw", "_end")


def quantile(df: DataFrame, value: str, q: float, held: int = 50_000, bins: int = 65_536) -> float | None:
    """The exact quantile of a column, between its two neighbours as ``percentile`` gives it; nulls don't count.

    No task holds the values: they are counted in bins, and the bin of each neighbour again in finer
    ones, until it has ``held`` rows or one value. Each pass reads ``df``, so keep what is costly to make."""
    x = F.col(value).cast("double")
    df = df.select(x.alias("_x")).filter("_x IS NOT NULL")
    low, high, n = df.agg(F.min("_x"), F.max("_x"), F.count("*")).first()
    if not n:
        return None
    if not math.isfinite(low) or not math.isfinite(high) or not math.isfinite(high - low):
        return df.agg(F.percentile("_x", F.lit(q))).first()[0]
    where = (n - 1) * q
    ranks = (math.floor(where), math.ceil(where))
    at = dict.fromkeys(ranks, (low, high, 0, n))  # the least and greatest value that it can be, rows before these, rows in them
    while left := {s for s in at.values() if s[0] < s[1]}:
        for low, high, base, count in left:
            part = df.filter(F.col("_x").between(low, high))
            if count <= held:
                cuts = [(r["_x"], r["_x"], r["count"]) for r in part.groupBy("_x").count().collect()]
            else:
                b = F.least(F.floor((F.col("_x") - F.lit(low)) / F.lit(high - low) * F.lit(bins)), F.lit(bins - 1))
                cuts = [r[1:] for r in part.groupBy(b.alias("_b")).agg(F.min("_x"), F.max("_x"), F.count("*")).collect()]
            for rank in ranks:
                if at[rank] == (low, high, base, count):
                    before = base
                    for a, z, rows in sorted(cuts):
                        if rank < before + rows:
                            at[rank] = (a, z, before, rows)
                            break
                        before += rows
    a, z = (at[r][0] for r in ranks)
    return a if a == z else (ranks[1] - where) * a + (where - ranks[0]) * z
