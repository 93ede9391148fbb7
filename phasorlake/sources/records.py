"""JSON sources: claim registries, run logs, annotated boxes, instance points, lint counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM = "id string, statement string, value string, kind string, status string, supersedes string, superseded_by string, as_of string, cites array<string>, pattern string"
EVENT = "run string, event string, label string, at timestamp, status string, wall_s double"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; comments (#) and empty lines are skipped, torn lines too, unknown keys dropped."""
    text = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    bad = "_torn"
    row = F.from_json("value", f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad})
    return text.select(row.alias("r")).filter(f"r.{bad} IS NULL").select("r.*").drop(bad)


def registry(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, CLAIM)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, EVENT)


def boxes(docs: DataFrame, column: str = "json", field: str = "obbAligned") -> DataFrame:
    """(label, x, y, z, ex, ey, ez): annotated boxes as half extents along the world's axes."""
    box = "struct<centroid:array<double>,axesLengths:array<double>,normalizedAxes:array<double>>"
    kind = f"struct<data:array<struct<label:string,segments:struct<obb:{box},obbAligned:{box}>>>>"
    d = docs.select(F.explode(F.from_json(column, kind)["data"]).alias("d")).select("d.label", F.col(f"d.segments.{field}").alias("b"))
    half = [sum((F.abs(F.col("b.normalizedAxes")[3 * k + i]) * F.col("b.axesLengths")[k] / 2 for k in range(3)), F.lit(0.0)) for i in range(3)]
    return d.select("label", *[F.col("b.centroid")[i].alias(c) for i, c in enumerate("xyz")], *[h.alias(f"e{c}") for h, c in zip(half, "xyz")])


def instances(points: DataFrame, segments: DataFrame, groups: DataFrame) -> DataFrame:
    """points (i, ...) with their instance: segment of the i-th point, group of the segment, -1 outside all.

    ``segments`` has an array ``segIndices``, ``groups`` an array ``segGroups`` of (id, label, segments)."""
    seg = segments.select(F.posexplode("segIndices").alias("i", "segment"))
    grp = groups.select(F.explode("segGroups").alias("g")).select(F.col("g.id").alias("instance"), F.col("g.label").alias("label"), F.explode("g.segments").alias("segment"))
    twice = grp.groupBy("segment").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("_n")).select(F.assert_true(F.col("_n") <= 1, F.lit("a segment is in two groups")).alias("_ok"))
    out = points.join(seg, "i").join(grp, "segment", "left").withColumn("instance", F.coalesce("instance", F.lit(-1)))
    return out.crossJoin(F.broadcast(twice)).filter("_ok IS NULL").drop("_ok")


def instance_objects(rows: DataFrame) -> DataFrame:
    """(instance, label, centroid and largest half extents) of labelled instances."""
    return rows.filter("instance >= 0").groupBy("instance", "label").agg(*[F.avg(c).alias(c) for c in "xyz"], *[((F.max(c) - F.min(c)) / 2).alias(f"e{c}") for c in "xyz"])


def with_vocabulary(objects: DataFrame, mapping: DataFrame) -> DataFrame:
    """Objects with mapped labels (null leaves one out) and a number for each label in order of name."""
    from pyspark.sql import Window

    out = objects.join(mapping, "label", "left").filter("target IS NOT NULL")
    names = out.select("target").distinct().withColumn("number", F.row_number().over(Window.orderBy("target")) - 1)
    return out.join(names, "target")


def lint_counts(docs: DataFrame, column: str = "json") -> DataFrame:
    """(file, rule, n) of lint findings."""
    d = docs.select(F.explode(F.from_json(column, "array<struct<filename:string,code:string>>")).alias("d"))
    return d.groupBy(F.col("d.filename").alias("file"), F.col("d.code").alias("rule")).agg(F.count("*").alias("n"))


SWEEP = "scene string, splats_encoded long, cells long, cells_per_band map<string,long>"


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """(scene, splats_encoded, cells, cells_per_band) of a JSON sweep: an error if a scene's cells aren't the sum over its bands, or a number is missing."""
    rows = spark.read.schema(SWEEP).option("multiLine", True).json(path)
    total = F.aggregate(F.map_values("cells_per_band"), F.lit(0).cast("long"), lambda a, x: a + x)
    sure = F.assert_true(F.coalesce((F.col("cells") == total) & F.col("splats_encoded").isNotNull(), F.lit(False)), F.concat(F.lit("cells don't add up: "), F.coalesce("scene", F.lit("?"))))
    return rows.withColumn("_ok", sure).filter("_ok IS NULL").drop("_ok")


def load_manifest(spark: SparkSession, entries: list[dict], readers: dict) -> DataFrame:
    """(x, y, z, ex, ey, ez, label) of the sources that a manifest lists, one table.

    An entry has kind, path and, to keep only objects whose centres are in a box, low and
    high. ``readers`` gives for each kind a function (spark, path) -> objects; a kind
    without one is an error before anything is read."""
    unknown = sorted({e["kind"] for e in entries} - set(readers))
    if unknown or not entries:
        raise ValueError(f"no reader for {', '.join(unknown)}" if unknown else "the manifest is empty")
    out = None
    for e in entries:
        rows = readers[e["kind"]](spark, e["path"]).select("x", "y", "z", "ex", "ey", "ez", "label")
        for a, lo, hi in zip("xyz", e.get("low", []), e.get("high", [])):
            rows = rows.filter(F.col(a).between(lo, hi))
        out = rows if out is None else out.unionByName(rows)
    return out
