"""Queries of sources and codecs: files and blobs are made from the tables, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasorlake.operators import kernels as K
from phasorlake.operators import textual as O
from phasorlake.queries.fields import _book, _named, _packed, _splats, _splats3
from phasorlake.queries.registry import js, load, query, r6, s6, theta
from phasorlake.sources import blobs, captures, records
from phasorlake.space import Space

D = 32
SPACE = Space(D)


def _vectors(spark, d):
    """Nations' codewords, each as long as its key says."""
    n = load(spark, d, "nation")
    v = SPACE.codewords(n.select(F.col("n_name").alias("label"), (F.col("n_nationkey") + 1).alias("m")))
    return v.select("label", "j", (F.col("re") * F.col("m")).alias("re"), (F.col("im") * F.col("m") * F.cos("j")).alias("im"))


_V = f"v AS (SELECT n_name AS label, j, cos({theta(D, 'n_name')})*(n_nationkey+1) AS re, sin({theta(D, 'n_name')})*(n_nationkey+1)*cos(j) AS im FROM nation, {js(D)})"


def _there_and_back(v, bits, kind, places=3):
    got = _packed(v, ["label"]).select("label", blobs.unpacker()(blobs.packer(bits, kind)("re", "im")).alias("b"))
    out = got.select("label", F.posexplode(F.arrays_zip("b.re", "b.im")).alias("j", "x")).select("label", "j", F.col("x.re").alias("re"), F.col("x.im").alias("im"))
    return out.select("label", "j", *[(F.round(c, places) + F.lit(0.0)).alias(c) for c in ("re", "im")])


_PH = "((round_even((atan2(im, re) + 3.141592653589793) * {n} / 6.283185307179586, 0)::BIGINT % {n}) * 6.283185307179586 / {n} - 3.141592653589793)"


@query(f"WITH {_V} SELECT label, j, round(cos({_PH.format(n=256)}), 3) + 0.0 AS re, round(sin({_PH.format(n=256)}), 3) + 0.0 AS im FROM v")
def blob_phase(spark, d):
    """Vectors through phase codes of 8 bits."""
    return _there_and_back(_vectors(spark, d), 8, "phase")


@query(f"WITH {_V}, t AS (SELECT *, max(greatest(abs(re::FLOAT), abs(im::FLOAT))) OVER (PARTITION BY label) AS top FROM v) SELECT label, j, round(round_even(re::FLOAT::DOUBLE/top*2047, 0)*top/2047, 3) + 0.0 AS re, round(round_even(im::FLOAT::DOUBLE/top*2047, 0)*top/2047, 3) + 0.0 AS im FROM t")
def blob_parts(spark, d):
    """Vectors through signed parts of 12 bits."""
    return _there_and_back(_vectors(spark, d), 12, "parts")


@query(f"WITH {_V}, t AS (SELECT *, sqrt(re*re+im*im) AS m, max(sqrt(re*re+im*im)) OVER (PARTITION BY label) AS top FROM v), q AS (SELECT *, (round_even(sqrt(m/top)*255, 0)/255)**2*top AS k FROM t) SELECT label, j, round(k*cos({_PH.format(n=256)}), 1) + 0.0 AS re, round(k*sin({_PH.format(n=256)}), 1) + 0.0 AS im FROM q")
def blob_polar(spark, d):
    """Vectors through companded magnitudes and phases of 8 bits."""
    return _there_and_back(_vectors(spark, d), 8, "polar", 1)


@query("SELECT n_name AS label, kind, bytes, head FROM nation, (VALUES ('phase', 24, '4850010420000000'), ('parts', 44, '484D010420000000'), ('polar', 48, '4847010420000000')) k(kind, bytes, head)")
def blob_headers(spark, d):
    """Sizes and headers of blobs of 4 bits."""
    v, out = _packed(_vectors(spark, d), ["label"]), None
    for kind in ("phase", "parts", "polar"):
        b = v.select("label", F.lit(kind).alias("kind"), blobs.packer(4, kind)("re", "im").alias("b")).select("label", "kind", F.length("b").alias("bytes"), F.hex(F.substring("b", 1, 8)).alias("head"))
        out = b if out is None else out.unionByName(b)
    return out


def _scene(spark, d):
    s = _splats3(spark, d)
    unit = {"sx": F.lit(0.1), "sy": F.lit(0.2), "sz": F.lit(0.4), "r": F.lit(0.25), "g": F.lit(0.5), "b": F.lit(0.75), "a": (F.col("label") + 1) / 20, "qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)}
    return s.withColumns(unit).select(F.concat(F.lit("scene"), F.col("label") % 3).alias("path"), F.col("vec_id").alias("id"), *captures.COLUMNS)


_SC = "s AS (SELECT 'scene' || (label % 3) AS path, vec_id AS id, row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) - 1 AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (label + 1) / 20.0::DOUBLE AS a FROM embeddings)"


@query(f"WITH {_SC} SELECT path || '.ply' AS path, i AS id, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in 'xyz')}, round(a, 3) + 0.0 AS a, 0.1 AS sx, 0.4 AS sz FROM s")
def capture_ply(spark, d):
    """Scenes written as files of the full binary layout, and read."""
    files = captures.encode_files(_scene(spark, d), "ply").withColumn("path", F.concat("path", F.lit(".ply")))
    out = captures.decode_files(files)
    return out.select("path", "id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in "xyz"], (F.round("a", 3) + F.lit(0.0)).alias("a"), F.round("sx", 4).alias("sx"), F.round("sz", 4).alias("sz"))


@query(f"WITH {_SC} SELECT path || '.spz' AS path, i AS id, {', '.join(f'round(round_even({c}*4096, 0)/4096, 6) + 0.0 AS {c}' for c in 'xyz')}, round(round_even(a*255, 0)/255, 3) + 0.0 AS a FROM s")
def capture_spz(spark, d):
    """Scenes written as packed files of 12 fraction bits, and read."""
    files = captures.encode_files(_scene(spark, d), "spz").withColumn("path", F.concat("path", F.lit(".spz")))
    out = captures.decode_files(files)
    return out.select("path", "id", *[r6(c).alias(c) for c in "xyz"], (F.round("a", 3) + F.lit(0.0)).alias("a"))


@query(f"WITH {_SC} SELECT path, count(*) AS n, {s6('min(x)')} AS min_x, {s6('max(y)')} AS max_y FROM s WHERE a >= 0.2 AND x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN -0.2 AND 0.2 GROUP BY path")
def capture_crop(spark, d):
    """The splats of a box, and their bounds."""
    part = captures.crop(_scene(spark, d), [-0.2, -0.2, -0.2], [0.4, 0.4, 0.4], 0.2)
    return part.groupBy("path").agg(F.count("*").alias("n")).join(captures.bounds(part, 0.2), "path").select("path", "n", r6("min_x").alias("min_x"), r6("max_y").alias("max_y"))


@query("SELECT vec_id, round(1.0 - 2*((label+1)/20.0)*((label+1)/20.0)*2/(1+2*((label+1)/20.0)*((label+1)/20.0)), 6) + 0.0 AS r00 FROM embeddings")
def rotations(spark, d):
    """First entries of the rotations of quaternions (1, 0, q, q)."""
    q = (F.col("label") + 1) / 20
    s = _splats(spark, d).withColumns({"qw": F.lit(1.0), "qx": F.lit(0.0), "qy": q, "qz": q})
    return captures.rotations(s).select("vec_id", r6("r00").alias("r00"))


@query("SELECT l_returnflag AS file, l_linestatus AS rule, count(*) AS n FROM lineitem GROUP BY ALL")
def lint_counts(spark, d):
    """Findings of JSON reports, one for each order, counted by file and rule."""
    li = load(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_returnflag").alias("filename"), F.col("l_linestatus").alias("code")).alias("f"))
    reports = li.groupBy("l_orderkey").agg(F.to_json(F.collect_list("f")).alias("json"))
    return records.lint_counts(reports)


_INST = "p AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, vec_id % 7 AS segment FROM embeddings), g AS (SELECT *, CASE WHEN segment < 5 THEN segment // 2 ELSE -1 END AS instance FROM p)"


def _instances(spark, d):
    p = load(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("i"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    n = p.count()
    segments = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i % 7).alias("segIndices"))
    groups = spark.createDataFrame([([(0, "chair", [0, 1]), (1, "table", [2, 3]), (2, "lamp", [4])],)], "segGroups array<struct<id:int,label:string,segments:array<int>>>")
    return records.instances(p, segments, groups)


@query(f"WITH {_INST} SELECT i, instance, CASE instance WHEN 0 THEN 'chair' WHEN 1 THEN 'table' WHEN 2 THEN 'lamp' END AS label FROM g")
def instance_points(spark, d):
    """Points with the instance that their segment belongs to."""
    return _instances(spark, d).select(F.col("i").cast("long").alias("i"), F.col("instance").cast("long").alias("instance"), "label")


@query(f"WITH {_INST} SELECT instance, {', '.join(f'{s6(f'avg({c})')} AS {c}, {s6(f'(max({c})-min({c}))/2')} AS e{c}' for c in 'xyz')}, CASE instance WHEN 0 THEN 0 WHEN 1 THEN 1 END AS number FROM g WHERE instance IN (0, 1) GROUP BY instance")
def instance_objects(spark, d):
    """Objects of instances whose label is mapped, numbered by name."""
    mapping = spark.createDataFrame([("chair", "a seat"), ("table", "a table"), ("lamp", None)], "label string, target string")
    out = records.with_vocabulary(records.instance_objects(_instances(spark, d)), mapping)
    return out.select(F.col("instance").cast("long").alias("instance"), *[r6(c).alias(c) for a in "xyz" for c in (a, f"e{a}")], "number")


@query("SELECT o_orderkey::VARCHAR AS id, 'f' || (o_orderkey % 40 + k) AS file FROM orders, (SELECT unnest([0, 1]) AS k) WHERE o_orderkey % 40 + k > 35")
def missing_citations(spark, d):
    """Cited files that aren't there: f0 to f35 are."""
    claims = load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.array(*[F.concat(F.lit("f"), (F.col("o_orderkey") % 40 + k)) for k in (0, 1)]).alias("cites"))
    return O.missing_citations(claims, spark.range(36).select(F.concat(F.lit("f"), "id").alias("file")))


@query("SELECT r_regionkey::INT AS scene, 'NATION_' || (r_regionkey + k * 9) AS nation, r_name AS region, CASE k WHEN 0 THEN 1.0 ELSE 0.8 END AS amplitude FROM region, (SELECT unnest([0, 1]) AS k)")
def factor_two(spark, d):
    """Two bound pairs of unlike strength in one vector, found one after the other."""
    space = Space(4096)
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    (nations, a), (regions, b) = _book(space, n, "n_name"), _book(space, r, "r_name")
    scenes = []
    for x in r.collect():  # a scene for each region
        k = int(x.r_regionkey)
        v = sum(m * a[nations.index(f"NATION_{k + 9 * i}")] * b[regions.index(x.r_name)] for i, m in enumerate((1.0, 0.8)))
        scenes.append((k, v.real.tolist(), v.imag.tolist()))
    out = K.factor_signals(spark.createDataFrame(scenes, "scene int, re array<double>, im array<double>"), "scene", [a, b], 3).filter("converged")
    nation, region = _named(None, nations, regions)
    return out.select("scene", nation.alias("nation"), region.alias("region"), (F.round("score", 1) + F.lit(0.0)).alias("amplitude"))


@query("WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id % 20 = 0) SELECT a.vec_id, (a.j + b.j) % 64 AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM v a JOIN v b USING (vec_id) GROUP BY ALL")
def hrr_bind(spark, d):
    """Real vectors bound to themselves by circular convolution."""
    e = load(spark, d, "embeddings").filter("vec_id % 20 = 0").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    out = K.hrr_bind(e, "vec_id", "e", "e")
    return out.select("vec_id", F.posexplode("bound").alias("j", "v")).select("vec_id", F.col("j").cast("long").alias("j"), (F.round("v", 5) + F.lit(0.0)).alias("v"))

