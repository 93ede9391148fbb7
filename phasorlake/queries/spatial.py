"""Queries of the scene layer: line items and embeddings stand for points."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasorlake import functions as X
from phasorlake.operators import analytics as A
from phasorlake.operators import scenes as G
from phasorlake.queries.registry import load, query, r6, s6


def _points(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_tax").alias("alpha"), "l_suppkey", "l_returnflag")


_P = "p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax AS alpha, l_suppkey, l_returnflag FROM lineitem)"


def _wq(src: str, v: str, w: str, q: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""(WITH h AS (SELECT {cols}{v} AS v, sum({w}) AS w FROM {src} GROUP BY {cols}{v} HAVING sum({w}) > 0),
m AS (SELECT *, (sum(w) OVER ({part} ORDER BY v ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER ({part}) AS m FROM h),
l AS (SELECT *, lag(m) OVER ({part} ORDER BY v) AS pm, lag(v) OVER ({part} ORDER BY v) AS pv, lead(m) OVER ({part} ORDER BY v) IS NULL AS last FROM m),
a AS (SELECT *, unnest({q}::DOUBLE[]) AS q FROM l)
SELECT {cols}q, CASE WHEN pm IS NOT NULL THEN CASE WHEN q > pm AND q <= m THEN pv + (v - pv) * (q - pm) / (m - pm) WHEN last AND q > m THEN v END WHEN q <= m OR last THEN v END AS v FROM a WHERE (pm IS NOT NULL AND ((q > pm AND q <= m) OR (last AND q > m))) OR (pm IS NULL AND (q <= m OR last)))"""


@query(f"WITH {_P} SELECT l_returnflag, q, {s6('v')} AS y FROM {_wq('p', 'y', 'x', '[0.1, 0.5, 0.9]', 'l_returnflag')}")
def weighted_quantile(spark, d):
    out = G.weighted_quantile(_points(spark, d), "y", "x", [0.1, 0.5, 0.9], ["l_returnflag"])
    return out.select("l_returnflag", "q", r6("y").alias("y"))


@query(
    f"""WITH {_P}, f AS (SELECT * FROM p WHERE alpha >= 0.02), c AS (SELECT (SELECT v FROM {_wq('f', 'x', 'alpha', '[0.5]')}) AS cx, (SELECT v FROM {_wq('f', 'y', 'alpha', '[0.5]')}) AS cy, (SELECT v FROM {_wq('f', 'z', 'alpha', '[0.5]')}) AS cz),
r AS (SELECT f.*, cx, cy, cz, greatest(abs(x-cx), abs(y-cy), abs(z-cz)) AS r FROM f, c), k AS (SELECT v AS radius FROM {_wq('r', 'r', 'alpha', '[0.8]')})
SELECT l_orderkey, l_linenumber, {s6('(x-cx)/radius')} AS x, {s6('(y-cy)/radius')} AS y, {s6('(z-cz)/radius')} AS z FROM r, k WHERE r <= radius"""
)
def mass_crop(spark, d):
    out = G.mass_crop(_points(spark, d), ["x", "y", "z"], "alpha", 0.02, 0.8)
    return out.select("l_orderkey", "l_linenumber", r6("x_n").alias("x"), r6("y_n").alias("y"), r6("z_n").alias("z"))


@query("SELECT p_partkey, CASE WHEN p_size <= 5 THEN 0 WHEN p_size <= 15 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END AS band FROM part")
def band_of(spark, d):
    return load(spark, d, "part").select("p_partkey", G.band_of(F.col("p_size"), [5, 15, 40, 50]).alias("band"))


@query(f"WITH {_P} SELECT floor(x/5)::BIGINT AS ci, floor(y/2/5)::BIGINT AS cj, floor(z*2.5/5)::BIGINT AS ck, count(*) AS n, {s6('sum(alpha)')} AS alpha FROM p GROUP BY ALL")
def uniform_cells(spark, d):
    p = _points(spark, d).withColumns({"y": F.col("y") / 2, "z": F.col("z") * 2.5})
    return G.uniform_cells(p, ["x", "y", "z"], 10.0, 1).groupBy("ci", "cj", "ck").agg(F.count("*").alias("n"), r6(F.sum("alpha")).alias("alpha"))


@query(
    f"""WITH {_P}, k AS (SELECT *, count(*) OVER (PARTITION BY floor(x/16), floor(y/16), floor(z/16)) AS n0, count(*) OVER (PARTITION BY floor(x/8), floor(y/8), floor(z/8)) AS n1,
count(*) OVER (PARTITION BY floor(x/4), floor(y/4), floor(z/4)) AS n2, count(*) OVER (PARTITION BY floor(x/2), floor(y/2), floor(z/2)) AS n3 FROM p),
l AS (SELECT *, CASE WHEN n0 <= 200 THEN 0 WHEN n1 <= 200 THEN 1 WHEN n2 <= 200 THEN 2 ELSE 3 END AS level FROM k)
SELECT level, floor(floor(x/2)/2**(3-level))::BIGINT AS ci, floor(floor(y/2)/2**(3-level))::BIGINT AS cj, floor(floor(z/2)/2**(3-level))::BIGINT AS ck, count(*) AS n, bool_or(level = 3 AND n3 > 200) AS overflow FROM l GROUP BY ALL"""
)
def adaptive_cells(spark, d):
    out = G.adaptive_cells(_points(spark, d), ["x", "y", "z"], 16.0, 200, 3)
    return out.groupBy("level", "ci", "cj", "ck").agg(F.count("*").alias("n"), F.bool_or("overflow").alias("overflow"))


def _emb(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


_E = "e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


@query(
    f"""WITH {_E}, c AS (SELECT DISTINCT floor(x/0.1)::BIGINT AS ci, floor(y/0.1)::BIGINT AS cj FROM e)
SELECT vec_id, ci, cj FROM e, c WHERE (x - least(greatest(x, ci*0.1), ci*0.1+0.1))**2 + (y - least(greatest(y, cj*0.1), cj*0.1+0.1))**2 <= 0.15*0.15"""
)
def cell_range_join(spark, d):
    e = _emb(spark, d)
    cells = G.uniform_cells(e, ["x", "y"], 0.1).select("ci", "cj").distinct()
    return G.cells_in_reach(e.select("vec_id", "x", "y"), cells, ["x", "y"], ["ci", "cj"], 0.1, 0.15).select("vec_id", "ci", "cj")


@query(
    f"""WITH {_E}, s AS (SELECT x AS sx, y AS sy, (label+1)::DOUBLE AS alpha, floor(x/0.1)::BIGINT AS ci, floor(y/0.1)::BIGINT AS cj FROM e),
v AS (SELECT vec_id, sum(alpha*exp(-0.5/(0.05*0.05)*((x-sx)**2+(y-sy)**2))) AS v FROM e, s WHERE (x - least(greatest(x, ci*0.1), ci*0.1+0.1))**2 + (y - least(greatest(y, cj*0.1), cj*0.1+0.1))**2 <= 0.15*0.15 GROUP BY vec_id)
SELECT vec_id, {s6('coalesce(v, 0)')} AS value FROM e LEFT JOIN v USING (vec_id)"""
)
def exact_slice(spark, d):
    e = _emb(spark, d)
    s = e.select(F.col("x").alias("x_s"), F.col("y").alias("y_s"), (F.col("label") + 1).cast("double").alias("alpha"))
    return G.exact_slice(e.select("vec_id", "x", "y"), "vec_id", s, ["x", "y"], 0.1, 0.15, 0.05).select("vec_id", r6("value").alias("value"))


@query(f"WITH {_P}, b AS (SELECT l_returnflag, least(floor((x - 0)/(50.0/48)), 47)::INT AS b, sum(alpha) AS w FROM p WHERE x BETWEEN 0 AND 50 GROUP BY ALL) SELECT l_returnflag, {s6('(b + 0.5) * 50.0 / 48')} AS mode FROM b QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY round(w, 6) DESC, b) = 1")
def mass_mode(spark, d):
    return G.mass_mode(_points(spark, d), "x", "alpha", 0.0, 50.0, 48, ["l_returnflag"]).select("l_returnflag", r6("mode").alias("mode"))


@query(f"SELECT {s6('-1 + a.i * 2.0 / 15')} AS u, {s6('-1 + b.i * 2.0 / 15')} AS v FROM (SELECT unnest(range(16)) AS i) a, (SELECT unnest(range(16)) AS i) b")
def slice_grid(spark, d):
    return G.grid(spark, 16).select(r6("u").alias("u"), r6("v").alias("v"))


@query(f"SELECT p_partkey, {s6('p_size + 4.0')} AS var, {s6('p_retailprice * sqrt(p_size / (p_size + 4.0))')} AS amp FROM part")
def footprint_blur(spark, d):
    var, amp = G.footprint_blur([F.col("p_size").cast("double")], F.col("p_retailprice"), 2.0)
    return load(spark, d, "part").select("p_partkey", r6(var[0]).alias("var"), r6(amp).alias("amp"))


def _resid(spark, d):
    p = _points(spark, d)
    unit = p.agg((F.sum("y") / F.sum("x")).alias("u"))
    return p.crossJoin(F.broadcast(unit)).withColumn("recon", F.col("x") * F.col("u"))


_R = f"{_P}, q AS (SELECT p.*, x * (SELECT sum(y)/sum(x) FROM p) AS recon FROM p), e AS (SELECT *, y - recon AS r FROM q)"


@query(f"WITH {_R}, s AS (SELECT l_returnflag, r*r AS e, row_number() OVER (PARTITION BY l_returnflag ORDER BY r*r DESC) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n, sum(r*r) OVER (PARTITION BY l_returnflag) AS t FROM e) SELECT l_returnflag, f AS fraction, {s6('sum(CASE WHEN k <= greatest(1, floor(n*f)) THEN e END) / any_value(t)')} AS share FROM s, (SELECT unnest([0.01, 0.1]::DOUBLE[]) AS f) GROUP BY ALL")
def error_shares(spark, d):
    e = _resid(spark, d).withColumn("r", F.col("y") - F.col("recon"))
    return A.error_shares(e, "r", [0.01, 0.1], ["l_returnflag"]).select("l_returnflag", "fraction", r6("share").alias("share"))


@query(f"WITH {_R} SELECT cell, {s6('(sum(r*r)/(SELECT sum(r*r) FROM e)) / (count(*)::DOUBLE/(SELECT count(*) FROM e))')} AS enrichment FROM e JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey % 16 AS cell FROM e) USING (l_orderkey, l_linenumber) GROUP BY 1")
def enrichment(spark, d):
    e = _resid(spark, d).withColumns({"e": (F.col("y") - F.col("recon")) * (F.col("y") - F.col("recon")), "px": F.struct("l_orderkey", "l_linenumber"), "cell": F.col("l_suppkey") % 16})
    return A.enrichment(e.select("px", "e"), "px", "e", e, "cell").select("cell", r6("enrichment").alias("enrichment"))


@query(
    f"""WITH {_R}, s AS (SELECT r*r AS e, row_number() OVER (ORDER BY r*r DESC) AS k, count(*) OVER () AS n, sum(r*r) OVER () AS t FROM e), h AS (SELECT sum(CASE WHEN k <= greatest(1, floor(n*0.01)) THEN e END)/any_value(t) AS a, sum(CASE WHEN k <= greatest(1, floor(n*0.1)) THEN e END)/any_value(t) AS b FROM s)
SELECT {s6('sqrt(sum(r*r))/sqrt(sum(y*y))')} AS relative, {s6('max(abs(recon))/max(abs(y))')} AS peak, {s6('any_value(a)')} AS share_1, {s6('any_value(b)')} AS share_10, CASE WHEN any_value(a) >= 0.9 THEN 'spike' WHEN any_value(b) >= 0.5 THEN 'localised' ELSE 'distributed' END AS reading FROM e, h"""
)
def locality(spark, d):
    return A.locality(_resid(spark, d), "y", "recon").select(*[r6(c).alias(c) for c in ("relative", "peak", "share_1", "share_10")], "reading")


@query(f"WITH {_R} SELECT {s6('avg(r*r)')} AS mse, {s6('sqrt(avg(r*r))')} AS rmse, {s6('10*log10(10000/avg(r*r))')} AS psnr FROM e")
def psnr(spark, d):
    return A.psnr(_resid(spark, d), "y", "recon", 100.0).select(*[r6(c).alias(c) for c in ("mse", "rmse", "psnr")])


@query("SELECT p_partkey, p_brand, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size) AS rank FROM part")
def percentile_rank_in_band(spark, d):
    return A.percentile_rank(load(spark, d, "part"), ["p_brand"], "p_size").select("p_partkey", "p_brand", "rank")


@query(
    f"""WITH {_E}, a AS (SELECT * FROM e WHERE label % 2 = 0), b AS (SELECT * FROM e WHERE label % 2 = 1),
m AS (SELECT a.vec_id, arg_min(b.vec_id, struct_pack(d := sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2), k := b.vec_id)) AS k, min(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)) AS d FROM a, b WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) <= 0.08 GROUP BY 1)
SELECT a.vec_id, coalesce(k, -1) AS nearest, {s6('d')} AS dist FROM a LEFT JOIN m USING (vec_id)"""
)
def nn_radius_join(spark, d):
    e = _emb(spark, d)
    return A.nearest_within(e.filter("label % 2 = 0"), "vec_id", e.filter("label % 2 = 1"), "vec_id", ["x", "y", "z"], 0.08).select("vec_id", "nearest", r6("dist").alias("dist"))


@query(f"WITH {_E}, c AS (SELECT * FROM e WHERE label = 1) SELECT vec_id FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.x = e.x AND c.y = e.y AND c.z = e.z)")
def subset_antijoin(spark, d):
    e = _emb(spark, d)
    return A.remove_subset(e, "vec_id", e.filter("label = 1").withColumnRenamed("vec_id", "c"), "c", ["x", "y", "z"], 1e-6).select("vec_id")


@query("SELECT l_returnflag, CASE WHEN count_if(l_quantity > 25 OR l_discount > 0.05) > 0 THEN count_if(l_quantity > 25 AND l_discount > 0.05)::DOUBLE / count_if(l_quantity > 25 OR l_discount > 0.05) ELSE 1.0 END AS iou FROM lineitem GROUP BY 1")
def iou_mask(spark, d):
    return A.iou(load(spark, d, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05, ["l_returnflag"])


@query(f"WITH {_P}, m AS (SELECT floor(x/10)::BIGINT AS ci, floor(y/10)::BIGINT AS cj, sum(alpha) AS m FROM p GROUP BY ALL), k AS (SELECT median(m) AS mid FROM m WHERE m > 0) SELECT ci, cj, {s6('CASE WHEN m > 0 THEN ln(1 + m/mid) ELSE 0 END')} AS flat FROM m, k")
def voxel_flatten(spark, d):
    p = G.uniform_cells(_points(spark, d), ["x", "y"], 10.0)
    return A.flatten(p, ["ci", "cj"], "alpha").groupBy("ci", "cj").agg(r6(F.sum("flat")).alias("flat"))


@query(f"WITH {_P}, b AS (SELECT l_returnflag, least(floor(sqrt(x*x+z*z)/5.0), 9)::INT AS bin, sum(alpha) AS m FROM p WHERE sqrt(x*x+z*z) <= 50 GROUP BY ALL) SELECT l_returnflag, bin, {s6('m / sum(m) OVER (PARTITION BY l_returnflag)')} AS share FROM b")
def radial_histogram(spark, d):
    p = _points(spark, d)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z"))
    return A.weighted_histogram(p, r, F.col("alpha"), 0.0, 50.0, 10, ["l_returnflag"]).select("l_returnflag", "bin", r6("share").alias("share"))


@query(f"WITH {_E} SELECT label, least(floor(sqrt(x*x+z*z)/0.1), 4)::INT AS ring, (y > 0) AS up, {s6('avg(x*x+y*y+z*z)')} AS power FROM e WHERE sqrt(x*x+z*z) <= 0.5 GROUP BY ALL")
def radial_power(spark, d):
    e = _emb(spark, d).withColumn("ring", X.bucket(F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z")), 0.0, 0.5, 5)).filter("ring IS NOT NULL")
    return e.groupBy("label", "ring", (F.col("y") > 0).alias("up")).agg(r6(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("power"))


_KNN = "p AS (SELECT a.vec_id, a.label, b.vec_id AS k, b.label AS l, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0), t AS (SELECT vec_id, label, k AS nearest, l AS guess, cos FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, k) = 1)"


@query(f"WITH {_KNN} SELECT label, avg((label = guess)::INT::DOUBLE) AS accuracy, count(*) AS n FROM t GROUP BY label")
def loo_1nn(spark, d):
    """Ids divisible by 20 against all."""
    e = load(spark, d, "embeddings")
    out = A.knn_labels(e, "vec_id", "embedding", "label", e.filter("vec_id % 20 = 0"))
    return out.groupBy("label").agg(F.avg((F.col("label") == F.col("guess")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query(f"WITH {_P} SELECT k AS top, {s6('sum(m) / any_value(t)')} AS share FROM (SELECT x*alpha AS m, row_number() OVER (ORDER BY x*alpha DESC) AS r, sum(x*alpha) OVER () AS t FROM p), (SELECT unnest([10, 100, 600]) AS k) WHERE r <= k GROUP BY k")
def mass_shares(spark, d):
    return A.mass_shares(_points(spark, d), F.col("x") * F.col("alpha"), [10, 100, 600]).select("top", r6("share").alias("share"))


@query(f"WITH {_P}, a AS (SELECT unnest([1.0, 13.0, 25.0, 37.0]) AS t0), b AS (SELECT unnest([0.0, 3.0, 6.0]) AS t1) SELECT t0, t1, {s6('sum(alpha)')} AS mass, {s6('sum(alpha)/(SELECT sum(alpha) FROM p)')} AS share FROM p, a, b WHERE x BETWEEN t0 AND t0+14 AND z BETWEEN t1 AND t1+14 GROUP BY ALL HAVING sum(alpha)/(SELECT sum(alpha) FROM p) >= 0.05")
def tile_share(spark, d):
    out = G.tile_rows(_points(spark, d), ["x", "z"], [[1.0, 13.0, 25.0, 37.0], [0.0, 3.0, 6.0]], 14.0, "alpha", 0.05)
    return out.select("t0", "t1", r6("mass").alias("mass"), r6("share").alias("share"))


@query("SELECT * FROM (VALUES (0.0::DOUBLE), (6.0), (12.0), (18.0), (24.0), (30.0), (36.0), (38.0)) t(t0)")
def sliding_tiles(spark, d):
    return spark.createDataFrame([(float(x),) for x in G.tile_starts(0.0, 50.0, 12.0, 0.5)], "t0 double")


@query("SELECT l_orderkey, l_linenumber, " + " + ".join(f"((((l_quantity::BIGINT >> {b}) & 1) << {3 * b}) + (((floor(l_extendedprice/100)::BIGINT >> {b}) & 1) << {3 * b + 1}) + ((((l_discount*100)::BIGINT >> {b}) & 1) << {3 * b + 2}))" for b in range(10)) + " AS code FROM lineitem")
def morton_order(spark, d):
    li = load(spark, d, "lineitem")
    code = X.morton(F.col("l_quantity"), F.floor(F.col("l_extendedprice") / 100), F.rint(F.col("l_discount") * 100))
    return li.select("l_orderkey", "l_linenumber", code.alias("code"))


_V = "v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT a.vec_id, a.j // 2 AS j, a.v AS re, b.v AS im FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.j % 2 = 0 AND b.j = a.j + 1)"


def _complex(spark, d):
    v = load(spark, d, "embeddings").select("vec_id", F.expr("transform(sequence(0, int(size(embedding) / 2) - 1), i -> named_struct('j', i, 're', double(embedding[2*i]), 'im', double(embedding[2*i+1])))").alias("c"))
    return v.select("vec_id", F.inline("c"))


@query(f"WITH {_V} SELECT vec_id, j, (round_even(atan2(im, re) / 6.283185307179586 * 64, 0)::INT % 64 + 64) % 64 AS code FROM c")
def quantize_codes(spark, d):
    return _complex(spark, d).select("vec_id", F.col("j").cast("long").alias("j"), X.quantize(F.atan2("im", "re"), X.check_bits(6)).alias("code"))


@query(f"WITH {_V}, m AS (SELECT *, sqrt(re*re+im*im) AS mag FROM c), t AS (SELECT vec_id, quantile_cont(mag, 0.3) AS t FROM m GROUP BY 1) SELECT vec_id, j, {s6('re * greatest(mag-t, 0)/greatest(mag, 1e-30)')} AS re, {s6('im * greatest(mag-t, 0)/greatest(mag, 1e-30)')} AS im FROM m JOIN t USING (vec_id)")
def shrink_soft(spark, d):
    from phasorlake.operators.quantize import percentile_threshold, shrink

    c = _complex(spark, d)
    out = shrink(c.join(percentile_threshold(c, ["vec_id"], 30), "vec_id"), "threshold")
    return out.select("vec_id", F.col("j").cast("long").alias("j"), r6("re").alias("re"), r6("im").alias("im"))


@query(f"WITH {_V}, b AS (SELECT vec_id, j // 16 AS block, max(greatest(abs(re), abs(im))) AS top FROM c GROUP BY ALL) SELECT vec_id, block, ceil(round(log2(top), 9))::INT AS exponent FROM b")
def block_scale(spark, d):
    from phasorlake.operators.quantize import block_scales

    return block_scales(_complex(spark, d), ["vec_id"], 16).select("vec_id", F.col("block").cast("long").alias("block"), "exponent")


@query(f"WITH {_V}, p AS (SELECT *, sqrt(re*re+im*im) AS mag, max(sqrt(re*re+im*im)) OVER (PARTITION BY vec_id) AS top FROM c), k AS (SELECT *, round_even(sqrt(mag/top)*15, 0)::INT AS m, (round_even(atan2(im, re)/6.283185307179586*16, 0)::INT % 16 + 16) % 16 AS p FROM p) SELECT vec_id, j, m, p, {s6('top*(m/15.0)**2*cos(p*6.283185307179586/16)')} AS re, {s6('top*(m/15.0)**2*sin(p*6.283185307179586/16)')} AS im FROM k")
def quant_polar(spark, d):
    from phasorlake.operators.quantize import quant_polar

    return quant_polar(_complex(spark, d), ["vec_id"], 4, 4, 0.5).select("vec_id", F.col("j").cast("long").alias("j"), "m", "p", r6("re").alias("re"), r6("im").alias("im"))


@query(
    f"""WITH k AS (SELECT quantile_cont(p_retailprice, [{", ".join(str((i + 0.5) / 16) for i in range(16))}]) AS q FROM part), x AS (SELECT p_partkey, p_retailprice AS v, unnest(range(16)) AS i, unnest(q) AS level FROM part, k)
SELECT p_partkey, i::INT AS code, {s6('level')} AS level FROM x QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(level - v), i) = 1"""
)
def codebook_quantiles(spark, d):
    """16 quantile codes of prices and each part's nearest."""
    from phasorlake.operators.quantize import quantile_codebook

    return quantile_codebook(load(spark, d, "part"), "p_partkey", "p_retailprice", 16).withColumn("level", r6("level"))
