"""Queries of the composed studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasorlake.operators import fields as E
from phasorlake.operators import pairs as B
from phasorlake.operators import studies as T
from phasorlake.queries.fields import _S, _W, D, SPACE, _splats, _table
from phasorlake.queries.registry import gauss, js, load, query, r6, s6, theta, u
from phasorlake.space import Space


_CAP = f"""g AS (SELECT load, i, 'key' || load || '.' || i AS k, 'val' || floor({u("'val|' || load || '|' || i")} * 16)::INT AS v FROM (SELECT load, unnest(range(load)) AS i FROM (VALUES (8), (32), (128)) t(load))),
m AS (SELECT load, j, sum(cos({theta(512, 'k')} + {theta(512, 'v')})) AS re, sum(sin({theta(512, 'k')} + {theta(512, 'v')})) AS im FROM g, {js(512)} GROUP BY load, j),
b AS (SELECT v AS label, j, {theta(512, 'v')} AS t FROM (SELECT DISTINCT v FROM g), {js(512)}),
q AS (SELECT load, k, v, j, m.re*cos(t) + m.im*sin(t) AS re, m.im*cos(t) - m.re*sin(t) AS im FROM (SELECT load, k, v, j, {theta(512, 'k')} AS t FROM g, {js(512)}) JOIN m USING (load, j)),
s AS (SELECT load, k, v, label, sum(q.re*cos(b.t) + q.im*sin(b.t)) AS score FROM q JOIN b USING (j) GROUP BY ALL)"""


@query(f"WITH {_CAP}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY load, k ORDER BY score DESC, label) = 1) SELECT load, round(avg((v = label)::INT::DOUBLE), 6) AS recall FROM t GROUP BY load")
def map_capacity(spark, d):
    return T.map_capacity(Space(512), spark, [8, 32, 128], 16).withColumn("recall", F.round("recall", 6))


_Q = "'"
_X = "(0.5 / sqrt(n / 512.0))"
_T = f"(1.0 / (1.0 + 0.2316419 * {_X}))"


@query(f"SELECT n AS members, {s6(f'{_T} * (0.319381530 + {_T} * (-0.356563782 + {_T} * (1.781477937 + {_T} * (-1.821255978 + {_T} * 1.330274429)))) * exp(-{_X} * {_X} / 2) / sqrt(6.283185307179586)')} AS rate FROM (VALUES (10), (50), (100)) t(n)")
def false_positive_rate(spark, d):
    """The predicted rate of strangers that pass, at 256 dimensions."""
    rows = spark.createDataFrame([(10,), (50,), (100,)], "members int")
    return rows.select("members", r6(T.false_positive_rate(F.col("members"), 256)).alias("rate"))


_DOT = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


@query(
    f"""WITH v AS (SELECT label, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, list(m ORDER BY j) AS c FROM (SELECT label, j, avg(v) AS m FROM v GROUP BY ALL) GROUP BY label),
n AS (SELECT vec_id, embedding AS q, c.label FROM embeddings e, c WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_DOT.format(a='q', b='c')} DESC, c.label) <= 2)
SELECT n.vec_id, e.vec_id AS item, {_DOT.format(a='n.q', b='e.embedding')} AS score FROM n JOIN embeddings e ON e.label = n.label QUALIFY row_number() OVER (PARTITION BY n.vec_id ORDER BY score DESC, e.vec_id) = 1"""
)
def coarse_fine(spark, d):
    e = load(spark, d, "embeddings")
    return T.coarse_fine(e.filter("vec_id % 20 = 0"), "vec_id", e, "vec_id", "label", "embedding", 2)


@query(
    f"""WITH {_S}, {_W}, c AS (SELECT floor(x/0.25)::BIGINT AS ci, floor(y/0.25)::BIGINT AS cj, j, sum(alpha*cos(w0*x+w1*y)) AS re, sum(alpha*sin(w0*x+w1*y)) AS im FROM s, w GROUP BY ALL),
n AS (SELECT vec_id, x, y, ci, cj FROM p, (SELECT DISTINCT ci, cj FROM c) k WHERE (x - least(greatest(x, ci*0.25), ci*0.25+0.25))**2 + (y - least(greatest(y, cj*0.25), cj*0.25+0.25))**2 <= 0.2*0.2)
SELECT vec_id, round(sum(re*cos(w0*x+w1*y)+im*sin(w0*x+w1*y))/{D}, 4) + 0.0 AS value, count(DISTINCT (ci, cj)) AS consulted FROM n JOIN c USING (ci, cj) JOIN w USING (j) GROUP BY vec_id"""
)
def cells_bundle(spark, d):
    s, t = _splats(spark, d), _table(spark)
    out = T.cell_read(SPACE, s.filter("vec_id % 20 = 0"), "vec_id", s, t, ["x", "y"], 0.25, 0.2, "alpha")
    return out.select("vec_id", (F.round("value", 4) + F.lit(0.0)).alias("value"), "consulted")


@query(f"WITH {_S}, {_W} SELECT j, round(sum(CASE WHEN label = 3 THEN alpha ELSE 0 END * cos(w0*x+w1*y)), 4) + 0.0 AS re FROM s, w GROUP BY j")
def change_bundle(spark, d):
    """What a scene has more than the scene without label 3."""
    s, t = _splats(spark, d), _table(spark)
    f = lambda df: E.encode(df, t, ["x", "y"], ["alpha"]).withColumnsRenamed({"alpha_re": "re", "alpha_im": "im"})
    return T.difference(f(s), f(s.filter("label <> 3"))).select("j", (F.round("re", 4) + F.lit(0.0)).alias("re"))


@query(f"WITH {_S}, {_W} SELECT label % 3 AS band, j, round(sum(alpha*cos(w0*x+w1*y)), 4) + 0.0 AS re, round(sum(alpha*sin(w0*x+w1*y)), 4) + 0.0 AS im FROM s, w GROUP BY ALL")
def field_bands(spark, d):
    s = _splats(spark, d).withColumn("band", F.col("label") % 3)
    f = E.encode(s, _table(spark), ["x", "y"], ["alpha"], ["band"])
    return f.select("band", "j", *[(F.round(f"alpha_{c}", 4) + F.lit(0.0)).alias(c) for c in ("re", "im")])


@query(f"WITH {_S}, {_W}, f AS (SELECT j, sum(alpha*cos(w0*x+w1*y)) AS re FROM s, w GROUP BY j) SELECT j, round(re * CASE WHEN abs(w0*0.6+w1*0.8) < 1e-9 THEN 2.0*1.5 ELSE 2*sin((w0*0.6+w1*0.8)*1.5)/(w0*0.6+w1*0.8) END, 4) + 0.0 AS re FROM f JOIN w USING (j)")
def view_bundle(spark, d):
    t = _table(spark)
    f = E.encode(_splats(spark, d), t, ["x", "y"], ["alpha"]).withColumnsRenamed({"alpha_re": "re", "alpha_im": "im"})
    return E.view_bundle(f, t, [0.6, 0.8], 1.5).select("j", (F.round("re", 4) + F.lit(0.0)).alias("re"))


_P = f"p AS (SELECT a.vec_id AS q, b.vec_id AS k, a.label AS la, b.label AS lb, {_DOT.format(a='a.embedding', b='b.embedding')} AS cos FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"


def _asked(spark, d):
    """The stated query set, and all rows."""
    e = load(spark, d, "embeddings")
    return e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "q"), e.withColumnRenamed("vec_id", "k")


@query(f"WITH {_P} SELECT q, arg_max(la = lb, struct_pack(c := cos, k := -k)) AS hit, max(CASE WHEN la = lb THEN cos END) AS best_positive, max(CASE WHEN la <> lb THEN cos END) AS best_negative FROM p GROUP BY q")
def retrieval(spark, d):
    q, e = _asked(spark, d)
    return T.retrieval(B.best_pairs(q, "q", e, "k", "embedding", 1, same="label"), "q", "k", "cos", F.col("same"))


@query(f"WITH {_P.replace(' WHERE a.vec_id % 20 = 0', '')} SELECT la, lb, {s6('avg(cos)')} AS mean, {s6('stddev_pop(cos)')} AS sigma, {s6('quantile_cont(cos, 0.95)')} AS p95, {s6('max(cos)')} AS top FROM p GROUP BY ALL")
def pair_statistics(spark, d):
    """Scores of all pairs, by labels."""
    out = B.label_statistics(load(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.95).withColumnRenamed("quantile", "p95")
    return out.select("la", "lb", *[r6(c).alias(c) for c in ("mean", "sigma", "p95", "top")])


@query(f"WITH {_P} SELECT q, k, cos FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY cos DESC, k) <= 5")
def cosine_topk(spark, d):
    q, e = _asked(spark, d)
    return B.best_items(q, "q", e, "k", "embedding", 5)


@query("WITH r AS (SELECT p_partkey, p_size AS cells, p_size * 40.0 AS splats, p_size * 256.0 AS bytes FROM part) SELECT p_partkey, bytes::DOUBLE AS bytes, round((bytes/splats)::DOUBLE, 6) AS per_splat, round((bytes/(splats*16))::DOUBLE, 6) AS ratio, round((SELECT median(bytes/(splats*16)) FROM r)::DOUBLE, 6) AS median_ratio FROM r")
def storage_position(spark, d):
    p = load(spark, d, "part")
    out = T.storage_position(p, "p_partkey", F.col("p_size") * 40.0, F.col("p_size"), F.col("p_size"), 128, 8)
    return out.select("p_partkey", "bytes", *[r6(c).alias(c) for c in ("per_splat", "ratio", "median_ratio")])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_work(spark, d):
    done = load(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.resume(load(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query("SELECT user_id AS peer, event_id AS i FROM events WHERE event_type <> 'error'")
def orset_compact(spark, d):
    """After compaction the removed ops are gone, and no tombstone is left."""
    e = load(spark, d, "events").select(F.col("user_id").alias("peer"), F.lit(0).alias("epoch"), F.col("event_id").alias("i"), "event_type")
    kept, left = T.compact(e, e.filter("event_type = 'error'"))
    return kept.select("peer", "i").unionByName(left.select("peer", "i"))


@query(
    f"""WITH {_S}, r AS (SELECT x, y, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM s), dr AS (SELECT i, floor({u("'0|a|' || i")} * n)::BIGINT AS a, floor({u("'0|b|' || i")} * n)::BIGINT AS b FROM (SELECT unnest(range(2000)) AS i), (SELECT any_value(n) AS n FROM r)),
d AS (SELECT sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) AS d FROM dr JOIN r p ON p.r = dr.a JOIN r q ON q.r = dr.b) SELECT CASE WHEN d <= 4 THEN least(floor(d / 0.25), 15)::INT END AS bin, count(*) AS n FROM d GROUP BY 1"""
)
def pair_distances(spark, d):
    """The distribution of distances between drawn pairs of embeddings."""
    s = _splats(spark, d)
    from phasorlake.functions import bucket

    out = T.sampled_distances(s, "vec_id", ["x", "y"], 2000)
    return out.groupBy(bucket(F.col("d"), 0.0, 4.0, 16).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {_S} SELECT vec_id, {s6('x + 0.05*' + gauss(_Q + '0|drift|x|' + _Q + ' || vec_id'))} AS x, {s6('y + 0.05*' + gauss(_Q + '0|drift|y|' + _Q + ' || vec_id'))} AS y, {s6('alpha*exp(0.1*' + gauss(_Q + '0|gain|' + _Q + ' || vec_id') + ')')} AS alpha FROM s")
def drifted_points(spark, d):
    s = _splats(spark, d)
    moved = T.drift(s, "vec_id", ["x", "y"], "alpha", 0.05, 0.1)
    return moved.select("vec_id", r6("x").alias("x"), r6("y").alias("y"), r6("alpha").alias("alpha"))
