"""Queries of continuous fields, routing and kernels. Embeddings stand for splats; points are the stated set of ids divisible by 20."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from phasorlake.operators import fields as E
from phasorlake.operators import kernels as K
from phasorlake.operators import regress as G
from phasorlake.operators import render as V
from phasorlake.operators import routing as R
from phasorlake.plans import BROADCAST
from phasorlake.queries.registry import gauss, js, load, query, r6, s6, theta
from phasorlake.space import Space

D, SIGMA = 128, 0.3
SPACE = Space(D)


def _splats(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xy")], (F.col("label") + 1).cast("double").alias("alpha"), F.lit(1.0).alias("one"))


def r4(name: str):
    return (F.round(name, 4) + F.lit(0.0)).alias(name)


def _shared(df):
    return df.withColumnsRenamed({"x": "x_s", "y": "y_s"})


_S = "s AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (label+1)::DOUBLE AS alpha FROM embeddings), p AS (SELECT * FROM s WHERE vec_id % 20 = 0)"
_W = f"w AS (SELECT j, {gauss(f'{chr(39)}0|{D}|W|{chr(39)} || j || {chr(39)}|0{chr(39)}')} / {SIGMA} AS w0, {gauss(f'{chr(39)}0|{D}|W|{chr(39)} || j || {chr(39)}|1{chr(39)}')} / {SIGMA} AS w1 FROM {js(D)})"
_F = "f AS (SELECT j, sum(alpha*cos(w0*x+w1*y)) AS re, sum(alpha*sin(w0*x+w1*y)) AS im, sum(cos(w0*x+w1*y)) AS ore, sum(sin(w0*x+w1*y)) AS oim FROM s, w GROUP BY j)"


def _table(spark):
    return SPACE.frequencies(spark, 2, SIGMA)


@query(f"WITH {_W} SELECT j, round(w0, 5) + 0.0 AS w0, round(w1, 5) + 0.0 AS w1 FROM w")
def frequency_table(spark, d):
    return _table(spark).select("j", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("w0", "w1")])


@query(f"WITH {_S}, {_W}, {_F} SELECT vec_id, round(sum(re*cos(w0*x+w1*y) + im*sin(w0*x+w1*y))/{D}, 4) + 0.0 AS alpha, round(sum(ore*cos(w0*x+w1*y) + oim*sin(w0*x+w1*y))/{D}, 4) + 0.0 AS one FROM p, w JOIN f USING (j) GROUP BY vec_id")
def field_bundle(spark, d):
    """Two channels of one field, encoded and read in a pass each."""
    s, t = _splats(spark, d), _table(spark)
    out = E.decode(s.filter("vec_id % 20 = 0").select("vec_id", "x", "y"), "vec_id", E.encode(s, t, ["x", "y"], ["alpha", "one"]), t, ["x", "y"], ["alpha", "one"], D)
    return out.select("vec_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("alpha", "one")])


_K = f"exp(-0.5/({SIGMA}*{SIGMA})*((p.x-s.x)**2+(p.y-s.y)**2))"


@query(f"WITH {_S} SELECT p.vec_id, {s6(f'sum(s.alpha*{_K})')} AS alpha FROM p, s GROUP BY 1")
def field_exact(spark, d):
    s = _splats(spark, d)
    return E.exact(s.filter("vec_id % 20 = 0"), "vec_id", _shared(s.select("x", "y", "alpha")), ["x", "y"], ["alpha"], SIGMA).select("vec_id", r6("alpha").alias("alpha"))


@query(f"WITH {_S} SELECT p.vec_id, s.label, {s6(f'sum(s.alpha*{_K})')} AS score FROM p, s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY round(sum(s.alpha*{_K}), 9) DESC, s.label) = 1")
def what_is_at_exact(spark, d):
    s = _splats(spark, d)
    out = E.what_is_at_exact(s.filter("vec_id % 20 = 0"), "vec_id", _shared(s), ["x", "y"], "label", "alpha", SIGMA)
    return out.select("vec_id", "label", r6("score").alias("score"))


_LF = f"lf AS (SELECT j, sum(alpha*cos(w0*x+w1*y+{theta(D, 'label')})) AS re, sum(alpha*sin(w0*x+w1*y+{theta(D, 'label')})) AS im FROM s, w GROUP BY j)"


@query(
    f"""WITH {_S}, {_W}, {_LF}, k AS (SELECT label, j, {theta(D, 'label')} AS t FROM (SELECT DISTINCT label FROM s), {js(D)}),
q AS (SELECT vec_id, j, re*cos(w0*x+w1*y)+im*sin(w0*x+w1*y) AS re, im*cos(w0*x+w1*y)-re*sin(w0*x+w1*y) AS im FROM p, w JOIN lf USING (j)), c AS (SELECT vec_id, label, sum(re*cos(t)+im*sin(t))/{D} AS score FROM q JOIN k USING (j) GROUP BY ALL)
SELECT vec_id, label, round(score, 4) + 0.0 AS score FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1"""
)
def what_is_at(spark, d):
    s, t = _splats(spark, d), _table(spark)
    f = E.labelled(SPACE, s, t, ["x", "y"], "label", "alpha")
    out = E.what_is_at(SPACE, f, s.filter("vec_id % 20 = 0").select("vec_id", "x", "y"), "vec_id", t, ["x", "y"], s, "label")
    return out.select("vec_id", "label", (F.round("score", 4) + F.lit(0.0)).alias("score"))


@query(f"WITH {_S}, {_W}, {_LF}, l AS (SELECT j, re*cos({theta(D, chr(39) + '3' + chr(39))})+im*sin({theta(D, chr(39) + '3' + chr(39))}) AS re, im*cos({theta(D, chr(39) + '3' + chr(39))})-re*sin({theta(D, chr(39) + '3' + chr(39))}) AS im FROM lf) SELECT vec_id, round(sum(re*cos(w0*x+w1*y)+im*sin(w0*x+w1*y))/{D}, 4) + 0.0 AS score FROM p, w JOIN l USING (j) GROUP BY 1")
def where_is(spark, d):
    """The field of label 3, out of the bundle of all labels."""
    s, t = _splats(spark, d), _table(spark)
    f = E.labelled(SPACE, s, t, ["x", "y"], "label", "alpha")
    out = E.where_is(SPACE, f, "3", s.filter("vec_id % 20 = 0").select("vec_id", "x", "y"), "vec_id", t, ["x", "y"])
    return out.select("vec_id", (F.round("score", 4) + F.lit(0.0)).alias("score"))


@query(f"WITH {_S}, {_W}, {_LF} SELECT vec_id, round(sum(re*cos(w0*x+w1*y+{theta(D, 'label')}) + im*sin(w0*x+w1*y+{theta(D, 'label')})) / {D}, 4) + 0.0 AS score FROM p, w JOIN lf USING (j) GROUP BY vec_id")
def is_there(spark, d):
    """How much of its own label is at each asked point."""
    s, t = _splats(spark, d), _table(spark)
    f = E.labelled(SPACE, s, t, ["x", "y"], "label", "alpha")
    return E.is_there(SPACE, f, s.filter("vec_id % 20 = 0"), "vec_id", t, ["x", "y"], "label").select("vec_id", r4("score"))


_PAY = "y AS (SELECT vec_id, x, y, unnest(['kind', 'parity']) AS role, unnest(['kind' || label, 'parity' || (label % 2)]) AS filler FROM s)"
_RF = f"rf AS (SELECT j, sum(cos(w0*x+w1*y+{theta(D, 'role')}+{theta(D, 'filler')})) AS re, sum(sin(w0*x+w1*y+{theta(D, 'role')}+{theta(D, 'filler')})) AS im FROM y, w GROUP BY j)"


@query(
    f"""WITH {_S}, {_W}, {_PAY}, {_RF}, r AS (SELECT role, j, {theta(D, 'role')} AS t FROM (SELECT DISTINCT role FROM y), {js(D)}), k AS (SELECT filler AS label, j, {theta(D, 'filler')} AS t FROM (SELECT DISTINCT filler FROM y), {js(D)}),
q AS (SELECT vec_id, role, j, re*cos(w0*x+w1*y+r.t) + im*sin(w0*x+w1*y+r.t) AS re, im*cos(w0*x+w1*y+r.t) - re*sin(w0*x+w1*y+r.t) AS im FROM p, w JOIN rf USING (j) JOIN r USING (j)),
c AS (SELECT vec_id, role, label, sum(re*cos(t) + im*sin(t)) / {D} AS score FROM q JOIN k USING (j) GROUP BY ALL)
SELECT vec_id, role, label, round(score, 4) + 0.0 AS score FROM c QUALIFY row_number() OVER (PARTITION BY vec_id, role ORDER BY score DESC, label) = 1"""
)
def record_at(spark, d):
    """Records of two roles at every splat, asked for at points."""
    s, t = _splats(spark, d), _table(spark)
    roles = F.array(F.struct(F.lit("kind").alias("role"), F.concat(F.lit("kind"), "label").alias("filler")), F.struct(F.lit("parity").alias("role"), F.concat(F.lit("parity"), F.col("label") % 2).alias("filler")))
    pay = s.select("vec_id", F.explode(roles).alias("v")).select("vec_id", "v.*")
    f = E.record_field(SPACE, s, t, ["x", "y"], pay, "vec_id", "role", "filler")
    out = E.record_at(SPACE, f, s.filter("vec_id % 20 = 0").select("vec_id", "x", "y"), "vec_id", t, ["x", "y"], pay, "role", pay, "filler")
    return out.select("vec_id", "role", "label", r4("score"))


_BANDS = (0.3, 0.6)


def _wb(b: int, s: float) -> str:
    return f"SELECT {b} AS band, j, {gauss(f'{chr(39)}0|{D}|W{b}|{chr(39)} || j || {chr(39)}|0{chr(39)}')} / {s} AS w0, {gauss(f'{chr(39)}0|{D}|W{b}|{chr(39)} || j || {chr(39)}|1{chr(39)}')} / {s} AS w1 FROM {js(D)}"


@query(
    f"""WITH {_S}, wb AS ({' UNION ALL '.join(_wb(b, s) for b, s in enumerate(_BANDS))}), f AS (SELECT band, j, sum(alpha*cos(w0*x+w1*y)) AS re, sum(alpha*sin(w0*x+w1*y)) AS im FROM s JOIN wb ON band = label % 2 GROUP BY ALL)
SELECT vec_id, round(sum(re*cos(w0*x+w1*y) + im*sin(w0*x+w1*y)) / {D}, 4) + 0.0 AS alpha FROM p, wb JOIN f USING (band, j) GROUP BY vec_id"""
)
def field_by_band(spark, d):
    """Splats of two bands, each in its own frequencies; a point reads the sum."""
    s = _splats(spark, d).withColumn("band", F.col("label") % 2)
    t = E.band_tables(SPACE, spark, 2, _BANDS)
    out = E.decode_bands(s.filter("vec_id % 20 = 0").select("vec_id", "x", "y"), "vec_id", E.encode_by_band(s, t, ["x", "y"], ["alpha"]), t, ["x", "y"], ["alpha"], D)
    return out.select("vec_id", r4("alpha"))


@query(f"WITH {_S} SELECT p.vec_id, {', '.join(s6(f'sum(s.alpha*(s.label % 3 = {i})::INT*{_K})') + ' AS ' + c for i, c in enumerate('rgb'))} FROM p, s GROUP BY 1")
def colours_exact(spark, d):
    """Red, green and blue of the mixture, premultiplied."""
    s = E.colour_channels(_splats(spark, d).withColumns({c: (F.col("label") % 3 == i).cast("double") for i, c in enumerate("rgb")}), "alpha", "rgb")
    out = E.exact(s.filter("vec_id % 20 = 0"), "vec_id", _shared(s.select("x", "y", "r_a", "g_a", "b_a")), ["x", "y"], ["r_a", "g_a", "b_a"], SIGMA)
    return out.select("vec_id", *[r6(f"{c}_a").alias(c) for c in "rgb"])


@query(f"WITH {_S}, {_W}, f AS (SELECT j, {', '.join(f'sum(alpha*(label % 3 = {i})::INT*cos(w0*x+w1*y)) AS {c}re, sum(alpha*(label % 3 = {i})::INT*sin(w0*x+w1*y)) AS {c}im' for i, c in enumerate('rgb'))} FROM s, w GROUP BY j) SELECT vec_id, {', '.join(f'round(sum({c}re*cos(w0*x+w1*y) + {c}im*sin(w0*x+w1*y))/{D}, 4) + 0.0 AS {c}' for c in 'rgb')} FROM p, w JOIN f USING (j) GROUP BY vec_id")
def colours_bundle(spark, d):
    """Three channels on one table of frequencies, in one pass."""
    t = _table(spark)
    s = E.colour_channels(_splats(spark, d).withColumns({c: (F.col("label") % 3 == i).cast("double") for i, c in enumerate("rgb")}), "alpha", "rgb")
    names = ["r_a", "g_a", "b_a"]
    out = E.decode(s.filter("vec_id % 20 = 0").select("vec_id", "x", "y"), "vec_id", E.encode(s, t, ["x", "y"], names), t, ["x", "y"], names, D)
    return out.select("vec_id", *[(F.round(f"{c}_a", 4) + F.lit(0.0)).alias(c) for c in "rgb"])


@query(f"WITH {_S} SELECT p.vec_id, {s6(f'sum(s.alpha*{_K})')} AS alpha FROM p, s WHERE s.label = 3 GROUP BY 1")
def class_field_exact(spark, d):
    """The mixture of one label's splats."""
    s = _splats(spark, d)
    return E.exact(s.filter("vec_id % 20 = 0"), "vec_id", _shared(s.filter("label = 3").select("x", "y", "alpha")), ["x", "y"], ["alpha"], SIGMA).select("vec_id", r6("alpha").alias("alpha"))


_MW = f"m AS (SELECT j, {gauss(f'{chr(39)}0|{D}|mix|{chr(39)} || j || {chr(39)}|0{chr(39)}')} / CASE WHEN j % 2 = 0 THEN 0.3 ELSE 0.6 END AS w0, {gauss(f'{chr(39)}0|{D}|mix|{chr(39)} || j || {chr(39)}|1{chr(39)}')} / CASE WHEN j % 2 = 0 THEN 0.3 ELSE 0.6 END AS w1 FROM {js(D)})"
_IW = "iw AS (SELECT *, 1.0 / (39.47841760435743 * (0.5*0.09/6.283185307179586*exp(-0.5*0.09*(w0*w0+w1*w1)) + 0.5*0.36/6.283185307179586*exp(-0.5*0.36*(w0*w0+w1*w1)))) AS weight FROM m)"


@query(f"WITH {_MW}, {_IW} SELECT j, round(weight / (SELECT max(weight) FROM iw), 5) + 0.0 AS weight FROM iw")
def importance_weights(spark, d):
    """Weights of frequencies drawn from a mixture of two deviations, over the largest."""
    w = E.decode_weights(E.mixture_frequencies(SPACE, spark, 2, _BANDS), 2, _BANDS)
    return w.crossJoin(w.agg(F.max("weight").alias("top"))).select("j", (F.round(F.col("weight") / F.col("top"), 5) + F.lit(0.0)).alias("weight"))


@query(
    f"""WITH {_S}, {_MW}, {_IW}, f AS (SELECT j, sum(alpha*6.283185307179586*0.09*exp(-0.5*0.09*(w0*w0+w1*w1))*cos(w0*x+w1*y)) AS re, sum(-alpha*6.283185307179586*0.09*exp(-0.5*0.09*(w0*w0+w1*w1))*sin(w0*x+w1*y)) AS im FROM s, m GROUP BY j)
SELECT vec_id, round(sum(weight*(re*cos(w0*x+w1*y) - im*sin(w0*x+w1*y)))/{D}, 3) + 0.0 AS value FROM p, iw JOIN f USING (j) GROUP BY vec_id"""
)
def spectral_read(spark, d):
    """A spectral bundle over a mixture's frequencies, read with their importance weights."""
    t = E.mixture_frequencies(SPACE, spark, 2, _BANDS)
    s = _splats(spark, d).withColumns({"c00": F.lit(0.09), "c01": F.lit(0.0), "c11": F.lit(0.09)})
    f = E.spectral(s, t, ["x", "y"], [["c00", "c01"], ["c11"]], ["alpha"]).withColumnsRenamed({"alpha_re": "re", "alpha_im": "im"})
    out = E.weighted_read(s.filter("vec_id % 20 = 0").select("vec_id", "x", "y"), "vec_id", f, t, E.decode_weights(t, 2, _BANDS), ["x", "y"], D)
    return out.select("vec_id", (F.round("value", 3) + F.lit(0.0)).alias("value"))


@query(f"WITH {_S}, {_W} SELECT j, round(sum(alpha*cos(w0*(x+0.5)+w1*(y-0.25))), 4) + 0.0 AS re, round(sum(alpha*sin(w0*(x+0.5)+w1*(y-0.25))), 4) + 0.0 AS im FROM s, w GROUP BY j")
def field_translate(spark, d):
    """Moving the bundle is moving the splats."""
    t = _table(spark)
    f = E.encode(_splats(spark, d), t, ["x", "y"], ["alpha"]).withColumnsRenamed({"alpha_re": "re", "alpha_im": "im"})
    return E.translate(f, t, [0.5, -0.25]).select("j", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("re", "im")])


def _cov(spark, d):
    return _splats(spark, d).withColumns({"c00": F.lit(0.04) + F.col("label") * 0.01, "c01": F.lit(0.01), "c11": F.lit(0.05)})


@query(f"WITH {_S}, {_W} SELECT j, round(sum(alpha*6.283185307179586*sqrt((0.04+label*0.01)*0.05-0.0001)*exp(-0.5*((0.04+label*0.01)*w0*w0+2*0.01*w0*w1+0.05*w1*w1))*cos(w0*x+w1*y)), 4) + 0.0 AS re FROM s, w GROUP BY j")
def spectral_bundle(spark, d):
    out = E.spectral(_cov(spark, d), _table(spark), ["x", "y"], [["c00", "c01"], ["c11"]], ["alpha"])
    return out.select("j", (F.round("alpha_re", 4) + F.lit(0.0)).alias("re"))


@query(f"WITH {_S} SELECT p.vec_id, {s6('sum(s.alpha*exp(-0.5*(0.05*(p.x-s.x)**2-2*0.01*(p.x-s.x)*(p.y-s.y)+(0.04+s.label*0.01)*(p.y-s.y)**2)/((0.04+s.label*0.01)*0.05-0.0001)))')} AS value FROM p, s GROUP BY 1")
def field_anisotropic(spark, d):
    s = _cov(spark, d)
    out = E.exact_anisotropic(s.filter("vec_id % 20 = 0").select("vec_id", "x", "y"), "vec_id", _shared(s.drop("vec_id")), ["x", "y"], [["c00", "c01"], ["c11"]], "alpha")
    return out.select("vec_id", r6("value").alias("value"))


@query(f"WITH {_S} SELECT p.vec_id, {s6(f'sum(s.alpha*{SIGMA}*sqrt(6.283185307179586)*{_K})')} AS value FROM p, s GROUP BY 1")
def xray_exact(spark, d):
    s = _splats(spark, d)
    return E.xray(s.filter("vec_id % 20 = 0"), "vec_id", _shared(s.select("x", "y", "alpha")), ["x", "y"], SIGMA, "alpha").select("vec_id", r6("value").alias("value"))


@query(f"SELECT t, {s6('sum(exp(-0.5/(25.0)*(t-h)*(t-h))*value)/sum(exp(-0.5/(25.0)*(t-h)*(t-h)))')} AS value FROM (SELECT (day(ts) % 2) * 24 + hour(ts) + minute(ts) / 60.0::DOUBLE AS h, value FROM events), (SELECT unnest([0.0, 12.0, 24.0, 36.0]::DOUBLE[]) AS t) GROUP BY t")
def kernel_as_of(spark, d):
    h = F.pmod(F.dayofmonth("ts"), F.lit(2)) * 24 + F.hour("ts") + F.minute("ts") / 60.0
    e = load(spark, d, "events").select(h.cast("double").alias("h"), "value")
    asked = spark.createDataFrame([(0.0,), (12.0,), (24.0,), (36.0,)], "t double")
    return E.kernel_as_of(e, "h", "value", asked, "t", 5.0).select("t", r6("value").alias("value"))


def _rules(spark, d):
    return load(spark, d, "benchmark").select(F.col("item_id").alias("rule"), F.col("text").alias("condition"), F.concat(F.lit("act"), F.col("item_id") % 5).alias("action"))


def _inputs(spark, d):
    """Whole texts of all documents."""
    return load(spark, d, "documents").select("doc_id", "text")


def _grams_of(name: str, key: str, text: str, table: str) -> str:
    return f"{name} AS (SELECT {key}, substr(t, i, 3) AS gram, count(*) AS n FROM (SELECT {key}, t, unnest(range(1, len(t) - 1)) AS i FROM (SELECT {key}, regexp_replace(lower({text}), '[^a-z ]', '', 'g') AS t FROM {table}) WHERE len(t) >= 3) GROUP BY ALL)"


_L = [theta(D, f"substr(gram, {i + 1}, 1)", f"((j+{2 - i})%{D})") for i in range(3)]
_PROFILES = f"""{_grams_of('ga', 'doc_id', 'text', 'documents')}, {_grams_of('gb', 'item_id', 'text', 'benchmark')},
gc AS (SELECT gram, j, {_L[0]} + {_L[1]} + {_L[2]} AS t FROM (SELECT gram FROM ga UNION SELECT gram FROM gb), {js(D)}),
pa AS (SELECT doc_id, j, sum(n*cos(t)) AS re, sum(n*sin(t)) AS im FROM ga JOIN gc USING (gram) GROUP BY ALL), pb AS (SELECT item_id, j, sum(n*cos(t)) AS re, sum(n*sin(t)) AS im FROM gb JOIN gc USING (gram) GROUP BY ALL),
q AS (SELECT doc_id, j, re / nn AS re, im / nn AS im FROM (SELECT *, greatest(sqrt(sum(re*re+im*im) OVER (PARTITION BY doc_id)), 1e-9) AS nn FROM pa)),
r AS (SELECT item_id AS rule, 'act' || (item_id % 5) AS action, item_id % 8 AS band, j, re / nn AS re, im / nn AS im FROM (SELECT *, greatest(sqrt(sum(re*re+im*im) OVER (PARTITION BY item_id)), 1e-9) AS nn FROM pb))"""
_TA = theta(D, "action")


@query(f"WITH {_PROFILES}, s AS (SELECT doc_id, rule, any_value(action) AS action, sum(q.re*r.re + q.im*r.im) AS score FROM q JOIN r USING (j) GROUP BY doc_id, rule) SELECT doc_id, rule, CASE WHEN score >= 0.1 THEN action END AS action, {s6('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, rule) = 1")
def route_matrix(spark, d):
    """Each document's nearest text of the benchmark, and the action of that rule."""
    return R.dispatch_matrix(SPACE, _rules(spark, d), _inputs(spark, d), "doc_id", 0.1).withColumn("score", r6("score"))


_MEM = "{name} AS (SELECT {by}j, sum(re*cos(ta) - im*sin(ta)) AS re, sum(re*sin(ta) + im*cos(ta)) AS im FROM (SELECT *, " + _TA + " AS ta FROM r) GROUP BY {by}j)"
_ACTS = f"k AS (SELECT action AS label, j, {_TA} AS t FROM (SELECT DISTINCT action FROM r), {js(D)})"


@query(
    f"""WITH {_PROFILES}, {_MEM.format(name='m', by='')}, {_ACTS}, c AS (SELECT doc_id, label, sum((m.re*q.re+m.im*q.im)*cos(k.t) + (m.im*q.re-m.re*q.im)*sin(k.t)) / {D} AS score FROM q JOIN m USING (j) JOIN k USING (j) GROUP BY ALL)
SELECT doc_id, CASE WHEN score >= 0.0 THEN label END AS action, {s6('score')} AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1"""
)
def route_bundle(spark, d):
    rules = _rules(spark, d)
    return R.dispatch_bundle(SPACE, R.rule_bundle(SPACE, rules), rules, _inputs(spark, d), "doc_id", 0.0).withColumn("score", r6("score"))


@query(
    f"""WITH {_PROFILES}, {_MEM.format(name='m', by='band, ')}, {_ACTS}, ce AS (SELECT band, j, avg(re) AS re, avg(im) AS im FROM r GROUP BY ALL),
near AS (SELECT doc_id, band FROM (SELECT doc_id, band, sum(q.re*ce.re + q.im*ce.im) / {D} AS s FROM q JOIN ce USING (j) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(s), 9) DESC, band) <= 2),
c AS (SELECT doc_id, band, label, sum((m.re*q.re+m.im*q.im)*cos(k.t) + (m.im*q.re-m.re*q.im)*sin(k.t)) / {D} AS score FROM near JOIN q USING (doc_id) JOIN m USING (band, j) JOIN k USING (j) GROUP BY ALL),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, band ORDER BY score DESC, label) = 1)
SELECT doc_id, band, label AS action, {s6('score')} AS score FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, band) = 1"""
)
def route_banded(spark, d):
    return R.dispatch_banded(SPACE, R.banded(_rules(spark, d), 8), _inputs(spark, d), "doc_id", 2).withColumn("score", r6("score"))


@query()
def route_clustered(spark, d):
    return R.dispatch_banded(SPACE, R.clustered(SPACE, _rules(spark, d), 4), _inputs(spark, d), "doc_id", 1).withColumn("score", r6("score"))


def _book(space, df, c):
    """(labels, codewords) of a book; it goes to every task, so it must be small."""
    rows = space.expand(df.select(c).distinct()).groupBy(c).agg(F.array_sort(F.collect_list(F.struct("j", space.theta(F.col(c).cast("string"), F.col("j")).alias("t")))).alias("v"))
    if df.select(c).distinct().count() * space.dim * 16 > BROADCAST:
        raise ValueError("the book is too large to go to every task")
    got = sorted(rows.collect())
    return [r[0] for r in got], np.exp(1j * np.array([[x["t"] for x in r[1]] for r in got]))


def _packed(df, keys):
    """Angles or components (j, re, im) as arrays."""
    v = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", "re", "im"))).alias("v"))
    return v.select(*keys, F.transform("v", lambda x: x["re"]).alias("re"), F.transform("v", lambda x: x["im"]).alias("im"))


def _named(df, *books):
    """Indices of the factors as names."""
    lists = [F.array(*[F.lit(x) for x in b]) for b in books]
    return [F.element_at(b, F.col("indices")[i] + 1) for i, b in enumerate(lists)]


@query("SELECT n_name, n_name AS nation, r_name AS region, true AS converged, 1.0 AS amplitude FROM nation JOIN region ON n_regionkey = r_regionkey")
def resonator_factor(spark, d):
    """Nation and region codewords bound together, taken apart by the resonator."""
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    space = Space(1024)
    (nations, a), (regions, b) = _book(space, n, "n_name"), _book(space, r, "r_name")
    pairs = space.expand(n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name"))
    t = space.theta(F.col("n_name"), F.col("j")) + space.theta(F.col("r_name"), F.col("j"))
    packed = _packed(pairs.select("n_name", "j", F.cos(t).alias("re"), F.sin(t).alias("im")), ["n_name"])
    nation, region = _named(None, nations, regions)
    return K.factor_signals(packed, "n_name", [a, b]).select("n_name", nation.alias("nation"), region.alias("region"), "converged", r6("score").alias("amplitude"))


@query("SELECT r_regionkey AS scene, k, 'NATION_' || r_regionkey AS what, (r_regionkey * 2 + k * 5) % 8 AS col, (r_regionkey + k * 3) % 8 AS line FROM region, (SELECT unnest([0, 1])::INT AS k) WHERE k = 0")
def what_is_where(spark, d):
    """Which object is in a scene and where on a grid of 8 x 8: one codeword and two axes, found together."""
    space, side = Space(1024), 8
    n = load(spark, d, "nation")
    names, codes = _book(space, n, "n_name")
    w = np.array([[r.w0, r.w1] for r in sorted(space.frequencies(spark, 2, 0.15, "G").collect())])
    axes = [K.grid_codebook(w[:, k], np.linspace(-1, 1, side)) for k in range(2)]
    scenes = []
    for r in load(spark, d, "region").collect():  # a scene for each region
        k = int(r.r_regionkey)
        v = codes[names.index(f"NATION_{k}")] * axes[0][(k * 2) % side] * axes[1][k % side]
        scenes.append((k, v.real.tolist(), v.imag.tolist()))
    packed = spark.createDataFrame(scenes, "scene int, re array<double>, im array<double>")
    out = K.factor_signals(packed, "scene", [codes, *axes]).filter("converged")
    return out.select("scene", "k", _named(None, names)[0].alias("what"), F.col("indices")[1].alias("col"), F.col("indices")[2].alias("line"))


def _ridge_sql() -> str:
    """Three features by Cramer's rule on centred sums; the penalty is 1e-3."""
    x = ["l_quantity", "l_discount", "l_tax"]
    sums = ", ".join([f"sum(({x[i]}-m{i})*({x[j]}-m{j})){' + 1e-3' if i == j else ''} AS s{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(({x[i]}-m{i})*(l_extendedprice-my)) AS b{i}" for i in range(3)])
    at = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    det = lambda c: "(" + " + ".join(f"{c[0][k]}*({c[1][(k + 1) % 3]}*{c[2][(k + 2) % 3]}-{c[1][(k + 2) % 3]}*{c[2][(k + 1) % 3]})" for k in range(3)) + ")"
    whole = [[at(i, j) for j in range(3)] for i in range(3)]
    w = [f"{det([[f'b{i}' if j == k else at(i, j) for j in range(3)] for i in range(3)])}/{det(whole)}" for k in range(3)]
    return f"""WITH m AS (SELECT {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(x))}, avg(l_extendedprice) AS my FROM lineitem), s AS (SELECT {sums}, any_value(m0) AS m0, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my FROM lineitem, m),
w AS (SELECT {', '.join(f'{e} AS w{i}' for i, e in enumerate(w))}, m0, m1, m2, my FROM s) SELECT unnest(['quantity', 'discount', 'tax', 'intercept']) AS feature, round(unnest([w0, w1, w2, my - w0*m0 - w1*m1 - w2*m2]), 3) + 0.0 AS weight FROM w"""


@query(_ridge_sql())
def ridge_fit(spark, d):
    """Price by quantity, discount and tax."""
    li = load(spark, d, "lineitem")
    w = K.ridge(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1e-3)
    return spark.createDataFrame([(n, round(float(x), 3) + 0.0) for n, x in zip(["quantity", "discount", "tax", "intercept"], w)], "feature string, weight double")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) + 0.0 AS slope FROM lineitem GROUP BY 1")
def ridge_by_group(spark, d):
    out = K.ridge_by_group(load(spark, d, "lineitem"), "l_returnflag", ["l_quantity"], "l_extendedprice", 0.0)
    return out.select("l_returnflag", (F.round(F.col("weights")[0], 3) + F.lit(0.0)).alias("slope"))


_RD, _LAM = 16, 1e-3


@query(f"SELECT unnest(range({2 * _RD + 1}))::INT AS feature, 0.0 AS gradient")
def field_fit(spark, d):
    """A field of two axes fitted to the third: the penalised square has no slope at the fit, in any feature."""
    space = Space(_RD)
    s = load(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    t = space.frequencies(spark, 2, 0.2, "fit")
    theta, _ = G.fit(s, ["x", "y"], ["z"], t, _LAM)
    return G.gradient(s, ["x", "y"], "z", t, theta[:, 0], _LAM, _RD).withColumn("gradient", F.round("gradient", 7) + F.lit(0.0))


@query("SELECT vec_id, true AS close FROM embeddings WHERE vec_id % 20 = 0")
def field_fit_read(spark, d):
    """A smooth function of two axes is given back by the fitted field at the stated points."""
    space = Space(64)
    s = _splats(spark, d).withColumn("f", F.cos(F.col("x") * 3) + F.col("y"))
    t = space.frequencies(spark, 2, 0.3, "fit")
    _, f = G.fit(s, ["x", "y"], ["f"], t, 1e-6)
    asked = s.filter("vec_id % 20 = 0")
    got = G.evaluate(asked, "vec_id", f, t, ["x", "y"], ["f"], 64)
    return asked.select("vec_id", F.col("f").alias("truth")).join(got, "vec_id").select("vec_id", (F.abs(F.col("f") - F.col("truth")) < 0.02).alias("close"))


@query(f"SELECT l_returnflag, count(*) AS n, round((sum(l_quantity * l_extendedprice) / (sum(l_quantity * l_quantity) + 0.5 * count(*))), 4) + 0.0 AS free, round(((sum(l_quantity * l_extendedprice) + 0.5 * count(*) * 100) / (sum(l_quantity * l_quantity) + 0.5 * count(*))), 4) + 0.0 AS towards FROM lineitem GROUP BY l_returnflag")
def cell_fit(spark, d):
    """Each cell's slope through the origin, towards 0 and towards a prior of 100."""
    li = load(spark, d, "lineitem")
    x, y = [F.col("l_quantity")], F.col("l_extendedprice")
    prior = li.select("l_returnflag").distinct().withColumn("prior", F.array(F.lit(100.0)))
    free, towards = G.fit_by_cell(li, ["l_returnflag"], x, y, 0.5), G.fit_by_cell(li, ["l_returnflag"], x, y, 0.5, prior)
    at = lambda c: F.round(F.col(c)[0], 4) + F.lit(0.0)
    return free.join(towards.select("l_returnflag", F.col("weights").alias("_t")), "l_returnflag").select("l_returnflag", "n", at("weights").alias("free"), at("_t").alias("towards"))


# views

_VIEW, _RES, _HALF = (1.0, 2.0, 2.0), 12, 0.4
_V, _U1, _U2 = V.camera(_VIEW)
_S3 = "s AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (label+1)::DOUBLE AS alpha FROM embeddings)"
_PX = f"g AS (SELECT i::INT AS pixel, {-_HALF}::DOUBLE + (i % {_RES}) * {2 * _HALF / (_RES - 1)}::DOUBLE AS u, {-_HALF}::DOUBLE + (i // {_RES}) * {2 * _HALF / (_RES - 1)}::DOUBLE AS v FROM (SELECT unnest(range({_RES * _RES})) AS i)), px AS (SELECT *, {', '.join(f'u*{_U1[k]!r} + v*{_U2[k]!r} AS {a}'.replace('np.float64(', '(') for k, a in enumerate('xyz'))} FROM g)"
_W3 = f"w AS (SELECT j, {', '.join(gauss(f'{chr(39)}0|{D}|W|{chr(39)} || j || {chr(39)}|{k}{chr(39)}') + f' / {SIGMA} AS w{k}' for k in range(3))} FROM {js(D)})"
_A = "(" + " + ".join(f"w{k}*{float(_V[k])!r}" for k in range(3)) + ")"
_GAIN = f"(CASE WHEN abs({_A}) < 1e-9 THEN 3.0 ELSE 2.0*sin({_A}*1.5)/{_A} END)"
_WP = "w0*px.x+w1*px.y+w2*px.z"


def _splats3(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], (F.col("label") + 1).cast("double").alias("alpha"))


@query(f"WITH {_PX} SELECT pixel, {', '.join(s6(c) + ' AS ' + c for c in 'uvxyz')} FROM px")
def pixel_grid(spark, d):
    """The image plane of a view, with the camera's axes."""
    return V.pixels(spark, _VIEW, (0, 0, 0), _HALF, _RES).select("pixel", *[r6(c).alias(c) for c in "uvxyz"])


@query(
    f"""WITH {_S3}, {_PX}, {_W3}, f AS (SELECT j, sum(alpha*cos(w0*x+w1*y+w2*z)) AS re, sum(alpha*sin(w0*x+w1*y+w2*z)) AS im FROM s, w GROUP BY j)
SELECT pixel, round(sum({_GAIN}*(re*cos({_WP})+im*sin({_WP})))/{D}, 4) + 0.0 AS value FROM px, w JOIN f USING (j) GROUP BY pixel"""
)
def render_orthographic(spark, d):
    """A bundle of three axes seen from one side: rays of length 3."""
    t = SPACE.frequencies(spark, 3, SIGMA)
    f = E.encode(_splats3(spark, d), t, ["x", "y", "z"], ["alpha"]).withColumnsRenamed({"alpha_re": "value_re", "alpha_im": "value_im"})
    return V.orthographic(SPACE, f, t, _VIEW, (0, 0, 0), _HALF, _RES, 3.0).select("pixel", (F.round("value", 4) + F.lit(0.0)).alias("value"))


_SIZE, _REACH = 0.25, 0.3
_COV = ["(0.02+label*0.001)", "0.004", "0.0", "0.03", "0.002", "0.01"]


def _xray_sql() -> str:
    at = lambda i, j: _COV[{(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4, (2, 2): 5}[min(i, j), max(i, j)]]
    minor = lambda i, j: f"({at((i + 1) % 3, (j + 1) % 3)}*{at((i + 2) % 3, (j + 2) % 3)} - {at((i + 1) % 3, (j + 2) % 3)}*{at((i + 2) % 3, (j + 1) % 3)})"
    det = "(" + " + ".join(f"{at(0, k)}*{minor(0, k)}" for k in range(3)) + ")"
    inv = ", ".join(f"{minor(j, i)}/{det} AS i{i}{j}" for i in range(3) for j in range(i, 3))
    iv = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    along = [" + ".join(f"{iv(i, j)}*{float(_V[j])!r}" for j in range(3)) for i in range(3)]
    uv = lambda axis: " + ".join(f"(floor({a}/{_SIZE})+0.5)*{_SIZE}*{float(k)!r}" for a, k in zip("xyz", axis))
    d = [f"(px.{a}-m.{a})" for a in "xyz"]
    form = " + ".join(f"{1 if i == j else 2}*({iv(i, j)} - a{i}*a{j}/q)*{d[i]}*{d[j]}" for i in range(3) for j in range(i, 3))
    return f"""WITH {_S3}, {_PX}, c AS (SELECT *, {inv}, {uv(_U1)} AS cu, {uv(_U2)} AS cv FROM s), n AS (SELECT *, {', '.join(f'{x} AS a{i}' for i, x in enumerate(along))} FROM c), m AS (SELECT *, {' + '.join(f'a{i}*{float(_V[i])!r}' for i in range(3))} AS q FROM n)
SELECT pixel, round(coalesce(sum(CASE WHEN m.vec_id IS NOT NULL THEN alpha*sqrt(6.283185307179586/q)*exp(-0.5*({form})) END), 0), 5) + 0.0 AS value FROM px LEFT JOIN m ON (u-cu)*(u-cu)+(v-cv)*(v-cv) <= {(3**0.5 / 2 * _SIZE + _REACH) ** 2!r} GROUP BY pixel"""


@query(_xray_sql())
def xray_anisotropic(spark, d):
    """Line integrals of splats with covariances of their own, over the cells near each pixel's ray."""
    names = ["c00", "c01", "c02", "c11", "c12", "c22"]
    s = _splats3(spark, d).withColumns({n: F.expr(c).cast("double") for n, c in zip(names, _COV)}).drop("vec_id")
    out = V.exact_xray(V.pixels(spark, _VIEW, (0, 0, 0), _HALF, _RES), s, names, "alpha", _VIEW, _SIZE, _REACH)
    return out.select("pixel", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query(
    f"""WITH {_S3}, {_PX}, {_W3}, c AS (SELECT *, floor(x/{_SIZE}) AS ci, floor(y/{_SIZE}) AS cj, floor(z/{_SIZE}) AS ck FROM s), f AS (SELECT ci, cj, ck, j, sum(alpha*cos(w0*x+w1*y+w2*z)) AS re, sum(alpha*sin(w0*x+w1*y+w2*z)) AS im FROM c, w GROUP BY ALL),
k AS (SELECT DISTINCT ci, cj, ck, {' + '.join(f'(c{n}+0.5)*{_SIZE}*{float(x)!r}' for n, x in zip('ijk', _U1))} AS cu, {' + '.join(f'(c{n}+0.5)*{_SIZE}*{float(x)!r}' for n, x in zip('ijk', _U2))} AS cv FROM f),
n AS (SELECT px.*, ci, cj, ck FROM px JOIN k ON (u-cu)*(u-cu)+(v-cv)*(v-cv) <= {(3**0.5 / 2 * _SIZE + _REACH) ** 2!r})
SELECT px.pixel, round(sum({_GAIN}*(re*cos({_WP})+im*sin({_WP})))/{D}, 4) + 0.0 AS value FROM n px JOIN f USING (ci, cj, ck) JOIN w USING (j) GROUP BY px.pixel"""
)
def xray_masked(spark, d):
    """The same view from cell fields, each pixel reading the cells near its ray."""
    t = SPACE.frequencies(spark, 3, SIGMA)
    f = E.cell_fields(_splats3(spark, d), t, ["x", "y", "z"], _SIZE, ["alpha"])
    out = V.masked_xray(SPACE, V.pixels(spark, _VIEW, (0, 0, 0), _HALF, _RES), f, t, "alpha", _VIEW, 3.0, _SIZE, _REACH)
    return out.filter("value <> 0").select("pixel", (F.round("value", 4) + F.lit(0.0)).alias("value"))


_CAPS = [0.1, 0.3, 0.6]


@query(f"WITH s AS (SELECT vec_id, label, (label+1)*0.05::DOUBLE AS scale FROM embeddings), b AS (SELECT *, sqrt(scale*scale + 0.09/12) AS wide FROM s) SELECT vec_id, {s6('wide')} AS scale, CASE {' '.join(f'WHEN scale <= {c} THEN {i}' for i, c in enumerate(_CAPS))} END AS band, CASE {' '.join(f'WHEN wide <= sqrt({c}*{c} + 0.09/12) THEN {i}' for i, c in enumerate(_CAPS))} END AS matched FROM b")
def matched_bands(spark, d):
    """Scales and caps grown by a pixel: every splat keeps its band."""
    from phasorlake.operators.scenes import band_of

    s = load(spark, d, "embeddings").select("vec_id", ((F.col("label") + 1) * F.lit(0.05)).alias("scale"))
    s = s.withColumn("band", band_of(F.col("scale"), _CAPS))
    wide, caps = V.matched(s, "scale", _CAPS, 0.3)
    return wide.select("vec_id", r6("scale").alias("scale"), "band", band_of(F.col("scale"), caps).alias("matched"))


def _bk(b: int, cap: float) -> str:
    sig = [0.05 * (cap / 0.05) ** (i / 2) for i in range(3)]
    w = [gauss(f"'0|{D}|book{b}|' || j || '|{k}'") for k in range(2)]
    return f"SELECT {b} AS band, j, {', '.join(f'{x} * ([{1.0 / sig[0]!r}, {1.0 / sig[1]!r}, {1.0 / sig[2]!r}]::DOUBLE[])[j % 3 + 1] AS w{k}' for k, x in enumerate(w))} FROM {js(D)}"


@query(
    f"""WITH s AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (label+1)::DOUBLE AS alpha, (label+1)*0.05::DOUBLE AS scale FROM embeddings), k AS ({' UNION ALL '.join(_bk(b, c) for b, c in enumerate(_CAPS))}),
b AS (SELECT *, CASE {' '.join(f'WHEN scale <= {c} THEN {i}' for i, c in enumerate(_CAPS))} END AS band FROM s), c AS (SELECT *, floor(x / ([0.2, 0.4, 0.8]::DOUBLE[])[band + 1])::BIGINT AS ci, floor(y / ([0.2, 0.4, 0.8]::DOUBLE[])[band + 1])::BIGINT AS cj FROM b),
f AS (SELECT band, ci, cj, j, sum(alpha*cos(w0*x+w1*y)) AS re, sum(alpha*sin(w0*x+w1*y)) AS im FROM c JOIN k USING (band) GROUP BY ALL) SELECT band, ci, cj, round(sum(re*re+im*im)/{D}, 3) + 0.0 AS power FROM f GROUP BY ALL"""
)
def encode_bands(spark, d):
    """The power of each band's cell fields, each band with its own frequencies and cell size."""
    s = _splats(spark, d).withColumn("scale", (F.col("label") + 1) * F.lit(0.05))
    f = V.encode_bands(s, V.band_books(SPACE, spark, 2, 0.05, _CAPS), ["x", "y"], "scale", _CAPS, [0.2, 0.4, 0.8], ["alpha"])
    power = F.sum(F.col("alpha_re") * F.col("alpha_re") + F.col("alpha_im") * F.col("alpha_im")) / D
    return f.groupBy("band", "ci", "cj").agg((F.round(power, 3) + F.lit(0.0)).alias("power"))
