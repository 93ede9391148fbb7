"""Queries over codewords, maps, filters, records, sequences, graphs, automata."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasorlake import space as V
from phasorlake.operators import structures as S
from phasorlake.queries.registry import js, load, query, r6, s6, theta, u
from phasorlake.space import Space

D = 256
SPACE = Space(D)


def _nations(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name"), r.select("r_name")


@query(f"SELECT n_name AS label, j, {s6('cos(' + theta(D, 'n_name') + ')')} AS re, {s6('sin(' + theta(D, 'n_name') + ')')} AS im FROM nation, {js(D)}")
def codewords(spark, d):
    return SPACE.codewords(load(spark, d, "nation").select(F.col("n_name").alias("label"))).select("label", "j", r6("re").alias("re"), r6("im").alias("im"))


@query(
    f"""WITH v AS (SELECT r_name AS label, j, cos({theta(D, 'r_name')}) AS re, sin({theta(D, 'r_name')}) AS im FROM region, {js(D)}),
b AS (SELECT j, sum(re) AS re, sum(im) AS im FROM v GROUP BY j),
n AS (SELECT j, re / CASE WHEN sqrt(re*re+im*im) = 0 THEN 1 ELSE sqrt(re*re+im*im) END AS re, im / CASE WHEN sqrt(re*re+im*im) = 0 THEN 1 ELSE sqrt(re*re+im*im) END AS im FROM b)
SELECT v.label, {s6(f'sum(n.re*v.re + n.im*v.im) / {D}')} AS score,
{s6('sum(n.re*v.re + n.im*v.im) / (sqrt(sum(n.re*n.re+n.im*n.im)) * sqrt(sum(v.re*v.re+v.im*v.im)))')} AS cos FROM n JOIN v USING (j) GROUP BY v.label"""
)
def bundle_similarity(spark, d):
    rows = load(spark, d, "region").select(F.col("r_name").alias("label"))
    b = V.normalize(V.bundle(SPACE.codewords(rows), []))
    book = V.codebook(SPACE, rows)
    out = V.similarity(b, book, ["label"], D).join(V.cosine(b, book, ["label"]), "label")
    return out.select("label", r6("score").alias("score"), r6("cos").alias("cos"))


@query(
    f"""WITH v AS (SELECT r_name AS label, j, {theta(D, 'r_name')} AS t, {theta(D, 'r_name', f'(j + 3) % {D}')} AS t3 FROM region, {js(D)})
SELECT a.label, {s6('avg(cos(a.t3 - a.t))')} AS shifted, {s6('avg(cos((a.t + b.t) - b.t - a.t))')} AS inverted FROM v a JOIN v b ON a.j = b.j AND b.label = 'ASIA' GROUP BY a.label"""
)
def shift_and_inverse(spark, d):
    """A shifted codeword is like a new one; unbinding undoes binding."""
    v = SPACE.codewords(load(spark, d, "region").select(F.col("r_name").alias("label")))
    moved = V.shift(v, 3, D).withColumnsRenamed({"re": "bre", "im": "bim"})
    asia = v.filter("label = 'ASIA'").select("j", F.col("re").alias("kre"), F.col("im").alias("kim"))
    k = v.join(asia, "j")
    re, im = V.bind(V.pair(), V.pair("kre", "kim"))
    k = k.withColumns({"_re": re, "_im": im})
    re, im = V.unbind(V.pair("_re", "_im"), V.pair("kre", "kim"))
    inv = k.select("label", "j", V.F.col("re"), "im", re.alias("bre"), im.alias("bim"))
    a = v.join(moved, ["label", "j"]).groupBy("label").agg(r6(F.sum(F.col("re") * F.col("bre") + F.col("im") * F.col("bim")) / D).alias("shifted"))
    b = inv.groupBy("label").agg(r6(F.sum(F.col("re") * F.col("bre") + F.col("im") * F.col("bim")) / D).alias("inverted"))
    return a.join(b, "label")


_MAP = f"""m AS (SELECT j, sum(w * cos({theta(D, 'n_name')} + {theta(D, 'r_name')})) AS re, sum(w * sin({theta(D, 'n_name')} + {theta(D, 'r_name')})) AS im FROM p, {js(D)} GROUP BY j),
q AS (SELECT n_name, j, m.re*cos(t) + m.im*sin(t) AS re, m.im*cos(t) - m.re*sin(t) AS im FROM (SELECT n_name, j, {theta(D, 'n_name')} AS t FROM nation, {js(D)}) JOIN m USING (j)),
b AS (SELECT r_name AS label, j, {theta(D, 'r_name')} AS t FROM region, {js(D)}),
s AS (SELECT n_name, label, sum(q.re*cos(b.t) + q.im*sin(b.t)) / {D} AS score FROM q JOIN b USING (j) GROUP BY ALL)"""
_BEST = f"SELECT n_name, label, {s6('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY score DESC, label) = 1"


@query(f"WITH p AS (SELECT n_name, r_name, 1.0 AS w FROM nation JOIN region ON n_regionkey = r_regionkey), {_MAP} {_BEST}")
def map_get(spark, d):
    """All nations' regions in one vector, read back by name."""
    pairs, regions = _nations(spark, d)
    out = S.map_get(SPACE, S.map_bundle(SPACE, pairs, "n_name", "r_name"), pairs, "n_name", regions, "r_name")
    return out.select("n_name", "label", r6("score").alias("score"))


@query("SELECT n_name, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def map_get_exact(spark, d):
    return _nations(spark, d)[0].withColumnRenamed("r_name", "label")


@query(f"WITH p AS (SELECT n_name, r_name, 1.0 - (n_name < 'F')::INT AS w FROM nation JOIN region ON n_regionkey = r_regionkey), {_MAP} {_BEST}")
def map_delete(spark, d):
    """Names before F are put, then taken away: their score falls to noise."""
    pairs, regions = _nations(spark, d)
    log = pairs.withColumn("w", F.lit(1.0)).unionByName(pairs.filter("n_name < 'F'").withColumn("w", F.lit(-1.0)))
    out = S.map_get(SPACE, S.map_bundle(SPACE, log, "n_name", "r_name", F.col("w")), pairs, "n_name", regions, "r_name")
    return out.select("n_name", "label", r6("score").alias("score"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def membership_semi(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query(
    f"""WITH m AS (SELECT j, sum(cos({theta(D, 'n_name')})) AS re, sum(sin({theta(D, 'n_name')})) AS im FROM (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')), {js(D)} GROUP BY j),
b AS (SELECT n_name, j, {theta(D, 'n_name')} AS t FROM nation, {js(D)})
SELECT n_name, {s6(f'sum(re*cos(t) + im*sin(t)) / {D}')} AS score, sum(re*cos(t) + im*sin(t)) / {D} >= 0.5 AS member FROM m JOIN b USING (j) GROUP BY n_name"""
)
def membership_score(spark, d):
    """Members are the nations of two regions, probes all nations."""
    pairs, _ = _nations(spark, d)
    out = S.set_scores(SPACE, S.set_bundle(SPACE, pairs.filter("r_name IN ('ASIA', 'EUROPE')"), "n_name"), pairs, "n_name")
    return out.select("n_name", r6("score").alias("score"), (F.col("score") >= 0.5).alias("member"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def frequency_exact(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type),
v AS (SELECT event_type, n, j, {theta(D, 'event_type')} AS t FROM c, {js(D)}), m AS (SELECT j, sum(n*cos(t)) AS re, sum(n*sin(t)) AS im FROM v GROUP BY j)
SELECT event_type, round(sum(re*cos(t) + im*sin(t)) / {D}, 3) + 0.0 AS estimate FROM v JOIN m USING (j) GROUP BY event_type"""
)
def frequency_sketch(spark, d):
    n = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    out = S.set_scores(SPACE, S.set_bundle(SPACE, n, "event_type", F.col("n")), n, "event_type")
    return out.select("event_type", (F.round("score", 3) + F.lit(0.0)).alias("estimate"))


def _eav(spark, d):
    """Nations as records of name, region and first letter of the region."""
    roles = F.array(*[F.struct(F.lit(k).alias("role"), F.concat(F.lit(k + "="), v).alias("filler")) for k, v in (("name", F.col("n_name")), ("region", F.col("r_name")), ("letter", F.substring("r_name", 1, 1)))])
    return _nations(spark, d)[0].select("n_name", F.explode(roles).alias("x")).select("n_name", "x.*")


_EAV = "(SELECT n_name, unnest(['name', 'region', 'letter']) AS role, unnest(['name=' || n_name, 'region=' || r_name, 'letter=' || substr(r_name, 1, 1)]) AS filler FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(
    f"""WITH e AS {_EAV}, m AS (SELECT n_name, j, sum(cos({theta(D, 'role')} + {theta(D, 'filler')})) AS re, sum(sin({theta(D, 'role')} + {theta(D, 'filler')})) AS im FROM e, {js(D)} GROUP BY n_name, j),
r AS (SELECT role, j, {theta(D, 'role')} AS t FROM (SELECT DISTINCT role FROM e), {js(D)}), f AS (SELECT filler, j, {theta(D, 'filler')} AS t FROM (SELECT DISTINCT filler FROM e), {js(D)}),
s AS (SELECT n_name, role, filler AS label, sum((m.re*cos(r.t)+m.im*sin(r.t))*cos(f.t) + (m.im*cos(r.t)-m.re*sin(r.t))*sin(f.t)) / {D} AS score FROM m JOIN r USING (j) JOIN f USING (j) GROUP BY ALL)
SELECT n_name, role, label, {s6('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY n_name, role ORDER BY score DESC, label) = 1"""
)
def record_get(spark, d):
    e = _eav(spark, d)
    out = S.record_get(SPACE, S.records(SPACE, e, "n_name", "role", "filler"), "n_name", e, "role", e, "filler")
    return out.select("n_name", "role", "label", r6("score").alias("score"))


@query(f"WITH e AS {_EAV} SELECT x.n_name AS a, y.n_name AS b, x.role, x.filler AS asked, y.filler AS answer FROM e x JOIN e y ON x.role = y.role AND x.n_name <> y.n_name")
def record_analogy(spark, d):
    return S.analogy_exact(_eav(spark, d), "n_name", "role", "filler")


@query(f"WITH e AS {_EAV} SELECT x.n_name AS a, y.n_name AS b, x.filler, x.role, y.filler AS label FROM e x JOIN e y ON x.role = y.role AND y.n_name = 'NATION_7' WHERE x.n_name <> 'NATION_7'")
def record_analogy_bundle(spark, d):
    """What NATION_7 has where each nation has a filler: two unbindings, which give what the join gives."""
    space, e = Space(1024), _eav(spark, d)
    asked = e.filter("n_name <> 'NATION_7'").select(F.col("n_name").alias("a"), F.lit("NATION_7").alias("b"), "filler")
    out = S.analogy(space, S.records(space, e, "n_name", "role", "filler"), "n_name", asked, "filler", e, "role", e)
    return out.select("a", "b", "filler", "role", "label")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS pop FROM events")
def stack_pop(spark, d):
    return S.stack_order(load(spark, d, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "pop")


_SEQ = "(SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey)::INT - 1 AS p FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(
    f"""WITH e AS {_SEQ}, m AS (SELECT r_name, (j - p) % {D} + CASE WHEN j < p THEN {D} ELSE 0 END AS j, sum(cos({theta(D, 'n_name')})) AS re, sum(sin({theta(D, 'n_name')})) AS im FROM e, {js(D)} GROUP BY ALL),
k AS (SELECT n_name AS label, j, {theta(D, 'n_name')} AS t FROM nation, {js(D)}),
s AS (SELECT r_name, p, label, sum(re*cos(t) + im*sin(t)) / {D} AS score FROM m, (SELECT DISTINCT p FROM e) x JOIN k ON k.j = (m.j + x.p) % {D} GROUP BY ALL)
SELECT r_name, p, label, {s6('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY r_name, p ORDER BY score DESC, label) = 1"""
)
def sequence_decode(spark, d):
    """Each region's nations in order of key, read back at every position."""
    from pyspark.sql import Window

    n, r = load(spark, d, "nation"), load(spark, d, "region")
    w = Window.partitionBy("r_name").orderBy("n_nationkey")
    s = n.join(r, n.n_regionkey == r.r_regionkey).withColumn("p", F.row_number().over(w) - 1).select("r_name", "n_name", "p")
    out = S.sequence_decode(SPACE, S.sequence_bundle(SPACE, s, "r_name", "p", "n_name"), "r_name", s, "p", s, "n_name")
    return out.select("r_name", "p", "label", r6("score").alias("score"))


@query(f"WITH e AS {_SEQ} SELECT r_name, (row_number() OVER (PARTITION BY r_name ORDER BY p DESC))::INT AS pop, n_name AS label FROM e QUALIFY pop <= 4")
def stack_pop_bundle(spark, d):
    """Each region's nations pushed in order of key onto one vector, and four of them popped."""
    from pyspark.sql import Window

    space = Space(1024)
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    w = Window.partitionBy("r_name").orderBy(F.col("n_nationkey").desc())
    s = n.join(r, n.n_regionkey == r.r_regionkey).withColumn("depth", F.row_number().over(w) - 1).select("r_name", "n_name", "depth")
    # the last one is pushed onto the others
    rest = S.stack_bundle(space, s.filter("depth > 0").withColumn("depth", F.col("depth") - 1), "r_name", "depth", "n_name")
    full = S.stack_push(space, rest, "r_name", s.filter("depth = 0"), "n_name")
    return S.stack_pops(space, full, "r_name", s, "n_name", 4).select("r_name", "pop", "label")


_GRAMS = "g AS (SELECT {key}, substr(t, i, 3) AS gram, count(*) AS n FROM (SELECT {key}, t, unnest(range(1, greatest(1, len(t) - 1))) AS i FROM (SELECT {key}, regexp_replace(lower(text), '[^a-z ]', '', 'g') AS t FROM {table}) WHERE len(t) >= 3) GROUP BY ALL)"


@query(f"WITH {_GRAMS.format(key='lang', table='documents')} SELECT lang, gram, n FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 20")
def ngram_top(spark, d):
    from phasorlake.plans import first_by

    return first_by(S.ngrams(load(spark, d, "documents"), "lang", "text"), ["lang"], [F.col("n").desc(), F.col("gram")], 20)


@query(
    f"""WITH {_GRAMS.format(key='doc_id', table='documents')}, l AS (SELECT lang, gram, sum(n)::BIGINT AS n FROM g JOIN documents USING (doc_id) GROUP BY ALL),
x AS (SELECT doc_id, l.lang, sum(g.n::DOUBLE*l.n) AS d FROM g JOIN l USING (gram) GROUP BY ALL), a AS (SELECT doc_id, sqrt(sum(n::DOUBLE*n)) AS na FROM g GROUP BY 1), b AS (SELECT lang, sqrt(sum(n::DOUBLE*n)) AS nb FROM l GROUP BY 1)
SELECT doc_id, lang AS guess, {s6('d / (na*nb)')} AS cos FROM x JOIN a USING (doc_id) JOIN b USING (lang) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(d / (na*nb), 9) DESC, lang) = 1"""
)
def ngram_lang_cosine(spark, d):
    """Each document's language by the cosine of letter trigrams."""
    from phasorlake.plans import first_by

    docs = load(spark, d, "documents")
    lang = S.ngrams(docs, "lang", "text")
    best = first_by(S.profile_cosines(docs, "doc_id", "text", lang, "lang"), ["doc_id"], [F.round("cos", 9).desc(), F.col("lang").asc()])
    return best.select("doc_id", F.col("lang").alias("guess"), r6("cos").alias("cos"))


def _trade(spark, d):
    c, o, n = load(spark, d, "customer"), load(spark, d, "orders"), load(spark, d, "nation")
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    li = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    e = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    e = e.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src")), n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"))
    return e.join(a, "s_nationkey").join(b, "c_nationkey").select("src", "dst", "n")


_TRADE = "e AS (SELECT a.n_name AS src, b.n_name AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY ALL)"
_TOP = f"{_TRADE}, f AS (SELECT src, dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) <= 2)"


def _top(spark, d):
    from phasorlake.plans import first_by

    return first_by(_trade(spark, d), ["src"], [F.col("n").desc(), F.col("dst")], 2).select("src", "dst")


@query(
    f"""WITH {_TOP}, m AS (SELECT j, sum(cos({theta(D, 'src')} + {theta(D, 'dst', f'(j+1)%{D}')})) AS re, sum(sin({theta(D, 'src')} + {theta(D, 'dst', f'(j+1)%{D}')})) AS im FROM f, {js(D)} GROUP BY j),
p AS (SELECT a.n_name AS src, b.n_name AS dst FROM nation a, nation b)
SELECT src, dst, {s6(f"sum(re*cos(t) + im*sin(t)) / {D}")} AS score, sum(re*cos(t) + im*sin(t)) / {D} >= 0.5 AS edge FROM (SELECT src, dst, j, {theta(D, 'src')} + {theta(D, 'dst', f'(j+1)%{D}')} AS t FROM p, {js(D)}) JOIN m USING (j) GROUP BY src, dst"""
)
def graph_has_edge(spark, d):
    n = load(spark, d, "nation")
    probes = n.select(F.col("n_name").alias("src")).crossJoin(n.select(F.col("n_name").alias("dst")))
    out = S.graph_has_edge(SPACE, S.graph_bundle(SPACE, _top(spark, d)), probes)
    return out.select("src", "dst", r6("score").alias("score"), (F.col("score") >= 0.5).alias("edge"))


@query(
    f"""WITH {_TOP}, m AS (SELECT j, sum(cos({theta(D, 'src')} + {theta(D, 'dst', f'(j+1)%{D}')})) AS re, sum(sin({theta(D, 'src')} + {theta(D, 'dst', f'(j+1)%{D}')})) AS im FROM f, {js(D)} GROUP BY j),
s AS (SELECT a.n_name AS node, b.n_name AS label, j, {theta(D, 'a.n_name')} + {theta(D, 'b.n_name', f'(j+1)%{D}')} AS t FROM nation a, nation b, {js(D)})
SELECT node, label, {s6(f"sum(re*cos(t) + im*sin(t)) / {D}")} AS score FROM s JOIN m USING (j) GROUP BY node, label HAVING sum(re*cos(t) + im*sin(t)) / {D} >= 0.6"""
)
def graph_neighbors(spark, d):
    n = load(spark, d, "nation").select(F.col("n_name").alias("node"))
    out = S.graph_neighbors(SPACE, S.graph_bundle(SPACE, _top(spark, d)), n, "node", n, "node", 0.6)
    return out.select("node", "label", r6("score").alias("score"))


@query(f"WITH {_TRADE} SELECT src, dst, n FROM e")
def graph_neighbors_exact(spark, d):
    return _trade(spark, d)


@query(
    """WITH x AS (SELECT DISTINCT event_type, user_id % 7 AS k FROM events WHERE value > 50), y AS (SELECT DISTINCT event_type, user_id % 7 AS k FROM events WHERE value > 90)
SELECT (SELECT count(*) FROM x) AS truth, (SELECT count(*) FROM y) AS found, CASE WHEN (SELECT count(*) FROM y) > 0 THEN c::DOUBLE / (SELECT count(*) FROM y) ELSE 1.0 END AS precision,
CASE WHEN (SELECT count(*) FROM x) > 0 THEN c::DOUBLE / (SELECT count(*) FROM x) ELSE 1.0 END AS recall, c = (SELECT count(*) FROM x) AND c = (SELECT count(*) FROM y) AS exact FROM (SELECT count(*) AS c FROM x JOIN y USING (event_type, k))"""
)
def set_metrics(spark, d):
    e = load(spark, d, "events").withColumn("k", F.col("user_id") % 7)
    return S.set_metrics(e.filter("value > 50"), e.filter("value > 90"), ["event_type", "k"])


_RULES = """rules AS (SELECT state, symbol, after FROM (SELECT state, symbol, after, count(*) AS n FROM (SELECT event_type AS state, lead(event_type, 1) OVER w AS symbol, lead(event_type, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE after IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY state, symbol ORDER BY n DESC, after) = 1)"""


@query(
    f"""WITH RECURSIVE {_RULES}, i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_type AS a FROM events),
t AS (SELECT user_id, 0::BIGINT AS p, 'view' AS s FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT t.user_id, i.p, coalesce(r.after, t.s) FROM t JOIN i ON i.user_id = t.user_id AND i.p = t.p + 1 LEFT JOIN rules r ON r.state = t.s AND r.symbol = i.a)
SELECT user_id, p AS position, s AS state FROM t WHERE p > 0"""
)
def fsm_run(spark, d):
    """Each user's events drive the automaton of the commonest followers, from ``view``."""
    from pyspark.sql import Window

    e = load(spark, d, "events")
    rows = e.withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return S.fsm_run(rows, "user_id", "p", "event_type", S.top_followers(e, "user_id", ["ts", "event_id"], "event_type"), "view")


def _t(label: str, j: str = "j") -> str:
    return theta(512, label, j)


_SYM = "'sym:' || symbol"


@query(
    f"""WITH {_RULES}, m AS (SELECT j, sum(cos({_t('state')} + {_t(_SYM)} + {_t('after', '(j+1)%512')})) AS re, sum(sin({_t('state')} + {_t(_SYM)} + {_t('after', '(j+1)%512')})) AS im FROM rules, {js(512)} GROUP BY j),
s AS (SELECT r.state, r.symbol, k.label, sum(re*cos(t) + im*sin(t)) / 512 AS score FROM (SELECT a.state, a.symbol, k.label, j, {_t('a.state')} + {_t("'sym:' || a.symbol")} + {_t('k.label', '(j+1)%512')} AS t FROM rules a, (SELECT DISTINCT event_type AS label FROM events) k, {js(512)}) x JOIN m USING (j) JOIN rules r ON r.state = x.state AND r.symbol = x.symbol JOIN (SELECT DISTINCT event_type AS label FROM events) k ON k.label = x.label GROUP BY ALL)
SELECT state, symbol, label, {s6('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY state, symbol ORDER BY score DESC, label) = 1"""
)
def fsm_step(spark, d):
    e, space = load(spark, d, "events"), Space(512)
    rules = S.top_followers(e, "user_id", ["ts", "event_id"], "event_type")
    out = S.fsm_step(space, S.fsm_bundle(space, rules), rules, e, "event_type")
    return out.select("state", "symbol", "label", r6("score").alias("score"))


@query(
    f"""WITH RECURSIVE {_RULES}, i AS (SELECT machine, generate_subscripts(w, 1) AS p, unnest(w) AS a FROM (VALUES (1, ['click', 'view', 'purchase', 'view', 'click']), (2, ['view', 'view', 'view', 'click', 'purchase'])) t(machine, w)),
t AS (SELECT DISTINCT machine, 0 AS p, 'view' AS s FROM i UNION ALL SELECT t.machine, i.p::INT, r.after FROM t JOIN i ON i.machine = t.machine AND i.p = t.p + 1 JOIN rules r ON r.state = t.s AND r.symbol = i.a)
SELECT machine, p AS position, s AS state FROM t"""
)
def fsm_trajectory(spark, d):
    """Two words driven through the bundle of the rules, a clean-up at every step."""
    e, space = load(spark, d, "events"), Space(2048)
    rules = S.top_followers(e, "user_id", ["ts", "event_id"], "event_type")
    words = [(1, "click view purchase view click"), (2, "view view view click purchase")]
    inputs = spark.createDataFrame([(m, p, a) for m, w in words for p, a in enumerate(w.split(), 1)], "machine int, position int, symbol string")
    return S.fsm_trajectory(space, S.fsm_bundle(space, rules), inputs, "machine", e, "event_type", "view")


_BIT = "CASE WHEN {} < 0.5 THEN -1 ELSE 1 END"
_SDM = f"""pt AS (SELECT n_nationkey AS id, bit, {_BIT.format(u("'pat|' || n_name || '|' || bit"))} AS sign FROM nation, (SELECT unnest(range(256)) AS bit)),
nz AS (SELECT id, bit, CASE WHEN {u("'noise|' || id || '|' || bit")} < 0.05 THEN -sign ELSE sign END AS sign FROM pt),
ad AS (SELECT loc, bit, {_BIT.format(u("'0|sdm|' || loc || '|' || bit"))} AS sign FROM (SELECT unnest(range(1000)) AS loc), (SELECT unnest(range(256)) AS bit)),
wa AS (SELECT id, loc FROM ad JOIN pt USING (bit) GROUP BY id, loc HAVING (256 - sum(ad.sign * pt.sign)) / 2.0 <= 112), me AS (SELECT loc, bit, sum(sign) AS cnt FROM wa JOIN pt USING (id) GROUP BY loc, bit),
a1 AS (SELECT id, loc FROM ad JOIN nz USING (bit) GROUP BY id, loc HAVING (256 - sum(ad.sign * nz.sign)) / 2.0 <= 112), r1 AS (SELECT id, bit, CASE WHEN sum(cnt) >= 0 THEN 1 ELSE -1 END AS sign FROM a1 JOIN me USING (loc) GROUP BY id, bit),
a2 AS (SELECT id, loc FROM ad JOIN r1 USING (bit) GROUP BY id, loc HAVING (256 - sum(ad.sign * r1.sign)) / 2.0 <= 112), r2 AS (SELECT id, bit, CASE WHEN sum(cnt) >= 0 THEN 1 ELSE -1 END AS sign FROM a2 JOIN me USING (loc) GROUP BY id, bit)"""


@query(f"WITH {_SDM} SELECT id, count_if(nz.sign <> pt.sign)::BIGINT AS before, count_if(r2.sign <> pt.sign)::BIGINT AS after FROM nz JOIN pt USING (id, bit) JOIN r2 USING (id, bit) GROUP BY id")
def sdm_recall(spark, d):
    """Patterns with some bits turned, read back from a sparse distributed memory: (id, wrong bits before, after)."""
    bits, radius = 256, 112
    pats = load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"), "n_name")
    from phasorlake.functions import text, uniform

    pats = pats.withColumn("sign", F.when(uniform(text("pat", F.col("n_name"), F.col("bit"))) < 0.5, -1).otherwise(1)).drop("n_name")
    noisy = pats.withColumn("sign", F.when(uniform(text("noise", F.col("id"), F.col("bit"))) < 0.05, -F.col("sign")).otherwise(F.col("sign")))
    addresses = S.sdm_addresses(SPACE, spark, 1000, bits)
    memory = S.sdm_write(addresses, pats, "id", radius, bits)
    got = S.sdm_read(addresses, memory, noisy, "id", radius, bits)
    a = noisy.withColumnRenamed("sign", "n").join(pats, ["id", "bit"]).join(got.withColumnRenamed("sign", "g"), ["id", "bit"])
    return a.groupBy("id").agg(F.count_if(F.col("n") != F.col("sign")).alias("before"), F.count_if(F.col("g") != F.col("sign")).alias("after"))
