"""Queries over op logs, sets, text, graphs and run logs: events stand for ops, orders for edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasorlake.operators import graphs as P
from phasorlake.operators import replicate as M
from phasorlake.operators import textual as O
from phasorlake.operators.structures import ngrams, profile_cosines
from phasorlake.queries.registry import load, query, r6, s6


def _log(spark, d):
    return load(spark, d, "events").select((F.col("user_id") % 16).alias("peer"), F.col("event_id").alias("counter"), F.col("event_type").alias("container"), "value", "ts")


_L = "l AS (SELECT user_id % 16 AS peer, event_id AS counter, event_type AS container, value, ts FROM events)"


@query(f"WITH {_L}, t AS (SELECT container, peer, arg_max(value, counter) AS value FROM l GROUP BY ALL) SELECT container, {s6('sum(value)')} AS total, {s6('avg(value)')} AS mean, {s6('arg_min(value, peer)')} AS owner FROM t GROUP BY container")
def crdt_merge_rules(spark, d):
    g = _log(spark, d)
    a, b, c = (M.merged(g, ["container"], "value", r).withColumnRenamed("value", n) for r, n in (("sum", "total"), ("mean", "mean"), ("owner", "owner")))
    return a.join(b, "container").join(c, "container").select("container", *[r6(x).alias(x) for x in ("total", "mean", "owner")])


@query(f"WITH {_L}, v AS (SELECT peer, max(counter) AS c FROM l WHERE counter < 5000 AND peer < 12 GROUP BY peer) SELECT l.peer, counter, container FROM l LEFT JOIN v USING (peer) WHERE counter > coalesce(c, -1)")
def crdt_delta(spark, d):
    g = _log(spark, d)
    return M.updates_since(g, M.version(g.filter("counter < 5000 AND peer < 12"))).select("peer", "counter", "container")


@query(f"WITH {_L} SELECT count(*) AS n, count(DISTINCT container) AS containers FROM l")
def crdt_redelivery(spark, d):
    """A delta delivered twice leaves the log as it is."""
    g = _log(spark, d)
    twice = M.apply(M.apply(g.filter("counter % 3 = 0"), g.filter("counter % 2 = 0")), g)
    return twice.agg(F.count("*").alias("n"), F.count_distinct("container").alias("containers"))


@query(f"WITH {_L}, t AS (SELECT container, peer, arg_max(ceil(value), counter) AS value FROM l GROUP BY ALL) SELECT DISTINCT container, value FROM t")
def crdt_multi_value(spark, d):
    return M.multi_values(_log(spark, d).withColumn("value", F.ceil("value").cast("double")), "container", "value")


@query("WITH m AS (SELECT l_quantity AS x, sum(l_tax) AS m FROM lineitem GROUP BY 1) SELECT min(x) AS cut FROM (SELECT x, sum(m) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS r, sum(m) OVER () AS t FROM m) WHERE r >= t * 0.5")
def split_point(spark, d):
    return M.split_point(load(spark, d, "lineitem"), "l_quantity", "l_tax")


@query(f"SELECT {s6('regr_slope(ln(n), ln(q))')} AS slope FROM (SELECT l_quantity AS q, sum(l_extendedprice) AS n FROM lineitem GROUP BY 1)")
def growth_slope(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("q")).agg(F.sum("l_extendedprice").alias("n"))
    return M.growth(n, "q", "n").select(r6("slope").alias("slope"))


_OR = """a AS (SELECT peer, ((rn-1)//8)::INT AS epoch, ((rn-1)%8)::INT AS i, event_id, event_type, value FROM (SELECT user_id AS peer, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)),
live AS (SELECT * FROM a WHERE NOT (event_type = 'error') AND NOT EXISTS (SELECT 1 FROM a b WHERE b.peer = a.peer AND b.epoch = a.epoch AND b.i = 0 AND b.event_id % 5 = 0))"""


def _live(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("peer"), "event_id", "event_type", "value")
    a = M.with_epochs(e, "peer", ["event_id"], 8)
    return M.observed(a, a.filter("event_type = 'error'"), a.filter("i = 0 AND event_id % 5 = 0"))


@query(f"WITH {_OR} SELECT peer, epoch, i, event_id FROM live")
def orset_live(spark, d):
    return _live(spark, d).select("peer", "epoch", "i", "event_id")


@query(f"WITH {_OR} SELECT event_type, {s6('sum(value)')} AS value FROM live GROUP BY 1")
def orset_merged(spark, d):
    return M.live_sum(_live(spark, d), ["event_type"], F.col("value")).select("event_type", r6("value").alias("value"))


@query(f"WITH {_OR} SELECT peer, epoch, count(*) AS n FROM live GROUP BY ALL")
def stroke_list(spark, d):
    return M.strokes(_live(spark, d))


_RUN = "r AS (SELECT user_id || '-' || date_trunc('day', ts)::DATE AS run, CASE WHEN event_type = 'click' THEN 'started' WHEN event_type = 'purchase' THEN 'ended' END AS event, ts FROM events WHERE event_type IN ('click', 'purchase'))"


@query(f"WITH {_RUN} SELECT run, s.started, e.ended, CASE WHEN e.ended IS NULL THEN 'killed' ELSE 'done' END AS status FROM (SELECT run, min(ts) AS started FROM r WHERE event = 'started' GROUP BY 1) s LEFT JOIN (SELECT run, max(ts) AS ended FROM r WHERE event = 'ended' GROUP BY 1) e USING (run)")
def runs_outer(spark, d):
    e = load(spark, d, "events").filter("event_type IN ('click', 'purchase')")
    e = e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("run"), F.when(F.col("event_type") == "click", "started").otherwise("ended").alias("event"), F.col("ts").alias("at"))
    return P.runs(e)


@query(f"WITH {_RUN}, s AS (SELECT run, min(ts) AS started FROM r WHERE event = 'started' AND run NOT IN (SELECT run FROM r WHERE event = 'ended') GROUP BY 1) SELECT run, started FROM s ORDER BY started DESC, run LIMIT 10")
def killed_runs(spark, d):
    """The report of the last ten."""
    return runs_outer(spark, d).filter("status = 'killed'").select("run", "started").orderBy(F.col("started").desc(), "run").limit(10)


@query("SELECT doc_id, (contains(lower(text), 'license'))::INT + (contains(lower(text), 'the'))::INT + (contains(lower(text), 'and'))::INT AS score FROM documents WHERE score > 0")
def keyword_search(spark, d):
    return O.keyword_scores(load(spark, d, "documents"), "doc_id", "text", "The License and of")


_G3 = "{n} AS (SELECT {key}, substr(t, i, 3) AS gram, count(*) AS n FROM (SELECT {key}, t, unnest(range(1, greatest(1, len(t) - 1))) AS i FROM (SELECT {key}, regexp_replace(lower({text}), '[^a-z ]', '', 'g') AS t FROM {table}) WHERE len(t) >= 3) GROUP BY ALL)"
_COS = f"WITH {_G3.format(n='a', key='doc_id', text='text', table='documents')}, {_G3.format(n='b', key='item_id', text='text', table='benchmark')}, na AS (SELECT doc_id, sqrt(sum(n::DOUBLE*n)) AS x FROM a GROUP BY 1), nb AS (SELECT item_id, sqrt(sum(n::DOUBLE*n)) AS y FROM b GROUP BY 1), c AS (SELECT doc_id, item_id, round(sum(a.n::DOUBLE*b.n)/(any_value(x)*any_value(y)), 9) AS cos FROM a JOIN b USING (gram) JOIN na USING (doc_id) JOIN nb USING (item_id) GROUP BY ALL)"


def _routes(spark, d):
    rules = ngrams(load(spark, d, "benchmark"), "item_id", "text")
    return profile_cosines(load(spark, d, "documents"), "doc_id", "text", rules, "item_id").withColumn("cos", F.round("cos", 9))


@query(f"{_COS} SELECT doc_id, item_id, {s6('cos')} AS cos, row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, item_id)::INT AS rank FROM c WHERE cos >= 0.1 QUALIFY rank <= 3")
def search_topk(spark, d):
    """Whole texts against the benchmark's texts as a rule book: the three best at or over a threshold."""
    return O.search_topk(_routes(spark, d), ["doc_id"], "item_id", 3, 0.1).select("doc_id", "item_id", r6("cos").alias("cos"), "rank")


@query(f"{_COS}, m AS (SELECT doc_id, arg_max(item_id, struct_pack(c := cos, i := -item_id)) AS item, max(cos) AS cos FROM c GROUP BY 1) SELECT t AS threshold, count_if(cos >= t)::BIGINT AS answered, count(*)::BIGINT AS asked FROM m, (SELECT unnest([0.0, 0.1, 0.2, 0.3]::DOUBLE[]) AS t) GROUP BY t")
def abstention_curve(spark, d):
    best = _routes(spark, d).groupBy("doc_id").agg(F.max("cos").alias("cos"))
    rows = best.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2, 0.3)])))
    return rows.groupBy("threshold").agg(F.count_if(F.col("cos") >= F.col("threshold")).alias("answered"), F.count("*").alias("asked"))


@query("SELECT doc_id, min(k) AS rule FROM documents, (VALUES (0, ['the', 'license']), (1, ['la', 'que']), (2, ['the'])) r(k, w) WHERE len(list_filter(w, lambda x: NOT list_contains(string_split(lower(text), ' '), x))) = 0 GROUP BY doc_id")
def exact_and(spark, d):
    """The first rule all of whose words a text has."""
    rules = spark.createDataFrame([(0, ["the", "license"]), (1, ["la", "que"]), (2, ["the"])], "k int, w array<string>")
    docs = load(spark, d, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("t"))
    hit = docs.crossJoin(F.broadcast(rules)).filter(F.size(F.array_except("w", "t")) == 0)  # the rule book against all texts
    return hit.groupBy("doc_id").agg(F.min("k").alias("rule"))


def _claims(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") - F.col("c_custkey") % 7).cast("string")).alias("supersedes"), F.col("c_name").alias("statement"))
    return c


@query("WITH RECURSIVE k AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey - c_custkey % 7)::VARCHAR END AS supersedes FROM customer), t AS (SELECT id AS root, id, 0 AS step FROM k UNION ALL SELECT t.root, k.supersedes, step + 1 FROM t JOIN k ON k.id = t.id WHERE k.supersedes IS NOT NULL) SELECT root, id, step FROM t")
def claims_chain(spark, d):
    return O.supersession(_claims(spark, d))


@query(
    """WITH k AS (SELECT CASE WHEN c_custkey % 500 = 1 THEN (c_custkey - 1)::VARCHAR ELSE c_custkey::VARCHAR END AS id, CASE WHEN c_custkey % 333 = 0 THEN 'gone' WHEN c_custkey % 7 <> 0 THEN (c_custkey - c_custkey % 7)::VARCHAR END AS supersedes, CASE WHEN c_custkey % 250 = 3 THEN ' ' ELSE c_name END AS statement FROM customer)
SELECT id, 'duplicate' AS error FROM k GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'dangling' FROM k WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT id FROM k) UNION ALL SELECT id, 'empty' FROM k WHERE trim(statement) = ''"""
)
def claims_errors(spark, d):
    """A registry with ids given twice, links to nothing and empty statements."""
    k = F.col("c_custkey")
    c = load(spark, d, "customer").select(
        F.when(k % 500 == 1, k - 1).otherwise(k).cast("string").alias("id"),
        F.when(k % 333 == 0, F.lit("gone")).when(k % 7 != 0, (k - k % 7).cast("string")).alias("supersedes"),
        F.when(k % 250 == 3, F.lit(" ")).otherwise(F.col("c_name")).alias("statement"),
    )
    return O.registry_errors(c)


@query("WITH f AS (SELECT p_partkey % 10 AS k, p_size AS since, max(p_retailprice) AS value FROM part GROUP BY ALL), g AS (SELECT *, lead(since) OVER (PARTITION BY k ORDER BY since) AS until FROM f) SELECT o_orderkey, g.value FROM orders LEFT JOIN g ON o_orderkey % 10 = k AND o_custkey % 60 >= since AND (until IS NULL OR o_custkey % 60 < until)")
def value_as_of(spark, d):
    f = load(spark, d, "part").groupBy((F.col("p_partkey") % 10).alias("k"), F.col("p_size").alias("since")).agg(F.max("p_retailprice").alias("value"))
    a = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("k"), (F.col("o_custkey") % 60).alias("v"))
    return O.value_as_of(f, a, "k", "v").select("o_orderkey", "value")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def graph_hotspots(spark, d):
    return P.hotspots(load(spark, d, "part"), "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def graph_uncalled(spark, d):
    return P.uncalled(load(spark, d, "customer"), "c_custkey", load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), "o_custkey").select("c_custkey")


@query("SELECT o_custkey, count(*) AS degree FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def graph_hubs(spark, d):
    return P.hubs(load(spark, d, "orders"), "o_custkey")


@query("SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst, c_nationkey AS src_lane, s_nationkey AS dst_lane FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey")
def graph_leakage(spark, d):
    o, c, s = load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "supplier")
    a = o.join(c, o.o_custkey == c.c_custkey).select(F.concat(F.lit("o"), "o_orderkey").alias("name"), F.col("c_nationkey").alias("lane"))
    nodes = a.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.col("s_nationkey").alias("lane")))
    e = load(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    out = P.leakage(e, nodes, "name", "lane")
    return out.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"), "src_lane", "dst_lane")


@query("SELECT s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_name = 'Customer#' || substr(s_name, 10) AND c_acctbal < 0)")
def graph_untested(spark, d):
    c = load(spark, d, "customer").filter("c_acctbal < 0")
    return P.untested(load(spark, d, "supplier"), "s_name", F.concat(F.lit("Customer#"), F.substring("s_name", 10, 100)), c, "c_name").select("s_name")


@query("WITH a AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT lang, source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL) SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.source, b.source) AS source, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS now, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'regression' ELSE 'improvement' END AS change FROM a FULL JOIN b ON a.lang = b.lang AND a.source = b.source WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def ratchet_diff(spark, d):
    docs = load(spark, d, "documents")
    good = docs.join(load(spark, d, "labels").filter("quality = 1"), "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return P.ratchet(docs.groupBy("lang", "source").agg(F.count("*").alias("n")), good, ["lang", "source"])
