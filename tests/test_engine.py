"""The registry against its SQL on small tables, and brute-force twins of what SQL can't say."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from phasorlake.operators import analytics, graphs, kernels, quantize, routing, scenes, structures, textual
from phasorlake.plans import radius_join
from phasorlake.queries import QUERIES, SQL
from phasorlake.space import Space

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def rows(df):
    def text(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "NULL"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(SQL[name]).df())


def test_radius_join_and_nearest(spark):
    r = np.random.default_rng(2)
    a, b = r.uniform(-1, 1, (80, 2)), r.uniform(-1, 1, (70, 2))
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)] + [(999, None, 0.0)], "i int, x double, y double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "k int, x_r double, y_r double")
    d = np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    got = radius_join(left, right, ["x", "y"], 0.2).collect()
    assert sorted((p.i, p.k) for p in got) == sorted(map(tuple, np.argwhere(d <= 0.2).tolist()))
    near = {p.i: p.nearest for p in analytics.nearest_within(left, "i", right.toDF("k", "x", "y"), "k", ["x", "y"], 0.2).collect()}
    assert near == {i: int(d[i].argmin()) if d[i].min() <= 0.2 else -1 for i in range(80)} | {999: -1}


def test_remove_subset_refuses_a_stranger(spark):
    p = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, x double")
    assert analytics.remove_subset(p, "i", p.filter("i < 3").withColumnRenamed("i", "c"), "c", ["x"], 0.1).count() == 7
    with pytest.raises(Exception, match="parent"):
        analytics.remove_subset(p, "i", spark.createDataFrame([(1, 77.0)], "c int, x double"), "c", ["x"], 0.1).count()


def test_sdm_and_resonator(spark):
    out = QUERIES["sdm_recall"](spark, SF).collect()
    assert sum(r.after for r in out) < 0.2 * sum(r.before for r in out)
    factored = QUERIES["resonator_factor"](spark, SF).collect()
    assert len(factored) == 25 and all(r.converged and r.nation == r.n_name and r.amplitude > 0.99 for r in factored)
    r = np.random.default_rng(3)
    books = [np.exp(1j * r.uniform(-np.pi, np.pi, (8, 2048))) for _ in range(2)]
    two = books[0][1] * books[1][6] + 0.6 * books[0][5] * books[1][2]
    found = kernels.factorize_all(two, books, 3)
    assert {tuple(x[0]) for x in found[:2]} == {(1, 6), (5, 2)} and not found[2][2]


def test_numeric_kernels(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 2))
    y = x @ [2.0, -1.0] + 0.5
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    assert np.allclose(kernels.ridge(df, ["a", "b"], "y", 1e-9), [2, -1, 0.5], atol=1e-6)
    freqs, shift = r.normal(size=(64, 2)), np.array([0.3, -0.2])
    a = np.exp(1j * r.uniform(size=64))
    grid = np.array([[i / 10, j / 10] for i in range(-5, 6) for j in range(-5, 6)])
    at, score = kernels.phase_correlation(a, a * np.exp(1j * freqs @ shift), freqs, grid)
    assert np.allclose(at, shift) and score > 0.99
    assert kernels.phase_correlation(a * 0, a, freqs, grid)[1] == 0
    u, v = r.normal(size=8), r.normal(size=8)
    want = [sum(u[k] * v[(i - k) % 8] for k in range(8)) for i in range(8)]
    got = kernels.hrr_bind(spark.createDataFrame([(1, u.tolist(), v.tolist())], "k int, a array<double>, b array<double>"), "k", "a", "b").first().bound
    assert np.allclose(got, want)
    g = x.T @ x
    assert np.allclose(kernels.project(g, g @ np.ones((2, 1)), 1e-9), 1)


def test_routing_survives_typos(spark):
    rules = spark.createDataFrame([(0, "transfer money to savings account", "pay"), (1, "play some quiet music tonight", "play"), (2, "what is the weather tomorrow morning", "weather")], "rule int, condition string, action string")
    asked = spark.createDataFrame([(0, "trnsfer money to savings acount"), (1, "play sme quiet musc"), (2, "wht is the weather tomorow")], "k int, text string")
    space = Space(1024)
    want = {0: "pay", 1: "play", 2: "weather"}
    assert {r.k: r.action for r in routing.dispatch_matrix(space, rules, asked, "k").collect()} == want
    assert {r.k: r.action for r in routing.dispatch_bundle(space, routing.rule_bundle(space, rules), rules, asked, "k").collect()} == want
    assert {r.k: r.action for r in routing.dispatch_banded(space, routing.banded(rules, 2), asked, "k", 2).collect()} == want
    assert {r.action for r in routing.dispatch_matrix(space, rules, spark.createDataFrame([(0, "zzzz qqqq")], "k int, text string"), "k", 0.3).collect()} <= {None}


def test_graph_scan(spark):
    src = "import os\nfrom a import b\nclass C:\n    def m(self):\n        if os:\n            return helper()\ndef helper():\n    return 1\n"
    df = graphs.scan_python(spark.createDataFrame([("pkg/x.py", src), ("bad.py", "def (")], "path string, text string"))
    got = {(r.kind, r.name) for r in df.collect()}
    assert {("function", "pkg.x.C.m"), ("class", "pkg.x.C"), ("module", "pkg.x"), ("broken", "bad")} <= got
    assert [tuple(r) for r in graphs.resolve_calls(df).collect()] == [("pkg.x.C.m", "pkg.x.helper")]
    assert df.filter("kind = 'function' and name = 'pkg.x.C.m'").first().complexity == 2


def test_paragraphs_chunks_and_claims(spark):
    md = "# Head\nSome *text* with [a link](http://x)\nthat wraps.\n\n- one\n- two\n\n```\ncode\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    p = textual.paragraphs(spark.createDataFrame([("f", md)], "file string, text string"), "file", "text")
    assert [(r.kind, r.body) for r in p.orderBy("line").collect()] == [("heading", "Head"), ("prose", "Some text with a link that wraps."), ("prose", "one"), ("prose", "two"), ("row", "a ; b"), ("row", "1 ; 2")]
    c = textual.chunks(p, "file", 20, 60).orderBy("l0").collect()
    assert c[0].heading == "Head" and all(len(x.body) <= 60 for x in c) and len(c) >= 2
    schema = "id string, statement string, status string, supersedes string, as_of string"
    claims = spark.createDataFrame([("n", "first", "current", None, "2024-01-01")], schema)
    two = textual.supersede(claims, "n", "second", "2024-02-01")
    three = textual.supersede(two, "n", "third", "2024-03-01")
    assert {r.id: (r.status, r.supersedes) for r in three.collect()} == {"n": ("superseded", None), "n@a": ("superseded", "n"), "n@b": ("current", "n@a")}
    assert sorted((r.root, r.id, r.step) for r in textual.supersession(three).collect() if r.root == "n@b") == [("n@b", "n", 2), ("n@b", "n@a", 1), ("n@b", "n@b", 0)]
    loop = spark.createDataFrame([("a", "x", "c", "b", ""), ("b", "x", "c", "a", "")], schema)
    assert textual.supersession(loop).count() == 4
    hits = textual.pattern_hits(spark.createDataFrame([("n", r"(\d+) tests", "5")], "id string, pattern string, value string"), spark.createDataFrame([(1, "5 tests"), (2, "9 tests"), (3, "it was 7 tests")], "line int, body string"))
    assert {r.line: r.reading for r in hits.collect()} == {1: "current", 2: "stale", 3: "historical"}


def test_block_quantisation_and_tiles(spark):
    v = [(0, j, 0.9 * np.cos(j), 0.5 * np.sin(j)) for j in range(40)]
    df = spark.createDataFrame([(k, j, float(a), float(b)) for k, j, a, b in v], "k int, j int, re double, im double")
    got = {r.j: (r.re, r.im) for r in quantize.quant_block(df, ["k"], 16, 8).collect()}
    assert max(abs(got[j][0] - a) for _, j, a, _ in v) < 1 / 127
    assert scenes.tile_starts(0, 5, 10, 0.5) == [0] and scenes.tile_starts(0, 20, 10, 0.5) == [0, 5.0, 10]
    m = structures.set_metrics(df, df.filter("j < 0"), ["j"]).first()
    assert (m.precision, m.recall, m.exact) == (1.0, 0.0, False)


def test_long_chain_of_claims_is_walked_to_its_end(spark):
    n = 130
    rows = [(f"c@{i}", f"c@{i - 1}" if i else None) for i in range(n)]
    got = textual.supersession(spark.createDataFrame(rows, "id string, supersedes string").coalesce(1))
    assert sorted((r.step, r.id) for r in got.filter(f"root = 'c@{n - 1}'").collect()) == [(k, f"c@{n - 1 - k}") for k in range(n)]
    # an id with two rows, a claim that isn't there, a circle behind a claim, no id
    few = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", None), ("p", "q"), ("q", "r"), ("r", "q"), (None, "b")], "id string, supersedes string").coalesce(1)
    want = [("a", "a", 0)] * 2 + [("a", "b", 1), ("a", "x", 1)] * 2 + [("b", "b", 0), ("p", "p", 0), ("p", "q", 1), ("p", "r", 2), ("q", "q", 0), ("q", "r", 1), ("r", "q", 1), ("r", "r", 0), (None, None, 0)]
    assert sorted(map(str, map(tuple, textual.supersession(few).collect()))) == sorted(map(str, want))


def test_nearest_in_a_crowd_meets_few(spark, monkeypatch):
    """rows of a dense place, and copies of a row, don't meet all others within the radius."""
    met = []

    def counted(*args):
        out = radius_join(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(analytics, "radius_join", counted)
    r = np.random.default_rng(5)
    a, b = (np.r_[r.normal(size=(600, 2)) / 100, np.zeros((200, 2)), r.uniform(-3, 3, (100, 2))] for _ in range(2))
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "i int, x double, y double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "k int, x double, y double")
    d = np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    got = {p.i: (p.nearest, p.dist) for p in analytics.nearest_within(left, "i", right, "k", ["x", "y"], 0.4).collect()}
    assert got == {i: (int(x.argmin()), pytest.approx(x.min())) if x.min() <= 0.4 else (-1, None) for i, x in enumerate(d)}
    assert sum(met) < 20_000 < (d <= 0.4).sum()


def test_fuzzy_findings_reads_texts_once(spark):
    """the cosines of all texts are made once, not once for each use of them."""
    assert QUERIES["fuzzy_findings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
