"""Pairs by blocks against brute force."""

import numpy as np
import pytest

from phasorlake.operators import pairs
from phasorlake.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def table(spark, n=2500, copies=40):
    """Vectors of a coarse grid, so that many scores are equal, with copies, a null vector and a null label."""
    v = np.random.default_rng(7).integers(-2, 3, (n, 4)) / 4
    v[:copies] = v[0]
    label = [None if i == 11 else i % 3 for i in range(n)]
    rows = [(i, None if i == 5 else x.tolist(), l) for i, (x, l) in enumerate(zip(v, label))]  # noqa: E741
    v[5] = np.nan
    s = np.round(v @ v.T, 9)
    return spark.createDataFrame(rows, "id long, v array<float>, label int"), s, label


def asked(df):
    return df.filter("id % 50 = 0 OR id IN (5, 11)").withColumnRenamed("id", "q"), df.withColumnRenamed("id", "k")


def no_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_of_each_kind(spark):
    """a block's best of each kind, and no row for each pair."""
    df, s, label = table(spark)
    q, e = asked(df)
    got = pairs.best_pairs(q, "q", e, "k", "v", 1, same="label").collect()
    ids = {r.q for r in got}
    assert ids == {i for i in range(len(s)) if i % 50 == 0 or i in (5, 11)} and len(got) < 3 * 3 * 3 * len(ids)
    for i in ids - {5}:
        for kind in (True, False):
            want = [(-s[i, j], j) for j in range(len(s)) if j not in (i, 5) and label[i] is not None and label[j] is not None and (label[i] == label[j]) == kind]
            have = [(-r.cos, r.k) for r in got if r.q == i and r.same is kind and r.cos is not None]
            assert (min(have) if have else None) == (min(want) if want else None)
    assert no_pairs(QUERIES["retrieval"](spark, SF))


def test_best_items_of_equals(spark):
    """the five best of each row, the least key of equals, null scores last, and no row for each pair."""
    df, s, _ = table(spark)
    q, e = asked(df)
    got = {}
    for r in pairs.best_items(q, "q", e, "k", "v", 5).collect():
        got.setdefault(r.q, []).append((r.cos is None, -(r.cos or 0.0), r.k))
    for i, have in got.items():
        want = sorted((bool(np.isnan(s[i, j])), -np.nan_to_num(s[i, j]) + 0.0, j) for j in range(len(s)) if j != i)[:5]
        assert sorted(have) == want
    assert len(got) == 52 and no_pairs(QUERIES["cosine_topk"](spark, SF))


def test_statistics_of_all_pairs(spark):
    """no pair of different keys is left out, whichever its first key is."""
    assert "% 20" not in SQL["pair_statistics"]
    e = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    v, label = np.array([r.embedding for r in e]), np.array([r.label for r in e])
    s = np.round(v @ v.T, 9)
    got = {(r.la, r.lb): r for r in QUERIES["pair_statistics"](spark, SF).collect()}
    assert set(got) == {(a, b) for a in set(label) for b in set(label)}
    for (a, b), r in got.items():
        x = s[(label[:, None] == a) & (label[None] == b) & ~np.eye(len(s), dtype=bool)]
        assert np.allclose([r.mean, r.sigma, r.p95, r.top], [x.mean(), x.std(), np.quantile(x, 0.95), x.max()], atol=1.1e-6)


def test_statistics_by_blocks(spark, monkeypatch):
    """F2: equal scores, nulls and further passes over the bins; no row for each pair."""
    df, s, label = table(spark)
    for most in (20_000_000, 10):
        monkeypatch.setattr(pairs, "VALUES", most)
        out = pairs.label_statistics(df, "id", "label", "v", 0.95)
        assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.la, r.lb): r for r in out.collect()}
        names = [-1 if x is None else x for x in label]
        assert len(got) == 15  # one row has no label, and no other to be paired with
        for (a, b), r in got.items():
            rows, cols = (np.array(names) == (-1 if x is None else x) for x in (a, b))
            x = s[np.outer(rows, cols) & ~np.eye(len(s), dtype=bool)]
            x = x[~np.isnan(x)]
            assert np.allclose([r.mean, r.sigma, r["quantile"], r.top], [x.mean(), x.std(), np.quantile(x, 0.95), x.max()], atol=1e-8)


def test_best_item_within_groups(spark):
    """the best item of the nearest groups, without a row for each pair of a query and an item."""
    from phasorlake.operators import studies

    r = np.random.default_rng(3)
    v, g = r.normal(size=(1500, 6)).astype("f4").astype(float), r.integers(0, 5, 1500)
    df = spark.createDataFrame([(i, x.tolist(), None if i == 4 else int(y)) for i, (x, y) in enumerate(zip(v, g))], "id long, v array<float>, g int")
    out = studies.coarse_fine(df.filter("id % 40 = 0"), "id", df.withColumnRenamed("id", "k"), "k", "g", "v", 2)
    assert "FlatMapCoGroups" in out._jdf.queryExecution().executedPlan().toString()
    g[4] = -1
    centre = {x: v[g == x].mean(0) for x in set(g)}
    want = {}
    for i in range(0, 1500, 40):
        near = sorted(centre, key=lambda x: -round(float(v[i] @ centre[x]), 9))[:2]
        k = max((j for j in range(1500) if g[j] in near and g[j] >= 0), key=lambda j: (round(float(v[i] @ v[j]), 9), -j))
        want[i] = (k, pytest.approx(v[i] @ v[k], abs=1e-9))
    assert {x.id: (x.item, x.score) for x in out.collect()} == want
