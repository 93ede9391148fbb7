"""Operators that have no query, or whose edge cases the tables don't hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasorlake.operators import analytics, change, fields, graphs, kernels, quantize, regress, render, replicate, scenes, structures, studies, textual
from phasorlake.plans import running
from phasorlake.sources import blobs, captures
from phasorlake.space import Space


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_running_sums_by_ranges(spark):
    r = np.random.default_rng(1)
    data = [(int(g), float(v), float(w)) for g, v, w in zip(r.integers(0, 3, 500), r.integers(0, 90, 500) / 7, r.integers(1, 5, 500))]
    got = rows(running(spark.createDataFrame(data, "g int, v double, w double"), "v", "w", ["g"], 8).select("g", "v", "_w", "_before", "_all", "_low", "_lowbefore", "_last"), "g", "v")
    want = []
    for g in range(3):
        own: dict = {}
        for a, v, w in data:
            if a == g:
                own[v] = own.get(v, 0) + w
        before, low, lowbefore = 0.0, None, None
        for v in sorted(own):
            want.append((g, v, own[v], before, sum(own.values()), low, lowbefore, v == max(own)))
            low, lowbefore, before = v, before, before + own[v]
    assert got == want
    assert running(spark.createDataFrame([], "v double, w double"), "v", "w").count() == 0


def test_quantile_of_one_value_and_weights_of_zero(spark):
    df = spark.createDataFrame([(5.0, 2.0), (5.0, 1.0), (9.0, 0.0)], "v double, w double")
    assert rows(scenes.weighted_quantile(df, "v", "w", [0.0, 0.5, 1.0]), "q") == [(0.0, 5.0), (0.5, 5.0), (1.0, 5.0)]


def test_machines_in_blocks(spark):
    r = np.random.default_rng(2)
    rules = spark.createDataFrame([(s, a, "xyz"[(i + k) % 3]) for i, s in enumerate("xyz") for k, a in enumerate("ab")], "state string, symbol string, after string")
    step = {(x.state, x.symbol): x.after for x in rules.collect()}
    data = [(m, p, "abc"[int(r.integers(0, 3))]) for m in range(3) for p in range(1, 40 * (m + 1))]
    got = rows(structures.fsm_run(spark.createDataFrame(data, "m int, p long, a string").repartition(5), "m", "p", "a", rules, "x", block=7), "m", "position")
    want = []
    for m in range(3):
        s = "x"
        for _, p, a in [d for d in data if d[0] == m]:
            s = step.get((s, a), s)
            want.append((m, p, s))
    assert got == want


def test_resonator_needs_no_phase_and_keeps_a_trace():
    r = np.random.default_rng(3)
    books = [np.exp(1j * r.uniform(-np.pi, np.pi, (20, 512))) for _ in range(2)]
    signal = books[0][4] * books[1][17]
    for turn in (0.0, 0.5, np.pi / 2, np.pi):
        index, score, done, rounds, trace = kernels.resonator(signal * np.exp(1j * turn), books)
        assert index == [4, 17] and done and score > 0.95 and len(trace) == rounds
    held = kernels.resonator(signal, books, hysteresis=0.5, init=[b[0] + b[4] for b in books])
    assert held[0] == [4, 17]
    assert not kernels.resonator(np.exp(1j * r.uniform(-np.pi, np.pi, 512)), books, iters=5, floor=0.9)[2]
    for bad in (dict(iters=-1), dict(hysteresis=2.0), dict(floor=-1.0)):
        with pytest.raises(ValueError):
            kernels.resonator(signal, books, **bad)
    with pytest.raises(ValueError):
        kernels.resonator(signal * np.nan, books)


def test_product_books_and_butterfly():
    r = np.random.default_rng(4)
    axes = [kernels.grid_codebook(r.normal(size=256) * 4, np.linspace(-1, 1, 6)) for _ in range(3)]
    flat = kernels.product_codebook(axes)
    assert flat.shape == (216, 256) and np.allclose(flat[(2 * 6 + 5) * 6 + 1], axes[0][2] * axes[1][5] * axes[2][1])
    angles = r.uniform(-np.pi, np.pi, (5, 128))
    book = np.array([np.exp(1j * sum((angles[b] for b in range(5) if i >> (4 - b) & 1), np.zeros(128))) for i in range(32)])
    q = book[19] + 0.3 * book[5]
    scores = kernels.butterfly(q, angles)
    full = np.abs(book.conj() @ q) / 128
    assert sorted(np.round(scores, 9)) == sorted(np.round(full, 9))


def test_real_vectors_unbind_and_clean_up():
    r = np.random.default_rng(5)
    book = r.normal(size=(30, 1024)) / 32
    bound = kernels.circular_convolution(book[3], book[8])
    assert kernels.hrr_cleanup(kernels.hrr_unbind(bound, book[3]), book)[0] == 8
    assert kernels.hrr_cleanup(np.zeros(1024), book) == (0, 0.0)


def test_fit_with_fewer_rows_than_features(spark):
    space = Space(40)
    t = space.frequencies(spark, 2, 0.5)
    r = np.random.default_rng(6)
    data = [(i, float(x), float(y), float(np.cos(x) + y), float(y)) for i, (x, y) in enumerate(r.uniform(-1, 1, (200, 2)))]
    df = spark.createDataFrame(data, "id int, x double, y double, f double, g double")
    theta, field = regress.fit(df, ["x", "y"], ["f", "g"], t, 1e-6)
    few, _ = regress.fit(df.limit(30), ["x", "y"], ["f"], t, 1e-4)
    w = regress._table(t, 2)
    a = regress.design(np.array([d[1:3] for d in data]), w)
    y = np.array([d[3:5] for d in data])
    assert np.allclose(a.T @ (y - a @ theta), 1e-6 * 200 * theta, atol=1e-6)
    a, y = a[:30], y[:30, :1]
    assert few.shape == (81, 1) and np.allclose(a.T @ (y - a @ few), 1e-4 * 30 * few, atol=1e-6)
    got = regress.evaluate(df, "id", field, t, ["x", "y"], ["f", "g"], 40).join(df.withColumnsRenamed({"f": "tf", "g": "tg"}), "id")
    assert got.filter("abs(f - tf) > 0.01 or abs(g - tg) > 0.01").count() == 0
    assert np.allclose(regress.fit(df.limit(0), ["x", "y"], ["f"], t)[0], 0)


def test_camera():
    for view, up in (((1, 2, 2), "y"), ((0, 0, 1), "z"), ((0, 1, 0), "y")):
        v, a, b = render.camera(view, up)
        m = np.array([v, a, b])
        assert np.allclose(m @ m.T, np.eye(3))


def test_wide_splats_are_refused(spark):
    space = Space(8)
    df = spark.createDataFrame([(0.0, 0.0, 9.0, 1.0)], "x double, y double, s double, a double")
    with pytest.raises(Exception, match="wider"):
        render.encode_bands(df, render.band_books(space, spark, 2, 0.1, [0.2, 0.4]), ["x", "y"], "s", [0.2, 0.4], [1, 1], ["a"]).collect()


def test_bundles_as_bytes():
    r = np.random.default_rng(7)
    v = (r.normal(size=(3, 33)) + 1j * r.normal(size=(3, 33))).astype(np.complex64)
    assert (blobs.unpack_bundle(blobs.pack_bundle(v)) == v).all() and blobs.unpack_bundle(blobs.pack_bundle(v[0])).shape == (33,)
    assert np.abs(blobs.unpack_bundle(blobs.pack_bundle(v, "hg8")) - v).max() < 0.1
    for bad in (b"", b"HB" + b"\0" * 20, blobs.pack_bundle(v)[:-1], blobs.pack_bundle(v, "hg8")[:-1]):
        with pytest.raises(ValueError):
            blobs.unpack_bundle(bad)
    with pytest.raises(ValueError):
        blobs.pack_bundle(v, "zip")
    zero = blobs.unpack(blobs.pack(np.array([0j, 1 + 0j, -1j]), 8, "parts"))
    assert zero[0] == 0 and zero[1] == 1 and zero[2] == -1j
    head = blobs.pack(np.exp(1j * np.zeros(5)), 4)
    assert head[:8] == b"HP\x01\x04\x05\x00\x00\x00" and len(head) == 8 + 3 and head[8] == 0x88
    with pytest.raises(ValueError):
        blobs.pack(v[0], 1, "parts")


def test_stores_of_objects():
    t = np.array([[0.5, 1, 2, 0.25, 0.25, 0.5, 3], [1, 1, 1, 1, 1, 1, 0]])
    assert (blobs.decode_table(blobs.encode_table(t)) == t).all()
    v = np.exp(1j * np.linspace(0, 3, 64))
    whole, n = blobs.decode_store(blobs.encode_store(v, 7))
    four, _ = blobs.decode_store(blobs.encode_store(v, 7, 4))
    assert n == 7 and np.allclose(whole, v, atol=1e-6) and np.abs(four - v).max() < 0.15 and len(blobs.encode_store(v, 7, 4)) < len(blobs.encode_store(v, 7)) / 6
    with pytest.raises(ValueError):
        blobs.decode_table(blobs.encode_table(t)[:-1])


def test_colour_coefficients(spark):
    r = np.random.default_rng(8)
    d = r.normal(size=(200, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    basis = lambda x, y, z: np.stack([y, z, x, x * y, y * z, 3 * z * z - 1, x * z, x * x - y * y], 1)
    c = r.normal(size=8)
    assert np.allclose(basis(*d.T) @ c, basis(*(d * [1, -1, -1]).T) @ (c * captures.sh_half_turn(2)))
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0, 0.5, 0.5, 2.0)], "qw double, qx double, qy double, qz double, sx double, sy double, sz double")
    got = captures.covariances(df, 0.1, 1.0).first()
    q = np.array([1, 0, 0, 1]) / 2**0.5
    w, x, y, z = q
    m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    cov = m @ np.diag([0.25, 0.25, 1.0]) @ m.T
    assert np.allclose([got[f"c{i}{j}"] for i in range(3) for j in range(i, 3)], cov[np.triu_indices(3)])


def test_codecs(spark):
    v = Space(64).codewords(spark.createDataFrame([("a",), ("b",)], "label string"))
    curve = quantize.codec_curve(v, ["label"], [1, 2, 4, 8])
    got = {(r.kind, r.bits): r.rmse for r in curve.collect()}
    assert ("block", 1) not in got and all(got[k, 8] < got[k, 4] < got[k, 2] for k in ("phase", "polar", "block"))
    assert quantize.cheapest(curve, 0.1).first().bytes == min(b for (k, b) in [(k, {"phase": n / 8, "polar": n / 4, "block": n / 4 + 1 / 32}[k]) for (k, n), e in got.items() if e <= 0.1])
    assert quantize.cheapest(curve, 0.0).count() == 0
    with pytest.raises(ValueError):
        quantize.quant_block(v, ["label"], 32, 1)
    half = quantize.half_floats(spark.createDataFrame([(0.1,), (1e6,)], "x double"), ["x"]).collect()
    assert half[0].x == float(np.float16(0.1)) and half[1].x == float("inf")
    codes = quantize.palette(spark.createDataFrame([(float(i // 5 * 10 + i % 5), 0.0) for i in range(15)], "x double, y double"), ["x", "y"], 3)
    assert {tuple(sorted(r.x for r in codes.filter(codes.code == k).collect())) for k in range(3)} == {tuple(float(10 * g + i) for i in range(5)) for g in range(3)}


def test_long_paragraphs_stay_whole(spark):
    long = "word " * 1000
    docs = spark.createDataFrame([("f", f"# A\n\nshort one\n\n{long}\n\nshort two\n")], "f string, t string")
    got = textual.chunks(textual.paragraphs(docs, "f", "t"), "f").orderBy("l0").collect()
    assert [len(r.body) for r in got] == [len("short one"), len(long.strip()), len("short two")]


def test_chains_of_any_length(spark):
    claims = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(201)] + [("x", "y"), ("y", "x")], "id string, supersedes string")
    got = textual.supersession(claims)
    assert got.filter("root = 'c200'").count() == 201 and got.filter("root = 'x'").count() == 2


def test_keys_with_gaps_lose_no_pair(spark):
    pts = spark.createDataFrame([(i * 17 + 5, float(i), 0.0) for i in range(30)], "k long, x double, y double")
    assert studies.sampled_distances(pts, "k", ["x", "y"], 300).count() == 300
    assert studies.sampled_distances(pts.limit(0), "k", ["x", "y"], 300).count() == 0


def test_texts(spark):
    docs = spark.createDataFrame([(1, '---\ntitle: "A b"\nTags: x\nnot a pair\ntitle: c\n---\nbody: no'), (2, "title: no\n---\n"), (3, None), (4, "---\nopen: yes")], "k int, t string")
    assert rows(textual.front_matter(docs, "k", "t"), "name") == [(1, "Tags", "x"), (1, "title", "c")]
    code = spark.createDataFrame([("a.py", '"""Doc\n  of it."""\nx = 1  # one\n# two\n# three\ndef f():\n    "inner"\n'), ("b.py", "def broken(:\n# kept\n"), ("c.py", None)], "k string, t string")
    got = {tuple(r) for r in textual.python_paragraphs(code, "k", "t").collect()}
    assert {("a.py", 1, "docstring", "Doc of it."), ("a.py", 7, "docstring", "inner"), ("b.py", 2, "comment", "kept")} <= got
    assert any(r[0] == "a.py" and r[2] == "comment" and "two three" in r[3] for r in got)
    plain = spark.createDataFrame([(1, "a\nb\n\n  \n\nc  d"), (2, ""), (3, None)], "k int, t string")
    assert [r[2] for r in rows(textual.plain_paragraphs(plain, "k", "t"), "k", "part")] == ["a b", "c d"]
    files = spark.createDataFrame([("f", "text one"), ("g", "text two")], "k string, t string")
    index = textual.build_index(spark.createDataFrame([("f", "chunk"), ("g", "chunk")], "k string, body string"), files, "k", "t")
    later = spark.createDataFrame([("f", "text one"), ("g", "changed")], "k string, t string")
    assert [r.stale for r in textual.stale(index, later, "k", "sha256", "t").orderBy("k").collect()] == [False, True]
    assert textual.stale(index, later.limit(0), "k", "sha256", "t").filter("stale").count() == 2


def test_claims_helpers(spark):
    claims = spark.createDataFrame([("a", ["f", "g"]), ("b", ["h"]), ("c", None)], "id string, cites array<string>")
    files = spark.createDataFrame([("f",)], "file string")
    assert rows(textual.missing_citations(claims, files), "file") == [("a", "g"), ("b", "h")]
    a, b = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, score double"), spark.createDataFrame([("y", 3.0), ("z", 4.0)], "k string, score double")
    assert rows(textual.both_scores(a, b, "k", 0.5), "k") == [("x", 1.0), ("y", 3.5), ("z", 2.0)]
    cos = spark.createDataFrame([(1, c, s) for c, s in (("p", 0.9), ("q", 0.8), ("r", 0.7), ("s", 0.6), ("t", 0.1))] + [(2, "p", 0.9)], "probe int, chunk string, cos double")
    got = studies.fuzzy_findings(spark.createDataFrame([(1,)], "probe int"), "probe", cos, "chunk", spark.createDataFrame([(1, "q")], "probe int, chunk string"), 0.2)
    assert [r[1] for r in rows(got, F.desc("cos"))] == ["p", "r", "s"]


def test_structure(spark):
    files = spark.createDataFrame([("lib/a.py", "core"), ("lib/b.py", "core"), ("lib/__init__.py", "core"), ("tests/test_a.py", "test"), ("tests/test_gone.py", "test"), ("app/c.py", "app"), ("app/README.md", "app")], "path string, lane string")
    imports = spark.createDataFrame([("lib/a.py", "app/c.py"), ("app/c.py", "lib/a.py")], "src string, dst string")
    got = rows(graphs.structure_errors(files, imports, spark.createDataFrame([("core", "app")], "src_lane string, dst_lane string")), "path", "rule")
    assert got == [("app/c.py", "untested"), ("lib", "no README"), ("lib/a.py", "forbidden import"), ("lib/b.py", "untested"), ("tests/test_gone.py", "orphan test")]


def test_change_helpers(spark):
    pts = spark.createDataFrame([(i, float(i % 7), float(i // 7), 2.0) for i in range(49)], "k long, x double, y double, w double")
    two = studies.split_some(pts, "k", ["x", "y"], "w", 0.5, 0.1)
    assert two.agg(F.sum("w")).first()[0] == 98.0 and 49 < two.count() < 98
    box = change.core_box(pts, ["x", "y"], "w", 1.0).first()
    assert (box.x_low, box.x_high) == (0.0, 6.0)
    none = change.distance_change(pts, "k", pts.limit(0), pts, "k", ["x", "y"], 0.5)
    assert none.filter("change <> 0.5").count() == 0
    tiles = spark.createDataFrame([(1, 0.0, 1, 1), (2, 9.0, 1, 0), (3, 9.0, 1, 1)], "t int, score double, before int, after int")
    nulls = spark.createDataFrame([(1, 5.0), (1, 5.1), (3, 8.0)], "t int, score double")
    assert [r.change for r in change.tile_change(tiles, ["t"], nulls).orderBy("t").collect()] == [True, True, False]
    space = Space(64)
    t = space.frequencies(spark, 2, 1.0)
    zero = fields.encode(pts.withColumn("w", F.lit(0.0)), t, ["x", "y"], ["w"]).withColumnsRenamed({"w_re": "re", "w_im": "im"})
    assert change.find_shift(zero, zero, t, ["x", "y"], 1.0, 2, 0)[1] == 0.0


def test_budget_is_kept(spark):
    df = spark.createDataFrame([(3,), (4,)], "n int")
    assert studies.refuse_over(df, F.col("n"), 7, "cells").count() == 2
    with pytest.raises(Exception, match="over the budget"):
        studies.refuse_over(df, F.col("n"), 6, "cells").count()


def test_shares_and_pairs(spark):
    assert abs(studies.null_share(1.0) - 1.0) < 1e-9 and studies.null_share(0.01) > 0.01
    best = analytics.best_per_pair(spark.createDataFrame([("a", "b", 1, 0.5), ("a", "b", 2, 0.5), ("a", "c", 3, 0.1)], "p string, q string, t int, s double"), ["p", "q"], "s", ["t"])
    assert rows(best.select("p", "q", "t"), "q") == [("a", "b", 1), ("a", "c", 3)]
    log = spark.createDataFrame([(1, 1, "k", 1.0), (1, 3, "k", 4.0), (1, 2, "k", 9.0)], "peer int, counter int, c string, value double")
    assert replicate.latest(log, ["c"], "value").first().value == 4.0 and replicate.grow_only(log, ["c"]).count() == 1


def test_kept_tables_go(spark, tmp_path):
    import os

    from phasorlake import plans

    a, b = plans.keep(spark.range(3), "a"), plans.keep(spark.range(4), "b")
    assert a.count() == 3 and os.path.isdir(a._kept_path)
    plans.drop(spark, a, None)
    assert not os.path.isdir(a._kept_path) and os.path.isdir(b._kept_path)
    plans.drop_all()
    assert not os.path.isdir(b._kept_path)


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace

    from phasorlake import plans

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "s3://x/y/"), sparkContext=SimpleNamespace(master="spark://h:1"))
    assert plans.shared_dir(named) == "s3://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        plans.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://h:1")))


def test_projection_of_cells(spark):
    r = np.random.default_rng(9)
    a = r.normal(size=(12, 6)) + 1j * r.normal(size=(12, 6))
    gram = a.conj().T @ a
    b = r.normal(size=(3, 6)) + 1j * r.normal(size=(3, 6))
    df = spark.createDataFrame([(i, x.real.tolist(), x.imag.tolist()) for i, x in enumerate(b)], "c int, re array<double>, im array<double>")
    for x in kernels.project_cells(df, ["c"], gram, 1e-12).collect():
        assert np.allclose(gram @ (np.array(x.re) + 1j * np.array(x.im)), b[x.c])
    low = kernels.band_operator(gram, keep=0.5)
    assert np.linalg.matrix_rank(low) < 6 and np.linalg.matrix_rank(kernels.band_operator(gram, tikhonov=1.0)) == 6
    assert not kernels.band_operator(np.zeros((4, 4))).any() and not kernels.band_operator(np.zeros((4, 4)), keep=0.9).any()
    with pytest.raises(kernels.Diverged):
        kernels.project_cells(df, ["c"], gram * 1e-6, 1e-12, most=10.0)


def test_kernels_agree(spark):
    space = Space(64)
    t = space.frequencies(spark, 3, 0.5)
    from phasorlake.operators import generate

    s = generate.random_scene(spark, 200, 3)
    f = fields.encode(s, t, ["x", "y", "z"], ["alpha", "scale"])
    a = {r.id: (r.alpha, r.scale) for r in fields.decode(s, "id", f, t, ["x", "y", "z"], ["alpha", "scale"], 64).collect()}
    b = {r.id: (r.alpha, r.scale) for r in fields.decode(s, "id", f, t, ["x", "y", "z"], ["alpha", "scale"], 64, kernel="arrow").collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i]) for i in a)
    q = generate.random_quaternions(spark, 500)
    assert q.filter("abs(qw*qw + qx*qx + qy*qy + qz*qz - 1) > 1e-9").count() == 0


def test_manifests_and_sweeps(spark, tmp_path):
    import json

    from phasorlake.sources import records

    rows = lambda spark, path: spark.createDataFrame([(float(path), 0.0, 0.0, 1.0, 1.0, 1.0, "a"), (5.0, 0.0, 0.0, 1.0, 1.0, 1.0, "b")], "x double, y double, z double, ex double, ey double, ez double, label string")
    got = records.load_manifest(spark, [{"kind": "k", "path": "1"}, {"kind": "k", "path": "2", "low": [0, 0, 0], "high": [3, 0, 0]}], {"k": rows})
    assert sorted(r.x for r in got.collect()) == [1.0, 2.0, 5.0]
    for bad in ([], [{"kind": "other", "path": "1"}]):
        with pytest.raises(ValueError):
            records.load_manifest(spark, bad, {"k": rows})
    sweep = [{"scene": "s", "splats_encoded": 10, "cells": 5, "cells_per_band": {"a": 2, "b": 3}}]
    (tmp_path / "good.json").write_text(json.dumps(sweep))
    (tmp_path / "bad.json").write_text(json.dumps([{**sweep[0], "cells": 6}]))
    assert records.read_sweep(spark, str(tmp_path / "good.json")).first().cells_per_band == {"a": 2, "b": 3}
    with pytest.raises(Exception, match="add up"):
        records.read_sweep(spark, str(tmp_path / "bad.json")).collect()


def test_runs_and_views(spark):
    log = graphs.run_events(spark, "r1", "build", "2024-01-01", "ok", 2.0).unionByName(graphs.run_events(spark, "r2", "build", "2024-01-02"))
    assert {r.run: r.status for r in graphs.runs(log).collect()} == {"r1": "done", "r2": "killed"}
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    graphs.register(nodes, edges)
    assert spark.sql("SELECT name FROM code_nodes LEFT ANTI JOIN code_edges ON name = dst").first().name == "a"


def test_image_layout_is_a_raster(spark):
    from phasorlake.operators import generate

    s = generate.random_scene(spark, 300, 3)
    got = quantize.image_layout(s, "id", ["x", "y", "z"], ["scale"], 16, 20).collect()
    assert sorted((r.line, r.col) for r in got) == [(i // 20, i % 20) for i in range(300)]
    assert {r.scale_code for r in got} == set(range(16)) and all(0 <= r.x_code <= 65535 for r in got)


def test_kernels_cut_their_batches(spark):
    """F8, F9, F12: texts are looked at in small slices, and counts of one key are added up over them."""
    from collections import Counter

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": list(range(600))})
    parts = list(structures.slices([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [256, 256, 88] and [x for p in parts for x in p.column(0).to_pylist()] == list(range(600))
    texts = [(i % m, "abc" * (i % 5) + "xyz"[: i % 4]) for m in (2, 400) for i in range(700)]
    for m in (2, 400):
        part = texts[:700] if m == 2 else texts[700:]
        want = Counter((k, t[a : a + 3]) for k, t in part for a in range(len(t) - 2))
        got = structures.ngrams(spark.createDataFrame(part, "k int, t string").coalesce(1), "k", "t").collect()
        assert {(r.k, r.gram): r.n for r in got} == dict(want)


def test_short_machines_are_run_once(spark):
    """only machines of several blocks are run from every state."""
    rules = spark.createDataFrame([("x", "a", "y"), ("y", "a", "x")], "state string, symbol string, after string")
    data = [(m, p, "a") for m, n in ((1, 3), (2, 9)) for p in range(1, n + 1)] + [(None, 1, "a")]
    out = structures.fsm_run(spark.createDataFrame(data, "m int, p long, a string"), "m", "p", "a", rules, "x", block=4)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.m, r.position): r.state for r in out.collect()} == {(m, p): "xy"[p % 2] for m, p, _ in data if m}
