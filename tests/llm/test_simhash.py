import random

import xxhash

from phasorlake.llm.components import components
from phasorlake.llm.simhash import as_hex, fingerprint, links, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component_id long"


def slow(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def rows():
    r = random.Random(4)
    base = [[f"W{r.randint(0, 500)}É" for _ in range(400)] for _ in range(8)]
    out = []
    for i in range(90):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 30])):
            w[r.randrange(len(w))] = "changed%d" % r.randint(0, 3)
        out.append((1000 - i, " ".join(w), "clash", 3))
    return out + [(1, None, None, None), (2, "", None, None), (3, " \t\n", None, None), (4, "one", None, None), (5, "ONE", None, None), (6, "one two", None, None), (None, out[0][1], None, None), (1000, out[0][1], None, None)]


def test_fingerprints():
    for _, t, *_ in rows():
        assert fingerprint(t) == slow(t)
    assert fingerprint("a b c d " * 40000) == slow("a b c d " * 40000)


def test_against_all_pairs(spark):
    data = rows()
    got = near_duplicates(spark.createDataFrame(data, SCHEMA)).select("doc_id", as_hex("fp").alias("fp"), "component_id").collect()
    assert len(got) == len(data)
    ids = sorted({d for d, *_ in data if d is not None})
    fp = {d: slow(t) for d, t, *_ in data}
    want = roots(ids, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp, r.component_id) == (f"{fp[r.doc_id]:016x}", want[r.doc_id])
        else:
            assert r.component_id == want[1000]


def test_links_are_complete(spark):
    r = random.Random(8)
    seeds = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for s in seeds for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius in (1, 2, 3):
        edges = links(df, radius)
        want = roots(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius)
        got = {x.node: x.root for x in components(edges).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {500: 500, 501: 500}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_forest_keeps_all_groups():
    import numpy as np

    from phasorlake.llm.simhash import forest

    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(5)}
    for _ in range(80):
        fps.add(r.choice(sorted(fps)) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 8))))
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    for limit in (2, 5, 9):
        edges = [(a, b) for a, b in forest(signed, 9) if ((a ^ b) % 2**64).bit_count() <= limit]
        got = roots(sorted(signed.tolist()), lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
        want = roots(sorted(signed.tolist()), lambda a, b: ((a ^ b) % 2**64).bit_count() <= limit)
        assert got == want and len(edges) < len(signed)


def test_one_of_each_by_shingles(spark):
    from phasorlake.llm.simhash import one_of_each

    r = random.Random(12)
    texts, kin = [], []
    for g in range(40):
        w = [f"{g}w{r.randint(0, 300)}" for _ in range(r.randint(150, 500))]
        texts.append(" ".join(w))
        kin.append(g)
        for _ in range(r.randint(0, 3)):
            x = list(w)
            for _ in range(r.randint(1, max(1, len(w) // 60))):  # similarity of 0.83 and more
                x[r.randrange(len(x))] = "other"
            texts.append(" ".join(x).upper() if r.random() < 0.3 else " ".join(x))
            kin.append(g)
    half = [" ".join(t.split()[: len(t.split()) // 2]) for t in texts[:10]]  # far from its whole
    data = [(i, t, "c", i) for i, t in enumerate(texts + half)] + [(900, None, "c", 1), (901, "", "c", 1), (None, texts[0], "c", 1), (902, "a b", "c", 1), (903, "A B", "c", 2)]
    left = one_of_each(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    ids = {x.doc_id for x in left}
    firsts = {kin.index(g) for g in range(40)}
    assert firsts <= ids and {900, 902} <= ids and not {901, 903, None} & ids
    assert len([i for i in range(len(texts)) if i in ids]) <= len(firsts) + 0.1 * (len(texts) - len(firsts))
    whole = {i for i in range(len(texts), len(texts) + 10)}
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in enumerate(texts + half)}
    for i in whole - ids:  # a half goes only for another half like it
        assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in whole & ids)
    assert [x.component_id for x in left if x.doc_id == 902] == [1]


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_loses_no_link_at_the_limit(spark):
    from phasorlake.llm.simhash import one_of_each

    r = random.Random(3)
    texts = []
    for g in range(60):  # pairs that are just over, or just under, 0.8 of each other
        w = [f"{g}w{k}" for k in range(r.randint(90, 240))]
        x = list(w)
        for k in range(2, 2 + 8 * (len(w) // 80), 8):
            x[k] = "other"
        while len(five(" ".join(w)) & five(" ".join(x))) >= 0.8 * len(five(" ".join(w)) | five(" ".join(x))):
            w, x = w[:-1], x[:-1]
        over = " ".join(f"{g}w{k}" for k in range(len(w), len(w) + r.randint(0, 3)))
        texts += [" ".join(w) + " " + over, " ".join(x) + " " + over]
    # over half of these shingles are one and the same, so their fingerprints are equal; little else is
    texts += ["na " * 90 + " ".join(f"{g}z{k}" for k in range(40)) for g in range(4)]
    texts += [" ".join(f"c{k}" for k in range(i, i + 60)) for i in range(0, 24, 3)]  # a chain: neighbours are alike, its ends aren't
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"{i}q{k}" for k in range(80)) for i in range(50)]  # a passage of many texts
    sets = [five(t) for t in texts]
    want = roots(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert 20 < sum(k != v for k, v in want.items()) < 100
    data = [(i, t, "c", i) for i, t in enumerate(texts)]
    got = one_of_each(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert sorted(x.doc_id for x in got) == sorted(set(want.values()))


def test_first_shingles_and_parities_allow_every_link():
    import numpy as np

    from phasorlake.llm.simhash import met_pairs, parities, prefix

    r = np.random.default_rng(2)
    heavy = None
    for _ in range(300):
        n, common_ = int(r.integers(1, 400)), r.integers(0, 2**64, 500, np.uint64)
        same = common_[:n]
        rest = int(n / 0.8) - n  # the union is as large as the limit allows
        cut = int(r.integers(0, rest + 1))
        a, b = (np.unique(np.r_[same, r.integers(0, 2**64, k, np.uint64)]) for k in (cut, rest - cut))
        heavy = np.sort(common_[::2]) if r.random() < 0.5 else np.empty(0, np.uint64)
        assert len(np.intersect1d(prefix(a, heavy, 0.8), prefix(b, heavy, 0.8))) >= 1
        assert np.bitwise_count(parities(a) ^ parities(b)).sum() <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-6
    h, node, size = r.integers(0, 40, 400), np.arange(400) * 7, r.integers(80, 120, 400)
    comp, rank = np.where(r.random(400) < 0.5, node, r.integers(0, 5, 400)), r.integers(0, 20, 400)
    got = {(int(a), int(b)) for part in met_pairs(h, node, comp, size, rank, 0.8) for a, b in zip(*part)}
    alike = lambda i, j: h[i] == h[j] and comp[i] != comp[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and 9 * min(size[i] - rank[i], size[j] - rank[j]) >= 4 * (size[i] + size[j])
    assert got == {(int(node[i]), int(node[j])) for i in range(400) for j in range(i + 1, 400) if alike(i, j)}


def test_parities_tell_large_sets_apart():
    import numpy as np

    from phasorlake.llm.simhash import odd_cells, parities

    r = np.random.default_rng(5)
    for n in (2000, 4096, 5000, 20_000):
        a, b = (np.unique(r.integers(0, 2**64, n, np.uint64)) for _ in range(2))
        assert odd_cells(parities(a), parities(b)) > (len(a) + len(b)) * 0.2 / 1.8
        # alike sets, also where one has twice the cells, stay
        for cut in (0, n // 10, n // 5 - 1):
            assert odd_cells(parities(a), parities(a[cut:])) <= cut
            assert odd_cells(parities(a[cut:]), parities(a)) <= cut
    a = np.unique(r.integers(0, 2**64, 4100, np.uint64))
    assert len(parities(a)) == 2 * len(parities(a[10:]))


def test_kept_tables_leave_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from phasorlake.llm import common

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(x) for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = files()
    df = spark.range(20_000).groupBy(F.xxhash64("id").alias("h")).count()
    kept = common.keep(df)
    until = time.time() + 5
    while (left := files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert kept.count() == df.count() == 20_000  # what was kept can be worked out again
    common.drop(spark, kept)


def test_crowded_shingles_make_few_pairs(spark, monkeypatch):
    from phasorlake.llm import common, simhash

    r = random.Random(21)
    passages = [[f"{p}p{k}" for k in range(60)] for p in range(6)]
    texts = []
    for i in range(240):  # 40 texts share each passage, of which the sample sees few
        texts.append([f"{i}w{k}" for k in range(140)] + passages[i % 6])
    for i in range(30):  # like one of them, some at little over 0.8
        w = list(r.choice(texts[:240]))
        for k in r.sample(range(len(w)), r.randint(1, 4)):
            w[k] = "other"
        texts.append(w)
    texts = [" ".join(w) for w in texts]
    sets = [five(t) for t in texts]
    want = roots(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    pairs, keep = [], common.keep

    def counted(df, label="kept"):
        out = keep(df, label)
        if label == "met":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "SAMPLE", 4)
    monkeypatch.setattr(common, "keep", counted)
    data = spark.createDataFrame([(i, t, "c", i) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = simhash.one_of_each(data).select("doc_id").collect()
    assert sorted(x.doc_id for x in got) == sorted(set(want.values()))
    assert pairs[-1] <= len(texts)  # 6 x 40 x 39 / 2 = 4680 pairs share a passage


def test_late_shingles_by_join_as_by_array(spark):
    import numpy as np

    from phasorlake.llm.simhash import prefix, reordered

    r = np.random.default_rng(6)
    pool = np.unique(r.integers(0, 2**64, 400, np.uint64))
    late = np.sort(r.choice(pool, 150, replace=False))
    sets = {i: np.sort(r.choice(pool, n, replace=False)) for i, n in enumerate((1, 2, 5, 40, 99, 300))}
    sets[6] = late[:60]
    rows = [(i, x.view(np.int64).tolist()) for i, x in sets.items()]
    df = spark.createDataFrame(rows, "node long, shingles array<long>")
    got = reordered(df, spark.createDataFrame([(int(h),) for h in late.view(np.int64)], "h long"), 0.8).collect()
    assert {x.node: x.firsts for x in got} == {i: prefix(x, late, 0.8).view(np.int64).tolist() for i, x in sets.items()}
