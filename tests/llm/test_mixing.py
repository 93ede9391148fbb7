import hashlib
import random

from phasorlake.llm.mixing import emit, mix, mix_words

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def brute(sizes):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def rows(seed=1):
    r = random.Random(seed)
    names = ["b", "a", "é", "ZZ", None, "", "c10", "c9", "\U0001f600", "zz"]
    out = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(names if i % 3 else ["hot"]), "clash", 7) for i in range(900)]
    return out + [(900, None, "empty", None, None), (901, " \n\t", "empty", None, None), (None, "a\x0bb\x1fc d e", "a", None, None), (5, "x y", "hot", None, None)]


def test_targets_and_draws(spark):
    data = rows()
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s, *_ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, got = brute(sizes), mix_words(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    by_size = {r[0]: r for r in got}
    taken = {}
    for d, t, s, *_ in data:
        if d == 5 or d is None:
            continue
        r = by_size[d]
        assert (r.size, r.source_size) == (size(t), sizes[s])
        assert abs(r.target - want[s]) < 1e-6
        u = int(hashlib.md5(f"mix|{d}".encode()).hexdigest()[:12], 16) / 16**12
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert r.taken == r.size * (int(rate) + (u < rate % 1))
        assert r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert abs(taken["hot"] - want["hot"]) < 0.2 * want["hot"]


def test_emit_repeats_documents(spark):
    mixed = mix(spark.createDataFrame(rows(2), SCHEMA))
    want = {}
    for r in mixed.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {r.doc_id: r["count"] for r in emit(mixed).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_empty_table_and_no_words(spark):
    assert mix_words(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mix_words(spark.createDataFrame([(1, None, None, "", 0)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0.0, 0)]
