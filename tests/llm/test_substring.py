import hashlib
import random
from collections import Counter

from phasorlake.llm import common
from phasorlake.llm.substring import RunIndex, substring_dedup

SCHEMA = "doc_id long, text string, key string, h int"


def brute(rows, width):
    docs = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in docs for i in range(len(w) - width + 1))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def rows(n=60, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é x", " ", "a.b"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(30, 80))] for _ in range(6)]
    out = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            at, p = r.randint(0, len(w)), r.choice(passages)
            w[at:at] = p[r.randint(0, 5) :]
        out.append((i, r.choice([" ", "\n", "\t "]).join(w), "k", 1))
    out += [(100, out[0][1], "k", 1), (101, out[0][1] + " tail", "k", 1), (102, None, "k", 1), (103, "", None, None), (104, "For " * 300, "k", 1), (105, "x", "k", 1)]
    out += [(None, out[1][1], "k", 1), (106, out[2][1], "k", 1), (106, out[2][1], "k", 1), (None, "only here " * 3, "k", 1)]
    # one doc_id with several texts, rows without doc_id, the same words with other white space
    out += [(1, out[3][1], "k", 1), (1, out[4][1] + " x", "k", 1), (None, out[4][1], "k", 1), (None, out[5][1], "k", 1), (None, out[5][1], "k", 1), (107, out[6][1].replace(" ", "  "), "k", 1)]
    return out


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    assert got(substring_dedup(df)) == brute(data, 35)
    assert got(substring_dedup(df, width=12, seed=5, batches=3)) == brute(data, 12)


def test_width_equal_to_seed_and_one_document(spark):
    data = [(1, "a b c a b c a b c d", "", 0)]
    assert got(substring_dedup(spark.createDataFrame(data, SCHEMA), width=3, seed=3, batches=1)) == brute(data, 3)


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_incremental_judges_against_history(spark):
    data = rows(40, 9)
    first, second = data[:25], data[25:]
    a, b = spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA)
    index = RunIndex(spark, width=20, seed=6, fanout=2)
    index.add(a.filter("doc_id % 2 = 0"))
    index.add(a.filter("doc_id % 2 = 1 or doc_id is null"))
    assert [lv for lv, _ in index.runs] == [1]
    reopened = RunIndex(spark, index.path, width=20, seed=6, fanout=2)
    assert reopened.runs == index.runs and len(reopened.segments) == 2
    out = got(substring_dedup(b, batches=1, index=reopened, history=a))
    assert out == sorted(ordered_brute(data, 20)[25:], key=str)


def test_runs_are_merge_joined_as_they_lie(spark):
    """Neither an exchange nor a sort on the run's side of the join, and no old document is read."""
    data = rows(40, 9)
    index = RunIndex(spark, width=20, seed=6, fanout=9)
    index.add(spark.createDataFrame(data[:25], SCHEMA))
    run = index.runs[0][1]
    wanted = index.run(run).select("seed").distinct()
    asked = spark.createDataFrame(wanted.collect(), wanted.schema)
    with index._ordered():
        plan = index._merged(asked, run)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    side = join[: join.index("FileScan")]
    assert "Exchange" not in side and "Sort " not in side and f"SelectedBucketsCount: {index.buckets} out of {index.buckets}" in plan
    common.drop(spark, index.segments[0])  # what an increment doesn't need
    second = spark.createDataFrame(data[25:], SCHEMA)
    out = got(substring_dedup(second, batches=1, index=index, history=spark.createDataFrame(data[:25], SCHEMA)))
    assert sorted(out, key=str) == sorted((w for w, r in zip(ordered_brute(data, 20), data) if r in data[25:]), key=str)
    index.clear()
    assert not index._exists(index.path)


def ordered_brute(data, width):
    """As brute, in the order of the rows."""
    by = {}
    for r in data:
        by.setdefault((r[0], r[1]), []).append(r)
    done = brute([((i, d), t) for i, (d, t, *_) in enumerate(data)], width)
    return [(w[0][1], *w[1:]) for w in sorted(done, key=lambda w: w[0][0])]


def test_text_out_and_spans(spark):
    data = [r for i, r in enumerate(rows()) if r[0] not in {x[0] for x in rows()[:i]}]
    df = substring_dedup(spark.createDataFrame(data, SCHEMA), width=12, seed=5, text_out=True)
    texts = {r[0]: (r[1] or "").encode().split() for r in data}
    for r in df.collect():
        if r.doc_id is None:
            continue
        w, gone = texts[r.doc_id], set()
        for a, b in zip(r.spans[::2], r.spans[1::2]):
            gone |= set(range(a, b))
        assert len(gone) == r.n_removed
        assert (r.kept is None) == (r.n_removed == 0)
        if r.kept is not None:
            assert r.kept.encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)
