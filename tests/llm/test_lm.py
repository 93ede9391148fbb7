import math
import random
from collections import Counter

import numpy as np

from phasorlake.llm import lm

SCHEMA = "doc_id long, text string, n_tokens string, w int"


def prose(r, n):
    """Words that follow each other in a fixed round, now and then another."""
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "then"]
    return " ".join(words[i % 8] if r.random() < 0.9 else r.choice(["dogs", "run", "fast"]) for i in range(n))


def rows():
    r = random.Random(1)
    return [(i, prose(r, 400), "x", 1) for i in range(100)] + [(500, None, None, None), (501, "", "x", 1), (502, " \n", "x", 1), (None, "The cat", "x", 1), (503, " ".join(random.Random(2).sample(prose(r, 400).split(), 400)), "x", 1), (504, "one", "x", 1)]


def class_log_prob(net, ids, token, i, reach=lm.REACH):
    """The log probability of one token's class, by the formula, from the classes around it."""
    h = np.tanh(sum(net.inner[k][ids[j] if 0 <= (j := i + d) < len(ids) else 0] for k, d in enumerate(x for x in range(-reach, reach + 1) if x)))
    a, b = divmod(token, lm.SIDE)
    out = 0
    for z, at in ((h @ net.outer_a + net.bias_a + net.none, a), (h @ net.outer_b + net.bias_b[a] + net.none_of[a], b)):
        out += z[at] - math.log(np.exp(z).sum())
    return max(out, net.floor)


def spelled(counts, word):
    """The log probability of a word's bytes and end, by the formula."""
    out, w = 0.0, [256, 256, *word, 256]
    for i in range(2, len(w)):
        context = (w[i - 2] * 37 + w[i - 1]) % lm.CONTEXTS
        follow = Counter()
        for x, n in counts.items():
            y = [256, 256, *x, 256]
            for k in range(2, len(y)):
                if (y[k - 2] * 37 + y[k - 1]) % lm.CONTEXTS == context:
                    follow[y[k]] += n
        out += math.log((follow[w[i]] + 0.5) / (sum(follow.values()) + 257 * 0.5))
    return out


def brute(data, scorer, counts):
    """Scores in plain Python: priors, and the memory from tuples of words."""
    total = sum(counts.values())
    order = sorted((w for w, n in counts.items() if n * lm.KNOWN >= total), key=lambda w: (-counts[w], w))
    place = {w: i + 1 for i, w in enumerate(order[: lm.FREQUENT])}
    others = {w: lm.other_class(w, len(place)) for w in order[lm.FREQUENT :]}
    sizes, rarer, spelling = Counter(), {w: n for w, n in counts.items() if w not in place and w not in others}, {}
    for w, c in others.items():
        sizes[c] += counts[w]
    words = scorer.words()
    memory, spots, out = Counter(), [], []
    for _, t, *_ in data:
        ws = lm._tokens(t)
        at, _ = words.code([t]).remembered(lm.REACH)
        pad = [None] * 2 + ws + [None] * 2
        spots.append({i: ((*pad[i : i + 2], *pad[i + 3 : i + 5]), ws[i]) for i in at.tolist()})
        memory.update(spots[-1].values())
    windows = Counter()
    for (window, _), n in memory.items():
        windows[window] += n
    for (_, t, *_), spot in zip(data, spots):
        ws = lm._tokens(t)
        around = [place.get(w, lm.other_class(w, len(place))) for w in ws]
        score = 0.0
        for i, w in enumerate(ws):
            token = place.get(w) or others.get(w, lm.RARER)
            if token == lm.RARER and w not in spelling:
                spelling[w] = spelled(rarer, w)
            p = class_log_prob(scorer.network, around, token, i) + (0 if w in place else math.log(counts[w] / sizes[token]) if w in others else spelling[w])
            if i in spot and (m := windows[spot[i][0]]) > 1:
                p = math.log((math.exp(p) + memory[spot[i]] - 1) / m)
            score += p
        out.append((len(ws), score))
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 6)
    monkeypatch.setattr(lm, "KNOWN", 1 << 9)
    data = rows()
    # words of one ending, so of one class; a passage that comes twice; repeated rows
    data += [(520, "aing " * 200, "", 1), (521, "bing " * 3, "", 1), (522, "zqing", "", 1), (523, "bing zqing x", "", 1)]
    passage = " ".join(f"w{i}q" for i in range(60))
    data += [(530, passage, "", 1), (531, "up " + passage + " down", "", 1), (532, passage.replace("w30q", "other"), "", 1), (533, "one", "", 1), (533, "one", "", 1)]
    data += [(540 + k, " ".join(f"w{r}q" for r in random.Random(k).sample(range(60), 60)), "", 1) for k in range(3)]  # the same words, in other orders
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    scorer = lm.train(df)
    assert b"aing" in scorer.known and b"bing" not in scorer.known and len(scorer.frequent) == 6
    counts = Counter(w for r in data for w in lm._tokens(r[1]))
    probes = data + [(600, "never qqing seen the cat", "", 1)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.log_prob, r.per_token) for r in lm.lm_score(spark.createDataFrame(probes, SCHEMA).repartition(4), scorer).collect())
    want = sorted((-1 if d[0] is None else d[0], n, s) for d, (n, s) in zip(probes, brute(probes, scorer, counts)))
    assert len(got) == len(want)
    for (d, n, score, each), (d2, n2, s2) in zip(got, want):
        assert (d, n) == (d2, n2) and abs(score - s2) < 1e-4 * (1 + n) and (each is None) == (not n)
    score = {d: each for d, _, _, each in got}
    assert min(score[530], score[531]) > score[540] + 0.5  # remembered elsewhere


def test_every_word_has_a_probability_and_they_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 1 << 12)
    monkeypatch.setattr(lm, "FREQUENT", 20)
    df = spark.createDataFrame(rows() + [(700 + i, f"rare{i} more{i}ing " + f"often{i}ing " * 20, "", 1) for i in range(50)], SCHEMA)
    scorer = lm.train(df)
    place = {w: i + 1 for i, w in enumerate(scorer.frequent)}
    for around in ([0, 0, 0, 0], [1, 2, 3, 4], [600, 0, 1, 900]):
        every = np.arange(lm.CLASSES)
        _, _, (ea, eb), (sa, sb) = scorer.network.forward([np.full(lm.CLASSES, x) for x in around], every // lm.SIDE)
        p = ea[every, every // lm.SIDE].astype(float) / sa * eb[every, every % lm.SIDE] / sb
        each = [p[c] for c in place.values()] + [p[lm.other_class(w, len(place))] * math.exp(x) for w, x in scorer.known.items()] + [p[lm.RARER]]
        assert len(each) > 60 and min(each) > 0 and abs(sum(each) - 1) < 1e-5 and p[0] == 0
    assert np.allclose(np.exp(scorer.spelling.table).sum(1), 1)
    good = scorer.spelling.log_probs([b"rare7", b"re7ra", b"more8ing", b"zzzzzzz", b""])
    assert good[0] > good[1] and good[2] > good[3] and np.isfinite(good).all()


def test_weights_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 9000)
    df = spark.createDataFrame(rows(), SCHEMA)
    got = []
    for n in (1, 7):
        got.append(sorted((-1 if r.doc_id is None else r.doc_id, r.log_prob) for r in lm.lm_score(df.repartition(n, "text")).collect()))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 1e-9 * max(1, abs(a[1])) for a, b in zip(*got))


def test_training_learns_the_order(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    scorer = lm.train(df)
    got = {r.doc_id: r for r in lm.lm_score(df, scorer).collect()}
    # order matters: a shuffled text scores worse than those in order, which beat the tokens' own shares
    assert got[503].per_token < min(got[i].per_token for i in range(100)) - 0.3
    coded = scorer.words().code([rows()[0][1]])
    start = lm.Network(scorer.sizes)
    assert scorer.network.score(coded.token, coded.windows(2)).mean() > start.score(coded.token, coded.windows(2)).mean() + 0.5


def test_gradient():
    r = np.random.default_rng(0)
    net = lm.Network(np.r_[0, np.ones(lm.CLASSES - 1)])
    coded = lm.Coded(r.integers(1, 9, 50).astype(np.int32), None, None, np.array([30, 0, 20]))
    w = coded.windows(2)
    around = np.array(w[np.array([0, 29, 30])]).T
    assert around[0, :2].tolist() == around[1, 2:].tolist() == around[2, :2].tolist() == [0, 0] and around[0, 2:].tolist() == coded.around[1:3].tolist()
    before = net.score(coded.token, w).mean()
    trainer = lm.Trainer(net)
    for _ in range(30):
        trainer.step(coded.token, w[np.arange(50)])
    assert net.score(coded.token, w).mean() > before + 0.5


def test_remembered_places_are_local_least():
    words = lm.Words([], {}, lm.Spelling(np.zeros(lm.CONTEXTS * 257)))
    text = " ".join(f"t{i * i % 97}" for i in range(300))
    at, h = words.code([text, text + " more", "", "one"]).remembered(2)
    every = {int(i) for i in at}
    assert at.tolist() == sorted(every) and all(any(i + k in every for k in range(-10, 11)) for i in range(10, 290))
    inner = [i for i in at.tolist() if 20 < i < 270]
    assert [i + 300 for i in inner] == [i for i in at.tolist() if 320 < i < 570]


def test_code_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(5000))
    whole = lm.Words([b"w1"], {b"w2": -1.0}, lm.Spelling(np.zeros(lm.CONTEXTS * 257))).code([text, None, "w1 zz"])
    monkeypatch.setattr(lm, "CHUNK", 400)
    monkeypatch.setattr(lm, "MEMO", 10)
    cut = lm.Words([b"w1"], {b"w2": -1.0}, lm.Spelling(np.zeros(lm.CONTEXTS * 257))).code([text, None, "w1 zz"])
    for x in ("token", "around", "share", "hash", "sizes", "doc"):
        assert np.array_equal(getattr(whole, x), getattr(cut, x))


def test_every_window_is_remembered(spark):
    words = lm.Words([], {}, lm.Spelling(np.zeros(lm.CONTEXTS * 257)))
    texts = [" ".join(f"t{i * i % 97}" for i in range(300)), "", None, "one", "a b c d e"]
    at, h = words.code(texts).remembered(2)
    assert at.tolist() == list(range(306)) and len(h) == 306
    # a pair of texts that differ in their first words only: each window that comes twice counts, wherever it stands
    data = [(k, f"{k}x{k} " + " ".join(f"w{i}q" for i in range(12)), "", 1) for k in range(2)]
    df = spark.createDataFrame(data, SCHEMA).repartition(2)
    scorer = lm.train(df)
    coded = scorer.words().code([data[0][1]])
    p = scorer.network.score(coded.token, coded.windows(2)) + coded.share
    want = [x if i in (1, 2) else math.log((math.exp(x) + (i > 0)) / 2) for i, x in enumerate(p)]
    got = {r.doc_id: r.log_prob for r in lm.lm_score(df, scorer).collect()}
    assert abs(got[0] - sum(want)) < 1e-4


def test_packed_windows():
    r = np.random.default_rng(3)
    for n in (1, 7, 3000):
        w, seen, p = r.integers(0, 2**64, n, np.uint64), r.integers(0, 2**32, n, np.uint64), -20 * r.random(n)
        place = np.sort(r.integers(0, 70_000 if n < 10 else 500, n))
        got = lm.unpack(*lm.pack(w, seen, p, place))
        want = (w & np.uint64(2**48 - 1), seen, p.astype(np.float32), place)
        assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_little_is_shuffled_and_nothing_stays_of_training(spark):
    import gc
    import os
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {x: os.path.getsize(x) for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x and x.endswith(".data") and os.path.exists(x)}

    r = random.Random(9)
    data = [(i, " ".join(r.choice("abcdefgh") + str(int(r.random() ** 3 * 4000)) for _ in range(500)), "", 1) for i in range(600)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4).localCheckpoint()
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(1)
    before = shuffled()
    scorer = lm.train(df)
    until = time.time() + 5
    large = lambda: sum(n for x, n in shuffled().items() if x not in before)
    while large() > 100_000 and time.time() < until:
        time.sleep(0.1)
    assert large() < 100_000  # before, two bytes of each token stayed
    before = shuffled()
    out = lm.lm_score(df, scorer)
    assert len(out.collect()) == 600
    assert large() < 15 * 300_000


def test_empty_table(spark):
    assert lm.lm_score(spark.createDataFrame([], SCHEMA)).collect() == []
