import random

import numpy as np

from phasorlake.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, kept string, n_words int"
FUNCTION = {"en": ["the", "of", "and", "to", "in"], "fr": ["le", "la", "de", "et", "un"]}


def prose(r, lang, n):
    return " ".join(r.choice(FUNCTION[lang]) if r.random() < 0.35 else "".join(r.choice("abdeiklmnorst") for _ in range(r.randint(3, 9))) + r.choice(["", "", "", ",", "."]) for _ in range(n)).capitalize()


def rows():
    r = random.Random(2)
    out = [(i, prose(r, "en" if i % 2 else "fr", r.randint(60, 250)), "en" if i % 2 else "fr", "clash", 1) for i in range(120)]
    hot = prose(r, "en", 200) + " ZZZ QQQ"
    out += [(200 + i, hot, "en", "", 1) for i in range(60)]
    out += [(300, " ".join(f"{w}###" for w in prose(r, "en", 150).split()), "en", "", 1)]
    out += [(301, " | ".join("".join(r.choice("abdeiklmnorst") for _ in range(6)) for _ in range(150)), "en", "", 1)]
    out += [(302, "!! ".join(prose(r, "fr", 150).upper().split()), "fr", "", 1)]
    out += [(303, None, "en", None, None), (304, "", None, "", 1), (305, "one two\n\none two\n one two", None, "", 1), (None, "a b c d e f g h " * 30, "en", "", 1)]
    out += [(306, prose(r, "en", 100), None, "", 1), (307, prose(r, "en", 90).replace(" ", "\x0b\n") + "#|\U0001f600 x\x1fy", "en", "", 1)]
    return out


def slow(text):
    w = (text or "").encode().split()
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.encode().split() and x in lines[:i])
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(win) if win.count(x) > 1 for j in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_counts_and_verdicts(spark):
    data = rows()
    got = q.quality_rules(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert len(got) == len(data)
    text = {r[0]: r[1] for r in data}
    for r in got:
        want = slow(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {300, 301, 302, 303, 304, 305, None}
    assert kept >= {*range(120), *range(200, 260), 306, 307}


def test_distance():
    p = np.array([[0.5, 0.5, 0], [1, 0, 0], [0, 0, 1]])
    d = q.distance(p, np.array([0.5, 0.5, 0]))
    assert d[0] == 0 and abs(d[2] - 1) < 1e-12 and 0 < d[1] < 1


def test_empty_table_and_no_references(spark):
    assert q.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    got = q.quality_rules(spark.createDataFrame([(1, "w%d " * 30 % tuple(range(30)), None, "", 0)], SCHEMA)).collect()
    assert got[0].kept and got[0].word_distance is None


def test_small_languages(spark, monkeypatch):
    monkeypatch.setitem(FUNCTION, "de", ["der", "die", "und", "zu", "ein"])
    r = random.Random(4)
    data = [(i, prose(r, "en", 450), "en", "", 1) for i in range(300)]
    data += [(1000 + i, prose(r, "fr", 400), "fr", "", 1) for i in range(6)]  # 2,400 words, under 2 %
    data += [(2000, prose(r, "de", 300), "de", "", 1), (2001, "a b c d e f g h " * 30, "de", "", 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {x.doc_id: x for x in q.quality_rules(df).collect()}
    assert {d for d, x in got.items() if not x.kept} == {2001}
    assert got[1000].word_distance < 0.2 and got[2000].word_distance is None and got[2000].class_distance is None
    assert {x.doc_id for x in q.keep_good(df).collect()} == set(got) - {2001}


def brute(data):
    """Distances and verdicts in plain Python, from the definition."""
    langs, refs = {}, {}
    for _, text, lang, *_ in data:
        if lang and text:
            h = [q.WordHashes()[w] for w in text.encode().split()]
            pairs = [(a * q.ONE + b) % 2**64 for a, b in zip(h, h[1:])] or h
            langs.setdefault(lang, []).append((min(pairs, default=0) % q.BUCKETS, q.pure_words(text), [sum(q._class(c) == k for c in text) for k in range(7)]))
    for lang, rows in langs.items():
        every = [w for _, ws, _ in rows for w in ws]
        if len(every) < q.LEAST_WORDS:
            continue
        common = sorted(w for w in set(every) if every.count(w) * q.MOST_WORDS >= len(every))
        buckets = sorted({b for b, ws, _ in rows if ws})
        per = {b: [w for x, ws, _ in rows if x == b for w in ws] for b in buckets}
        share = np.array([np.median([per[b].count(w) / len(per[b]) for b in buckets]) for w in common])
        kinds = np.array([np.sum([k for x, _, k in rows if x == b], axis=0) for b in buckets], float)
        kind = np.median(kinds / kinds.sum(1, keepdims=True), axis=0)
        refs[lang] = common, share / max(1, share.sum()), kind / kind.sum()
    out = []
    for _, text, lang, *_ in data:
        ws = q.pure_words(text or "")
        k = np.array([sum(q._class(c) == x for c in text or "") for x in range(7)], float)
        asked = list(refs) if lang is None else [lang] if lang in refs else []
        bw, bc = [], []
        for name in asked:
            common, share, kind = refs[name]
            if len(ws) >= q.MIN_WORDS:
                p = [ws.count(w) / len(ws) for w in common]
                bw.append(float(q.distance(np.array([*p, 1 - sum(p)]), np.array([*share, max(0, 1 - share.sum())]))))
            if k.sum() >= q.MIN_CHARS:
                bc.append(float(q.distance(k / k.sum(), kind)))
        good = (not bw or min(bw) <= q.WORD_LIMIT[0] + q.WORD_LIMIT[1] / len(ws) ** 0.5) and (not bc or min(bc) <= q.CLASS_LIMIT[0] + q.CLASS_LIMIT[1] / k.sum() ** 0.5)
        out.append((min(bw, default=None), min(bc, default=None), good))
    return out


def near(a, b):
    return a is b or abs(a - b) < 1e-9


def test_distances_against_brute_force(spark):
    data = [(i, *r[1:]) for i, r in enumerate(rows())]
    wrong = random.Random(9)
    data += [(len(data), prose(wrong, "fr", 200), "en", "", 1), (len(data) + 1, prose(wrong, "en", 200), "xx", "", 1)]
    got = {r.doc_id: r for r in q.quality_rules(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()}
    want = brute(data)
    for row, (bw, bc, good) in zip(data, want):
        r = got[row[0]]
        assert near(r.word_distance, bw) and near(r.class_distance, bc) and r.kept == (good and not r.base_failed)
    assert not got[len(data) - 2].kept and got[len(data) - 1].kept  # French labelled English; a language without reference


def test_tally_is_bounded_and_misses_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(q, "ROOM", 300)
    r = random.Random(1)
    text = " ".join("le" if r.random() < 0.02 else "rare" if r.random() < 0.004 else "w" + "".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60000))
    batch = pa.RecordBatch.from_arrays([pa.array(["fr", "fr"]), pa.array([text, text[: len(text) // 2]])], ["lang", "text"])
    seen = [x for b in q._tally(iter([batch])) for x in b.to_pylist()]
    rest = sum(x["n"] for x in seen if x["word"] is None)
    total = sum(x["total"] for x in seen)
    bound = {x["word"]: x["n"] + rest for x in seen if x["word"]}
    words = q.pure_words(text) + q.pure_words(text[: len(text) // 2])
    assert total == len(words) and len(bound) <= 300
    assert bound["le"] >= words.count("le") and {w for w, n in q.Counter(words).items() if n * q.MOST_WORDS >= total} <= set(bound)


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(5)
    text = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(4000)) + "\n" + "x" * 5000 + "\n\x0bend end"
    memo = q.WordHashes()
    whole = q.measured([text], memo)
    index = q.Index({"en": ["a", "ab", "end"]})
    plain = index.profile(text, "en")
    monkeypatch.setattr(q, "CHUNK", 700)
    assert "".join(q.common.pieces(text, 700)) == text and max(map(len, q.common.pieces(text, 700))) < 5800
    cut = q.measured([text], memo)
    assert (whole[0][0] == cut[0][0]).all() and (whole[1] == cut[1]).all() and whole[1][0][4] == slow(text)[4]
    again = index.profile(text, "en")
    assert (plain[0] == again[0]).all() and plain[1] == again[1] and dict(zip(*plain[2:])) == dict(zip(*again[2:]))


def test_memory_of_a_very_long_text():
    """50 MB in one text, and two million distinct words, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, random, pyarrow as pa, numpy as np
from phasorlake.llm import quality as q
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = " ".join(f"{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(2_000_000)) + " " + "xyzzy beta gamma " * 2_000_000
b = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
size = len(text); del text
list(q._tally(iter([b])))
docs = pa.RecordBatch.from_arrays([pa.array([1]), b.column(1), b.column(0)], ["doc_id", "text", "lang"])
out = [r for x in q._profiles(q.Index({"en": ["xyzzy"]}))(iter([docs])) for r in x.to_pylist()]
assert out[0]["n_words"] == 8_000_000 and out[0]["counts"] == [2_000_000] and out[0]["n_repeat_words"] >= 6_000_000, out
print(size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(q.__file__).rsplit("/phasorlake", 1)[0])
    assert not done.returncode, done.stderr
    size, used = map(int, done.stdout.split())
    assert size > 45_000_000 and used < 1200, used
