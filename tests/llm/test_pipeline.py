"""Each stage of the pipeline against a brute-force twin, on its own input."""

import hashlib
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parent)]
import corpus_pipeline as p  # noqa: E402
from test_mixing import brute as mix_targets  # noqa: E402
from test_simhash import roots  # noqa: E402
from test_substring import brute as cut_words  # noqa: E402

from phasorlake.llm.quality import quality_rules  # noqa: E402
from phasorlake.llm.queries import tokenizer_path  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return (text or "").encode().split()


def shingles(text, k=5):
    w = words(text.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard_roots(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    return roots(sorted(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def make(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # cases of every stage among the table's own rows
    base = docs.filter("doc_id = 1").first()
    shared = " ".join(base.text.split()[:60])
    rows = [(90001, base.text, "en", "src1", 1), (90002, base.text + " " + shared, "en", None, 1), (90003, " ".join(base.text.split()[::-1]) + " " + shared, "en", "", 1), (90006, base.text.replace(base.text.split()[30], "another", 1), "en", "src1", 1), (90004, None, None, None, None), (90005, "", "en", "src1", 0), (None, docs.filter("doc_id = 5").first().text, "en", "src1", 2)]
    return docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_stages(spark):
    docs = p.common.keep(make(spark, "/root/testdata/sf0.001"), "documents")
    before = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id: r.kept for r in quality_rules(docs).collect()}

    good = p.common.keep(p.quality(spark, docs, ""), "good")
    kept = good.collect()
    assert good.columns == COLUMNS and all(tuple(r) == tuple(before[r.doc_id]) for r in kept)
    assert {r.doc_id for r in kept} == {d for d, k in verdict.items() if k}
    assert not {90004, 90005} & {r.doc_id for r in kept} and {1, 90001, 90002, 90003} <= {r.doc_id for r in kept}

    single = p.common.keep(p.near(spark, good, ""), "single")
    root = jaccard_roots({r.doc_id: r.text for r in kept if r.doc_id is not None})
    left = single.collect()
    firsts, ids = {d for d in root if root[d] == d}, {r.doc_id for r in left} - {None}
    # no text goes without a like one that stays; a pair at the limit can be missed
    assert single.columns == COLUMNS and firsts <= ids and len(ids) <= len(firsts) + 0.1 * (len(root) - len(firsts)) + 1
    assert 1 in {r.doc_id for r in left} and not {90001, 90006} & {r.doc_id for r in left}

    cut = p.common.keep(p.substring(spark, single, ""), "cut")
    want = {r[0]: r for r in cut_words([tuple(r) for r in left], 35)}
    texts = {r.doc_id: r.text for r in left}
    done = cut.collect()
    assert cut.columns == COLUMNS and len(done) == len(left)
    for r in done:
        if r.doc_id is None:
            continue
        _, _, removed, digest = want[r.doc_id]
        assert r.text == texts[r.doc_id] if not removed else hashlib.sha256(r.text.encode()).hexdigest() == digest and r.n_chars == len(r.text)
    shared = " ".join(before[1].text.split()[:60])
    assert shared in texts[90003] and shared not in {r.doc_id: r.text for r in done}[90003]

    mixed = p.common.keep(p.mixing(spark, cut, ""), "mixed")
    copies, sizes = {}, {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in done:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    target = mix_targets(sizes)
    for r in done:
        u = int(hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16) / 16**12
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert copies.get(r.doc_id, 0) == int(rate + 1e-12) + (u < (rate + 1e-12) % 1)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    text = {r.doc_id: r.text for r in done}
    out = p.bpe(spark, mixed, "").collect()
    assert len(out) == sum(copies.values())
    for r in out:
        assert r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids


def test_run_chains_the_stages(spark):
    assert [n for n, _ in p.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "mixing", "BPE encoding"]
    assert p.run(spark, "/root/testdata/sf0.001").count() > 100


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_empty_input(spark, name, stage):
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    assert stage(spark, p.common.keep(empty, "empty"), "").count() == 0


def test_repeated_rows_are_one(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(7, text["a"], "en", "s", 1)] * 3 + [(8, text["a"], "en", "s", 1), (9, text["b"], "en", "s", 1), (9, text["b"], "en", "other", 1)]
    # one doc_id with two texts, rows without doc_id, and null columns side by side
    rows += [(9, text["a"], "en", "s", 1), (None, text["c"], None, "s", 1), (None, text["c"], None, "s", 1), (None, text["c"], "s", None, 1), (None, text["b"], "en", "s", 1), (10, text["d"], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = p.common.keep(p.near(spark, p.common.keep(docs, "docs"), ""), "single")
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=lambda r: r[1])
    assert got == [(7, text["a"]), (9, text["b"]), (None, text["c"]), (10, text["d"])] and left.columns == COLUMNS
    assert {r.text for r in p.substring(spark, left, "").collect()} == set(text.values())
