import hashlib
import random
import struct
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from phasorlake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    r = random.Random(5)
    alphabet = "aábcdeèfghiíßñÉÀÖ ΑΣσςİİ́̀ȩ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  ​﻿'sdmtlrve'!?.,#09²½٣漢字한글\U0001f600\U0001d400_~`"
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    out += ["it's they'LL I'D you've", "ΟΔΥΣΣΕΥΣ ΑΣ Σ", "x<|endoftext|>y <|startoftext|><|startoftext|>", "<|endoftext", "a" * 5000, "ab" * 3000 + "!?" * 2000, "", " ", "näive Å ﬁ Ǆ", "<|ENDOFTEXT|>"]
    out += [" ".join(r.choice(["the", "thanedble", "Erineses", "of", "ciónado", "über", "—", "12345"]) for _ in range(300))]
    return out


def codec(words=()):
    v = bpe.vocabulary(PATH)
    return bpe.Codec(v, bpe.Lexicon(bpe.mapped(bpe.Lexicon.compile(sorted((w.encode(), v.merge(w)) for w in set(words))))))


def test_against_the_library(library):
    words = {w for t in texts()[::2] for w in bpe.pieces(t, PATH)}
    for c in (codec(), codec(words)):
        for t in texts():
            want = library.encode(t, add_special_tokens=False).ids
            got = list(struct.unpack(f"<{len(c.encode(t)) // 4}I", c.encode(t)))
            assert got == want, repr(t)
            assert c.decode(c.encode(t)) == library.decode(want, skip_special_tokens=False)


def test_every_character(library):
    c = codec()
    for a in range(0, sys.maxunicode + 1, 64):
        t = "".join(f"a{chr(i)}b" for i in range(a, a + 64) if not 0xD800 <= i < 0xE000)
        if t:
            assert np.frombuffer(c.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, hex(a)


def test_lexicon_is_minimal_and_complete():
    words = sorted({a + b + c for a in (b"", b"re", b"un") for b in (b"do", b"work", b"\xc3\xa9") for c in (b"", b"ing", b"ed", b"s")})
    block = bpe.Lexicon.compile((w, [i, i + 1]) for i, w in enumerate(words))
    lex = bpe.Lexicon(block)
    assert [lex.find(w) for w in words] == list(range(len(words)))
    assert [lex.tokens(i).tolist() for i in range(len(words))] == [[i, i + 1] for i in range(len(words))]
    for w in (b"", b"r", b"rework!", b"doin", b"x"):
        assert lex.find(w) == -1
    n = len(lex.final)
    after = [set() for _ in range(n)]  # the right languages: all must differ
    for s in range(n):
        after[s] = ({b""} if lex.final[s] else set()) | {bytes([lex.label[e]]) + x for e in range(lex.first[s], lex.first[s + 1]) for x in after[lex.target[e]]}
    assert len({frozenset(x) for x in after}) == n


def test_digests_and_round_trip(spark, library):
    data = [(i, t, "clash", None) for i, t in enumerate(texts()[::7])] + [(-1, None, None, None), (None, "the the", None, None), (3, "repeated", "", "")]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    text = {}
    for d, t, *_ in data:
        text.setdefault(d, []).append(t or "")
    for r in bpe.bpe_digests(df, PATH, most=500).collect():
        options = []
        for t in text[r.doc_id]:
            ids = library.encode(t, add_special_tokens=False).ids
            options.append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in options
    for r in bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.bpe_digests(empty, PATH).collect() == [] == bpe.bpe_encode(empty, PATH).collect()


def test_lexicon_is_mapped_whatever_renames_do(monkeypatch, tmp_path):
    from pyspark import SparkFiles

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(SparkFiles, "getRootDirectory", lambda: ".")  # as on executors
    real = bpe.os.replace

    def within_a_folder(a, b):  # as where the work folder's absolute path is another mount
        if bpe.os.path.dirname(a) != bpe.os.path.dirname(b):
            raise OSError(18, "Invalid cross-device link")
        real(a, b)

    monkeypatch.setattr(bpe.os, "replace", within_a_folder)
    assert bytes(bpe.mapped(b"block")) == b"block" and len(list(tmp_path.iterdir())) == 1

    def never(a, b):
        raise OSError(18, "Invalid cross-device link")

    monkeypatch.setattr(bpe.os, "replace", never)
    assert bytes(bpe.mapped(b"other")) == b"other" and len(list(tmp_path.iterdir())) == 1
