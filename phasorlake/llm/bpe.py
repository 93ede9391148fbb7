"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The corpus's frequent words are compiled into one automaton that shares suffixes as
well as prefixes; following a word adds up outputs to the word's number, and a table
has the token ids of each number. Its arrays are one block of bytes: the driver
broadcasts it, each executor writes it once to a local file, and all workers map that
file into memory. A word that the automaton doesn't hold is merged exactly, by rank,
and remembered for as long as the memory bound lets it.

Frequent words are those of the stretches between white space that have at least
``1 / MOST_WORDS`` of all such stretches each, so there are at most MOST_WORDS such
stretches, whatever the corpus. They are counted over the whole table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasorlake.llm import common

MOST_WORDS, MEMO, CHUNK = 1 << 16, 500_000, 1_000_000
_NO = 1 << 62
#: White space as the vocabulary's normaliser has it.
_SPACE = r"[\t-\r\x85\p{Zs}\p{Zl}\p{Zp}]"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^\t-\r\x85\p{{Zs}}\p{{Zl}}\p{{Zp}}\p{{L}}\p{{N}}]+")
_PLAIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself where it is one, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A public tokenizer's file: ids, merge ranks, special strings."""

    def __init__(self, path: str):
        self.path = path
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        # both ids of a pair in one number, to its rank and its new id in one number
        self.pairs = {self.ids[a] << 32 | self.ids[b]: rank + 1 << 32 | self.ids[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.end] for c in letters]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def merge(self, word: str) -> list[int]:
        """Token ids of a normalised word: the pair of least rank first, the left one of equals."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.pairs.get
        found = [get(a << 32 | b, _NO) for a, b in zip(ids, ids[1:])]
        while found and (least := min(found)) < _NO:
            i = found.index(least)
            ids[i] = least & 0xFFFFFFFF
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 32 | ids[i], _NO)
            if i < len(found):
                found[i] = get(ids[i] << 32 | ids[i + 1], _NO)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap: n log n for words of any length."""
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        get = self.pairs.get
        heap = [(m >> 32, i, m & 0xFFFFFFFF, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (m >> 32, x, m & 0xFFFFFFFF, ids[x], ids[y]))
        return [t for t in ids if t >= 0]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(1)
def _unassigned() -> re.Pattern:
    """Characters that Python's Unicode tables don't know; newer tables may class them."""
    new = np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])
    edge = np.flatnonzero(np.diff(np.r_[False, new, False].astype(np.int8)))
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2)) + "]")


@lru_cache(1)
def _library(path: str):
    from tokenizers import Tokenizer

    shown = {c: b for b, c in enumerate(byte_letters())}
    t = Tokenizer.from_file(path)
    return lambda text: [bytes(map(shown.__getitem__, w)).decode() for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]


def pieces(text: str, path: str) -> list[str]:
    """The words of a text without special strings, normalised.

    Texts with unassigned characters go through the library's own normaliser and
    splitter, whose tables may be of a later Unicode version.
    """
    if text.isascii():
        return _PLAIN.findall(text.lower())
    if not text.isprintable() and _unassigned().search(text):  # an unassigned character isn't printable
        return _library(path)(text)
    text = unicodedata.normalize("NFC", text)
    # lower-casing is by character: a capital sigma at a word's end has no form of its own
    return _SPLIT.findall(text.replace("Σ", "σ").lower())


def segments(vocab: Vocabulary, text: str) -> Iterator[tuple[str, int | None]]:
    """Stretches of a text, (stretch, None), and its special strings, (string, id), in order."""
    at = 0
    if "<|" in text:
        for m in vocab.cut.finditer(text):
            yield text[at : m.start()], None
            yield m[0], vocab.special[m[0]]
            at = m.end()
    yield text[at:], None


class Lexicon:
    """A minimal acyclic automaton over UTF-8 words; a word's outputs add up to its place in sorted order.

    Arrays: for each state the first of its edges; for each edge its byte, target and
    output (the words of the state before it, with the state's own end counted); for
    each state whether it ends a word; for each word where its ids begin; the ids.
    """

    NAMES = ("first", "label", "target", "output", "final", "start", "ids")
    KINDS = ("<u4", "u1", "<u4", "<u4", "u1", "<u4", "<u4")

    def __init__(self, block: bytes | mmap.mmap):
        sizes = np.frombuffer(block, "<u8", len(self.NAMES))
        at = 8 * len(self.NAMES)
        for name, kind, n in zip(self.NAMES, self.KINDS, sizes):
            setattr(self, name, np.frombuffer(block, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        # memory views are plain to index from Python, and copy nothing
        self._first, self._label, self._target, self._output, self._final = (memoryview(getattr(self, n)) for n in self.NAMES[:5])

    @classmethod
    def compile(cls, entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """The block of (word, ids) pairs sorted by word, without repeats: states equal in
        all that follows are made one as soon as no later word can change them."""
        known: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # open states: whether it ends a word, its edges

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                end, edges = path.pop()
                key = (end, tuple(edges))
                if key not in known:
                    known[key] = len(frozen)
                    frozen.append(key)
                path[-1][1][-1] = (path[-1][1][-1][0], known[key])

        last, start, ids = b"", [0], []
        for word, tokens in entries:
            if word <= last and start[1:]:
                raise ValueError("words must be sorted and without repeats")
            same = len(os.path.commonprefix([word, last]))
            freeze(same)
            for b in word[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            ids += tokens
            start.append(len(ids))
            last = word
        freeze(0)
        frozen.append((path[0][0], tuple(path[0][1])))
        count: list[int] = []  # words from a state on; targets are frozen before their sources
        first, label, target, output, final = [0], [], [], [], []
        for end, edges in frozen:
            n = int(end)
            for b, t in edges:
                label.append(b)
                target.append(t)
                output.append(n)
                n += count[t]
            count.append(n)
            final.append(end)
            first.append(len(label))
        arrays = [np.array(x, k) for x, k in zip((first, label, target, output, final, start, ids), cls.KINDS)]
        out = [np.array([len(x) for x in arrays], "<u8").tobytes()]
        for x in arrays:
            out.append(x.tobytes() + b"\0" * (-x.nbytes % 8))
        return b"".join(out)

    def find(self, word: bytes) -> int:
        """The word's number, or -1."""
        first, label, target, output = self._first, self._label, self._target, self._output
        state, number = len(self._final) - 1, 0
        for b in word:
            end = first[state + 1]
            e = bisect_left(label, b, first[state], end)  # edges are in order of their bytes
            if e == end or label[e] != b:
                return -1
            number += output[e]
            state = target[e]
        return number if self._final[state] else -1

    def tokens(self, number: int) -> np.ndarray:
        return self.ids[self.start[number] : self.start[number + 1]]


def mapped(block: bytes) -> mmap.mmap:
    """The block as a read-only map of a file in the task's work folder, which this machine's workers share.

    The file holds nothing but what was broadcast: one that is absent, or that isn't the
    block, is written anew and put in place as a whole.
    """
    digest = hashlib.sha256(block).hexdigest()
    try:
        from pyspark import SparkFiles

        folder = SparkFiles.getRootDirectory()
    except Exception:  # outside of Spark, as in tests
        folder = tempfile.gettempdir()
    folder = folder if folder and os.path.isdir(folder) and os.access(folder, os.W_OK) else tempfile.gettempdir()
    path = os.path.join(folder, f"lexicon-{digest[:24]}")
    for _ in range(2):
        if os.path.exists(path):
            with open(path, "rb") as f:
                out = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            if hashlib.sha256(out).hexdigest() == digest:
                return out
            out.close()
        # its name is beside ``path`` as that is written: mkstemp's own, made absolute, can be on another device
        part = f"{path}-{uuid4().hex}"
        with open(part, "xb") as f:
            f.write(block)
        try:
            os.replace(part, path)
        except OSError:  # then it isn't shared: the map outlives the file's name
            with open(part, "rb") as f:
                out = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            os.remove(part)
            return out
    raise OSError(f"{path} doesn't hold what was written")


class Codec:
    """Encodes through the lexicon, else by merging; decodes by the token table.

    No normalisation, special string or word reaches across ASCII white space, so
    each stretch between is encoded by itself and remembered as a whole.
    """

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon):
        self.vocab, self.lexicon = vocab, lexicon
        self.words: dict[str, bytes] = {}
        self.stretches: dict[bytes, bytes] = {}

    def word(self, word: str) -> bytes:
        """A word's ids as little-endian 32-bit numbers."""
        out = self.words.get(word)
        if out is None:
            number = self.lexicon.find(word.encode())
            out = self.lexicon.tokens(number).tobytes() if number >= 0 else array("I", self.vocab.merge(word)).tobytes()
            if len(self.words) >= MEMO // 2:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = out
        return out

    def stretch(self, raw: bytes) -> bytes:
        text, path = raw.decode(), self.vocab.path
        if b"<|" in raw:
            out = b"".join(b"".join(map(self.word, pieces(part, path))) if special is None else special.to_bytes(4, "little") for part, special in segments(self.vocab, text))
        else:
            out = b"".join(map(self.word, pieces(text, path)))
        if len(self.stretches) >= MEMO:
            self.stretches.clear()
        if len(raw) <= 64:
            self.stretches[raw] = out
        return out

    def encode(self, text: str | None) -> bytes:
        get, new = self.stretches.get, self.stretch
        return b"".join([get(w) or new(w) for w in common.words(text)])

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, joined by a space: the vocabulary's file names no decoder."""
        return " ".join(map(self.vocab.tokens.__getitem__, memoryview(ids).cast("I"))) if ids else ""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stretch, n) of each batch."""
    for batch in batches:
        for part in common.slices(batch, 0, 32 * CHUNK):
            n: Counter = Counter()
            for t in part.column(0):
                n.update(common.words(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["stretch", "n"])


def lexicon(docs: DataFrame, path: str, most: int = MOST_WORDS) -> bytes:
    """The compiled block of the words in the frequent stretches of the column ``text``."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "stretch binary, n long").groupBy("stretch").agg(F.sum("n").alias("n"))
    counts = common.keep(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.filter((F.col("n") * most >= total) & (F.length("stretch") <= 64)).select("stretch")
    vocab, words = vocabulary(path), set()
    for r in frequent.collect():  # ``most`` rows at most
        for part, special in segments(vocab, bytes(r.stretch).decode()):
            words.update(pieces(part, path) if special is None else ())
    common.drop(docs.sparkSession, counts)
    return Lexicon.compile(sorted((w.encode(), vocab.merge(w)) for w in words))


def _codec(docs: DataFrame, path: str, most: int):
    block = docs.sparkSession.sparkContext.broadcast(lexicon(docs, path, most))
    return lambda: Codec(vocabulary(path), Lexicon(mapped(block.value)))


def bpe_encode(docs: DataFrame, path: str, most: int = MOST_WORDS) -> DataFrame:
    """The documents with ``ids`` (array of int), the tokens of ``text``, and ``n_tokens``.

    Ids are those of the tokenizers library for the file at ``path`` (on every
    executor), without special tokens added; their strings in a text are cut out and
    get their ids. Null and empty texts have no ids. Repeated rows are encoded each.
    An empty table gives no rows. Columns ``ids`` and ``n_tokens`` are replaced, all
    others stay.
    """
    rest = docs.drop("ids", "n_tokens")
    make = _codec(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            for part in common.slices(batch, batch.schema.get_field_index("text"), CHUNK):
                raw = [codec.encode(t.as_py()) for t in part.column("text")]
                n = np.array([len(r) // 4 for r in raw], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(n)], [*part.schema.names, "ids", "n_tokens"])

    schema = rest.withColumns({"ids": F.lit(None).cast("array<int>"), "n_tokens": F.lit(None).cast("long")}).schema
    return rest.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``, the tokens' strings of ``ids`` joined by spaces.

    Null and empty ids give an empty text; an id that the vocabulary doesn't have is an
    error. Repeated rows are decoded each, an empty table gives no rows, a column
    ``decoded`` is replaced and all others stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            text = [" ".join(tokens[i] for i in ids.as_py() or ()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

    rest = encoded.drop("decoded")
    return rest.mapInArrow(run, rest.withColumn("decoded", F.lit("")).schema)


def bpe_digests(docs: DataFrame, path: str, most: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to.

    As ``bpe_encode`` and ``bpe_decode``, in one pass and without moving ids.
    """
    make = _codec(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            out = []
            for t in batch.column(1):
                raw = codec.encode(t.as_py())
                out.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(codec.decode(raw).encode()).hexdigest()))
            n, ids, text = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
