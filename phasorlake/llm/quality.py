"""Quality rules by distribution divergence, with exact base counts.

A document's histogram of character classes and of common words is compared with the
reference of its language by Jensen-Shannon distance (base 2, 0 to 1).

References are of the whole table, in three steps, of which none holds more than a
bounded number of words:

* ``common_words``: a common word has at least ``1 / MOST_WORDS`` of its language's
  words. Tasks count words into tables of at most ROOM entries (a full one lowers all
  its counts by the same number, and remembers by how much), and pass on only words that
  could be common, with an upper bound of their counts. Every common word is among those
  whose bounds add up to its share, so the candidates are whole and few.
* ``profiles``: for each document, counts of its language's candidates and of its
  character classes, and the base counts: a narrow table.
* ``references``: sums over the profiles. Candidates below their share go.

A large group of copies must not pull a reference towards itself: documents are put in
buckets by the least hash of their word pairs, so that copies and near copies share
one, and a share is its median over the buckets.

A document is rejected if it is far from its language's reference; one without a
language, from every reference. A short text's histogram is noisy, as one over the root
of its length, and so the limits fall with the length: base + slope / sqrt(letters-only
words, or characters other than white space). A test passes a text below its least
length, and one whose language has under LEAST_WORDS words, too few for a reference:
another language's says nothing of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasorlake.llm import common
from phasorlake.llm.windows import ONE, WordHashes

MOST_WORDS, BUCKETS, LEAST_WORDS = 200, 16, 2000
#: Entries of a table of word counts, and characters of text that a kernel works on at once.
ROOM, CHUNK = 20_000, 1_000_000
SYMBOLS = "#*$%&|<>"
_PURE = re.compile(r"[^\W\d_]+")
CLASSES = ("lower", "upper", "accented", "digit", "stop", "symbol", "other")
_STOPS, _MARKS = ".,;:!?'\"()-", "#*$%&|<>=+/\\^~@_`{}[]"


def _class(c: str) -> int:
    """Place in CLASSES; white space is one past the end, so in none."""
    if c.isspace():
        return 7
    if c.isdigit():
        return 3
    if c.isalpha():
        return 2 if ord(c) > 127 else 0 if c.islower() else 1
    return 4 if c in _STOPS else 5 if c in _MARKS else 6


_TABLE = np.array([_class(chr(i)) for i in range(0x10000)], np.uint8)


def classes(text: str) -> np.ndarray:
    """Characters of a text in each of CLASSES; those beyond 16 bits are in the last."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if codes.size and codes.max() > 0xFFFF:
        codes = np.where(codes > 0xFFFF, 0xFFFF, codes)
    return np.bincount(_TABLE[codes], minlength=8)[:7]


def pure_words(text: str) -> list[str]:
    """The words of a text without what is no letter, lower-cased."""
    return _PURE.findall(text.lower())


def _bucket(h: np.ndarray) -> int:
    """The bucket of a text by its words' hashes."""
    pairs = h[:-1] * np.uint64(ONE) + h[1:] if len(h) > 1 else h
    return int(pairs.min()) % BUCKETS if len(h) else 0


class Tally:
    """Counts of one language's words in at most ``room`` entries, each too low by ``lost`` at most."""

    def __init__(self, room: int):
        self.n, self.room, self.total, self.lost = Counter(), room, 0, 0

    def update(self, words: list[str]) -> None:
        self.total += len(words)
        self.n.update(words)
        if len(self.n) > self.room:
            cut = sorted(self.n.values(), reverse=True)[self.room // 2]
            self.lost += cut
            self.n = Counter({w: n - cut for w, n in self.n.items() if n > cut})

    def rows(self, share: int) -> tuple[list[str], list[int], int]:
        """Words that may have ``1 / share`` of all, their counts' upper bounds, and the bound of all others."""
        least = self.total // (10 * share) if self.lost or self.total > self.room // 4 else 0
        held = [(w, n + self.lost) for w, n in self.n.items() if n + self.lost > least]
        return [w for w, _ in held], [n for _, n in held], max(least, self.lost)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): by how much a word's bound is above that of the words not listed, which the row of the null word has, with the language's words in ``total``."""
    tallies: dict[str, Tally] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, t in tallies.items():
            w, n, rest = t.rows(MOST_WORDS)
            columns = [[lang] * (len(w) + 1), [None, *w], [rest, *(x - rest for x in n)], [t.total] + [0] * len(w)]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "word", "n", "total"])
        tallies.clear()

    for batch in batches:
        for rows in common.slices(batch, 1, CHUNK):
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                if lang is None or not (text := text.as_py()):
                    continue
                t = tallies.get(lang) or tallies.setdefault(lang, Tally(ROOM))
                for part in common.pieces(text, CHUNK):
                    t.update(pure_words(part))
            if sum(len(t.n) for t in tallies.values()) > 4 * ROOM or len(tallies) > ROOM:
                yield from out()
    yield from out()


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """Language to its candidates for common words, sorted; under ``1.2 * MOST_WORDS`` for each language of LEAST_WORDS words."""
    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(_tally, "lang string, word string, n long, total long")
    sums = rows.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    sums = common.keep(sums, "tallies")
    totals = sums.filter("word IS NULL").select("lang", F.col("n").alias("rest"), F.col("total").alias("all")).filter(F.col("all") >= LEAST_WORDS)
    could = sums.filter("word IS NOT NULL").join(totals, "lang", "right").filter(F.col("word").isNull() | ((F.col("n") + F.col("rest")) * MOST_WORDS >= F.col("all")))
    out: dict[str, list[str]] = {}
    for r in could.select("lang", "word").collect():
        out.setdefault(r.lang, []).extend([] if r.word is None else [r.word])
    common.drop(docs.sparkSession, sums)
    return {lang: sorted(out[lang]) for lang in sorted(out)}


class Index:
    """Places of the candidates of all languages in one row: those of a language are side by side."""

    def __init__(self, words: dict[str, list[str]]):
        self.span, self.place, self.every = {}, {}, {}
        n = 0
        for lang, listed in words.items():
            self.span[lang] = (n, n + len(listed))
            self.place[lang] = {w: n + i for i, w in enumerate(listed)}
            for w, i in self.place[lang].items():
                self.every.setdefault(w, []).append(i)
            n += len(listed)
        self.size = n

    def profile(self, text: str | None, lang: str | None) -> tuple[np.ndarray, int, list[int], list[int]]:
        """Characters by class, letters-only words, and places and counts of candidates: the language's, or all without one."""
        kinds, total, found = np.zeros(len(CLASSES), np.int64), 0, Counter()
        place = self.every if lang is None else self.place.get(lang, {})
        for part in common.pieces(text or "", CHUNK):
            kinds += classes(part)
            w = pure_words(part)
            total += len(w)
            found.update(filter(place.__contains__, w))
        if lang is None:
            flat = [(i, n) for w, n in found.items() for i in place[w]]
            return kinds, total, [i for i, _ in flat], [n for _, n in flat]
        return kinds, total, [place[w] for w in found], list(found.values())


_PROFILE = "doc_id long, lang string, bucket int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, kinds array<long>, pure long, places array<int>, counts array<int>"


def _profiles(index: Index):
    names = [x.split()[0] for x in _PROFILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in common.slices(batch, 1, CHUNK):
                langs, texts = part.column(2).to_pylist(), part.column(1).to_pylist()
                hashes, counts = measured(texts, memo)
                kinds, pure, places, n = zip(*map(index.profile, texts, langs))
                columns = [part.column(0), part.column(2), pa.array(map(_bucket, hashes), pa.int32()), *(pa.array(x) for x in counts.T)]
                columns += [pa.array(kinds, pa.list_(pa.int64())), pa.array(pure, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def profiles(docs: DataFrame, index: Index) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return common.keep(rows.mapInArrow(_profiles(index), _PROFILE), "profiles")


def references(rows: DataFrame, index: Index) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Language to (shares of its candidates, 0 for one that isn't common, and of the character classes), from profiles."""
    own = rows.filter(F.col("lang").isin(list(index.span)))
    kinds = own.groupBy("lang", "bucket").agg(F.sum("pure").alias("pure"), *[F.sum(F.col("kinds")[i]).alias(f"k{i}") for i in range(len(CLASSES))]).collect()
    each = own.select("bucket", F.explode(F.arrays_zip("places", "counts")).alias("x"))
    found = each.groupBy("bucket", F.col("x.places").alias("place")).agg(F.sum("x.counts").alias("n")).collect()  # BUCKETS for each candidate
    n = np.zeros((BUCKETS, index.size))
    for r in found:
        n[r.bucket, r.place] = r.n
    out = {}
    for lang, (a, b) in index.span.items():
        total, of_kind = np.zeros(BUCKETS), np.zeros((BUCKETS, len(CLASSES)))
        for r in kinds:
            if r.lang == lang:
                total[r.bucket], of_kind[r.bucket] = r.pure, [r[f"k{i}"] for i in range(len(CLASSES))]
        full = total > 0
        if full.any():
            share = np.median(n[full, a:b] / total[full, None], axis=0)
            share[n[:, a:b].sum(0) * MOST_WORDS < total.sum()] = 0
            seen = of_kind[of_kind.sum(1) > 0]
            kind = np.median(seen / seen.sum(1, keepdims=True), axis=0)
            out[lang] = share / max(1.0, share.sum()), kind / kind.sum()
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q: the root of the divergence in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(0.0, d / 2))


def repeated_words(w: list[bytes] | np.ndarray, span: int = 8) -> int:
    """Words, given by themselves or by hashes, in windows of ``span`` words that are found twice or more in the text."""
    n = len(w) - span + 1
    if n < 2:
        return 0
    if isinstance(w, np.ndarray):
        x = np.unique(w, return_inverse=True)[1]
    else:
        ids: dict[bytes, int] = {}
        x = np.fromiter((ids.setdefault(t, len(ids)) for t in w), np.int64, len(w))
        if len(ids) == len(w):
            return 0
    have = 1
    while have < span:  # ranks of longer windows from ranks of two shorter ones: exact
        step = min(have, span - have)
        _, x = np.unique(x[:-step] * (len(w) + 1) + x[step:], return_inverse=True)
        have += step
    again = np.bincount(x)[x] > 1
    edge = np.zeros(len(w) + 1, np.int32)
    at = np.flatnonzero(again)
    if not len(at):
        return 0
    edge[at] += 1
    edge[at + span] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base(text: str | None, n_words: int, repeated: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return n_words, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def suspects(hashes: list[np.ndarray], span: int = 8) -> np.ndarray:
    """Whether two windows of a text have one hash; equal windows always have."""
    out = np.zeros(len(hashes), bool)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    if len(h) < span:
        return out
    sizes = np.array([len(x) for x in hashes])
    doc = np.repeat(np.arange(len(hashes), dtype=np.int32), sizes)
    n = len(h) - span + 1
    key = np.zeros(n, np.uint64)
    for k in range(span):
        key *= np.uint64(ONE)
        key += h[k : k + n]
    key ^= key >> np.uint64(29)
    key = key * np.uint64(0xBF58476D1CE4E5B9) + doc[:n] * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(doc[:n] == doc[span - 1 :])
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    out[doc[order[1:][same]]] = True
    return out


def measured(texts: list[str | None], memo: WordHashes) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each text's words, and the base counts, a row for each text.

    Repeated windows are told by the words themselves, but in a text beyond CHUNK by their
    64-bit hashes, eight to a window, so that its words needn't be held at once.
    """
    hashes, held = [], []
    for t in texts:
        if t and len(t) > CHUNK:
            hashes.append(np.concatenate([np.fromiter(map(memo.__getitem__, common.words(x)), np.uint64) for x in common.pieces(t, CHUNK)]))
            held.append(None)
        else:
            held.append(common.words(t))
            hashes.append(np.fromiter(map(memo.__getitem__, held[-1]), np.uint64, len(held[-1])))
    again = [repeated_words(h if w is None else w) if x else 0 for h, w, x in zip(hashes, held, suspects(hashes))]
    return hashes, np.array([base(t, len(h), n) for t, h, n in zip(texts, hashes, again)], np.int64).reshape(-1, 5)


class Judge:
    """Distances of texts to references, and the verdicts."""

    def __init__(self, index: Index, refs: dict, word_limit: tuple[float, float], class_limit: tuple[float, float], min_words: int, min_chars: int):
        self.index, self.refs = index, refs
        self.word_limit, self.class_limit, self.min_words, self.min_chars = word_limit, class_limit, max(1, min_words), max(1, min_chars)

    def __call__(self, langs: list[str | None], kinds: np.ndarray, pure: np.ndarray, places: list, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word distances and class distances (NaN where not tested), and whether none is over its limit."""
        n = len(langs)
        by_word, by_class, good = np.full(n, np.nan), np.full(n, np.nan), np.ones(n, bool)
        chars = kinds.sum(1)
        asked: dict[str | None, list[int]] = {}
        for i, lang in enumerate(langs):
            asked.setdefault(lang, []).append(i)
        for own, rows in asked.items():
            for lang in self.refs if own is None else [own] if own in self.refs else []:
                share, kind = self.refs[lang]
                at = np.array(rows)
                at = at[chars[at] >= self.min_chars]
                by_class[at] = np.fmin(by_class[at], distance(kinds[at] / chars[at, None], kind))
                at = np.array(rows)
                at = at[pure[at] >= self.min_words]
                a, b = self.index.span[lang]
                p = np.zeros((len(at), b - a + 1))
                for k, i in enumerate(at):
                    spot = np.asarray(places[i], np.int64) - a
                    ours = (spot >= 0) & (spot < b - a)
                    p[k, spot[ours]] = np.asarray(counts[i])[ours]
                p[:, :-1][:, share == 0] = 0  # was a candidate, isn't common
                p[:, -1] = pure[at] - p.sum(1)
                by_word[at] = np.fmin(by_word[at], distance(p / pure[at, None], np.r_[share, max(0.0, 1 - share.sum())]))
        with np.errstate(divide="ignore", invalid="ignore"):
            good &= ~(by_class > self.class_limit[0] + self.class_limit[1] / np.sqrt(chars))
            good &= ~(by_word > self.word_limit[0] + self.word_limit[1] / np.sqrt(pure))
        return by_word, by_class, good


WORD_LIMIT, CLASS_LIMIT, MIN_WORDS, MIN_CHARS = (0.10, 1.75), (0.22, 1.6), 40, 100


def quality_rules(docs: DataFrame, word_limit: tuple[float, float] = WORD_LIMIT, class_limit: tuple[float, float] = CLASS_LIMIT, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The base counts and verdict of each document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under 20 words, or over 30 % of them in repeated windows of 8), kept,
    and the distances word_distance and class_distance to the language's reference (null
    if the text is too short for the test, or its lang has no reference).

    Null and empty texts have no words and fail. A null lang is left out of the
    references; the document is judged against all of them, by the nearest. A document
    whose lang has no reference isn't tested. Repeated rows are counted and judged as
    often as they come. An empty table gives no rows. Other columns are ignored,
    whatever their names. A text of any length is worked on in pieces.
    """
    index = Index(common_words(docs))
    rows = profiles(docs, index)
    judge = Judge(index, references(rows, index), word_limit, class_limit, min_words, min_chars)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_distance", "class_distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n) for n in b.schema.names}
            words, again = c["n_words"].to_numpy(), c["n_repeat_words"].to_numpy()
            failed = (words < 20) | (100 * again > 30 * words)
            kinds = np.array(c["kinds"].to_pylist(), np.int64)
            by_word, by_class, good = judge(c["lang"].to_pylist(), kinds, c["pure"].to_numpy(), c["places"].to_pylist(), c["counts"].to_pylist())
            columns = [*(c[n] for n in names[:6]), pa.array(failed), pa.array(good & ~failed)]
            columns += [pa.array(x, pa.float64(), from_pandas=True) for x in (by_word, by_class)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.drop("bucket").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, word_distance double, class_distance double")


def keep_good(docs: DataFrame, word_limit: tuple[float, float] = WORD_LIMIT, class_limit: tuple[float, float] = CLASS_LIMIT, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_rules`` keeps; rows aren't moved.

    Cases are as there: null and empty texts go, a repeated row stays as often as it
    comes, an empty table gives an empty table, and columns of any other name pass through.
    """
    index = Index(common_words(docs))
    rows = profiles(docs, index)
    judge = Judge(index, references(rows, index), word_limit, class_limit, min_words, min_chars)
    common.drop(docs.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in common.slices(batch, batch.schema.get_field_index("text"), CHUNK):
                texts, langs = part.column("text").to_pylist(), part.column("lang").cast(pa.string()).to_pylist()
                _, counts = measured(texts, memo)
                failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
                kinds, pure, places, n = zip(*map(index.profile, texts, langs))
                yield part.filter(pa.array(judge(langs, np.array(kinds), np.array(pure), places, n)[2] & ~failed))

    return docs.mapInArrow(run, docs.schema)
