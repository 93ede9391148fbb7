"""LM scoring by masked pseudo-likelihood.

A network sees a window around each token, not the token, and predicts it: embeddings
of the tokens on both sides, one table for each offset, are summed, pass a tanh layer,
and give a softmax in two steps over CLASSES classes: p(a) * p(b | a). A document's
score is the sum of its tokens' conditional log probabilities.

The FREQUENT commonest words (ties by bytes) are a class each, and the other words with
at least ``1 / KNOWN`` of all are spread over further classes by a hash of their ending.
A word's probability is that of its class in its window, times its share of the class's
words. All rarer words, seen or not, are one class; a word's share of it is the
probability of its spelling: of each byte after the two before it, from the counts of all
rarer words, and of its end. So every word has a probability of its own, and no table of
words need be joined. (Around a token a rarer word counts by its ending too.)

The network is the prior of a memory, which grows with the corpus: every window of the
scored table is counted with the word in its midst. Where a window of four words comes m
times, n times with the token's word, then, the token itself left out, the word's
probability is (prior + n - 1) / m. Windows are dealt by their hashes over tasks of about
SHARE of them, packed to 13 to 14 bytes, and each task sends back one sum for a document.
Windows of a task are told apart by 48 bits, words in a window by 32.

Every token of the table is trained on. Documents are dealt by a hash of themselves into
shards of about SHARD tokens, and sorted by it; each shard's task takes Adagrad steps
from the same start, and the weights that come out are averaged by tokens, as whole
numbers, in a shuffle. So the weights depend on the table alone, not on how its rows lie
in partitions, and the driver gets one set of weights whatever the number of shards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasorlake.llm import common

SIDE, FREQUENT, REACH, WIDE, STEP, RATE = 32, 512, 2, 16, 4096, 0.1
CLASSES = SIDE * SIDE
KNOWN, SHARD, SHARE, CONTEXTS = 1 << 18, 1_500_000, 1_500_000, 1024
CHUNK, MEMO, TURN = 1_000_000, 300_000, 262_144
#: Tokens that are scored together, and the most that a logit can be.
PART, TOP = 4096, 80
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Weights are averaged as whole multiples of 1 / UNIT, tokens as multiples of 1,024.
UNIT = 1 << 24


def _tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def other_class(word: bytes, frequent: int) -> int:
    """The class of a word that isn't one of so many frequent ones; 0 is outside of the text, the last is of rarer words."""
    return 1 + frequent + crc32(word[-3:]) % (CLASSES - 2 - frequent)


RARER = CLASSES - 1


def _cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A cell for each byte, or 256 for the end, after the two before it, of all words in a row; and the words' sizes with the end."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    flat = np.full(ends[-1] if len(words) else 0, 256)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    flat[inside] = np.frombuffer(b"".join(words), np.uint8)
    one, two = np.r_[256, flat[:-1]], np.r_[256, 256, flat[:-2]][: len(flat)]
    two[(ends - sizes + 1)[sizes > 1]] = 256
    two[ends - sizes] = 256
    return ((two * 37 + one) % CONTEXTS) * 257 + flat, sizes


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n) of the words' bytes, over (word, n)."""
    total = np.zeros(CONTEXTS * 257)
    for batch in batches:
        words, n = batch.column(0), batch.column(1).to_numpy()
        for a in range(0, len(words), 20_000):
            cells, sizes = _cells(words[a : a + 20_000].to_pylist())
            total += np.bincount(cells, np.repeat(n[a : a + 20_000], sizes), CONTEXTS * 257)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["cell", "n"])


class Spelling:
    """Log probabilities of words by their bytes."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(CONTEXTS, 257) + 0.5
        self.table = np.log(n / n.sum(1, keepdims=True))

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        cells, sizes = _cells(words)
        return np.bincount(np.repeat(np.arange(len(words)), sizes), self.table.ravel()[cells], len(words))


class Classes(dict):
    """Word to its class; that of a rarer word's ending is negative."""

    def __init__(self, frequent: list[bytes], known: dict[bytes, float]):
        self.fixed, self.known = {w: i + 1 for i, w in enumerate(frequent)}, known
        super().__init__(self.fixed)

    def __missing__(self, word: bytes) -> int:
        c = other_class(word, len(self.fixed))
        self[word] = c = c if word in self.known else -c
        return c

    def code(self, text: str | None) -> bytes:
        """The classes of a text's words, 16 bits each."""
        out = []
        for piece in common.pieces(text or "", CHUNK):
            if len(self) > MEMO:
                self.clear()
                self.update(self.fixed)
            w = _tokens(piece)
            out.append(np.fromiter(map(self.__getitem__, w), np.int16, len(w)).tobytes())
        return b"".join(out)


class Words(dict):
    """Word to a place in arrays of its class (negative as in ``Classes``), the log of its share of it, and its hash."""

    def __init__(self, frequent: list[bytes], known: dict[bytes, float], spelling: Spelling):
        super().__init__()
        self.number, self.known, self.spelling = {w: i + 1 for i, w in enumerate(frequent)}, known, spelling
        room = MEMO + CHUNK
        self.cls, self.share, self.hash = np.zeros(room, np.int16), np.zeros(room), np.zeros(room, np.uint64)

    def places(self, run: list[bytes]) -> np.ndarray:
        """The places of words; new ones are filled in together."""
        at = np.fromiter(map(self.get, run, repeat(-1)), np.int32, len(run))
        spots = np.flatnonzero(at < 0)
        if len(spots):
            new = list(dict.fromkeys([run[i] for i in spots.tolist()]))
            a, b = len(self), len(self) + len(new)
            self.update(zip(new, range(a, b)))
            f = len(self.number)
            self.cls[a:b] = [self.number.get(w) or (other_class(w, f) if w in self.known else -other_class(w, f)) for w in new]
            self.share[a:b] = [self.known.get(w, 0.0) for w in new]
            self.hash[a:b] = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            rarer = np.flatnonzero(self.cls[a:b] < 0)
            self.share[a + rarer] = self.spelling.log_probs([new[i] for i in rarer.tolist()])
            at[spots] = np.fromiter(map(self.__getitem__, [run[i] for i in spots.tolist()]), np.int32, len(spots))
        return at

    def code(self, texts: Iterable[str | None]) -> Coded:
        """Tokens of the texts in a row. Words are held for a part of them at a time."""
        sizes, parts, run = [], [], []

        def take() -> None:
            if len(self) > MEMO:
                self.clear()
            at = self.places(run)
            parts.append((self.cls[at].astype(np.int32), self.share[at], self.hash[at]))

        for t in texts:
            size = 0
            for piece in common.pieces(t or "", CHUNK):
                w = _tokens(piece)
                size += len(w)
                run += w
                if len(run) > CHUNK // 4:
                    take()
                    run = []
            sizes.append(size)
        take()
        return Coded(*map(np.concatenate, zip(*parts)), np.array(sizes, np.int64))


class Coded:
    """Classes (as ``Classes`` has them), log shares and hashes of texts' tokens in a row; sizes of the texts."""

    def __init__(self, cls: np.ndarray, share: np.ndarray | None, hash_: np.ndarray | None, sizes: np.ndarray):
        self.share, self.hash, self.sizes = share, hash_, sizes
        self.around, self.token = np.abs(cls), np.where(cls < 0, RARER, cls)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)

    def apart(self, values: np.ndarray, gap: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
        """Values with ``gap`` fills between the texts, so that a window never sees another text; and their places."""
        room = np.full(len(values) + gap * (len(self.sizes) + 1), fill, values.dtype)
        at = np.arange(len(values)) + (self.doc + 1) * gap
        room[at] = values
        return room, at

    def windows(self, reach: int) -> Windows:
        return Windows(*self.apart(self.around, reach, 0), reach)

    def remembered(self, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of all tokens, and the hashes of the windows around them."""
        room, at = self.apart(self.hash, reach, 0)
        h = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
        for d in range(-reach, reach + 1):
            if d:
                h = mixed(h + room[at + d])
        return np.arange(len(h)), h


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Windows:
    """Tokens around places of texts, a row for each offset: asked for a part at a time."""

    def __init__(self, room: np.ndarray, at: np.ndarray, reach: int):
        self.room, self.at, self.steps = room, at, [d for d in range(-reach, reach + 1) if d]

    def __getitem__(self, places) -> list[np.ndarray]:
        at = self.at[places]
        return [self.room.take(at + d) for d in self.steps]


class Network:
    """in: (2 reach) tables of classes x wide; out: wide x SIDE with a bias for a, and for b with a bias for each a.

    ``none`` and ``none_of`` are minus infinity for a, and b of a, without words.
    """

    NAMES = ("inner", "outer_a", "bias_a", "outer_b", "bias_b")

    def __init__(self, counts: np.ndarray, reach: int = REACH, wide: int = WIDE, seed: int = 5):
        r = np.random.default_rng(seed)
        self.inner = r.normal(size=(2 * reach, CLASSES, wide)) * 0.3
        self.outer_a, self.outer_b = (r.normal(size=(wide, SIDE)) * 0.1 for _ in range(2))
        n = counts.astype(float).reshape(SIDE, SIDE)
        self.floor = -math.log(n.sum() + 1)
        full = n.sum(1) > 0
        with np.errstate(divide="ignore"):
            self.none = np.where(full, 0.0, -np.inf)
            self.none_of = np.where(n > 0, 0.0, np.where(full[:, None], -np.inf, 0.0))
            # it starts from the classes' own shares
            self.bias_a = np.log(np.maximum(n.sum(1), 1) / max(1.0, n.sum()))
            self.bias_b = np.log(np.maximum(n, 1) / np.maximum(n.sum(1, keepdims=True), 1))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def load(self, flat: np.ndarray, kind: type = np.float64) -> Network:
        a = 0
        for x in self.NAMES:
            old = getattr(self, x)
            setattr(self, x, flat[a : a + old.size].reshape(old.shape).astype(kind))
            a += old.size
        self.none, self.none_of = self.none.astype(kind), self.none_of.astype(kind)
        return self

    def hidden(self, around: list[np.ndarray]) -> np.ndarray:
        h = self.inner[0].take(around[0], 0)
        for table, at in zip(self.inner[1:], around[1:]):
            h += table.take(at, 0)
        return np.tanh(h, out=h)

    def forward(self, around: list[np.ndarray], a: np.ndarray) -> tuple[np.ndarray, list, list, list]:
        """Hidden layer; logits of all a, and of all b given a; their exponentials; and the sums of these."""
        h = self.hidden(around)
        z = [h @ self.outer_a + (self.bias_a + self.none), h @ self.outer_b + (self.bias_b + self.none_of).take(a, 0)]
        e = [np.exp(np.minimum(x, TOP, out=x)) for x in z]
        one = np.ones(SIDE, h.dtype)
        return h, z, e, [x @ one for x in e]

    def score(self, token: np.ndarray, windows: Windows) -> np.ndarray:
        """Log probabilities of the tokens' classes. All parts have one size: a token's score doesn't depend on its place."""
        out = np.empty(len(token))
        row = np.arange(PART)
        for i in range(0, len(token), PART):
            t, around = token[i : i + PART], windows[slice(i, i + PART)]
            n = len(t)
            if n < PART:
                t, around = np.pad(t, (0, PART - n)), [np.pad(x, (0, PART - n)) for x in around]
            a, b = t // SIDE, t % SIDE
            _, z, _, total = self.forward(around, a)
            out[i : i + n] = (z[0][row, a].astype(float) + z[1][row, b] - np.log(total[0].astype(float) * total[1]))[:n]
        return np.maximum(out, self.floor)  # of a class without words


class Trainer:
    """Adagrad on a network, in single precision."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate = net.load(net.flat(), np.float32), np.float32(rate)
        self.past = {x: np.full(getattr(net, x).shape, 1e-6, np.float32) for x in Network.NAMES}

    def _down(self, name: str, slope: np.ndarray, k: int | None = None) -> None:
        value, past = getattr(self.net, name), self.past[name]
        if k is not None:
            value, past = value[k], past[k]
        past += slope * slope
        value -= self.rate * slope / np.sqrt(past)

    def step(self, token: np.ndarray, around: np.ndarray) -> None:
        """A step down the mean negative log probability of the tokens."""
        net, n = self.net, len(token)
        a, b, row = token // SIDE, token % SIDE, np.arange(n)
        h, _, (da, db), (sa, sb) = net.forward(around, a)
        da *= (1 / (n * sa))[:, None]
        db *= (1 / (n * sb))[:, None]
        da[row, a] -= np.float32(1 / n)
        db[row, b] -= np.float32(1 / n)
        dh = (da @ net.outer_a.T + db @ net.outer_b.T) * (1 - h * h)
        is_a = np.zeros((n, SIDE), np.float32)
        is_a[row, a] = 1
        self._down("outer_a", h.T @ da)
        self._down("bias_a", da.sum(0))
        self._down("outer_b", h.T @ db)
        self._down("bias_b", is_a.T @ db)
        lane, wide, flat = np.arange(h.shape[1]), h.shape[1], dh.astype(float).ravel()
        for k, at in enumerate(around):
            cell = (at[:, None] * wide + lane).ravel()
            self._down("inner", np.bincount(cell, flat, CLASSES * wide).reshape(CLASSES, wide).astype(np.float32), k)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    n: Counter = Counter()
    for batch in batches:
        for t in batch.column(0):
            for piece in common.pieces(t.as_py() or "", CHUNK):
                n.update(_tokens(piece))
                if len(n) > MEMO:
                    yield rows(n)
                    n = Counter()
    yield rows(n)


class Scorer:
    """The classes of words, a trained network, and words' shares of their classes.

    ``known`` has the logarithms of the shares of the words of shared classes, ``sizes``
    the classes' words, and ``spelling`` the shares of rarer words.
    """

    def __init__(self, frequent: list[bytes], known: dict[bytes, float], counts: np.ndarray, spelling: Spelling, reach: int = REACH):
        self.frequent, self.known, self.sizes, self.spelling, self.reach = frequent, known, counts, spelling, reach
        self.network = Network(counts, reach)

    def words(self) -> Words:
        return Words(self.frequent, self.known, self.spelling)


def train(docs: DataFrame, reach: int = REACH, rate: float = RATE) -> Scorer:
    """A scorer trained on every token of the column ``text``; documents are told apart by doc_id and text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = common.keep(texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    held = sorted(((bytes(r.word), r.n) for r in counts.filter(F.col("n") * KNOWN >= total).collect()), key=lambda r: (-r[1], r[0]))  # KNOWN at most
    top, others = held[:FREQUENT], held[FREQUENT:]
    sizes = np.zeros(CLASSES)
    sizes[1 : len(top) + 1] = [n for _, n in top]
    place = [other_class(w, len(top)) for w, _ in others]
    np.add.at(sizes, place, [n for _, n in others])
    sizes[RARER] = max(1, total - sizes.sum())
    letters = np.zeros(CONTEXTS * 257)
    for r in counts.filter(F.col("n") * KNOWN < total).mapInArrow(_letters, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        letters[r.cell] = r.n
    common.drop(spark, counts)
    known = {w: math.log(n / sizes[c]) for (w, n), c in zip(others, place)}
    scorer = Scorer([w for w, _ in top], known, sizes, Spelling(letters), reach)
    if not total:
        return scorer
    shared = spark.sparkContext.broadcast(scorer)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Classes(shared.value.frequent, shared.value.known)
        for batch in batches:
            for part in common.slices(batch, 1, CHUNK):
                texts = [words.code(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["key", "classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value.network.flat()
        shard, held, size = None, [], 0

        def learn(texts: list[np.ndarray]) -> int:
            """Steps over the tokens of some texts, in an order that their number gives."""
            all_ = Coded(np.concatenate(texts), None, None, np.array([len(t) for t in texts]))
            n, w, token = len(all_.token), all_.windows(reach), all_.token
            order = np.random.default_rng(n).permutation(n)
            for i in range(0, n, STEP):
                at = order[i : i + STEP]
                trainer.step(token[at], w[at])
            return n

        def weights() -> pa.RecordBatch:
            times = -(-seen // 1024)
            w = np.round(trainer.net.flat().astype(np.float64) * UNIT).astype(np.int64) * times
            return pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(w))), pa.array(np.r_[times, w])], ["place", "w"])

        for batch in batches:
            for s, classes in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != shard:
                    if shard is not None:
                        seen += learn(held) if size else 0
                        yield weights()
                    shard, held, size, seen, trainer = s, [], 0, 0, Trainer(Network(shared.value.sizes, reach).load(start), rate)
                held.append(np.frombuffer(classes.as_py(), np.int16).astype(np.int32))
                size += len(held[-1])
                if size >= TURN:
                    seen += learn(held)
                    held, size = [], 0
        if shard is not None:
            seen += learn(held) if size else 0
            yield weights()

    shards = max(1, -(-int(total) // SHARD))
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    dealt = docs.select(key.alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(coded, "key long, classes binary").filter("length(classes) > 0")
    dealt = dealt.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "classes")
    averaged = common.keep(dealt.select("shard", "classes").mapInArrow(run, "place long, w long").groupBy("place").agg(F.sum("w").alias("w")), "weights")
    sums = dict(averaged.collect())
    common.drop(spark, averaged)
    n = len(scorer.network.flat())
    scorer.network.load(np.array([sums[i] for i in range(n)], np.float64) / UNIT / sums[-1], np.float32)
    return scorer


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of little-endian numbers: a row of the lowest of each, and so on."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzip(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, n, codec="zstd"), np.uint8)


def pack(w: np.ndarray, seen: np.ndarray, p: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """48 bits of windows, 32 of words, priors in single precision, and ascending places.

    What is like noise comes as it is, 13 bytes of each; what isn't (the top bytes of priors,
    the gaps between places) comes compressed.
    """
    p = _planes(p.astype("<f4"))
    solid = _planes(w.astype("<u8"))[:6].tobytes() + seen.astype("<u4").tobytes() + p[:3].tobytes()
    return solid, _zip(p[3]), _zip(_planes(np.diff(place, prepend=0).astype("<u4")))


def unpack(solid: bytes, tops: bytes, gaps: bytes) -> tuple[np.ndarray, ...]:
    """What ``pack`` was given."""
    n = len(solid) // 13
    flat = np.frombuffer(solid, np.uint8)
    w, p = np.zeros((n, 8), np.uint8), np.empty((n, 4), np.uint8)
    w[:, :6], p[:, :3], p[:, 3] = flat[: 6 * n].reshape(6, n).T, flat[10 * n :].reshape(3, n).T, _unzip(tops, n)
    gap = np.ascontiguousarray(_unzip(gaps, 4 * n).reshape(4, n).T)
    return w.view("<u8").ravel(), np.frombuffer(solid, "<u4", n, 6 * n), p.view("<f4").ravel(), np.cumsum(gap.view("<u4").ravel(), dtype=np.int64)


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """For each place of sorted columns, how many places are equal to it."""
    n = len(sorted_[0])
    new = np.ones(n, bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
    size = np.diff(np.r_[np.flatnonzero(new), n])
    return np.repeat(size, size)


def lm_score(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """doc_id, n_tokens, ``log_prob`` (the sum over tokens, natural logarithm) and ``per_token``.

    Words are the stretches between ASCII white space, A-Z lower-cased. A null or empty
    text has no tokens: 0, 0.0 and a null ``per_token``. Repeated rows are scored, train
    and are remembered as often as they come. A word that the scorer's table doesn't have
    is a rarer one. A null doc_id stays null. An empty table gives no rows. Other columns
    are ignored, whatever their names. A long text is scored whole, its words are held in
    pieces.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if scorer is None:
        scorer = train(docs)
        total = int(scorer.sizes.sum())
    else:
        total = docs.agg(F.sum(common.word_count(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(common.slots(docs.sparkSession), -(-total // SHARE))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    # a document, or (with ``solid``) a part's windows of one bucket, or (with ``sums``) what they add to some of the part's documents; ``part`` is the first row of a part
    kinds = {"bucket": pa.int32(), "part": pa.int64(), "row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "held": pa.float64(), "solid": pa.binary(), "tops": pa.binary(), "gaps": pa.binary(), "sums": pa.binary()}
    spec = "bucket int, part long, row long, doc_id long, n_tokens long, held double, solid binary, tops binary, gaps binary, sums binary"
    schema = pa.schema(list(kinds.items()))

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net, reach = shared.value.words(), shared.value.network, shared.value.reach
        for batch in batches:
            for part in common.slices(batch, 2, CHUNK):
                coded = words.code(part.column(2).to_pylist())
                prior = net.score(coded.token, coded.windows(reach)) + coded.share
                n, row = len(coded.sizes), part.column(0).to_numpy()
                yield rows(n, bucket=row % buckets, part=np.full(n, row[0]), row=row, doc_id=part.column(1), n_tokens=coded.sizes, held=np.bincount(coded.doc, prior, n))
                at, h = coded.remembered(reach)
                if not len(at):
                    continue
                bucket = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order].astype(np.int64)) > 0])
                values = (h // np.uint64(buckets), mixed(mixed(h) + coded.hash) & np.uint64(0xFFFFFFFF), prior, coded.doc)
                packed = [pack(*x) for x in zip(*(np.split(v[order], cuts[1:]) for v in values))]
                yield rows(len(cuts), bucket=bucket[order[cuts]].astype(np.int64), part=np.full(len(cuts), row[0]), **dict(zip(("solid", "tops", "gaps"), zip(*packed))))

    def recall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            own = pc.is_null(batch.column("solid"))
            yield batch.filter(own)
            for first, *x in zip(*(batch.filter(pc.invert(own)).column(c).to_pylist() for c in ("part", "solid", "tops", "gaps"))):
                w, seen, p, place = unpack(*x)
                held.append((w, seen, p, place.astype(np.uint32), np.full(len(w), len(held), np.uint32), np.array([first])))
        if not held:
            return
        *x, first = map(np.concatenate, zip(*held))
        held.clear()
        w, seen, p, place, packet = x
        order = np.argsort(w)
        m = _runs(w[order])
        order, m = order[m > 1], m[m > 1]
        w, seen, p, place, packet = w[order], seen[order], p[order].astype(float), place[order], packet[order]
        order = np.lexsort((seen, w))
        n = np.empty(len(w), np.int64)
        n[order] = _runs(w[order], seen[order])
        more = np.log((np.exp(p) + (n - 1)) / m) - p
        # a sum for each document of a packet
        key = packet.astype(np.int64) << 32 | place
        to, at = np.unique(key, return_inverse=True)
        sums, packet, place = np.bincount(at, more, len(to)), to >> 32, to & 0xFFFFFFFF
        cuts = np.flatnonzero(np.r_[True, np.diff(packet) > 0]) if len(to) else np.empty(0, np.int64)
        for i in range(0, len(cuts), 1000):
            some = cuts[i : i + 1000]
            ends = np.r_[some[1:], cuts[i + 1000] if i + 1000 < len(cuts) else len(to)]
            gaps = [_zip(_planes(np.diff(place[a:b], prepend=0).astype("<u4"))) for a, b in zip(some, ends)]
            yield rows(len(some), part=first[packet[some]], gaps=gaps, sums=[sums[a:b].astype("<f4").tobytes() for a, b in zip(some, ends)])

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, to, more = [], [np.empty(0, np.int64)], [np.empty(0, "<f4")]
        for batch in batches:
            is_own = pc.is_null(batch.column("sums"))
            own.append(batch.filter(is_own).select(["row", "doc_id", "n_tokens", "held"]))
            for first, gaps, sums in zip(*(batch.filter(pc.invert(is_own)).column(c).to_pylist() for c in ("part", "gaps", "sums"))):
                n = len(sums) // 4
                gap = np.ascontiguousarray(_unzip(gaps, 4 * n).reshape(4, n).T).view("<u4").ravel()
                to.append(first + np.cumsum(gap, dtype=np.int64))
                more.append(np.frombuffer(sums, "<f4"))
        if not own:
            return
        docs_ = pa.Table.from_batches(own).sort_by("row").combine_chunks()
        to, more = np.concatenate(to), np.concatenate(more).astype(float)
        order = np.lexsort((more, to))  # sums don't depend on the order of arrival
        at = np.searchsorted(docs_["row"].to_numpy(), to[order])
        held = docs_["held"].to_numpy() + np.bincount(at, more[order], docs_.num_rows)
        docs_ = docs_.select(["doc_id", "n_tokens"]).append_column("log_prob", pa.array(held))
        yield from docs_.to_batches(max_chunksize=10_000)

    # documents and windows come from one run of a task, so a row's number is one and the same for both
    dealt = texts.mapInArrow(run, spec).repartitionById(buckets, F.col("bucket"))
    back = dealt.mapInArrow(recall, spec).drop("bucket", "solid", "tops").repartition("part")
    out = back.mapInArrow(total_up, "doc_id long, n_tokens long, log_prob double")
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("per_token"))
