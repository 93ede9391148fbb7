"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a value within r bits of both.
So every distinct fingerprint emits all values within r bits of itself, the values are
the shuffle key, and fingerprints that meet are verified pairs. At r = 1 that is 65
rows a fingerprint, and a meeting has at most 65 fingerprints, whatever the data: all
of them are within 2 bits of each other, so tying each to the least of its meeting
loses no link. Copies share a fingerprint and are counted before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasorlake.llm import common
from phasorlake.llm.components import components
from phasorlake.plans import BROADCAST

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints (or bands) whose variants one task emits.
SPREAD = 50_000
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, of which one is set if it is set in over half of the shingles' hashes."""
    w = text.encode().translate(_LOWER).split() if text else []
    if not w:
        return 0
    hashes = _hashes(w, shingle)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _hashes(w: list[bytes], shingle: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    if len(w) < shingle:
        return np.array([h(b" ".join(w), SEED)], "<u8")
    runs = zip(*[w[i:] for i in range(shingle)])
    return np.fromiter((h(s, SEED) for s in map(b" ".join, runs)), "<u8", len(w) - shingle + 1)


def _kernel(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of whole texts, kept: they are read again, texts aren't."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.keep(rows.mapInArrow(_kernel(shingle), "doc_id long, fp long"), "fingerprints")


def _masks(r: int) -> list[int]:
    out = []
    for k in range(r + 1):
        for bits in combinations(range(64), k):
            m = sum(1 << b for b in bits)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` within ``radius`` bits.

    For radius 2 the edges of a meeting are a star and the rest follows through it.
    A larger radius can bring fingerprints together that differ in more bits than
    asked, so there each meeting's pairs are listed and verified.
    """
    half = (radius + 1) // 2
    variants = F.explode(F.transform(F.array(*[F.lit(m) for m in _masks(half)]), lambda m: F.col("fp").bitwiseXOR(m))).alias("v")
    met = distinct.select("fp", variants).groupBy("v").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    if radius == 2:
        low = F.array_min("fps")
        pairs = met.select(low.alias("a"), F.explode("fps").alias("b"))
    else:
        pairs = met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    return pairs.filter("a < b").distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, ``fp`` (signed 64 bits) and component_id, the least doc_id that its links reach.

    Null and empty texts have fingerprint 0, which links like any other. A text of
    fewer words than a shingle is one shingle. Repeated rows each get a row. A null
    doc_id gets a row and never names a component that has another. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    marks = fingerprints(docs, shingle)
    distinct = common.keep(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    # each fingerprint becomes many rows: tasks of a bounded number of them
    wide = max(common.slots(docs.sparkSession), -(-distinct.count() // SPREAD))
    roots = components(links(distinct.select("fp").repartition(wide, "fp"), radius)).withColumnsRenamed({"node": "fp"})
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.keep(placed.join(least, "root").select("fp", "component_id"), "components")
    common.drop(docs.sparkSession, distinct)
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def text_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; none without words."""
    w = text.encode().translate(_LOWER).split() if text else []
    return _hashes(w, shingle) if w else np.empty(0, "<u8")


def text_fingerprint(hashes: np.ndarray, bands: int, band: int) -> tuple[int, list[int]]:
    """The 64-bit fingerprint, and ``bands`` further ones of ``band`` bits each, from other hashes of the same shingles."""
    if not len(hashes):
        return 0, [0] * bands
    words = 1 + -(-bands * band // 64)
    ones = np.zeros((words, 64), np.int64)
    for a in range(0, len(hashes), 65536):
        part = hashes[a : a + 65536]
        for k in range(words):
            h = part
            if k:
                h = part * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 1 & 2**64 - 1)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            ones[k] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    whole = [int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little") for x in (bits[0], bits[1:].ravel())]
    return whole[0], [whole[1] >> (band * i) & (1 << band) - 1 for i in range(bands)]


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A shortest spanning forest of signed fingerprints, over pairs that differ in ``most`` bits at most.

    Distances are found for one row of them at a time (Prim), so any number needs little
    memory. Whatever groups a limit below ``most`` makes, the forest's edges below it make too.
    """
    x = np.sort(fps).astype(np.int64).view(np.uint64)
    n, out = len(x), []
    best, tied = np.full(n, 65, np.uint8), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        d = np.bitwise_count(x ^ x[at])
        near = left & (d < best)
        best[near], tied[near] = d[near], at
        at = int(np.argmin(np.where(left, best, 66)))
        if best[at] <= most:
            out.append((int(x[tied[at]].view(np.int64)), int(x[at].view(np.int64))))
    return out


def band_links(nodes: DataFrame, bands: int, band: int, most: int) -> DataFrame:
    """Edges (a, b) among fingerprints ``fp`` with ``bands`` that meet: some band differs in 2 bits at most.

    Each band emits all values within 1 bit of itself, which are the shuffle key. Of a
    meeting the shortest forest over pairs of ``most`` bits at most is kept.
    """
    each = nodes.select("fp", F.posexplode("bands").alias("i", "value"))
    ball = F.explode(F.transform(F.array(*[F.lit(m) for m in [0, *(1 << b for b in range(band))]]), lambda m: F.col("value").bitwiseXOR(m))).alias("value")
    each = each.select("fp", "i", ball).select("fp", (F.shiftleft(F.col("i").cast("long"), 64 - 8).bitwiseXOR(F.col("value"))).alias("v"))
    met = each.groupBy("v").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1).select("fps").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for fps in batch.column(0) for e in forest(fps.values.to_numpy(), most)]
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


#: Rows of the sample that heavy shingles are told from, the least count there, the most of them; rows and candidates of a task.
SAMPLE, HEAVY, MOST_HEAVY, MEET, PAIRS = 8192, 4, 1 << 16, 1_000_000, 500_000
#: Texts that are looked up by a broadcast of their keys; more are joined by a shuffle.
FEW = 100_000
#: The least number of 64-bit words of a set's parities.
PARITIES = 8
#: First shingles of more components than this are crowded: they go last in the order.
CROWD = 8


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of a set's shingles: two sets differ in as many at least as their cells.

    There are as many cells as shingles at least, a power of two, so unlike sets differ in
    about half of them, however large they are.
    """
    bits = max((64 * PARITIES - 1).bit_length(), (len(shingles) - 1).bit_length())
    cells = (shingles * np.uint64(0x9E3779B97F4A7C15 | 1)) >> np.uint64(64 - bits)
    return np.packbits((np.bincount(cells.astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8), bitorder="little").view("<u8")


def odd_cells(a: np.ndarray, b: np.ndarray) -> int:
    """In how many cells the parities of two sets differ; those of more cells are folded first."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        cells = np.unpackbits(a.view(np.uint8), bitorder="little").reshape(-1, 2)
        a = np.packbits(cells[:, 0] ^ cells[:, 1], bitorder="little").view("<u8")
    return int(np.bitwise_count(a ^ b).sum())


def prefix(shingles: np.ndarray, heavy: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's shingles, of which two sets as similar as that share one at least.

    Their order is by value, with the ``heavy`` ones (sorted) last: any one order of all
    shingles is exact, this one makes few sets meet.
    """
    n = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    if not len(heavy):
        return shingles[:n]
    late = heavy[np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)] == shingles
    return np.concatenate([shingles[~late], shingles[late]])[:n]


def met_pairs(h: np.ndarray, node: np.ndarray, comp: np.ndarray, size: np.ndarray, rank: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of nodes with one ``h``, of different components; a part at a time.

    Left out are those whose sizes are too far apart, and those that ``h``, at these
    ``rank`` in both orders, can't be the first common shingle of: none but what follows
    it can be common then. Linked nodes meet by the first one.
    """
    order = np.lexsort((comp, h))
    h, node, comp, size, rank = h[order], node[order], comp[order], size[order], rank[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
    ends = np.r_[np.flatnonzero(new)[1:], len(h)]
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    run = new | np.r_[True, comp[1:] != comp[:-1]] if len(h) else new
    ends = np.r_[np.flatnonzero(run)[1:], len(h)]
    after = np.repeat(ends, np.diff(np.r_[0, ends]))  # the first place of the next component
    left = np.flatnonzero(after < end)
    n = (end - after)[left]
    total = np.cumsum(n)
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS)))
        times = n[i:j]
        a = np.repeat(left[i:j], times)
        b = np.repeat(after[left[i:j]], times) + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        near = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
        near &= np.minimum(size[a] - rank[a], size[b] - rank[b]) >= similarity / (1 + similarity) * (size[a] + size[b]) - 1e-9
        a, b = a[near], b[near]
        turn = node[a] > node[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        yield node[a], node[b]
        i = j


def crowded(h: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each ``h`` of more than CROWD components, and of how many."""
    order = np.lexsort((comp, h))
    h, comp = h[order], comp[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (comp[1:] != comp[:-1])] if len(h) else np.empty(0, bool)
    each, n = np.unique(h[new], return_counts=True)
    return each[n > CROWD], n[n > CROWD]


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = pa.schema([("h", pa.int64()), ("comp", pa.int64())])
    t = pa.Table.from_batches((pa.RecordBatch.from_arrays(b.columns, schema=columns) for b in batches), columns)
    h, n = crowded(t["h"].to_numpy(), t["comp"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])


def reordered(sets: DataFrame, late: DataFrame, similarity: float) -> DataFrame:
    """(node, firsts) of sets (node, shingles) as ``prefix`` has them, with the table ``late`` (h) in place of its array.

    Values are compared as unsigned ones; ``late`` may be as large as it likes, each h once.
    """
    sign = F.lit(-(1 << 63)).cast("long")
    each = sets.select("node", F.explode("shingles").alias("h")).join(late.select("h", F.lit(True).alias("late")), "h", "left")
    each = each.select("node", F.struct(F.coalesce("late", F.lit(False)).alias("late"), F.col("h").bitwiseXOR(sign).alias("h")).alias("x"))
    ranked = each.groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    most = F.size("xs") - F.ceil(F.lit(float(similarity)) * F.size("xs") - 1e-9).cast("int") + 1
    return ranked.select("node", F.transform(F.slice("xs", F.lit(1), most), lambda x: x.h.bitwiseXOR(sign)).alias("firsts"))


def _heavy(texts: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of many texts, sorted, told from a sample of about SAMPLE rows; MOST_HEAVY at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(text_hashes(t.as_py(), shingle)) for t in batch.column(0)]
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, "<u8"), np.empty(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    share = max(1, -(-texts.count() // SAMPLE))
    some = texts.filter(F.pmod("_k2", F.lit(share)) == 0).select("text")
    counts = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY)
    return np.sort(np.array([r.h for r in counts.orderBy(F.desc("n"), "h").limit(MOST_HEAVY).collect()], np.int64).view(np.uint64))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 10, band: int = 28, most: int = 18) -> DataFrame:
    """Exactly one row of ``docs`` of each group of near duplicates, all columns: the one of the least doc_id, any other before a null.

    Texts are linked if their sets of ``shingle``-word shingles have a Jaccard similarity
    of ``similarity`` or more, and no link is left out. Texts of one set are one node.

    First, candidates are fingerprints of which one of ``bands`` further ones differs in
    2 bits at most (meet in the middle) and the first in ``most`` of 64, and nodes of one
    fingerprint; their shingles are compared, and what links is one component. So large
    groups of copies are together before pairs are listed. By chance of the bits some links
    are missed there. Then nodes of different components meet by the first shingles of
    their sets (``prefix``), of which linked ones must share one; pairs whose sizes and
    ``parities`` allow the similarity are compared by their shingles as well. Before pairs
    are listed, first shingles of over CROWD components are put last in the order, and the
    sets that had them get others, until the crowds left are of no more pairs than there are
    nodes, or of shingles that are last already (all of a set's rarer ones are used up then).

    A row is known by 128 bits over all its columns, so equal rows, which nothing tells
    apart, are counted as one key; texts are moved only for keys that come repeatedly and
    for candidates. Null and empty texts are one group. An empty table stays empty.
    """
    flat = [c for n in docs.columns for c in (F.col(n), F.isnull(n))]  # a null alone leaves a hash as it was
    keyed = docs.withColumns({"_k1": F.xxhash64(F.lit(1), *flat), "_k2": F.xxhash64(F.lit(2), *flat)})
    spark = docs.sparkSession
    rows = keyed.select("_k1", "_k2", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heavy = spark.sparkContext.broadcast(_heavy(rows, shingle))
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [text_hashes(t.as_py(), shingle) for t in batch.column(3)]
            got = [text_fingerprint(h, bands, band) for h in hashes]
            sets = [np.unique(h) for h in hashes]
            fps, nodes = (np.array(x, np.uint64).view(np.int64) for x in ([x for x, _ in got], [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets]))
            columns = [pa.array(nodes), pa.array(fps), pa.array([x for _, x in got], longs), pa.array([len(x) for x in sets], pa.int32())]
            columns += [pa.array([parities(x).tobytes() for x in sets], pa.binary()), pa.array([prefix(x, heavy.value, similarity).view(np.int64) for x in sets], longs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["_k1", "_k2", "doc_id", "node", "fp", "bands", "n", "odd", "firsts"])

    marks = common.keep(rows.mapInArrow(run, "_k1 long, _k2 long, doc_id long, node long, fp long, bands array<long>, n int, odd binary, firsts array<long>"), "fingerprints")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_k1", "_k2")).alias("first")
    # texts of one set can differ in fingerprints, as these count repeats: any one does
    distinct = marks.groupBy("node").agg(first, *[F.any_value(c).alias(c) for c in ("n", "odd", "firsts")], F.min(F.struct("fp", "bands")).alias("x"))
    distinct = common.keep(distinct.select("node", "first", "n", "odd", "firsts", "x.fp", "x.bands"), "distinct")
    each = common.keep(marks.groupBy("_k1", "_k2", "node").agg(F.count("*").alias("n")), "keys")
    common.drop(spark, marks)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(text_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, longs)], ["node", "shingles"])

    def of_texts(nodes: DataFrame, kernel, column: str) -> DataFrame:
        """(node, column), kept, that a kernel finds of distinct nodes' texts."""
        asked = common.keep(distinct.join(nodes, "node").select("node", F.col("first._k1").alias("_k1"), F.col("first._k2").alias("_k2")), "asked")
        few = F.broadcast(asked) if asked.count() <= FEW else asked
        texts = rows.select("_k1", "_k2", "text").join(few, ["_k1", "_k2"]).select("node", "text")
        out = common.keep(texts.mapInArrow(kernel, f"node long, {column} array<long>").dropDuplicates(["node"]), column)
        common.drop(spark, asked)
        return out

    def moved(nodes: DataFrame, late: DataFrame) -> DataFrame:
        """(node, firsts), kept, of distinct nodes, with the shingles of ``late`` last."""
        if late.count() * 8 > BROADCAST:
            sets = of_texts(nodes, shingled, "shingles")
            out = common.keep(reordered(sets, late, similarity), "firsts")
            common.drop(spark, sets)
            return out
        last = spark.sparkContext.broadcast(np.sort(late.toArrow()["h"].to_numpy().view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                firsts = [prefix(np.unique(text_hashes(t.as_py(), shingle)), last.value, similarity).view(np.int64) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(firsts, longs)], ["node", "firsts"])

        return of_texts(nodes, run, "firsts")

    def verified(edges: DataFrame) -> DataFrame:
        """The rows of kept edges (a, b, ...) whose sets are similar."""
        sets = of_texts(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingled, "shingles")
        both = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
        same = F.size(F.array_intersect("_a", "_b"))
        out = common.keep(both.filter(same >= F.lit(float(similarity)) * (F.size("_a") + F.size("_b") - same)).select(*edges.columns), "links")
        common.drop(spark, sets)
        return out

    leads = common.keep(distinct.groupBy("fp").agg(F.min("node").alias("lead"), F.min_by("bands", "node").alias("bands")), "leads")
    wide = max(common.slots(spark), -(-leads.count() * bands // SPREAD))
    edges = common.keep(band_links(leads.select("fp", "bands").repartition(wide, "fp"), bands, band, most), "met")
    lead = {x: leads.select(F.col("fp").alias(f"f{x}"), F.col("lead").alias(x)) for x in "ab"}
    met = edges.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(lead["a"], "fa").join(lead["b"], "fb").select("a", "b")
    alike = distinct.join(leads.select("fp", "lead"), "fp").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    met = common.keep(met.unionByName(alike), "candidates")
    links_ = verified(met)
    roots = components(links_).select("node", F.col("root").alias("comp"))
    near = common.keep(distinct.select("node", "n", "firsts").join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near")
    common.drop(spark, edges, leads, met, links_)

    nodes, total = near.agg(F.count("*"), F.coalesce(F.sum(F.size("firsts")), F.lit(0))).first()
    wide = max(common.slots(spark), -(-total // MEET))
    late = common.keep(spark.createDataFrame([(int(h),) for h in heavy.value.view(np.int64)], "h long"), "late")
    while True:
        each_h = near.select(F.explode("firsts").alias("h"), "comp").repartition(wide, "h")
        crowds = common.keep(each_h.mapInArrow(_crowds, "h long, n long").join(late, "h", "left_anti"), "crowds")
        listed = crowds.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
        if listed <= nodes:
            common.drop(spark, crowds, late)
            break
        more_late = common.keep(late.unionByName(crowds.select("h")), "late")
        hit = near.select("node", F.explode("firsts").alias("h")).join(crowds.select("h"), "h", "left_semi").select("node").distinct()
        changed = moved(hit, more_late)
        others = near.join(changed.withColumnRenamed("firsts", "others"), "node", "left")
        others = common.keep(others.withColumn("firsts", F.coalesce("others", "firsts")).drop("others"), "near")
        common.drop(spark, crowds, late, changed, near)
        late, near = more_late, others

    columns = pa.schema([("h", pa.int64()), ("node", pa.int64()), ("comp", pa.int64()), ("n", pa.int32()), ("rank", pa.int32())])

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches((pa.RecordBatch.from_arrays(b.columns, schema=columns) for b in batches), columns)
        for pairs in met_pairs(t["h"].to_numpy(), t["node"].to_numpy(), t["comp"].to_numpy(), t["n"].to_numpy(), t["rank"].to_numpy(), similarity):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])

    dealt = near.select(F.posexplode("firsts").alias("rank", "h"), "node", "comp", "n").select("h", "node", "comp", "n", "rank").repartition(wide, "h")
    met = common.keep(dealt.mapInArrow(meetings, "a long, b long").distinct(), "met")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most_apart = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (1 - similarity) / (1 + similarity) + 1e-6
            odd = ([np.frombuffer(x.as_py(), "<u8") for x in batch.column(i)] for i in (4, 5))
            apart = np.array([odd_cells(a, b) for a, b in zip(*odd)], np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(apart <= most_apart))

    side = {x: distinct.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}")) for x in "ab"}
    pairs = met.join(side["a"], "a").join(side["b"], "b").select("a", "b", "na", "nb", "oa", "ob")
    pairs = common.keep(pairs.mapInArrow(allowed, "a long, b long"), "pairs")
    common.drop(spark, met)
    more = verified(pairs)
    of = {x: near.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"}
    roots = components(more.join(of["a"], "a").join(of["b"], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnsRenamed({"node": "comp", "root": "over"})
    placed = distinct.select("node", "first").join(near.select("node", "comp"), "node").join(roots, "comp", "left")
    placed = placed.select("node", "first", F.coalesce("over", "comp").alias("root"))
    named = common.keep(placed.select("node", "root").join(placed.groupBy("root").agg(F.min("first").alias("first")), "root").select("node", "first"), "components")
    common.drop(spark, pairs, more, near)
    chosen = (F.col("_k1") == F.col("first._k1")) & (F.col("_k2") == F.col("first._k2"))
    fate = each.join(named, "node").select("_k1", "_k2", chosen.alias("chosen"), "n").filter("NOT chosen OR n > 1")
    fate = common.keep(fate, "lost")
    common.drop(spark, each, distinct, named)
    again = keyed.join(fate.filter("chosen").select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    rest = keyed.join(fate.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti")
    return rest.select(*docs.columns).unionByName(again.select(*docs.columns))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
