"""Substring deduplication with a log-structured fingerprint index.

A window is ``width`` consecutive words of one document. A window whose word
sequence also starts elsewhere, in the same document or another, is repeated, and
every word that a repeated window covers is removed.

Storing a hash of every window would take more bytes than the text. The index
therefore keeps *seeds*: of the ``seed``-word hashes inside a window, the least
one. Equal windows have equal seeds, so a window is repeated only if its seed is;
about ``2 / (width - seed + 2)`` of all positions are seeds. The index folder has

* ``docs``: a segment for each batch, with a row for each document: hash of the text,
  number of words, digest, and its distinct seeds with their counts;
* ``runs``: immutable runs of (seed, text), sorted by seed in buckets of the seed, one
  file each. A bucket is of (seed, salt): the salt is of the text, so a seed of very many
  texts is in SALTS buckets.

A batch adds a run. Its distinct seeds are merge-joined with each older run, bucket by
bucket: the older run is neither moved nor sorted, and no old document is read. That
gives the texts, new and old, that hold a repeated seed: the candidates. ``compact``
merges ``fanout`` runs of a level into one of the next.

The candidates' windows with such seeds are then verified by a hash of 96 bits over all
the words, counted over all of them. Equal texts are one text with a weight of two, so a
group of copies costs a row for each copy and no more.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasorlake.llm import common
from phasorlake.llm.windows import CHUNK, OTHER, Windows, WordHashes

WIDTH, SEED, FANOUT, SALTS = 35, 8, 2, 16

_DOCS = "k1 long, k2 long, doc_id long, n_words long, digest string, seeds array<long>, counts array<int>"
_RUN = "seed long, salt int, k1 long, k2 long, first long, n int, weight int"


def _signatures(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for rows in common.slices(batch, 3, CHUNK):
                part = [common.words(t) for t in rows.column(3).to_pylist()]
                seeds, counts = [[] for _ in part], [[] for _ in part]
                c = Windows(part, memo)
                if c.n >= width:
                    doc, h = c.chosen(width, seed)
                    order = np.lexsort((h, doc))
                    doc, h = doc[order], h[order]
                    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, int)
                    n = np.diff(np.r_[new, len(h)])
                    cut = np.searchsorted(doc[new], np.arange(len(part) + 1))
                    values = h[new].view(np.int64)
                    seeds = [values[x:y] for x, y in zip(cut, cut[1:])]
                    counts = [n[x:y] for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[:3],
                        pa.array([len(t) for t in part], pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(t)).hexdigest() for t in part]),
                        pa.array(seeds, pa.list_(pa.int64())),
                        pa.array(counts, pa.list_(pa.int32())),
                    ],
                    ["k1", "k2", "doc_id", "n_words", "digest", "seeds", "counts"],
                )

    return run


def _windows(width: int, seed: int):
    """The distinct windows of each document whose seed is among its repeated seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for rows in common.slices(batch, 2, CHUNK):
                (k1, k2, weights), hits = (rows.column(i).to_numpy() for i in (0, 1, 3)), rows.column(4)
                c = Windows([common.words(t) for t in rows.column(2).to_pylist()], memo)
                if c.n < width:
                    continue
                _, least, whole = c.seeds(width, seed)
                firsts = np.r_[0, c.ends]
                asked = np.zeros(len(least), bool)
                for i in range(len(k1)):
                    lo, hi = firsts[i], min(firsts[i + 1], len(least))
                    asked[lo:hi] = np.isin(least[lo:hi], hits[i].values.to_numpy().view(np.uint64))
                at = np.flatnonzero(asked & whole)
                h, check, doc = c.hashes(width)[at], (c.hashes(width, OTHER)[at] >> np.uint64(32)).astype(np.uint32), c.doc[at]
                order = np.lexsort((check, h, doc))
                h, check, doc = h[order], check[order], doc[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (check[1:] != check[:-1])]) if len(h) else np.empty(0, int)
                n = np.diff(np.r_[new, len(h)]) * weights[doc[new]] if len(h) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k1[doc[new]]), pa.array(k2[doc[new]]), pa.array(h[new].view(np.int64)), pa.array(check[new].view(np.int32)), pa.array(np.minimum(n, 2).astype(np.int8))], ["k1", "k2", "h", "check", "n"])

    return run


def _removal(width: int, field: str):
    """Texts without the words that the listed windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            texts, hits = batch.column(2), batch.column(3)
            removed, kept, spans = [], [], []
            for i in range(len(texts)):
                t = common.words(texts[i].as_py())
                gone = np.zeros(len(t) + 1, np.int32)
                c = Windows([t], memo)
                at = np.flatnonzero(np.isin(c.hashes(width), hits[i].values.to_numpy().view(np.uint64)))
                np.add.at(gone, at, 1)
                np.add.at(gone, at + width, -1)
                out = np.cumsum(gone[:-1]) > 0
                removed.append(int(out.sum()))
                left = b" ".join([w for w, x in zip(t, out) if not x])
                kept.append(left.decode() if field == "kept" else hashlib.sha256(left).hexdigest())
                edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
                spans.append(edge.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.int32()))], ["k1", "k2", "n_removed", field, "spans"])

    return run


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text, which stand for it."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, text."""
    text = F.col("text").cast("string")
    return docs.select(*(k.alias(f"k{i}") for i, k in enumerate(text_key(text), 1)), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


class RunIndex:
    """A folder of immutable sorted runs of (seed, text) and of document segments."""

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH, seed: int = SEED, fanout: int = FANOUT):
        if not 0 < seed <= width:
            raise ValueError("a seed has from 1 to width words")
        self.spark, self.path, self.width, self.seed, self.fanout = spark, path or common.new_path(spark, "runs"), width, seed, fanout
        self.runs: list[tuple[int, str]] = []
        self.segments: list[str] = []
        self.version, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        manifest = f"{self.path}/manifest"
        if path and self._exists(manifest):
            state = json.loads(max(spark.read.text(manifest).collect(), key=lambda r: json.loads(r[0])["version"])[0])
            self.runs, self.segments = [tuple(x) for x in state["runs"]], state["segments"]
            self.version, self.buckets = state["version"], state["buckets"]

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _publish(self) -> None:
        """A new manifest row is the commit: a job that dies before it leaves the old state."""
        self.version += 1
        row = json.dumps({"version": self.version, "buckets": self.buckets, "runs": self.runs, "segments": self.segments})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")

    @staticmethod
    def _name(run: str) -> str:
        return "phasorlake_run_" + run.rsplit("-", 1)[1]

    def run(self, path: str) -> DataFrame:
        """A run, with its buckets and their order known to Spark: joins on (seed, salt) read it as it lies."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(path)} ({_RUN}) USING parquet CLUSTERED BY (seed, salt) SORTED BY (seed, salt) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(self._name(path))

    def _write_run(self, rows: DataFrame, level: int) -> tuple[int, str]:
        to = f"{self.path}/runs/{level}-{uuid.uuid4().hex}"
        dealt = rows.select(*[c.split()[0] for c in _RUN.split(", ")]).repartition(self.buckets, "seed", "salt")
        dealt.write.option("path", to).option("compression", "zstd").bucketBy(self.buckets, "seed", "salt").sortBy("seed", "salt").saveAsTable(self._name(to), format="parquet")
        return level, to

    def _drop_run(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")
        common.drop(self.spark, path)

    def segment(self, path: str) -> DataFrame:
        return self.spark.read.schema(_DOCS).parquet(path)

    def add(self, docs: DataFrame) -> DataFrame:
        """Append a batch with columns doc_id and text: a segment and a sorted run.

        Returns the candidates, kept: (k1, k2, first, seeds, weight) of the texts of the
        batch and of older ones with seeds that the batch has repeated. first is the least
        doc_id, weight 2 if a text comes twice or more.
        """
        to = f"{self.path}/docs/{uuid.uuid4().hex}"
        _keyed(docs).mapInArrow(_signatures(self.width, self.seed), _DOCS).write.option("compression", "zstd").parquet(to)
        # copies are one text: their seeds are taken from one of them
        texts = self.segment(to).filter(F.size("seeds") > 0).groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.least(F.count("*"), F.lit(2)).cast("int").alias("weight"), F.any_value("seeds").alias("seeds"), F.any_value("counts").alias("counts"))
        each = texts.select("k1", "k2", "first", "weight", F.pmod("k1", F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.arrays_zip("seeds", "counts")).alias("x"))
        level, run = self._write_run(each.select(F.col("x.seeds").alias("seed"), "salt", "k1", "k2", "first", F.least(F.col("x.counts") * F.col("weight"), F.lit(2)).cast("int").alias("n"), "weight"), 0)
        new = self.run(run)
        sums = common.keep(new.groupBy("seed").agg(F.sum("n").alias("n")), "sums")
        columns = ["k1", "k2", "first", "weight", "seed"]
        with self._ordered():
            found = [common.keep(self._merged(sums, path).select(*columns, F.lit(i + 1).alias("source")), "older") for i, (_, path) in enumerate(self.runs)]
            again = sums.filter("n > 1").select("seed")
            for old in found:
                again = again.unionByName(old.select("seed"))
            own = common.keep(self._merged(again.distinct(), run).select(*columns, F.lit(0).alias("source")), "own")
        rows = own
        for old in found:
            rows = rows.unionByName(old)
        # the runs and the batch are parts of the corpus: a text in two of them comes twice
        out = rows.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.collect_set("seed").alias("seeds"), F.collect_set(F.struct("source", "weight")).alias("weights"))
        weight = F.least(F.aggregate("weights", F.lit(0), lambda a, x: a + x["weight"]), F.lit(2))
        out = common.keep(out.select("k1", "k2", "first", "seeds", weight.alias("weight")), "hits")
        common.drop(self.spark, sums, own, *found)
        self.runs.append((level, run))
        self.segments.append(to)
        self._publish()
        self.compact()
        return out

    @contextmanager
    def _ordered(self) -> Iterator[None]:
        """Spark takes a bucket of one file as sorted only where this setting says so."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _merged(self, wanted: DataFrame, path: str) -> DataFrame:
        """The rows of a run whose seed is wanted, by a merge join on the run as it lies: a wanted seed is looked for in each salt."""
        each = wanted.select("seed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return self.run(path).join(each.hint("merge"), ["seed", "salt"])

    def compact(self) -> None:
        """Merge the runs of a level that has ``fanout`` of them into one of the next; a text of several is one."""
        while full := [lv for lv, n in Counter(lv for lv, _ in self.runs).items() if n >= self.fanout]:
            old = [r for r in self.runs if r[0] == min(full)]
            rows = self.run(old[0][1])
            for _, path in old[1:]:
                rows = rows.unionByName(self.run(path))
            rows = rows.groupBy("seed", "salt", "k1", "k2").agg(F.min("first").alias("first"), *[F.least(F.sum(c), F.lit(2)).cast("int").alias(c) for c in ("n", "weight")])
            merged = self._write_run(rows, min(full) + 1)
            self.runs = [r for r in self.runs if r not in old] + [merged]
            self._publish()
            for _, path in old:
                self._drop_run(path)

    def clear(self) -> None:
        for _, path in self.runs:
            self._drop_run(path)
        common.drop(self.spark, self.path)
        self.runs, self.segments = [], []


def substring_dedup(docs: DataFrame, width: int = WIDTH, seed: int = SEED, batches: int = 2, index: RunIndex | None = None, text_out: bool = False, history: DataFrame | None = None) -> DataFrame:
    """Remove the words that repeated windows cover.

    ``docs`` has doc_id and text; it is added to the index in ``batches`` runs. An
    index that already has runs makes this incremental: the new windows are judged
    against the history too, whose texts ``history`` must then supply; only those of
    candidates are looked at. An index that isn't given is removed at the end. Returns
    k1 and k2 (128 bits of the text: a result is a text's, whatever rows have it), doc_id,
    n_words, n_removed, ``spans`` (start, end, start, end ... of the removed words) and
    the digest ``kept_sha256`` of the words left, joined by one space, or, with
    ``text_out``, those words as ``kept`` (null where nothing was removed).

    Null and empty texts have no words: 0, 0 and the digest of nothing. A text
    shorter than a window loses nothing. Repeated rows are documents like others, so
    each repeats the windows of the other. Rows that share a doc_id, or have none, are
    judged by their own texts. A null doc_id stays null. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or RunIndex(spark, width=width, seed=seed)
    width, seed = index.width, index.seed
    before = len(index.segments)
    parts = [docs.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(batches)) == b) if batches > 1 else docs for b in range(batches)]
    hits = [index.add(p) for p in parts]
    new = [index.segment(p).drop("seeds", "counts") for p in index.segments[before:]]
    result = common.keep(reduce(DataFrame.unionByName, new), "result") if own else reduce(DataFrame.unionByName, new)
    if own:
        index.clear()

    rows = reduce(DataFrame.unionByName, hits)
    if len(hits) > 1:
        rows = rows.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.array_distinct(F.flatten(F.collect_list("seeds"))).alias("seeds"), F.max("weight").alias("weight"))
    stands = common.keep(rows, "stands")
    common.drop(spark, *hits)

    # one row stands for a text: copies differ in doc_id, so they are spread, and those that don't are made one
    source = _keyed(docs) if history is None else _keyed(docs).unionByName(_keyed(history))
    key = ["k1", "k2", "_d"]
    found_at = stands.withColumn("_d", F.coalesce("first", F.lit(-1)))
    texts = source.withColumn("_d", F.coalesce("doc_id", F.lit(-1))).select(*key, "text").join(found_at, key)
    texts = texts.groupBy(*key).agg(F.any_value("text").alias("text"), F.any_value("weight").alias("weight"), F.any_value("seeds").alias("seeds"))
    candidates = common.keep(texts.select("k1", "k2", "text", "weight", "seeds"), "candidates")

    found = common.keep(candidates.mapInArrow(_windows(width, seed), "k1 long, k2 long, h long, check int, n byte"), "windows")
    twice = found.groupBy("h", "check").agg(F.sum("n").alias("m")).filter("m > 1").select("h", "check")
    # the windows counted are one row each, so a hot one is many rows on one side only, which Spark splits
    listed = found.join(twice, ["h", "check"]).groupBy("k1", "k2").agg(F.collect_set("h").alias("windows"))
    field = "kept" if text_out else "kept_sha256"
    once = candidates.filter("weight = 1").select("k1", "k2", "text")
    cut = once.join(listed, ["k1", "k2"]).select("k1", "k2", "text", "windows").mapInArrow(_removal(width, field), f"k1 long, k2 long, n_removed long, {field} string, spans array<int>")
    cut = common.keep(cut, "cut")
    common.drop(spark, candidates, found)

    # copies need no text: all their words go
    copied = stands.filter("weight > 1").select("k1", "k2", F.lit(True).alias("copied"))
    out = result.join(copied, ["k1", "k2"], "left").join(cut, ["k1", "k2"], "left")
    gone = F.coalesce("copied", F.lit(False))
    nothing = F.lit("" if text_out else hashlib.sha256(b"").hexdigest())
    return out.select(
        "k1",
        "k2",
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, nothing).otherwise(F.col(field) if text_out else F.coalesce(field, "digest")).alias(field),
        F.when(gone, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.coalesce("spans", F.array().cast("array<int>"))).alias("spans"),
    )
