"""Mixing sources to target weights. [native]

Sources share a number of words by weight; a target stops at ``most`` times its
source's size and the excess is shared again by weight among the others, until none
is above (``targets``: the fixed point in closed form, over sorted ratios). A source's
rate is target / size. Each document is emitted floor(rate) times, plus once more if
its hash, taken as a uniform number, is below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasorlake.llm import common

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from a document's id, the same in each run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, source_size): partial sums before the shuffle, so a hot source is a row a task."""
    return docs.groupBy("source").agg(F.sum("size").alias("source_size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The table has a row for each source. It is ranked and accumulated in one task:
    its length is the number of sources, not of documents: a million sources are some
    tens of megabytes there.
    """
    if share > most:
        raise ValueError("the share can't be above the most that all sources can give")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", pick)
    cap = F.col("source_size") * most
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("rank").asc())
    held = ranked.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()),
            "below": F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # the level if this source and all with larger ratios are below their caps
    level = (F.col("total") * share - F.col("below")) / F.col("rest")
    free = held.withColumn("level", F.when(cap >= level * F.col("weight"), level))
    free = free.withColumn("first", F.min(F.when(F.col("level").isNotNull(), F.struct((cap / F.col("weight")).alias("ratio"), "rank", "level"))).over(Window.partitionBy()))
    target = F.least(cap.cast("double"), F.coalesce(F.col("first.level") * F.col("weight"), cap.cast("double")))
    return free.select("source", "source_size", target.cast("double").alias("target"))


def _mixed(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str) -> DataFrame:
    # kept, so that its size is known: Spark broadcasts it only below its threshold
    shares = common.keep(targets(source_sizes(sized), weights, share, most).withColumnRenamed("source", "_source"), "shares")
    out = sized.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn("copies", F.floor(rate) + extra)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``copies``.

    ``docs`` has doc_id, text and source; a column of any of the four names is
    replaced, others stay. A null source is a source of its own, the last. A null or
    empty text has size 0; a source without words has target 0 and its documents 0
    copies. Repeated rows of a doc_id draw alike. A null doc_id draws as an empty id.
    An empty table gives no rows.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "_source")
    return _mixed(docs.withColumn("size", common.word_count(F.col("text"))), weights, share, most, seed)


def emit(mixed: DataFrame) -> DataFrame:
    """Each document ``copies`` times, with the number of the copy in ``copy``.

    Rows with 0 or null copies go; a null text or doc_id is emitted like any other;
    repeated rows are emitted each. An empty table gives no rows. A column ``copy`` is
    replaced, all others stay.
    """
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixed.filter("copies > 0").select(*[c for c in mixed.columns if c != "copy"], copy)


def mix_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, and ``taken``: the words that the mix takes of each document.

    As ``mix``; texts are read once, to count their words into a narrow kept table.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), common.word_count(F.col("text")).alias("size"))
    out = _mixed(common.keep(sized, "sizes"), weights, share, most, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
