"""A training-data pipeline over ``documents``: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasorlake.llm import common
from phasorlake.llm.bpe import bpe_encode
from phasorlake.llm.mixing import emit, mix
from phasorlake.llm.quality import keep_good
from phasorlake.llm.queries import tokenizer_path
from phasorlake.llm.simhash import one_of_each
from phasorlake.llm.substring import substring_dedup, text_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts among them.

    A null language is judged against all; a repeated row goes or stays as often as it
    comes; an empty table stays empty, and columns of other names pass through.
    """
    return keep_good(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are alike in 0.8 or more of their five-word shingles exactly one row stays, that of the least doc_id.

    A row without doc_id stays only if no other is there. Null and empty texts are one
    group, repeated rows are of one group, and an empty table stays empty.
    """
    return one_of_each(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; a text that loses none stays as it is, white space included.

    What is left belongs to a text, not to a doc_id: rows that share one, or have none, get
    their own texts' remains. Null and empty texts, and texts under 35 words, stay. Repeated
    rows repeat each other's windows and lose them. An empty table stays empty.
    """
    cut = substring_dedup(docs, text_out=True).filter("n_removed > 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kept").alias("_kept"))
    cut = common.keep(cut.dropDuplicates(["_k1", "_k2"]), "cuts")
    k1, k2 = text_key(F.col("text").cast("string"))
    out = docs.withColumns({"_k1": k1, "_k2": k2}).join(cut, ["_k1", "_k2"], "left")
    changed = F.col("_kept").isNotNull()
    new = {"text": F.coalesce("_kept", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and add none to their source; a null source is one
    of its own; repeated rows are drawn alike; an empty table stays empty.
    """
    return emit(mix(docs)).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text: doc_id, lang, source, n_tokens and ids.

    A null or empty text has no tokens; a repeated row is encoded as often as it comes; an
    empty table gives no rows.
    """
    return bpe_encode(docs, tokenizer_path()).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("quality rules", quality), ("SimHash near-dedup", near), ("substring dedup", substring), ("mixing", mixing), ("BPE encoding", bpe)]

#: Hash functions, a trained reference and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        docs = common.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.drop(spark, getattr(before, "_kept_path", None))
    return docs
