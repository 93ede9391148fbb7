"""Queries over the shared tables, one for each operator, and their SQL.

Every query takes (spark, sf_dir), reads its whole table and returns its whole result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasorlake.llm.bpe import bpe_digests
from phasorlake.llm.chat import chat_items
from phasorlake.llm.common import load
from phasorlake.llm.gif import text_media
from phasorlake.llm.html import main_text
from phasorlake.llm.lm import lm_score
from phasorlake.llm.mixing import mix_words
from phasorlake.llm.quality import quality_rules
from phasorlake.llm.simhash import as_hex, near_duplicates
from phasorlake.llm.substring import substring_dedup
from phasorlake.llm.urls import url_filter


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(load(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents"), width=35).drop("k1", "k2", "spans")


def tokenizer_path() -> str:
    """A public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(load(spark, sf_dir, "documents"), tokenizer_path())


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(load(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages"))


#: Tools whose calls are validated; those of other names are told as unknown.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "top": {"type": "integer", "minimum": 1, "maximum": 100}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
    "read": {"type": "object", "required": ["path"], "properties": {"path": {"type": "string"}, "lines": {"type": "array", "items": {"type": "integer", "minimum": 0}}}},
}


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = chat_items(load(spark, sf_dir, "conversations"), TOOLS)
    return items.select("conv_id", "block", "step", "place", "turn", "kind", "status", F.size("errors").alias("n_errors"), F.sha2("json", 256).alias("json_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(load(spark, sf_dir, "pages"))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(load(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_source_mixing, op2_substring_dedup, op3_bpe, op4_lm_scoring, op5_simhash, op6_html_extraction, op7_chat_formatting, op8_quality_rules, op9_url_filters, op10_gif_media, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op7_chat_formatting": OP7_SQL}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+34], ' ')) AS x FROM s),
r AS (SELECT x FROM h GROUP BY x HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM h JOIN r USING (x), (SELECT unnest(generate_series(0, 34)) AS k)),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
o AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, p: NOT list_contains(gone, p)), ' ')) AS kept_sha256
FROM o
"""

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3)::INT + 1] AS weight, source_size * 2 AS cap FROM k),
h AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, (total * 1.5::DOUBLE - below::DOUBLE) / rest::DOUBLE AS level FROM h),
f AS (SELECT arg_min(level, struct_pack(r := cap / weight, rank := rank)) AS level FROM l WHERE cap >= level * weight),
t AS (SELECT w.source, w.source_size, least(cap::DOUBLE, coalesce(f.level * weight, cap::DOUBLE)) AS target FROM w LEFT JOIN f ON true),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM c
"""

#: The tables hold no tool calls, so every message is one plain item.
OP7_SQL = """
SELECT conv_id, turn AS block, 0 AS step, 0 AS place, turn, 'message' AS kind, 'plain' AS status, 0 AS n_errors,
  sha256(json_object('content', text, 'role', role)::VARCHAR) AS json_sha256 FROM conversations
"""
