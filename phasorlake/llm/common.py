"""What the operators of this subpackage share: words, shared tables, safe columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasorlake.plans import drop, drop_all, keep, new_path, shared_dir

__all__ = ["drop", "drop_all", "keep", "load", "new_path", "pieces", "shared_dir", "slices", "slots", "word_count", "words"]

#: A word is a maximal run of anything but the six ASCII white-space characters.
#: ``bytes.split()`` cuts UTF-8 at exactly these six, so kernels use it.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(r"[ \t-\r]")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; a null text has none."""
    return text.encode().split() if text else []


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts have about ``most`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    a = held = 0
    for b, n in enumerate(sizes):
        if b > a and held + n > most:
            yield batch.slice(a, b - a)
            a, held = b, 0
        held += n
    if a < len(sizes):
        yield batch.slice(a)


def pieces(text: str, most: int) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut before white space; a longer word stays whole."""
    a = 0
    while len(text) - a > most:
        cut = max(text.rfind(c, a + 1, a + most) for c in " \n\t\r")
        if cut < 0:
            m = _SPACE.search(text, a + most)
            cut = m.start() if m else len(text)
        yield text[a:cut]
        a = cut
    yield text[a:]


def word_count(text: Column) -> Column:
    """Number of words, as a native expression; a null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slots(spark: SparkSession) -> int:
    """Tasks that run at once, for the width of small Python stages."""
    return max(2, spark.sparkContext.defaultParallelism)
