"""A query and its SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c: Column | str) -> Column:
    """Six places; the sign of a zero goes."""
    return F.round(c, 6) + F.lit(0.0)


# SQL spellings of the hash-derived numbers

def u(s: str) -> str:
    return f"((('0x' || substr(md5({s}), 1, 8))::BIGINT)::DOUBLE / 4294967296.0)"


def theta(dim: int, label: str, j: str = "j", seed: int = 0) -> str:
    return f"(({u(f"'{seed}|{dim}|' || ({label}) || '|' || ({j})")} - 0.5) * 6.283185307179586)"


def gauss(s: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u(f'({s}) || {chr(39)}a{chr(39)}')})) * cos(6.283185307179586 * {u(f'({s}) || {chr(39)}b{chr(39)}')}))"


def js(dim: int) -> str:
    return f"(SELECT unnest(range({dim}))::INT AS j)"


def s6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
