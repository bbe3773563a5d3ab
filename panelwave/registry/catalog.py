"""Register of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, folder) under ``name``."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Doubles that depend on the order of summation agree after rounding; adding 0.0
    turns a negative zero into zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def bin_label(number: str, cuts: str, bins: int = 4) -> str:
    """SQL text of a bin's label, from its number and the list of cut points."""
    plain = lambda x: f"regexp_replace(regexp_replace(printf('%.4f', CAST({x} AS DOUBLE)), '0+$', ''), '\\.$', '')"
    cases = " ".join(
        f"WHEN {i} THEN '{'[' if i == 1 else '('}' || {plain(f'{cuts}[{i}]')} || ', ' || {plain(f'{cuts}[{i + 1}]')} || ']'"
        for i in range(1, bins + 1)
    )
    return f"CASE {number} {cases} END"


def r(expr: str, name: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round({expr}, {digits}) + 0.0 AS {name}"
