"""Projections, filters, derived columns, sorts and unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelwave.functions import columns as C


def project(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    drop: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Select ``keep`` (in that order), leave out ``drop``, then rename old to new."""
    if keep is not None:
        df = df.select(*keep)
    return df.drop(*drop).withColumnsRenamed(dict(rename or {}))


def valid_rows(df: DataFrame, not_null: Sequence[str] = (), positive: Sequence[str] = ()) -> DataFrame:
    """Rows where all of ``not_null`` are present and all of ``positive`` exceed zero."""
    tests = [F.col(c).isNotNull() for c in not_null] + [F.col(c) > 0 for c in positive]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def in_period(df: DataFrame, lo: int, hi: int, year: str = "year") -> DataFrame:
    return df.filter(F.col(year).between(lo, hi))


def add_logs(df: DataFrame, logs: Mapping[str, str]) -> DataFrame:
    """``logs`` maps the new column to the measure."""
    return df.withColumns({out: C.positive_log(src) for out, src in logs.items()})


def add_ratio(df: DataFrame, out: str, num: str, den: str) -> DataFrame:
    return df.withColumn(out, C.ratio(num, den))


def add_diff(df: DataFrame, out: str, total: str, part: str) -> DataFrame:
    return df.withColumn(out, F.col(total) - F.col(part))


def code_treatment(
    df: DataFrame, lo: int, hi: int, start: str = "start_year", year: str = "year"
) -> DataFrame:
    """Add ``treated`` and ``any_treated`` and turn a missing start year into 0."""
    return df.withColumns(
        {
            "treated": C.treated_flag(start, year),
            "any_treated": C.arm_label(start, lo, hi),
            start: F.coalesce(F.col(start), F.lit(0)),
        }
    )


def shift_late(
    adoption: DataFrame, month: int = 10, start: str = "start_year", date: str = "start_date"
) -> DataFrame:
    return adoption.withColumn(start, C.shifted_start(start, date, month))


def parse_dates(df: DataFrame, col: str, fmt: str = "dd/MM/yyyy") -> DataFrame:
    return df.withColumn(col, C.parse_date(col, fmt))


def alias_names(df: DataFrame, col: str, variants: Mapping[str, str]) -> DataFrame:
    """Replace names that equal a known variant; a name that only contains a variant
    stays, so a correct name is never rewritten twice."""
    if not variants:
        return df
    pairs = [F.lit(x) for pair in variants.items() for x in pair]
    canonical = F.try_element_at(F.create_map(*pairs), F.col(col))
    return df.withColumn(col, F.coalesce(canonical, F.col(col)))


def split2(df: DataFrame, col: str, sep: str, into: tuple[str, str], extra: str = "merge") -> DataFrame:
    """Split a text column in two and drop it.  ``extra="merge"`` keeps everything after
    the first separator; ``"drop"`` keeps the piece up to the second one."""
    if extra not in ("merge", "drop"):
        raise ValueError(f"extra must be 'merge' or 'drop', not {extra!r}")
    quoted = "".join(f"\\{ch}" if ch in r"\.[]{}()*+-?^$|" else ch for ch in sep)
    parts = F.split(F.col(col), quoted, 2 if extra == "merge" else -1)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    kept = [F.col(c) for c in df.columns if c != col]
    return df.select(first.alias(into[0]), second.alias(into[1]), *kept)


def fill(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(defaults))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(cols))


def label(df: DataFrame, col: str, labels: Mapping[str, str], out: str = "label") -> DataFrame:
    """Add the display label of a code and its position in the label order."""
    labels = dict(labels)
    return df.withColumns({out: C.code_label(col, labels), f"{out}_order": C.code_rank(col, labels)})


def order_table(df: DataFrame, *keys: str) -> DataFrame:
    """Global sort; a leading "-" makes a key descending."""
    cols = [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]
    return df.orderBy(*cols)


def stack(*frames: DataFrame) -> DataFrame:
    """Append tables by column name; a column absent from one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
