"""Grouped summaries.  Spark aggregates map-side first, so a group that holds a large
share of the rows reaches the shuffle as one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def rollup_sum(micro: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    return micro.groupBy(*keys).agg(F.sum(col).alias(out))


def rollup_mean(
    micro: DataFrame, keys: Sequence[str], col: str, out: str, positive: bool = True
) -> DataFrame:
    """Mean by key, over positive values only when ``positive``."""
    rows = micro.filter(F.col(col) > 0) if positive else micro
    return rows.groupBy(*keys).agg(F.avg(col).alias(out))


def count_events(df: DataFrame, keys: Sequence[str], out: str = "n_events") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def adoption_counts(
    adoption: DataFrame, lo: int, hi: int, start: str = "start_year"
) -> DataFrame:
    """Adopters per start year, with the total over the window on every row."""
    counts = adoption.filter(F.col(start).isNotNull()).groupBy(start).agg(F.count(F.lit(1)).alias("n"))
    total = adoption.filter(F.col(start).between(lo, hi)).agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("total_in_window", total)


def coverage(df: DataFrame, year: str = "year") -> DataFrame:
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_years(year: Column, lo: int, hi: int) -> Column:
    """Aggregate: how many different years of the window occur.  Years are bits of a few
    words, so rows combine map-side without a distinct aggregation."""
    total: Column = F.lit(0)
    for start in range(lo, hi + 1, 62):
        inside = year.between(start, min(start + 61, hi))
        bit = F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), (year - start).cast("int")))
        total = total + F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0))
    return total


def unbalanced(
    df: DataFrame,
    cols: Sequence[str],
    lo: int,
    hi: int,
    unit: str = "unit_id",
    year: str = "year",
    compat: bool = False,
) -> DataFrame:
    """Units that lack a value of any of ``cols`` in some year of the window.

    A year counts once, however often the unit-year occurs.  Every unit of the table is
    judged, also one with no value at all.  With
    ``compat=True`` a unit without a single value of a column is not listed for
    that column.
    """
    window = F.col(year).between(lo, hi)
    years = hi - lo + 1
    counts = [
        distinct_years(F.when(window & F.col(c).isNotNull(), F.col(year)), lo, hi).alias(f"__n{i}")
        for i, c in enumerate(cols)
    ]
    grouped = df.groupBy(unit).agg(*counts)
    bad: Column = F.lit(False)
    for i in range(len(cols)):
        n = F.col(f"__n{i}")
        bad = bad | ((n < years) & (n > 0) if compat else n < years)
    return grouped.filter(bad).select(unit)


def distinct_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def support_bounds(
    df: DataFrame, cols: Sequence[str], pad: float = 0.01, treated: str = "treated", by_range: bool = False
) -> DataFrame:
    """Extremes of each column among treated rows, widened by ``pad``.

    By default the maximum is multiplied by 1 + pad and the minimum by 1 - pad, which
    narrows the range for negative values; ``by_range`` pads by that share of the
    range instead.
    """
    aggs = []
    for c in cols:
        hi, lo = F.max(c), F.min(c)
        if by_range:
            aggs += [(hi + pad * (hi - lo)).alias(f"max_{c}"), (lo - pad * (hi - lo)).alias(f"min_{c}")]
        else:
            aggs += [(hi * (1 + pad)).alias(f"max_{c}"), (lo * (1 - pad)).alias(f"min_{c}")]
    return df.filter(F.col(treated) == 1).agg(*aggs)


def support_trim(df: DataFrame, bounds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows strictly inside the bounds in every column; the one-row table of bounds is
    read as a single scalar subquery."""
    box = bounds.select(F.struct(*bounds.columns)).scalar()
    for c in cols:
        df = df.filter((F.col(c) < box[f"max_{c}"]) & (F.col(c) > box[f"min_{c}"]))
    return df


def with_max_year(df: DataFrame, year: str = "year", out: str = "max_year") -> DataFrame:
    """Last year of the table on every row, without a global window."""
    return df.withColumn(out, df.agg(F.max(year)).scalar())


def cohort_sizes(df: DataFrame, start: str = "start_year", year: str = "year") -> DataFrame:
    """Units per treated cohort in the last year."""
    last = df.agg(F.max(year)).scalar()
    rows = df.filter((F.col(year) == last) & (F.col(start) != 0))
    return rows.groupBy(start).agg(F.count(F.lit(1)).alias("number_units"))


def treated_counts(df: DataFrame, start: str = "start_year", year: str = "year") -> DataFrame:
    """Per year, units already treated; years without any are left out."""
    on = (F.col(start) != 0) & (F.col(start) <= F.col(year))
    counts = df.groupBy(year).agg(F.count_if(on).alias("number_units"))
    return counts.filter(F.col("number_units") > 0)


def n_balanced(df: DataFrame, e: int, start: str = "start_year", year: str = "year") -> DataFrame:
    """One row: treated units observed for at least ``e`` years after the first one."""
    threshold = df.agg(F.max(year) - e).scalar()
    rows = df.filter(
        (F.col(year) == threshold) & (F.col(start) != 0) & (F.col(start) <= threshold)
    )
    return rows.agg(F.count(F.lit(1)).alias("n_balanced"))
