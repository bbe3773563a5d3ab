"""Wide/long reshapes and the complete unit x year grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def to_long(
    df: DataFrame, ids: Sequence[str], names_to: str = "year", values_to: str = "value", cast: str | None = "int"
) -> DataFrame:
    """One row per (ids, column) for all columns that are not ids."""
    values = [c for c in df.columns if c not in set(ids)]
    out = df.unpivot(list(ids), values, names_to, values_to)
    return out.withColumn(names_to, F.col(names_to).try_cast(cast)) if cast else out


def to_wide(
    df: DataFrame, keys: Sequence[str], names: str, values: str, levels: Sequence[str]
) -> DataFrame:
    """One column per level.  The levels are declared, so no extra job looks for them.  A key
    with two values for a level stops the job."""
    value, count = F.max(values), F.count(values)
    once = F.when(count <= 1, value).otherwise(F.raise_error(F.lit("two values for one key and level")).cast(df.schema[values].dataType))
    return df.groupBy(*keys).pivot(names, list(levels)).agg(once)


def complete(df: DataFrame, unit: str, year: str, defaults: dict[str, object]) -> DataFrame:
    """All observed years for all observed units; absent measures take the default.

    The range of years is one array, which each unit explodes, and years that do not
    occur are taken out by a semi join; no list of values is gathered in a task.  Years are
    whole numbers or dates.  The measures then join on the full key.
    """
    span = df.agg(F.sequence(F.min(year), F.max(year))).scalar()
    units = df.select(unit).filter(F.col(unit).isNotNull()).distinct()
    seen = df.select(year).filter(F.col(year).isNotNull()).distinct()
    grid = units.select(unit, F.explode(span).alias(year)).join(seen, year, "left_semi").select(unit, year)
    return grid.join(df, [unit, year], "left").fillna(defaults)


def event_time_names(n_periods: int) -> dict[int, str]:
    """Column name of each event time from -(n-1) to n-2."""
    times = range(-(n_periods - 1), n_periods - 1)
    return {l: f"Dtmin{-l}" if l < 0 else f"Dt{l}" for l in times}


def event_dummies(
    df: DataFrame, n_periods: int, start: str = "start_year", year: str = "year"
) -> DataFrame:
    """0/1 columns for the time since treatment starts; all 0 for never-treated units."""
    elapsed = F.when(F.coalesce(F.col(start), F.lit(0)) > 0, F.col(year) - F.col(start))
    dummies = {
        name: F.when(elapsed == l, 1).otherwise(0) for l, name in event_time_names(n_periods).items()
    }
    return df.withColumns(dummies)
