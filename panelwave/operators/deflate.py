"""Price-index deflation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwave.functions import columns as C


def anchor_value(index: DataFrame, period: str, label: str = "period", value: str = "value") -> Column:
    """Index value of one period as a scalar subquery."""
    return index.filter(F.col(label) == period).agg(F.max(value)).scalar()


def yearly_index(
    index: DataFrame, anchor: str, exclude: Sequence[str] = (), label: str = "period", value: str = "value"
) -> DataFrame:
    """Year table of index values relative to the anchor period.

    ``exclude`` names the periods that are not year-end values.
    """
    rows = index.filter(~F.col(label).isin(list(exclude))) if exclude else index
    return rows.select(
        C.extract_year(label).alias("year"),
        C.ratio(F.col(value), anchor_value(index, anchor, label, value)).alias("deflator"),
    )


def deflate(df: DataFrame, cols: Sequence[str], index: DataFrame, year: str = "year") -> DataFrame:
    """Real values: nominal divided by the year's deflator, NULL where there is none."""
    index = index.select(F.col("year").alias("__y"), F.col("deflator").alias("__d"))
    joined = df.join(index, F.col(year) == F.col("__y"), "left")
    return joined.withColumns({c: C.ratio(c, "__d") for c in cols}).drop("__y", "__d")


def rebase(df: DataFrame, cols: Sequence[str], index: DataFrame, current: str, target: str) -> DataFrame:
    """Move values that stand at the prices of ``current`` to those of ``target``."""
    factor = C.ratio(anchor_value(index, current), anchor_value(index, target))
    return df.withColumns({c: C.ratio(F.col(c), factor) for c in cols})
