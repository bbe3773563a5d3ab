"""Result tables: rounded summaries, interval labels, comparisons between models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwave.functions import columns as C
from panelwave.operators import rollups
from panelwave.plans.aggregate import Aggregate, z_value


def round_half_even(c: str, digits: int) -> F.Column:
    return F.bround(F.col(c), digits)


def summary_table(agg: Aggregate, panel: DataFrame, digits: int | None = None) -> DataFrame:
    """Rounded rows of an aggregation, with unit counts for the group and calendar kinds.
    The star looks at the rounded bounds."""
    spec = agg.effects.spec
    digits = spec.digits if digits is None else digits
    rows = agg.table.select(
        F.col("egt").alias("event_time"),
        F.col("att").alias("estimate_att"),
        F.col("se").alias("std_error"),
        F.col("lo").alias("lower_bound"),
        F.col("hi").alias("upper_bound"),
    )
    rounded = ("estimate_att", "std_error", "lower_bound", "upper_bound")
    rows = rows.withColumns({c: round_half_even(c, digits) for c in rounded})
    if agg.kind in ("group", "calendar"):
        key = spec.cohort if agg.kind == "group" else spec.time
        if agg.kind == "group":
            counts = rollups.cohort_sizes(panel, spec.cohort, spec.time)
        else:
            counts = rollups.treated_counts(panel, spec.cohort, spec.time)
        rows = rows.join(counts.withColumnRenamed(key, "event_time"), "event_time", "left")
    return rows.withColumn("statistical_significance", C.star("lower_bound", "upper_bound"))


def overall_ci(agg: Aggregate, alpha: float | None = None, digits: int = 3, percent: bool = False) -> DataFrame:
    """One row: overall effect, its error, normal interval and the interval as text."""
    z = z_value(agg.effects.spec.alpha if alpha is None else alpha)
    row = agg.overall.select("att", "se").withColumns(
        {"lo": F.col("att") - z * F.col("se"), "hi": F.col("att") + z * F.col("se")}
    )
    return row.withColumn("label", C.interval_text("lo", "hi", digits, percent))


def covariate_label(covariates: tuple[str, ...], labels: dict[str, str] | None = None) -> str:
    """Text for a covariate set, made from the specification itself."""
    names = [(labels or {}).get(c, c) for c in covariates]
    if not names:
        return "Intercept only"
    return names[0] if len(names) == 1 else ", ".join(names[:-1]) + " and " + names[-1]


# Display names of the aggregations.
AGGREGATION_NAMES = {
    "simple": "Simple",
    "dynamic": "Dynamic",
    "dynamic_balanced": "Dynamic (balanced)",
    "group": "Group",
    "calendar": "Calendar-time",
}


def comparison_row(agg: Aggregate, label: str, digits: int = 3, alpha: float | None = None) -> DataFrame:
    """One row per model and aggregation.  The bounds are rounded, but the star looks at
    the unrounded bounds."""
    ci = overall_ci(agg, alpha)
    return ci.select(
        F.lit(label).alias("covariates"),
        F.lit(AGGREGATION_NAMES[agg.kind]).alias("aggregation"),
        round_half_even("lo", digits).alias("lower_bound"),
        round_half_even("hi", digits).alias("upper_bound"),
        C.star("lo", "hi").alias("sig"),
    )
