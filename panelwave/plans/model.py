"""The whole estimation in one call, and the sweep over covariate sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelwave.operators import rollups
from panelwave.operators.frames import stack
from panelwave.plans import tables
from panelwave.plans.aggregate import Aggregate, aggregate_all
from panelwave.plans.att import Effects
from panelwave.plans.covariates import att_gt
from panelwave.plans.design import ModelSpec, Prepared, keep, prepare


@dataclass(frozen=True)
class ModelResult:
    """Prepared panel, group-time effects, the five aggregations and their tables."""

    spec: ModelSpec
    prepared: Prepared
    effects: Effects
    aggregates: Mapping[str, Aggregate]
    summaries: Mapping[str, DataFrame]
    n_balanced: DataFrame

    def stacked(self) -> DataFrame:
        """All summary tables in one, with the aggregation named."""
        return stack(*[df.withColumn("aggregation", F.lit(k)) for k, df in self.summaries.items()])

    def overalls(self) -> DataFrame:
        return stack(
            *[tables.overall_ci(a).withColumn("aggregation", F.lit(k)) for k, a in self.aggregates.items()]
        )


def fit(panel: DataFrame, spec: ModelSpec) -> ModelResult:
    """Prepare, estimate, aggregate in all five ways and tabulate."""
    prepared = prepare(panel, spec)
    effects = att_gt(panel, spec)
    rows = keep(
        prepared.panel.select(
            spec.unit, spec.time, F.coalesce(F.col(spec.cohort), F.lit(0)).alias(spec.cohort)
        )
    )
    aggregates = aggregate_all(effects)
    summaries = {
        kind: tables.summary_table(agg, rows) for kind, agg in aggregates.items() if kind != "simple"
    }
    n_balanced = rollups.n_balanced(rows, spec.balance_e, spec.cohort, spec.time)
    return ModelResult(spec, prepared, effects, aggregates, summaries, n_balanced)


def covariate_set_sweep(
    panel: DataFrame,
    spec: ModelSpec,
    covariate_sets: Sequence[tuple[str, ...]],
    kinds: Sequence[str] = ("group", "dynamic", "calendar"),
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """One comparison row per covariate set and aggregation, sorted by aggregation."""
    rows = []
    for covariates in covariate_sets:
        effects = att_gt(panel, spec.but(covariates=tuple(covariates), cband=False))
        label = tables.covariate_label(tuple(covariates), dict(labels or {}))
        parts = aggregate_all(effects, kinds)
        rows += [tables.comparison_row(parts[kind], label, spec.digits) for kind in kinds]
    return stack(*rows).orderBy(F.col("aggregation").desc(), "covariates")
