"""Model specification and the balanced design table.

The design keeps one row per unit with its outcome path and covariate paths as arrays
over the years.  It costs one shuffle by unit; all later steps read it row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from panelwave.operators import joins, rollups
from panelwave.session import persisted


@dataclass(frozen=True)
class ModelSpec:
    """Everything a run needs to know; column names are parameters throughout."""

    outcome: str
    period: tuple[int, int]
    covariates: tuple[str, ...] = ()
    unit: str = "unit_id"
    time: str = "year"
    cohort: str = "start_year"
    treated: str = "treated"
    region: str = "region"
    only_regions: bool = True
    regions_within_period: bool = False
    control: str = "nevertreated"
    base: str = "universal"
    est: str = "dr"
    alpha: float = 0.05
    balance_e: int = 5
    digits: int = 3
    bootstrap: bool = False
    cband: bool = True
    draws: int = 1000
    seed: int = 2024
    min_treated: int = 1
    overlap_limit: float = 0.999
    newton_steps: int = 60
    newton_tolerance: float = 1e-9
    drop_bad_cells: bool = False
    late_as_never: bool = True

    def __post_init__(self) -> None:
        allowed = {
            "control": ("nevertreated", "notyettreated"),
            "base": ("universal", "varying"),
            "est": ("dr", "reg", "ipw"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}, not {getattr(self, name)!r}")
        if self.period[0] >= self.period[1]:
            raise ValueError(f"empty period {self.period}")

    def but(self, **changes: object) -> ModelSpec:
        return replace(self, **changes)

    @property
    def years(self) -> list[int]:
        return list(range(self.period[0], self.period[1] + 1))

    @property
    def variables(self) -> tuple[str, ...]:
        return (self.outcome, *self.covariates)


@dataclass(frozen=True)
class Prepared:
    panel: DataFrame
    excluded: DataFrame
    excluded_treated: DataFrame

    def message(self) -> str:
        """Number of distinct units left out, as text."""
        return f"{self.excluded.count()} units left out: a variable is missing in some year."


def _regions(panel: DataFrame, spec: ModelSpec) -> DataFrame:
    source = rollups_window(panel, spec) if spec.regions_within_period else panel
    return joins.treated_regions(source, spec.region, spec.treated)


def rollups_window(panel: DataFrame, spec: ModelSpec) -> DataFrame:
    return panel.filter(F.col(spec.time).between(*spec.period))


def prepare(panel: DataFrame, spec: ModelSpec, compat: bool = False) -> Prepared:
    """Long balanced panel: window rows of the units that are complete in the outcome
    and all covariates, in regions with treated units if asked for."""
    bad = rollups.unbalanced(
        panel, spec.variables, *spec.period, unit=spec.unit, year=spec.time, compat=compat
    )
    window = rollups_window(panel, spec)
    units = window.groupBy(spec.unit).agg(
        F.max(spec.region).alias("region") if spec.only_regions else F.lit(None).alias("region"),
        F.count(spec.time).alias("n_rows"),
        rollups.distinct_years(F.col(spec.time), *spec.period).alias("n_years"),
    )
    units = units.filter(_once(F.col("n_rows") <= F.col("n_years")))
    if spec.only_regions:
        units = units.join(_regions(panel, spec).withColumnRenamed(spec.region, "region"), "region", "left_semi")
    rows = window.join(bad, spec.unit, "left_anti").join(units.select(spec.unit), spec.unit, "left_semi")
    return Prepared(rows, bad, joins.audit_excluded(panel, bad, spec.unit, spec.treated))


def _once(fine: Column) -> Column:
    return F.when(fine, True).otherwise(
        F.raise_error(F.lit("duplicate unit-year in the panel")).cast("boolean")
    )


def unit_paths(panel: DataFrame, spec: ModelSpec) -> DataFrame:
    """The balanced design: ``unit, cohort, y, x`` with ``y[i]`` the outcome and
    ``x[j][i]`` covariate ``j`` in year ``lo + i``.

    The same units as in ``prepare``, minus those already treated in the first period,
    which no comparison can use.  Cohorts that start after the window count as never
    treated, coded 0; with ``late_as_never`` off they form one cohort, coded ``hi + 1``, as
    they are alike in every comparison.  So there are never more cohorts than years and
    two.  Every year is picked by a
    conditional maximum, so Spark combines rows map-side; a unit-year that occurs
    twice stops the job.
    """
    lo, hi = spec.period
    year = F.col(spec.time)
    start = F.coalesce(F.col(spec.cohort), F.lit(0)).cast("int")
    values = [
        F.max(F.when(year == t, F.col(v).cast("double"))).alias(f"v{j}_{t}")
        for j, v in enumerate(spec.variables)
        for t in spec.years
    ]
    wide = (
        rollups_window(panel, spec)
        .groupBy(spec.unit)
        .agg(
            F.max(start).alias("cohort"),
            F.max(spec.region).alias("region") if spec.only_regions else F.lit(None).alias("region"),
            F.count(year).alias("n_rows"),
            rollups.distinct_years(year, lo, hi).alias("n_years"),
            *values,
        )
    )
    wide = wide.filter(_once(F.col("n_rows") <= F.col("n_years")))
    complete = [F.col(f"v{j}_{t}").isNotNull() for j in range(len(spec.variables)) for t in spec.years]
    for test in complete:
        wide = wide.filter(test)
    wide = wide.filter((F.col("cohort") == 0) | (F.col("cohort") > lo))
    if spec.only_regions:
        regions = _regions(panel, spec).withColumnRenamed(spec.region, "region")
        wide = wide.join(regions, "region", "left_semi")
    paths = [F.array(*[f"v{j}_{t}" for t in spec.years]) for j in range(len(spec.variables))]
    late = F.when(F.col("cohort") > hi, 0 if spec.late_as_never else hi + 1).otherwise(F.col("cohort"))
    return wide.select(
        F.col(spec.unit).alias("unit"),
        late.alias("cohort"),
        paths[0].alias("y"),
        (F.array(*paths[1:]) if spec.covariates else F.array().cast("array<array<double>>")).alias("x"),
    )


def keep(df: DataFrame) -> DataFrame:
    """Cache a unit-level table for the passes that follow; it spills to disk, and a lost
    block is computed again from its inputs."""
    return persisted(df)


def cohort_cells(cohorts: Sequence[int], spec: ModelSpec) -> list[tuple[int, int, int]]:
    """All (g, t, b): treated cohort, year and base year."""
    lo, hi = spec.period
    treated = sorted(c for c in cohorts if lo < c <= hi)
    if spec.base == "universal":
        return [(g, t, g - 1) for g in treated for t in spec.years]
    return [(g, t, g - 1 if t >= g else t - 1) for g in treated for t in spec.years if t > lo]


def cell_members(
    cohorts: Sequence[int], spec: ModelSpec
) -> list[tuple[int, int, int, int, int, int]]:
    """Which cohorts enter which cell: (cohort, g, t, b, horizon, d), with d = 1 for the
    treated cohort and 0 for a control cohort.

    A not-yet-treated control must start after ``horizon = max(t, b)``.  The list has at
    most years^3 entries, whatever the size of the panel.
    """
    out = []
    for g, t, b in cohort_cells(cohorts, spec):
        horizon = max(t, b)
        for c in sorted(cohorts):
            if c == g:
                out.append((c, g, t, b, horizon, 1))
            elif c == 0 or (spec.control == "notyettreated" and c > horizon):
                out.append((c, g, t, b, horizon, 0))
    return out


MEMBER_SCHEMA = "cohort int, g int, t int, b int, horizon int, d int"
