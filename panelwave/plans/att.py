"""Group-time effects without covariates, from cohort moments.

With no covariates every effect and every influence value is linear in the outcome
path of a unit, with coefficients that depend on its cohort only.  One pass over the
units therefore gives all that is needed: per cohort, the cross products of
(1, y_1, ..., y_T).  Cells, standard errors, all aggregations and their covariance
follow from these matrices, whose size depends on the number of years alone; like all tables
of cells, components and draws they are arrays on the driver.
"""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwave.plans.design import ModelSpec, cell_members, keep, unit_paths
from panelwave.plans.moments import gram, keyed_sums
from panelwave.session import local_table

class Cell(NamedTuple):
    """A group-time effect; ``att`` is missing unless the status is "ok", ``se`` also in the base period."""

    g: int
    t: int
    att: float | None
    se: float | None
    n_treated: int
    n_control: int
    cell_status: str


CELL_SCHEMA = "g int, t int, att double, se double, n_treated long, n_control long, cell_status string"

#: Coefficients of a component on the cells' influence, and on the indicators of cohorts.
Weights = Mapping[tuple[int, int], float]
Shift = Mapping[int, float]


@dataclass
class Effects:
    """Group-time effects with what is needed to combine them.

    Components are linear combinations of cells: weights by (g, t) plus a term that depends on
    a unit's cohort, for weights that are estimated.
    """

    spec: ModelSpec
    units: DataFrame
    sizes: dict[int, int]
    cells: list[Cell]

    @property
    def n(self) -> int:
        return sum(self.sizes.values())

    @property
    def spark(self) -> SparkSession:
        return self.units.sparkSession

    @cached_property
    def table(self) -> DataFrame:
        """(g, t, att, se, n_treated, n_control, cell_status)."""
        return local_table(self.spark, self.cells, CELL_SCHEMA)

    def share(self, g: int) -> float:
        return self.sizes[g] / self.n

    @property
    def bad_cells(self) -> list[tuple[int, int, int, str]]:
        """(g, t, n_treated, cell_status) of the cells without an estimate."""
        return sorted((c.g, c.t, c.n_treated or 0, c.cell_status) for c in self.cells if c.cell_status != "ok")

    def influence(self) -> DataFrame:
        """(unit, g, t, psi) for the units of each cell; psi is 0 for all other units."""
        raise NotImplementedError

    def combine(self, names: Sequence[Hashable], weights: Sequence[Weights], shift: Sequence[Shift]) -> Combined:
        """The components of an aggregation, ready for their second moments and draws."""
        raise NotImplementedError


class Combined:
    """Influence of a set of components, in the order of ``names``."""

    names: Sequence[Hashable]

    def covariance(self) -> np.ndarray:
        """Sums of products of the influence of all pairs of components, divided by n^2."""
        raise NotImplementedError

    def draw_sums(self) -> np.ndarray:
        """Multiplier sums of the influence over sqrt(n), a row per draw."""
        raise NotImplementedError


def cohort_counts(units: DataFrame) -> dict[int, int]:
    """Units per cohort of a design; it has a cohort per year of the window and two more at most."""
    return {r["cohort"]: r["n"] for r in units.groupBy("cohort").agg(F.count(F.lit(1)).alias("n")).collect()}


@dataclass
class MomentEffects(Effects):
    #: cross products of (1, y_1 - y_1, ..., y_T - y_1) by cohort, and per cell the two means
    moments: dict[int, np.ndarray] = field(default_factory=dict, repr=False)
    means: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict, repr=False)

    def _members(self) -> list[tuple[int, int, int, int, float, float]]:
        """(cohort, g, t, b, scale, mean) of psi = scale * (dy - mean), per cell and member cohort."""
        at = {(c.g, c.t): c for c in self.cells if c.cell_status == "ok"}
        out = []
        for cohort, g, t, b, _, d in cell_members(list(self.sizes), self.spec):
            if t != b and (g, t) in at:
                scale = self.n / at[g, t].n_treated if d else -self.n / at[g, t].n_control
                out.append((cohort, g, t, b, scale, self.means[g, t][d]))
        return out

    def influence(self) -> DataFrame:
        lo = self.spec.period[0]
        dy = F.get("y", F.col("t") - lo) - F.get("y", F.col("b") - lo)
        members = local_table(self.spark, self._members(), "cohort int, g int, t int, b int, scale double, mean double")
        rows = self.units.join(members, "cohort")
        return rows.select("unit", "g", "t", (F.col("scale") * (dy - F.col("mean"))).alias("psi"))

    @cached_property
    def path_draws(self) -> dict[int, np.ndarray]:
        """Multiplier sums of the outcome paths by cohort (draws x p); every aggregation uses them."""
        spec, p = self.spec, len(self.spec.years) + 1
        z = self.units.select("unit", "cohort", _path().alias("z"))
        return _by_cohort(keyed_sums(z, "z", p, spec.draws, spec.seed, ("cohort",)), ("draw", "idx", "q"), (spec.draws, p), 1)

    def combine(self, names: Sequence[Hashable], weights: Sequence[Weights], shift: Sequence[Shift]) -> Combined:
        """Influence of each component as coefficients on (1, y_1, ..., y_T), by cohort."""
        lo, p = self.spec.period[0], len(self.spec.years) + 1
        load = {c: np.zeros((len(names), p)) for c in self.sizes}
        w = {key: np.array([x.get(key, 0.0) for x in weights]) for key in {k for x in weights for k in x}}
        for cohort, g, t, b, scale, mean in self._members():
            if (g, t) in w:
                load[cohort][:, t - lo + 1] += scale * w[g, t]
                load[cohort][:, b - lo + 1] -= scale * w[g, t]
                load[cohort][:, 0] -= scale * mean * w[g, t]
        for k, terms in enumerate(shift):
            for cohort, h in terms.items():
                load[cohort][k, 0] += h
        return Loadings(list(names), self, load)


@dataclass
class Loadings(Combined):
    """Components as coefficients on (1, y_1, ..., y_T), a matrix components x p for each cohort."""

    names: list
    effects: MomentEffects
    load: dict[int, np.ndarray]

    def covariance(self) -> np.ndarray:
        total = sum(a @ self.effects.moments[c] @ a.T for c, a in self.load.items())
        return total / float(self.effects.n) ** 2

    def draw_sums(self) -> np.ndarray:
        drawn = self.effects.path_draws
        return sum(drawn[c] @ a.T for c, a in self.load.items()) / float(self.effects.n) ** 0.5


def _path() -> F.Column:
    """(1, y_1 - y_1, ..., y_T - y_1).  Only differences within a unit matter, and small
    numbers keep the cross products accurate."""
    first = F.get("y", F.lit(0))
    return F.concat(F.array(F.lit(1.0)), F.transform("y", lambda v: v - first))


def _by_cohort(
    rows: DataFrame, names: tuple[str, str, str], shape: tuple[int, int], first: int = 0
) -> dict[int, np.ndarray]:
    """A matrix for each cohort from rows (cohort, i, j, value); i counts from ``first``."""
    table = rows.toArrow()
    cohort, i, j, value = (np.asarray(table[c]) for c in ("cohort", *names))
    out = {int(c): np.zeros(shape) for c in np.unique(cohort)}
    for c, matrix in out.items():
        mine = cohort == c
        matrix[i[mine] - first, j[mine]] = value[mine]
    return out


def cell_status(spec: ModelSpec, n_treated: int, n_control: int) -> str:
    return "no_control" if not n_control else "few_treated" if n_treated < spec.min_treated else "ok"


def att_gt_moments(panel: DataFrame, spec: ModelSpec) -> MomentEffects:
    """Group-time effects without covariates, for either control group and base period."""
    units = keep(unit_paths(panel, spec.but(covariates=())))
    p, lo = len(spec.years) + 1, spec.period[0]
    moments = _by_cohort(gram(units.select("cohort", _path().alias("z")), "z", ("cohort",)), ("i", "j", "m"), (p, p))
    sizes = {c: round(float(m[0, 0])) for c, m in moments.items()}

    sums: dict[tuple[int, int, int], np.ndarray] = {}  # rows: control, treated; columns: n, sum and sum of squares of dy
    for cohort, g, t, b, _, d in cell_members(list(sizes), spec):
        m, i, j = moments[cohort], t - lo + 1, b - lo + 1
        total = sums.setdefault((g, t, b), np.zeros((2, 3)))
        total[d] += m[0, 0], m[0, i] - m[0, j], m[i, i] + m[j, j] - 2 * m[i, j]
    cells, means = [], {}
    for (g, t, b), ((n0, s0, q0), (n1, s1, q1)) in sums.items():
        status, att, se = cell_status(spec, round(n1), round(n0)), None, None
        if status == "ok":
            m0, m1 = s0 / n0, s1 / n1
            att, means[g, t] = float(m1 - m0), (float(m0), float(m1))
            spread = max(q0 / n0 - m0 * m0, 0.0) / n0 + max(q1 / n1 - m1 * m1, 0.0) / n1
            se = float(spread**0.5) if t != b else None
        cells.append(Cell(g, t, att, se, round(n1), round(n0), status))
    return MomentEffects(spec, units, sizes, cells, moments, means)


def did_2x2(panel: DataFrame, spec: ModelSpec, g: int, pre: int, post: int) -> DataFrame:
    """Two periods, one cohort against the controls untreated in both: one row with the
    four means and their double difference."""
    start = F.coalesce(F.col(spec.cohort), F.lit(0))
    horizon = max(pre, post)
    late = start > (horizon if spec.control == "notyettreated" else spec.period[1])
    control = (start == 0) | late
    rows = panel.filter(F.col(spec.time).isin(pre, post)).select(
        F.col(spec.time).alias("t"),
        F.when(start == g, 1).when(control, 0).alias("d"),
        F.col(spec.outcome).cast("double").alias("y"),
    )
    mean = lambda d, t: F.avg(F.when((F.col("d") == d) & (F.col("t") == t), F.col("y")))
    means = rows.filter(F.col("d").isNotNull()).agg(
        mean(1, pre).alias("treated_pre"),
        mean(1, post).alias("treated_post"),
        mean(0, pre).alias("control_pre"),
        mean(0, post).alias("control_post"),
    )
    change = F.col("treated_post") - F.col("treated_pre") - (F.col("control_post") - F.col("control_pre"))
    return means.withColumn("did", change)
