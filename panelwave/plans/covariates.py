"""Group-time effects with covariates: outcome regression, inverse-probability weighting
and the doubly robust combination.

All cells are handled together, and every pass reads a unit once.  A task takes the units as
Arrow batches; for each cell (at most years^2 of them) it picks the rows of the cell's cohorts and
adds their sums by matrix products, so no unit is multiplied by its cells.  A pass shuffles the
sums of each cell and task.  Only their totals reach the driver, where one small system per cell
is solved.  The passes differ in the numbers that the driver sends along, not in their plan,
so a Newton step compiles nothing.

Functions that run in tasks are nested, so that Spark ships them whole.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelwave.plans.att import Cell, Combined, Effects, Shift, Weights, att_gt_moments, cohort_counts
from panelwave.plans.design import ModelSpec, cell_members, keep, unit_paths
from panelwave.plans.moments import gram, keyed_sums
from panelwave.session import local_table

P_CLIP = 1 - 1e-6
#: Units that a task of a pass takes, about.
UNITS_PER_TASK = 4096


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Solution of a small symmetric system, None if it is (nearly) singular."""
    if not np.all(np.isfinite(a)) or np.linalg.cond(a) > 1e12:
        return None
    return np.linalg.solve(a, b)


@dataclass
class Design:
    """Units with their paths, location and scale of the covariates, and the cells they enter.

    ``units`` has unit, cohort, y (a value per year) and x (the covariates' paths, one after the other).
    """

    spec: ModelSpec
    units: DataFrame
    sizes: dict[int, int]
    centre: list[float]
    spread: list[float]
    dropped: list[str]

    @property
    def k(self) -> int:
        return len(self.centre) + 1

    def members(self) -> list[tuple]:
        return [m for m in cell_members(list(self.sizes), self.spec) if m[2] != m[3]]

    def cells(self, keys: Mapping[Hashable, Sequence[tuple[int, int, int, int]]]) -> Callable:
        """A function that splits a batch of units into cells.

        ``keys`` has (cohort, t, b, d) of the members of each cell.  The function yields, for
        each cell with a row in the batch, its key, the rows, d, the difference of the outcome and the
        standardised covariates of the base year with a leading 1.
        """
        lo, years, centre, spread = self.spec.period[0], len(self.spec.years), self.centre, self.spread
        plan = [(key, rows[0][1] - lo, rows[0][2] - lo, [(c, d) for c, _, _, d in rows]) for key, rows in keys.items()]

        def split(batch: pa.RecordBatch) -> Iterator[tuple]:
            import numpy as np

            n, p = batch.num_rows, len(centre)
            y = np.asarray(batch.column("y").flatten()).reshape(n, years)
            x = np.asarray(batch.column("x").flatten()).reshape(n, p, years).astype(float)
            x = (x - np.array(centre).reshape(1, p, 1)) / np.array(spread).reshape(1, p, 1)
            cohort = np.asarray(batch.column("cohort"))
            at = {int(c): np.flatnonzero(cohort == c) for c in np.unique(cohort)}
            for key, t, b, sides in plan:
                parts = [(at[c], d) for c, d in sides if c in at]
                if parts:
                    rows = np.concatenate([r for r, _ in parts])
                    d = np.concatenate([np.full(len(r), float(d)) for r, d in parts])
                    yield key, rows, d, y[rows, t] - y[rows, b], np.column_stack([np.ones(len(rows)), x[rows, :, b]])

        return split

    def sums(self, keys: Mapping[Hashable, Sequence[tuple[int, int, int, int]]], add: Callable) -> dict:
        """Sums over the rows of each cell: ``add(key, d, dy, x)`` gives those of a batch as a vector.
        The totals are one row per cell and sum; cells without a row are missing."""
        split, names, schema = self.cells(keys), {key: i for i, key in enumerate(keys)}, "cell int, i int, v double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            totals: dict = {}
            for batch in batches:
                for key, _, d, dy, x in split(batch) if batch.num_rows else ():
                    part = np.asarray(add(key, d, dy, x), float)
                    totals[key] = totals[key] + part if key in totals else part
            for key, total in totals.items():
                cell = np.full(len(total), names[key], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "i", "v"]
                )

        if not keys:
            return {}
        partial = self.units.select("cohort", "y", "x").mapInArrow(run, schema)
        rows = partial.groupBy("cell", "i").agg(F.sum("v").alias("v")).toArrow()  # cells x sums, whatever the units
        order = np.lexsort((np.asarray(rows["i"]), np.asarray(rows["cell"])))
        cell, value = np.asarray(rows["cell"])[order], np.asarray(rows["v"])[order]
        listed = list(names)
        return {listed[c]: value[cell == c] for c in np.unique(cell)}


def build_design(panel: DataFrame, spec: ModelSpec) -> Design:
    """Unit table plus location and scale of each covariate.  A covariate without any
    variation is left out and named in ``dropped``.

    The passes read the kept partitions together, as many tasks as the units need: the partitions
    are those of the shuffle that made them, which may be hundreds for a few units."""
    units = keep(unit_paths(panel, spec))
    stats = []
    for j in range(len(spec.covariates)):
        path = F.get("x", F.lit(j))
        total = F.aggregate(path, F.lit(0.0), lambda acc, v: acc + v)
        squares = F.aggregate(path, F.lit(0.0), lambda acc, v: acc + v * v)
        stats += [F.sum(total).alias(f"s{j}"), F.sum(squares).alias(f"q{j}")]
    sums = units.agg(F.sum(F.size("y")).alias("n"), *stats).first()
    centre, spread, kept, dropped = [], [], [], []
    for j, name in enumerate(spec.covariates):
        mean = sums[f"s{j}"] / sums["n"]
        sd = max(sums[f"q{j}"] / sums["n"] - mean * mean, 0.0) ** 0.5
        if sd > 1e-9 * max(1.0, abs(mean)):
            centre.append(mean), spread.append(sd), kept.append(j)
        else:
            dropped.append(name)
    flat = F.flatten(F.array(*[F.get("x", F.lit(j)) for j in kept])) if kept else F.array().cast("array<double>")
    tasks = -(-sums["n"] // (len(spec.years) * UNITS_PER_TASK))  # n counts the years of the units
    units = units.withColumn("x", flat).coalesce(tasks)
    return Design(spec, units, cohort_counts(units), centre, spread, dropped)


def _comparisons(design: Design) -> dict[tuple[int, int, int], list[tuple[int, int, int, int]]]:
    """Members of each comparison (g, base year, horizon); the outcome plays no part in it."""
    out: dict = {}
    for c, g, t, b, h, d in design.members():
        rows = out.setdefault((g, b, h), [])
        if (c, b, b, d) not in rows:
            rows.append((c, b, b, d))
    return out


#: Coefficients (on standardised covariates) beyond this size mean that the arms are separated.
SEPARATED = 50.0


def fit_logit_cells(design: Design) -> dict[tuple[int, int, int], tuple[np.ndarray | None, int, str]]:
    """Logistic regressions of treatment on the covariates, all comparisons at once.

    A comparison is (g, base year, horizon); cells that share one share the fit.  Each
    Newton step is one aggregation of likelihoods, gradients and Hessians; a step that
    lowers the likelihood is halved.  Returns coefficients (standardised scale; None
    without a fit), the number of passes and ``ok``, ``no_control``, ``separated``,
    ``singular_hessian`` or ``not_converged``.
    """
    k, limit = design.k, design.spec.newton_steps
    members, size = _comparisons(design), {}
    for key, rows in members.items():
        counts = size.setdefault(key, [0, 0])
        for c, _, _, d in rows:
            counts[d] += design.sizes[c]
    beta, done, last = {}, {}, {}
    for key, (n0, n1) in size.items():
        if n0 and n1:
            beta[key] = np.concatenate([[np.log(n1 / n0)], np.zeros(k - 1)])
        else:
            done[key] = (None, 0, "no_control")
    for step in range(1, limit + 1):
        if not beta:
            break
        now_at = dict(beta)

        def likelihood(key, d, dy, x):
            import numpy as np

            eta = x @ now_at[key]
            p = 1 / (1 + np.exp(-eta))
            soft = np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta)))
            hess = (x * (p * (1 - p))[:, None]).T @ x
            return np.concatenate([[(d * eta - soft).sum()], (d - p) @ x, hess.ravel()])

        sums = design.sums({key: members[key] for key in beta}, likelihood)
        for key, total in sums.items():
            now, grad, hess = total[0], total[1 : k + 1], total[k + 1 :].reshape(k, k)
            if key in last and now < last[key][1] - 1e-9 * abs(last[key][1]):
                before, value, move = last[key]
                last[key] = (before, value, move / 2)
                beta[key] = before + move / 2
                if np.max(np.abs(move)) < design.spec.newton_tolerance:
                    beta.pop(key)
                    done[key] = (before, step, "ok")
                continue
            move = _solve(hess, grad)
            if move is None or np.max(np.abs(beta[key] + move)) > SEPARATED:
                # a likelihood near its bound 0 has no finite maximum
                apart = move is not None or now > -1e-3 * sum(size[key])
                done[key] = (None, step, "separated" if apart else "singular_hessian")
                del beta[key]
                continue
            last[key] = (beta[key], now, move)
            beta[key] = beta[key] + move
            if np.max(np.abs(move)) < design.spec.newton_tolerance:
                done[key] = (beta.pop(key), step, "ok")
    for key in beta:
        done[key] = (None, limit, "not_converged")
    return done


def propensity_table(design: Design) -> DataFrame:
    """(g, b, horizon, steps, converged, intercept, coef): fits on the covariates' own scale."""
    rows = []
    for (g, b, h), (pi, steps, _) in sorted(fit_logit_cells(design).items()):
        if pi is None:
            rows.append((g, b, h, steps, False, None, None))
            continue
        slopes = [float(v / s) for v, s in zip(pi[1:], design.spread)]
        intercept = float(pi[0] - sum(v * c for v, c in zip(slopes, design.centre)))
        rows.append((g, b, h, steps, True, intercept, slopes))
    schema = "g int, b int, horizon int, steps int, converged boolean, intercept double, coef array<double>"
    return local_table(design.units.sparkSession, rows, schema)


@dataclass(frozen=True)
class CellFit:
    """Numbers that give the influence of a cell's rows."""

    beta: np.ndarray
    pi: np.ndarray
    at: np.ndarray
    ac: np.ndarray
    bp: np.ndarray
    eta_t: float
    eta_c: float
    n_t: float
    w_c: float


def weights_function(est: str) -> Callable:
    """(residual, propensity, control weight) of a cell's rows."""
    clip = P_CLIP

    def weights(beta, pi, d, dy, x):
        import numpy as np

        p = 1 / (1 + np.exp(-(x @ pi)))
        clipped = np.minimum(p, clip)
        return dy - x @ beta, p, np.where(d == 0, clipped / (1 - clipped), 0.0)

    return weights


def influence_function(est: str, n: int, fits: Mapping[tuple[int, int], CellFit]) -> Callable:
    """Influence of a cell's rows on its effect, on the scale of the whole panel."""
    weights = weights_function(est)
    numbers = {key: (f.beta, f.pi, f.at, f.ac, f.bp, f.eta_t, f.eta_c, f.n_t, f.w_c) for key, f in fits.items()}

    def influence(key, d, dy, x):
        beta, pi, at, ac, bp, eta_t, eta_c, n_t, w_c = numbers[key]
        resid, p, odds = weights(beta, pi, d, dy, x)
        treated = d * (resid - eta_t)
        if est in ("dr", "reg"):
            treated = treated - (1 - d) * resid * (x @ at)
        psi = treated / n_t
        if est in ("dr", "ipw"):
            control = odds * (resid - eta_c) + (d - p) * (x @ bp)
            if est == "dr":
                control = control - (1 - d) * resid * (x @ ac)
            psi = psi - control / w_c
        return psi * float(n)

    return influence


@dataclass
class ScoreEffects(Effects):
    """Effects whose influence values are evaluated per unit and cell."""

    design: Design = field(default=None, repr=False)
    fits: dict[tuple[int, int], CellFit] = field(default_factory=dict, repr=False)

    def _members(self) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
        return {key: rows for key, rows in _cell_rows(self.design).items() if key in self.fits}

    def influence(self) -> DataFrame:
        split = self.design.cells(self._members())
        value = influence_function(self.spec.est, self.n, self.fits)
        units = self.design.units
        kind = to_arrow_schema(units.select("unit").schema).field("unit").type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                for (g, t), rows, d, dy, x in split(batch) if batch.num_rows else ():
                    years = [pa.array(np.full(len(rows), year, np.int32)) for year in (g, t)]
                    unit = batch.column("unit").take(pa.array(rows)).cast(kind)
                    yield pa.RecordBatch.from_arrays([unit, *years, pa.array(value((g, t), d, dy, x))], names=["unit", "g", "t", "psi"])

        return units.mapInArrow(run, f"unit {units.schema['unit'].dataType.simpleString()}, g int, t int, psi double")

    def combine(self, names: Sequence[Hashable], weights: Sequence[Weights], shift: Sequence[Shift]) -> Combined:
        """Per unit, the influence of each component as an array: weighted sums over the unit's cells
        and the share term of its cohort.  The rows stay where they are; the vectors are kept, as
        errors and draws both read them."""
        loads, shares = ({k: np.array([x.get(k, 0.0) for x in xs]) for k in {k for x in xs for k in x}} for xs in (weights, shift))
        split = self.design.cells(self._members())
        value = influence_function(self.spec.est, self.n, self.fits)
        units, size = self.design.units, len(names)
        kind = to_arrow_schema(units.select("unit").schema).field("unit").type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                if not batch.num_rows:
                    continue
                total = np.zeros((batch.num_rows, size))
                for key, rows, d, dy, x in split(batch):
                    if key in loads:
                        total[rows] += value(key, d, dy, x)[:, None] * loads[key]
                cohort = np.asarray(batch.column("cohort"))
                for c, h in shares.items():
                    total[cohort == c] += h
                vec = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("unit").cast(kind), vec], names=["unit", "vec"])

        vectors = units.mapInArrow(run, f"unit {units.schema['unit'].dataType.simpleString()}, vec array<double>")
        return UnitScores(list(names), self, keep(vectors))


@dataclass
class UnitScores(Combined):
    """Component influence per unit: (unit, vec) with vec in the order of ``names``."""

    names: list
    effects: ScoreEffects
    vectors: DataFrame

    def covariance(self) -> np.ndarray:
        rows = gram(self.vectors, "vec").toArrow()  # components squared
        out = np.zeros((len(self.names), len(self.names)))
        out[np.asarray(rows["i"]), np.asarray(rows["j"])] = np.asarray(rows["m"])
        return out / float(self.effects.n) ** 2

    def draw_sums(self) -> np.ndarray:
        spec = self.effects.spec
        rows = keyed_sums(self.vectors, "vec", len(self.names), spec.draws, spec.seed).toArrow()
        out = np.zeros((spec.draws, len(self.names)))
        out[np.asarray(rows["draw"]) - 1, np.asarray(rows["idx"])] = np.asarray(rows["q"])
        return out / float(self.effects.n) ** 0.5


def _cell_rows(design: Design) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """Members (cohort, t, b, d) of each cell (g, t)."""
    out: dict = {}
    for c, g, t, b, h, d in design.members():
        out.setdefault((g, t), []).append((c, t, b, d))
    return out


def _cell_regressions(design: Design) -> dict[tuple[int, int], tuple]:
    """Per cell: counts, covariate sums of the treated, and the control regression."""
    k = design.k

    def moments(key, d, dy, x):
        import numpy as np

        control = x * (1 - d)[:, None]
        return np.concatenate([[d.sum(), (1 - d).sum()], d @ x, dy @ control, (control.T @ x).ravel()])

    out = {}
    for key, total in design.sums(_cell_rows(design), moments).items():
        n1, n0 = round(total[0]), round(total[1])
        beta = xx = tx = None
        if n0 >= k and n1:
            tx, xx = total[2 : 2 + k], total[2 + 2 * k :].reshape(k, k)
            beta = _solve(xx, total[2 + k : 2 + 2 * k])
        out[key] = (n1, n0, beta, xx, tx)
    return out


def att_gt_covariates(panel: DataFrame, spec: ModelSpec) -> ScoreEffects:
    """Group-time effects with covariates taken at the base period."""
    design = build_design(panel, spec)
    k, est = design.k, spec.est
    n = sum(design.sizes.values())
    cells = _cell_regressions(design)
    fits = fit_logit_cells(design) if est in ("dr", "ipw") else {}

    zero = np.zeros(k)
    status, start = {}, {}
    for c, g, t, b, h, d in design.members():
        if (g, t) in start:
            continue
        n1, n0, beta, xx, tx = cells.get((g, t), (0, 0, None, None, None))
        pi, _, fitted = fits.get((g, b, h), (None, 0, "no_control"))
        if not n0:
            status[g, t] = "no_control"
        elif n1 < spec.min_treated:
            status[g, t] = "few_treated"
        elif est != "ipw" and beta is None:
            status[g, t] = "singular"
        elif est != "reg" and pi is None:
            status[g, t] = fitted
        else:
            status[g, t] = "ok"
        start[g, t] = (beta if est != "ipw" and beta is not None else zero, pi if pi is not None else zero)

    alive = {key: rows for key, rows in _cell_rows(design).items() if status[key] == "ok"}
    weights, overlap, first = weights_function(est), spec.overlap_limit, {key: start[key] for key in alive}

    def weighted(key, d, dy, x):
        import numpy as np

        r, p, w = weights(*first[key], d, dy, x)
        hess = (x * (p * (1 - p))[:, None]).T @ x
        return np.concatenate([[(d * r).sum(), w.sum(), (w * r).sum(), (p >= overlap).sum()], w @ x, (w * r) @ x, hess.ravel()])

    found, att = {}, {}
    for key, total in design.sums(alive, weighted).items():
        n1, n0, beta, xx, tx = cells[key]
        rt, w, wr, at_limit = total[:4]
        wx, wrx, hess = total[4 : 4 + k], total[4 + k : 4 + 2 * k], total[4 + 2 * k :].reshape(k, k)
        eta_t, eta_c, w_c, at, ac, bp = rt / n1, 0.0, 1.0, zero, zero, zero
        if est != "reg":
            if at_limit or w <= 0:
                status[key] = f"overlap: {round(at_limit)} units at the limit"
                continue
            w_c, eta_c = w, wr / w
            bp = _solve(hess, wrx - eta_c * wx)
            if bp is None:
                status[key] = "singular_hessian"
                continue
            if est == "dr":
                ac = np.linalg.solve(xx, wx)
        if est != "ipw":
            at = np.linalg.solve(xx, tx)
        att[key] = float(eta_t - eta_c)
        found[key] = CellFit(*start[key], at, ac, bp, float(eta_t), float(eta_c), float(n1), float(w_c))

    effects = ScoreEffects(spec, design.units, design.sizes, [], design, found)
    value = influence_function(est, n, found)

    def squares(key, d, dy, x):
        psi = value(key, d, dy, x)
        return [psi @ psi]

    errors = {key: float(total[0]) ** 0.5 / n for key, total in design.sums(effects._members(), squares).items()}
    reference: dict = {}
    for c, g, t, b, h, d in cell_members(list(design.sizes), spec):
        reference[g, t] = reference.get((g, t), 0) + (design.sizes[c] if d == 0 else 0)
    for c, g, t, b, h, d in cell_members(list(design.sizes), spec):
        if d == 1 and t == b:
            effects.cells.append(Cell(g, t, 0.0, None, design.sizes[c], reference[g, t], "ok"))
        elif d == 1:
            n1, n0 = cells.get((g, t), (0, 0))[:2]
            effects.cells.append(Cell(g, t, att.get((g, t)), errors.get((g, t)), n1, n0, status.get((g, t), "no_control")))
    return effects


def att_gt(panel: DataFrame, spec: ModelSpec) -> Effects:
    """Group-time effects for any specification."""
    return att_gt_covariates(panel, spec) if spec.covariates else att_gt_moments(panel, spec)
