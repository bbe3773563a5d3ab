"""Aggregations of group-time effects, with standard errors that include the estimated
cohort shares, and simultaneous bands.

Effects, components and draws are small arrays, whose size the years and the number of draws
bound; the passes over the units behind them are in ``att`` and ``covariates``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame

from panelwave.plans.att import Cell, Combined, Effects, Shift, Weights
from panelwave.session import local_table

KINDS = ("simple", "dynamic", "dynamic_balanced", "group", "calendar")
OVERALL = "overall"
ROWS = "egt int, att double, se double, crit double, lo double, hi double"


def z_value(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


@dataclass
class Aggregate:
    """``table``: (egt, att, se, crit, lo, hi).  ``overall``: one row (att, se, lo, hi)
    whose interval always uses the normal quantile."""

    kind: str
    effects: Effects
    table: DataFrame
    overall: DataFrame
    combined: Combined
    balance_e: int | None

    def covariances(self) -> DataFrame:
        """(comp1, comp2, v) of the components, among them the overall effect."""
        cov = self.combined.covariance()
        mine = [(i, comp) for i, (kind, comp) in enumerate(self.combined.names) if kind == self.kind]
        rows = [(a, b, float(cov[i, j])) for i, a in mine for j, b in mine]
        return local_table(self.effects.spark, rows, "comp1 string, comp2 string, v double")


def _enters(g: int, t: int, kind: str, period: tuple[int, int], balance_e: int) -> bool:
    """Whether a cell belongs to an aggregation."""
    lo, hi = period
    if kind == "dynamic_balanced":
        return hi - g >= balance_e and balance_e - (hi - lo) <= t - g <= balance_e
    return kind == "dynamic" or t >= g


def lost_cells(effects: Effects, kind: str, balance_e: int) -> list[tuple[int, int, int, str]]:
    """Cells of an aggregation that have no estimate.

    A cell without any control unit has nothing to be compared with and is not an effect
    of the design.  Any other one stops the aggregation unless the specification says
    ``drop_bad_cells``; the remaining weights would otherwise be taken for all units.
    """
    lost = [c for c in effects.bad_cells if _enters(c[0], c[1], kind, effects.spec.period, balance_e)]
    failed = [c for c in lost if c[3] != "no_control"]
    if failed and not effects.spec.drop_bad_cells:
        listed = ", ".join(f"(g={g}, t={t}: {status})" for g, t, _, status in failed[:20])
        raise ValueError(f"{len(failed)} cells without an estimate: {listed}; drop_bad_cells=True leaves them out")
    return lost


def _kept_cells(effects: Effects, kind: str, balance_e: int) -> list[Cell]:
    """Usable cells of an aggregation."""
    lost_cells(effects, kind, balance_e)
    period = effects.spec.period
    return [c for c in effects.cells if c.cell_status == "ok" and _enters(c.g, c.t, kind, period, balance_e)]


def component_weights(
    effects: Effects, kind: str, balance_e: int | None = None
) -> tuple[dict[str, Weights], dict[str, Shift]]:
    """Weights of the cells and share terms of the cohorts, for all components of an
    aggregation, the overall effect among them.

    A component with share weights is sum(pg * ATT) / sum(pg).  Estimating the shares
    adds, for the units of a cohort, the sum of (ATT - component) / sum(pg) over that
    cohort's cells.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    cells = _kept_cells(effects, kind, effects.spec.balance_e if balance_e is None else balance_e)
    place = {
        "simple": lambda c: OVERALL,
        "dynamic": lambda c: str(c.t - c.g),
        "dynamic_balanced": lambda c: str(c.t - c.g),
        "calendar": lambda c: str(c.t),
        "group": lambda c: str(c.g),
    }[kind]
    parts: dict[str, list[Cell]] = {}
    for c in cells:
        parts.setdefault(place(c), []).append(c)
    weights: dict[str, dict[tuple[int, int], float]] = {}
    shift: dict[str, dict[int, float]] = {}
    if kind == "group":
        _group_weights(effects, parts, weights, shift)
        return weights, shift
    for comp, mine in parts.items():
        s = sum(effects.share(c.g) for c in mine)
        theta = sum(effects.share(c.g) * c.att for c in mine) / s
        weights[comp] = {(c.g, c.t): effects.share(c.g) / s for c in mine}
        shift[comp] = {}
        for c in mine:
            shift[comp][c.g] = shift[comp].get(c.g, 0.0) + (c.att - theta) / s
    if kind != "simple":
        averaged = [comp for comp in parts if kind == "calendar" or int(comp) >= 0]
        for out in (weights, shift):
            total: dict = {}
            for comp in averaged:
                for key, value in out[comp].items():
                    total[key] = total.get(key, 0.0) + value / len(averaged)
            out[OVERALL] = total
    return weights, shift


def _group_weights(effects: Effects, parts: dict[str, list[Cell]], weights: dict, shift: dict) -> None:
    """Within a cohort a plain mean over time; overall, cohort-share weights."""
    share = {comp: effects.share(mine[0].g) for comp, mine in parts.items()}
    means = {comp: sum(c.att for c in mine) / len(mine) for comp, mine in parts.items()}
    s = sum(share.values())
    theta = sum(share[comp] * means[comp] for comp in parts) / s if s else 0.0
    overall, term = {}, {}
    for comp, mine in parts.items():
        weights[comp], shift[comp] = {(c.g, c.t): 1 / len(mine) for c in mine}, {}
        overall |= {(c.g, c.t): share[comp] / s / len(mine) for c in mine}
        term[mine[0].g] = (means[comp] - theta) / s
    weights[OVERALL], shift[OVERALL] = overall, term


def _draw_scale(draws: np.ndarray) -> np.ndarray:
    """Robust spread of the multiplier sums of each component."""
    iqr_to_sd = NormalDist().inv_cdf(0.75) - NormalDist().inv_cdf(0.25)
    low, high = np.quantile(draws, [0.25, 0.75], axis=0) if draws.shape[1] else (np.zeros(0), np.zeros(0))
    return (high - low) / iqr_to_sd


def _band_crit(draws: np.ndarray, scale: np.ndarray, alpha: float) -> float | None:
    """Critical value of a simultaneous band over components with these draws."""
    moves = scale > 1e-12
    if not moves.any():
        return None
    return float(np.quantile(np.abs(draws[:, moves] / scale[moves]).max(axis=1), 1 - alpha))


def _combined(effects: Effects, kinds: Sequence[str], balance_e: int | None) -> tuple[Combined, list[float]]:
    """All components of several aggregations, named (kind, component), and their effects."""
    names, weights, shift = [], [], []
    for kind in kinds:
        w, h = component_weights(effects, kind, balance_e)
        for comp in w:
            names.append((kind, comp)), weights.append(w[comp]), shift.append(h[comp])
    att = {(c.g, c.t): c.att for c in effects.cells}
    values = [sum(x * att[key] for key, x in w.items()) for w in weights]
    return effects.combine(names, weights, shift), values


def aggregate_all(
    effects: Effects, kinds: Sequence[str] = KINDS, balance_e: int | None = None
) -> dict[str, Aggregate]:
    """Several aggregations with their tables and overall effects.

    The components of all of them share one pass over the units for the standard errors
    and one for the bootstrap draws.  Standard errors are analytic, or come from the
    bootstrap if the specification asks for it.  With ``cband`` the critical value of a
    table is that of a simultaneous band, also when the standard errors are analytic.
    """
    spec = effects.spec
    combined, att = _combined(effects, kinds, balance_e)
    names, z = combined.names, z_value(spec.alpha)
    banded = spec.cband and any(kind != "simple" for kind in kinds)
    if spec.bootstrap or banded:
        draws = combined.draw_sums()
        scale = _draw_scale(draws)
    if spec.bootstrap:
        errors = [float(x) / effects.n**0.5 if x > 1e-12 else None for x in scale]
    else:
        errors = [float(v) ** 0.5 if v > 1e-20 else None for v in np.diag(combined.covariance())]
    out = {}
    for kind in kinds:
        crit = None
        if banded:
            inner = [i for i, (k, comp) in enumerate(names) if k == kind and comp != OVERALL]
            crit = _band_crit(draws[:, inner], scale[inner], spec.alpha)
        rows = {comp: (att[i], errors[i]) for i, (k, comp) in enumerate(names) if k == kind}
        out[kind] = _aggregate(effects, kind, rows, z if crit is None else crit, combined, balance_e)
    return out


def _bounds(att: float, se: float | None, m: float) -> tuple[float | None, float | None]:
    return (None, None) if se is None else (att - m * se, att + m * se)


def _aggregate(
    effects: Effects,
    kind: str,
    rows: dict[str, tuple[float, float | None]],
    crit: float,
    combined: Combined,
    balance_e: int | None,
) -> Aggregate:
    z = z_value(effects.spec.alpha)
    table = [
        (None if comp == OVERALL else int(comp), att, se, crit, *_bounds(att, se, crit))
        for comp, (att, se) in rows.items()
        if comp != OVERALL or kind == "simple"
    ]
    overall = [(att, se, *_bounds(att, se, z)) for comp, (att, se) in rows.items() if comp == OVERALL]
    more, counted = "", "n_cells_dropped long, n_treated_dropped long"
    if effects.spec.drop_bad_cells:
        table, overall = _with_losses(effects, kind, table, overall, balance_e)
        more = f", {counted}"
    spark = effects.spark
    return Aggregate(
        kind,
        effects,
        local_table(spark, table, ROWS + more),
        local_table(spark, overall, "att double, se double, lo double, hi double" + more),
        combined,
        balance_e,
    )


def _with_losses(
    effects: Effects, kind: str, table: list[tuple], overall: list[tuple], balance_e: int | None
) -> tuple[list[tuple], list[tuple]]:
    """Adds n_cells_dropped and n_treated_dropped: cells left out of a component, and treated
    units of the cohorts they belong to.  A component that lost all its cells has a row without
    an effect."""
    lost = lost_cells(effects, kind, effects.spec.balance_e if balance_e is None else balance_e)
    part = {"dynamic": lambda g, t: t - g, "dynamic_balanced": lambda g, t: t - g, "group": lambda g, t: g, "calendar": lambda g, t: t}
    place = part.get(kind, lambda g, t: None)
    by: dict[int | None, dict[int, list[int]]] = {}
    for g, t, n, _ in lost:
        cells = by.setdefault(place(g, t), {}).setdefault(g, [0, 0])
        cells[0] += 1
        cells[1] = max(cells[1], n)
    losses = {k: (sum(c for c, _ in v.values()), sum(n for _, n in v.values())) for k, v in by.items()}
    known = {row[0] for row in table}
    table = [(*row, *losses.get(row[0], (0, 0))) for row in table]
    table += [(k, *[None] * 5, *count) for k, count in losses.items() if k not in known]
    treated = {g: max(n for a, _, n, _ in lost if a == g) for g, *_ in lost}
    return table, [(*row, len(lost), sum(treated.values())) for row in overall]


def aggregate(effects: Effects, kind: str, balance_e: int | None = None) -> Aggregate:
    """One of the five aggregations."""
    return aggregate_all(effects, (kind,), balance_e)[kind]


def bootstrap_table(effects: Effects, kind: str) -> DataFrame:
    """(egt, se_bootstrap) of an aggregation's components, the overall effect as NULL."""
    combined, _ = _combined(effects, (kind,), None)
    rows = [
        (None if comp == OVERALL else int(comp), float(x) / effects.n**0.5 if x > 1e-12 else None)
        for (_, comp), x in zip(combined.names, _draw_scale(combined.draw_sums()))
    ]
    return local_table(effects.spark, rows, "egt int, se_bootstrap double")
