"""Two-way fixed-effects regressions, exact on balanced and unbalanced panels.

Unit effects are taken out by subtracting unit means; year effects stay in as dummy
regressors.  The normal equations of the demeaned data are

    sum over rows of x x'  -  sum over units of s s' / rows of the unit,   s = sum of x.

Both parts are plain sums: a row has one event-time dummy, one year dummy and a few
covariates, so the first part comes from totals by (year, event time) and the second
from one vector per unit.  No sweeps over the data and no wide dummy matrix are needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelwave.operators.reshape import event_time_names
from panelwave.plans.moments import gram
from panelwave.session import local_table, settle


@dataclass
class TwowayFit:
    names: list[str]
    coef: dict[str, float]
    se: dict[str, float]
    dropped: list[str]
    n_rows: int
    n_units: int
    n_years: int
    sigma2: float


def twoway_fit(
    rows: DataFrame,
    outcome: str,
    dense: Sequence[str],
    event: str | None = None,
    event_levels: Sequence[int] = (),
    unit: str = "unit_id",
    year: str = "year",
) -> TwowayFit:
    """Least squares of ``outcome`` on ``dense`` columns and dummies for the levels of the
    ``event`` column, with unit and year effects and classical standard errors.

    Rows with a missing value are left out.  Regressors without independent variation
    are dropped and named.
    """
    measures = [*dense, outcome]
    level = F.col(event) if event else F.lit(None).cast("int")
    data = rows.select(
        F.col(unit).alias("unit"),
        F.col(year).cast("int").alias("year"),
        F.when(level.isin(list(event_levels)), level).cast("int").alias("event"),
        *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(measures)],
    ).dropna("any", subset=[f"m{i}" for i in range(len(measures))])

    k = len(measures)
    totals = data.groupBy("year", "event").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"m{i}").alias(f"s{i}") for i in range(k)],
        *[F.sum(F.col(f"m{i}") * F.col(f"m{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)],
    ).collect()  # one row per (year, event time)
    years = sorted({r["year"] for r in totals})
    names = [f"e{l}" for l in event_levels] + [f"y{t}" for t in years[1:]] + measures
    at = {name: i for i, name in enumerate(names)}
    first_measure = len(names) - k

    cross = np.zeros((len(names), len(names)))
    for r in totals:
        dummies = [at[d] for d in (f"e{r['event']}", f"y{r['year']}") if d in at]
        for a in dummies:
            for b in dummies:
                cross[a, b] += r["n"]
            for i in range(k):
                cross[a, first_measure + i] += r[f"s{i}"]
                cross[first_measure + i, a] += r[f"s{i}"]
        for i in range(k):
            for j in range(i, k):
                cross[first_measure + i, first_measure + j] += r[f"q{i}_{j}"]
                if i != j:
                    cross[first_measure + j, first_measure + i] += r[f"q{i}_{j}"]

    vector = [F.sum(F.when(F.col("event") == l, 1.0).otherwise(0.0)) for l in event_levels]
    vector += [F.sum(F.when(F.col("year") == t, 1.0).otherwise(0.0)) for t in years[1:]]
    vector += [F.sum(f"m{i}") for i in range(k)]
    per_unit = data.groupBy("unit").agg(F.array(*vector).alias("s"), F.count(F.lit(1)).alias("n"))
    per_unit = per_unit.select(F.concat("s", F.array(F.sqrt("n"))).alias("s"), (1.0 / F.col("n")).alias("w"))
    n_rows = sum(r["n"] for r in totals)
    n_units = 0
    for r in gram(per_unit, "s", weight=F.col("w")).collect():  # at most (regressors + 1)^2 rows
        if r["i"] < len(names) and r["j"] < len(names):
            cross[r["i"], r["j"]] -= r["m"]
        elif r["i"] == r["j"]:
            n_units = round(r["m"])
    return _solve(cross, names, event_levels, dense, years, n_rows, n_units)


def _solve(
    cross: np.ndarray,
    names: list[str],
    event_levels: Sequence[int],
    dense: Sequence[str],
    years: Sequence[int],
    n_rows: int,
    n_units: int,
) -> TwowayFit:
    p = len(names) - 1
    xx, xy, yy = cross[:p, :p], cross[:p, p], cross[p, p]
    wanted = [f"e{l}" for l in event_levels] + list(dense)
    # Year effects first, then regressors in order; one that the earlier ones explain is dropped.
    order = [i for i in range(p) if names[i] not in wanted] + [i for i in range(p) if names[i] in wanted]
    kept: list[int] = []
    for i in order:
        if xx[i, i] <= 1e-9:
            continue
        left = xx[i, i]
        if kept:
            part = xx[np.ix_(kept, [i])][:, 0]
            left -= part @ np.linalg.solve(xx[np.ix_(kept, kept)], part)
        if left > 1e-8 * xx[i, i]:
            kept.append(i)
    inverse = np.linalg.inv(xx[np.ix_(kept, kept)])
    beta = inverse @ xy[kept]
    rss = float(yy - beta @ xy[kept])
    sigma2 = rss / (n_rows - n_units - len(kept))
    errors = np.sqrt(np.maximum(sigma2 * np.diag(inverse), 0.0))
    coef = {names[i]: float(b) for i, b in zip(kept, beta) if names[i] in wanted}
    se = {names[i]: float(s) for i, s in zip(kept, errors) if names[i] in wanted}
    dropped = [w for w in wanted if w not in coef]
    return TwowayFit(wanted, coef, se, dropped, n_rows, n_units, len(years), sigma2)


def event_study(
    panel: DataFrame,
    outcome: str,
    covariates: Sequence[str] = (),
    n_periods: int = 15,
    unit: str = "unit_id",
    year: str = "year",
    start: str = "start_year",
) -> TwowayFit:
    """Event-time dummies from -(n-1) to n-2 plus covariates; never-treated rows and rows
    outside these event times are the baseline."""
    elapsed = F.when(F.coalesce(F.col(start), F.lit(0)) > 0, F.col(year) - F.col(start))
    rows = panel.withColumn("__event", elapsed)
    return twoway_fit(rows, outcome, covariates, "__event", list(event_time_names(n_periods)), unit, year)


def fit_table(panel: DataFrame, fit: TwowayFit) -> DataFrame:
    """(term, coef, se) of a fit; NULL for dropped terms."""
    rows = [(name, fit.coef.get(name), fit.se.get(name)) for name in fit.names]
    return local_table(panel.sparkSession, rows, "term string, coef double, se double")


def event_study_table(panel: DataFrame, fit: TwowayFit, n_periods: int = 15, alpha: float = 0.05) -> DataFrame:
    """One row per event time: coefficient, error, normal interval and a post flag.
    Event times are found by name, so a dropped one is NULL and moves no other."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    rows = [
        (fit.coef.get(f"e{l}"), fit.se.get(f"e{l}"), l) for l in event_time_names(n_periods)
    ]
    table = local_table(panel.sparkSession, rows, "coefs double, ses double, time_of_exposure int")
    return table.withColumns(
        {
            "lo": F.col("coefs") - z * F.col("ses"),
            "hi": F.col("coefs") + z * F.col("ses"),
            "post": F.col("time_of_exposure") >= 0,
        }
    )
