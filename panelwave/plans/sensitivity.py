"""Sensitivity of an event-time effect to departures from parallel trends.

The intervals here have closed forms.  They are valid but wider than, or less exact
than, intervals found by optimisation over all linear estimators:

* smoothness: the trend may bend by at most M per period.  The last two pre-period points
  are extrapolated linearly and the worst-case bias M (e+1)(e+2)/2 is added;
* relative magnitude: each post-period step of the trend is at most Mbar times the
  largest pre-period step, which is taken at its point estimate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwave.plans.aggregate import OVERALL, Aggregate, z_value
from panelwave.session import settle


def _check(agg: Aggregate) -> None:
    if agg.kind not in ("dynamic", "dynamic_balanced"):
        raise ValueError("sensitivity needs a dynamic aggregation")
    if agg.effects.spec.base != "universal":
        raise ValueError("sensitivity needs a universal base period")


def _needs(agg: Aggregate, e: int, steps: bool) -> None:
    """Stop unless the event times that a method uses are there."""
    have = {r["egt"] for r in agg.table.filter("att IS NOT NULL").select("egt").collect()}
    wanted = {e, -1, -2} if not steps else {e, -1, -2} | set(range(min(have, default=0), 0))
    if missing := sorted(wanted - have):
        raise ValueError(f"no effect at event times {missing}; have {sorted(have)}")


def event_cov(agg: Aggregate) -> DataFrame:
    """(e1, e2, v): covariance of the event-time effects, without the reference e = -1."""
    _check(agg)
    inner = (F.col("comp1") != OVERALL) & (F.col("comp2") != OVERALL)
    cov = agg.covariances().filter(inner)
    rows = cov.select(
        F.col("comp1").try_cast("int").alias("e1"), F.col("comp2").try_cast("int").alias("e2"), "v"
    )
    return settle(rows.filter((F.col("e1") != -1) & (F.col("e2") != -1)))


def _betas(agg: Aggregate) -> DataFrame:
    return agg.table.select(F.col("egt").alias("e"), "att")


def original_ci(agg: Aggregate, e: int = 0, alpha: float | None = None, cov: DataFrame | None = None) -> DataFrame:
    """Conventional interval of the effect at event time ``e``: (e, lo, hi)."""
    z = z_value(agg.effects.spec.alpha if alpha is None else alpha)
    v = (event_cov(agg) if cov is None else cov).filter((F.col("e1") == e) & (F.col("e2") == e))
    row = _betas(agg).filter(F.col("e") == e).join(v.select(F.col("e1").alias("e"), "v"), "e")
    half = z * F.sqrt("v")
    return row.select("e", (F.col("att") - half).alias("lo"), (F.col("att") + half).alias("hi"))


def _with_grid(row: DataFrame, name: str, grid: Sequence[float]) -> DataFrame:
    return row.withColumn(name, F.explode(F.array(*[F.lit(float(m)) for m in grid])))


def smoothness_sweep(
    agg: Aggregate, e: int, grid: Sequence[float], alpha: float | None = None, cov: DataFrame | None = None
) -> DataFrame:
    """(m, estimate, bias, lo, hi) for every bound M on the bend of the trend."""
    z = z_value(agg.effects.spec.alpha if alpha is None else alpha)
    _needs(agg, e, steps=False)
    cov = event_cov(agg) if cov is None else cov
    slope = float(e + 1)
    pick = lambda at: F.max(F.when(F.col("e") == at, F.col("att")))
    point = _betas(agg).agg((pick(e) + slope * pick(-2)).alias("estimate"))
    both = lambda a, b: (F.col("e1") == a) & (F.col("e2") == b)
    var = cov.agg(
        (
            F.max(F.when(both(e, e), F.col("v")))
            + slope**2 * F.max(F.when(both(-2, -2), F.col("v")))
            + 2 * slope * F.max(F.when(both(e, -2), F.col("v")))
        ).alias("v")
    )
    row = point.withColumn("se", F.sqrt(var.scalar()))
    rows = _with_grid(row, "m", grid).withColumn("bias", F.col("m") * (e + 1) * (e + 2) / 2)
    half = F.col("bias") + z * F.col("se")
    return rows.select(
        "m", "estimate", "bias", (F.col("estimate") - half).alias("lo"), (F.col("estimate") + half).alias("hi")
    )


def relative_magnitude_sweep(
    agg: Aggregate, e: int, grid: Sequence[float], alpha: float | None = None, cov: DataFrame | None = None
) -> DataFrame:
    """(m, estimate, bias, lo, hi) for every positive multiple Mbar; 0 is left out."""
    z = z_value(agg.effects.spec.alpha if alpha is None else alpha)
    _needs(agg, e, steps=True)
    cov = event_cov(agg) if cov is None else cov
    betas = _betas(agg)
    pre = betas.filter(F.col("e") < 0)
    step = pre.alias("a").join(pre.alias("b"), F.col("b.e") == F.col("a.e") + 1)
    largest = step.agg(F.max(F.abs(F.col("b.att") - F.col("a.att")))).scalar()
    se = cov.filter((F.col("e1") == e) & (F.col("e2") == e)).agg(F.sqrt(F.max("v"))).scalar()
    row = betas.filter(F.col("e") == e).select(
        F.col("att").alias("estimate"), largest.alias("step"), se.alias("se")
    )
    rows = _with_grid(row, "m", [m for m in grid if m > 0])
    rows = rows.withColumn("bias", (e + 1) * F.col("m") * F.col("step"))
    half = F.col("bias") + z * F.col("se")
    return rows.select(
        "m", "estimate", "bias", (F.col("estimate") - half).alias("lo"), (F.col("estimate") + half).alias("hi")
    )


def sensitivity(agg: Aggregate, kind: str, e: int, grid: Sequence[float], alpha: float | None = None) -> DataFrame:
    if kind not in ("smoothness", "relative_magnitude"):
        raise ValueError(f"unknown kind {kind!r}")
    sweep = smoothness_sweep if kind == "smoothness" else relative_magnitude_sweep
    return sweep(agg, e, grid, alpha)
