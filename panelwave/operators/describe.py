"""Descriptive tables: moments and quantiles by arm, Welch differences, densities,
cohort means and treatment histories."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial, pi

from pyspark.sql import DataFrame, functions as F

from panelwave.functions.columns import ratio
from panelwave.functions.student import t_p_value, t_quantile
from panelwave.operators.quantiles import group_quantiles, quantile_bucket
from panelwave.session import persisted


def _long(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """(variable, arm, value) rows without missing values."""
    doubles = [F.col(c).cast("double").alias(c) for c in cols]
    rows = df.select(F.col(by).alias("arm"), *doubles).unpivot("arm", list(cols), "variable", "value")
    return rows.filter(F.col("value").isNotNull())


def describe_by(df: DataFrame, by: str, cols: Sequence[str], stat: str = "mean") -> DataFrame:
    """Per variable and arm: n with mean and sd, or n with q1, median and q3."""
    rows = _long(df, by, cols)
    if stat == "mean":
        return rows.groupBy("variable", "arm").agg(
            F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
        )
    if stat != "median":
        raise ValueError(f"stat must be 'mean' or 'median', not {stat!r}")
    q = group_quantiles(rows, "value", (0.25, 0.5, 0.75), ["variable", "arm"])
    names = ("q1", "median", "q3")
    return q.select("variable", "arm", "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(names)])


def welch(
    df: DataFrame, by: str, cols: Sequence[str], arms: tuple[str, str], confidence: float = 0.95
) -> DataFrame:
    """First arm minus second arm per variable, with unequal variances: difference,
    standard error, degrees of freedom, confidence limits and p-value."""
    rows = _long(df, by, cols)
    stats = []
    for i, arm in enumerate(arms):
        v = F.when(F.col("arm") == arm, F.col("value"))
        stats += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_samp(v).alias(f"v{i}")]
    moments = rows.groupBy("variable").agg(*stats)
    return welch_from_moments(moments, confidence)


def welch_from_moments(moments: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Welch table from rows (variable, n0, m0, v0, n1, m1, v1)."""
    a, b = ratio("v0", "n0"), ratio("v1", "n1")
    table = moments.select(
        "variable",
        (F.col("m0") - F.col("m1")).alias("diff"),
        F.sqrt(a + b).alias("se"),
        ratio((a + b) * (a + b), a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1)).alias("df"),
    )
    t = t_quantile(F.lit(confidence), F.col("df"))
    return table.withColumns(
        {
            "lo": F.col("diff") - t * F.col("se"),
            "hi": F.col("diff") + t * F.col("se"),
            "p_value": t_p_value(ratio("diff", "se"), F.col("df")),
        }
    )


#: Bins per bandwidth and terms of the expansion inside a bin.
BINS, TERMS = 2, 13
#: A bin adds nothing to points further than this many bandwidths from its centre.
REACH = 9.5


def kde_error_bound(bins: int = BINS, terms: int = TERMS) -> float:
    """Largest error of the binned density, as a share of the kernel's peak.

    With values at most d = 1 / (2 * bins) bandwidths from their bin's centre, the terms from
    ``terms`` on of the expansion are below 1.0865 * d^k / sqrt(k!) each (Cramér's bound for
    Hermite functions).  Points beyond the reach would add less than exp(-9^2 / 2).
    """
    d = 0.5 / bins
    return sum(1.0865 * d**k / factorial(k) ** 0.5 for k in range(terms, terms + 40)) + exp(-40.5)


def _hermite(terms: int) -> list[list[float]]:
    """Coefficients of the probabilists' Hermite polynomials, lowest power first."""
    rows: list[list[float]] = [[1.0], [0.0, 1.0]]
    for k in range(1, terms - 1):
        up = [0.0, *rows[k]]
        rows.append([a - k * b for a, b in zip(up, [*rows[k - 1], 0.0, 0.0])])
    return rows[:terms]


def _density_stats(rows: DataFrame) -> DataFrame:
    """(variable, arm, n, from, to, bw): shared range of a variable and bandwidth of an arm."""
    spread = rows.groupBy("variable", "arm").agg(
        F.count("value").alias("n"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    q = group_quantiles(rows, "value", (0.25, 0.75), ["variable", "arm"], reuse=False).select(
        "variable", "arm", ((F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 1.34).alias("iqr")
    )
    ranges = spread.groupBy("variable").agg(F.min("lo").alias("from"), F.max("hi").alias("to"))
    narrow = F.least(F.col("sd"), F.when(F.col("iqr") > 0, F.col("iqr")))
    return persisted(
        spread.join(q, ["variable", "arm"])
        .join(ranges, "variable")
        .select("variable", "arm", "n", "from", "to", (0.9 * narrow * F.pow("n", F.lit(-0.2))).alias("bw"))
    )


def kde(df: DataFrame, by: str, cols: Sequence[str], n: int = 512, exact: bool = False) -> DataFrame:
    """Gaussian kernel density on ``n`` points per variable, by arm: (variable, arm, point, x, density).

    The grid runs over the range of the variable in all arms together; the bandwidth
    is 0.9 * min(sd, IQR / 1.34) * n^(-1/5) per arm; the density of an arm without one is NULL.
    Rows without an arm are left out.

    Two stages, neither of which multiplies the values by the points.  First the values are
    summed into bins of half a bandwidth: each bin keeps the sums of the powers of the
    distances to its centre, combined map-side.  Then every bin adds its Hermite expansion
    to the points within reach.  The error is at most ``kde_error_bound()`` (2.2e-13) of the
    kernel's peak.  A bin holds any number of values, and there are no more bins than values
    and no more than the range has half bandwidths.  ``exact=True`` adds every value's kernel to
    every point instead.
    """
    rows = persisted(_long(df, by, cols))
    stats = _density_stats(rows)
    step = (F.col("to") - F.col("from")) / (n - 1)
    x = F.col("from") + F.col("point") * step
    points = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point")
    if exact:
        grid = rows.join(stats, ["variable", "arm"]).select("*", points)
        z = ratio(x - F.col("value"), "bw")
        kernel = ratio(F.exp(-0.5 * z * z), F.col("n") * F.col("bw") * (2 * F.pi()) ** F.lit(0.5))
        return (
            grid.select("variable", "arm", "point", x.alias("x"), kernel.alias("kernel"))
            .groupBy("variable", "arm", "point")
            .agg(F.max("x").alias("x"), F.sum("kernel").alias("density"))
        )
    # Stage 1: moments of the distance to the bin's centre, in bandwidths.
    place = F.floor((F.col("value") - F.col("from")) / F.col("bw") * BINS)
    binned = rows.join(stats.filter("bw > 0"), ["variable", "arm"]).select(
        "variable", "arm", "bw", "n", "from", "to", place.alias("bin"),
        ((F.col("value") - F.col("from")) / F.col("bw") - (place + 0.5) / BINS).alias("d"),
    )
    power, moments = F.lit(1.0), []
    for k in range(TERMS):
        moments.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("d") / (k + 1)
    bins = binned.groupBy("variable", "arm", "bw", "n", "from", "to", "bin").agg(*moments)
    # Stage 2: the expansion of a bin is the kernel at its centre times a polynomial.
    hermite = _hermite(TERMS)
    terms = [
        sum((F.col(f"m{k}") * hermite[k][j] for k in range(j, TERMS, 2)), F.lit(0.0)).alias(f"a{j}") for j in range(TERMS)
    ]
    centre = (F.col("bin") + 0.5) / BINS  # in bandwidths from the start of the grid
    first = F.greatest(F.ceil(F.try_divide((centre - REACH) * F.col("bw"), step)), F.lit(0))
    last = F.least(F.floor(F.try_divide((centre + REACH) * F.col("bw"), step)), F.lit(n - 1))
    near = bins.select("variable", "arm", "bw", "n", "from", "to", centre.alias("centre"), *terms, first.alias("f"), last.alias("l"))
    near = near.filter("f <= l").select("*", F.explode(F.sequence("f", "l")).alias("point"))
    u = F.col("point") * step / F.col("bw") - F.col("centre")
    near = near.withColumn("u", u)
    poly = F.lit(0.0)
    for j in reversed(range(TERMS)):
        poly = poly * F.col("u") + F.col(f"a{j}")
    part = F.exp(-0.5 * F.col("u") * F.col("u")) * poly / (F.col("n") * F.col("bw") * (2 * pi) ** 0.5)
    sums = near.groupBy("variable", "arm", F.col("point").cast("int").alias("point")).agg(F.sum(part).alias("sum"))
    grid = stats.select("variable", "arm", "bw", "from", "to", points).select("variable", "arm", "point", "bw", x.alias("x"))
    density = F.when(F.col("bw") > 0, F.greatest(F.coalesce("sum", F.lit(0.0)), F.lit(0.0)))
    return grid.join(sums, ["variable", "arm", "point"], "left").select("variable", "arm", "point", "x", density.alias("density"))


def cohort_means(
    df: DataFrame,
    log_col: str,
    level_col: str,
    size_col: str,
    last: int,
    unit: str = "unit_id",
    start: str = "start_year",
    year: str = "year",
    treated: str = "treated",
) -> DataFrame:
    """Mean log outcome, level and per-head level by (year, cohort, treated) of the units
    treated by ``last``, with the cohort's quartile group."""
    ever = df.filter((F.col(start) <= last) & (F.col(treated) == 1)).select(unit).distinct()
    means = (
        df.join(ever, unit, "left_semi")
        .groupBy(year, start, treated)
        .agg(
            F.avg(log_col).alias("mean_log"),
            F.avg(level_col).alias("mean_level"),
            F.avg(ratio(level_col, size_col)).alias("mean_per_capita"),
        )
    )
    return quantile_bucket(persisted(means), start, out="macro_group")


def histories(
    df: DataFrame,
    lo: int,
    hi: int,
    unit: str = "unit_id",
    year: str = "year",
    treated: str = "treated",
) -> DataFrame:
    """Number of units per treatment history, in order of first treatment.

    One letter per year: "C" control unit, "B" treated unit before its treatment,
    "T" treated, "." not observed.
    """
    status = [F.max(F.when(F.col(year) == y, F.col(treated))).alias(f"s{y}") for y in range(lo, hi + 1)]
    first = F.min(F.when((F.col(treated) == 1) & F.col(year).between(lo, hi), F.col(year)))
    per_unit = df.filter(F.col(year).between(lo, hi)).groupBy(unit).agg(first.alias("first_treated"), *status)
    letters = [
        F.when(F.col(f"s{y}").isNull(), ".")
        .when(F.col(f"s{y}") == 1, "T")
        .when(F.col("first_treated").isNull(), "C")
        .otherwise("B")
        for y in range(lo, hi + 1)
    ]
    counted = per_unit.groupBy(F.concat(*letters).alias("history"), "first_treated").agg(
        F.count(F.lit(1)).alias("n_units")
    )
    return counted.orderBy(F.col("first_treated").asc_nulls_last(), "history")
