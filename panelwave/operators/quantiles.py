"""Exact grouped quantiles that never bring a whole group into one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one task.  Here
three passes do the same with bounded state:

1. a mergeable sketch per group gives cut points close around each wanted rank;
2. counts between the cut points give, exactly, the interval that holds each rank;
3. only the rows of those intervals are shuffled and ranked.

The cut points only decide how much work step 3 has; the result is exact for any of
them.  Ties are collapsed to (value, count) before ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwave.session import persisted


def _interval(value: Column, cuts: Column, n_cuts: int) -> Column:
    """Number of cut points below the value."""
    out = F.lit(0)
    for i in range(n_cuts):
        out = out + F.when(value > F.get(cuts, F.lit(i)), 1).otherwise(0)
    return out


def group_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
    reuse: bool = True,
) -> DataFrame:
    """Linear-interpolation quantiles (type 7) of the non-null values.

    Returns one row per group: the ``by`` columns, ``n`` and ``q`` (array in the order
    of ``probs``).  The passes share a cached copy of the key and value columns; pass
    ``reuse=False`` when reading the input again is cheap.
    """
    by = list(by)
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = df.filter(F.col(value).isNotNull()).select(key.alias("k"), F.col(value).cast("double").alias("v"))
    if reuse:
        rows = persisted(rows)

    margin = 2.0 / accuracy
    marks = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)})
    sketch = persisted(
        rows.groupBy("k").agg(
            F.count("v").alias("n"), F.percentile_approx("v", marks, accuracy).alias("cuts")
        )
    )
    placed = rows.join(sketch.select("k", "cuts"), "k").select(
        "k", "v", _interval(F.col("v"), F.col("cuts"), len(marks)).alias("part")
    )
    running = Window.partitionBy("k").orderBy("part")
    parts = persisted(
        placed.groupBy("k", "part")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("before", F.sum("size").over(running) - F.col("size"))
    )

    # Each probability needs the order statistics on both sides of (n - 1) * p.
    wanted = sketch.select(
        "k", "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p")
    ).withColumn("h", (F.col("n") - 1) * F.col("p"))
    sides = wanted.select(
        "k", "i", F.posexplode(F.array(F.floor("h"), F.ceil("h"))).alias("side", "rank")
    )
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size"))
    targets = persisted(
        sides.join(parts, "k")
        .filter(inside)
        .select("k", "part", "i", "side", (F.col("rank") - F.col("before")).alias("rank"))
    )

    ordered = Window.partitionBy("k", "part").orderBy("v")
    ranked = (
        placed.join(targets.select("k", "part").distinct(), ["k", "part"], "left_semi")
        .groupBy("k", "part", "v")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("before", F.sum("size").over(ordered) - F.col("size"))
    )
    found = ranked.join(targets, ["k", "part"]).filter(inside)
    ends = found.groupBy("k", "i").agg(
        F.max(F.when(F.col("side") == 0, F.col("v"))).alias("lo"),
        F.max(F.when(F.col("side") == 1, F.col("v"))).alias("hi"),
    )
    weight = F.col("h") - F.floor("h")
    quantile = ends.join(wanted, ["k", "i"]).select(
        "k", "n", "i", (F.col("lo") + weight * (F.col("hi") - F.col("lo"))).alias("q")
    )
    out = quantile.groupBy("k").agg(
        F.max("n").alias("n"),
        F.array(*[F.max(F.when(F.col("i") == i, F.col("q"))) for i in range(len(probs))]).alias("q"),
    )
    return out.select(*[F.col(f"k.`{c}`").alias(c) for c in by], "n", "q")


def quantile_bucket(
    df: DataFrame, col: str, probs: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), out: str = "bucket"
) -> DataFrame:
    """Cut a column at its own quantiles: right-closed bins, the lowest value included.

    Adds the bin number (from 1) and its label, "[a, b]" for the first bin and
    "(a, b]" for the others; NULL outside the outermost cut points.
    """
    cuts = group_quantiles(df, col, probs).select("q").scalar()
    df = df.withColumn("__cuts", cuts)
    cut = [F.get("__cuts", F.lit(i)) for i in range(len(probs))]
    number, text = F.when(F.col(col) < cut[0], None), F.when(F.col(col) < cut[0], None)
    for i in range(1, len(probs)):
        left = "[" if i == 1 else "("
        name = F.concat(F.lit(left), _plain(cut[i - 1]), F.lit(", "), _plain(cut[i]), F.lit("]"))
        number, text = number.when(F.col(col) <= cut[i], i), text.when(F.col(col) <= cut[i], name)
    return df.withColumns({out: number, f"{out}_label": text}).drop("__cuts")


def _plain(c: Column) -> Column:
    fixed = F.format_string("%.4f", c)
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def iqr_outliers(
    df: DataFrame, col: str, by: str = "year", k_hi: float = 7.5, k_lo: float = 1.5
) -> DataFrame:
    """Flag values above Q3 + k_hi * IQR or below Q1 - k_lo * IQR of their own ``by`` group.

    Adds ``upper``, ``lower``, ``iqr`` and ``outlier`` (1/0, NULL for a missing value).
    """
    q = persisted(group_quantiles(df, col, (0.25, 0.75), [by]))
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    fences = q.select(
        F.col(by),
        (q3 - q1).alias("iqr"),
        (q3 + k_hi * (q3 - q1)).alias("upper"),
        (q1 - k_lo * (q3 - q1)).alias("lower"),
    )
    beyond = (F.col(col) > F.col("upper")) | (F.col(col) < F.col("lower"))
    flag = F.when(F.col(col).isNull(), None).when(beyond, 1).otherwise(0)
    return df.join(fences, by, "left").withColumn("outlier", flag)
