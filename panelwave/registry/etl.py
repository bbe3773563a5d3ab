"""Queries for joins, grouped summaries, outliers and descriptive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwave.operators import (
    describe as Ds,
    frames as O,
    joins as J,
    quantiles as Q,
    rollups as A,
)
from panelwave.plans.design import keep
from panelwave.registry.catalog import query, r, rounded, table
from panelwave.registry.panels import (
    CUST_CTE,
    CUST_PANEL_CTE,
    SEG_CTE,
    SEG_DID_CTE,
    cust_panel,
    customers,
    seg_did,
    seg_panel,
    seg_units,
)
from panelwave.registry.transforms import ADOPTION_CTE, first_orders

SEG, DID, CUST = f"WITH {SEG_CTE}", f"WITH {SEG_DID_CTE}", f"WITH {CUST_PANEL_CTE}"

# ---------------------------------------------------------------- joins


def shipped_by_unit(spark: SparkSession, sf: str) -> DataFrame:
    """(unit_id, year, qty): quantity of the line items by segment unit and ship year.

    Line items are summed per order and year before they meet the orders.
    """
    items = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"), F.year("l_shipdate").alias("year"))
        .agg(F.sum("l_quantity").alias("qty"))
    )
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("custkey"))
    return (
        items.join(orders, "k")
        .join(customers(spark, sf), "custkey")
        .groupBy("unit_id", "year")
        .agg(F.sum("qty").alias("qty"))
    )


SHIPPED_CTE = """shipped AS (SELECT unit_id, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = custkey
  GROUP BY unit_id, year(l_shipdate))"""


@query(
    "build_panel",
    f"""{SEG}, {SHIPPED_CTE},
    grid AS (SELECT unit_id, CAST(range AS INTEGER) AS year FROM seg_units CROSS JOIN range(1995, 2003))
    SELECT g.unit_id, g.year, u.start_year, s.n_orders, {r('u.area', 'area')}, h.qty, s2.n_cust,
           {r('s2.total', 'total', 2)}
    FROM grid g LEFT JOIN seg_units u ON u.unit_id = g.unit_id
    LEFT JOIN seg s ON s.unit_id = g.unit_id AND s.year = g.year
    LEFT JOIN shipped h ON h.unit_id = g.unit_id AND h.year = g.year
    LEFT JOIN seg s2 ON s2.unit_id = g.unit_id AND s2.year = g.year""",
)
def build_panel(spark: SparkSession, sf: str) -> DataFrame:
    units, panel = keep(seg_units(spark, sf)), keep(seg_panel(spark, sf))
    years = F.explode(F.sequence(F.lit(1995), F.lit(2002)))
    spine = units.select("unit_id", years.alias("year"), (F.col("unit_id") + 100000).alias("unit6"))
    by_code = panel.select((F.col("unit_id") + 100000).alias("code"), "year", "n_cust", "total")
    specs = [
        J.JoinSpec(units.select("unit_id", "start_year"), ["unit_id"]),
        J.JoinSpec(panel.select("unit_id", "year", "n_orders"), ["unit_id", "year"]),
        J.JoinSpec(units.select("unit_id", "area"), ["unit_id"]),
        J.JoinSpec(shipped_by_unit(spark, sf), ["unit_id", "year"]),
        J.JoinSpec(by_code, {"unit6": "code", "year": "year"}),
    ]
    return rounded(rounded(J.build_panel(spine, specs), ["area"]), ["total"], 2).drop("unit6")


@query(
    "join_on_renamed_key",
    """WITH t AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders
                  FROM orders GROUP BY o_custkey, year(o_orderdate))
       SELECT c_custkey AS unit_id, y.year, n_orders FROM customer CROSS JOIN (SELECT DISTINCT year FROM t) y
       LEFT JOIN t ON t.code = c_custkey AND t.year = y.year""",
)
def join_on_renamed_key(spark: SparkSession, sf: str) -> DataFrame:
    years = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    span = years.agg(F.sequence(F.min("year"), F.max("year"))).scalar()
    spine = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.explode(span).alias("year"))
    return J.attach(spine, J.JoinSpec(years, {"unit_id": "code", "year": "year"}))


@query(
    "merge_two_sources",
    f"""{SEG}, {SHIPPED_CTE} SELECT seg.unit_id, seg.year, n_orders, qty FROM seg
        LEFT JOIN shipped ON shipped.unit_id = seg.unit_id AND shipped.year = seg.year""",
)
def merge_two_sources(spark: SparkSession, sf: str) -> DataFrame:
    first = seg_panel(spark, sf).select("unit_id", "year", "n_orders")
    return J.attach(first, J.JoinSpec(shipped_by_unit(spark, sf), ["unit_id", "year"]))


@query(
    "entity_match_by_name",
    """SELECT c_custkey AS code, c_nationkey AS region, count(*) AS n_orders FROM orders
       JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY c_custkey, c_nationkey""",
)
def entity_match_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Orders know their customer only by an upper-case "name - nation" label; codes come
    from a reference list of the customers with a positive balance."""
    from panelwave.functions.columns import fold_accents

    who = table(spark, sf, "customer")
    label = F.concat(F.upper("c_name"), F.lit(" - "), F.col("c_nationkey").cast("string"))
    labels = who.select(F.col("c_custkey").alias("o_custkey"), label.alias("place"))
    counted = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    left = counted.join(labels, "o_custkey").select("place", "n_orders")
    left = O.split2(left, "place", " - ", ("name", "region"), "drop").withColumn("name", fold_accents("name"))
    ref = who.filter("c_acctbal > 0").select(
        fold_accents("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("region"),
        F.col("c_custkey").alias("code"),
    )
    matched = J.match_by_name(left, ref, ["name", "region"])
    return matched.select("code", F.col("region").cast("int").alias("region"), "n_orders")


@query(
    "anti_incomplete_units",
    f"""{CUST} SELECT unit_id, year, n_orders FROM cpanel
        WHERE unit_id IN (SELECT unit_id FROM cpanel GROUP BY unit_id HAVING count(*) >= 7)""",
)
def anti_incomplete_units(spark: SparkSession, sf: str) -> DataFrame:
    return J.drop_incomplete(cust_panel(spark, sf), "unit_id", 7).select("unit_id", "year", "n_orders")


@query("anti_always_treated", f"{DID} SELECT unit_id, year, start_year FROM did")
def anti_always_treated(spark: SparkSession, sf: str) -> DataFrame:
    return seg_did(spark, sf).select("unit_id", "year", "start_year")


@query(
    "semi_regions_with_treated",
    f"{DID} SELECT unit_id, region, year FROM did WHERE region IN (SELECT region FROM did WHERE treated = 1)",
)
def semi_regions_with_treated(spark: SparkSession, sf: str) -> DataFrame:
    return J.keep_treated_regions(seg_did(spark, sf), "region").select("unit_id", "region", "year")


@query(
    "treated_lost",
    f"""{CUST} SELECT DISTINCT unit_id FROM cpanel WHERE treated = 1 AND unit_id IN
        (SELECT unit_id FROM cpanel GROUP BY unit_id HAVING count(*) FILTER (year BETWEEN 1995 AND 2000) < 6)""",
)
def treated_lost(spark: SparkSession, sf: str) -> DataFrame:
    panel = cust_panel(spark, sf)
    return J.audit_excluded(panel, A.unbalanced(panel, ["y"], 1995, 2000))


# ---------------------------------------------------------------- grouped summaries


@query(
    "rollup_employment",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS unit_id,
              CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS total_active
       FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2000 GROUP BY year(l_shipdate), l_suppkey""",
)
def rollup_employment(spark: SparkSession, sf: str) -> DataFrame:
    micro = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.col("l_suppkey").alias("unit_id"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("active"),
    )
    return A.rollup_sum(O.in_period(micro, 1995, 2000), ["year", "unit_id"], "active", "total_active")


@query(
    "rollup_mean_wage",
    f"""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS unit_id,
               {r('avg(l_discount)', 'mean_wage')}
        FROM lineitem WHERE l_discount > 0 GROUP BY year(l_shipdate), l_suppkey""",
)
def rollup_mean_wage(spark: SparkSession, sf: str) -> DataFrame:
    micro = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("unit_id"), "l_discount"
    )
    return rounded(A.rollup_mean(micro, ["year", "unit_id"], "l_discount", "mean_wage"), ["mean_wage"])


@query(
    "count_events",
    "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events FROM events GROUP BY user_id, CAST(ts AS DATE)",
)
def count_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    return A.count_events(rows, ["user_id", "day"])


@query(
    "adoption_by_year",
    f"""WITH {ADOPTION_CTE} SELECT start_year, count(*) AS n,
        (SELECT count(*) FROM adoption WHERE start_year BETWEEN 1996 AND 2000) AS total_in_window
        FROM adoption GROUP BY start_year""",
)
def adoption_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return A.adoption_counts(first_orders(spark, sf), 1996, 2000)


@query("coverage_by_year", f"{CUST} SELECT year, count(*) AS n_rows FROM cpanel GROUP BY year")
def coverage_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return A.coverage(cust_panel(spark, sf))


@query(
    "unbalanced_units",
    f"""{CUST} SELECT unit_id FROM cpanel GROUP BY unit_id
        HAVING count(*) FILTER (year BETWEEN 1995 AND 2000 AND y IS NOT NULL) < 6""",
)
def unbalanced_units(spark: SparkSession, sf: str) -> DataFrame:
    return A.unbalanced(cust_panel(spark, sf), ["y", "x1"], 1995, 2000)


@query("distinct_units", f"{CUST} SELECT DISTINCT region, start_year FROM cpanel")
def distinct_units(spark: SparkSession, sf: str) -> DataFrame:
    return A.distinct_of(cust_panel(spark, sf), ["region", "start_year"])


@query(
    "cohort_means",
    f"""{DID}, m AS (
      SELECT year, start_year, treated, avg(y) AS mean_log, avg(total) AS mean_level,
             avg(total / n_cust) AS mean_per_capita
      FROM did WHERE unit_id IN (SELECT unit_id FROM did WHERE start_year <= 2000 AND treated = 1)
      GROUP BY year, start_year, treated),
    q AS (SELECT quantile_cont(start_year, [0, 0.25, 0.5, 0.75, 1.0]) AS c FROM m)
    SELECT year, start_year, treated, {r('mean_log', 'mean_log')}, {r('mean_level', 'mean_level')},
           {r('mean_per_capita', 'mean_per_capita')},
           CASE WHEN start_year <= c[2] THEN 1 WHEN start_year <= c[3] THEN 2 WHEN start_year <= c[4] THEN 3
                ELSE 4 END AS macro_group
    FROM m, q""",
)
def cohort_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = Ds.cohort_means(seg_did(spark, sf), "y", "total", "n_cust", 2000).drop("macro_group_label")
    return rounded(rows, ["mean_log", "mean_level", "mean_per_capita"])


SUPPORT = ("y", "x1", "x2", "total")


@query(
    "common_support_bounds",
    f"{DID} SELECT "
    + ", ".join(f"{r(f'max({c}) * 1.01', f'max_{c}', 4)}, {r(f'min({c}) * 0.99', f'min_{c}', 4)}" for c in SUPPORT)
    + " FROM did WHERE treated = 1",
)
def common_support_bounds(spark: SparkSession, sf: str) -> DataFrame:
    bounds = A.support_bounds(seg_did(spark, sf), SUPPORT)
    return rounded(bounds, bounds.columns, 4)


@query(
    "common_support_trim",
    f"{DID}, bd AS (SELECT "
    + ", ".join(f"max({c}) * 1.01 AS max_{c}, min({c}) * 0.99 AS min_{c}" for c in SUPPORT)
    + " FROM did WHERE treated = 1) SELECT unit_id, year FROM did, bd WHERE "
    + " AND ".join(f"{c} < max_{c} AND {c} > min_{c}" for c in SUPPORT),
)
def common_support_trim(spark: SparkSession, sf: str) -> DataFrame:
    rows = seg_did(spark, sf)
    return A.support_trim(rows, A.support_bounds(rows, SUPPORT), SUPPORT).select("unit_id", "year")


@query(
    "group_unit_counts",
    f"""{DID} SELECT start_year, count(*) AS number_units FROM did
        WHERE year = (SELECT max(year) FROM did) AND start_year <> 0 GROUP BY start_year""",
)
def group_unit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.cohort_sizes(seg_did(spark, sf))


@query(
    "calendar_unit_counts",
    f"""{DID} SELECT year, count(*) AS number_units FROM did
        WHERE start_year <> 0 AND start_year <= year GROUP BY year""",
)
def calendar_unit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.treated_counts(seg_did(spark, sf))


@query(
    "balanced_unit_count",
    f"""{DID} SELECT count(*) AS n_balanced FROM did
        WHERE year = (SELECT max(year) - 3 FROM did) AND start_year <> 0 AND start_year <= year""",
)
def balanced_unit_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.n_balanced(seg_did(spark, sf), 3)


# ---------------------------------------------------------------- descriptive tables

ARM_COLS = ("y", "x1", "x2", "area")


def _reference_year(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.code_treatment(seg_did(spark, sf).filter("year = 1996"), 1995, 2000)
    return rows.select("unit_id", "any_treated", *ARM_COLS)


ARM_CTE = f"""{DID}, ref AS (
  SELECT CASE WHEN start_year BETWEEN 1995 AND 2000 THEN 'Treated' ELSE 'Untreated' END AS arm, y, x1, x2, area
  FROM did WHERE year = 1996),
long AS (UNPIVOT ref ON y, x1, x2, area INTO NAME variable VALUE value)"""


@query(
    "summary_mean_sd",
    f"""{ARM_CTE} SELECT variable, arm, count(*) AS n, {r('avg(value)', 'mean')},
        {r('stddev_samp(value)', 'sd')} FROM long GROUP BY variable, arm""",
)
def summary_mean_sd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Ds.describe_by(_reference_year(spark, sf), "any_treated", ARM_COLS), ["mean", "sd"])


@query(
    "summary_median_iqr",
    f"""{ARM_CTE} SELECT variable, arm, count(*) AS n, {r('quantile_cont(value, 0.25)', 'q1')},
        {r('quantile_cont(value, 0.5)', 'median')}, {r('quantile_cont(value, 0.75)', 'q3')}
        FROM long GROUP BY variable, arm""",
)
def summary_median_iqr(spark: SparkSession, sf: str) -> DataFrame:
    rows = Ds.describe_by(_reference_year(spark, sf), "any_treated", ARM_COLS, "median")
    return rounded(rows, ["q1", "median", "q3"])


WELCH_SQL = f"""{ARM_CTE}, m AS (
  SELECT variable, count(*) FILTER (arm = 'Treated') AS n0, avg(value) FILTER (arm = 'Treated') AS m0,
         var_samp(value) FILTER (arm = 'Treated') / count(*) FILTER (arm = 'Treated') AS a,
         count(*) FILTER (arm = 'Untreated') AS n1, avg(value) FILTER (arm = 'Untreated') AS m1,
         var_samp(value) FILTER (arm = 'Untreated') / count(*) FILTER (arm = 'Untreated') AS b
  FROM long GROUP BY variable)
SELECT variable, {r('m0 - m1', 'diff')}, {r('sqrt(a + b)', 'se')},
       {r('(a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1))', 'df', 4)} FROM m"""


@query("welch_difference", WELCH_SQL)
def welch_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = Ds.welch(_reference_year(spark, sf), "any_treated", ARM_COLS, ("Treated", "Untreated"))
    return rounded(rounded(rows.select("variable", "diff", "se", "df"), ["diff", "se"]), ["df"], 4)


def _t_area(t: str, df: str) -> str:
    """SQL for P(|T| < t): Simpson's rule after the substitution t = sqrt(df) * tan(angle)."""
    top, steps = f"atan(({t}) / sqrt({df}))", 2000
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    total = f"list_sum(list_transform(range({steps + 1}), lambda i: ({weight}) * pow(cos({top} * i / {steps}), {df} - 1)))"
    return f"(2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {top} / {3 * steps} * {total})"


WELCH_INTERVAL_SQL = (
    WELCH_SQL[: WELCH_SQL.rindex("SELECT variable")].replace("WITH", "WITH RECURSIVE", 1)
    + f""", w AS (SELECT variable, m0 - m1 AS diff, sqrt(a + b) AS se,
         (a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1)) AS df FROM m),
       q AS (SELECT variable, df, 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(64 AS DOUBLE) AS hi FROM w
             UNION ALL
             SELECT variable, df, step + 1, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END
             FROM (SELECT *, {_t_area('(lo + hi) / 2', 'df')} < 0.95 AS low FROM q WHERE step < 50))
       SELECT variable, {r('diff', 'diff')}, {r('se', 'se')}, {r('w.df', 'df', 4)}, {r('diff - lo * se', 'lo')},
              {r('diff + lo * se', 'hi')}, {r('1 - ' + _t_area('abs(diff) / se', 'w.df'), 'p_value')}
       FROM w JOIN q USING (variable) WHERE step = 50"""
)


@query("welch_interval", WELCH_INTERVAL_SQL)
def welch_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The same table with confidence limits and p-value, which need the t distribution."""
    rows = Ds.welch(_reference_year(spark, sf), "any_treated", ARM_COLS, ("Treated", "Untreated"))
    return rounded(rounded(rows, ["diff", "se", "lo", "hi", "p_value"]), ["df"], 4)


@query(
    "density_by_arm",
    f"""{ARM_CTE}, s AS (
      SELECT variable, arm, count(*) AS n, least(stddev_samp(value),
             (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * 0.9 * pow(count(*), -0.2) AS bw
      FROM long GROUP BY variable, arm),
    rg AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM long GROUP BY variable),
    grid AS (SELECT variable, CAST(range AS INTEGER) AS point, lo + range * (hi - lo) / 511 AS x
             FROM rg CROSS JOIN range(0, 512))
    SELECT s.variable, s.arm, point, {r('max(x)', 'x')},
           {r('sum(exp(-0.5 * pow((x - value) / bw, 2)) / (n * bw * sqrt(2 * pi())))', 'density')}
    FROM long JOIN s ON s.variable = long.variable AND s.arm = long.arm
    JOIN grid ON grid.variable = long.variable GROUP BY s.variable, s.arm, point""",
)
def density_by_arm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Ds.kde(_reference_year(spark, sf), "any_treated", ARM_COLS), ["x", "density"])


def _letters(y: int) -> str:
    s = f"max(treated) FILTER (year = {y})"
    return f"CASE WHEN {s} IS NULL THEN '.' WHEN {s} = 1 THEN 'T' WHEN {FIRST} IS NULL THEN 'C' ELSE 'B' END"


FIRST = "min(year) FILTER (treated = 1 AND year BETWEEN 1995 AND 2000)"


@query(
    "treatment_history",
    f"""{CUST}, h AS (SELECT unit_id, {FIRST} AS first_treated, {' || '.join(map(_letters, range(1995, 2001)))} AS history
        FROM cpanel WHERE year BETWEEN 1995 AND 2000 GROUP BY unit_id)
        SELECT history, first_treated, count(*) AS n_units FROM h GROUP BY history, first_treated""",
)
def treatment_history(spark: SparkSession, sf: str) -> DataFrame:
    return Ds.histories(cust_panel(spark, sf), 1995, 2000)


# ---------------------------------------------------------------- outliers, sorts, unions

FENCE_CTE = f"""{CUST}, f AS (SELECT year, quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3
  FROM cpanel GROUP BY year),
flagged AS (SELECT cpanel.unit_id, cpanel.year, q3 + 1.5 * (q3 - q1) AS upper, q1 - 0.25 * (q3 - q1) AS lower,
  CASE WHEN total > q3 + 1.5 * (q3 - q1) OR total < q1 - 0.25 * (q3 - q1) THEN 1 ELSE 0 END AS outlier
  FROM cpanel JOIN f ON f.year = cpanel.year)"""


def _flags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    panel = cust_panel(spark, sf)
    return panel, Q.iqr_outliers(panel.select("unit_id", "year", "total"), "total", "year", 1.5, 0.25)


@query(
    "outlier_flag_by_year",
    f"{FENCE_CTE} SELECT unit_id, year, {r('upper', 'upper', 3)}, {r('lower', 'lower', 3)}, outlier FROM flagged",
)
def outlier_flag_by_year(spark: SparkSession, sf: str) -> DataFrame:
    flags = _flags(spark, sf)[1].select("unit_id", "year", "upper", "lower", "outlier")
    return rounded(flags, ["upper", "lower"], 3)


@query(
    "drop_outlier_units",
    f"{FENCE_CTE} SELECT unit_id, year FROM cpanel WHERE unit_id NOT IN (SELECT unit_id FROM flagged WHERE outlier = 1)",
)
def drop_outlier_units(spark: SparkSession, sf: str) -> DataFrame:
    panel, flags = _flags(spark, sf)
    return J.drop_flagged(panel.select("unit_id", "year"), flags)


@query(
    "max_year_window",
    f"{CUST} SELECT unit_id, year, (SELECT max(year) FROM cpanel) AS max_year FROM cpanel",
)
def max_year_window(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_max_year(cust_panel(spark, sf).select("unit_id", "year"))


@query("order_table", f"WITH {ADOPTION_CTE} SELECT start_year, unit_id FROM adoption ORDER BY start_year DESC, unit_id")
def order_table(spark: SparkSession, sf: str) -> DataFrame:
    return O.order_table(first_orders(spark, sf).select("start_year", "unit_id"), "-start_year", "unit_id")


@query(
    "stack_results",
    f"""WITH {CUST_CTE} SELECT unit_id, region, NULL AS total FROM cust
        UNION ALL SELECT o_custkey, NULL, o_totalprice FROM orders""",
)
def stack_results(spark: SparkSession, sf: str) -> DataFrame:
    who = customers(spark, sf).select(F.col("unit_id").cast("long").alias("unit_id"), "region")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit_id"), F.col("o_totalprice").alias("total"))
    return O.stack(who, orders)
