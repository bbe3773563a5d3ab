"""Panels that the queries derive from the order tables.

* ``seg_panel``: unit = nation x market segment, region = nation, outcome = log of the
  order total of the year.
* ``cust_panel``: unit = customer; unbalanced.

Start years follow a fixed rule of the unit number; nation 24 is treated before the
first year and nations 20-23 never adopt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwave.functions.columns import positive_log, treated_flag
from panelwave.operators.joins import drop_always_treated
from panelwave.plans.design import ModelSpec
from panelwave.registry.catalog import table

# Market segments in alphabetical order; the position is the ordinal.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

START_RULE = """CASE WHEN region = 24 THEN 1990 WHEN region >= 20 THEN NULL
    WHEN (unit_id * 7 + region) % 6 = 0 THEN 1997
    WHEN (unit_id * 7 + region) % 6 = 1 THEN 1998
    WHEN (unit_id * 7 + region) % 6 = 2 THEN 2000
    WHEN (unit_id * 7 + region) % 6 = 3 THEN 2003 END"""


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """(custkey, unit_id, region): the segment unit and nation of each customer."""
    ordinal = F.coalesce(*[F.when(F.col("c_mktsegment") == s, i) for i, s in enumerate(SEGMENTS)])
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"),
        (F.col("c_nationkey") * 5 + ordinal).alias("unit_id"),
        F.col("c_nationkey").alias("region"),
    )


def customer_years(spark: SparkSession, sf: str) -> DataFrame:
    """(custkey, year, total, n_orders): orders summed before they meet any other table."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"))
        .agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders"))
    )


def seg_units(spark: SparkSession, sf: str) -> DataFrame:
    """(unit_id, region, area, b, start_year) of each segment unit."""
    counts = customers(spark, sf).groupBy("unit_id", "region").agg(F.count(F.lit(1)).alias("n"))
    median = counts.agg(F.percentile("n", F.lit(0.5))).scalar()  # 125 rows
    return counts.select(
        "unit_id",
        "region",
        positive_log("n").alias("area"),
        F.when(F.col("n") >= median, 1).otherwise(0).alias("b"),
        F.expr(START_RULE).cast("int").alias("start_year"),
    )


def seg_panel(spark: SparkSession, sf: str) -> DataFrame:
    years = (
        customer_years(spark, sf)
        .join(customers(spark, sf), "custkey")
        .groupBy("unit_id", "year")
        .agg(
            F.sum("total").alias("total"),
            F.sum("n_orders").alias("n_orders"),
            F.count(F.lit(1)).alias("n_cust"),  # one row per customer and year
        )
    )
    return years.join(seg_units(spark, sf), "unit_id").select(
        "unit_id",
        "region",
        "year",
        "start_year",
        treated_flag("start_year", "year").alias("treated"),
        "total",
        "n_orders",
        "n_cust",
        positive_log("total").alias("y"),
        positive_log("n_orders").alias("x1"),
        positive_log("n_cust").alias("x2"),
        "area",
        "b",
    )


def seg_did(spark: SparkSession, sf: str) -> DataFrame:
    """Segment panel without the units treated before 1995."""
    return drop_always_treated(seg_panel(spark, sf), seg_units(spark, sf), 1995)


def cust_panel(spark: SparkSession, sf: str) -> DataFrame:
    who = customers(spark, sf).select(F.col("custkey").alias("unit_id"), "region")
    rows = customer_years(spark, sf).withColumnRenamed("custkey", "unit_id").join(who, "unit_id")
    start = F.expr(START_RULE).cast("int")
    rows = rows.withColumn("start_year", start)
    return rows.select(
        "unit_id",
        "region",
        "year",
        "start_year",
        treated_flag("start_year", "year").alias("treated"),
        "total",
        "n_orders",
        positive_log("total").alias("y"),
        positive_log("n_orders").alias("x1"),
    )


def cust_did(spark: SparkSession, sf: str) -> DataFrame:
    panel = cust_panel(spark, sf)
    return panel.filter(F.coalesce(F.col("start_year"), F.lit(9999)) >= 1995)


def seg_spec(**changes: object) -> ModelSpec:
    """Window 1995-2000, universal base, not-yet-treated controls, regions with adopters."""
    return ModelSpec(outcome="y", period=(1995, 2000), control="notyettreated", balance_e=1).but(**changes)


_CASES = " ".join(f"WHEN c_mktsegment = '{s}' THEN {i}" for i, s in enumerate(SEGMENTS))

# Common table expressions for the comparison SQL.
CUST_CTE = f"""cust AS (
  SELECT c_custkey AS custkey, CAST(c_nationkey * 5 + CASE {_CASES} END AS INTEGER) AS unit_id,
         c_nationkey AS region
  FROM customer)"""

SEG_CTE = f"""{CUST_CTE},
seg_size AS (SELECT unit_id, region, count(*) AS n FROM cust GROUP BY unit_id, region),
seg_units AS (
  SELECT unit_id, region, ln(n) AS area,
         CASE WHEN n >= (SELECT quantile_cont(n, 0.5) FROM seg_size) THEN 1 ELSE 0 END AS b,
         CAST({START_RULE} AS INTEGER) AS start_year
  FROM seg_size),
seg AS (
  SELECT u.unit_id, u.region, CAST(year(o_orderdate) AS INTEGER) AS year, u.start_year,
         CASE WHEN u.start_year <= year(o_orderdate) THEN 1 ELSE 0 END AS treated,
         sum(o_totalprice) AS total, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_cust,
         ln(sum(o_totalprice)) AS y, ln(count(*)) AS x1, ln(count(DISTINCT o_custkey)) AS x2,
         u.area, u.b
  FROM orders JOIN cust ON o_custkey = custkey JOIN seg_units u ON u.unit_id = cust.unit_id
  GROUP BY u.unit_id, u.region, year(o_orderdate), u.start_year, u.area, u.b)"""

SEG_DID_CTE = f"""{SEG_CTE},
did AS (SELECT * FROM seg WHERE start_year IS NULL OR start_year >= 1995)"""

CUST_PANEL_CTE = f"""cust AS (
  SELECT c_custkey AS unit_id, c_nationkey AS region FROM customer),
cpanel0 AS (
  SELECT cust.unit_id, region, CAST(year(o_orderdate) AS INTEGER) AS year,
         sum(o_totalprice) AS total, count(*) AS n_orders
  FROM orders JOIN cust ON o_custkey = unit_id GROUP BY cust.unit_id, region, year(o_orderdate)),
cpanel AS (
  SELECT *, CASE WHEN start_year <= year THEN 1 ELSE 0 END AS treated, ln(total) AS y, ln(n_orders) AS x1
  FROM (SELECT *, CAST({START_RULE} AS INTEGER) AS start_year FROM cpanel0)),
cdid AS (SELECT * FROM cpanel WHERE start_year IS NULL OR start_year >= 1995)"""
