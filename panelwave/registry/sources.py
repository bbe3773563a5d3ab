"""Queries for readers and writers.  Each writes a driver table to the shared folder in
the format to be read and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from panelwave.operators.frames import split2
from panelwave.operators.reshape import to_long, to_wide
from panelwave.registry.catalog import query, rounded, r, table
from panelwave.registry.panels import SEG_CTE, seg_panel
from panelwave.session import local_table, scratch_path
from panelwave.sources import tables as S

YEARS = tuple(range(1995, 2002))


@query(
    "read_typed_csv",
    "SELECT c_custkey AS unit_id, c_name AS name, c_nationkey AS region, c_acctbal AS balance FROM customer",
)
def read_typed_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customer_csv")
    table(spark, sf, "customer").write.csv(path, header=True)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    rename = {"c_custkey": "unit_id", "c_name": "name", "c_nationkey": "region", "c_acctbal": "balance"}
    return S.read_typed(spark, path, schema, rename)


@query(
    "read_legacy_csv",
    """WITH n AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders
               FROM orders GROUP BY o_custkey, year(o_orderdate)),
          full_units AS (SELECT k FROM n GROUP BY k HAVING count(*) = 7)
       SELECT CAST(100000 + c_custkey AS BIGINT) AS unit6, 'São ' || c_name AS name, year, n_orders
       FROM n JOIN full_units USING (k) JOIN customer ON c_custkey = k""",
)
def read_legacy_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "legacy")
    names = table(spark, sf, "customer").select("c_custkey", "c_name")
    years = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("y")).count()
    wide = to_wide(years, ["o_custkey"], "y", "count", [str(y) for y in YEARS])
    label = F.concat((F.col("c_custkey") + 100000).cast("string"), F.lit(" São "), "c_name")
    body = names.join(wide, F.col("c_custkey") == F.col("o_custkey")).select(
        label.alias("unit"), *[F.col(str(y)).cast("string") for y in YEARS]
    )
    options = {"sep": ";", "encoding": "ISO-8859-1", "header": False}
    body.write.options(**options).csv(path)
    totals = body.agg(F.lit("Total").alias("unit"), *[F.sum(F.col(str(y)).cast("long")).cast("string") for y in YEARS])
    totals.write.mode("append").options(**options).csv(path)
    notes = ["Orders by customer", "Period: 1995-2001", "", "Unit;" + ";".join(map(str, YEARS)), "Note: made from orders"]
    spark.createDataFrame([(n,) for n in notes], "value string").write.mode("append").text(path)
    rows = S.read_legacy(spark, path, ["unit", *map(str, YEARS)], key_pattern=r"^\d{6,} ")
    rows = split2(rows, "unit", " ", ("unit6", "name"), extra="merge")
    rows = to_long(rows, ["unit6", "name"], "year", "n_orders")
    return S.cast_declared(rows, {"unit6": "long", "n_orders": "long"})


@query(
    "cast_declared",
    """SELECT o_orderkey AS id, o_totalprice AS price, TRY_CAST(o_orderpriority AS INTEGER) AS priority,
              TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank FROM orders""",
)
def cast_declared(spark: SparkSession, sf: str) -> DataFrame:
    text = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.substring("o_orderpriority", 1, 1).alias("rank"),
    )
    return S.cast_declared(text, {"id": "long", "price": "double", "priority": "int", "rank": "int"})


@query(
    "select_excel_extract",
    """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders""",
)
def select_excel_extract(spark: SparkSession, sf: str) -> DataFrame:
    cols = {"id": ("o_orderkey", "long"), "day": ("o_orderdate", "date"), "price": ("o_totalprice", "double")}
    return S.read_extract(spark, f"{sf}/orders.parquet", cols)


@query(
    "union_yearly_files",
    """SELECT o_custkey AS unit_id, o_totalprice AS total, o_orderstatus AS status,
              CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
)
def union_yearly_files(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "yearly")
    orders = table(spark, sf, "orders")
    paths = {}
    for y in YEARS:
        paths[y] = f"{root}/{y}"
        rows = orders.filter(F.year("o_orderdate") == y).select("o_custkey", "o_totalprice", "o_orderstatus")
        rows.toDF(f"UNIT {y}", f"Total_{y}", "STATUS").write.csv(paths[y], header=True)
    stacked = S.union_yearly(spark, paths, ["unit_id", "total", "status"])
    return S.cast_declared(stacked, {"unit_id": "long", "total": "double"})


_CELLS = {"o_orderkey": "long", "o_totalprice": "double", "o_orderdate": "date", "o_orderpriority": "int"}


def _spoilt_orders(spark: SparkSession, sf: str) -> str:
    """Orders as CSV in which pending orders lack a readable price and priorities are text."""
    path = scratch_path(spark, "spoilt_csv")
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    table(spark, sf, "orders").select(
        "o_orderkey", price.alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority"
    ).write.csv(path, header=True)
    return path


@query(
    "read_typed_account",
    """SELECT unnest(['o_orderkey', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS name,
              unnest([0, count(*) FILTER (o_orderstatus = 'P'), 0,
                      count(*) FILTER (TRY_CAST(o_orderpriority AS INTEGER) IS NULL)]) AS rejected, count(*) AS n_rows FROM orders""",
)
def read_typed_account(spark: SparkSession, sf: str) -> DataFrame:
    """Text that its declared type does not take, counted by column in the pass that reads it."""
    account = Observation()
    schema = ", ".join(f"{c} {t}" for c, t in _CELLS.items())
    S.read_typed(spark, _spoilt_orders(spark, sf), schema, account=account).write.format("noop").mode("overwrite").save()
    counts = account.get
    rows = [(c, counts[f"rejected_{c}"], counts["n_rows"]) for c in _CELLS]
    return local_table(spark, rows, "name string, rejected long, n_rows long")


@query(
    "rejected_rows",
    """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'o_totalprice,' ELSE '' END || 'o_orderpriority'
              AS rejected FROM orders WHERE TRY_CAST(o_orderpriority AS INTEGER) IS NULL""",
)
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.rejected_rows(spark.read.csv(_spoilt_orders(spark, sf), header=True), _CELLS)
    return rows.select(F.col("o_orderkey").cast("long"), "o_orderpriority", F.concat_ws(",", "rejected").alias("rejected"))


SEG_ROWS = f"WITH {SEG_CTE} SELECT unit_id, year, n_orders, {r('total', 'total', 2)} FROM seg"


@query("write_panel", SEG_ROWS)
def write_panel(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "panel")
    S.write_panel(seg_panel(spark, sf).select("unit_id", "year", "n_orders", "total"), path)
    return rounded(spark.read.parquet(path), ["total"], 2)


@query("materialize_once", SEG_ROWS)
def materialize_once(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "once")
    build = lambda: seg_panel(spark, sf).select("unit_id", "year", "n_orders", "total")
    S.materialize_once(spark, path, build)
    return rounded(S.materialize_once(spark, path, build), ["total"], 2)
