"""Queries for projections, scalar functions, deflation and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwave.functions import columns as C
from panelwave.operators import deflate as D, frames as O, quantiles as Q, reshape as R
from panelwave.registry.catalog import bin_label, query, r, rounded, table
from panelwave.registry.panels import SEG_CTE, seg_panel

SEG = f"WITH {SEG_CTE}"


@query(
    "project_rename",
    "SELECT c_acctbal AS balance, c_custkey AS unit_id, c_nationkey AS region FROM customer",
)
def project_rename(spark: SparkSession, sf: str) -> DataFrame:
    return O.project(
        table(spark, sf, "customer"),
        keep=["c_acctbal", "c_custkey", "c_nationkey", "c_mktsegment"],
        drop=["c_mktsegment"],
        rename={"c_acctbal": "balance", "c_custkey": "unit_id", "c_nationkey": "region"},
    )


@query(
    "filter_valid_rows",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey IS NOT NULL AND c_acctbal > 0 AND c_custkey > 0",
)
def filter_valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.valid_rows(table(spark, sf, "customer"), ["c_nationkey"], ["c_acctbal", "c_custkey"])
    return rows.select("c_custkey", "c_acctbal")


@query("filter_period", f"{SEG} SELECT unit_id, year, n_orders FROM seg WHERE year BETWEEN 1996 AND 1999")
def filter_period(spark: SparkSession, sf: str) -> DataFrame:
    return O.in_period(seg_panel(spark, sf), 1996, 1999).select("unit_id", "year", "n_orders")


@query(
    "derive_log_columns",
    f"""SELECT c_custkey, {r('CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END', 'log_balance')},
               {r('CASE WHEN c_nationkey > 0 THEN ln(c_nationkey) END', 'log_nation')} FROM customer""",
)
def derive_log_columns(spark: SparkSession, sf: str) -> DataFrame:
    logs = {"log_balance": "c_acctbal", "log_nation": "c_nationkey"}
    rows = O.add_logs(table(spark, sf, "customer"), logs).select("c_custkey", *logs)
    return rounded(rows, list(logs))


@query(
    "derive_ratio_diff",
    f"""SELECT l_orderkey, l_linenumber, {r('l_extendedprice / nullif(l_tax, 0)', 'per_tax')},
               {r('l_extendedprice - l_quantity', 'rest')} FROM lineitem""",
)
def derive_ratio_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.add_ratio(table(spark, sf, "lineitem"), "per_tax", "l_extendedprice", "l_tax")
    rows = O.add_diff(rows, "rest", "l_extendedprice", "l_quantity")
    return rounded(rows.select("l_orderkey", "l_linenumber", "per_tax", "rest"), ["per_tax", "rest"])


def price_index(spark: SparkSession, sf: str) -> DataFrame:
    """A yearly price index from the line items: mean unit price per ship year, with
    period labels, and one extra label that is not a year-end value."""
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    yearly = (
        table(spark, sf, "lineitem")
        .groupBy(F.year("l_shipdate").alias("y"))
        .agg(F.avg(unit_price).alias("value"))
        .select(F.concat(F.lit("dezembro "), F.col("y").cast("string")).alias("period"), "value")
    )
    may = yearly.filter("period = 'dezembro 1999'").select(
        F.lit("maio 1999").alias("period"), (F.col("value") * 0.97).alias("value")
    )
    return yearly.unionByName(may)


INDEX_CTE = """idx AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_extendedprice / l_quantity) AS v
    FROM lineitem GROUP BY year(l_shipdate))"""


@query(
    "deflate_by_index",
    f"""{SEG}, {INDEX_CTE}
    SELECT unit_id, seg.year, {r('total / (v / (SELECT v FROM idx WHERE year = 1998))', 'total', 4)}
    FROM seg LEFT JOIN idx ON idx.year = seg.year""",
)
def deflate_by_index(spark: SparkSession, sf: str) -> DataFrame:
    index = D.yearly_index(price_index(spark, sf), "dezembro 1998", exclude=["maio 1999"])
    rows = D.deflate(seg_panel(spark, sf).select("unit_id", "year", "total"), ["total"], index)
    return rounded(rows, ["total"], 4)


@query(
    "deflate_by_scalar",
    f"""{SEG}, {INDEX_CTE}
    SELECT unit_id, seg.year, {r('''total / ((SELECT v * 0.97 FROM idx WHERE year = 1999)
      / (SELECT v FROM idx WHERE year = 1998))''', 'total', 4)} FROM seg""",
)
def deflate_by_scalar(spark: SparkSession, sf: str) -> DataFrame:
    rows = seg_panel(spark, sf).select("unit_id", "year", "total")
    return rounded(D.rebase(rows, ["total"], price_index(spark, sf), "maio 1999", "dezembro 1998"), ["total"], 4)


@query(
    "treatment_code",
    f"""{SEG} SELECT unit_id, year, coalesce(start_year, 0) AS start_year,
          CASE WHEN start_year <= year THEN 1 ELSE 0 END AS treated,
          CASE WHEN start_year BETWEEN 1995 AND 2000 THEN 'Treated' ELSE 'Untreated' END AS any_treated FROM seg""",
)
def treatment_code(spark: SparkSession, sf: str) -> DataFrame:
    rows = seg_panel(spark, sf).select("unit_id", "year", "start_year")
    return O.code_treatment(rows, 1995, 2000)


ADOPTION_CTE = """adoption AS (SELECT o_custkey AS unit_id, CAST(min(o_orderdate) AS DATE) AS start_date,
    CAST(year(min(o_orderdate)) AS INTEGER) AS start_year FROM orders GROUP BY o_custkey)"""


def first_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as adopters: (unit_id, start_date, start_year) of the first order."""
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("unit_id")).agg(
        F.min("o_orderdate").cast("date").alias("start_date")
    )
    return first.withColumn("start_year", F.year("start_date"))


@query(
    "shift_late_adopters",
    f"""WITH {ADOPTION_CTE} SELECT unit_id, start_date,
        CAST(CASE WHEN month(start_date) >= 10 THEN start_year + 1 ELSE start_year END AS INTEGER) AS start_year
        FROM adoption""",
)
def shift_late_adopters(spark: SparkSession, sf: str) -> DataFrame:
    return O.shift_late(first_orders(spark, sf))


@query(
    "parse_date",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
)
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("day"))
    return O.parse_dates(rows, "day")


@query(
    "fold_accents",
    f"""SELECT doc_id, md5(translate(lower(text), '{C.ACCENTED}', '{C.PLAIN}')) AS folded FROM documents""",
)
def fold_accents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(C.fold_accents("text")).alias("folded"))


# Spelling variants of the example and their canonical form.
VARIANTS = {"MACHINERY": "MACHINES", "AUTOMOBILE": "CARS"}


@query(
    "alias_entity_names",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'MACHINES' WHEN 'AUTOMOBILE' THEN 'CARS'
       ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def alias_entity_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return O.alias_names(rows, "c_mktsegment", VARIANTS)


@query(
    "split_column",
    """SELECT o_orderkey AS id, 'merge' AS how, regexp_extract(o_orderpriority, '^([^ ]*)', 1) AS a,
              CASE WHEN contains(o_orderpriority, ' ')
                   THEN substr(o_orderpriority, strpos(o_orderpriority, ' ') + 1) END AS b FROM orders
       UNION ALL
       SELECT c_custkey, 'drop', split_part(c_name, '0', 1), split_part(c_name, '0', 2) FROM customer""",
)
def split_column(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    merged = O.split2(orders, "o_orderpriority", " ", ("a", "b"), "merge").withColumn("how", F.lit("merge"))
    dropped = O.split2(names, "c_name", "0", ("a", "b"), "drop").withColumn("how", F.lit("drop"))
    return O.stack(merged, dropped)


@query(
    "derive_key_prefix",
    "SELECT c_custkey, CAST(substr(CAST(1000000 + c_custkey AS VARCHAR), 1, 6) AS INTEGER) AS unit6 FROM customer",
)
def derive_key_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", C.prefix_key(F.col("c_custkey") + 1000000).alias("unit6"))


@query("extract_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def extract_year(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.lit("dezembro "), F.year("o_orderdate").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", C.extract_year(label).alias("year"))


@query("replace_nulls", f"{SEG} SELECT unit_id, year, coalesce(start_year, 0) AS start_year FROM seg")
def replace_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return O.fill(seg_panel(spark, sf).select("unit_id", "year", "start_year"), {"start_year": 0})


@query("drop_null_rows", f"{SEG} SELECT unit_id, year, start_year FROM seg WHERE start_year IS NOT NULL")
def drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    return O.drop_null(seg_panel(spark, sf).select("unit_id", "year", "start_year"), ["start_year"])


@query(
    "bucket_by_quantile",
    f"""WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1.0]) AS c FROM orders),
       b AS (SELECT o_orderkey, c, CASE WHEN o_totalprice <= c[2] THEN 1 WHEN o_totalprice <= c[3] THEN 2
              WHEN o_totalprice <= c[4] THEN 3 ELSE 4 END AS bucket FROM orders, q)
       SELECT o_orderkey, bucket, {bin_label('bucket', 'c')} AS bucket_label FROM b""",
)
def bucket_by_quantile(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Q.quantile_bucket(rows, "o_totalprice").select("o_orderkey", "bucket", "bucket_label")


# Display labels of the order status, in display order.
STATUS_LABELS = {"O": "Open", "F": "Finished", "P": "Pending"}


@query(
    "label_ordered",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Finished' WHEN 'P' THEN 'Pending' END
       AS label, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 WHEN 'P' THEN 3 END AS label_order FROM orders""",
)
def label_ordered(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.label(table(spark, sf, "orders"), "o_orderstatus", STATUS_LABELS)
    return rows.select("o_orderkey", "label", "label_order")


_TEXT = "regexp_replace(regexp_replace(printf('%.{d}f', round_even({x}, {d})), '0+$', ''), '\\.$', '')"


@query(
    "format_interval",
    f"""WITH s AS (SELECT c_nationkey, avg(c_acctbal) / 10000 AS m, stddev_samp(c_acctbal) / 10000 AS s
                   FROM customer GROUP BY c_nationkey)
        SELECT c_nationkey,
          '[' || {_TEXT.format(d=3, x='m - s')} || ', ' || {_TEXT.format(d=3, x='m + s')} || ']' AS plain,
          '[' || {_TEXT.format(d=1, x='100 * (m - s)')} || '%, ' || {_TEXT.format(d=1, x='100 * (m + s)')} || '%]' AS pct
        FROM s""",
)
def format_interval(spark: SparkSession, sf: str) -> DataFrame:
    stats = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        (F.avg("c_acctbal") / 10000).alias("m"), (F.stddev_samp("c_acctbal") / 10000).alias("s")
    )
    lo, hi = F.col("m") - F.col("s"), F.col("m") + F.col("s")
    return stats.select(
        "c_nationkey", C.interval_text(lo, hi, 3).alias("plain"), C.interval_text(lo, hi, 1, True).alias("pct")
    )


YEAR_COLS = [str(y) for y in range(1995, 2002)]


def _orders_wide(spark: SparkSession, sf: str) -> DataFrame:
    years = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("y")).count()
    return R.to_wide(years, ["o_custkey"], "y", "count", YEAR_COLS)


@query(
    "long_to_wide",
    "SELECT o_custkey, "
    + ", ".join(f"nullif(count(*) FILTER (year(o_orderdate) = {y}), 0) AS \"{y}\"" for y in YEAR_COLS)
    + " FROM orders GROUP BY o_custkey",
)
def long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_wide(spark, sf)


@query(
    "wide_to_long",
    """WITH k AS (SELECT DISTINCT o_custkey FROM orders), y AS (SELECT CAST(range AS INTEGER) AS year FROM range(1995, 2002)),
       n AS (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n_orders FROM orders GROUP BY o_custkey, year(o_orderdate))
       SELECT k.o_custkey, y.year, n.n_orders FROM k CROSS JOIN y
       LEFT JOIN n ON n.o_custkey = k.o_custkey AND n.year = y.year""",
)
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return R.to_long(_orders_wide(spark, sf), ["o_custkey"], "year", "n_orders")


@query(
    "complete_grid",
    """WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events FROM events GROUP BY user_id, CAST(ts AS DATE))
       SELECT u.user_id, d.day, coalesce(n_events, 0) AS n_events FROM (SELECT DISTINCT user_id FROM n) u
       CROSS JOIN (SELECT DISTINCT day FROM n) d LEFT JOIN n ON n.user_id = u.user_id AND n.day = d.day""",
)
def complete_grid(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events")
    )
    return R.complete(counts, "user_id", "day", {"n_events": 0})


@query(
    "event_time_dummies",
    f"{SEG} SELECT unit_id, year, "
    + ", ".join(
        f"CASE WHEN start_year > 0 AND year = start_year + ({l}) THEN 1 ELSE 0 END AS {name}"
        for l, name in R.event_time_names(5).items()
    )
    + " FROM seg",
)
def event_time_dummies(spark: SparkSession, sf: str) -> DataFrame:
    rows = seg_panel(spark, sf).select("unit_id", "year", "start_year")
    return R.event_dummies(rows, 5).drop("start_year")
