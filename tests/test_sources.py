from __future__ import annotations

import os

import pytest
from pyspark.sql import Observation, functions as F

from panelwave.operators import describe, quantiles
from panelwave.plans.design import ModelSpec
from panelwave.plans.model import fit
from panelwave.session import persisted, scope, scratch_path
from panelwave.sources import tables


def files(path, year):
    return [f for f in os.listdir(f"{path}/year={year}") if f.endswith(".parquet")]


def test_panel_files_follow_the_size_of_a_year(spark):
    """One year holds nearly all rows; the task count does not multiply the files."""
    year = F.when(F.col("id") % 100 > 4, 2003).when(F.col("id") % 100 > 0, 2004 + F.col("id") % 100)
    df = spark.range(60_000).select("id", (F.col("id") % 7).alias("k"), year.cast("int").alias("year")).repartition(40)
    path = scratch_path(spark, "sized")
    tables.write_panel(df, path, file_rows=5_000)
    assert len(files(path, 2003)) == 12 and all(len(files(path, y)) == 1 for y in range(2005, 2009))
    assert len(files(path, "__HIVE_DEFAULT_PARTITION__")) == 1
    back = spark.read.parquet(path)
    sizes = [r["count"] for r in back.filter("year = 2003").groupBy(F.input_file_name()).count().collect()]
    assert min(sizes) > 4_000 and max(sizes) <= 5_000 and sum(sizes) == 57_000
    assert back.select("id", "k", "year").exceptAll(df).count() == 0 and back.count() == 60_000
    one = scratch_path(spark, "one")
    tables.write_panel(df, one)
    assert len(files(one, 2003)) == 1
    alike = scratch_path(spark, "alike")  # equal rows share a salt; their task starts further files
    tables.write_panel(spark.range(9_000).selectExpr("1 as v", "2003 as year").repartition(4), alike, file_rows=1_000)
    assert len(files(alike, 2003)) == 9
    empty = scratch_path(spark, "empty")
    tables.write_panel(df.limit(0), empty)
    assert spark.read.schema(df.schema).parquet(empty).count() == 0


def test_a_finished_table_is_used_and_a_dead_one_replaced(spark):
    path, calls = scratch_path(spark, "once"), []

    def build(n):
        calls.append(n)
        return spark.range(n).selectExpr("id", "cast(id % 3 as int) as year")

    os.makedirs(path.removeprefix("file:"))
    with open(f"{path.removeprefix('file:')}/part-00000.parquet", "w") as f:
        f.write("half a file")
    assert tables.materialize_once(spark, path, lambda: build(5), params={"n": 5}).count() == 5
    assert tables.materialize_once(spark, path, lambda: build(6), params={"n": 5}).count() == 5 and calls == [5]
    with pytest.raises(ValueError, match="params"):
        tables.materialize_once(spark, path, lambda: build(6), params={"n": 6})
    assert tables.materialize_once(spark, path, lambda: build(6), schema="id long, year int").count() == 5
    with pytest.raises(ValueError, match="schema"):
        tables.materialize_once(spark, path, lambda: build(6), schema="id long")
    with pytest.raises(ValueError, match="declared"):
        tables.materialize_once(spark, scratch_path(spark, "other"), lambda: build(2), schema="id string")
    assert calls == [5, 2]
    beside = os.listdir(os.path.dirname(path.removeprefix("file:")))
    assert beside == ["once"]  # no staging folder is left


def test_two_builders_of_one_table(spark):
    """The second writer starts before the first one is done and finds its table."""
    path = scratch_path(spark, "race")

    def slow():
        tables.materialize_once(spark, path, lambda: spark.range(3).toDF("id"), params={"by": 1})
        return spark.range(7).toDF("id")

    with pytest.raises(ValueError, match="params"):
        tables.materialize_once(spark, path, slow, params={"by": 2})
    assert spark.read.parquet(path).count() == 3
    assert tables.materialize_once(spark, path, slow).count() == 3
    assert os.listdir(os.path.dirname(path.removeprefix("file:"))) == ["race"]
    assert not any("staging" in f for f in os.listdir(path.removeprefix("file:")))


def test_partitioned_tables_are_published_with_their_partitions(spark):
    path = scratch_path(spark, "parts")
    made = tables.materialize_once(spark, path, lambda: spark.range(9).selectExpr("id", "cast(id % 2 as int) as year"), "year")
    assert made.filter("year = 1").count() == 4 and len(files(path, 1)) == 1


def test_rejected_text_is_counted_in_the_pass_that_reads_it(spark):
    path = scratch_path(spark, "rejects")
    rows = [("1", "2.5", "2003-01-02"), ("x", "", "n/a"), (None, "7e2", "2004-05-06"), ("4", "--", "2004-13-01"), ("x", "1", None)]
    spark.createDataFrame(rows, "unit string, v string, `the day` string").coalesce(1).write.csv(path, header=True)
    declared = "unit int, v double, `the day` date"
    account = Observation()
    df = tables.read_typed(spark, path, declared, account=account)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    got = df.collect()
    want = {"n_rows": 5, "rejected_unit": 2, "rejected_v": 1, "rejected_the day": 2}
    assert account.get == want
    assert [r.unit for r in got] == [1, None, None, 4, None] and [r.v for r in got] == [2.5, None, 700.0, None, 1.0]
    text = spark.read.csv(path, header=True)
    bad = tables.rejected_rows(text, {"unit": "int", "v": "double", "the day": "date"}).collect()
    assert [r.rejected for r in bad] == [["unit", "the day"], ["v", "the day"], ["unit"]] and bad[1].v == "--"
    renamed = tables.read_typed(spark, path, declared, {"the day": "day"}, account=(second := Observation()))
    assert renamed.columns == ["day"] and renamed.count() == 5 and second.get["rejected_unit"] == 2
    extract = tables.read_extract(spark, path, {"u": ("unit", "int")}, "csv", account=(third := Observation()))
    assert extract.count() == 5 and third.get == {"n_rows": 5, "rejected_unit": 2}


def test_a_scope_releases_what_it_owns(spark, panel):
    spark.catalog.clearCache()
    panel = spark.createDataFrame(panel.collect(), panel.schema)
    held = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    before = held()
    with scope(spark) as mine:
        spec = ModelSpec(outcome="y", period=(1, 6), covariates=("x",), control="notyettreated", balance_e=1, draws=20)
        assert fit(panel, spec).stacked().count() > 0
        assert quantiles.iqr_outliers(panel, "y", "year").count() == panel.count()
        assert describe.kde(panel, "treated", ["y"], n=16).count() == 32
        folder = scratch_path(spark, "inside")
        spark.range(3).write.parquet(folder)
        assert held() > before and len(mine.tables) > 3
        with scope(spark):
            inner = persisted(spark.range(5))
            assert inner.count() == 5 and inner.storageLevel.useMemory
        assert not inner.storageLevel.useMemory
    assert held() == before
    assert not os.path.exists(os.path.dirname(folder.removeprefix("file:")))
    kept = persisted(spark.range(4))  # without a scope a table stays
    assert kept.count() == 4 and held() == before + 1
    kept.unpersist()
