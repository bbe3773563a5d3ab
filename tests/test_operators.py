from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwave.functions import columns as C
from panelwave.functions.student import t_p_value, t_quantile
from panelwave.operators import describe, frames, joins, quantiles, reshape, rollups
from panelwave.session import persisted, scratch_path, settle
from panelwave.sources import tables


@pytest.mark.parametrize("probs", [(0.25, 0.5, 0.75), (0.0, 0.1, 0.999, 1.0)])
def test_group_quantiles_are_exact_under_skew_and_ties(spark, probs):
    """One group holds most rows, one value a third of them."""
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(6000) < 0.33, 7.0, rng.normal(5, 2, 6000))
    data = [("hot", float(v)) for v in hot] + [("small", float(v)) for v in rng.normal(0, 1, 37)]
    data += [("one", 4.0), (None, 1.0), (None, 3.0), ("hot", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    got = {r.k: (r.n, r.q) for r in quantiles.group_quantiles(df, "v", probs, ["k"], accuracy=100).collect()}
    for k in ("hot", "small", "one", None):
        values = [v for kk, v in data if kk == k and v is not None]
        assert got[k][0] == len(values)
        assert got[k][1] == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


def test_quantile_bucket_labels(spark):
    df = spark.createDataFrame([(float(v),) for v in (2004, 2007, 2010, 2014, 2019)], "v double")
    rows = {r.v: (r.bucket, r.bucket_label) for r in quantiles.quantile_bucket(df, "v").collect()}
    assert rows[2004.0] == (1, "[2004, 2007]") and rows[2007.0] == (1, "[2004, 2007]")
    assert rows[2010.0] == (2, "(2007, 2010]") and rows[2019.0][0] == 4


def test_outlier_fences_are_asymmetric(spark):
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None, -9.0])], "unit_id int, year int, v double")
    flags = {r.unit_id: r.outlier for r in quantiles.iqr_outliers(df, "v").collect()}
    q1, q3 = np.quantile([1, 2, 3, 4, 5, 100, -9], [0.25, 0.75])
    assert flags[5] == int(100 > q3 + 7.5 * (q3 - q1)) == 1
    assert flags[7] == int(-9 < q1 - 1.5 * (q3 - q1)) and flags[6] is None
    assert 5 not in {r.unit_id for r in joins.drop_flagged(df, quantiles.iqr_outliers(df, "v")).collect()}


def test_text_functions(spark):
    row = spark.range(1).select(
        C.fold_accents(F.lit("São João D'Ávila çÑ")).alias("a"),
        C.extract_year(F.lit("dezembro 2020")).alias("b"),
        C.extract_year(F.lit("none")).alias("c"),
        C.prefix_key(F.lit(3550308)).alias("d"),
        C.parse_date(F.lit("31/12/2013")).alias("e"),
        C.parse_date(F.lit("later")).alias("f"),
        C.positive_log(F.lit(0.0)).alias("g"),
        C.number_text(F.lit(-0.0125)).alias("h"),
        C.interval_text(F.lit(0.036), F.lit(0.166), 1, True).alias("i"),
        C.number_text(F.lit(-0.0001)).alias("j"),
        C.number_text(F.lit(100.0)).alias("k"),
    ).first()
    assert row.a == "sao joao d'avila cñ"
    assert (row.b, row.c, row.d) == (2020, None, 355030)
    assert row.e == dt.date(2013, 12, 31) and row.f is None and row.g is None
    assert (row.h, row.i, row.j, row.k) == ("-0.012", "[3.6%, 16.6%]", "0", "100")


def test_alias_does_not_rewrite_a_correct_name(spark):
    df = spark.createDataFrame([("picarras",), ("balneario picarras",), ("piui",), (None,)], "m string")
    fixed = frames.alias_names(df, "m", {"picarras": "balneario picarras", "piui": "piumhi"})
    assert [r.m for r in fixed.collect()] == ["balneario picarras", "balneario picarras", "piumhi", None]


def test_split2(spark):
    df = spark.createDataFrame([("110001 Alta Floresta - RO",), ("x",)], "t string")
    merged = frames.split2(df, "t", " ", ("code", "name")).collect()
    assert merged[0] == ("110001", "Alta Floresta - RO") and merged[1] == ("x", None)
    assert frames.split2(df, "t", " - ", ("n", "s"), "drop").first() == ("110001 Alta Floresta", "RO")


def test_treatment_codes(spark):
    df = spark.createDataFrame([(1, 2004, 2003), (1, 2004, 2004), (2, None, 2010), (3, 2021, 2019)], "u int, start_year int, year int")
    rows = frames.code_treatment(df, 2003, 2019).collect()
    assert [r.treated for r in rows] == [0, 1, 0, 0]
    assert [r.any_treated for r in rows] == ["Treated", "Treated", "Untreated", "Untreated"]
    assert [r.start_year for r in rows] == [2004, 2004, 0, 2021]


def test_complete_and_reshape(spark):
    df = spark.createDataFrame([(2003, 1, 5), (2004, 2, 7)], "year int, unit int, deaths int")
    full = reshape.complete(df, "unit", "year", {"deaths": 0}).orderBy("unit", "year").collect()
    assert [(r.unit, r.year, r.deaths) for r in full] == [(1, 2003, 5), (1, 2004, 0), (2, 2003, 0), (2, 2004, 7)]
    plan = reshape.complete(df, "unit", "year", {"deaths": 0})._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    wide = reshape.to_wide(df, ["unit"], "year", "deaths", ["2003", "2004"])
    assert reshape.to_long(wide, ["unit"]).count() == 4
    assert len(reshape.event_time_names(15)) == 28


def test_build_panel_keeps_rows_and_rejects_duplicate_keys(spark):
    spine = spark.createDataFrame([(1, 2003, 11), (2, 2003, 22)], "unit int, year int, unit6 int")
    area = spark.createDataFrame([(1, 9.0)], "unit int, area double")
    iss = spark.createDataFrame([(22, 2003, 4.0)], "code int, year int, iss double")
    rows = joins.build_panel(
        spine, [joins.JoinSpec(area, ["unit"]), joins.JoinSpec(iss, {"unit6": "code", "year": "year"})]
    )
    assert rows.columns == ["unit", "year", "unit6", "area", "iss"]
    assert sorted(rows.collect()) == [(1, 2003, 11, 9.0, None), (2, 2003, 22, None, 4.0)]
    twice = joins.JoinSpec(area.union(area), ["unit"])
    with pytest.raises(Exception, match="duplicate key"):
        joins.attach(spine, twice).collect()


def test_membership_filters_survive_nulls(spark):
    df = spark.createDataFrame([(1, 2000), (2, 2010), (3, None)], "unit_id int, start_year int")
    kept = joins.drop_always_treated(df, df, 2003)
    assert sorted(r.unit_id for r in kept.collect()) == [2, 3]
    panel = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (2, 1, 0)], "unit_id int, region int, treated int")
    assert {r.region for r in joins.keep_treated_regions(panel, "region").collect()} == {1}


def test_support_bounds_both_rules(spark):
    df = spark.createDataFrame([(1, 10.0), (1, -10.0), (0, 99.0), (0, 9.0)], "treated int, v double")
    row = rollups.support_bounds(df, ["v"]).first()
    assert (row.max_v, row.min_v) == pytest.approx((10.1, -9.9))
    wide = rollups.support_bounds(df, ["v"], by_range=True)
    assert tuple(wide.first()) == pytest.approx((10.2, -10.2))
    assert sorted(r.v for r in rollups.support_trim(df, wide, ["v"]).collect()) == [-10.0, 9.0, 10.0]


def test_rollups_with_a_hot_key(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 5 - 1).alias("w")
    )
    sums = {r.k: r.s for r in rollups.rollup_sum(df, ["k"], "w", "s").collect()}
    assert sum(sums.values()) == sum((i % 5) - 1 for i in range(9000))
    assert rollups.rollup_mean(df, ["k"], "w", "m").filter("k = 0").first().m == pytest.approx(2.0)


def test_histories_and_density(spark):
    rows = [(1, y, int(y >= 3)) for y in (1, 2, 3, 4)] + [(2, y, 0) for y in (1, 2, 4)]
    df = spark.createDataFrame(rows, "unit_id int, year int, treated int")
    assert [(r.history, r.n_units) for r in describe.histories(df, 1, 4).collect()] == [("BBTT", 1), ("CC.C", 1)]
    values = np.random.default_rng(0).normal(0, 1, 80)
    data = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(values)], "arm string, v double")
    curve = describe.kde(data, "arm", ["v"], n=64).filter("arm = 'a'").orderBy("point").collect()
    mine = np.array([v for i, v in enumerate(values) if i % 3])
    bw = 0.9 * min(mine.std(ddof=1), np.subtract(*np.quantile(mine, [0.75, 0.25])) / 1.34) * len(mine) ** -0.2
    grid = np.linspace(values.min(), values.max(), 64)
    want = np.exp(-0.5 * ((grid[:, None] - mine) / bw) ** 2).sum(1) / (len(mine) * bw * np.sqrt(2 * np.pi))
    assert [r.density for r in curve] == pytest.approx(list(want), rel=1e-9)


def test_binned_density_against_the_exact_sum(spark):
    """Heavy tails, ties for a third of the rows, a constant arm and a far outlier."""
    rng = np.random.default_rng(4)
    rows = [("t", float(v)) for v in rng.standard_t(2, 4000)] + [("n", float(v)) for v in rng.normal(3, 0.2, 2500)]
    rows += [("t", 1.25)] * 2000 + [("t", 900.0)] + [("flat", 2.0)] * 5 + [("n", None), (None, 1.0), (None, 1.5), (None, 4.0)]
    data = spark.createDataFrame(rows, "arm string, v double").repartition(5)
    exact = describe.kde(data, "arm", ["v"], exact=True).withColumnsRenamed({"density": "want", "x": "at"})
    binned = describe.kde(data, "arm", ["v"])
    same = (exact["arm"].eqNullSafe(binned["arm"])) & (exact["point"] == binned["point"])
    both = exact.join(binned, same).select(exact["arm"], "at", "x", "want", "density").collect()
    assert len(both) == 3 * 512 and describe.kde_error_bound() < 2.5e-13
    peak = max(r.want for r in both if r.want is not None)
    for r in both:
        assert r.at == r.x and (r.density is None) == (r.want is None) == (r.arm == "flat")
        if r.want is not None:
            assert abs(r.density - r.want) < 1e-12 * peak
    plan = binned._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Generate explode(sequence(0, 511" in line and "value" in line for line in plan.splitlines())


def test_student_t(spark):
    """Published quantiles and tails, few to very many degrees of freedom, and missing values."""
    cases = [(0.95, 10.0, 2.2281388519), (0.95, 3000.0, 1.9607555), (0.95, 1.0, 12.7062047), (0.99, 5.0, 4.0321430), (0.5, 2.0, 0.8164966)]
    cases += [(0.95, 1e9, 1.9599640), (0.95, 99_000.0, 1.9599880), (0.95, 101_000.0, 1.9599875)]
    df = spark.createDataFrame(cases, "c double, df double, t double")
    for row in df.select("*", t_quantile(F.col("c"), F.col("df")).alias("q"), t_p_value(-F.col("t"), F.col("df")).alias("p")).collect():
        assert row.q == pytest.approx(row.t, abs=1e-6) and row.p == pytest.approx(1 - row.c, abs=1e-7)
    tails = spark.createDataFrame([(0.0, 4.0), (50.0, 9.0), (3.0, None), (None, 3.0), (1.0, 0.5)], "t double, df double")
    p = [r.p for r in tails.select(t_p_value(F.col("t"), F.col("df")).alias("p")).collect()]
    assert p[0] == 1.0 and p[1] == pytest.approx(2.508e-12, rel=1e-3) and p[2:] == [None, None, None]
    plan = df.select(t_quantile(F.col("c"), F.col("df")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


# Published inputs and results (treated mean, sd; control mean, sd; difference, interval).
WELCH = {
    "iss": (14.80, 1.33, 13.60, 1.89, 1.2, 0.67, 1.7),
    "pop": (9.87, 0.78, 9.39, 1.23, 0.48, 0.17, 0.79),
    "gdp": (13.50, 1.10, 12.42, 1.49, 1.1, 0.64, 1.5),
    "area": (5.79, 1.09, 5.96, 1.04, -0.17, -0.60, 0.26),
}


def test_welch_matches_published_intervals(spark):
    rows = [(k, 27, v[0], v[1] ** 2, 3037, v[2], v[3] ** 2) for k, v in WELCH.items()]
    moments = spark.createDataFrame(rows, "variable string, n0 int, m0 double, v0 double, n1 int, m1 double, v1 double")
    for row in describe.welch_from_moments(moments).collect():
        diff, lo, hi = WELCH[row.variable][4:]
        assert row.diff == pytest.approx(diff, abs=0.051)
        assert row.lo == pytest.approx(lo, abs=0.012) and row.hi == pytest.approx(hi, abs=0.06)


# Published effects and sizes by cohort, and effects by year.
COHORTS = {
    2004: (0.435, 1), 2007: (-0.293, 1), 2008: (0.284, 2), 2009: (0.591, 1), 2010: (-0.142, 1), 2011: (0.285, 2),
    2012: (-0.137, 1), 2013: (-0.034, 1), 2014: (0.312, 5), 2015: (-0.491, 1), 2017: (0.087, 2), 2018: (0.120, 4),
    2019: (-0.112, 5),
}
COUNTS = [1, 1, 1, 2, 4, 5, 6, 8, 9, 10, 15, 16, 16, 18, 22, 27]


def test_published_counts(spark):
    units = [(g * 10 + i, g) for g, (_, n) in COHORTS.items() for i in range(n)] + [(1, 0)]
    df = spark.createDataFrame(units, "unit_id int, start_year int")
    panel = df.select("unit_id", "start_year", F.explode(F.sequence(F.lit(2003), F.lit(2019))).alias("year"))
    assert {r.start_year: r.number_units for r in rollups.cohort_sizes(panel).collect()} == {g: n for g, (_, n) in COHORTS.items()}
    counts = rollups.treated_counts(panel).orderBy("year").collect()
    assert [r.number_units for r in counts] == COUNTS and counts[0].year == 2004
    assert rollups.n_balanced(panel, 5).first().n_balanced == 15
    shares = sum(a * n for a, n in COHORTS.values()) / 27
    assert round(shares, 3) == 0.101


def test_sources(spark):
    path = scratch_path(spark, "t")
    df = spark.createDataFrame([(1, 2003, 1.5), (2, 2004, None)], "unit int, year int, v double")
    tables.write_panel(df, path)
    assert spark.read.parquet(path).filter("year = 2003").count() == 1
    calls = []

    def build():
        calls.append(1)
        return df

    once = scratch_path(spark, "once")
    assert tables.materialize_once(spark, once, build).count() == 2
    assert tables.materialize_once(spark, once, build).count() == 2 and len(calls) == 1
    with pytest.raises(ValueError):
        tables.union_yearly(spark, {2003: path}, ["only"], fmt="parquet")


def test_settled_tables_are_local(spark):
    small = settle(spark.range(50))
    assert small.count() == 50 and small.rdd.getNumPartitions() == 1
    big = persisted(spark.range(50))
    assert big.storageLevel.useMemory and big.rdd.getNumPartitions() > 1
    big.unpersist()


def test_read_typed_goes_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,extra,a\n1,x,2\n")
    row = tables.read_typed(spark, str(tmp_path / "t.csv"), "a int, b int").first()
    assert (row.a, row.b) == (2, 1)
    with pytest.raises(ValueError, match="has no columns"):
        tables.read_typed(spark, str(tmp_path / "t.csv"), "a int, c int")


def test_two_values_for_a_key_stop_the_pivot(spark):
    df = spark.createDataFrame([(1, "p", 1.0), (1, "p", 2.0)], "k int, n string, v double")
    with pytest.raises(Exception, match="two values"):
        reshape.to_wide(df, ["k"], "n", "v", ["p"]).collect()
