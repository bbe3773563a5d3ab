"""Estimators against plain numpy on a small synthetic panel."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwave.plans import covariates, eventstudy, sensitivity
from panelwave.plans.aggregate import KINDS, aggregate, z_value
from panelwave.plans.covariates import att_gt, build_design, propensity_table
from panelwave.plans.design import ModelSpec, prepare, unit_paths
from panelwave.plans.model import fit

SPEC = ModelSpec(outcome="y", period=(1, 6), control="notyettreated", only_regions=False, balance_e=2, cband=False)


def brute_cell(pdf, g, t, b, covs, est, control):
    """(att, se, psi by unit) of one cell by direct matrix algebra."""
    wide = pdf.pivot(index="unit_id", columns="year", values="y")
    cohort = pdf.groupby("unit_id")["start_year"].first().fillna(0).astype(int)
    later = cohort > max(t, b) if control == "notyettreated" else np.zeros(len(cohort), bool)
    d = (cohort == g).to_numpy()
    c = ((cohort == 0) | later).to_numpy() & ~d
    use = d | c
    dy = (wide[t] - wide[b]).to_numpy()[use]
    d = d[use].astype(float)
    x = np.ones((use.sum(), 1))
    for name in covs:
        x = np.column_stack([x, pdf.pivot(index="unit_id", columns="year", values=name)[b].to_numpy()[use]])
    n, n1 = len(cohort), use.sum()
    beta = np.linalg.lstsq(x[d == 0], dy[d == 0], rcond=None)[0] if est != "ipw" else np.zeros(x.shape[1])
    pi = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ pi))
        pi = pi + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (d - p))
    p = 1 / (1 + np.exp(-x @ pi))
    r = dy - x @ beta
    wt, wc = d, np.where(d == 0, p / (1 - p), 0.0) if est != "reg" else np.zeros(n1)
    eta_t = (wt * r).mean() / wt.mean()
    inf = wt * (r - eta_t)
    xx = np.linalg.inv((x * (1 - d)[:, None]).T @ x / n1)
    psi_b = (x * ((1 - d) * r)[:, None]) @ xx
    if est != "ipw":
        inf = inf - psi_b @ (x * wt[:, None]).mean(0)
    psi, att = inf / wt.mean(), eta_t
    if est != "reg":
        eta_c = (wc * r).mean() / wc.mean()
        hess = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x / n1)
        psi_p = (x * (d - p)[:, None]) @ hess
        ctl = wc * (r - eta_c) + psi_p @ (x * (wc * (r - eta_c))[:, None]).mean(0)
        if est == "dr":
            ctl = ctl - psi_b @ (x * wc[:, None]).mean(0)
        psi, att = psi - ctl / wc.mean(), eta_t - eta_c
    full = np.zeros(n)
    full[use] = psi * n / n1
    return att, np.sqrt((full**2).sum()) / n, full


@pytest.mark.parametrize("est", ["dr", "reg", "ipw"])
@pytest.mark.parametrize("control,base", [("notyettreated", "universal"), ("nevertreated", "varying")])
def test_covariate_estimators_match_numpy(panel, panel_pd, est, control, base):
    effects = att_gt(panel, SPEC.but(covariates=("x", "w"), est=est, control=control, base=base))
    rows = effects.table.collect()
    assert len(rows) == (12 if base == "universal" else 10)
    for row in rows:
        b = row.g - 1 if base == "universal" or row.t >= row.g else row.t - 1
        assert row.cell_status == "ok"
        if row.t == b:
            assert row.att == 0 and row.se is None
            continue
        att, se, _ = brute_cell(panel_pd, row.g, row.t, b, ("x", "w"), est, control)
        assert row.att == pytest.approx(att, abs=1e-8)
        assert row.se == pytest.approx(se, rel=1e-6)


def test_moments_agree_with_scores_and_recover_the_effect(panel, panel_pd):
    plain = {(r.g, r.t): r for r in att_gt(panel, SPEC).table.collect()}
    for (g, t), row in plain.items():
        if t != g - 1:
            att, se, _ = brute_cell(panel_pd, g, t, g - 1, (), "reg", "notyettreated")
            assert row.att == pytest.approx(att, abs=1e-9)
            assert row.se == pytest.approx(se, rel=1e-7)
    overall = aggregate(att_gt(panel, SPEC.but(covariates=("x",))), "group").overall.first()
    assert abs(overall.att - 0.5) < 4 * overall.se


@pytest.mark.parametrize("covs", [(), ("x",)])
def test_aggregates_match_per_unit_influence(panel, panel_pd, covs):
    """Dynamic and group aggregation from the definition, unit by unit."""
    effects = att_gt(panel, SPEC.but(covariates=covs))
    est = "dr" if covs else "reg"
    cohort = panel_pd.groupby("unit_id")["start_year"].first().fillna(0).to_numpy().astype(int)
    n = len(cohort)
    pg = {g: (cohort == g).mean() for g in (3, 5)}
    cell = {}
    for g in (3, 5):
        for t in range(1, 7):
            same = t == g - 1
            cell[g, t] = (0.0, 0.0, np.zeros(n)) if same else brute_cell(panel_pd, g, t, g - 1, covs, est, "notyettreated")

    def weighted(keys, values, infl):
        s = sum(pg[k] for k in keys)
        theta = sum(pg[k] * v for k, v in zip(keys, values)) / s
        out = sum(pg[k] / s * f for k, f in zip(keys, infl))
        total = sum((cohort == k) - pg[k] for k in keys)
        for k, v in zip(keys, values):
            out = out + v * (((cohort == k) - pg[k]) / s - pg[k] * total / s**2)
        return theta, out

    dynamic = {r.egt: r for r in aggregate(effects, "dynamic").table.collect()}
    for e, row in dynamic.items():
        keys = [g for g in (3, 5) if 1 <= g + e <= 6]
        theta, infl = weighted(keys, [cell[g, g + e][0] for g in keys], [cell[g, g + e][2] for g in keys])
        assert row.att == pytest.approx(theta, abs=1e-8)
        if e == -1:
            assert row.att == 0 and row.se is None
        else:
            assert row.se == pytest.approx(np.sqrt((infl**2).sum()) / n, rel=1e-6)
    thetas = [np.mean([cell[g, t][0] for t in range(g, 7)]) for g in (3, 5)]
    infl = [np.mean([cell[g, t][2] for t in range(g, 7)], axis=0) for g in (3, 5)]
    theta, total = weighted([3, 5], thetas, infl)
    overall = aggregate(effects, "group").overall.first()
    assert overall.att == pytest.approx(theta, abs=1e-8)
    assert overall.se == pytest.approx(np.sqrt((total**2).sum()) / n, rel=1e-6)


def test_influence_sums_to_zero_and_cells_are_invariant(panel):
    spec = SPEC.but(covariates=("x",))
    effects = att_gt(panel, spec)
    for row in effects.influence().groupBy("g", "t").agg(F.sum("psi").alias("s")).collect():
        assert abs(row.s) < 1e-6
    moved = panel.withColumn("y", F.col("y") + 3.0 * F.col("unit_id") % 11 + F.col("year") * 2.0)
    a = {(r.g, r.t): r.att for r in att_gt(panel, SPEC).table.collect()}
    b = {(r.g, r.t): r.att for r in att_gt(moved, SPEC).table.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_bootstrap_does_not_depend_on_partitions(panel):
    spec = SPEC.but(bootstrap=True, cband=True, draws=200)
    first = {r.egt: r for r in aggregate(att_gt(panel.repartition(1), spec), "dynamic").table.collect()}
    second = {r.egt: r for r in aggregate(att_gt(panel.repartition(13, "year"), spec), "dynamic").table.collect()}
    analytic = {r.egt: r for r in aggregate(att_gt(panel, SPEC), "dynamic").table.collect()}
    for e, row in first.items():
        assert row.crit == pytest.approx(second[e].crit, rel=1e-9) and row.crit > 1.96
        if e != -1:
            assert row.se == pytest.approx(second[e].se, rel=1e-9)
            assert row.se == pytest.approx(analytic[e].se, rel=0.35)


def test_propensity_on_original_scale(panel, panel_pd):
    design = build_design(panel, SPEC.but(covariates=("x", "const")))
    assert design.dropped == ["const"]
    row = propensity_table(design).filter("g = 3 and horizon = 6").first()
    first = panel_pd[panel_pd.year == 2].set_index("unit_id")
    keep = first.start_year.isna() | (first.start_year == 3)
    x = np.column_stack([np.ones(keep.sum()), first.x[keep]])
    d = (first.start_year[keep] == 3).to_numpy().astype(float)
    pi = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ pi))
        pi += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (d - p))
    assert [row.intercept, *row.coef] == pytest.approx(list(pi), abs=1e-7)


def test_passes_take_tasks_by_units_not_by_shuffle_partitions(spark, panel, monkeypatch):
    """A pass over few units is one task however many partitions the shuffles have; more units, more tasks."""
    spec, before = SPEC.but(covariates=("x",)), spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false"}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        design = build_design(panel, spec)
        assert design.units.rdd.getNumPartitions() == 1
        n = sum(design.sizes.values())
        assert design.units.count() == n
        monkeypatch.setattr(covariates, "UNITS_PER_TASK", 50)
        assert build_design(panel, spec).units.rdd.getNumPartitions() == -(-n // 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bad_cells_get_a_status(spark, panel):
    """A cohort of one unit with more covariates than units must not stop the run."""
    lone = panel.withColumn("start_year", F.when(F.col("unit_id") == 0, 4).otherwise(F.when(F.col("start_year") == 3, 3)))
    lone = lone.withColumn("treated", F.when(F.col("start_year") <= F.col("year"), 1).otherwise(0))
    rows = att_gt(lone, SPEC.but(covariates=("x",), est="reg", min_treated=2)).table.filter("g = 4 and t <> 3").collect()
    assert {r.cell_status for r in rows} == {"few_treated"} and all(r.att is None for r in rows)


def test_duplicate_unit_year_stops(panel):
    with pytest.raises(Exception, match="duplicate unit-year"):
        att_gt(panel.unionByName(panel.limit(1)), SPEC).table.collect()


@pytest.mark.parametrize("drop", [0, 40])
def test_event_study_matches_dummy_regression(spark, panel, panel_pd, drop):
    rng = np.random.default_rng(1)
    gone = rng.choice(len(panel_pd), drop, replace=False)
    pdf = panel_pd.drop(index=gone)
    keys = spark.createDataFrame(pdf[["unit_id", "year"]]).withColumn("year", F.col("year").cast("int"))
    data = panel.join(keys, ["unit_id", "year"], "left_semi")
    data = data.withColumn("z", F.sin(F.col("unit_id") * F.col("year")))
    fitted = eventstudy.event_study(data, "y", ["z", "w"], n_periods=4)
    assert fitted.dropped == ["w"]  # constant within units
    el = (pdf.year - pdf.start_year).to_numpy()
    cols, names = [], []
    for l in range(-3, 3):
        cols.append((el == l).astype(float)), names.append(f"e{l}")
    cols.append(np.sin(pdf.unit_id * pdf.year).to_numpy()), names.append("z")
    units = [(pdf.unit_id == u).to_numpy().astype(float) for u in pdf.unit_id.unique()]
    years = [(pdf.year == t).to_numpy().astype(float) for t in sorted(pdf.year.unique())[1:]]
    X = np.column_stack(cols + units + years)
    y = pdf.y.to_numpy()
    pinv = np.linalg.pinv(X.T @ X)
    beta = pinv @ X.T @ y
    rank = np.linalg.matrix_rank(X)
    s2 = ((y - X @ beta) ** 2).sum() / (len(y) - rank)
    assert fitted.n_rows == len(pdf) and fitted.sigma2 == pytest.approx(s2, rel=1e-8)
    for i, name in enumerate(names):
        assert fitted.coef[name] == pytest.approx(beta[i], abs=1e-6)
        assert fitted.se[name] == pytest.approx(np.sqrt(s2 * pinv[i, i]), rel=1e-5)
    table = eventstudy.event_study_table(data, fitted, 4)
    assert [r.time_of_exposure for r in table.orderBy("time_of_exposure").collect()] == list(range(-3, 3))


def test_sensitivity_widens_and_checks_its_input(panel):
    agg = aggregate(att_gt(panel, SPEC), "dynamic")
    base = sensitivity.original_ci(agg, 0).first()
    rel = sensitivity.sensitivity(agg, "relative_magnitude", 0, (0.0, 0.5, 1.0)).orderBy("m").collect()
    assert [r.m for r in rel] == [0.5, 1.0]
    assert rel[0].lo < base.lo and rel[1].hi > rel[0].hi
    smooth = sensitivity.sensitivity(agg, "smoothness", 0, (0.0, 0.1)).orderBy("m").collect()
    assert smooth[1].hi - smooth[0].hi == pytest.approx(0.1)
    with pytest.raises(ValueError):
        sensitivity.event_cov(aggregate(att_gt(panel, SPEC), "group"))
    with pytest.raises(ValueError):
        sensitivity.event_cov(aggregate(att_gt(panel, SPEC.but(base="varying")), "dynamic"))


def test_prepare_counts_distinct_units_and_fit_runs(panel):
    broken = panel.withColumn("y", F.when((F.col("unit_id") == 1) & (F.col("year") == 2), None).otherwise(F.col("y")))
    broken = broken.withColumn("y", F.when(F.col("unit_id") == 2, None).otherwise(F.col("y")))
    prepared = prepare(broken, SPEC.but(covariates=("x",)))
    assert sorted(r.unit_id for r in prepared.excluded.collect()) == [1, 2]
    assert prepared.message().startswith("2 units")
    assert [r.unit_id for r in prepare(broken, SPEC, compat=True).excluded.collect()] == [1]
    result = fit(broken, SPEC)
    assert set(result.aggregates) == set(KINDS)
    assert result.effects.n == 238
    assert result.stacked().count() > 10
    overall = result.overalls().filter("aggregation = 'simple'").first()
    assert overall.hi - overall.lo == pytest.approx(2 * z_value(0.05) * overall.se)


def test_many_late_cohorts_form_one(spark):
    """With ``late_as_never`` off, start years after the window are alike and none is lost."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(2500):
        start = 4 if i < 60 else 1000 + i
        for t in range(1, 7):
            rows.append((i, 1, t, start, int(t >= start), float(rng.normal() + (t >= start)), float(i % 7)))
    df = spark.createDataFrame(rows, "unit_id long, region long, year int, start_year int, treated int, y double, x double")
    spec = ModelSpec(outcome="y", period=(1, 6), control="notyettreated", late_as_never=False)
    plain = att_gt(df, spec)
    assert plain.n == 2500 and {r.n_control for r in plain.table.collect()} == {2440}
    assert att_gt(df, spec.but(covariates=("x",))).n == 2500


def test_lost_cells_stop_an_aggregation(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):
        cohort = 3 if i < 40 else 4 if i < 80 else None
        x = 50.0 + rng.normal() if cohort == 4 else rng.normal()
        for t in range(1, 7):
            on = int(cohort is not None and t >= cohort)
            effect = {3: 1.0, 4: 5.0}.get(cohort, 0.0) * on
            rows.append((i, 1, t, cohort, on, float(rng.normal() * 0.1 + effect), float(x)))
    df = spark.createDataFrame(rows, "unit_id long, region long, year int, start_year int, treated int, y double, x double")
    spec = ModelSpec(outcome="y", period=(1, 6), covariates=("x",), cband=False)
    effects = att_gt(df, spec)
    assert {r.cell_status for r in effects.table.filter("g = 4 and t <> 3").collect()} <= {"separated", "not_converged", "singular_hessian"}
    with pytest.raises(ValueError, match="g=4"):
        aggregate(effects, "simple")
    lossy = aggregate(att_gt(df, spec.but(drop_bad_cells=True)), "group")
    overall = lossy.overall.first()
    assert abs(overall.att - 1.0) < 0.2 and overall.n_treated_dropped == 40 and overall.n_cells_dropped == 3
    assert {r.egt: (r.n_cells_dropped, r.att is None) for r in lossy.table.collect()} == {3: (0, False), 4: (3, True)}


def test_duplicate_unit_years_stop_both_designs(spark):
    rows = [(1, 1, t, 3, 1.0) for t in (1, 1, 2)] + [(2, 1, t, 0, 1.0) for t in (1, 2, 3)]
    df = spark.createDataFrame([(*r[:4], int(r[2] >= 3 and r[3] > 0), r[4]) for r in rows], "unit_id long, region long, year int, start_year int, treated int, y double")
    spec = ModelSpec(outcome="y", period=(1, 3), only_regions=False)
    for built in (prepare(df, spec).panel, unit_paths(df, spec)):
        with pytest.raises(Exception, match="duplicate unit-year"):
            built.collect()


def test_sensitivity_needs_its_event_times(spark, panel):
    spec = ModelSpec(outcome="y", period=(2, 6), cband=False)
    agg = aggregate(att_gt(panel.filter("coalesce(start_year, 0) in (0, 3)"), spec), "dynamic")
    for kind in ("smoothness", "relative_magnitude"):
        with pytest.raises(ValueError, match="event times"):
            sensitivity.sensitivity(agg, kind, 0, (0.0, 0.5))
