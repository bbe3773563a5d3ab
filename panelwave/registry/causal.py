"""Queries for the estimation plans, on the segment panel unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwave.operators.frames import stack
from panelwave.operators.reshape import event_time_names
from panelwave.plans import eventstudy as E, sensitivity as S, tables as T
from panelwave.plans.aggregate import KINDS, Aggregate, aggregate, aggregate_all, bootstrap_table
from panelwave.plans.att import Effects, did_2x2 as two_by_two
from panelwave.plans.covariates import att_gt, build_design, propensity_table
from panelwave.plans.design import ModelSpec, keep, prepare
from panelwave.plans.model import covariate_set_sweep as sweep, fit
from panelwave.registry import causal_sql as Q
from panelwave.registry.catalog import query, r, rounded
from panelwave.registry.panels import CUST_PANEL_CTE, cust_did, cust_panel, seg_did, seg_spec

EFFECT = ["att", "se"]


def _seg_effects(spark: SparkSession, sf: str, **changes: object) -> Effects:
    return att_gt(keep(seg_did(spark, sf)), seg_spec(**changes))


def _cust_spec(**changes: object) -> ModelSpec:
    return seg_spec(**changes)


def _att(effects: Effects, status: bool = False) -> DataFrame:
    cols = ["g", "t", "att", "se", "n_treated", "n_control"] + (["cell_status"] if status else [])
    return rounded(effects.table.select(*cols), EFFECT)


def _both(agg: Aggregate) -> DataFrame:
    """Component rows and the overall row (egt NULL) of an aggregation without bands."""
    overall = agg.overall.select(F.lit(None).cast("int").alias("egt"), "att", "se", "lo", "hi")
    rows = overall if agg.kind == "simple" else agg.table.drop("crit").unionByName(overall)
    return rounded(rows, ["att", "se", "lo", "hi"])


# ---------------------------------------------------------------- preparation and cells


@query(
    "prepare_did_panel",
    f"{Q.prep()} SELECT unit_id, year, cohort AS start_year, {r('y', 'y')} FROM prep",
)
def prepare_did_panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = prepare(seg_did(spark, sf), seg_spec(covariates=("x1",))).panel
    start = F.when(F.col("start_year").between(1995, 2000), F.col("start_year")).otherwise(0)
    return rounded(rows.select("unit_id", "year", start.alias("start_year"), "y"), ["y"])


@query(
    "prepare_customer_panel",
    f"{Q.prep(source='cust')} SELECT unit_id, year, cohort AS start_year, {r('y', 'y')} FROM prep",
)
def prepare_customer_panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = prepare(cust_did(spark, sf), _cust_spec()).panel
    start = F.when(F.col("start_year").between(1995, 2000), F.col("start_year")).otherwise(0)
    return rounded(rows.select("unit_id", "year", start.alias("start_year"), "y"), ["y"])


@query(
    "did_2x2",
    f"""WITH {Q.SEG_DID_CTE}, a AS (
      SELECT CASE WHEN start_year = 1997 THEN 1 ELSE 0 END AS d, year, avg(y) AS m FROM did
      WHERE year IN (1996, 1999) AND (start_year IS NULL OR start_year = 1997 OR start_year > 1999) GROUP BY d, year),
    w AS (SELECT max(m) FILTER (d = 1 AND year = 1996) AS treated_pre, max(m) FILTER (d = 1 AND year = 1999) AS treated_post,
                 max(m) FILTER (d = 0 AND year = 1996) AS control_pre, max(m) FILTER (d = 0 AND year = 1999) AS control_post FROM a)
    SELECT {r('treated_pre', 'treated_pre')}, {r('treated_post', 'treated_post')}, {r('control_pre', 'control_pre')},
           {r('control_post', 'control_post')},
           {r('treated_post - treated_pre - (control_post - control_pre)', 'did')} FROM w""",
)
def did_2x2(spark: SparkSession, sf: str) -> DataFrame:
    out = two_by_two(seg_did(spark, sf), seg_spec(), 1997, 1996, 1999)
    return rounded(out, out.columns)


@query("att_gt_nevertreated", Q.prep() + Q.members("nevertreated") + Q.PLAIN + Q.att_select())
def att_gt_nevertreated(spark: SparkSession, sf: str) -> DataFrame:
    return _att(_seg_effects(spark, sf, control="nevertreated"))


@query("att_gt_notyettreated", Q.prep() + Q.members() + Q.PLAIN + Q.att_select())
def att_gt_notyettreated(spark: SparkSession, sf: str) -> DataFrame:
    return _att(_seg_effects(spark, sf))


@query(
    "att_gt_universal_base",
    Q.prep(source="cust") + Q.members("nevertreated") + Q.PLAIN + Q.att_select(),
)
def att_gt_universal_base(spark: SparkSession, sf: str) -> DataFrame:
    """On customers; the effect one year before treatment is 0 by construction."""
    return _att(att_gt(keep(cust_did(spark, sf)), _cust_spec(control="nevertreated", base="universal")))


@query("att_gt_varying_base", Q.prep() + Q.members(base="varying") + Q.PLAIN + Q.att_select())
def att_gt_varying_base(spark: SparkSession, sf: str) -> DataFrame:
    return _att(_seg_effects(spark, sf, base="varying"))


@query(
    "att_gt_reg",
    Q.prep(covariate="x1") + Q.members() + Q.REG + Q.att_select(),
)
def att_gt_reg(spark: SparkSession, sf: str) -> DataFrame:
    return _att(_seg_effects(spark, sf, covariates=("x1",), est="reg"))


@query("att_gt_ipw", Q.prep(covariate="b") + Q.members() + Q.IPW01 + Q.att_select())
def att_gt_ipw(spark: SparkSession, sf: str) -> DataFrame:
    return _att(_seg_effects(spark, sf, covariates=("b",), est="ipw"))


@query("att_gt_dr", Q.prep(covariate="b") + Q.members() + Q.DR01 + Q.att_select())
def att_gt_dr(spark: SparkSession, sf: str) -> DataFrame:
    return _att(_seg_effects(spark, sf, covariates=("b",), est="dr"))


@query(
    "att_gt_dr_covariates",
    Q.prep(covariate="x1", source="cust") + Q.members() + Q.doubly_robust() + Q.att_select(),
)
def att_gt_dr_covariates(spark: SparkSession, sf: str) -> DataFrame:
    """Doubly robust with a continuous covariate, on customers."""
    return _att(att_gt(keep(cust_did(spark, sf)), _cust_spec(covariates=("x1",), est="dr")))


@query(
    "propensity_by_cell",
    Q.prep(covariate="b")
    + Q.members()
    + f""", f AS (SELECT g, b, greatest(t, b) AS horizon, x, sum(d) / sum(1 - d) AS odds FROM memb WHERE t <> b
                  GROUP BY g, t, b, x),
    w AS (SELECT g, b, horizon, max(odds) FILTER (x = 0) AS o0, max(odds) FILTER (x = 1) AS o1
          FROM f GROUP BY g, b, horizon)
    SELECT g, b, horizon, {r('ln(o0)', 'intercept')}, {r('ln(o1) - ln(o0)', 'slope')} FROM w""",
)
def propensity_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    design = build_design(seg_did(spark, sf), seg_spec(covariates=("b",)))
    fits = propensity_table(design).select("g", "b", "horizon", "intercept", F.get("coef", F.lit(0)).alias("slope"))
    return rounded(fits, ["intercept", "slope"])


@query(
    "influence_function",
    Q.prep() + Q.members() + Q.PLAIN + f" SELECT unit_id, g, t, {r('psi', 'psi')} FROM psi JOIN est USING (g, t) WHERE t <> b",
)
def influence_function(spark: SparkSession, sf: str) -> DataFrame:
    psi = _seg_effects(spark, sf).influence().withColumnRenamed("unit", "unit_id")
    return rounded(psi, ["psi"])


@query(
    "influence_function_dr",
    Q.prep(covariate="b") + Q.members() + Q.DR01 + f" SELECT unit_id, g, t, {r('psi', 'psi')} FROM psi",
)
def influence_function_dr(spark: SparkSession, sf: str) -> DataFrame:
    psi = _seg_effects(spark, sf, covariates=("b",)).influence().withColumnRenamed("unit", "unit_id")
    return rounded(psi, ["psi"])


@query(
    "att_gt_se",
    Q.prep(source="cust") + Q.members() + Q.PLAIN
    + f" SELECT g, t, {r('sqrt(sum(psi * psi)) / max(n)', 'se')} FROM psi, nn WHERE t <> g - 1 GROUP BY g, t",
)
def att_gt_se(spark: SparkSession, sf: str) -> DataFrame:
    """Standard errors from the influence values themselves, on customers."""
    effects = att_gt(keep(cust_did(spark, sf)), _cust_spec())
    psi = effects.influence().groupBy("g", "t").agg(
        (F.sqrt(F.sum(F.col("psi") * F.col("psi"))) / float(effects.n)).alias("se")
    )
    return rounded(psi, ["se"])


# ---------------------------------------------------------------- aggregations

PLAIN = Q.prep() + Q.members() + Q.PLAIN
DR = Q.prep(covariate="b") + Q.members() + Q.DR01


@query("aggte_simple", PLAIN + Q.components("simple") + Q.aggregate_select("simple"))
def aggte_simple(spark: SparkSession, sf: str) -> DataFrame:
    return _both(aggregate(_seg_effects(spark, sf, cband=False), "simple"))


@query("aggte_dynamic", PLAIN + Q.components("dynamic") + Q.aggregate_select("dynamic"))
def aggte_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    return _both(aggregate(_seg_effects(spark, sf, cband=False), "dynamic"))


@query(
    "aggte_dynamic_balanced",
    PLAIN + Q.components("dynamic_balanced", 2) + Q.aggregate_select("dynamic_balanced"),
)
def aggte_dynamic_balanced(spark: SparkSession, sf: str) -> DataFrame:
    return _both(aggregate(_seg_effects(spark, sf, cband=False, balance_e=2), "dynamic_balanced"))


@query("aggte_group", PLAIN + Q.components("group") + Q.aggregate_select("group"))
def aggte_group(spark: SparkSession, sf: str) -> DataFrame:
    return _both(aggregate(_seg_effects(spark, sf, cband=False), "group"))


@query("aggte_calendar", PLAIN + Q.components("calendar") + Q.aggregate_select("calendar"))
def aggte_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return _both(aggregate(_seg_effects(spark, sf, cband=False), "calendar"))


@query("aggte_se", DR + Q.components("dynamic") + Q.aggregate_select("dynamic"))
def aggte_se(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of a doubly robust dynamic aggregation, with the weight terms."""
    return _both(aggregate(_seg_effects(spark, sf, cband=False, covariates=("b",)), "dynamic"))


@query("aggte_group_dr", DR + Q.components("group") + Q.aggregate_select("group"))
def aggte_group_dr(spark: SparkSession, sf: str) -> DataFrame:
    return _both(aggregate(_seg_effects(spark, sf, cband=False, covariates=("b",)), "group"))


BOOT_SQL = Q.draws(1000, 2024)


@query(
    "multiplier_bootstrap",
    PLAIN + Q.components("dynamic") + BOOT_SQL
    + f""" SELECT CAST(CASE WHEN comp <> 'overall' THEN comp END AS INTEGER) AS egt,
           {r('CASE WHEN sigma > 1e-12 THEN sigma / sqrt(n) END', 'se_bootstrap')} FROM sg, nn""",
)
def multiplier_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bootstrap_table(_seg_effects(spark, sf), "dynamic"), ["se_bootstrap"])


CUSTOMERS = Q.prep(source="cust") + Q.members() + Q.PLAIN


@query("aggte_dynamic_customers", CUSTOMERS + Q.components("dynamic") + Q.aggregate_select("dynamic"))
def aggte_dynamic_customers(spark: SparkSession, sf: str) -> DataFrame:
    """The dynamic aggregation with a unit per customer, so its work grows with the tables."""
    return _both(aggregate(att_gt(keep(cust_did(spark, sf)), _cust_spec(cband=False)), "dynamic"))


@query(
    "multiplier_bootstrap_customers",
    CUSTOMERS + Q.components("dynamic") + BOOT_SQL
    + f""" SELECT CAST(CASE WHEN comp <> 'overall' THEN comp END AS INTEGER) AS egt,
           {r('CASE WHEN sigma > 1e-12 THEN sigma / sqrt(n) END', 'se_bootstrap')} FROM sg, nn""",
)
def multiplier_bootstrap_customers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bootstrap_table(att_gt(keep(cust_did(spark, sf)), _cust_spec()), "dynamic"), ["se_bootstrap"])


@query(
    "multiplier_bootstrap_dr",
    DR + Q.components("group") + BOOT_SQL
    + f""" SELECT CAST(CASE WHEN comp <> 'overall' THEN comp END AS INTEGER) AS egt,
           {r('CASE WHEN sigma > 1e-12 THEN sigma / sqrt(n) END', 'se_bootstrap')} FROM sg, nn""",
)
def multiplier_bootstrap_dr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bootstrap_table(_seg_effects(spark, sf, covariates=("b",)), "group"), ["se_bootstrap"])


@query(
    "simultaneous_band",
    PLAIN + Q.components("dynamic") + BOOT_SQL + Q.ERRORS
    + f""" SELECT CAST(comp AS INTEGER) AS egt, {r('att', 'att')}, {r('se', 'se')}, {r('crit', 'crit')},
           {r('att - crit * se', 'lo')}, {r('att + crit * se', 'hi')} FROM agg, cr WHERE comp <> 'overall'""",
)
def simultaneous_band(spark: SparkSession, sf: str) -> DataFrame:
    agg = aggregate(_seg_effects(spark, sf), "dynamic")
    return rounded(agg.table, ["att", "se", "crit", "lo", "hi"])


# ---------------------------------------------------------------- result tables


def _re(x: str, name: str) -> str:
    return f"round_even({x}, 3) + 0.0 AS {name}"


def _summary_sql(kind: str, body: str = PLAIN) -> str:
    none = "SELECT 0 AS k, CAST(NULL AS BIGINT) AS number_units WHERE FALSE"
    counts = {
        "dynamic": none,
        "dynamic_balanced": none,
        "group": "SELECT cohort AS k, count(*) AS number_units FROM prep WHERE year = 2000 AND cohort <> 0 GROUP BY cohort",
        "calendar": "SELECT year AS k, count(*) AS number_units FROM prep WHERE cohort <> 0 AND cohort <= year GROUP BY year",
    }[kind]
    return (
        body + Q.components(kind) + BOOT_SQL + Q.ERRORS
        + f""", counts AS ({counts}),
        s AS (SELECT CAST(comp AS INTEGER) AS event_time, '{kind}' AS aggregation, {_re('att', 'estimate_att')},
              {_re('se', 'std_error')}, {_re('att - crit * se', 'lower_bound')}, {_re('att + crit * se', 'upper_bound')}
              FROM agg, cr WHERE comp <> 'overall')
        SELECT s.*, number_units, CASE WHEN lower_bound * upper_bound > 0 THEN '*' ELSE '' END AS statistical_significance
        FROM s LEFT JOIN counts ON k = event_time"""
    )


@query("aggte_summary_table", _summary_sql("group"))
def aggte_summary_table(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, "group")


@query("aggte_summary_table_calendar", _summary_sql("calendar"))
def aggte_summary_table_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, "calendar")


def _summary(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    panel, spec = seg_did(spark, sf), seg_spec()
    rows = T.summary_table(aggregate(att_gt(panel, spec), kind), prepare(panel, spec).panel)
    cols = ["estimate_att", "std_error", "lower_bound", "upper_bound"]
    return rows.withColumns({c: F.col(c) + F.lit(0.0) for c in cols}).withColumn("aggregation", F.lit(kind))


def _interval_sql(scale: int, digits: int, unit: str) -> str:
    text = lambda x: (
        f"regexp_replace(regexp_replace(printf('%.{digits}f', round_even({scale} * ({x}), {digits})), '0+$', ''), '\\.$', '')"
    )
    return f"'[' || {text(f'att - {Q.Z975} * se')} || '{unit}, ' || {text(f'att + {Q.Z975} * se')} || '{unit}]'"


@query(
    "overall_ci",
    PLAIN + Q.components("group") + Q.ERRORS
    + f""" SELECT {r('att', 'att')}, {r('se', 'se')}, {_interval_sql(1, 3, '')} AS label, {_interval_sql(100, 1, '%')} AS percent
           FROM agg WHERE comp = 'overall'""",
)
def overall_ci(spark: SparkSession, sf: str) -> DataFrame:
    agg = aggregate(_seg_effects(spark, sf, cband=False), "group")
    percent = T.overall_ci(agg, digits=1, percent=True).select("label").scalar()
    return rounded(T.overall_ci(agg).select("att", "se", "label", percent.alias("percent")), EFFECT)


def _compare_sql(label: str, name: str) -> str:
    lo, hi = f"att - {Q.Z975} * se", f"att + {Q.Z975} * se"
    return f"""{Q.ERRORS} SELECT '{label}' AS covariates, '{name}' AS aggregation, {_re(lo, 'lower_bound')},
           {_re(hi, 'upper_bound')}, CASE WHEN ({lo}) * ({hi}) > 0 THEN '*' ELSE '' END AS sig
           FROM agg WHERE comp = 'overall'"""


KINDS3 = ("group", "dynamic", "calendar")


@query(
    "overall_ci_comparison",
    " UNION ALL ".join(
        f"SELECT * FROM ({PLAIN + Q.components(k) + _compare_sql('Intercept only', T.AGGREGATION_NAMES[k])})"
        for k in KINDS3
    ),
)
def overall_ci_comparison(spark: SparkSession, sf: str) -> DataFrame:
    effects = _seg_effects(spark, sf, cband=False)
    parts = aggregate_all(effects, KINDS3)
    return stack(*[T.comparison_row(parts[k], "Intercept only") for k in KINDS3])


@query(
    "covariate_set_sweep",
    " UNION ALL ".join(
        f"SELECT * FROM ({body + Q.components(k) + _compare_sql(label, T.AGGREGATION_NAMES[k])})"
        for k in KINDS3
        for body, label in ((PLAIN, "Intercept only"), (DR, "Size"))
    ),
)
def covariate_set_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The covariate sets whose estimates have a closed form: none, and the 0/1 covariate."""
    panel = keep(seg_did(spark, sf))
    return sweep(panel, seg_spec(), [(), ("b",)], KINDS3, {"b": "Size"})


_SETS = (("x1", "x2", "area"), ("x1", "x2"), ("x1", "area"), ())
_LABELS = {"x1": "Orders", "x2": "Customers", "area": "Area"}


@query(
    "covariate_set_sweep_continuous",
    " UNION ALL ".join(
        f"""SELECT * FROM ({(Q.several(*s) if s else PLAIN) + Q.components(k)
        + _compare_sql(T.covariate_label(s, _LABELS), T.AGGREGATION_NAMES[k])})"""
        for k in KINDS3
        for s in _SETS
    ),
)
def covariate_set_sweep_continuous(spark: SparkSession, sf: str) -> DataFrame:
    """Four covariate sets in three aggregations, as one comparison table."""
    return sweep(keep(seg_did(spark, sf)), seg_spec(), _SETS, KINDS3, _LABELS)


_ALT = [("x1", 2000, True), ("x2", 2001, True), ("y", 2001, False)]


@query(
    "alternate_outcomes",
    " UNION ALL ".join(
        f"""SELECT '{y}' AS outcome, {hi} AS last_year, * FROM
        ({Q.prep(y, hi=hi, regions=reg) + Q.members() + Q.PLAIN + Q.att_select()})"""
        for y, hi, reg in _ALT
    ),
)
def alternate_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The same model for other outcomes, a longer period and all regions."""
    panel = keep(seg_did(spark, sf))
    frames = []
    for outcome, hi, regions in _ALT:
        spec = seg_spec(outcome=outcome, period=(1995, hi), only_regions=regions)
        labels = [F.lit(outcome).alias("outcome"), F.lit(hi).alias("last_year")]
        frames.append(_att(att_gt(panel, spec)).select(*labels, "*"))
    return stack(*frames)


@query(
    "fit_model",
    " UNION ALL BY NAME ".join(
        f"SELECT * FROM ({_summary_sql(k, DR)})" for k in ("dynamic", "dynamic_balanced", "group", "calendar")
    ),
)
def fit_model(spark: SparkSession, sf: str) -> DataFrame:
    """Prepare, doubly robust effects with a 0/1 covariate, all aggregations, all tables."""
    rows = fit(keep(seg_did(spark, sf)), seg_spec(covariates=("b",))).stacked()
    cols = ["estimate_att", "std_error", "lower_bound", "upper_bound"]
    return rows.withColumns({c: F.col(c) + F.lit(0.0) for c in cols})


@query(
    "fit_model_continuous",
    " UNION ALL BY NAME ".join(
        f"SELECT * FROM ({_summary_sql(k, Q.several('x1', 'b'))})" for k in ("dynamic", "dynamic_balanced", "group", "calendar")
    ),
)
def fit_model_continuous(spark: SparkSession, sf: str) -> DataFrame:
    """The same with two covariates, one of them continuous."""
    rows = fit(keep(seg_did(spark, sf)), seg_spec(covariates=("x1", "b"))).stacked()
    cols = ["estimate_att", "std_error", "lower_bound", "upper_bound"]
    return rows.withColumns({c: F.col(c) + F.lit(0.0) for c in cols})


@query(
    "fit_model_customers",
    " UNION ALL ".join(
        f"""SELECT * FROM ({Q.prep(source='cust') + Q.members() + Q.PLAIN + Q.components(k) + Q.ERRORS}
        SELECT {r('att', 'att')}, {r('se', 'se')}, {r(f'att - {Q.Z975} * se', 'lo')}, {r(f'att + {Q.Z975} * se', 'hi')},
               {_interval_sql(1, 3, '')} AS label, '{k}' AS aggregation FROM agg WHERE comp = 'overall')"""
        for k in KINDS
    ),
)
def fit_model_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Overall effects of the five aggregations on the customer panel."""
    rows = fit(keep(cust_did(spark, sf)), _cust_spec(cband=False)).overalls()
    return rounded(rows, ["att", "se", "lo", "hi"])


# ---------------------------------------------------------------- event study, sensitivity


@query(
    "twfe_single_regressor",
    Q.prep() + f""", d AS (SELECT *, CASE WHEN cohort > 0 AND cohort <= year THEN 1.0 ELSE 0.0 END AS tr FROM prep),
    w AS (SELECT y - avg(y) OVER (PARTITION BY unit_id) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS yy,
                 tr - avg(tr) OVER (PARTITION BY unit_id) - avg(tr) OVER (PARTITION BY year) + avg(tr) OVER () AS xx FROM d),
    f AS (SELECT sum(xx * yy) / sum(xx * xx) AS b, sum(xx * xx) AS sxx, sum(yy * yy) AS syy, count(*) AS n FROM w)
    SELECT 'treated' AS term, {r('b', 'coef')},
      {r('sqrt((syy - b * b * sxx) / (f.n - nn.n - 6 + 1 - 1) / sxx)', 'se')} FROM f, nn""",
)
def twfe_single_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """Static two-way regression on the treatment indicator."""
    panel = prepare(seg_did(spark, sf), seg_spec()).panel
    return rounded(E.fit_table(panel, E.twoway_fit(panel, "y", ["treated"])), ["coef", "se"])


def _event_sql(head: str, rows: str, dense: tuple[str, ...], n_periods: int, years: range) -> str:
    body = Q.twoway_sql(rows, dense, tuple(event_time_names(n_periods)), years)
    return head.replace("WITH", "WITH RECURSIVE", 1) + "," + body


_ELAPSED = "CASE WHEN start_year > 0 THEN year - start_year END AS event"


@query(
    "twfe_event_study",
    _event_sql(f"WITH {CUST_PANEL_CTE}", f"SELECT unit_id, year, {_ELAPSED}, x1, y FROM cpanel", ("x1",), 8, range(1995, 2002))
    + f" SELECT term, {r('coef', 'coef')}, {r('se', 'se')} FROM fitted",
)
def twfe_event_study(spark: SparkSession, sf: str) -> DataFrame:
    """Event study with a covariate on the unbalanced customer panel."""
    panel = cust_panel(spark, sf)
    fitted = E.event_study(panel, "y", ["x1"], n_periods=8)
    return rounded(E.fit_table(panel, fitted), ["coef", "se"])


@query(
    "event_study_table",
    _event_sql(
        Q.prep(),
        f"SELECT unit_id, year, {_ELAPSED}, x1, area, y FROM did JOIN (SELECT unit_id, year FROM prep) USING (unit_id, year)",
        ("x1", "area"),
        6,
        range(1995, 2001),
    )
    + f""" SELECT {r('coef', 'coefs')}, {r('se', 'ses')}, CAST(substr(term, 2) AS INTEGER) AS time_of_exposure,
        {r(f'coef - {Q.Z975} * se', 'lo')}, {r(f'coef + {Q.Z975} * se', 'hi')}, CAST(substr(term, 2) AS INTEGER) >= 0 AS post
        FROM fitted WHERE term NOT IN ('x1', 'area')""",
)
def event_study_table(spark: SparkSession, sf: str) -> DataFrame:
    panel = prepare(seg_did(spark, sf), seg_spec(covariates=("x1",))).panel
    fitted = E.event_study(panel, "y", ["x1", "area"], n_periods=6)
    return rounded(E.event_study_table(panel, fitted, 6), ["coefs", "ses", "lo", "hi"])


def _dynamic(spark: SparkSession, sf: str, **changes: object) -> Aggregate:
    return aggregate(_seg_effects(spark, sf, cband=False, **changes), "dynamic")


DYN = PLAIN + Q.components("dynamic")
COV = """,
ev AS (SELECT a.comp::INTEGER AS e1, b.comp::INTEGER AS e2, sum(a.v * b.v) / max(n) / max(n) AS v
       FROM infl a JOIN infl b ON a.unit_id = b.unit_id, nn
       WHERE a.comp <> 'overall' AND b.comp <> 'overall' AND a.comp <> '-1' AND b.comp <> '-1'
       GROUP BY a.comp, b.comp),
be AS (SELECT comp::INTEGER AS e, att FROM theta WHERE comp <> 'overall')"""


@query("event_cov_matrix", DYN + COV + f" SELECT e1, e2, {r('v', 'v', 9)} FROM ev")
def event_cov_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.event_cov(_dynamic(spark, sf)), ["v"], 9)


@query("event_cov_matrix_dr", DR + Q.components("dynamic") + COV + f" SELECT e1, e2, {r('v', 'v', 9)} FROM ev")
def event_cov_matrix_dr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.event_cov(_dynamic(spark, sf, covariates=("b",))), ["v"], 9)


@query(
    "sensitivity_original_ci",
    DYN + COV + f""" SELECT e, {r(f'att - {Q.Z975} * sqrt(v)', 'lo')}, {r(f'att + {Q.Z975} * sqrt(v)', 'hi')}
    FROM be JOIN ev ON e1 = e AND e2 = e WHERE e = 0""",
)
def sensitivity_original_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.original_ci(_dynamic(spark, sf), 0), ["lo", "hi"])


SMOOTH_GRID = (0.0, 0.01, 0.02, 0.05, 0.1)
RELATIVE_GRID = (0.0, 0.5, 1.0, 1.5, 2.0)


def _values(grid: tuple[float, ...]) -> str:
    return "(SELECT unnest([" + ", ".join(f"CAST({m} AS DOUBLE)" for m in grid) + "]) AS m)"


_SWEEP = f"""SELECT m, {r('est', 'estimate')}, {r('bias', 'bias')}, {r(f'est - bias - {Q.Z975} * se', 'lo')},
    {r(f'est + bias + {Q.Z975} * se', 'hi')} FROM z"""


@query(
    "sensitivity_smoothness_sweep",
    DYN + COV + f""", p AS (SELECT max(att) FILTER (e = 1) + 2 * max(att) FILTER (e = -2) AS est FROM be),
    s AS (SELECT sqrt(max(v) FILTER (e1 = 1 AND e2 = 1) + 4 * max(v) FILTER (e1 = -2 AND e2 = -2)
                 + 4 * max(v) FILTER (e1 = 1 AND e2 = -2)) AS se FROM ev),
    z AS (SELECT m, est, se, m * 2 * 3 / 2 AS bias FROM p, s, {_values(SMOOTH_GRID)})
    {_SWEEP}""",
)
def sensitivity_smoothness_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.sensitivity(_dynamic(spark, sf), "smoothness", 1, SMOOTH_GRID)
    return rounded(rows, ["estimate", "bias", "lo", "hi"])


@query(
    "sensitivity_relmag_sweep",
    DYN + COV + f""", d AS (SELECT max(abs(b.att - a.att)) AS step FROM be a JOIN be b ON b.e = a.e + 1 WHERE a.e < 0 AND b.e < 0),
    z AS (SELECT m, att AS est, sqrt(v) AS se, m * step AS bias FROM be JOIN ev ON e1 = 0 AND e2 = 0, d,
          {_values(RELATIVE_GRID)} WHERE e = 0 AND m > 0)
    {_SWEEP}""",
)
def sensitivity_relmag_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.sensitivity(_dynamic(spark, sf), "relative_magnitude", 0, RELATIVE_GRID)
    return rounded(rows, ["estimate", "bias", "lo", "hi"])
