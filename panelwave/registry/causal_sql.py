"""SQL for the estimation queries, written unit by unit from the textbook formulas.

It shares nothing with the Spark plans: influence values are formed per unit and cell,
and weights that are estimated enter through their own per-unit terms.
"""

from __future__ import annotations

from panelwave.plans.moments import PHILOX_MULTIPLIER, PHILOX_ROUNDS, PHILOX_STEP
from panelwave.registry.catalog import r
from panelwave.registry.panels import CUST_PANEL_CTE, SEG_DID_CTE

Z975 = 1.959963984540054


def prep(
    outcome: str = "y", covariate: str | None = None, hi: int = 2000, regions: bool = True, source: str = "seg"
) -> str:
    """Complete units of the window as ``prep(unit_id, cohort, year, y, x)`` and ``nn(n)``."""
    head, name = (SEG_DID_CTE, "did") if source == "seg" else (CUST_PANEL_CTE, "cdid")
    years = hi - 1995 + 1
    keep = f"AND region IN (SELECT region FROM {name} WHERE treated = 1)" if regions else ""
    return f"""WITH {head},
prep AS (
  SELECT unit_id, CASE WHEN start_year BETWEEN 1995 AND {hi} THEN start_year ELSE 0 END AS cohort, year,
         {outcome} AS y, {covariate or '0'} AS x
  FROM {name} WHERE year BETWEEN 1995 AND {hi} {keep} AND unit_id IN (
    SELECT unit_id FROM {name} WHERE year BETWEEN 1995 AND {hi} AND {outcome} IS NOT NULL
    GROUP BY unit_id HAVING count(*) = {years})),
nn AS (SELECT count(DISTINCT unit_id) AS n FROM prep),
pgs AS (SELECT cohort, count(DISTINCT unit_id) AS n_g, count(DISTINCT unit_id) / max(n) AS pg
        FROM prep, nn GROUP BY cohort)"""


def members(control: str = "notyettreated", base: str = "universal") -> str:
    """``memb(unit_id, cohort, g, t, b, d, dy, x)``: units of each cell."""
    b = "g.cohort - 1" if base == "universal" else "CASE WHEN p.year >= g.cohort THEN g.cohort - 1 ELSE p.year - 1 END"
    later = f"OR p.cohort > greatest(p.year, {b})" if control == "notyettreated" else ""
    return f""",
memb AS (
  SELECT p.unit_id, p.cohort, g.cohort AS g, p.year AS t, q.year AS b,
         CASE WHEN p.cohort = g.cohort THEN 1 ELSE 0 END AS d, p.y - q.y AS dy, q.x AS x
  FROM prep p JOIN (SELECT cohort FROM pgs WHERE cohort > 1995) g
    ON p.cohort = g.cohort OR p.cohort = 0 {later}
  JOIN prep q ON q.unit_id = p.unit_id AND q.year = {b})"""


PLAIN = """,
st AS (SELECT g, t, any_value(b) AS b, sum(d) AS n1, sum(1 - d) AS n0, avg(dy) FILTER (d = 1) AS m1,
         avg(dy) FILTER (d = 0) AS m0 FROM memb GROUP BY g, t),
psi AS (SELECT unit_id, cohort, memb.g, memb.t, n * (d * (dy - m1) / n1 - (1 - d) * (dy - m0) / n0) AS psi
        FROM memb JOIN st USING (g, t), nn),
est AS (SELECT g, t, b, m1 - m0 AS att, n1, n0 FROM st)"""

# One continuous covariate, regression only.
REG = """,
st AS (SELECT g, t, any_value(b) AS b, sum(d) AS n1, sum(1 - d) AS n0, sum(x) FILTER (d = 1) AS tx,
         sum(x) FILTER (d = 0) AS sx, sum(x * x) FILTER (d = 0) AS sxx,
         regr_slope(dy, x) FILTER (d = 0) AS b1, regr_intercept(dy, x) FILTER (d = 0) AS b0
       FROM memb WHERE t <> b GROUP BY g, t),
res AS (SELECT memb.*, n1, n0, dy - b0 - b1 * x AS e, (sxx * n1 - sx * tx) / (n0 * sxx - sx * sx) AS a0,
          (n0 * tx - sx * n1) / (n0 * sxx - sx * sx) AS a1 FROM memb JOIN st USING (g, t)),
eta AS (SELECT g, t, avg(e) FILTER (d = 1) AS att FROM res GROUP BY g, t),
psi AS (SELECT unit_id, cohort, res.g, res.t, n * (d * (e - att) - (1 - d) * e * (a0 + a1 * x)) / n1 AS psi
        FROM res JOIN eta USING (g, t), nn),
est AS (SELECT g, t, b, att, n1, n0 FROM st JOIN eta USING (g, t))"""

_STRATA = """,
sx AS (SELECT g, t, x, sum(d) AS n1s, sum(1 - d) AS n0s, sum(d) / count(*) AS p,
         sum(d) / sum(1 - d) AS odds, avg(dy) FILTER (d = 0) AS ms FROM memb WHERE t <> b GROUP BY g, t, x),
st AS (SELECT g, t, any_value(b) AS b, sum(d) AS n1, sum(1 - d) AS n0, avg(dy) FILTER (d = 1) AS m1
       FROM memb WHERE t <> b GROUP BY g, t),
ctl AS (SELECT g, t, sum(n0s * odds) AS w, sum(n0s * odds * ms) / sum(n0s * odds) AS eta_c FROM sx GROUP BY g, t)"""

# One 0/1 covariate: the logistic fit is the share per stratum.
IPW01 = _STRATA + """,
psi AS (SELECT unit_id, cohort, memb.g, memb.t, n * (d * (dy - m1) / n1
          - ((1 - d) * odds * (dy - eta_c) + (d - p) * n0s * odds * (ms - eta_c) / ((n0s + n1s) * p * (1 - p))) / w) AS psi
        FROM memb JOIN st USING (g, t) JOIN ctl USING (g, t) JOIN sx ON sx.g = memb.g AND sx.t = memb.t AND sx.x = memb.x, nn),
est AS (SELECT g, t, b, m1 - eta_c AS att, n1, n0 FROM st JOIN ctl USING (g, t))"""

# The same for the doubly robust form, where the regression is the stratum mean.
DR01 = _STRATA + """,
eta AS (SELECT g, t, avg(dy - ms) FILTER (d = 1) AS att FROM memb JOIN sx USING (g, t, x) GROUP BY g, t),
psi AS (SELECT unit_id, cohort, memb.g, memb.t,
          n * (d * (dy - ms - att) - (1 - d) * (dy - ms) * odds) / n1 AS psi
        FROM memb JOIN st USING (g, t) JOIN eta USING (g, t)
        JOIN sx ON sx.g = memb.g AND sx.t = memb.t AND sx.x = memb.x, nn),
est AS (SELECT g, t, b, att, n1, n0 FROM st JOIN eta USING (g, t)
        UNION ALL SELECT DISTINCT g, t, b, 0, NULL, NULL FROM memb WHERE t = b)"""


def doubly_robust(steps: int = 12) -> str:
    """One continuous covariate, doubly robust: Newton steps of the logit one after the other."""
    fit = """,
l0 AS (SELECT g, t, ln(sum(d) / sum(1 - d)) AS a, 0.0 AS c FROM memb WHERE t <> b GROUP BY g, t)"""
    for k in range(steps):
        fit += f""",
l{k + 1} AS (SELECT g, t, a + (h11 * s0 - h01 * s1) / (h00 * h11 - h01 * h01) AS a,
         c + (h00 * s1 - h01 * s0) / (h00 * h11 - h01 * h01) AS c
       FROM (SELECT g, t, any_value(a) AS a, any_value(c) AS c, sum(d - p) AS s0, sum((d - p) * x) AS s1,
               sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
             FROM (SELECT memb.*, a, c, 1 / (1 + exp(-(a + c * x))) AS p FROM memb JOIN l{k} USING (g, t) WHERE memb.t <> memb.b)
             GROUP BY g, t))"""
    return fit + f""",
reg AS (SELECT g, t, any_value(b) AS b, sum(d) AS n1, sum(1 - d) AS n0, sum(x) FILTER (d = 1) AS tx,
          sum(x) FILTER (d = 0) AS sx, sum(x * x) FILTER (d = 0) AS sxx,
          regr_slope(dy, x) FILTER (d = 0) AS b1, regr_intercept(dy, x) FILTER (d = 0) AS b0
        FROM memb WHERE t <> b GROUP BY g, t),
res AS (SELECT u.*, n1, n0, tx, sx, sxx, dy - b0 - b1 * x AS e, (1 - d) * p / (1 - p) AS w
        FROM (SELECT memb.*, 1 / (1 + exp(-(a + c * x))) AS p FROM memb JOIN l{steps} USING (g, t) WHERE memb.t <> memb.b) u
        JOIN reg USING (g, t)),
eta AS (SELECT g, t, avg(e) FILTER (d = 1) AS et, sum(w * e) / sum(w) AS ec, sum(w) AS ws, sum(w * x) AS wx,
          sum(w * e) AS we, sum(w * e * x) AS wex, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01,
          sum(p * (1 - p) * x * x) AS h11, any_value(n0 * sxx - sx * sx) AS det FROM res GROUP BY g, t),
psi AS (SELECT unit_id, cohort, res.g, res.t,
          n * ((d * (e - et) - (1 - d) * e * ((sxx * n1 - sx * tx) / det + (n0 * tx - sx * n1) / det * x)) / n1
            - (w * (e - ec)
               + (d - p) * ((h11 * (we - ec * ws) - h01 * (wex - ec * wx)) + (h00 * (wex - ec * wx) - h01 * (we - ec * ws)) * x)
                 / (h00 * h11 - h01 * h01)
               - (1 - d) * e * ((sxx * ws - sx * wx) / det + (n0 * wx - sx * ws) / det * x)) / ws) AS psi
        FROM res JOIN eta USING (g, t), nn),
est AS (SELECT g, t, b, et - ec AS att, n1, n0 FROM reg JOIN eta USING (g, t))"""


def att_select() -> str:
    """Effects of all cells, the reference cells t = b with their counts among them."""
    return f""",
cell AS (SELECT g, t, b, att, n1, n0 FROM est WHERE t <> b
         UNION ALL SELECT g, t, any_value(b), 0, sum(d), sum(1 - d) FROM memb WHERE t = b GROUP BY g, t)
SELECT est.g, est.t, {r('att', 'att')},
       {r('CASE WHEN est.t <> est.b THEN se END', 'se')}, CAST(n1 AS BIGINT) AS n_treated, CAST(n0 AS BIGINT) AS n_control
FROM cell est LEFT JOIN (SELECT g, t, sqrt(sum(psi * psi)) / max(n) AS se FROM psi, nn GROUP BY g, t) s
  ON s.g = est.g AND s.t = est.t"""


_COND = {
    "simple": "t >= g",
    "dynamic": "TRUE",
    "dynamic_balanced": "2000 - g >= {e} AND t - g <= {e} AND t - g >= {e} - 5",
    "group": "t >= g",
    "calendar": "t >= g",
}
_COMP = {
    "simple": "'overall'",
    "dynamic": "CAST(t - g AS VARCHAR)",
    "dynamic_balanced": "CAST(t - g AS VARCHAR)",
    "group": "CAST(g AS VARCHAR)",
    "calendar": "CAST(t AS VARCHAR)",
}


def components(kind: str, e: int = 1) -> str:
    """``theta(comp, att)`` and ``infl(unit_id, comp, v)``, the overall effect included."""
    out = f""",
comp0 AS (SELECT est.g, est.t, att, pg, {_COMP[kind]} AS comp FROM est JOIN pgs ON pgs.cohort = est.g
          WHERE {_COND[kind].format(e=e)}),
tot AS (SELECT comp, sum(pg) AS s, sum(pg * att) / sum(pg) AS theta FROM comp0 GROUP BY comp),
m AS (SELECT comp, g, count(*) AS m FROM comp0 GROUP BY comp, g),
people AS (SELECT DISTINCT unit_id, cohort FROM prep)"""
    if kind == "group":
        return out + """,
th AS (SELECT comp, g, any_value(pg) AS pg, avg(att) AS theta FROM comp0 GROUP BY comp, g),
tg AS (SELECT sum(pg) AS s, sum(pg * theta) / sum(pg) AS theta FROM th),
infl0 AS (SELECT u.unit_id, u.cohort, th.comp, th.g, th.pg, th.theta, avg(coalesce(psi, 0)) AS v
          FROM people u CROSS JOIN comp0 c JOIN th ON th.comp = c.comp
          LEFT JOIN psi ON psi.unit_id = u.unit_id AND psi.g = c.g AND psi.t = c.t
          GROUP BY u.unit_id, u.cohort, th.comp, th.g, th.pg, th.theta),
infl AS (SELECT unit_id, comp, v FROM infl0
         UNION ALL
         SELECT unit_id, 'overall', sum(infl0.pg / s * v) + sum(infl0.theta * (
           (CASE WHEN cohort = g THEN 1 ELSE 0 END - infl0.pg) / s - infl0.pg * (CASE WHEN known THEN 1 ELSE 0 END - s) / (s * s)))
         FROM (SELECT *, cohort IN (SELECT g FROM th) AS known FROM infl0) infl0, tg GROUP BY unit_id),
theta AS (SELECT comp, theta AS att FROM th UNION ALL SELECT 'overall', theta FROM tg)"""
    out += """,
infl0 AS (SELECT u.unit_id, c.comp,
            sum(c.pg / tot.s * coalesce(psi, 0)) + sum(c.att * (
              (CASE WHEN u.cohort = c.g THEN 1 ELSE 0 END - c.pg) / tot.s
              - c.pg * (coalesce(m.m, 0) - tot.s) / (tot.s * tot.s))) AS v
          FROM people u CROSS JOIN comp0 c JOIN tot ON tot.comp = c.comp
          LEFT JOIN m ON m.comp = c.comp AND m.g = u.cohort
          LEFT JOIN psi ON psi.unit_id = u.unit_id AND psi.g = c.g AND psi.t = c.t
          GROUP BY u.unit_id, c.comp)"""
    if kind == "simple":
        return out + """,
infl AS (SELECT * FROM infl0), theta AS (SELECT comp, theta AS att FROM tot)"""
    post = "TRUE" if kind == "calendar" else "CAST(comp AS INTEGER) >= 0"
    return out + f""",
infl AS (SELECT * FROM infl0 UNION ALL
         SELECT unit_id, 'overall', avg(v) FROM infl0 WHERE {post} GROUP BY unit_id),
theta AS (SELECT comp, theta AS att FROM tot UNION ALL SELECT 'overall', avg(theta) FROM tot WHERE {post})"""


ERRORS = """,
err AS (SELECT comp, sqrt(sum(v * v)) / max(n) AS se0 FROM infl, nn GROUP BY comp),
agg AS (SELECT theta.comp, att, CASE WHEN se0 > 1e-10 THEN se0 END AS se FROM theta JOIN err ON err.comp = theta.comp)"""


def aggregate_select(kind: str) -> str:
    """Rows (egt, att, se, lo, hi) with normal bounds; egt is NULL for the overall effect."""
    egt = "CAST(CASE WHEN comp <> 'overall' THEN comp END AS INTEGER)"
    return f"""{ERRORS}
SELECT {egt} AS egt, {r('att', 'att')}, {r('se', 'se')}, {r(f'att - {Z975} * se', 'lo')},
       {r(f'att + {Z975} * se', 'hi')} FROM agg"""


def multipliers_sql(seed: int, draws: int, units: str) -> str:
    """DuckDB SQL for (unit_id, draw, v): the same multipliers for the units of a table."""
    big = lambda x: f"CAST({x} AS UBIGINT)"
    digits = f"md5('{seed}|' || unit_id)"
    bits = [big(f"'0x' || substr({digits}, {a}, 8)") for a in (1, 9)]
    text = f"""SELECT unit_id, b, {big('b')} AS l, {bits[1]} AS r, {bits[0]} AS k
        FROM {units} CROSS JOIN (SELECT range AS b FROM range(0, {(draws + 1) // 2}))"""
    for _ in range(PHILOX_ROUNDS):
        text = f"""SELECT unit_id, b, xor(xor(({big(PHILOX_MULTIPLIER)} * l) >> 32, k), r) AS l,
        ({big(PHILOX_MULTIPLIER)} * l) & {big(0xFFFFFFFF)} AS r, (k + {big(PHILOX_STEP)}) & {big(0xFFFFFFFF)} AS k FROM ({text})"""
    low = "u / 4294967296.0 < (sqrt(5.0) + 1) / (2 * sqrt(5.0))"
    return f"""SELECT unit_id, draw, CASE WHEN {low} THEN (1 - sqrt(5.0)) / 2 ELSE (1 + sqrt(5.0)) / 2 END AS v
        FROM (SELECT unit_id, 2 * b + 1 AS draw, l AS u FROM ({text}) UNION ALL SELECT unit_id, 2 * b + 2, r FROM ({text}))
        WHERE draw <= {draws}"""


def draws(n_draws: int, seed: int) -> str:
    """``rr(draw, comp, r)`` and the bootstrap scale ``sg(comp, sigma)``."""
    return f""",
vv AS ({multipliers_sql(seed, n_draws, 'people')}),
rr AS (SELECT draw, comp, sum(vv.v * infl.v) / sqrt(max(n)) AS r FROM vv JOIN infl USING (unit_id), nn GROUP BY draw, comp),
sg AS (SELECT comp, (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) / 1.3489795003921634 AS sigma FROM rr GROUP BY comp),
mx AS (SELECT draw, max(abs(r / sigma)) AS m FROM rr JOIN sg USING (comp)
       WHERE sigma > 1e-12 AND comp <> 'overall' GROUP BY draw),
cr AS (SELECT quantile_cont(m, 0.95) AS crit FROM mx)"""


# ---------------------------------------------------------------- small linear systems


def swept(matrix: str, pivots: int) -> str:
    """SQL for a symmetric matrix (list of rows) swept on its first ``pivots`` places.

    Afterwards the block of the pivots is minus the inverse, their columns to the right hold
    the solutions and the rest is what the pivots leave unexplained.
    """
    order = ", ".join(f"[[{k}.0]]" for k in range(1, pivots + 1))
    k = "CAST(e[1][1] AS BIGINT)"
    cell = f"""CASE WHEN i = {k} AND j = {k} THEN -1 / v WHEN i = {k} OR j = {k} THEN v / m[{k}][{k}]
      ELSE v - m[i][{k}] * m[{k}][j] / m[{k}][{k}] END"""
    return f"list_reduce([{matrix}, {order}], lambda m, e: list_transform(m, lambda row, i: list_transform(row, lambda v, j: {cell})))"


def _matrix(k: int, cell: str, right: str) -> str:
    """Rows of the sums ``cell(i, j)`` bordered by the sums ``right(i)``."""
    rows = [", ".join([*[cell.format(i=min(i, j), j=max(i, j)) for j in range(1, k + 1)], right.format(i=i)]) for i in range(1, k + 1)]
    rows.append(", ".join([*[right.format(i=i) for i in range(1, k + 1)], "0.0"]))
    return "[" + ", ".join(f"[{row}]" for row in rows) + "]"


def doubly_robust_many(k: int, steps: int = 12) -> str:
    """Several covariates, doubly robust.  ``memb.x`` is the list [1, x1, ...] of length ``k``; the
    Newton steps of the logit follow one after the other, each solving a k x k system."""
    pick = lambda m, i: f"{m}[{i}][{k + 1}]"
    vector = lambda m: "[" + ", ".join(pick(m, i) for i in range(1, k + 1)) + "]"
    upper = [(i, j) for i in range(1, k + 1) for j in range(i, k + 1)]
    hess = ", ".join(f"sum(p * (1 - p) * x[{i}] * x[{j}]) AS h{i}_{j}" for i, j in upper)
    grad = ", ".join(f"sum((d - p) * x[{i}]) AS s{i}" for i in range(1, k + 1))
    zeros = ", ".join(["0.0"] * (k - 1))
    logit = lambda c: f"1 / (1 + exp(-list_dot_product(CAST({c} AS DOUBLE[]), CAST(x AS DOUBLE[]))))"
    out = f""",
l0 AS (SELECT g, t, [ln(sum(d) / sum(1 - d)), {zeros}] AS c FROM memb WHERE t <> b GROUP BY g, t)"""
    for n in range(steps):
        out += f""",
l{n + 1} AS (SELECT g, t, list_transform(c, lambda v, i: v + m[i][{k + 1}]) AS c FROM (
  SELECT g, t, c, {swept(_matrix(k, 'h{i}_{j}', 's{i}'), k)} AS m FROM (
    SELECT g, t, any_value(c) AS c, {hess}, {grad}
    FROM (SELECT memb.*, c, {logit('c')} AS p FROM memb JOIN l{n} USING (g, t) WHERE memb.t <> memb.b) GROUP BY g, t)))"""
    xx = ", ".join(f"sum(x[{i}] * x[{j}]) FILTER (d = 0) AS a{i}_{j}" for i, j in upper)
    xy = ", ".join(f"sum(x[{i}] * dy) FILTER (d = 0) AS y{i}" for i in range(1, k + 1))
    tx = ", ".join(f"sum(x[{i}]) FILTER (d = 1) AS t{i}" for i in range(1, k + 1))
    dot = lambda a: f"list_dot_product(CAST({a} AS DOUBLE[]), CAST(x AS DOUBLE[]))"
    wsums = ", ".join(f"sum(w * x[{i}]) AS wx{i}, sum(w * e * x[{i}]) AS wex{i}" for i in range(1, k + 1))
    solve = lambda cell, right: vector(f"({swept(_matrix(k, cell, right), k)})")
    return out + f""",
reg AS (SELECT g, t, b, n1, n0, {solve('a{i}_{j}', 'y{i}')} AS beta, {solve('a{i}_{j}', 't{i}')} AS tc,
          {', '.join(f'a{i}_{j}' for i, j in upper)}
        FROM (SELECT g, t, any_value(b) AS b, sum(d) AS n1, sum(1 - d) AS n0, {xx}, {xy}, {tx}
              FROM memb WHERE t <> b GROUP BY g, t)),
res AS (SELECT u.*, n1, n0, tc, dy - {dot('beta')} AS e, (1 - d) * p / (1 - p) AS w
        FROM (SELECT memb.*, {logit('c')} AS p FROM memb JOIN l{steps} USING (g, t) WHERE memb.t <> memb.b) u
        JOIN reg USING (g, t)),
eta0 AS (SELECT g, t, avg(e) FILTER (d = 1) AS et, sum(w * e) / sum(w) AS ec, sum(w) AS ws, {wsums}, {hess} FROM res GROUP BY g, t),
eta AS (SELECT g, t, et, ec, ws, {solve('h{i}_{j}', '(wex{i} - ec * wx{i})')} AS bp, {solve('a{i}_{j}', 'wx{i}')} AS ac
        FROM eta0 JOIN reg USING (g, t)),
psi AS (SELECT unit_id, cohort, res.g, res.t,
          n * ((d * (e - et) - (1 - d) * e * {dot('tc')}) / n1
               - (w * (e - ec) + (d - p) * {dot('bp')} - (1 - d) * e * {dot('ac')}) / ws) AS psi
        FROM res JOIN eta USING (g, t), nn),
est AS (SELECT g, t, b, et - ec AS att, n1, n0 FROM reg JOIN eta USING (g, t)
        UNION ALL SELECT DISTINCT g, t, b, 0, NULL, NULL FROM memb WHERE t = b)"""


def several(*covariates: str) -> str:
    """CTEs of the doubly robust estimate with these covariates."""
    return prep(covariate=f"[1.0, {', '.join(covariates)}]") + members() + doubly_robust_many(len(covariates) + 1)


def twoway_sql(rows: str, dense: tuple[str, ...], levels: tuple[int, ...], years: range) -> str:
    """CTEs ``fitted(term, coef, se)``: least squares of y on event-time dummies and dense columns
    with unit and year effects, from a table (unit_id, year, event, y and the dense columns).

    Everything is demeaned by unit; the normal matrix of (year dummies, event dummies, dense, y)
    is swept column by column in a recursion, leaving out columns that the earlier ones explain.
    """
    values = [f"CASE WHEN year = {t} THEN 1.0 ELSE 0.0 END" for t in years[1:]]
    values += [f"CASE WHEN event = {level} THEN 1.0 ELSE 0.0 END" for level in levels]
    values += [f"CAST({c} AS DOUBLE)" for c in (*dense, "y")]
    first, p = len(years) - 1, len(values) - 1
    terms = [f"e{level}" for level in levels] + list(dense)
    cell = """CASE WHEN i = k AND j = k THEN -1 / v WHEN i = k OR j = k THEN v / m[k][k]
        ELSE v - m[i][k] * m[k][j] / m[k][k] END"""
    return f"""
z AS (SELECT unit_id, year, unnest([{', '.join(values)}]) AS v, unnest(range(1, {p + 2})) AS i FROM ({rows})),
w AS (SELECT unit_id, year, i, v - avg(v) OVER (PARTITION BY unit_id, i) AS v FROM z),
cross_sums AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS s FROM w a JOIN w b USING (unit_id, year) GROUP BY a.i, b.i),
size AS (SELECT count(*) AS n, count(DISTINCT unit_id) AS units FROM (SELECT DISTINCT unit_id, year FROM z)),
start AS (SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS line FROM cross_sums GROUP BY i)),
sweeps AS (SELECT 1 AS k, m, m AS whole, 0 AS used, CAST([] AS BOOLEAN[]) AS kept FROM start
  UNION ALL
  SELECT k + 1, CASE WHEN fine THEN list_transform(m, lambda line, i: list_transform(line, lambda v, j: {cell})) ELSE m END,
         whole, used + CAST(fine AS INT), list_append(kept, fine)
  FROM (SELECT *, whole[k][k] > 1e-9 AND m[k][k] > 1e-8 * whole[k][k] AS fine FROM sweeps WHERE k <= {p})),
fitted AS (SELECT unnest([{', '.join(f"'{t}'" for t in terms)}]) AS term,
    unnest(list_transform(range({first + 1}, {p + 1}), lambda i: CASE WHEN kept[i] THEN m[i][{p + 1}] END)) AS coef,
    unnest(list_transform(range({first + 1}, {p + 1}), lambda i: CASE WHEN kept[i]
      THEN sqrt(greatest(m[{p + 1}][{p + 1}] / (n - units - used) * -m[i][i], 0)) END)) AS se
  FROM sweeps, size WHERE k = {p + 1})"""
