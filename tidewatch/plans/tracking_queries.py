"""Queries of bootstrapped tracking and metric vectors."""

from __future__ import annotations

from tidewatch.operators import counts as co
from tidewatch.plans.count_queries import ERROR_SQL, P_SQL, scored
from tidewatch.plans.event_queries import AUC_SQL, DAY, DRAWS_SQL, views
from tidewatch.plans.rate_queries import ASOF_SQL, EMISSIONS_SQL, GRID, WITH, paths
from tidewatch.plans.registry import query

MOST = 3


def _correlated(k: int) -> str:
    a, b = (f"hazard[{1 + max(0, -k)}:{len(GRID) - max(0, k)}]", f"rate[{1 + max(0, k)}:{len(GRID) - max(0, -k)}]")
    dev = lambda v: f"list_transform({v}, lambda x: x - list_avg({v}))"
    dot = lambda u, v: f"list_dot_product({u}, {v})"
    return f"{{'c': CASE WHEN {dot(dev(a), dev(a))} > 1e-24 AND {dot(dev(b), dev(b))} > 1e-24 THEN round({dot(dev(a), dev(b))} / sqrt({dot(dev(a), dev(a))} * {dot(dev(b), dev(b))}), 9) END, 'k': {-k}}}"


@query(f"""{WITH}, {EMISSIONS_SQL}, {ASOF_SQL}, {DRAWS_SQL.format(seed=43, replicates=1000)}, times AS (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS t),
own AS (SELECT u.series_id, g.t, p.rate * 3600 AS rate, coalesce(exp(-(g.t - t_event) * (g.t - t_event) / (2e0 * {DAY} * {DAY})) / ({DAY} * 2.5066282746310002e0), 0.0) * 3600 AS d, CASE WHEN record_end >= g.t AND coalesce(t_event, 'infinity'::DOUBLE) >= g.t THEN 1 ELSE 0 END AS dn FROM units u CROSS JOIN times g LEFT JOIN paths p ON p.series_id = u.series_id AND p.t = g.t),
w AS (SELECT replicate, series_id, times FROM draws UNION ALL SELECT -1, series_id, 1 FROM units),
s AS (SELECT replicate, t, coalesce(sum(rate * times) / nullif(sum(times) FILTER (rate IS NOT NULL), 0), 0.0) AS rate, CASE WHEN sum(dn * times) > 0 THEN sum(d * times) / sum(dn * times) ELSE 0.0 END AS hazard FROM w JOIN own USING (series_id) GROUP BY ALL),
l AS (SELECT replicate, list(rate ORDER BY t) AS rate, list(hazard ORDER BY t) AS hazard, avg(rate - hazard) AS bias FROM s GROUP BY replicate),
e AS (SELECT replicate, bias, list_max(list_filter([{', '.join(_correlated(k) for k in range(-MOST, MOST + 1))}], lambda v: v.c IS NOT NULL)) AS best FROM l),
f AS (SELECT replicate, bias, coalesce(-best.k, 0)::DOUBLE AS lag, best IS NOT NULL AS estimable FROM e)
SELECT max(lag) FILTER (replicate < 0) AS lag, max(bias) FILTER (replicate < 0) AS bias, bool_or(estimable) FILTER (replicate < 0) AS estimable, quantile_cont(lag, 0.025) FILTER (replicate >= 0) AS lag_lo, quantile_cont(lag, 0.975) FILTER (replicate >= 0) AS lag_hi,
  quantile_cont(bias, 0.025) FILTER (replicate >= 0) AS bias_lo, quantile_cont(bias, 0.975) FILTER (replicate >= 0) AS bias_hi, count(*) FILTER (replicate >= 0) AS replicates FROM f""", "lag bias lag_lo lag_hi bias_lo bias_hi")
def bootstrap_tracking(spark, sf_dir):
    hourly = paths(spark, sf_dir).selectExpr("series_id", "t", "rate * 3600 AS rate")
    return co.bootstrap_tracking(hourly, views(spark, sf_dir)[1], list(GRID), DAY, MOST, 1000, 43, scale=3600.0)


@query(f"""{P_SQL}, {DRAWS_SQL.format(seed=47, replicates=1000)}, b AS (SELECT replicate, bin, CAST(sum(times) AS DOUBLE) AS n, sum(p * times) AS sp, sum(label * times) AS sy, sum((p - label) * (p - label) * times) AS sq FROM binned JOIN draws USING (series_id) GROUP BY 1, 2),
r AS (SELECT replicate, sum(abs(sp - sy)) / sum(n) AS error, sum(sq) / sum(n) AS brier FROM b GROUP BY 1),
summed AS (SELECT replicate, p AS s, sum(CASE WHEN label = 1 THEN times ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN times ELSE 0 END) AS neg FROM p0 JOIN draws USING (series_id) GROUP BY 1, 2),
a AS (SELECT replicate, CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM summed) GROUP BY replicate HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT 'auc' AS metric, (SELECT CAST(auc AS DOUBLE) FROM ({AUC_SQL.format(score='p', label='label', rows='p0')})) AS estimate, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi, count(*) AS replicates FROM a
UNION ALL SELECT 'brier', (SELECT avg((p - label) * (p - label)) FROM p0), quantile_cont(brier, 0.025), quantile_cont(brier, 0.975), count(*) FROM r
UNION ALL SELECT 'reliability_error', {ERROR_SQL}, quantile_cont(error, 0.025), quantile_cont(error, 0.975), count(*) FROM r""", "estimate lo hi")
def bootstrap_vector(spark, sf_dir):
    rows, edges = scored(spark, sf_dir)
    return co.bootstrap_vector(rows, views(spark, sf_dir)[1], "p", "label", edges, 1000, 47)
