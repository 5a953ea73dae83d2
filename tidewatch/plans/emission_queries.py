"""Queries of rate emissions in full. With a fixed gap SQL can say all but the draws; with the record's own
decorrelation time the tests walk each emission."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.emission import Config
from tidewatch.operators import emissions as em
from tidewatch.operators import rates as ra
from tidewatch.plans.count_queries import count_sql, recursive
from tidewatch.plans.event_queries import CROSSINGS_SQL, DAY, SAMPLES_SQL, UNITS_SQL, find_crossings, views
from tidewatch.plans.registry import query

CADENCE, WINDOW, REFRESH, LEAST, QUANTILE, SHAPE, RATE = 175_000.0, 1_037_000.0, 525_000.0, 2, 0.75, 2.3, 1.1
#: A fixed threshold and the chance that a crossing passes it, for emissions from the start.
LEVEL, CHANCE = 0.5, 0.3


def paths(spark, sf_dir, draws=False, **changes):
    config = Config(**{"cadence": CADENCE, "shape": SHAPE, "rate": RATE, "quantile": QUANTILE, "window": WINDOW, "least": LEAST, "refresh": REFRESH, "seed": 9, "gap": DAY} | changes)
    return em.emission_paths(views(spark, sf_dir)[0], find_crossings(spark, sf_dir), config, draws)


def paths_sql(first: int) -> str:
    """CTEs up to `led`: the chain leaders of each emission, from the window (kind w) and from the whole record (f)."""
    return f"""WITH {SAMPLES_SQL}, {UNITS_SQL}, {CROSSINGS_SQL},
rec AS (SELECT series_id, min(t) AS t0, max(t) AS t1, median(t - pt) AS dt, count(*) AS m FROM (SELECT *, lag(t) OVER (PARTITION BY series_id ORDER BY i) AS pt FROM samples) GROUP BY series_id),
ticks AS (SELECT *, t0 + k * {CADENCE} AS e FROM (SELECT *, unnest(range({first}, CAST(ceil((t1 - t0) / {CADENCE}) AS BIGINT) + 2)) AS k FROM rec WHERE m >= 3) WHERE t0 + k * {CADENCE} < t1 + {CADENCE / 2}),
asked AS (SELECT *, CASE WHEN e - {WINDOW} > t0 + 1e-6 THEN e - {WINDOW} ELSE t0 END AS ws FROM ticks),
met AS (SELECT a.series_id, a.k, c.t, c.i_detect, c.severity, c.side, c.t >= a.ws AS inside FROM asked a JOIN crossings c ON c.series_id = a.series_id AND c.t <= a.e),
seen AS (SELECT a.*, coalesce(n_all, 0) AS n_all, coalesce(n_win, 0) AS n_win FROM asked a LEFT JOIN (SELECT series_id, k, count(*) AS n_all, count(*) FILTER (inside) AS n_win FROM met GROUP BY ALL) USING (series_id, k)),
two AS (SELECT 'f' AS kind, * FROM met UNION ALL SELECT 'w', * FROM met WHERE inside),
chained AS (SELECT *, sum(fresh) OVER (PARTITION BY kind, series_id, k ORDER BY t, i_detect) AS chain FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY kind, series_id, k ORDER BY t, i_detect) > {DAY} THEN 1 ELSE 0 END AS fresh FROM two)),
led AS (SELECT kind, series_id, k, severity, side FROM (SELECT *, row_number() OVER (PARTITION BY kind, series_id, k, chain ORDER BY severity DESC, t, i_detect) AS r FROM chained) WHERE r = 1)"""


RAW = -(-LEAST * 4 // 1)
GATED = f"""{paths_sql(1)},
cut AS (SELECT kind, series_id, k, quantile_cont(severity, {QUANTILE}) AS q FROM led GROUP BY ALL),
tail AS (SELECT l.kind, l.series_id, l.k, count(*) AS n, count(*) FILTER (side > 0) AS positive, least(any_value(q), 1 - 1.1102230246251565e-16) AS threshold, any_value(q) >= 1 AS clipped, count(*) FILTER (severity > least(q, 1 - 1.1102230246251565e-16)) AS exceedances, coalesce(sum(severity - least(q, 1 - 1.1102230246251565e-16)) FILTER (severity > least(q, 1 - 1.1102230246251565e-16)), 0.0) AS excess FROM led l JOIN cut USING (kind, series_id, k) GROUP BY ALL),
open AS (SELECT * FROM seen WHERE n_all >= {RAW} AND (SELECT count(*) FROM samples s WHERE s.series_id = seen.series_id AND s.t <= seen.e) >= 3),
picked AS (SELECT o.*, CASE WHEN o.ws > o.t0 AND (o.n_win < {RAW} OR coalesce(w.exceedances, 0) < {LEAST}) THEN 'f' ELSE 'w' END AS kind FROM open o LEFT JOIN tail w ON w.kind = 'w' AND w.series_id = o.series_id AND w.k = o.k),
made AS (SELECT p.series_id, p.e AS t, greatest(p.e - CASE WHEN p.kind = 'w' THEN p.ws ELSE p.t0 END, p.dt) AS exposure, l.n, l.exceedances, l.positive, l.n - l.positive AS negative, l.threshold, exceedances / n * pow(({RATE} + excess) / ({RATE} + excess + 1 - threshold), {SHAPE} + exceedances) AS p_critical,
  concat_ws(',', CASE WHEN p.kind = 'f' THEN 'full_history' END, CASE WHEN exceedances < 3 THEN 'prior_dominated' END, CASE WHEN clipped THEN 'threshold_clipped' END) AS flags FROM picked p JOIN tail l ON l.kind = p.kind AND l.series_id = p.series_id AND l.k = p.k WHERE l.exceedances >= {LEAST})"""


@query(f"{GATED} SELECT series_id, t, n / exposure * p_critical * 3600 AS rate, exposure, n, exceedances, positive, negative, threshold, p_critical, flags FROM made", "t rate exposure threshold p_critical")
def gated_emissions(spark, sf_dir):
    return paths(spark, sf_dir).select("series_id", "t", "rate", "exposure", "n", "exceedances", "positive", "negative", "threshold", "p_critical", F.concat_ws(",", "flags").alias("flags"))


EARLY = f"""{paths_sql(0)},
tail AS (SELECT kind, series_id, k, count(*) AS n, count(*) FILTER (side > 0) AS positive, count(*) FILTER (severity > {LEVEL}) AS exceedances, coalesce(sum(severity - {LEVEL}) FILTER (severity > {LEVEL}), 0.0) AS excess FROM led GROUP BY ALL),
picked AS (SELECT *, CASE WHEN ws > t0 AND n_win < {RAW} THEN 'f' ELSE 'w' END AS kind FROM seen),
made AS (SELECT p.series_id, p.k, p.e AS t, p.kind, greatest(p.e - CASE WHEN p.kind = 'w' THEN p.ws ELSE p.t0 END, p.dt) AS exposure, coalesce(l.n, 0) AS n, coalesce(exceedances, 0) AS exceedances, coalesce(positive, 0) AS positive, coalesce(l.n - positive, 0) AS negative, {CHANCE} * pow(({RATE} + coalesce(excess, 0.0)) / ({RATE} + coalesce(excess, 0.0) + 1 - {LEVEL}), {SHAPE} + coalesce(exceedances, 0)) AS p_critical
  FROM picked p LEFT JOIN tail l ON l.kind = p.kind AND l.series_id = p.series_id AND l.k = p.k),
kinds AS (SELECT DISTINCT n AS key, n AS k, 0 AS n FROM made), {count_sql('kinds', 'garwood')},
held AS (SELECT *, k - k % 3 AS k0 FROM made),
bound AS (SELECT m.series_id, m.k, m.t AS drawn_at, g.lo * m.p_critical * 3600 / m.exposure AS lo, g.hi * m.p_critical * 3600 / m.exposure AS hi FROM made m JOIN garwood g ON g.key = m.n)"""


@query(recursive(f"{EARLY} SELECT h.series_id, t, n / exposure * p_critical * 3600 AS rate, lo, hi, exposure, n, exceedances, positive, negative, p_critical, concat_ws(',', CASE WHEN kind = 'f' THEN 'full_history' END, CASE WHEN exceedances < 3 THEN 'prior_dominated' END) AS flags, drawn_at FROM held h JOIN bound b ON b.series_id = h.series_id AND b.k = h.k0"), "t rate lo hi exposure p_critical drawn_at")
def emissions_from_start(spark, sf_dir):
    out = paths(spark, sf_dir, gated=False, threshold=LEVEL, exceedance=CHANCE)
    return out.select("series_id", "t", "rate", "lo", "hi", "exposure", "n", "exceedances", "positive", "negative", "p_critical", F.concat_ws(",", "flags").alias("flags"), "drawn_at")


@query()
def emissions_by_own_gap(spark, sf_dir):
    """Chained by the decorrelation time of each emission's history, with 512 draws summed over the record: the count and its interval."""
    out = paths(spark, sf_dir, draws=True, gap=None)
    u = views(spark, sf_dir)[1]
    per_second = out.select("series_id", "t", (F.col("rate") / 3600).alias("rate"), F.transform("draws", lambda v: v / 3600).alias("draws"))
    point = ra.integrate_rate(per_second, u)
    drawn = ra.integrate_draws(per_second, u).groupBy("series_id").agg(F.percentile("expected", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return point.join(drawn, "series_id").select("series_id", "expected", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
