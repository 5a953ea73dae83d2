"""Queries that put operators together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import events as ev
from tidewatch.operators import metrics as me
from tidewatch.operators import rates as ra
from tidewatch.operators import scores as sc
from tidewatch.operators import studies as st
from tidewatch.plans.event_queries import ALARM, CURVE_SQL, DAY, DEBOUNCE, GAP, HORIZON, LABELS_SQL, METRIC_DOUBLES, REFRACTORY, RUNS_SQL, SAMPLES_SQL, SCORES_SQL, UNITS_SQL, WITH_BASE, WITH_CROSSINGS, contributions_sql, curve, episodes_sql, find_crossings, labelled, merged_sql, metrics_sql, views
from tidewatch.plans.rate_queries import EMISSIONS_SQL, KEPT_SQL, emitted, kept
from tidewatch.plans.registry import query

WITH = f"WITH {SAMPLES_SQL}, {UNITS_SQL}"
WITH_KEPT = f"{WITH_CROSSINGS}, {KEPT_SQL}"
SCALED_SQL = "scaled AS (SELECT series_id, i, t, x / 200.0e0 AS x, dx / 0.02e0 AS dx FROM samples)"
ENERGY_SQL = "energies AS (SELECT *, lag(reserve) OVER (PARTITION BY series_id ORDER BY i) - reserve AS depletion FROM (SELECT *, 0.25e0 - energy AS reserve FROM (SELECT series_id, i, dx * dx / 2 + x * x / 2 - x*x*x*x / 4 + 0.1e0 * x*x*x*x*x*x / 6 AS energy FROM scaled)))"


def scaled(spark, sf_dir):
    return st.physical_scale(views(spark, sf_dir)[0], 200.0, 0.0001)


@query(f"{WITH}, {SCALED_SQL} SELECT series_id, i, x, dx FROM scaled", "x dx")
def physical_scale(spark, sf_dir):
    return scaled(spark, sf_dir)


@query(f"{WITH}, {SCALED_SQL}, {ENERGY_SQL} SELECT series_id, i, round(energy, 3) AS energy, round(reserve, 3) AS reserve, round(depletion, 3) AS depletion FROM energies WHERE abs(energy) < 1000", "energy reserve depletion")
def energy_scores(spark, sf_dir):
    out = st.energy_scores(scaled(spark, sf_dir), 0.1, 0.25).where(F.abs("energy") < 1000)
    return out.select("series_id", "i", *(F.round(c, 3).alias(c) for c in ("energy", "reserve", "depletion")))


VARIANCE_SQL = f"""grid0 AS (SELECT series_id, record_start + k * {2 * DAY} AS g FROM (SELECT *, unnest(range(1, CAST(greatest(1, floor((record_end - record_start) / {2 * DAY})) AS BIGINT) + 1)) AS k FROM units)),
variances AS (SELECT u.series_id, coalesce(m.v, 0.0) AS variance FROM units u LEFT JOIN (SELECT series_id, avg(v) AS v FROM (SELECT g.series_id, g.g, var_samp(s.x) AS v FROM grid0 g JOIN samples s ON s.series_id = g.series_id AND s.t <= g.g GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1) m USING (series_id))"""


def variances(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    return st.mean_causal_variance(s, u, 2 * DAY)


@query(f"{WITH}, {VARIANCE_SQL} SELECT * FROM variances", "variance")
def mean_causal_variance(spark, sf_dir):
    return variances(spark, sf_dir)


@query()
def entry_state(spark, sf_dir):
    s = views(spark, sf_dir)[0]
    return st.entry_state(sc.danger_score(s, 200.0, 0.001, 50.0), st.energy_scores(scaled(spark, sf_dir), 0.1, 0.25), s, 10 * DAY)


HERALD_SQL = f"""ahead AS (SELECT *, lead(retained_t) OVER (PARTITION BY series_id ORDER BY retained_t, cluster) AS next_t FROM groups),
heralds AS (SELECT DISTINCT u.series_id FROM ahead a JOIN units u ON a.series_id = u.series_id WHERE t_event IS NOT NULL AND last_t <= t_event AND t_event - last_t <= {DAY} AND (next_t IS NULL OR next_t > t_event))"""
OBSERVED_SQL = f"""{HERALD_SQL}, {VARIANCE_SQL}, counted AS (SELECT series_id, count(*) AS n FROM groups GROUP BY 1),
observed AS (SELECT u.series_id, u.stratum, coalesce(t_event, record_end) - record_start AS exposure, coalesce(n, 0) AS clusters, CASE WHEN coalesce(t_event, record_end) > record_start THEN coalesce(n, 0) / (coalesce(t_event, record_end) - record_start) * 3600 END AS rate, variance,
  CASE WHEN t_event IS NULL THEN 'none' WHEN h.series_id IS NOT NULL THEN 'heralded' ELSE 'unheralded' END AS outcome FROM units u LEFT JOIN counted c ON c.series_id = u.series_id LEFT JOIN heralds h ON h.series_id = u.series_id LEFT JOIN variances v ON v.series_id = u.series_id)"""


def observed(spark, sf_dir):
    groups = ev.clusters(find_crossings(spark, sf_dir), DAY)
    u = views(spark, sf_dir)[1]
    return st.observe(u, groups, ev.terminal_partition(groups, u, DAY), variances(spark, sf_dir))


@query(f"{WITH_CROSSINGS}, {OBSERVED_SQL} SELECT * FROM observed", "exposure rate variance")
def observe(spark, sf_dir):
    return observed(spark, sf_dir)


@query(f"{WITH_CROSSINGS}, {OBSERVED_SQL} SELECT stratum, count(*) AS n, count(*) FILTER (outcome = 'heralded') AS heralded, count(*) FILTER (outcome = 'unheralded') AS unheralded, count(*) FILTER (outcome = 'none') AS \"none\" FROM observed GROUP BY stratum")
def partition_summary(spark, sf_dir):
    return st.partition_summary(observed(spark, sf_dir), ["stratum"])


@query(f"""{WITH_KEPT}, b AS (SELECT c.*, u.t_event FROM crossings c JOIN units u USING (series_id) WHERE c.t <= u.t_event),
l AS (SELECT series_id, arg_max(side, t) AS side, max(t) AS last_t, min(t) AS first_t FROM b GROUP BY 1), f AS (SELECT series_id, side, min(t) AS side_t FROM b GROUP BY 1, 2),
o AS (SELECT u.t_event, l.last_t, l.first_t, f.side_t FROM units u LEFT JOIN l USING (series_id) LEFT JOIN f ON f.series_id = l.series_id AND f.side = l.side WHERE u.t_event IS NOT NULL)
SELECT count(*) FILTER (last_t IS NULL) AS without, avg(CASE WHEN last_t IS NULL THEN NULL WHEN last_t = side_t THEN 1.0 ELSE 0.0 END) AS first_share, quantile_cont(t_event - first_t, 0.5) AS median_delay,
  (SELECT CAST(count(*) AS DOUBLE) FROM kept) / (SELECT count(*) FROM units) AS retained_per_series FROM o""", "first_share median_delay retained_per_series")
def crossing_structure(spark, sf_dir):
    return st.crossing_structure(find_crossings(spark, sf_dir), kept(spark, sf_dir), views(spark, sf_dir)[1])


@query(f"""{WITH}, {SCORES_SQL}, {RUNS_SQL}, own AS (SELECT s.series_id, s.t, s.score FROM scores s JOIN units u USING (series_id) WHERE t >= record_start AND t <= record_end AND t <= coalesce(t_event, record_end)),
{episodes_sql('own', 'series_id', str(ALARM))}, {merged_sql('episodes', 'series_id')},
f AS (SELECT m.series_id, m.t_start AS lo_m, m.t_end AS hi_m FROM merged m JOIN units u USING (series_id) WHERE NOT coalesce(m.t_start < t_event AND m.t_end >= t_event - {HORIZON}, false)),
met AS (SELECT DISTINCT f.series_id, f.lo_m FROM f JOIN episodes e ON e.series_id = f.series_id AND e.t_start >= lo_m AND e.t_end <= hi_m JOIN runs r ON r.series_id = f.series_id AND e.t_start <= r.t_end AND r.t_start <= e.t_end JOIN units u ON u.series_id = f.series_id WHERE u.t_event IS NULL)
SELECT (SELECT count(*) FROM f) AS false_episodes, (SELECT count(*) FROM met) AS coincident""")
def false_group_share(spark, sf_dir):
    s, u, scores = views(spark, sf_dir)
    groups = ev.runs_above(s, 50.0, 3600.0).select("series_id", F.col("t_start").alias("lo"), F.col("t_end").alias("hi"))
    return st.false_group_share(scores.select("series_id", "t", "score"), u, groups, ALARM, DEBOUNCE, REFRACTORY, HORIZON, GAP)


@query(f"""WITH {SAMPLES_SQL}, {UNITS_SQL}, scores AS (SELECT CASE WHEN series_id % 3 = 0 THEN 'level' ELSE 'other' END AS method, series_id, t, x AS score FROM samples), frozen AS (SELECT *, CASE method WHEN 'level' THEN 60.0 ELSE 90.0 END AS threshold FROM scores), {contributions_sql('frozen', 'method, threshold', 'threshold')} {metrics_sql('method, threshold')}""", f"threshold {METRIC_DOUBLES}")
def frozen_policy(spark, sf_dir):
    _, u, s = views(spark, sf_dir)
    two = s.withColumn("method", F.when(F.col("series_id") % 3 == 0, "level").otherwise("other"))
    policy = spark.createDataFrame([("level", 60.0), ("other", 90.0)], "method string, threshold double")
    return st.apply_policy(two, u, policy, DEBOUNCE, REFRACTORY, HORIZON, GAP)


@query(f"""{CURVE_SQL}, two AS (SELECT CASE WHEN threshold < 50 THEN 'low' ELSE 'high' END AS method, sum(false_per_hour) AS false_per_hour FROM curve GROUP BY 1) SELECT method, 1 - false_per_hour / (SELECT false_per_hour FROM two WHERE method = 'low') AS reduction FROM two""", "reduction")
def compare_methods(spark, sf_dir):
    two = curve(spark, sf_dir).groupBy(F.when(F.col("threshold") < 50, "low").otherwise("high").alias("method")).agg(F.sum("false_per_hour").alias("false_per_hour"))
    return me.compare_methods(two, "low")


@query(f"{CURVE_SQL} SELECT method, threshold, false_episodes, detected FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY detected DESC, false_episodes, threshold) AS k FROM curve) WHERE k = 1", "threshold")
def select_best(spark, sf_dir):
    return st.select_best(curve(spark, sf_dir), [F.desc("detected"), "false_episodes", "threshold"], ["method"]).select("method", "threshold", "false_episodes", "detected")


@query(f"{WITH_CROSSINGS}, {OBSERVED_SQL} SELECT stratum, outcome, count(*) AS n, count(*) FILTER (clusters >= 8) AS captured FROM observed GROUP BY GROUPING SETS ((), (stratum), (outcome))")
def capture_breakdown(spark, sf_dir):
    return st.capture_breakdown(observed(spark, sf_dir).withColumn("hit", F.col("clusters") >= 8), "hit", "stratum", "outcome")


@query(f"{WITH_KEPT}, {EMISSIONS_SQL}, o AS (SELECT u.*, (SELECT min(t) FROM emissions e WHERE e.series_id = u.series_id) AS first_t, coalesce(t_event, record_end) AS stop FROM units u) SELECT sum(greatest(stop - first_t, 0)) / 3600 AS covered_hours, sum(stop - record_start) / 3600 AS hours, count(*) FILTER (t_event >= first_t) AS covered_events, count(t_event) AS events FROM o", "covered_hours hours")
def gated_coverage(spark, sf_dir):
    return st.gated_coverage(emitted(spark, sf_dir), views(spark, sf_dir)[1])


@query(f"""WITH {SAMPLES_SQL}, b AS (SELECT series_id, t, x, avg(x) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p, min(t) OVER (PARTITION BY series_id) AS lo, max(t) OVER (PARTITION BY series_id) AS hi FROM samples)
SELECT avg(mae) AS error, count(*) AS series FROM (SELECT series_id, avg(abs(p - x)) AS mae FROM b WHERE t >= hi - (hi - lo) / 2 GROUP BY 1)""", "error")
def tracking_error(spark, sf_dir):
    s = views(spark, sf_dir)[0]
    moment = sc.local_moment(s, 5).join(s.select("series_id", "i", "t"), ["series_id", "i"]).select("series_id", "t", F.col("moment").alias("value"))
    return st.tracking_error(moment, s.select("series_id", "t", F.col("x").alias("value")), 0.5)


@query(f"""WITH {SAMPLES_SQL}, p AS (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY i) AS px FROM samples), u AS (SELECT series_id, level, t FROM p CROSS JOIN (SELECT unnest([40.0, 65.0, 90.0, 115.0, 140.0]::DOUBLE[]) AS level) WHERE px < level AND x >= level),
c AS (SELECT level, CASE WHEN t - lag(t) OVER (PARTITION BY series_id, level ORDER BY t) > {DAY} THEN 1 ELSE 0 END + CASE WHEN lag(t) OVER (PARTITION BY series_id, level ORDER BY t) IS NULL THEN 1 ELSE 0 END AS fresh FROM u),
r AS (SELECT level, sum(fresh) / 1000.0 AS rate FROM c GROUP BY 1) SELECT level, CAST(rate AS DOUBLE) AS rate, CAST(row_number() OVER (ORDER BY round(abs(rate - 1.5), 9), level) AS INTEGER) AS rank FROM r""", "level rate")
def level_search(spark, sf_dir):
    return st.level_search(views(spark, sf_dir)[0], 40.0, 140.0, 5, DAY, 1000.0, 1.5)


@query(f"{WITH_BASE}, {LABELS_SQL} SELECT label, CAST(least(floor(4 * (t - record_start) / nullif(record_end - record_start, 0)), 3) AS INTEGER) AS quarter, count(*) AS n FROM labelled JOIN units USING (series_id) GROUP BY 1, 2")
def stratum_counts(spark, sf_dir):
    u = views(spark, sf_dir)[1]
    own = labelled(spark, sf_dir)
    return own.join(sc.clock_score(own.select("series_id", "t"), u), ["series_id", "t"]).groupBy("label", "quarter").agg(F.count("*").alias("n"))


@query(f"""{WITH_KEPT}, q AS (SELECT unnest([0.5, 0.75, 0.9]::DOUBLE[]) AS q), cut AS (SELECT stratum, q, quantile_cont(severity, 0.5) AS a, quantile_cont(severity, 0.75) AS b, quantile_cont(severity, 0.9) AS c FROM kept CROSS JOIN q GROUP BY 1, 2),
k AS (SELECT stratum, q, least(CASE round(q, 2) WHEN 0.5 THEN a WHEN 0.75 THEN b ELSE c END, 1 - 1e-9) AS threshold FROM cut)
SELECT k.stratum, q, any_value(threshold) AS threshold, count(*) FILTER (severity > threshold) AS exceedances, CAST(count(*) FILTER (severity > threshold) AS DOUBLE) / count(*) AS share FROM kept JOIN k ON k.stratum = kept.stratum GROUP BY 1, 2""", "q threshold share")
def tail_priors(spark, sf_dir):
    out = None
    for q in (0.5, 0.75, 0.9):
        one = ra.tail_posterior(kept(spark, sf_dir), q, 2.0, 1.0, ["stratum"]).select("stratum", F.lit(q).alias("q"), "threshold", "exceedances", (F.col("exceedances") / F.col("n")).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{WITH}, {SCORES_SQL} SELECT 'square' AS method, series_id, t, score * score AS score FROM scores", "t score")
def register_score(spark, sf_dir):
    s = views(spark, sf_dir)[2]
    return st.register_score(s.select("series_id", "t", "score"), "square", lambda f: f.score * f.score)
