"""Queries over events: crossings, runs, episodes, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import events as ev
from tidewatch.operators import metrics as me
from tidewatch.operators import resampling as re_
from tidewatch.plans.registry import query
from tidewatch.sources.tables import SAMPLES_SQL, SCORES_SQL, UNITS_SQL, level_scores, read, samples, units

DAY = 86400.0
ALARM, DEBOUNCE, REFRACTORY, HORIZON, GAP = 60.0, 2, 2, 3 * DAY, DAY / 2
HIGH, LOW, CRITICAL = 120.0, 5.0, 0.002


def views(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return samples(e), units(e), level_scores(e)


CROSSINGS_SQL = f"""crossings AS (
  SELECT series_id, side, pt + f * (t - pt) AS t, i AS i_detect, side * (pdx + f * (dx - pdx)) AS outward_rate, {CRITICAL} AS critical_rate, side * (pdx + f * (dx - pdx)) / {CRITICAL} AS severity
  FROM (SELECT *, ((CASE WHEN side = 1 THEN {HIGH} ELSE {LOW} END) - px) / (x - px) AS f
    FROM (SELECT *, CASE WHEN px < {HIGH} AND x >= {HIGH} THEN 1 WHEN px > {LOW} AND x <= {LOW} THEN -1 END AS side
      FROM (SELECT *, lag(x) OVER w AS px, lag(dx) OVER w AS pdx, lag(t) OVER w AS pt FROM samples WINDOW w AS (PARTITION BY series_id ORDER BY i)))
    WHERE side IS NOT NULL))"""
CHAINS_SQL = f"""chains AS (
  SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY t, i_detect) AS cluster FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id ORDER BY t, i_detect) > {DAY} THEN 1 ELSE 0 END AS fresh FROM crossings))"""
GROUPS_SQL = """groups AS (
  SELECT series_id, cluster, min(t) AS first_t, max(t) AS last_t, count(*) AS n,
    first(t ORDER BY severity DESC, t, i_detect) AS retained_t, first(severity ORDER BY severity DESC, t, i_detect) AS retained_severity
  FROM chains GROUP BY series_id, cluster)"""
WITH_CROSSINGS = f"WITH {SAMPLES_SQL}, {UNITS_SQL}, {CROSSINGS_SQL}, {CHAINS_SQL}, {GROUPS_SQL}"


def find_crossings(spark, sf_dir):
    return ev.crossings(views(spark, sf_dir)[0], HIGH, LOW, CRITICAL, CRITICAL)


@query(f"{WITH_CROSSINGS} SELECT * FROM crossings", "t outward_rate critical_rate severity")
def crossings(spark, sf_dir):
    return find_crossings(spark, sf_dir)


@query(f"WITH {SAMPLES_SQL} SELECT series_id, CAST(sum(CASE WHEN px < 50 AND x >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_up FROM (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY i) AS px FROM samples) GROUP BY series_id")
def upcrossings(spark, sf_dir):
    return ev.upcrossings(views(spark, sf_dir)[0], 50.0)


@query(f"""{WITH_CROSSINGS} SELECT series_id, side, t, i_detect, outward_rate, critical_rate, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, cluster ORDER BY severity DESC, t, i_detect) AS rank FROM chains) WHERE rank = 1""", "t outward_rate critical_rate severity")
def declustered(spark, sf_dir):
    return ev.decluster(find_crossings(spark, sf_dir), DAY)


@query(f"{WITH_CROSSINGS} SELECT series_id, CAST(cluster AS BIGINT) AS cluster, first_t, last_t, n, retained_t, retained_severity FROM groups", "first_t last_t retained_t retained_severity")
def event_clusters(spark, sf_dir):
    return ev.clusters(find_crossings(spark, sf_dir), DAY)


@query(f"""{WITH_CROSSINGS}, ahead AS (SELECT *, lead(retained_t) OVER (PARTITION BY series_id ORDER BY retained_t, cluster) AS next_t FROM groups),
met AS (SELECT u.series_id, max_by(cluster, last_t) AS cluster FROM ahead a JOIN units u ON a.series_id = u.series_id
  WHERE t_event IS NOT NULL AND last_t <= t_event AND t_event - last_t <= {DAY} AND (next_t IS NULL OR next_t > t_event) GROUP BY u.series_id)
SELECT u.series_id, m.cluster IS NOT NULL AS heralded, CAST(m.cluster AS BIGINT) AS cluster FROM units u LEFT JOIN met m ON u.series_id = m.series_id WHERE t_event IS NOT NULL""")
def terminal_partition(spark, sf_dir):
    own = find_crossings(spark, sf_dir)
    return ev.terminal_partition(ev.clusters(own, DAY), views(spark, sf_dir)[1], DAY)


RUNS_SQL = """runs AS (SELECT series_id, min(i) AS i_start, max(i) AS i_end, min(t) AS t_start, max(t) AS t_end, max(x) AS top FROM (
  SELECT *, i - row_number() OVER (PARTITION BY series_id ORDER BY i) AS island FROM samples WHERE x > 50) GROUP BY series_id, island HAVING max(t) - min(t) >= 3600)"""


@query(f"WITH {SAMPLES_SQL}, {RUNS_SQL} SELECT * FROM runs", "t_start t_end top")
def runs_above(spark, sf_dir):
    return ev.runs_above(views(spark, sf_dir)[0], 50.0, 3600.0)


@query(f"""WITH {SAMPLES_SQL}, {UNITS_SQL}, {RUNS_SQL} SELECT u.series_id, coalesce(bool_or(r.t_start < t_event AND r.t_end >= t_event - {HORIZON}), false) AS preceded
FROM units u LEFT JOIN runs r ON r.series_id = u.series_id WHERE t_event IS NOT NULL GROUP BY u.series_id""")
def preceded_by(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    return ev.preceded_by(u, ev.runs_above(s, 50.0, 3600.0).select("series_id", F.col("t_start").alias("lo"), F.col("t_end").alias("hi")), HORIZON)


def episodes_sql(scores: str, keys: str, threshold: str, name: str = "episodes") -> str:
    """CTEs of alarm episodes over a CTE of scores(keys, t, score)."""
    return f"""flags AS (SELECT *, CASE WHEN score >= {threshold} THEN 1 ELSE 0 END AS flag FROM {scores}),
turns AS (SELECT *, CASE WHEN flag = lag(flag) OVER (PARTITION BY {keys} ORDER BY t) THEN 0 ELSE 1 END AS turn FROM flags),
numbered AS (SELECT *, sum(turn) OVER (PARTITION BY {keys} ORDER BY t) AS run FROM turns),
placed AS (SELECT *, row_number() OVER (PARTITION BY {keys}, run ORDER BY t) AS k FROM numbered),
flag_runs AS (SELECT {keys}, run, max(flag) AS flag, count(*) AS n, min(CASE WHEN k = {DEBOUNCE} THEN t END) AS opens, max(t) AS last_t, max(score) AS top FROM placed GROUP BY {keys}, run),
segmented AS (SELECT *, sum(CASE WHEN flag = 0 AND n >= {REFRACTORY} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY run) AS segment FROM flag_runs),
opened AS (SELECT *, min(CASE WHEN n >= {DEBOUNCE} THEN run END) OVER (PARTITION BY {keys}, segment) AS first_run FROM segmented WHERE flag = 1),
{name} AS (SELECT {keys}, min_by(opens, run) AS t_start, max(last_t) AS t_end, max(top) AS max_score FROM opened WHERE run >= first_run GROUP BY {keys}, segment)"""


def merged_sql(source: str, keys: str, name: str = "merged") -> str:
    return f"""{name} AS (SELECT {keys}, min(t_start) AS t_start, max(t_end) AS t_end, max(max_score) AS max_score FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY t_start, t_end) AS chain FROM (
    SELECT *, CASE WHEN t_start - lag(t_end) OVER (PARTITION BY {keys} ORDER BY t_start, t_end) > {GAP} THEN 1 ELSE 0 END AS fresh FROM {source})) GROUP BY {keys}, chain)"""


@query(f"WITH {SAMPLES_SQL}, {SCORES_SQL}, {episodes_sql('scores', 'series_id', str(ALARM))} SELECT * FROM episodes", "t_start t_end max_score")
def alarm_episodes(spark, sf_dir):
    return ev.episodes(views(spark, sf_dir)[2], ALARM, DEBOUNCE, REFRACTORY)


@query(f"WITH {SAMPLES_SQL}, {SCORES_SQL}, {episodes_sql('scores', 'series_id', str(ALARM))}, {merged_sql('episodes', 'series_id')} SELECT * FROM merged", "t_start t_end max_score")
def merged_episodes(spark, sf_dir):
    return ev.merge_episodes(ev.episodes(views(spark, sf_dir)[2], ALARM, DEBOUNCE, REFRACTORY), GAP)


def contributions_sql(scores: str, keys: str, threshold: str) -> str:
    """CTEs up to `contributions` over scores(keys without series_id as given, series_id, t, score)."""
    own = f"{keys}, series_id" if keys else "series_id"
    every = f"(SELECT DISTINCT {keys} FROM {scores}) CROSS JOIN units" if keys else "units"
    return f"""own AS (SELECT s.*, u.record_start, u.record_end, u.t_event FROM {scores} s JOIN units u USING (series_id) WHERE t >= record_start AND t <= record_end),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY t) AS k0 FROM own),
seen AS (SELECT {own}, min(CASE WHEN k0 = {DEBOUNCE} THEN t END) AS opening, bool_or(coalesce(t < t_event AND t >= t_event - {HORIZON}, false)) AS near FROM ranked GROUP BY {own}),
base0 AS (SELECT e.*, greatest(e.record_start, coalesce(s.opening, 'infinity'::DOUBLE)) AS opening, s.near FROM (SELECT * FROM {every}) e LEFT JOIN seen s USING ({own})),
base1 AS (SELECT *, coalesce(t_event > opening AND near, false) AS observable FROM base0),
base2 AS (SELECT *, CASE WHEN coalesce(t_event <= opening, false) THEN record_start WHEN observable THEN least(record_end, t_event) ELSE record_end END AS event_end FROM base1),
base AS (SELECT *, greatest(0.0, event_end - record_start) AS exposure FROM base2),
risk AS (SELECT o.* EXCLUDE (record_start, record_end, t_event) FROM own o JOIN base b USING ({own}) WHERE b.event_end > b.record_start AND o.t <= b.event_end),
counted AS (SELECT {own}, count(*) AS opportunities FROM risk GROUP BY {own}),
{episodes_sql('risk', own, threshold)}, {merged_sql('episodes', own)},
held AS (SELECT {own}, sum(CASE WHEN a THEN 0 ELSE 1 END) AS false_episodes, max(CASE WHEN a THEN 1 ELSE 0 END) AS detected, max(CASE WHEN a THEN t_event - t_start END) AS lead FROM (
  SELECT m.*, b.t_event, coalesce(b.observable AND m.t_start < b.t_event AND m.t_end >= b.t_event - {HORIZON}, false) AS a FROM merged m JOIN base b USING ({own})) GROUP BY {own}),
contributions AS (SELECT {', '.join('b.' + x.strip() for x in own.split(','))}, b.stratum, b.exposure, coalesce(c.opportunities, 0) AS opportunities, CAST(b.observable AS BIGINT) AS observable, CAST(coalesce(h.detected, 0) AS BIGINT) AS detected, CAST(coalesce(h.false_episodes, 0) AS BIGINT) AS false_episodes, h.lead
  FROM base b LEFT JOIN counted c USING ({own}) LEFT JOIN held h USING ({own}))"""


def metrics_sql(keys: str = "", source: str = "contributions") -> str:
    z = 1.959963984540054
    head, tail = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    mid, half = f"(p + {z}*{z} / (2 * events)) / (1 + {z}*{z} / events)", f"{z} * sqrt(p * (1 - p) / events + {z}*{z} / (4 * events * events)) / (1 + {z}*{z} / events)"
    return f"""SELECT {head}exposure_hours, opportunities, events, detected, false_episodes, CASE WHEN events > 0 THEN p ELSE 0.0 END AS sensitivity,
  CASE WHEN events > 0 THEN {mid} - {half} END AS sensitivity_lo, CASE WHEN events > 0 THEN {mid} + {half} END AS sensitivity_hi,
  CASE WHEN exposure_hours > 0 THEN false_episodes / exposure_hours ELSE 0.0 END AS false_per_hour, lead_q10, lead_q50, lead_q90 FROM (
  SELECT *, CASE WHEN events > 0 THEN CAST(detected AS DOUBLE) / events END AS p FROM (
  SELECT {head}sum(exposure) / 3600.0 AS exposure_hours, CAST(sum(opportunities) AS BIGINT) AS opportunities, CAST(sum(observable) AS BIGINT) AS events, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(false_episodes) AS BIGINT) AS false_episodes,
    quantile_cont(lead, 0.1) AS lead_q10, quantile_cont(lead, 0.5) AS lead_q50, quantile_cont(lead, 0.9) AS lead_q90 FROM {source}{tail}))"""


METRIC_DOUBLES = "exposure_hours sensitivity sensitivity_lo sensitivity_hi false_per_hour lead_q10 lead_q50 lead_q90"
WITH_BASE = f"WITH {SAMPLES_SQL}, {UNITS_SQL}, {SCORES_SQL}"


def contribution(spark, sf_dir):
    _, u, s = views(spark, sf_dir)
    return me.contributions(s.select("series_id", "t", "score"), u, ALARM, DEBOUNCE, REFRACTORY, HORIZON, GAP)


@query(f"{WITH_BASE}, level AS (SELECT series_id, t, score FROM scores), {contributions_sql('level', '', str(ALARM))} SELECT * FROM contributions", "exposure lead")
def alarm_contributions(spark, sf_dir):
    return contribution(spark, sf_dir)


@query(f"{WITH_BASE}, level AS (SELECT series_id, t, score FROM scores), {contributions_sql('level', '', str(ALARM))} {metrics_sql()}", METRIC_DOUBLES)
def alarm_metrics(spark, sf_dir):
    return me.alarm_metrics(contribution(spark, sf_dir))


GRID_SQL = "grid AS (SELECT DISTINCT method, unnest(list_append(quantile_cont(score, [" + ", ".join(repr(k / 40) for k in range(41)) + "]), -1.7976931348623157e308)) AS threshold FROM scores GROUP BY method)"
CURVE_SQL = f"{WITH_BASE}, {GRID_SQL}, crossed AS (SELECT s.*, g.threshold FROM scores s JOIN grid g USING (method)), {contributions_sql('crossed', 'method, threshold', 'threshold')}, curve AS ({metrics_sql('method, threshold')})"


@query(f"{WITH_BASE}, {GRID_SQL} SELECT * FROM grid", "threshold")
def threshold_grid(spark, sf_dir):
    return me.threshold_grid(views(spark, sf_dir)[2])


def curve(spark, sf_dir):
    _, u, s = views(spark, sf_dir)
    return me.operating_curve(s, u, me.threshold_grid(s), DEBOUNCE, REFRACTORY, HORIZON, GAP)


@query(f"{CURVE_SQL} SELECT * FROM curve", f"threshold {METRIC_DOUBLES}")
def operating_curve(spark, sf_dir):
    return curve(spark, sf_dir)


@query(f"""{CURVE_SQL} SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY CASE WHEN sensitivity >= 0.9 THEN 0 ELSE 1 END, round(CASE WHEN sensitivity >= 0.9 THEN false_per_hour ELSE -sensitivity END, 9), threshold) AS rank FROM curve) WHERE rank = 1""", f"threshold {METRIC_DOUBLES}")
def matched_point(spark, sf_dir):
    return me.matched_point(curve(spark, sf_dir))


LABELS_SQL = f"""labelled AS (SELECT method, series_id, t, score, CASE WHEN lead > 0 AND lead <= {HORIZON} THEN 1 ELSE 0 END AS label FROM (
  SELECT s.*, u.t_event, u.t_event - s.t AS lead FROM scores s JOIN units u USING (series_id) WHERE t >= record_start AND t <= record_end)
  WHERE t_event IS NULL OR (lead > 0 AND lead <= {HORIZON}) OR lead > {HORIZON + DAY})"""
AUC_SQL = "SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {score} AS s, sum(CASE WHEN {label} = 1 THEN 1.0 ELSE 0 END) AS pos, sum(CASE WHEN {label} = 0 THEN 1.0 ELSE 0 END) AS neg FROM {rows} GROUP BY 1))"


def labelled(spark, sf_dir):
    _, u, s = views(spark, sf_dir)
    return me.window_labels(s, u, HORIZON, DAY)


@query(f"{WITH_BASE}, {LABELS_SQL} SELECT * FROM labelled", "t score")
def window_labels(spark, sf_dir):
    return labelled(spark, sf_dir)


@query(f"{WITH_BASE}, {LABELS_SQL} SELECT CAST(auc AS DOUBLE) AS auc FROM ({AUC_SQL.format(score='score', label='label', rows='labelled')})", "auc")
def window_auc(spark, sf_dir):
    return me.auc(labelled(spark, sf_dir))


DRAWS_SQL = """ranked_units AS (SELECT series_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY series_id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM units),
drawn AS (SELECT stratum, replicate, ('0x' || substr(md5(concat_ws('|', '{seed}', stratum, replicate, k)), 1, 8))::BIGINT % n AS k FROM ranked_units CROSS JOIN (SELECT unnest(range({replicates})) AS replicate)),
draws AS (SELECT d.replicate, r.series_id, count(*) AS times FROM drawn d JOIN ranked_units r ON d.stratum = r.stratum AND d.k = r.k GROUP BY d.replicate, r.series_id)"""


@query(f"{WITH_BASE}, {DRAWS_SQL.format(seed=17, replicates=200)} SELECT CAST(replicate AS INTEGER) AS replicate, series_id, times FROM draws")
def bootstrap_draws(spark, sf_dir):
    return re_.bootstrap_draws(views(spark, sf_dir)[1], 200, 17)


@query(f"""{WITH_BASE}, level AS (SELECT series_id, t, score FROM scores), {contributions_sql('level', '', str(ALARM))}, {DRAWS_SQL.format(seed=17, replicates=1000)},
sums AS (SELECT replicate, CAST(sum(detected * times) AS DOUBLE) AS a, CAST(sum(observable * times) AS DOUBLE) AS b FROM draws JOIN contributions USING (series_id) GROUP BY replicate)
SELECT (SELECT CAST(sum(detected) AS DOUBLE) / sum(observable) FROM contributions) AS estimate, quantile_cont(a / b, 0.025) AS lo, quantile_cont(a / b, 0.975) AS hi, count(*) AS replicates FROM sums WHERE b > 0""", "estimate lo hi")
def cluster_bootstrap(spark, sf_dir):
    return re_.bootstrap_ratio(contribution(spark, sf_dir), views(spark, sf_dir)[1], "detected", "observable", 1000, 17)


@query(f"""{WITH_BASE}, {LABELS_SQL}, {DRAWS_SQL.format(seed=17, replicates=50)},
summed AS (SELECT replicate, score AS s, sum(CASE WHEN label = 1 THEN times ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN times ELSE 0 END) AS neg FROM labelled JOIN draws USING (series_id) GROUP BY replicate, score),
aucs AS (SELECT replicate, CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM summed) GROUP BY replicate HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT (SELECT CAST(auc AS DOUBLE) FROM ({AUC_SQL.format(score='score', label='label', rows='labelled')})) AS estimate, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi, count(*) AS replicates FROM aucs""", "estimate lo hi")
def bootstrap_auc(spark, sf_dir):
    return re_.bootstrap_auc(labelled(spark, sf_dir), views(spark, sf_dir)[1], 50, 17)


@query(f"""{WITH_BASE}, g AS (SELECT stratum, count(t_event) AS hits, count(*) AS n, CAST(count(t_event) AS DOUBLE) / count(*) AS share, 1.959963984540054 AS z FROM units GROUP BY stratum)
SELECT stratum, hits, n, share, (share + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(share*(1-share)/n + z*z/(4*n*n)) / (1 + z*z/n) AS lo, (share + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(share*(1-share)/n + z*z/(4*n*n)) / (1 + z*z/n) AS hi FROM g""", "share lo hi")
def proportion_wilson(spark, sf_dir):
    return re_.proportion_wilson(views(spark, sf_dir)[1].withColumn("hit", F.col("t_event").isNotNull()), ["stratum"], "hit")


@query()
def proportion_ci(spark, sf_dir):
    return re_.proportion_ci(views(spark, sf_dir)[1].withColumn("hit", F.col("t_event").isNotNull()), ["stratum"], "hit")


@query()
def rate_ci(spark, sf_dir):
    u = views(spark, sf_dir)[1].withColumns({"hit": F.col("t_event").isNotNull(), "exposure": F.coalesce("t_event", "record_end") - F.col("record_start")})
    return re_.rate_ci(u, ["stratum"], "hit", "exposure")
