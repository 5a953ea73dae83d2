"""Queries over windows: labels, thinning, normalisers, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import metrics as me
from tidewatch.operators import windows as wi
from tidewatch.plans.event_queries import ALARM, AUC_SQL, DAY, HORIZON, SAMPLES_SQL, SCORES_SQL, UNITS_SQL, views
from tidewatch.plans.registry import query

LENGTH, STRIDE = 12, 3
WITH = f"WITH {SAMPLES_SQL}, {UNITS_SQL}"
#: Windows in long form: one row for each end, with aggregates over the trailing frame.
ENDS_SQL = f"""ends AS (SELECT * FROM (SELECT *, count(*) OVER w AS have FROM samples WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW)) WHERE have = {LENGTH} AND (i - {LENGTH - 1}) % {STRIDE} = 0)"""
LABEL_WINDOWS_SQL = f"""labelled AS (SELECT series_id, i AS i_end, t AS t_end, CASE WHEN lead <= {HORIZON} THEN 1 ELSE 0 END AS label FROM (
  SELECT e.*, u.record_end, u.t_event, u.t_event - e.t AS lead FROM ends e JOIN units u USING (series_id))
  WHERE (t_event IS NULL OR lead > 0) AND (lead IS NULL OR lead <= {HORIZON} OR lead > {HORIZON + DAY}) AND coalesce(lead <= {HORIZON} OR t + {HORIZON} <= record_end, t + {HORIZON} <= record_end))"""


def all_windows(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    return wi.windows(wi.to_series(s), LENGTH, STRIDE), u


@query(f"{WITH} SELECT series_id, count(*) AS n, sum(x) AS total, max(t) AS last_t FROM samples GROUP BY series_id", "total last_t")
def series_arrays(spark, sf_dir):
    s = wi.to_series(views(spark, sf_dir)[0])
    return wi.to_samples(s).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("t").alias("last_t"))


@query(f"{WITH}, {ENDS_SQL} SELECT series_id, i AS i_end, t AS t_end, (SELECT sum(x) FROM samples s WHERE s.series_id = e.series_id AND s.i BETWEEN e.i - {LENGTH - 1} AND e.i) AS total FROM ends e", "t_end total")
def windows(spark, sf_dir):
    w, _ = all_windows(spark, sf_dir)
    return w.select("series_id", "i_end", "t_end", F.aggregate("w", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query(f"{WITH}, {ENDS_SQL}, {LABEL_WINDOWS_SQL} SELECT * FROM labelled", "t_end")
def horizon_labels(spark, sf_dir):
    w, u = all_windows(spark, sf_dir)
    return wi.label_windows(w.select("series_id", "i_end", "t_end"), u, HORIZON, DAY)


@query(f"""{WITH}, {ENDS_SQL} SELECT series_id, i AS i_end, t AS t_end, CASE WHEN lead <= {HORIZON} THEN 1 WHEN t + {HORIZON} <= record_end THEN 0 END AS label FROM (
  SELECT e.*, u.record_end, u.t_event, u.t_event - e.t AS lead FROM ends e JOIN units u USING (series_id)) WHERE (t_event IS NULL OR lead > 0) AND (lead IS NULL OR lead <= {HORIZON} OR lead > {HORIZON + DAY})""", "t_end")
def censored_labels(spark, sf_dir):
    w, u = all_windows(spark, sf_dir)
    return wi.label_windows(w.select("series_id", "i_end", "t_end"), u, HORIZON, DAY, censored=True)


@query(f"""{WITH}, {ENDS_SQL}, {LABEL_WINDOWS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_end) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM labelled)
SELECT series_id, i_end, t_end, label FROM k WHERE n <= 5 OR k IN (0, (n - 1) // 4, (2 * (n - 1)) // 4, (3 * (n - 1)) // 4, n - 1)""", "t_end")
def thinned_windows(spark, sf_dir):
    w, u = all_windows(spark, sf_dir)
    return wi.thin(wi.label_windows(w.select("series_id", "i_end", "t_end"), u, HORIZON, DAY), 5)


CAUSAL_SQL = """causal AS (SELECT series_id, i, CASE WHEN n < 2 THEN 0.0 ELSE (x - (o + s1 / n + (si - (n - 1) / 2 * s1) / greatest(n * (n * n - 1) / 12, 1e-12) * (n - (n - 1) / 2))) / greatest(sqrt(greatest((s2 - s1 * s1 / n) / greatest(n - 1, 1.0), 0.0)), 1e-12) END AS z FROM (
  SELECT *, sum(c) OVER w AS s1, sum(c * c) OVER w AS s2, sum(n * c) OVER w AS si FROM (
    SELECT *, x - o AS c, CAST(i AS DOUBLE) AS n FROM (SELECT *, first_value(x) OVER (PARTITION BY series_id ORDER BY i) AS o FROM samples))
  WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
RECORD_SQL = "record AS (SELECT series_id, i, coalesce((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 0.0) AS z FROM samples WINDOW w AS (PARTITION BY series_id))"


@query(f"{WITH}, {CAUSAL_SQL} SELECT * FROM causal", "z")
def causal_normalize(spark, sf_dir):
    return wi.causal_normalize(views(spark, sf_dir)[0])


@query(f"{WITH}, {RECORD_SQL} SELECT * FROM record", "z")
def record_normalize(spark, sf_dir):
    return wi.record_normalize(views(spark, sf_dir)[0])


PROBE_SQL = "SELECT series_id, i, CASE WHEN i >= 20 AND t_event IS NOT NULL THEN 1 ELSE 0 END AS label FROM samples JOIN units USING (series_id)"


@query(f"""{WITH}, {CAUSAL_SQL}, {RECORD_SQL}, l AS ({PROBE_SQL}), a AS (SELECT l.label, round(c.z, 9) AS z FROM l JOIN causal c USING (series_id, i)), b AS (SELECT l.label, round(r.z, 9) AS z FROM l JOIN record r USING (series_id, i))
SELECT (SELECT CAST(auc AS DOUBLE) FROM ({AUC_SQL.format(score='z', label='label', rows='a')})) AS causal_auc, (SELECT CAST(auc AS DOUBLE) FROM ({AUC_SQL.format(score='z', label='label', rows='b')})) AS record_auc""", "causal_auc record_auc")
def leakage_probe(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    label = s.join(u, "series_id").select("series_id", "i", ((F.col("i") >= 20) & F.col("t_event").isNotNull()).cast("int").alias("label"))
    one = lambda z, name: me.auc(label.join(z.withColumn("z", F.round("z", 9)), ["series_id", "i"]), score="z").select(F.col("auc").alias(name))
    return one(wi.causal_normalize(s), "causal_auc").crossJoin(one(wi.record_normalize(s), "record_auc"))


HORIZONS = (DAY, 3 * DAY)
FORECAST_SQL = "forecasts AS (" + " UNION ALL ".join(f"SELECT series_id, i, t, {h} AS horizon, coalesce(max(abs(x)) OVER (PARTITION BY series_id ORDER BY CAST(round(t * 1e6) AS BIGINT) RANGE BETWEEN 1 FOLLOWING AND {round(h * 1e6)} FOLLOWING), 0.0) AS target, max(t) OVER (PARTITION BY series_id) AS last_t FROM samples" for h in HORIZONS) + ")"
FORECASTS_SQL = f"{FORECAST_SQL}, usable AS (SELECT series_id, i, t, horizon, target FROM forecasts WHERE t + horizon <= last_t AND i % 2 = 0)"


@query(f"{WITH}, {FORECASTS_SQL} SELECT * FROM usable", "t horizon target")
def forecast_samples(spark, sf_dir):
    return wi.forecast_samples(views(spark, sf_dir)[0], list(HORIZONS), step=2)


@query(f"{WITH}, {FORECASTS_SQL} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM usable WHERE horizon = {DAY} AND t >= {10 * DAY}) WHERE k = 1", "t horizon target")
def snapshot(spark, sf_dir):
    return wi.snapshot(wi.forecast_samples(views(spark, sf_dir)[0], [DAY], step=2), 10 * DAY)


@query(f"{WITH}, {SCORES_SQL} SELECT u.series_id, coalesce(max(CASE WHEN t <= record_end - {HORIZON} + 1e-9 THEN t END), min(record_start)) AS risk_end FROM units u LEFT JOIN scores s USING (series_id) GROUP BY u.series_id", "risk_end")
def risk_end(spark, sf_dir):
    _, u, s = views(spark, sf_dir)
    return wi.risk_end(s, u, HORIZON)


@query(f"""{WITH}, {SCORES_SQL} SELECT series_id, count(*) AS n, min(t) AS first_t FROM scores WHERE score >= {ALARM} GROUP BY series_id""", "first_t")
def flagged_scores(spark, sf_dir):
    s = views(spark, sf_dir)[2]
    return s.where(F.col("score") >= ALARM).groupBy("series_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


