"""Queries that run the streaming operators over the events table as a finite stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.plans.event_queries import ALARM, CRITICAL, DAY, DEBOUNCE, HIGH, LOW, REFRACTORY, SAMPLES_SQL, episodes_sql
from tidewatch.plans.registry import query
from tidewatch.streaming.sources import event_stream, run_to_end
from tidewatch.streaming.stateful import stream_aci as aci
from tidewatch.streaming.stateful import stream_coverage as coverage
from tidewatch.streaming.stateful import stream_crossings as crossings
from tidewatch.streaming.stateful import stream_episodes as episodes
from tidewatch.streaming.stateful import stream_normalize as normalize
from tidewatch.streaming.timed import timed_crossings as crossings_by_time
from tidewatch.streaming.timed import timed_episodes as episodes_by_time


@query()
def stream_normalize(spark, sf_dir):
    return run_to_end(normalize(event_stream(spark, sf_dir).select("series_id", "t", "x")))


@query()
def stream_crossings(spark, sf_dir):
    return run_to_end(crossings(event_stream(spark, sf_dir).select("series_id", "t", "x"), HIGH, LOW, CRITICAL, DAY))


@query()
def stream_episodes(spark, sf_dir):
    return run_to_end(episodes(event_stream(spark, sf_dir).select("series_id", "t", F.col("x").alias("score")), ALARM, DEBOUNCE, REFRACTORY))


@query()
def stream_aci(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select("series_id", "t", F.lit(100.0).alias("bound"), F.col("x").alias("target"))
    return run_to_end(aci(rows, [float(k) for k in range(-100, 101, 4)], 0.1, 0.02, 2))


@query("SELECT CAST(d AS VARCHAR) AS window_start, count(*) AS n, 1 - avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END) AS coverage FROM (SELECT value, CAST(date_trunc('day', ts) AS DATE) AS d FROM events) GROUP BY d", "coverage")
def stream_coverage(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select("ts", (F.col("x") >= 100).cast("int").alias("miss"))
    out = run_to_end(coverage(rows, "ts", "1 day", "1 day", "2 days"), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n", "coverage")


#: Seconds of silence after which a series' state is forgotten, and the epoch in microseconds.
IDLE, EPOCH_MICROS = 3 * DAY, 1704067200000000
#: What the watermark has passed at the end of a stream without lateness, in spells of each series without such a silence.
SPELLS_SQL = f"""WITH {SAMPLES_SQL}, mark AS (SELECT floor(max(epoch_us(ts)) / 1000) * 1000 AS us FROM events), seen AS (SELECT * FROM samples WHERE t <= (SELECT (us - {EPOCH_MICROS}) / 1e6 FROM mark)),
spells AS (SELECT series_id, i, t, x, sum(CASE WHEN t - pt > {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY i) AS spell FROM (SELECT *, lag(t) OVER (PARTITION BY series_id ORDER BY i) AS pt FROM seen)),
ends AS (SELECT series_id, spell, max(t) AS end_t, spell < max(spell) OVER (PARTITION BY series_id) OR (SELECT (us - {EPOCH_MICROS}) / 1e6 FROM mark) - max(t) > {IDLE} AS over FROM spells GROUP BY 1, 2)"""


@query(f"""{SPELLS_SQL}, scores AS (SELECT series_id, spell, t, x AS score FROM spells), {episodes_sql('scores', 'series_id, spell', str(ALARM))}
SELECT e.series_id, t_start, t_end, max_score FROM episodes e JOIN ends USING (series_id, spell) WHERE over OR (SELECT count(*) FROM spells s WHERE s.series_id = e.series_id AND s.spell = e.spell AND s.t > e.t_end) >= {REFRACTORY}""", "t_start t_end max_score")
def timed_episodes(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select("series_id", "ts", F.col("x").alias("score"))
    out = run_to_end(episodes_by_time(rows, ALARM, DEBOUNCE, REFRACTORY, "0 seconds", IDLE))
    return out.select("series_id", *(((F.col(c) - EPOCH_MICROS) / 1e6).alias(c) for c in ("t_start", "t_end")), "max_score")


@query(f"""{SPELLS_SQL}, d AS (SELECT *, coalesce(CASE WHEN t > lag(t) OVER w THEN (x - lag(x) OVER w) / (t - lag(t) OVER w) END, 0.0) AS dx FROM spells WINDOW w AS (PARTITION BY series_id, spell ORDER BY i)),
p AS (SELECT *, lag(x) OVER w AS px, lag(dx) OVER w AS pdx, lag(t) OVER w AS pt FROM d WINDOW w AS (PARTITION BY series_id, spell ORDER BY i)),
s AS (SELECT *, ((CASE WHEN side = 1 THEN {HIGH} ELSE {LOW} END) - px) / (x - px) AS f FROM (SELECT *, CASE WHEN px < {HIGH} AND x >= {HIGH} THEN 1 WHEN px > {LOW} AND x <= {LOW} THEN -1 END AS side FROM p) WHERE side IS NOT NULL),
c AS (SELECT series_id, spell, i, side, pt + f * (t - pt) AS at_t, side * (pdx + f * (dx - pdx)) / {CRITICAL} AS severity FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id, spell ORDER BY at_t, i) AS chain FROM (SELECT *, CASE WHEN at_t - lag(at_t) OVER (PARTITION BY series_id, spell ORDER BY at_t, i) > {DAY} THEN 1 ELSE 0 END AS fresh FROM c)),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, spell, chain ORDER BY severity DESC, at_t, i) AS rank, max(at_t) OVER (PARTITION BY series_id, spell, chain) AS last_t FROM g)
SELECT r.series_id, round(at_t, 3) AS t, side, severity FROM r JOIN ends e ON e.series_id = r.series_id AND e.spell = r.spell WHERE rank = 1 AND (over OR end_t - last_t > {DAY})""", "t severity")
def timed_crossings(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select("series_id", "ts", "x")
    out = run_to_end(crossings_by_time(rows, HIGH, LOW, CRITICAL, DAY, "0 seconds", IDLE))
    return out.select("series_id", F.round((F.col("before") - EPOCH_MICROS) / 1e6 + F.col("after") / 1e6, 3).alias("t"), "side", "severity")
