"""Queries of dataset control: audits, splits, overlays, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import dataset as da
from tidewatch.operators import events as ev
from tidewatch.plans.event_queries import DAY, HORIZON, SAMPLES_SQL, UNITS_SQL, views
from tidewatch.plans.registry import query
from tidewatch.sources.tables import read

WITH = f"WITH {SAMPLES_SQL}, {UNITS_SQL}"
RANGES = [("train", 0, 60), ("calibration", 60, 100), ("test", 100, 1 << 40)]


@query(f"""{WITH} SELECT DISTINCT rule, series_id FROM (SELECT 'time' AS rule, series_id FROM (SELECT *, lag(t) OVER (PARTITION BY series_id ORDER BY i) AS pt FROM samples) WHERE t <= pt
  UNION ALL SELECT 'finite', series_id FROM samples WHERE isnan(x) OR isinf(x) UNION ALL SELECT 'event', series_id FROM units WHERE t_event < record_start OR t_event > record_end)""")
def integrity_audit(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    return da.audit_samples(s, u)


@query(f"{WITH} SELECT stratum, count(*) AS n, count(t_event) AS events, avg(CASE WHEN t_event IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM units GROUP BY stratum", "share")
def outcome_counts(spark, sf_dir):
    return da.outcome_counts(views(spark, sf_dir)[1], ["stratum"])


@query(f"{WITH} SELECT series_id, CASE WHEN series_id < 0 THEN NULL WHEN series_id < 60 THEN 'train' WHEN series_id < 100 THEN 'calibration' ELSE 'test' END AS split FROM units")
def assign_split(spark, sf_dir):
    return da.assign_split(views(spark, sf_dir)[1].select("series_id"), RANGES, "series_id")


@query(f"{WITH} SELECT series_id, CASE WHEN series_id % 2 = 0 THEN 'new' ELSE 'old' END AS version, record_end FROM units", "record_end")
def overlay(spark, sf_dir):
    u = views(spark, sf_dir)[1].select("series_id", "record_end")
    return da.overlay(u.withColumn("version", F.lit("old")), u.where("series_id % 2 = 0").withColumn("version", F.lit("new")), ["series_id"])


@query(f"{WITH}, c AS (SELECT series_id, greatest(record_start, {10 * DAY}) AS lo, least(record_end, {20 * DAY}) AS hi FROM units) SELECT s.series_id, count(*) AS n, sum(x) AS total FROM samples s JOIN c USING (series_id) WHERE lo <= hi AND t >= lo AND t <= hi GROUP BY s.series_id", "total")
def restrict(spark, sf_dir):
    _, u, s = views(spark, sf_dir)
    kept, _ = da.restrict(s, u, F.lit(10 * DAY), F.lit(20 * DAY))
    return kept.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query(f"{WITH} SELECT series_id, t_event FROM units WHERE t_event IS NULL OR series_id IN (SELECT series_id FROM units WHERE t_event IS NOT NULL ORDER BY series_id LIMIT 25)", "t_event")
def take_rows(spark, sf_dir):
    return da.take_rows(views(spark, sf_dir)[1], 25).select("series_id", "t_event")


@query(f"{WITH} SELECT campaign, count(*) AS n, count(t_event) AS events FROM (SELECT 'a' AS campaign, * FROM units WHERE stratum = 0 UNION ALL SELECT 'b', * FROM units WHERE stratum <> 0) GROUP BY campaign")
def union_campaigns(spark, sf_dir):
    u = views(spark, sf_dir)[1]
    return da.union_campaigns({"a": u.where("stratum = 0"), "b": u.where("stratum <> 0")}).groupBy("campaign").agg(F.count("*").alias("n"), F.count("t_event").alias("events"))


@query(f"{WITH} SELECT held_out, CASE WHEN stratum = held_out THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM units CROSS JOIN (SELECT DISTINCT stratum AS held_out FROM units) GROUP BY 1, 2")
def rotations(spark, sf_dir):
    return da.rotations(views(spark, sf_dir)[1], "stratum").groupBy("held_out", "role").agg(F.count("*").alias("n"))


#: Each order's span, from its date to its last shipment, in days.
SPANS_SQL = "spans AS (SELECT o_custkey AS series_id, o_orderkey, epoch_us(o_orderdate) / 86400e6 AS lo, epoch_us(max(l_shipdate)) / 86400e6 AS hi FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate)"


def spans(spark, sf_dir):
    days = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {c}) / 86400e6D")
    last = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    return read(spark, sf_dir, "orders").join(last, F.expr("o_orderkey = l_orderkey")).select(F.col("o_custkey").alias("series_id"), "o_orderkey", days("cast(o_orderdate as timestamp_ntz)").alias("lo"), days("cast(shipped as timestamp_ntz)").alias("hi"))


@query(f"""WITH {SPANS_SQL}, m AS (SELECT *, max(hi) OVER (PARTITION BY series_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
k AS (SELECT *, sum(CASE WHEN lo <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT series_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM k GROUP BY series_id, island""", "lo hi")
def merge_intervals(spark, sf_dir):
    return ev.merge_intervals(spans(spark, sf_dir), ["series_id"])


@query(f"WITH {SPANS_SQL}, p AS (SELECT a.series_id, count(*) AS pairs FROM spans a JOIN spans b ON a.series_id = b.series_id AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1 GROUP BY a.series_id) SELECT * FROM p")
def overlap_join(spark, sf_dir):
    s = spans(spark, sf_dir)
    return ev.overlap_join(s.where("o_orderkey % 2 = 0"), s.where("o_orderkey % 2 = 1")).groupBy("series_id").agg(F.count("*").alias("pairs"))


NAMED_SQL = "named AS (SELECT l_suppkey AS name, min(l_orderkey) AS lo, max(l_orderkey) + 1 AS hi FROM lineitem GROUP BY 1)"


@query(f"WITH {NAMED_SQL} SELECT a.name AS a_name, b.name AS b_name, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM named a JOIN named b ON a.lo < b.hi AND b.lo < a.hi WHERE a.name % 2 = 0 AND b.name % 2 = 1")
def interval_conflicts(spark, sf_dir):
    named = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.min("l_orderkey").alias("lo"), (F.max("l_orderkey") + 1).alias("hi"))
    return ev.interval_conflicts(named.where("name % 2 = 0"), named.where("name % 2 = 1"))


@query(f"""WITH {SAMPLES_SQL}, a AS (SELECT series_id, min(CASE WHEN x >= 200 THEN t END) AS ta FROM samples GROUP BY 1), b AS (SELECT series_id, min(CASE WHEN x >= 150 THEN t END) AS tb FROM samples GROUP BY 1)
SELECT count(*) AS pairs, count(*) FILTER ((ta IS NULL) <> (tb IS NULL)) AS discordant, count(abs(ta - tb)) AS both, quantile_cont(abs(ta - tb), 0.5) AS median_gap, max(abs(ta - tb)) AS largest_gap, CAST(count(tb) - count(ta) AS DOUBLE) / count(*) AS shift, count(*) FILTER (abs(ta - tb) > {HORIZON}) AS "over" FROM a JOIN b USING (series_id)""", "median_gap largest_gap shift")
def paired_compare(spark, sf_dir):
    from tidewatch.sources.tables import units

    e = read(spark, sf_dir, "events")
    return da.paired_compare(units(e, 200.0), units(e, 150.0), "series_id", HORIZON)
