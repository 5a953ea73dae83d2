"""The series views over event tables: samples, units and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds are counted from here, independent of the session's time zone.
EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def seconds(column: str):
    """Seconds since EPOCH of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', {column}) / 1e6D")


def samples(events: DataFrame) -> DataFrame:
    """series_id, i (from 0), t, x and dx of events(user_id, ts, event_id, value): dx is the difference quotient to
    the sample before, 0 for the first. One shuffle, on the series."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = events.select(F.col("user_id").alias("series_id"), (F.row_number().over(order) - 1).alias("i"), seconds("ts").alias("t"), F.col("value").alias("x"), F.lag("value").over(order).alias("px"), F.lag(seconds("ts")).over(order).alias("pt"))
    slope = F.when(F.col("t") > F.col("pt"), (F.col("x") - F.col("px")) / (F.col("t") - F.col("pt")))
    return out.select("series_id", "i", "t", "x", F.coalesce(slope, F.lit(0.0)).alias("dx"))


def units(events: DataFrame, level: float = 200.0) -> DataFrame:
    """One row per series: record_start, record_end, t_event (first time at which value reaches level, else null) and
    stratum. Aggregated before its shuffle."""
    t = seconds("ts")
    return events.groupBy(F.col("user_id").alias("series_id")).agg(F.min(t).alias("record_start"), F.max(t).alias("record_end"), F.min(F.when(F.col("value") >= level, t)).alias("t_event"), (F.first("user_id") % 3).alias("stratum"))


def level_scores(events: DataFrame, method: str = "level") -> DataFrame:
    """scores(method, series_id, t, score) in which the value itself is the score."""
    return events.select(F.lit(method).alias("method"), F.col("user_id").alias("series_id"), seconds("ts").alias("t"), F.col("value").alias("score"))


SAMPLES_SQL = f"""samples AS (
  SELECT series_id, i, t, x, coalesce(CASE WHEN t > pt THEN (x - px) / (t - pt) END, 0.0) AS dx FROM (
    SELECT user_id AS series_id, CAST(row_number() OVER w - 1 AS INTEGER) AS i, s AS t, value AS x, lag(value) OVER w AS px, lag(s) OVER w AS pt
    FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '{EPOCH}')) / 1e6 AS s FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""
UNITS_SQL = """units AS (
  SELECT series_id, min(t) AS record_start, max(t) AS record_end, min(CASE WHEN x >= 200 THEN t END) AS t_event, series_id % 3 AS stratum
  FROM samples GROUP BY series_id)"""
SCORES_SQL = "scores AS (SELECT 'level' AS method, series_id, t, x AS score FROM samples)"
