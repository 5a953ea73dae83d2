"""Queries that score windows and samples, and conformal calibration over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import conformal as co
from tidewatch.operators import metrics as me
from tidewatch.operators import scores as sc
from tidewatch.operators import windows as wi
from tidewatch.plans.event_queries import DAY, SAMPLES_SQL, UNITS_SQL, views
from tidewatch.plans.registry import query
from tidewatch.plans.window_queries import ENDS_SQL, FORECASTS_SQL, LENGTH, WITH, all_windows
from tidewatch.sources.tables import read

FRAME = "PARTITION BY series_id ORDER BY i ROWS BETWEEN {0} PRECEDING AND CURRENT ROW"


@query(f"""WITH {SAMPLES_SQL}, f AS (SELECT series_id, i, t, max(abs(x)) OVER w1 AS top_12, max(abs(x)) OVER w3 AS top_4, max(abs(x)) OVER w6 AS top_2, max(abs(x)) OVER w12 AS top_1,
  sqrt(avg(x * x) OVER w12) AS rms_x, sqrt(avg(dx * dx) OVER w12) AS rms_dx, max(abs(dx)) OVER w12 AS top_dx, x - first_value(x) OVER w12 AS change, count(*) OVER w12 AS have FROM samples
  WINDOW w1 AS ({FRAME.format(0)}), w3 AS ({FRAME.format(2)}), w6 AS ({FRAME.format(5)}), w12 AS ({FRAME.format(11)}))
SELECT series_id, i AS i_end, top_12, top_4, top_2, top_1, rms_x, rms_dx, top_dx, change FROM f WHERE have = 12 AND (i - 11) % 3 = 0""", "top_12 top_4 top_2 top_1 rms_x rms_dx top_dx change")
def summary_features(spark, sf_dir):
    w, _ = all_windows(spark, sf_dir)
    return sc.summary_features(w).drop("t_end", "w", "wdx")


def ews_sql(width: int, stops: list[int]) -> str:
    parts = ", ".join(f"(SELECT var_samp(x) FROM samples s WHERE s.series_id = e.series_id AND s.i BETWEEN e.i - {LENGTH} + {s} - {width} + 1 AND e.i - {LENGTH} + {s}) AS v{k}" for k, s in enumerate(stops))
    pairs = [(a, b) for a in range(len(stops)) for b in range(a + 1, len(stops))]
    total = " + ".join(f"sign(v{b} - v{a})" for a, b in pairs)
    untied = " + ".join(f"abs(sign(v{b} - v{a}))" for a, b in pairs)
    return f"{WITH}, {ENDS_SQL}, v AS (SELECT e.series_id, e.i AS i_end, {parts} FROM ends e) SELECT series_id, i_end, CASE WHEN ({untied}) > 0 THEN ({total}) / sqrt({float(len(pairs))} * ({untied})) ELSE 0.0 END AS ews FROM v"


@query(ews_sql(6, [6, 7, 8, 9, 10, 11, 12]), "ews")
def ews_score(spark, sf_dir):
    w, _ = all_windows(spark, sf_dir)
    return sc.ews_score(w, "variance", 0.5, 12, LENGTH).select("series_id", "i_end", "ews")


@query()
def ews_ac1_score(spark, sf_dir):
    w, _ = all_windows(spark, sf_dir)
    return sc.ews_score(w, "ac1", 0.5, 12, LENGTH).select("series_id", "i_end", "ews")


@query(f"{WITH}, {ENDS_SQL} SELECT e.series_id, e.i AS i_end, -CAST(count(s.i) AS DOUBLE) AS neighbor FROM ends e LEFT JOIN samples s ON s.series_id = e.series_id AND s.i BETWEEN e.i - {LENGTH - 1} AND e.i - 3 AND sqrt((s.x - e.x) * (s.x - e.x) + (s.dx - e.dx) * (s.dx - e.dx)) <= 20 GROUP BY e.series_id, e.i", "neighbor")
def neighbor_score(spark, sf_dir):
    w, _ = all_windows(spark, sf_dir)
    return sc.neighbor_score(w, 20.0, 3).select("series_id", "i_end", "neighbor")


MARGIN_SQL = "margins AS (SELECT series_id, i, t, least(0.001 * greatest(200 - (x - 50), 0.0) - dx, 0.001 * greatest(200 + (x - 50), 0.0) + dx) AS margin FROM samples)"


def margins(spark, sf_dir):
    return sc.danger_score(views(spark, sf_dir)[0], 200.0, 0.001, 50.0)


@query(f"{WITH}, {MARGIN_SQL} SELECT series_id, i, t, margin, -margin AS danger FROM margins", "t margin danger")
def danger_score(spark, sf_dir):
    return margins(spark, sf_dir)


@query(f"{WITH}, {MARGIN_SQL}, c AS (SELECT series_id, i, margin, -((margin - lag(margin, 4) OVER w) / (t - lag(t, 4) OVER w)) AS closure FROM margins WINDOW w AS (PARTITION BY series_id ORDER BY i)) SELECT series_id, i, closure, CASE WHEN round(closure, 12) > 0 THEN round(margin / closure, 2) END AS time_to_closure FROM c", "closure")
def margin_dynamics(spark, sf_dir):
    out = sc.margin_dynamics(margins(spark, sf_dir), 4)
    return out.select("series_id", "i", "closure", F.when(F.round("closure", 12) > 0, F.round("time_to_closure", 2)).alias("time_to_closure"))


@query(f"{WITH} SELECT s.series_id, s.t, CAST(least(floor(4 * (s.t - record_start) / nullif(record_end - record_start, 0)), 3) AS INTEGER) AS quarter FROM samples s JOIN units u USING (series_id)", "t")
def clock_score(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    return sc.clock_score(s.select("series_id", "t"), u)


@query(f"WITH {SAMPLES_SQL} SELECT series_id, i, sqrt(avg(x * x) OVER (PARTITION BY series_id ORDER BY CAST(round(t * 1e6) AS BIGINT) RANGE BETWEEN {round(DAY * 1e6)} PRECEDING AND CURRENT ROW)) AS rms FROM samples", "rms")
def trailing_rms(spark, sf_dir):
    return sc.trailing_rms(views(spark, sf_dir)[0], DAY)


@query(f"WITH {SAMPLES_SQL}, m AS (SELECT series_id, i, avg(x) OVER ({FRAME.format(4)}) AS moment FROM samples) SELECT series_id, i, moment, moment - lag(moment) OVER (PARTITION BY series_id ORDER BY i) AS change FROM m", "moment change")
def local_moment(spark, sf_dir):
    return sc.local_moment(views(spark, sf_dir)[0], 5)


@query(f"WITH {SAMPLES_SQL}, c AS (SELECT series_id, i, CASE WHEN lag(x) OVER w < 50 AND x >= 50 THEN t END AS c FROM samples WINDOW w AS (PARTITION BY series_id ORDER BY i)) SELECT series_id, i, CASE WHEN count(c) OVER w > 1 THEN round((max(c) OVER w - min(c) OVER w) / (count(c) OVER w - 1), 3) END AS period FROM c WINDOW w AS (PARTITION BY series_id ORDER BY i)", "period")
def period_scale(spark, sf_dir):
    return sc.period_scale(views(spark, sf_dir)[0], 50.0).withColumn("period", F.round("period", 3))


#: Forecasts of the largest value of the next day: 1.5 times that of the last six samples. Series of stratum 0 calibrate.
BOUNDS_SQL = f"""{FORECASTS_SQL}, tops AS (SELECT series_id, i, max(x) OVER ({FRAME.format(5)}) AS top FROM samples),
bounded AS (SELECT f.series_id, f.i, f.t, 1.5 * top AS bound, f.target, f.series_id % 3 AS stratum FROM usable f JOIN tops USING (series_id, i) WHERE horizon = {DAY})"""
LEVELS_SQL = "levels AS (SELECT stratum, target - bound AS s, row_number() OVER (PARTITION BY stratum ORDER BY target - bound) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM bounded)"


def bounded(spark, sf_dir):
    s = views(spark, sf_dir)[0]
    from pyspark.sql import Window

    top = F.max("x").over(Window.partitionBy("series_id").orderBy("i").rowsBetween(-5, 0))
    return wi.forecast_samples(s, [DAY], step=2).join(s.select("series_id", "i", (1.5 * top).alias("bound")), ["series_id", "i"]).select("series_id", "i", "t", "bound", "target", (F.col("series_id") % 3).alias("stratum"))


ALPHAS = (0.05, 0.1, 0.2)


@query(f"""{WITH}, {BOUNDS_SQL}, {LEVELS_SQL}, a AS (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS alpha)
SELECT stratum, alpha, any_value(n) AS n, coalesce(max(CASE WHEN k = ceil(round((n + 1) * (1 - alpha), 9)) THEN s END), 'infinity'::DOUBLE) AS quantile FROM levels CROSS JOIN a GROUP BY stratum, alpha""", "alpha quantile")
def conformal_quantile(spark, sf_dir):
    return co.conformal_quantile(bounded(spark, sf_dir).withColumn("score", F.col("target") - F.col("bound")), list(ALPHAS), ["stratum"])


SPLIT_SQL = f"""{BOUNDS_SQL}, {LEVELS_SQL}, a AS (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS alpha),
q AS (SELECT alpha, max(CASE WHEN k = ceil(round((n + 1) * (1 - alpha), 9)) THEN s END) AS quantile FROM levels CROSS JOIN a WHERE stratum = 0 GROUP BY alpha),
test AS (SELECT b.series_id, b.i, b.t, alpha, bound + quantile AS upper, CASE WHEN target > bound + quantile THEN 1 ELSE 0 END AS miss FROM bounded b CROSS JOIN q WHERE stratum <> 0)"""


def split(spark, sf_dir):
    b = bounded(spark, sf_dir)
    return co.split_bounds(b.where("stratum = 0"), b.where("stratum <> 0"), list(ALPHAS))


@query(f"{WITH}, {SPLIT_SQL} SELECT series_id, i, alpha, upper, miss FROM test", "alpha upper")
def split_cqr(spark, sf_dir):
    return split(spark, sf_dir).select("series_id", "i", "alpha", "upper", "miss")


@query(f"{WITH}, {SPLIT_SQL} SELECT alpha, count(*) AS n, 1 - avg(miss) AS coverage FROM test GROUP BY alpha", "alpha coverage")
def coverage_table(spark, sf_dir):
    return split(spark, sf_dir).groupBy("alpha").agg(F.count("*").alias("n"), (1 - F.avg("miss")).alias("coverage"))


CELLS_SQL = f"{SPLIT_SQL}, cells AS (SELECT series_id % 3 AS stratum, alpha, count(*) AS n, CAST(sum(1 - miss) AS BIGINT) AS covered, 1 - avg(miss) AS coverage, 1 - avg(miss) - (1 - alpha) AS error FROM test GROUP BY 1, 2)"


def cells(spark, sf_dir):
    return me.coverage_cells(split(spark, sf_dir).withColumn("stratum", F.col("series_id") % 3), ["stratum"])


@query(f"{WITH}, {CELLS_SQL} SELECT * FROM cells", "alpha coverage error")
def coverage_cells(spark, sf_dir):
    return cells(spark, sf_dir).drop("lo", "hi")


@query()
def coverage_cell_bands(spark, sf_dir):
    """coverage_cells with the exact intervals, which SQL lacks."""
    return cells(spark, sf_dir)


@query(f"""{WITH}, {CELLS_SQL} SELECT alpha, count(*) AS cells, avg(abs(error)) AS mean_error, max(abs(error)) AS max_error,
arg_max(stratum, ROW(round(abs(error), 9), -stratum)) AS worst_stratum FROM cells GROUP BY alpha""", "alpha mean_error max_error")
def coverage_errors(spark, sf_dir):
    return me.coverage_errors(cells(spark, sf_dir), ["stratum"], ["alpha"])


ROLLING_SQL = f"""{SPLIT_SQL}, days AS (SELECT floor(t / {DAY}) AS t, sum(miss) AS m, count(*) AS n FROM test WHERE round(alpha, 6) = 0.1 GROUP BY 1),
rolling AS (SELECT t, 1 - sum(m) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS coverage FROM days WINDOW w AS (ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""


def rolling(spark, sf_dir):
    rows = split(spark, sf_dir).where("round(alpha, 6) = 0.1").select(F.floor(F.col("t") / DAY).cast("double").alias("t"), "miss")
    return me.rolling_coverage(rows)


@query(f"{WITH}, {ROLLING_SQL} SELECT * FROM rolling", "t coverage")
def rolling_coverage(spark, sf_dir):
    return rolling(spark, sf_dir)


@query(f"{WITH}, {ROLLING_SQL}, ok AS (SELECT t, min(CASE WHEN abs(coverage - 0.9) <= 0.05 THEN 1 ELSE 0 END) OVER w AS held, count(*) OVER w AS rest FROM rolling WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT min(t) - 3 AS recovery FROM ok WHERE held = 1 AND rest >= 3 AND t >= 3", "recovery")
def recovery_time(spark, sf_dir):
    return me.recovery_time(rolling(spark, sf_dir), 3.0, 0.9, 0.05)


@query()
def aci(spark, sf_dir):
    b = bounded(spark, sf_dir)
    return co.aci(b.where("stratum <> 0"), b.where("stratum = 0"), 0.1, 0.02, 2).select("series_id", "t", "level", "upper", "miss")


def pairs(spark, sf_dir):
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"), (1.0 + F.col("doc_id") % 3).cast("double").alias("w"))


PAIRS_SQL = "pairs AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score, least(n_chars / 5000.0, 1.0) AS p, CAST(1.0 + doc_id % 3 AS DOUBLE) AS w FROM labels JOIN documents USING (doc_id))"
BINS_SQL = "bins AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, sum(w) AS weight, sum(w * p) / sum(w) AS predicted, sum(w * label) / sum(w) AS observed FROM pairs GROUP BY 1)"


@query(f"WITH {PAIRS_SQL}, {BINS_SQL} SELECT * FROM bins", "weight predicted observed")
def calibration_bins(spark, sf_dir):
    return me.calibration_bins(pairs(spark, sf_dir))


@query(f"WITH {PAIRS_SQL}, {BINS_SQL} SELECT (SELECT sum(w * (p - label) * (p - label)) / sum(w) FROM pairs) AS brier, (SELECT sum(weight * abs(predicted - observed)) / sum(weight) FROM bins) AS ece", "brier ece")
def calibration(spark, sf_dir):
    return me.calibration(pairs(spark, sf_dir))


@query("WITH " + PAIRS_SQL + " SELECT CAST(auc AS DOUBLE) AS auc FROM (SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT score AS s, sum(CASE WHEN label = 1 THEN 1.0 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1.0 ELSE 0 END) AS neg FROM pairs GROUP BY 1)))", "auc")
def label_auc(spark, sf_dir):
    return me.auc(pairs(spark, sf_dir))


@query(f"WITH {SAMPLES_SQL}, {UNITS_SQL} SELECT stratum, count(d) AS n, avg(d) AS mean, min(d) AS low, quantile_cont(d, 0.25) AS q25, quantile_cont(d, 0.5) AS q50, quantile_cont(d, 0.75) AS q75, max(d) AS high FROM (SELECT stratum, t_event - record_start AS d FROM units) GROUP BY stratum", "mean low q25 q50 q75 high")
def describe5(spark, sf_dir):
    return me.describe5(views(spark, sf_dir)[1].withColumn("d", F.col("t_event") - F.col("record_start")), "d", ["stratum"])


@query()
def sliding_aci(spark, sf_dir):
    b = bounded(spark, sf_dir)
    return co.sliding_aci(b.where("stratum <> 0"), b.where("stratum = 0"), 0.1, 0.02, 200, 2).select("series_id", "t", "level", "upper", "miss")


@query()
def dtaci(spark, sf_dir):
    b = bounded(spark, sf_dir)
    return co.dtaci(b.where("stratum <> 0"), b.where("stratum = 0"), 0.1, [0.001 * 2**k for k in range(8)], delay=2).select("series_id", "t", "level", "upper", "miss")
