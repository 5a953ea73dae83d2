"""Queries over arrays, fitted models and medoids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import fits, signal
from tidewatch.operators import windows as wi
from tidewatch.plans.event_queries import DAY, SAMPLES_SQL, UNITS_SQL, views
from tidewatch.plans.registry import query
from tidewatch.plans.window_queries import LENGTH, all_windows
from tidewatch.sources.tables import read

DT = DAY / 2


def long_windows(spark, sf_dir):
    return wi.windows(wi.to_series(views(spark, sf_dir)[0]), 40, 10)


@query()
def band_power_score(spark, sf_dir):
    return signal.band_power_score(long_windows(spark, sf_dir), 4).select("series_id", "i_end", "band_power")


@query()
def envelope_features(spark, sf_dir):
    return signal.envelope_features(long_windows(spark, sf_dir)).drop("w", "wdx", "t_end")


@query()
def dominant_period(spark, sf_dir):
    return signal.dominant_period(long_windows(spark, sf_dir), DT, 4 * DT).select("series_id", "i_end", "period")


@query()
def engineered_features(spark, sf_dir):
    return signal.engineered_features(long_windows(spark, sf_dir), DT, 4 * DT, 20.0, 40, 200.0, 0.001, 50.0).drop("w", "wdx", "t_end")


FRAME = f"PARTITION BY series_id ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW"


@query(f"""WITH {SAMPLES_SQL}, f AS (SELECT series_id, i, x, count(*) OVER w AS have, regr_slope(x, i) OVER w AS b, avg(x) OVER w AS m, avg(i) OVER w AS im, var_samp(x) OVER w AS vx, var_samp(i) OVER w AS vi FROM samples WINDOW w AS ({FRAME}))
SELECT series_id, i AS i_end, (x - m - b * (i - im)) / greatest(sqrt(vx - b * b * vi), 1e-12) AS z FROM f WHERE have = {LENGTH} AND (i - {LENGTH - 1}) % 3 = 0""", "z")
def window_normalize(spark, sf_dir):
    w, _ = all_windows(spark, sf_dir)
    return signal.window_normalize(w).select("series_id", "i_end", F.get("w", F.lit(LENGTH - 1)).alias("z"))


@query(f"""WITH {SAMPLES_SQL}, l AS (SELECT series_id, i, x, lag(x) OVER (PARTITION BY series_id ORDER BY i) AS px FROM samples),
f AS (SELECT series_id, i, count(*) OVER w AS have, var_samp(x) OVER w AS variance, corr(x, px) OVER p AS ac1 FROM l WINDOW w AS ({FRAME}), p AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN {LENGTH - 2} PRECEDING AND CURRENT ROW))
SELECT series_id, i AS i_end, variance, CASE WHEN isnan(ac1) THEN 0.0 ELSE coalesce(ac1, 0.0) END AS ac1 FROM f WHERE have = {LENGTH} AND (i - {LENGTH - 1}) % 3 = 0""", "variance ac1")
def window_moments(spark, sf_dir):
    return signal.window_moments(all_windows(spark, sf_dir)[0]).select("series_id", "i_end", "variance", "ac1")


@query()
def decorrelation_time(spark, sf_dir):
    return signal.decorrelation_time(wi.to_series(views(spark, sf_dir)[0]), DT)


@query()
def decorrelation_by_method(spark, sf_dir):
    return signal.decorrelation_by_method(views(spark, sf_dir)[2], DT)


@query()
def wave_groups(spark, sf_dir):
    return signal.wave_groups(wi.to_series(views(spark, sf_dir)[0]), 150.0, 2 * DT, DT)


@query()
def describe_groups(spark, sf_dir):
    return signal.describe_groups(wi.to_series(views(spark, sf_dir)[0]), DT, 200.0, 2 * DT, 0.75, 1.0)


@query(f"""WITH {SAMPLES_SQL}, c AS (SELECT series_id, i, x - avg(x) OVER (PARTITION BY series_id) AS c FROM samples), v AS (SELECT series_id, sum(c * c) AS v FROM c GROUP BY 1),
p AS (SELECT a.series_id, b.i - a.i AS lag, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.series_id = b.series_id AND b.i - a.i IN (1, 2, 4, 8) GROUP BY 1, 2)
SELECT CAST(lag AS INTEGER) AS lag, avg(s / v) AS acf, count(*) AS n FROM p JOIN v USING (series_id) WHERE v > 0 GROUP BY lag""", "acf")
def ensemble_acf(spark, sf_dir):
    return signal.ensemble_acf(wi.to_series(views(spark, sf_dir)[0]), [1, 2, 4, 8])


@query(f"""WITH {SAMPLES_SQL}, c AS (SELECT series_id, i, x - avg(x) OVER (PARTITION BY series_id) AS c FROM samples), v AS (SELECT series_id, sum(c * c) AS v FROM c GROUP BY 1),
p AS (SELECT a.series_id, b.i - a.i AS lag, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.series_id = b.series_id AND b.i - a.i IN (1, 2, 4, 8) GROUP BY 1, 2),
r AS (SELECT lag, avg(s / v) AS acf FROM p JOIN v USING (series_id) WHERE v > 0 GROUP BY lag), m AS (SELECT r.acf - pow(one.acf, r.lag) AS d FROM r, (SELECT acf FROM r WHERE lag = 1) one)
SELECT max(abs(d)) AS largest, sqrt(avg(d * d)) AS rmse FROM m""", "largest rmse")
def acf_error(spark, sf_dir):
    """How far the curve of all series is from a geometric one of the same first lag."""
    curve = signal.ensemble_acf(wi.to_series(views(spark, sf_dir)[0]), [1, 2, 4, 8])
    first = curve.where("lag = 1").select(F.col("acf").alias("one"))
    return signal.acf_error(curve, curve.select("lag").crossJoin(first).select("lag", F.pow("one", "lag").alias("acf")))


@query()
def crossing_rates(spark, sf_dir):
    series = wi.to_series(views(spark, sf_dir)[0]).withColumn("stratum", F.col("series_id") % 3)
    return signal.crossing_rates(series, 1.0, ["stratum"])


@query(f"""WITH {SAMPLES_SQL}, n AS (SELECT *, CASE WHEN t < {15 * DAY} THEN 'before' ELSE 'after' END AS side FROM samples WHERE t >= {10 * DAY} AND t < {20 * DAY}),
u AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY series_id, side ORDER BY i) < 50 AND x >= 50 THEN 1 ELSE 0 END AS up FROM n)
SELECT series_id, side, count(*) AS n, var_samp(x) AS variance, CAST(sum(up) AS BIGINT) AS n_up FROM u GROUP BY 1, 2""", "variance")
def step_stats(spark, sf_dir):
    return signal.step_stats(views(spark, sf_dir)[0], 15 * DAY, 5 * DAY, 50.0)


def tops(spark, sf_dir):
    s = views(spark, sf_dir)[0]
    top = F.max("x").over(Window.partitionBy("series_id").orderBy("i").rowsBetween(-5, 0))
    return wi.forecast_samples(s, [DAY], step=2).join(s.select("series_id", "i", "dx", top.alias("top")), ["series_id", "i"])


@query()
def fit_envelope(spark, sf_dir):
    return fits.fit_envelope(tops(spark, sf_dir), [0.5, 0.9, 0.95])


@query()
def fit_linear_quantile(spark, sf_dir):
    rows = tops(spark, sf_dir).select((F.col("top") / 100).alias("top"), (F.col("target") / 100).alias("target"))
    got = fits.fit_linear_quantile(rows, ["top"], "target", [0.5, 0.9])
    values = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.lit(b[0]).alias("intercept"), F.lit(b[1]).alias("slope")) for q, b in got.items())))
    return rows.withColumn("f", values).select("f.*", (F.col("target") > F.col("f.intercept") + F.col("f.slope") * F.col("top")).alias("over")).groupBy("q", "intercept", "slope").agg(F.avg(F.col("over").cast("double")).alias("share_over"))


def labelled_features(spark, sf_dir):
    from tidewatch.operators import scores as sc

    w, u = all_windows(spark, sf_dir)
    return wi.label_windows(sc.summary_features(w), u, 3 * DAY, DAY).select("series_id", "i_end", "label", "top_12", "top_1", "rms_x")


@query()
def fit_logistic(spark, sf_dir):
    return fits.fit_logistic(labelled_features(spark, sf_dir), ["top_1", "rms_x"], "label", 1.0)[1].select("series_id", "i_end", "label", "p")


@query()
def fit_trees(spark, sf_dir):
    return fits.fit_trees(labelled_features(spark, sf_dir), ["top_12", "top_1", "rms_x"], "label", rounds=5)[1].select("series_id", "i_end", "label", "p")


@query()
def medoids(spark, sf_dir):
    return fits.medoids(read(spark, sf_dir, "embeddings").where("embedding is not null"), "vec_id", "embedding", 5)


@query(f"""WITH {SAMPLES_SQL}, {UNITS_SQL}, e AS (SELECT series_id AS entry_id, stratum AS kind, 100.0 + series_id % 50 AS critical FROM units), g AS (SELECT series_id AS group_id, series_id % 3 AS kind, max(x) AS height FROM samples WHERE series_id % 5 = 0 GROUP BY 1, 2)
SELECT kind, multiplier, count(*) AS n, CAST(sum(CASE WHEN height * multiplier >= critical THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM e JOIN g USING (kind) CROSS JOIN (SELECT unnest([0.25, 0.5, 1.0]::DOUBLE[]) AS multiplier) GROUP BY 1, 2""", "multiplier")
def trial_grid(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    entries = u.select(F.col("series_id").alias("entry_id"), F.col("stratum").alias("kind"), (100.0 + F.col("series_id") % 50).alias("critical"))
    groups = s.where("series_id % 5 = 0").groupBy(F.col("series_id").alias("group_id"), (F.col("series_id") % 3).alias("kind")).agg(F.max("x").alias("height"))
    out = fits.trial_grid(entries, groups, [0.25, 0.5, 1.0])
    return out.groupBy("kind", "multiplier").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))


@query(f"""WITH {SAMPLES_SQL}, {UNITS_SQL}, e AS (SELECT series_id AS entry_id, stratum AS kind, 100.0 + series_id % 50 AS critical FROM units), g AS (SELECT series_id AS group_id, series_id % 3 AS kind, max(x) AS height FROM samples GROUP BY 1, 2)
SELECT kind, multiplier, count(*) AS n, CAST(sum(CASE WHEN height * multiplier >= critical THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM e JOIN g USING (kind) CROSS JOIN (SELECT unnest([0.25, 0.5, 1.0]::DOUBLE[]) AS multiplier) GROUP BY 1, 2""", "multiplier")
def trial_grid_all(spark, sf_dir):
    """trial_grid takes a fifth of the series as groups, as its SQL does; here all are."""
    s, u, _ = views(spark, sf_dir)
    entries = u.select(F.col("stratum").alias("kind"), (100.0 + F.col("series_id") % 50).alias("critical"))
    groups = s.groupBy("series_id", (F.col("series_id") % 3).alias("kind")).agg(F.max("x").alias("height"))
    return fits.trial_counts(entries, groups, [0.25, 0.5, 1.0])
