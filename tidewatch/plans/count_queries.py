"""Queries of exact intervals, count rates, bootstraps, curves, histories and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import counts as co
from tidewatch.operators import dataset as da
from tidewatch.operators import events as ev
from tidewatch.operators import metrics as me
from tidewatch.operators import rates as ra
from tidewatch.operators import resampling as re_
from tidewatch.operators import scores as sc
from tidewatch.operators import signal as si
from tidewatch.operators import studies as st
from tidewatch.operators import windows as wi
from tidewatch.plans.event_queries import ALARM, AUC_SQL, CURVE_SQL, DAY, DRAWS_SQL, LABELS_SQL, SAMPLES_SQL, UNITS_SQL, WITH_BASE, WITH_CROSSINGS, contribution, contributions_sql, curve, find_crossings, labelled, views
from tidewatch.plans.rate_queries import EMISSIONS_SQL, EXPECTED_SQL, STEP, emitted, expected, kept
from tidewatch.plans.rate_queries import WITH as WITH_KEPT
from tidewatch.plans.registry import query
from tidewatch.plans.study_queries import OBSERVED_SQL, VARIANCE_SQL, observed, variances

WITH = f"WITH {SAMPLES_SQL}, {UNITS_SQL}"
MICROS = "CAST(round(t * 1e6) AS BIGINT)"
BINOMIAL = "list_sum(list_transform(range(m, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(mid) + (n - j) * ln(1 - mid))))"
POISSON = "1 - coalesce(list_sum(list_transform(range(0, m), lambda j: exp(j * ln(mid) - mid - lgamma(j + 1)))), 0)"


def recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.strip().removeprefix("WITH")


def bounds_sql(source: str, name: str, tail: str, top: str, full: str) -> str:
    """CTEs that bisect for the exact bounds lo and hi of source(key, k, n): `tail` is P(count >= m) at mid."""
    return f"""{name}_b AS (SELECT key, side, m, n, target, 0.0::DOUBLE AS lo, CAST({top} AS DOUBLE) AS hi, 0 AS it FROM (
  SELECT key, k, k AS m, n, 0.025 AS target, 'lo' AS side FROM {source} WHERE k > 0 UNION ALL SELECT key, k, k + 1, n, 0.975, 'hi' FROM {source} WHERE {full})
  UNION ALL SELECT key, side, m, n, target, CASE WHEN tail < target THEN mid ELSE lo END, CASE WHEN tail < target THEN hi ELSE mid END, it + 1 FROM (SELECT *, {tail} AS tail FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_b WHERE it < 60))),
{name} AS (SELECT s.key, coalesce(max(CASE WHEN side = 'lo' THEN (lo + hi) / 2 END), 0.0) AS lo, coalesce(max(CASE WHEN side = 'hi' THEN (lo + hi) / 2 END), 1.0) AS hi FROM {source} s LEFT JOIN {name}_b b ON b.key IS NOT DISTINCT FROM s.key AND it = 60 GROUP BY s.key)"""


def share_sql(source: str, name: str) -> str:
    return bounds_sql(source, name, BINOMIAL, "1.0", "k < n")


def count_sql(source: str, name: str) -> str:
    return bounds_sql(source, name, POISSON, "k + 10 * sqrt(k + 1) + 20", "true")


@query(recursive(f"{WITH}, g AS (SELECT stratum AS key, count(t_event) AS k, count(*) AS n FROM units GROUP BY 1), {share_sql('g', 'b')} SELECT key AS stratum, k AS hits, n, lo, hi FROM g JOIN b USING (key)"), "lo hi")
def proportion_exact(spark, sf_dir):
    return re_.proportion_ci(views(spark, sf_dir)[1].withColumn("hit", F.col("t_event").isNotNull()), ["stratum"], "hit")


@query(recursive(f"{WITH}, g AS (SELECT stratum AS key, count(t_event) AS k, 0 AS n, sum(coalesce(t_event, record_end) - record_start) / 3600 AS hours FROM units GROUP BY 1), {count_sql('g', 'b')} SELECT key AS stratum, k AS events, hours, k / hours AS rate, lo / hours AS lo, hi / hours AS hi FROM g JOIN b USING (key)"), "hours rate lo hi")
def rate_exact(spark, sf_dir):
    u = views(spark, sf_dir)[1].withColumns({"hit": F.col("t_event").isNotNull(), "hours": (F.coalesce("t_event", "record_end") - F.col("record_start")) / 3600})
    return re_.rate_ci(u, ["stratum"], "hit", "hours").withColumnRenamed("exposure", "hours")


@query(recursive(f"""{WITH_BASE}, level AS (SELECT series_id, t, score FROM scores), {contributions_sql('level', '', str(ALARM))},
c AS (SELECT stratum AS key, CAST(sum(observable) AS BIGINT) AS events, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(false_episodes) AS BIGINT) AS false_episodes, sum(exposure) / 3600 AS hours FROM contributions GROUP BY 1),
g AS (SELECT key, detected AS k, events AS n FROM c), f AS (SELECT key, false_episodes AS k, 0 AS n FROM c), {share_sql('g', 'a')}, {count_sql('f', 'b')}
SELECT key AS stratum, events, detected, CASE WHEN events > 0 THEN detected / events END AS sensitivity, CASE WHEN events > 0 THEN a.lo END AS sensitivity_lo, CASE WHEN events > 0 THEN a.hi END AS sensitivity_hi, false_episodes / hours AS false_per_hour, b.lo / hours AS false_lo, b.hi / hours AS false_hi FROM c JOIN a USING (key) JOIN b USING (key)"""), "sensitivity sensitivity_lo sensitivity_hi false_per_hour false_lo false_hi")
def alarm_intervals(spark, sf_dir):
    return co.alarm_intervals(contribution(spark, sf_dir), ["stratum"])


@query(recursive(f"""{WITH}, r AS (SELECT stratum AS key, CASE WHEN x > 150 THEN 1 ELSE 0 END AS miss FROM samples JOIN units USING (series_id) WHERE t >= {5 * DAY} AND t < {15 * DAY}),
g AS (SELECT key, CAST(sum(1 - miss) AS BIGINT) AS k, count(*) AS n FROM r GROUP BY 1), {share_sql('g', 'b')} SELECT key AS stratum, n, k AS covered, k / n AS share, lo, hi FROM g JOIN b USING (key)"""), "share lo hi")
def coverage_region(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    rows = s.join(u.select("series_id", "stratum"), "series_id").select("stratum", "t", (F.col("x") > 150).cast("int").alias("miss"))
    return co.coverage(rows, 5 * DAY, 15 * DAY, ["stratum"])


@query(recursive(f"""{WITH_CROSSINGS}, {OBSERVED_SQL}, g AS (SELECT stratum AS key, count(*) FILTER (outcome = 'unheralded') AS k, 0 AS n, sum(exposure) / 3600 AS hours FROM observed GROUP BY 1), {count_sql('g', 'b')}
SELECT key AS stratum, k AS events, hours, k / hours AS rate, lo / hours AS lo, hi / hours AS hi FROM g JOIN b USING (key)"""), "hours rate lo hi")
def fit_intercept(spark, sf_dir):
    return co.fit_intercept(observed(spark, sf_dir), ["stratum"])


@query(f"""{WITH}, g AS (SELECT stratum, count(t_event) AS events, sum(coalesce(t_event, record_end) - record_start) / 3600 AS hours FROM units GROUP BY 1),
w AS (SELECT *, events + 0.5 AS r, hours / (hours + 720.0) AS p, unnest(range(0, 4000)) AS j FROM g),
c AS (SELECT *, sum(exp(lgamma(j + r) - lgamma(r) - lgamma(j + 1) + r * ln(p) + j * ln(1 - p))) OVER (PARTITION BY stratum ORDER BY j) AS cdf FROM w)
SELECT stratum, any_value(events) AS events, any_value(hours) AS hours, CAST(count(*) FILTER (cdf < 0.025) AS INTEGER) AS lo, CAST(count(*) FILTER (cdf < 0.975) AS INTEGER) AS hi FROM c GROUP BY stratum""", "hours")
def count_predictive(spark, sf_dir):
    u = views(spark, sf_dir)[1].withColumns({"hit": F.col("t_event").isNotNull(), "hours": (F.coalesce("t_event", "record_end") - F.col("record_start")) / 3600})
    return co.count_predictive(u, ["stratum"], "hit", "hours", future=720.0)


@query(f"""{WITH_BASE}, level AS (SELECT series_id, t, score FROM scores), {contributions_sql('level', '', str(ALARM))}, {DRAWS_SQL.format(seed=23, replicates=1000)},
sums AS (SELECT replicate, sum(false_episodes * times) AS a, sum(exposure / 3600 * times) AS b FROM draws JOIN contributions USING (series_id) GROUP BY replicate)
SELECT (SELECT sum(false_episodes) / sum(exposure / 3600) FROM contributions) AS estimate, quantile_cont(a / b, 0.025) AS lo, quantile_cont(a / b, 0.975) AS hi, count(*) AS replicates FROM sums WHERE b > 0""", "estimate lo hi")
def bootstrap_false_rate(spark, sf_dir):
    rows = contribution(spark, sf_dir).withColumn("hours", F.col("exposure") / 3600)
    return re_.bootstrap_ratio(rows, views(spark, sf_dir)[1], "false_episodes", "hours", 1000, 23)


@query(f"""{WITH_BASE}, {LABELS_SQL}, {DRAWS_SQL.format(seed=17, replicates=1000)},
summed AS (SELECT replicate, score AS s, sum(CASE WHEN label = 1 THEN times ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN times ELSE 0 END) AS neg FROM labelled JOIN draws USING (series_id) GROUP BY replicate, score),
aucs AS (SELECT replicate, CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM summed) GROUP BY replicate HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT (SELECT CAST(auc AS DOUBLE) FROM ({AUC_SQL.format(score='score', label='label', rows='labelled')})) AS estimate, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi, count(*) AS replicates FROM aucs""", "estimate lo hi")
def bootstrap_auc_full(spark, sf_dir):
    return re_.bootstrap_auc(labelled(spark, sf_dir), views(spark, sf_dir)[1], 1000, 17)


@query(f"""{WITH_KEPT}, {EMISSIONS_SQL}, {EXPECTED_SQL}, {DRAWS_SQL.format(seed=29, replicates=1000)}, own AS (SELECT u.series_id, u.stratum, e.expected AS v FROM units u JOIN expected e USING (series_id)),
sums AS (SELECT stratum, replicate, sum(v * times) AS s FROM own JOIN draws USING (series_id) GROUP BY 1, 2)
SELECT stratum, (SELECT sum(v) FROM own o WHERE o.stratum = s.stratum) AS estimate, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi, count(*) AS replicates FROM sums s GROUP BY stratum""", "estimate lo hi")
def bootstrap_total(spark, sf_dir):
    return co.bootstrap_total(expected(spark, sf_dir), views(spark, sf_dir)[1], "expected", "stratum", 1000, 29)


P_SQL = f"{WITH_BASE}, {LABELS_SQL}, p0 AS (SELECT series_id, label, round(score / (score + 100.0), 9) AS p FROM labelled), e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM p0), binned AS (SELECT p0.*, len(list_filter(q, lambda e: e <= p)) AS bin FROM p0 CROSS JOIN e)"
ERROR_SQL = "(SELECT sum(n * abs(sp / n - sy / n)) / sum(n) FROM (SELECT bin, count(*) AS n, sum(p) AS sp, sum(label) AS sy FROM binned GROUP BY bin))"


def scored(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("series_id", "label", F.round(F.col("score") / (F.col("score") + 100.0), 9).alias("p"))
    return rows, co.reliability_edges(rows, "p", 5)


@query(f"{P_SQL} SELECT bin, CAST(count(*) AS DOUBLE) AS n, avg(p) AS predicted, avg(label) AS observed, abs(avg(p) - avg(label)) AS error FROM binned GROUP BY bin", "n predicted observed error")
def reliability_table(spark, sf_dir):
    rows, edges = scored(spark, sf_dir)
    return co.reliability(rows, "p", "label", edges)


@query(f"WITH {SAMPLES_SQL}, q AS (SELECT quantile_cont(floor(x / 100), [0.2, 0.4, 0.6, 0.8]) AS q FROM samples) SELECT unnest(range(0, 6)) AS k, CAST(unnest(list_concat([-1.0], q, [2.0])) AS DOUBLE) AS edge, true AS rises FROM q", "edge")
def reliability_edges(spark, sf_dir):
    edges = co.reliability_edges(views(spark, sf_dir)[0].select(F.floor(F.col("x") / 100).cast("double").alias("p")), "p", 5)
    return spark.createDataFrame([(k, e, k == 0 or e > edges[k - 1]) for k, e in enumerate(edges)], "k long, edge double, rises boolean")


@query(f"{P_SQL} SELECT (SELECT CAST(auc AS DOUBLE) FROM ({AUC_SQL.format(score='p', label='label', rows='p0')})) AS auc, (SELECT avg((p - label) * (p - label)) FROM p0) AS brier, {ERROR_SQL} AS reliability_error", "auc brier reliability_error")
def metric_vector(spark, sf_dir):
    rows, edges = scored(spark, sf_dir)
    return co.metric_vector(rows, "p", "label", edges)


@query(f"""{P_SQL}, {DRAWS_SQL.format(seed=31, replicates=1000)}, b AS (SELECT replicate, bin, CAST(sum(times) AS DOUBLE) AS n, sum(p * times) AS sp, sum(label * times) AS sy FROM binned JOIN draws USING (series_id) GROUP BY 1, 2),
r AS (SELECT replicate, sum(abs(sp - sy)) / sum(n) AS error FROM b GROUP BY 1) SELECT {ERROR_SQL} AS estimate, quantile_cont(error, 0.025) AS lo, quantile_cont(error, 0.975) AS hi, count(*) AS replicates FROM r""", "estimate lo hi")
def bootstrap_reliability(spark, sf_dir):
    rows, edges = scored(spark, sf_dir)
    return co.bootstrap_reliability(rows, views(spark, sf_dir)[1], "p", "label", edges, 1000, 31)


@query(f"{WITH_BASE}, {LABELS_SQL}, r AS (SELECT label, -score AS score FROM labelled) SELECT CAST(greatest(auc, 1 - auc) AS DOUBLE) AS auc FROM ({AUC_SQL.format(score='score', label='label', rows='r')})", "auc")
def folded_auc(spark, sf_dir):
    return me.folded_auc(labelled(spark, sf_dir).withColumn("score", -F.col("score")))


def monotone_sql(table: str, key: str) -> str:
    """level and fit of table(key, level, n, share) by the max-min formula."""
    return f"""(SELECT c.{key}, c.level, max(least_mean) AS fit FROM {table} c JOIN (SELECT i.{key}, i.level AS lo, k.level AS at, min((SELECT sum(share * n) / sum(n) FROM {table} m WHERE m.{key} = i.{key} AND m.level BETWEEN i.level AND j.level)) AS least_mean
  FROM {table} i JOIN {table} k ON k.{key} = i.{key} AND i.level <= k.level JOIN {table} j ON j.{key} = i.{key} AND j.level >= k.level GROUP BY 1, 2, 3) x ON x.{key} = c.{key} AND x.at = c.level GROUP BY 1, 2)"""


@query(f"""{WITH_CROSSINGS}, {OBSERVED_SQL}, {DRAWS_SQL.format(seed=37, replicates=200)}, o AS (SELECT series_id, least(clusters // 3, 5) AS level, CASE WHEN outcome <> 'none' THEN 1.0 ELSE 0.0 END AS y FROM observed),
w AS (SELECT 0 AS replicate, level, count(*) AS n, avg(y) AS share FROM o GROUP BY 2), d AS (SELECT replicate, level, CAST(sum(times) AS DOUBLE) AS n, sum(y * times) / sum(times) AS share FROM o JOIN draws USING (series_id) GROUP BY 1, 2),
f AS (SELECT level, quantile_cont(fit, 0.025) AS lo, quantile_cont(fit, 0.975) AS hi FROM {monotone_sql('d', 'replicate')} GROUP BY 1)
SELECT w.level, w.n, w.share, m.fit, f.lo, f.hi FROM w JOIN {monotone_sql('w', 'replicate')} m USING (level) JOIN f USING (level)""", "share fit lo hi")
def response_curve(spark, sf_dir):
    rows = observed(spark, sf_dir).select("series_id", F.least(F.floor(F.col("clusters") / 3), F.lit(5)).cast("long").alias("level"), (F.col("outcome") != "none").cast("int").alias("hit"))
    return co.response_curve(rows, views(spark, sf_dir)[1], "level", "hit", 200, 37)


@query(f"{WITH}, q AS (SELECT stratum, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM samples JOIN units USING (series_id) GROUP BY 1) SELECT stratum, count(*) AS n, avg(CASE WHEN x BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS covered FROM samples JOIN units USING (series_id) JOIN q USING (stratum) GROUP BY 1", "covered")
def predictive_coverage(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    rows = s.join(u.select("series_id", "stratum"), "series_id")
    ends = rows.groupBy("stratum").agg(F.expr("percentile(x, array(0.1D, 0.9D))").alias("q")).select("stratum", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return co.predictive_coverage(rows.join(ends, "stratum"), "x", "lo", "hi", ["stratum"])


STEPS = [(2.0, 0.5), (6.0, 1.5), (12.0, 4.0)]


@query(f"{WITH_CROSSINGS}, {OBSERVED_SQL} SELECT series_id, clusters, rate2 AS rate, rate2 * exposure AS count FROM (SELECT *, CASE WHEN clusters >= 12 THEN 4.0 WHEN clusters >= 6 THEN 1.5 ELSE 0.5 END AS rate2 FROM observed)", "rate count")
def score_rate_map(spark, sf_dir):
    return co.score_rate_map(observed(spark, sf_dir), spark.createDataFrame(STEPS, "x double, y double"), "clusters")


@query(f"""{WITH_KEPT}, {EMISSIONS_SQL}, {VARIANCE_SQL}, l AS (SELECT series_id, arg_max(rate, t) * 3600 AS last_rate FROM emissions GROUP BY 1), c AS (SELECT series_id, count(*) AS n FROM kept GROUP BY 1)
SELECT u.series_id, t_event IS NOT NULL AS event, (coalesce(t_event, record_end) - record_start) / 3600 AS hours, coalesce(variance, 0.0) AS variance, CASE WHEN coalesce(t_event, record_end) > record_start THEN coalesce(n, 0) / ((coalesce(t_event, record_end) - record_start) / 3600) ELSE 0.0 END AS crossings_per_hour, coalesce(last_rate, 0.0) AS last_rate
FROM units u LEFT JOIN c USING (series_id) LEFT JOIN variances v USING (series_id) LEFT JOIN l USING (series_id)""", "hours variance crossings_per_hour last_rate")
def baseline_rows(spark, sf_dir):
    u = views(spark, sf_dir)[1]
    return co.baseline_rows(u, kept(spark, sf_dir), variances(spark, sf_dir), emitted(spark, sf_dir).withColumn("rate", F.col("rate") * 3600))


@query(f"""{WITH_KEPT}, {EMISSIONS_SQL}, y AS (SELECT series_id, t, CASE WHEN severity >= 1.0 THEN 0.6 WHEN severity >= 0.5 THEN 0.2 ELSE 0.1 END AS y FROM kept)
SELECT e.series_id, e.t, count(y.t) AS n, (coalesce(sum(y.y), 0) / any_value(e.exposure) + 1e-6) * 3600 AS rate FROM emissions e LEFT JOIN y ON y.series_id = e.series_id AND y.t <= e.t GROUP BY 1, 2""", "t rate")
def score_hybrid(spark, sf_dir):
    steps = spark.createDataFrame([(0.0, 0.1), (0.5, 0.2), (1.0, 0.6)], "x double, y double")
    # Many rates are halves at the seventh place but for the last bit, which rounding of decimals would tell apart
    return co.score_hybrid(kept(spark, sf_dir), emitted(spark, sf_dir), steps, 1e-6).withColumn("rate", F.round(F.col("rate") * 3600, 9))


@query(f"WITH {SAMPLES_SQL} SELECT series_id, t, x / 200.0 AS x, dx / (200.0 * 0.01) AS dx, 1.0 - 1e-7 * t AS stiffness, -1e-7 AS drift, 0.05 AS damping FROM samples", "t x dx stiffness drift damping")
def physical_state(spark, sf_dir):
    return st.physical_state(views(spark, sf_dir)[0], 200.0, 0.01, 1.0, -1e-7, {"damping": 0.05})


@query(f"{WITH} SELECT 'first' AS half, series_id FROM (SELECT *, row_number() OVER (ORDER BY series_id) AS k, count(*) OVER () AS n FROM units) WHERE k <= n // 2 UNION ALL SELECT 'second', series_id FROM (SELECT *, row_number() OVER (ORDER BY series_id) AS k, count(*) OVER () AS n FROM units) WHERE k > n // 2")
def take_half(spark, sf_dir):
    u = views(spark, sf_dir)[1].select("series_id")
    return da.take_half(u).select(F.lit("first").alias("half"), "series_id").unionByName(da.take_half(u, True).select(F.lit("second").alias("half"), "series_id"))


@query(f"""{WITH}, g AS (SELECT series_id, record_start + k * {2 * DAY} AS g FROM (SELECT *, unnest(range(1, CAST(greatest(1, floor((record_end - record_start) / {2 * DAY})) AS BIGINT) + 1)) AS k FROM units)),
v AS (SELECT g.series_id, g.g, var_samp(s.x) AS v FROM g JOIN samples s ON s.series_id = g.series_id AND {MICROS} BETWEEN CAST(round(g.g * 1e6) AS BIGINT) - {round(5 * DAY * 1e6)} AND CAST(round(g.g * 1e6) AS BIGINT) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT u.series_id, coalesce((SELECT avg(v) FROM v WHERE v.series_id = u.series_id), 0.0) AS variance FROM units u""", "variance")
def trailing_causal_variance(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    return st.mean_causal_variance(s, u, 2 * DAY, 5 * DAY)


@query(f"""WITH {SAMPLES_SQL}, c AS (SELECT *, {MICROS} AS m, CASE WHEN lag(x) OVER (PARTITION BY series_id ORDER BY i) < 50 AND x >= 50 THEN t END AS c FROM samples)
SELECT series_id, i, CASE WHEN count(c) OVER w > 1 THEN (max(c) OVER w - min(c) OVER w) / (count(c) OVER w - 1) / 3600 END AS period FROM c WINDOW w AS (PARTITION BY series_id ORDER BY m RANGE BETWEEN {round(10 * DAY * 1e6)} PRECEDING AND CURRENT ROW)""", "period")
def trailing_period_scale(spark, sf_dir):
    return sc.period_scale(views(spark, sf_dir)[0], 50.0, 10 * DAY).withColumn("period", F.col("period") / 3600)


@query(f"{WITH_CROSSINGS} SELECT series_id, side, t, i_detect, severity, CAST(cluster AS BIGINT) AS cluster, row_number() OVER (PARTITION BY series_id, cluster ORDER BY severity DESC, t, i_detect) = 1 AS retained FROM chains", "t severity")
def cluster_members(spark, sf_dir):
    return ev.cluster_members(find_crossings(spark, sf_dir), DAY).select("series_id", "side", "t", "i_detect", "severity", F.col("cluster").cast("long").alias("cluster"), "retained")


@query(f"""{WITH_KEPT}, {EMISSIONS_SQL} SELECT e.series_id, e.t, count(c.t) AS n, max(c.severity) AS severity FROM emissions e LEFT JOIN crossings c ON c.series_id = e.series_id AND CAST(round(c.t * 1e6) AS BIGINT) BETWEEN CAST(round(e.t * 1e6) AS BIGINT) - {round(4 * STEP * 1e6)} AND CAST(round(e.t * 1e6) AS BIGINT) GROUP BY 1, 2""", "t severity")
def history_counts(spark, sf_dir):
    return ra.history_counts(find_crossings(spark, sf_dir), emitted(spark, sf_dir), 4 * STEP)


@query(f"""{WITH}, f AS ({' UNION ALL '.join(f"SELECT series_id, i, t, {h} AS horizon, coalesce(max(abs(x)) OVER (PARTITION BY series_id ORDER BY {MICROS} RANGE BETWEEN 1 FOLLOWING AND {round(h * 1e6)} FOLLOWING), 0.0) AS target FROM samples" for h in (DAY, 3 * DAY))}),
k AS (SELECT s.series_id, s.i, u.t_event, row_number() OVER (PARTITION BY s.series_id ORDER BY s.i) AS k FROM samples s JOIN units u USING (series_id) WHERE s.i >= 5 AND (s.i - 5) % 2 = 0 AND s.t + {3 * DAY} <= record_end AND (t_event IS NULL OR s.t < t_event))
SELECT f.series_id, f.i, f.t, f.horizon, CASE WHEN t_event > f.t AND t_event - f.t <= f.horizon THEN greatest(target, 300.0) ELSE target END AS target FROM f JOIN k ON k.series_id = f.series_id AND k.i = f.i WHERE k.k <= 10""", "t horizon target")
def forecast_histories(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    return wi.forecast_histories(s, u, [DAY, 3 * DAY], 6, 2, 300.0, most=10)


@query()
def spectral_distortion(spark, sf_dir):
    s = wi.to_series(views(spark, sf_dir)[0]).select("series_id", "x")
    return si.spectral_distortion(s, s.withColumn("x", F.transform("x", lambda v, i: v + F.pmod(i, F.lit(2)) * 20.0)), 1.0, 8.0)


@query(f"WITH {SAMPLES_SQL} SELECT series_id, arg_min(x, CASE WHEN t >= {10 * DAY} THEN i END) - arg_max(x, CASE WHEN t < {10 * DAY} THEN i END) AS jump FROM samples GROUP BY 1", "jump")
def step_jump(spark, sf_dir):
    return si.step_jump(views(spark, sf_dir)[0], 10 * DAY)


@query(f"WITH {SAMPLES_SQL}, b AS (SELECT series_id, t, x, avg(x) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p FROM samples) SELECT CAST(floor(t / {5 * DAY}) AS BIGINT) AS bin, count(*) AS n, avg(p) AS predicted, avg(x) AS truth, avg(abs(p - x)) AS error FROM b GROUP BY 1", "predicted truth error")
def tracking_bins(spark, sf_dir):
    from pyspark.sql import Window

    s = views(spark, sf_dir)[0]
    pred = s.select("series_id", "t", F.avg("x").over(Window.partitionBy("series_id").orderBy("i").rowsBetween(-4, 0)).alias("value"))
    return st.tracking_bins(pred, s.select("series_id", "t", F.col("x").alias("value")), 5 * DAY)


@query(f"""{CURVE_SQL}, two AS (SELECT CASE WHEN threshold < 50 THEN 'low' ELSE 'high' END AS method, sum(false_per_hour) AS f, max(sensitivity) AS s FROM curve GROUP BY 1), b AS (SELECT f AS bf, s AS bs FROM two WHERE method = 'high')
SELECT method, CASE WHEN bf > 0 THEN 1 - f / bf END AS reduction, coalesce(bf > 0 AND 1 - f / bf >= 0.1, false) AS material, s >= 0.5 * bs AS survives, f > 0.05 AND f > 4 * bf AS explodes FROM two CROSS JOIN b""", "reduction")
def compare_guards(spark, sf_dir):
    two = curve(spark, sf_dir).groupBy(F.when(F.col("threshold") < 50, "low").otherwise("high").alias("method")).agg(F.sum("false_per_hour").alias("false_per_hour"), F.max("sensitivity").alias("sensitivity"))
    return me.compare_guards(two, "high", most=0.05)


@query(f"{WITH_BASE}, n AS (SELECT 'neighbor' AS method, -score AS score FROM scores) SELECT DISTINCT method, unnest(list_concat(quantile_cont(score, [0.0, 0.25, 0.5, 0.75, 1.0]), [-1.7976931348623157e308, -50.0])) AS threshold FROM n GROUP BY method", "threshold")
def threshold_grid_neighbor(spark, sf_dir):
    s = views(spark, sf_dir)[2].select(F.lit("neighbor").alias("method"), (-F.col("score")).alias("score"))
    return me.threshold_grid(s, 5, {"neighbor": -50.0})


