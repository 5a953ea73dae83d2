"""Queries of whole records: audits of planted faults, gaps, trailing levels, cells of coverage, medoids and forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import conformal as co
from tidewatch.operators import dataset as da
from tidewatch.operators import fits
from tidewatch.operators import metrics as me
from tidewatch.operators import rates as ra
from tidewatch.operators import studies as st
from tidewatch.operators import windows as wi
from tidewatch.plans.event_queries import DAY, HIGH, LOW, SAMPLES_SQL, UNITS_SQL, WITH_CROSSINGS, views
from tidewatch.plans.rate_queries import WITH as WITH_KEPT
from tidewatch.plans.rate_queries import kept
from tidewatch.plans.registry import query
from tidewatch.plans.score_queries import FORECASTS_SQL, FRAME
from tidewatch.plans.signal_queries import tops
from tidewatch.plans.study_queries import OBSERVED_SQL, observed
from tidewatch.sources.tables import read

WITH = f"WITH {SAMPLES_SQL}, {UNITS_SQL}"
#: Records of 20 samples an hour apart, and the faults that are planted in those whose number a prime divides.
FAULTS_SQL = f"""{WITH}, long AS (SELECT series_id FROM samples GROUP BY 1 HAVING count(*) >= 20),
base AS (SELECT series_id, i, i * 3600.0e0 AS t, x, dx FROM samples JOIN long USING (series_id) WHERE i < 20),
u0 AS (SELECT series_id, 0.0e0 AS record_start, 68400.0e0 AS record_end, min(CASE WHEN x >= 100 THEN t END) AS t_event FROM base GROUP BY 1),
s1 AS (SELECT b.series_id, CASE WHEN b.series_id % 31 = 0 AND i = 5 THEN 4 ELSE i END AS i, CASE WHEN b.series_id % 13 = 0 AND i = 7 THEN t - 7200 WHEN b.series_id % 19 = 0 AND i = 9 THEN t + 5 ELSE t END AS t,
  CASE WHEN b.series_id % 17 = 0 AND i = 0 THEN 'Infinity'::DOUBLE WHEN b.t > t_event AND b.series_id % 11 <> 0 THEN 'NaN'::DOUBLE ELSE x END AS x, CASE WHEN b.t > t_event THEN 'NaN'::DOUBLE ELSE dx END AS dx, b.t AS order_t FROM base b JOIN u0 USING (series_id)),
u1 AS (SELECT series_id, record_start, record_end, CASE WHEN series_id % 23 = 0 THEN t_event + 1e6 ELSE t_event END AS t_event FROM u0 WHERE series_id % 37 <> 0 UNION ALL SELECT series_id, record_start, record_end, t_event FROM u0 WHERE series_id % 29 = 0),
one AS (SELECT series_id, min(t_event) AS t_event, count(*) AS n, bool_or(t_event < record_start OR t_event > record_end) AS outside FROM u1 GROUP BY 1),
r AS (SELECT s.*, o.t_event, o.series_id IS NOT NULL AS known, coalesce(t > o.t_event, false) AS later, isfinite(x) AND isfinite(dx) AS good, isnan(x) AND isnan(dx) AS none FROM s1 s LEFT JOIN one o USING (series_id)),
lists AS (SELECT series_id, list_sort(list(ROW(i, t))) AS g FROM s1 GROUP BY 1)"""


def faulty(spark, sf_dir):
    s = views(spark, sf_dir)[0]
    long = s.groupBy("series_id").count().where("count >= 20").select("series_id")
    base = s.join(long, "series_id").where("i < 20").select("series_id", "i", (F.col("i") * 3600.0).alias("t"), "x", "dx")
    u = base.groupBy("series_id").agg(F.lit(0.0).alias("record_start"), F.lit(68400.0).alias("record_end"), F.min(F.when(F.col("x") >= 100, F.col("t"))).alias("t_event"))
    div = lambda p: F.col("series_id") % p == 0
    late = F.coalesce(F.col("t") > F.col("t_event"), F.lit(False))
    rows = base.join(u.select("series_id", "t_event"), "series_id").select(
        "series_id", F.when(div(31) & (F.col("i") == 5), 4).otherwise(F.col("i")).alias("i"), F.when(div(13) & (F.col("i") == 7), F.col("t") - 7200).when(div(19) & (F.col("i") == 9), F.col("t") + 5).otherwise(F.col("t")).alias("t"),
        F.when(div(17) & (F.col("i") == 0), float("inf")).when(late & ~div(11), float("nan")).otherwise(F.col("x")).alias("x"), F.when(late, float("nan")).otherwise(F.col("dx")).alias("dx"))
    own = u.where(~div(37)).withColumn("t_event", F.when(div(23), F.col("t_event") + 1e6).otherwise(F.col("t_event"))).unionByName(u.where(div(29)))
    return rows, own


@query(f"""{FAULTS_SQL} SELECT DISTINCT rule, series_id FROM (
  SELECT 'time' AS rule, series_id FROM (SELECT *, lag(t) OVER (PARTITION BY series_id ORDER BY i, t) AS pt FROM s1) WHERE t <= pt
  UNION ALL SELECT 'before', series_id FROM r WHERE NOT later AND NOT good UNION ALL SELECT 'after', series_id FROM r WHERE later AND NOT none
  UNION ALL SELECT 'event', series_id FROM one WHERE outside UNION ALL SELECT 'unique', series_id FROM one WHERE n > 1 UNION ALL SELECT 'unique', series_id FROM s1 GROUP BY series_id, i HAVING count(*) > 1
  UNION ALL SELECT 'unit', series_id FROM r WHERE NOT known UNION ALL SELECT 'grid', series_id FROM lists WHERE g <> (SELECT arg_min(g, series_id) FROM lists))""")
def audit_records(spark, sf_dir):
    """Faults planted by divisors of series_id, so that every rule finds some."""
    return da.audit_records(*faulty(spark, sf_dir))


@query(f"""{WITH_CROSSINGS}, {OBSERVED_SQL}, steps AS (SELECT s.*, t - lag(t) OVER (PARTITION BY series_id ORDER BY i) AS step FROM samples s),
l AS (SELECT s.series_id, median(step) AS dt, arg_max(s.t, i) FILTER (s.t < u.t_event) AS last_t, arg_max(s.x, i) FILTER (s.t < u.t_event) AS last_x, any_value(u.t_event) AS t_event FROM steps s JOIN units u USING (series_id) WHERE u.t_event IS NOT NULL GROUP BY 1)
SELECT o.series_id, outcome, outcome = 'unheralded' AND coalesce(CASE WHEN last_x >= 50 THEN last_x < {HIGH} ELSE last_x > {LOW} END AND l.t_event - last_t <= dt + 1e-12, false) AS gap FROM observed o LEFT JOIN l USING (series_id)""")
def sampling_gap(spark, sf_dir):
    s, u, _ = views(spark, sf_dir)
    return st.sampling_gap(observed(spark, sf_dir), s, u, HIGH, LOW, 50.0).select("series_id", "outcome", "gap")


RMS_WINDOW = 5 * DAY


@query(f"""{WITH_KEPT}, levels AS (SELECT series_id, i, sqrt(avg(x * x) OVER (PARTITION BY series_id ORDER BY CAST(round(t * 1e6) AS BIGINT) RANGE BETWEEN {round(RMS_WINDOW * 1e6)} PRECEDING AND CURRENT ROW)) AS rms FROM samples),
h AS (SELECT round(k.severity, 9) AS severity, round(rms, 6) AS rms, CASE WHEN k.t <= t_event AND t_event - k.t <= {2 * DAY} THEN 1 ELSE 0 END AS hit FROM kept k JOIN units u USING (series_id) JOIN levels l ON l.series_id = k.series_id AND l.i = k.i_detect),
thirds AS (SELECT list_distinct(quantile_cont(rms, [{1 / 3!r}, {2 / 3!r}])) AS thirds FROM h), p AS (SELECT severity, hit, (SELECT count(*) FROM (SELECT unnest(thirds) AS c) WHERE h.rms >= c) AS part FROM h, thirds),
cuts AS (SELECT part, list_distinct(quantile_cont(severity, [0.2, 0.4, 0.6, 0.8])) AS cuts FROM p GROUP BY part),
b AS (SELECT part, bin, count(*) AS n, sum(hit) AS hits, CAST(sum(hit) AS DOUBLE) / count(*) AS raw FROM (SELECT p.*, (SELECT count(*) FROM (SELECT unnest(cuts) AS c) WHERE p.severity >= c) AS bin FROM p JOIN cuts USING (part)) GROUP BY ALL),
m AS (SELECT p.part, p.bin AS a, q.bin AS z, (SELECT sum(r.n * r.raw) / sum(r.n) FROM b r WHERE r.part = p.part AND r.bin BETWEEN p.bin AND q.bin) AS m FROM b p JOIN b q ON p.part = q.part AND p.bin <= q.bin),
low AS (SELECT p.part, p.bin AS a, b.bin, min(m.m) AS l FROM b p JOIN b ON p.part = b.part AND p.bin <= b.bin JOIN m ON m.part = p.part AND m.a = p.bin AND m.z >= b.bin GROUP BY 1, 2, 3)
SELECT CAST(part AS INTEGER) AS part, CAST(bin AS INTEGER) AS bin, n, CAST(hits AS BIGINT) AS hits, (SELECT max(l) FROM low WHERE low.part = b.part AND low.bin = b.bin) AS p FROM b""", "p")
def fit_conditional_rms(spark, sf_dir):
    """A curve for each third of the crossings by the level of the motion before them."""
    s, u, _ = views(spark, sf_dir)
    joined = kept(spark, sf_dir).join(u.select("series_id", "t_event"), "series_id").join(st.trailing_rms(s, RMS_WINDOW).withColumnRenamed("i", "i_detect"), ["series_id", "i_detect"])
    rows = joined.select(F.round("severity", 9).alias("severity"), F.round("rms", 6).alias("rms"), F.coalesce((F.col("t") <= F.col("t_event")) & (F.col("t_event") - F.col("t") <= 2 * DAY), F.lit(False)).alias("hit"))
    return ra.fit_conditional(ra.by_parts(rows, "rms"), 5, ["part"]).select("part", "bin", "n", "hits", "p")


CELL_KEYS = ["family", "horizon", "model"]
CELLS_SQL = f"""{WITH}, {FORECASTS_SQL}, tops AS (SELECT series_id, i, x, max(x) OVER ({FRAME.format(5)}) AS top FROM samples),
b AS (SELECT f.series_id, f.series_id % 3 AS family, f.horizon, m.model, CASE m.model WHEN 'top' THEN 1.5 * top ELSE 2.0 * x END AS bound, f.target FROM usable f JOIN tops USING (series_id, i) CROSS JOIN (VALUES ('top'), ('last')) m(model)),
l AS (SELECT family, horizon, model, target - bound AS s, row_number() OVER (PARTITION BY family, horizon, model ORDER BY target - bound) AS k, count(*) OVER (PARTITION BY family, horizon, model) AS n FROM b WHERE (series_id // 3) % 2 = 0),
a AS (SELECT unnest([0.02, 0.05, 0.1, 0.2]::DOUBLE[]) AS alpha), q AS (SELECT family, horizon, model, alpha, coalesce(max(CASE WHEN k = ceil(round((n + 1) * (1 - alpha), 9)) THEN s END), 'infinity'::DOUBLE) AS q FROM l CROSS JOIN a GROUP BY ALL),
cells AS (SELECT family, horizon, model, alpha, count(*) AS n, CAST(count(*) FILTER (target <= bound + q) AS BIGINT) AS covered FROM b JOIN q USING (family, horizon, model) WHERE (series_id // 3) % 2 = 1 GROUP BY ALL)"""


def cells(spark, sf_dir):
    s = views(spark, sf_dir)[0]
    top = F.max("x").over(Window.partitionBy("series_id").orderBy("i").rowsBetween(-5, 0))
    made = wi.forecast_samples(s, [DAY, 3 * DAY], step=2).join(s.select("series_id", "i", "x", top.alias("top")), ["series_id", "i"])
    models = F.explode(F.array(F.struct(F.lit("top").alias("model"), (1.5 * F.col("top")).alias("bound")), F.struct(F.lit("last").alias("model"), (2.0 * F.col("x")).alias("bound"))))
    b = made.select("series_id", (F.col("series_id") % 3).alias("family"), "horizon", "target", models.alias("m")).select("series_id", "family", "horizon", "m.*", "target")
    half = F.floor(F.col("series_id") / 3) % 2
    return me.coverage_cells(co.split_bounds(b.where(half == 0), b.where(half == 1), [0.02, 0.05, 0.1, 0.2], CELL_KEYS), CELL_KEYS)


@query(f"{CELLS_SQL} SELECT family, horizon, model, alpha, n, covered, covered / n AS coverage, covered / n - (1 - alpha) AS error FROM cells", "horizon alpha coverage error")
def coverage_by_horizon(spark, sf_dir):
    return cells(spark, sf_dir).drop("lo", "hi")


@query(f"""{CELLS_SQL}, e AS (SELECT *, covered / n - (1 - alpha) AS error FROM cells), w AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(abs(error), 9) DESC, family, horizon, alpha) AS r FROM e)
SELECT e.model, count(*) AS cells, avg(abs(error)) AS mean_error, max(abs(error)) AS max_error, (SELECT family FROM w WHERE w.model = e.model AND r = 1) AS worst_family, (SELECT horizon FROM w WHERE w.model = e.model AND r = 1) AS worst_horizon, (SELECT alpha FROM w WHERE w.model = e.model AND r = 1) AS worst_alpha FROM e GROUP BY e.model""", "mean_error max_error worst_horizon worst_alpha")
def coverage_errors_by_model(spark, sf_dir):
    return me.coverage_errors(cells(spark, sf_dir), ["family", "horizon", "alpha"], ["model"])


def _medoids_sql(k: int) -> str:
    far = "".join(f", m{j} AS (SELECT arg_min(p_partkey, ROW(-d, p_partkey)) AS key FROM (SELECT r.p_partkey, min(round(sqrt((r.a - c.a) * (r.a - c.a) + (r.b - c.b) * (r.b - c.b)), 9)) AS d FROM r CROSS JOIN (SELECT a, b FROM r WHERE p_partkey IN ({' UNION '.join(f'SELECT key FROM m{i}' for i in range(j))})) c GROUP BY 1))" for j in range(1, k))
    every = " UNION ".join(f"SELECT key FROM m{i}" for i in range(k))
    return f"""WITH mid AS (SELECT median(p_retailprice) AS ma, median(p_size) AS mb FROM part), mad AS (SELECT median(abs(p_retailprice - ma)) AS sa, median(abs(p_size - mb)) AS sb FROM part, mid),
r AS (SELECT p_partkey, (p_retailprice - ma) / sa AS a, (p_size - mb) / sb AS b FROM part, mid, mad), m0 AS (SELECT arg_min(p_partkey, ROW(-round(sqrt(a * a + b * b), 9), p_partkey)) AS key FROM r){far},
c AS (SELECT p_partkey AS key, a, b FROM r WHERE p_partkey IN ({every})), n AS (SELECT r.p_partkey, c.key, round(sqrt((r.a - c.a) * (r.a - c.a) + (r.b - c.b) * (r.b - c.b)), 9) AS d FROM r CROSS JOIN c)
SELECT p_partkey, arg_min(key, ROW(d, key)) AS medoid, min(d) AS distance FROM n GROUP BY 1"""


@query(_medoids_sql(4), "distance")
def cluster_medoids(spark, sf_dir):
    return fits.cluster_medoids(read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size")), "p_partkey", ["price", "size"], 4)


@query()
def predict_quantiles(spark, sf_dir):
    """Forecasts of the largest motion of the next day at three levels, fitted by gradient steps, and how often they are passed."""
    rows = tops(spark, sf_dir).select("series_id", "i", (F.col("top") / 100).alias("top"), (F.col("target") / 100).alias("target"))
    levels = [0.5, 0.9, 0.95]
    out = fits.predict_quantiles(rows, fits.fit_linear_quantile(rows, ["top"], "target", levels), ["top"])
    return out.select("series_id", "i", *(F.get("quantiles", F.lit(k)).alias(f"q{round(100 * q)}") for k, q in enumerate(levels)), "target")
