"""Queries that estimate event rates, and as-of and monotone lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import events as ev
from tidewatch.operators import rates as ra
from tidewatch.operators import resampling as re_
from tidewatch.plans.event_queries import CHAINS_SQL, CROSSINGS_SQL, DAY, SAMPLES_SQL, UNITS_SQL, WITH_CROSSINGS, find_crossings, views
from tidewatch.plans.registry import query

KEPT_SQL = """kept AS (SELECT c.*, u.stratum FROM (SELECT series_id, side, t, i_detect, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, cluster ORDER BY severity DESC, t, i_detect) AS rank FROM chains) WHERE rank = 1) c JOIN units u USING (series_id))"""
WITH = f"{WITH_CROSSINGS}, {KEPT_SQL}"
TAIL = "n, threshold, exceedances, excess, CASE WHEN excess > 0 THEN exceedances / excess END AS mle, (2.0 + exceedances) / (1.0 + excess) AS posterior_mean, pow((1.0 + excess) / (1.0 + excess + 1 - threshold), 2.0 + exceedances) AS p_critical"


def kept(spark, sf_dir):
    return ev.decluster(find_crossings(spark, sf_dir), DAY).join(views(spark, sf_dir)[1].select("series_id", "stratum"), "series_id")


@query(f"""{WITH}, cut AS (SELECT stratum, least(quantile_cont(severity, 0.75), 1 - 1e-9) AS threshold, count(*) AS n FROM kept GROUP BY stratum),
s AS (SELECT stratum, any_value(n) AS n, any_value(threshold) AS threshold, count(*) FILTER (severity > threshold) AS exceedances, coalesce(sum(severity - threshold) FILTER (severity > threshold), 0.0) AS excess FROM kept JOIN cut USING (stratum) GROUP BY stratum)
SELECT stratum, {TAIL} FROM s""", "threshold excess mle posterior_mean p_critical")
def tail_posterior(spark, sf_dir):
    return ra.tail_posterior(kept(spark, sf_dir), 0.75, 2.0, 1.0, ["stratum"])


@query(f"""{WITH}, s AS (SELECT stratum, count(*) AS n, 0.5 AS threshold, count(*) FILTER (severity > 0.5) AS exceedances, coalesce(sum(severity - 0.5) FILTER (severity > 0.5), 0.0) AS excess FROM kept GROUP BY stratum)
SELECT stratum, {TAIL} FROM s""", "threshold excess mle posterior_mean p_critical")
def tail_fixed(spark, sf_dir):
    return ra.tail_posterior(kept(spark, sf_dir), 0.75, 2.0, 1.0, ["stratum"], fixed=0.5)


STEP = 2 * DAY
EMISSIONS_SQL = f"""ticks AS (SELECT series_id, record_start + k * {STEP} AS t, record_start FROM (SELECT *, unnest(range(1, CAST(greatest(1, floor((record_end - record_start) / {STEP})) AS BIGINT) + 1)) AS k FROM units)),
emissions AS (SELECT k.series_id, k.t, count(c.t) AS n, k.t - any_value(k.record_start) AS exposure, (2.0 + count(c.t)) / (900001.0 + k.t - any_value(k.record_start)) AS rate FROM ticks k LEFT JOIN kept c ON c.series_id = k.series_id AND c.t <= k.t GROUP BY k.series_id, k.t)"""


def emitted(spark, sf_dir):
    return ra.rate_emissions(kept(spark, sf_dir).select("series_id", "t"), views(spark, sf_dir)[1], STEP, 2.0, 900001.0)


@query(f"{WITH}, {EMISSIONS_SQL} SELECT series_id, t, n, exposure, rate * 3600 AS rate FROM emissions", "t exposure rate")
def rate_emissions(spark, sf_dir):
    return emitted(spark, sf_dir).withColumn("rate", F.col("rate") * 3600)


EXPECTED_SQL = "expected AS (SELECT series_id, sum(rate * greatest(coalesce(nt, record_end) - t, 0.0)) AS expected FROM (SELECT e.*, u.record_end, lead(t) OVER (PARTITION BY e.series_id ORDER BY t) AS nt FROM emissions e JOIN units u USING (series_id)) GROUP BY series_id)"


def expected(spark, sf_dir):
    return ra.integrate_rate(emitted(spark, sf_dir), views(spark, sf_dir)[1])


@query(f"{WITH}, {EMISSIONS_SQL}, {EXPECTED_SQL} SELECT * FROM expected", "expected")
def integrated_rate(spark, sf_dir):
    return expected(spark, sf_dir)


@query(f"{WITH}, {EMISSIONS_SQL}, {EXPECTED_SQL} SELECT stratum, count(*) AS n, sum(expected) AS predicted, count(t_event) AS realized, sum(1 - exp(-expected)) AS absorbing FROM expected JOIN units USING (series_id) GROUP BY stratum", "predicted absorbing")
def count_summary(spark, sf_dir):
    joined = expected(spark, sf_dir).join(views(spark, sf_dir)[1], "series_id")
    return joined.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("expected").alias("predicted"), F.count("t_event").alias("realized"), F.sum(1 - F.exp(-F.col("expected"))).alias("absorbing"))


@query(f"""{WITH}, {EMISSIONS_SQL}, {EXPECTED_SQL}, r AS (SELECT round(expected, 9) AS expected, CASE WHEN t_event IS NULL THEN 0.0 ELSE 1.0 END AS y FROM expected JOIN units USING (series_id)),
cuts AS (SELECT list_distinct(quantile_cont(expected, [0.2, 0.4, 0.6, 0.8])) AS cuts FROM r)
SELECT bin, count(*) AS n, avg(1 - exp(-expected)) AS predicted, avg(y) AS observed FROM (SELECT *, CAST((SELECT count(*) FROM (SELECT unnest(cuts) AS c) WHERE expected >= c) AS INTEGER) AS bin FROM r, cuts) GROUP BY bin""", "predicted observed")
def reliability(spark, sf_dir):
    joined = expected(spark, sf_dir).withColumn("expected", F.round("expected", 9)).join(views(spark, sf_dir)[1], "series_id").withColumn("hit", F.col("t_event").isNotNull())
    return ra.reliability(joined, 5)


GRID = tuple(k * 3 * DAY for k in range(11))
ASOF_SQL = f"""grid AS (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS t),
paths AS (SELECT u.series_id, g.t, CASE WHEN g.t <= u.record_end THEN coalesce((SELECT max_by(e.rate, e.t) FROM emissions e WHERE e.series_id = u.series_id AND e.t <= g.t), 0.0) END AS rate FROM units u CROSS JOIN grid g)"""


def paths(spark, sf_dir):
    return ra.asof_grid(emitted(spark, sf_dir), views(spark, sf_dir)[1], list(GRID))


@query(f"{WITH}, {EMISSIONS_SQL}, {ASOF_SQL} SELECT series_id, t, rate * 3600 AS rate FROM paths", "t rate")
def asof_grid(spark, sf_dir):
    return paths(spark, sf_dir).withColumn("rate", F.col("rate") * 3600)


@query(f"{WITH}, {EMISSIONS_SQL}, {ASOF_SQL} SELECT t, coalesce(avg(rate), 0.0) * 3600 AS mean_rate, count(rate) AS at_risk FROM paths GROUP BY t", "t mean_rate")
def ensemble_path(spark, sf_dir):
    return ra.ensemble_path(paths(spark, sf_dir)).withColumn("mean_rate", F.col("mean_rate") * 3600)


HAZARD_SQL = f"""hazard AS (SELECT g.t, CASE WHEN count(*) FILTER (record_end >= g.t AND coalesce(t_event, 'infinity'::DOUBLE) >= g.t) > 0 THEN coalesce(sum(exp(-(g.t - t_event) * (g.t - t_event) / (2e0 * {DAY} * {DAY})) / ({DAY} * 2.5066282746310002e0)), 0.0) / count(*) FILTER (record_end >= g.t AND coalesce(t_event, 'infinity'::DOUBLE) >= g.t) ELSE 0.0 END AS hazard,
  count(*) FILTER (record_end >= g.t AND coalesce(t_event, 'infinity'::DOUBLE) >= g.t) AS at_risk FROM units CROSS JOIN grid g GROUP BY g.t)"""


@query(f"{WITH}, grid AS (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS t), {HAZARD_SQL} SELECT t, hazard * 3600 AS hazard, at_risk FROM hazard", "t hazard")
def kernel_hazard(spark, sf_dir):
    return ra.kernel_hazard(views(spark, sf_dir)[1], list(GRID), DAY).withColumn("hazard", F.col("hazard") * 3600)


#: Severity of a series' largest crossing by tenths, against whether it has an event.
PEAKS_SQL = "peaks AS (SELECT series_id, least(floor(max(severity) * 4) / 4, 4.0) AS x, max(CASE WHEN t_event IS NULL THEN 0.0 ELSE 1.0 END) AS y FROM kept JOIN units USING (series_id) GROUP BY series_id)"
ISO_SQL = """b AS (SELECT x, avg(y) AS y, CAST(count(*) AS DOUBLE) AS w FROM peaks GROUP BY x),
means AS (SELECT p.x AS ax, q.x AS bx, (SELECT sum(r.w * r.y) / sum(r.w) FROM b r WHERE r.x BETWEEN p.x AND q.x) AS m FROM b p JOIN b q ON p.x <= q.x),
iso AS (SELECT b.x, b.y, b.w, (SELECT max(l) FROM (SELECT p.x, (SELECT min(m) FROM means n WHERE n.ax = p.x AND n.bx >= b.x) AS l FROM b p WHERE p.x <= b.x)) AS fit FROM b)"""


def peaks(spark, sf_dir):
    own = kept(spark, sf_dir).groupBy("series_id").agg(F.least(F.floor(F.max("severity") * 4) / 4, F.lit(4.0)).alias("x"))
    return own.join(views(spark, sf_dir)[1], "series_id").select("series_id", "x", F.col("t_event").isNotNull().cast("double").alias("y"), F.lit(1.0).alias("w"))


@query(f"{WITH}, {PEAKS_SQL}, {ISO_SQL} SELECT * FROM iso", "x y w fit")
def isotonic(spark, sf_dir):
    return ra.isotonic(peaks(spark, sf_dir), "x", "y", "w")


@query(f"{WITH}, {PEAKS_SQL}, {ISO_SQL} SELECT series_id, p.x, coalesce((SELECT min_by(fit, i.x) FROM iso i WHERE i.x >= p.x + 0.1), (SELECT max_by(fit, i.x) FROM iso i)) AS fit FROM peaks p", "x fit")
def step_predict(spark, sf_dir):
    p = peaks(spark, sf_dir)
    return ra.step_predict(p.withColumn("v", F.col("x") + 0.1), ra.isotonic(p, "x", "y", "w"), "v").select("series_id", "x", "fit")


@query(f"{WITH} SELECT series_id, t, severity, CAST((severity >= 0.5)::INT + (severity >= 1.0)::INT + (severity >= 2.0)::INT AS INTEGER) AS bin FROM kept", "t severity")
def bin_lookup(spark, sf_dir):
    return ra.bin_lookup(kept(spark, sf_dir).select("series_id", "t", "severity"), [0.0, 0.5, 1.0, 2.0, 99.0], "severity")


@query("""WITH s AS (SELECT o_orderpriority, count(*) AS size FROM orders GROUP BY 1), slots AS (SELECT o_orderpriority, unnest(range(1, least(size, 400) + 1)) AS turn FROM s),
take AS (SELECT o_orderpriority, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY turn, o_orderpriority) AS slot FROM slots) WHERE slot <= 400 GROUP BY 1),
k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('|', '5', o_orderkey)), o_orderkey) AS k FROM orders)
SELECT o_orderkey, k.o_orderpriority, size / CAST(n AS DOUBLE) AS weight FROM k JOIN take USING (o_orderpriority) JOIN s USING (o_orderpriority) WHERE k <= n""", "weight")
def stratified_sample(spark, sf_dir):
    from tidewatch.sources.tables import read

    return re_.stratified_sample(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], 400, 5, "o_orderkey")


#: Heights of series' peaks by class against critical heights of the clusters, by stratum, in equal shares.
ECDF_SQL = """g AS (SELECT series_id % 2 AS kind, max(x) AS height, 1.0 + series_id % 4 AS weight FROM samples GROUP BY series_id),
c AS (SELECT series_id % 2 AS kind, stratum, severity * 40 AS height FROM kept), s AS (SELECT kind, stratum, count(*) AS size FROM c GROUP BY 1, 2)"""


@query(f"{WITH}, {ECDF_SQL} SELECT sum(weight * below / size / 3.0) / 24.0 AS rate FROM (SELECT g.weight, s.size, (SELECT count(*) FROM c WHERE c.kind = g.kind AND c.stratum = s.stratum AND c.height <= g.height) AS below FROM g JOIN s USING (kind))", "rate")
def ecdf_rate(spark, sf_dir):
    s = views(spark, sf_dir)[0]
    groups = s.groupBy("series_id").agg(F.max("x").alias("height")).select((F.col("series_id") % 2).alias("kind"), "height", (1.0 + F.col("series_id") % 4).cast("double").alias("weight"))
    critical = kept(spark, sf_dir).select((F.col("series_id") % 2).alias("kind"), "stratum", (F.col("severity") * 40).alias("height"), F.lit(1 / 3).alias("share"))
    return ra.ecdf_rate(groups, critical, 24.0)


def hits(spark, sf_dir):
    joined = kept(spark, sf_dir).join(views(spark, sf_dir)[1].select("series_id", "t_event"), "series_id")
    return joined.select("stratum", F.round("severity", 9).alias("severity"), F.coalesce((F.col("t") <= F.col("t_event")) & (F.col("t_event") - F.col("t") <= 2 * DAY), F.lit(False)).alias("hit"))


@query(f"""{WITH}, h AS (SELECT k.stratum, round(severity, 9) AS severity, CASE WHEN t <= t_event AND t_event - t <= {2 * DAY} THEN 1 ELSE 0 END AS hit FROM kept k JOIN units u USING (series_id)),
cuts AS (SELECT list_distinct(quantile_cont(severity, [0.2, 0.4, 0.6, 0.8])) AS cuts FROM h),
b AS (SELECT bin, count(*) AS n, sum(hit) AS hits, CAST(sum(hit) AS DOUBLE) / count(*) AS raw FROM (SELECT h.*, (SELECT count(*) FROM (SELECT unnest(cuts) AS c) WHERE h.severity >= c) AS bin FROM h, cuts) GROUP BY bin),
m AS (SELECT p.bin AS a, q.bin AS z, (SELECT sum(r.n * r.raw) / sum(r.n) FROM b r WHERE r.bin BETWEEN p.bin AND q.bin) AS m FROM b p JOIN b q ON p.bin <= q.bin)
SELECT CAST(bin AS INTEGER) AS bin, n, CAST(hits AS BIGINT) AS hits, (SELECT max(l) FROM (SELECT (SELECT min(m.m) FROM m WHERE m.a = p.bin AND m.z >= b.bin) AS l FROM b p WHERE p.bin <= b.bin)) AS p FROM b""", "p")
def fit_conditional(spark, sf_dir):
    return ra.fit_conditional(hits(spark, sf_dir), 5).select("bin", "n", "hits", "p")


@query()
def fit_conditional_by(spark, sf_dir):
    return ra.fit_conditional(hits(spark, sf_dir), 5, ["stratum"])


@query()
def rate_draws(spark, sf_dir):
    return ra.rate_draws(emitted(spark, sf_dir), 512, 9).select("series_id", "t", "n", "lo", "hi")


@query()
def count_capture(spark, sf_dir):
    units = views(spark, sf_dir)[1]
    drawn = ra.rate_draws(emitted(spark, sf_dir), 512, 9)
    return ra.count_capture(expected(spark, sf_dir), ra.integrate_draws(drawn, units), units, ["stratum"], absorbing=True)


@query(f"""{WITH}, h AS (SELECT round(severity, 9) AS severity, round(k.t - u.record_start, 3) AS age, CASE WHEN k.t <= t_event AND t_event - k.t <= {2 * DAY} THEN 1 ELSE 0 END AS hit FROM kept k JOIN units u USING (series_id)),
thirds AS (SELECT list_distinct(quantile_cont(age, [1 / 3.0, 2 / 3.0])) AS c FROM h), p AS (SELECT severity, hit, (SELECT count(*) FROM (SELECT unnest(c) AS v) WHERE h.age >= v) AS part FROM h, thirds),
cuts AS (SELECT part, list_distinct(quantile_cont(severity, [0.2, 0.4, 0.6, 0.8])) AS cuts FROM p GROUP BY part),
b AS (SELECT part, bin, count(*) AS n, sum(hit) AS hits, CAST(sum(hit) AS DOUBLE) / count(*) AS raw FROM (SELECT p.*, (SELECT count(*) FROM (SELECT unnest(cuts) AS c) WHERE p.severity >= c) AS bin FROM p JOIN cuts USING (part)) GROUP BY part, bin),
m AS (SELECT p.part, p.bin AS a, q.bin AS z, (SELECT sum(r.n * r.raw) / sum(r.n) FROM b r WHERE r.part = p.part AND r.bin BETWEEN p.bin AND q.bin) AS m FROM b p JOIN b q ON p.part = q.part AND p.bin <= q.bin),
low AS (SELECT p.part, p.bin AS a, b.bin, min(m.m) AS l FROM b p JOIN b ON p.part = b.part AND p.bin <= b.bin JOIN m ON m.part = p.part AND m.a = p.bin AND m.z >= b.bin GROUP BY 1, 2, 3)
SELECT CAST(part AS INTEGER) AS part, CAST(bin AS INTEGER) AS bin, n, CAST(hits AS BIGINT) AS hits, (SELECT max(l) FROM low WHERE low.part = b.part AND low.bin = b.bin) AS p FROM b""", "p")
def fit_conditional_terciles(spark, sf_dir):
    """A curve for each third of the crossings by their age in the record."""
    joined = kept(spark, sf_dir).join(views(spark, sf_dir)[1].select("series_id", "record_start", "t_event"), "series_id")
    rows = joined.select(F.round("severity", 9).alias("severity"), F.round(F.col("t") - F.col("record_start"), 3).alias("age"), F.coalesce((F.col("t") <= F.col("t_event")) & (F.col("t_event") - F.col("t") <= 2 * DAY), F.lit(False)).alias("hit"))
    return ra.fit_conditional(ra.by_parts(rows, "age"), 5, ["part"]).select("part", "bin", "n", "hits", "p")


#: Variants of a predicted count: the gap that ends a cluster, in days; the tail's fixed threshold, or none; absorbing.
VARIANTS = {"baseline": (1, None, False), "absorbing": (1, None, True), "fixed_tail": (1, 0.5, False), "gap_half": (0.5, None, False), "gap_more": (1.5, None, False)}


def _variant_sql(name, gap, fixed, absorbing):
    cut = "least(quantile_cont(severity, 0.75), 1 - 1e-9)" if fixed is None else str(fixed)
    chains = CHAINS_SQL.replace(f"> {DAY} THEN", f"> {gap * DAY} THEN")
    return f"""SELECT '{name}' AS variant, (WITH {CROSSINGS_SQL}, {chains}, {KEPT_SQL}, {EMISSIONS_SQL}, {EXPECTED_SQL}, cut AS (SELECT stratum, {cut} AS threshold, count(*) AS n FROM kept GROUP BY stratum),
s AS (SELECT stratum, any_value(n) AS n, any_value(threshold) AS threshold, count(*) FILTER (severity > threshold) AS exceedances, coalesce(sum(severity - threshold) FILTER (severity > threshold), 0.0) AS excess FROM kept JOIN cut USING (stratum) GROUP BY stratum),
tail AS (SELECT stratum, {TAIL} FROM s), c AS (SELECT expected * coalesce(exceedances / n * p_critical, 0.0) AS count FROM expected JOIN units USING (series_id) LEFT JOIN tail USING (stratum))
SELECT coalesce(sum({"1 - exp(-count)" if absorbing else "count"}), 0.0) FROM c) AS predicted"""


@query(f"WITH {SAMPLES_SQL}, {UNITS_SQL}, v AS ({' UNION ALL '.join(_variant_sql(k, *v) for k, v in VARIANTS.items())}), b AS (SELECT predicted AS b FROM v WHERE variant = 'baseline') SELECT variant, predicted, predicted - b AS shift, CASE WHEN b <> 0 THEN (predicted - b) / b END AS relative FROM v, b", "predicted shift relative")
def attribution(spark, sf_dir):
    units = views(spark, sf_dir)[1]
    own = find_crossings(spark, sf_dir)
    parts = []
    for name, (gap, fixed, absorbing) in VARIANTS.items():
        marks = ev.decluster(own, gap * DAY).join(units.select("series_id", "stratum"), "series_id")
        counts = ra.integrate_rate(ra.rate_emissions(marks.select("series_id", "t"), units, STEP, 2.0, 900001.0), units)
        tail = ra.tail_posterior(marks, 0.75, 2.0, 1.0, ["stratum"], fixed=fixed)
        parts.append(ra.predicted_count(counts.join(units.select("series_id", "stratum"), "series_id"), tail, ["stratum"], absorbing).withColumn("variant", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ra.attribution(out)


@query()
def tracking_lag(spark, sf_dir):
    path = ra.ensemble_path(paths(spark, sf_dir)).join(ra.kernel_hazard(views(spark, sf_dir)[1], list(GRID), DAY).select("t", "hazard"), "t")
    return ra.tracking_lag(path.select((F.col("t") / GRID[1]).cast("int").alias("k"), (F.col("mean_rate") * 3600).alias("rate"), (F.col("hazard") * 3600).alias("hazard")), 3)
