"""Queries of rates composed of several sources of uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import composed as cp
from tidewatch.plans.event_queries import views
from tidewatch.plans.rate_queries import WITH, kept
from tidewatch.plans.registry import query

REPLICATES, SEED, EXPOSURE, COUNTED = 1000, 29, 24.0, 12.0


def parts(spark, sf_dir):
    """Series' peaks by class, four series a source; the series' strata; and critical heights of the kept crossings."""
    s, u, _ = views(spark, sf_dir)
    groups = s.groupBy("series_id").agg(F.max("x").alias("height")).select(F.floor(F.col("series_id") / 4).alias("source"), (F.col("series_id") % 2).alias("kind"), "height")
    entries = u.select(F.col("series_id").alias("entry_id"), "stratum")
    responses = kept(spark, sf_dir).select((F.col("series_id") * 1000003 + F.col("i_detect")).alias("response_id"), (F.col("series_id") % 2).alias("kind"), "stratum", (F.col("severity") * 40).alias("height"))
    return groups, entries, responses


def draws_sql(name: str, source: str, key: str, stratum: str, seed: int) -> str:
    """CTEs of bootstrap draws of source's rows within a stratum: name(replicate, key, times)."""
    return f"""{name}_r AS (SELECT {key}, {stratum} AS s, row_number() OVER (PARTITION BY {stratum} ORDER BY {key}) - 1 AS k, count(*) OVER (PARTITION BY {stratum}) AS n FROM {source}),
{name}_d AS (SELECT s, replicate, ('0x' || substr(md5(concat_ws('|', '{seed}', s, replicate, k)), 1, 8))::BIGINT % n AS k FROM {name}_r CROSS JOIN reps),
{name} AS (SELECT d.replicate, r.{key}, count(*) AS times FROM {name}_d d JOIN {name}_r r ON d.s = r.s AND d.k = r.k GROUP BY ALL)"""


DRAWS = f"""{WITH}, reps AS (SELECT unnest(range({REPLICATES})) AS replicate),
g AS (SELECT series_id // 4 AS source, series_id % 2 AS kind, max(x) AS height FROM samples GROUP BY series_id),
e AS (SELECT series_id AS entry_id, stratum FROM units),
c AS (SELECT series_id * 1000003 + i_detect AS response_id, series_id % 2 AS kind, stratum, severity * 40 AS height FROM kept),
src AS (SELECT DISTINCT source FROM g), {draws_sql('ds', 'src', 'source', "'0'", SEED)}, {draws_sql('de', 'e', 'entry_id', "'0'", SEED + 1)}, {draws_sql('dc', 'c', 'response_id', "kind || '|' || stratum", SEED + 2)},
size AS (SELECT kind, stratum, count(*) AS n FROM c GROUP BY ALL),
pos AS (SELECT g.source, g.kind, z.stratum, z.n, (SELECT count(*) FROM c WHERE c.kind = g.kind AND c.stratum = z.stratum AND c.height <= g.height) AS b, count(*) AS w FROM g JOIN size z USING (kind) GROUP BY g.source, g.kind, g.height, z.stratum, z.n),
wide AS (SELECT kind, stratum, n, b, sum(w) AS w0 FROM pos GROUP BY ALL),
wr AS (SELECT replicate, kind, stratum, b, sum(w * times) AS wr FROM pos JOIN ds USING (source) GROUP BY ALL),
place AS (SELECT response_id, kind, stratum, row_number() OVER (PARTITION BY kind, stratum ORDER BY height, response_id) AS k FROM c),
seen AS (SELECT replicate, kind, stratum, k AS p, 0 AS asks, times FROM dc JOIN place USING (response_id) UNION ALL SELECT replicate, kind, stratum, b, 1, 0 FROM wide CROSS JOIN reps),
cum AS (SELECT replicate, kind, stratum, p AS b, asks, sum(times) OVER (PARTITION BY replicate, kind, stratum ORDER BY p, asks ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM seen),
t AS (SELECT u.replicate, w.stratum, sum(w0 * w.b / n) AS t00, sum(coalesce(wr, 0) * w.b / n) AS t10, sum(w0 * cum / n) AS t01, sum(coalesce(wr, 0) * cum / n) AS t11 FROM cum u JOIN wide w ON u.kind = w.kind AND u.stratum = w.stratum AND u.b = w.b AND asks = 1
  LEFT JOIN wr ON wr.replicate = u.replicate AND wr.kind = w.kind AND wr.stratum = w.stratum AND wr.b = w.b GROUP BY ALL),
e0 AS (SELECT stratum, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM e) AS e0 FROM e GROUP BY ALL),
er AS (SELECT replicate, stratum, sum(times) / (SELECT CAST(count(*) AS DOUBLE) FROM e) AS er FROM de JOIN e USING (entry_id) GROUP BY ALL),
rates AS (SELECT t.replicate, sum(coalesce(e0, 0) * t00) / {EXPOSURE} AS point, sum(coalesce(er, 0) * t11) / {EXPOSURE} AS joint, sum(coalesce(e0, 0) * t10) / {EXPOSURE} AS groups, sum(coalesce(er, 0) * t00) / {EXPOSURE} AS entries, sum(coalesce(e0, 0) * t01) / {EXPOSURE} AS responses
  FROM t LEFT JOIN e0 USING (stratum) LEFT JOIN er ON er.replicate = t.replicate AND er.stratum = t.stratum GROUP BY t.replicate),
mean AS (SELECT *, joint * {COUNTED} AS m, (('0x' || substr(md5(concat_ws('|', '{SEED + 3}', replicate)), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM rates),
tail AS (SELECT replicate, u, sum(exp(j * ln(m) - m - lgamma(j + 1))) OVER (PARTITION BY replicate ORDER BY j) AS cdf FROM (SELECT *, unnest(range(0, CAST(2 * m + 60 AS BIGINT))) AS j FROM mean WHERE m > 0)),
counts AS (SELECT replicate, count(*) FILTER (cdf < u) AS count FROM tail GROUP BY ALL),
draws AS (SELECT r.*, coalesce(count, 0) AS count FROM rates r LEFT JOIN counts USING (replicate))"""


def draws(spark, sf_dir):
    return cp.component_draws(*parts(spark, sf_dir), EXPOSURE, REPLICATES, SEED, COUNTED)


@query(f"{DRAWS} SELECT CAST(replicate AS INTEGER) AS replicate, point, joint, groups, entries, responses, CAST(count AS BIGINT) AS count FROM draws", "point joint groups entries responses")
def component_draws(spark, sf_dir):
    return draws(spark, sf_dir)


@query(f"""{DRAWS}, flat AS (SELECT 'joint' AS component, point, joint AS rate, count FROM draws UNION ALL SELECT 'groups', point, groups, NULL FROM draws UNION ALL SELECT 'entries', point, entries, NULL FROM draws UNION ALL SELECT 'responses', point, responses, NULL FROM draws)
SELECT component, min(point) AS point, var_pop(rate) AS variance, quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi, CAST(quantile_disc(count, 0.025) AS BIGINT) AS count_lo, CAST(quantile_disc(count, 0.975) AS BIGINT) AS count_hi FROM flat GROUP BY component""", "point variance lo hi")
def component_bootstrap(spark, sf_dir):
    return cp.component_bootstrap(draws(spark, sf_dir))
