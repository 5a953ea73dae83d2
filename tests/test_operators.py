"""Hand fixtures: small inputs with results worked out by hand."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators import conformal, dataset, events, metrics, rates, resampling, scores, windows


def scored(spark, rows):
    return spark.createDataFrame(rows, "series_id long, t double, score double")


def unit(spark, rows):
    return spark.createDataFrame(rows, "series_id long, record_start double, record_end double, t_event double, stratum long")


def alarm(spark, rows, units_, threshold, d, r, h, gap=0.0):
    return metrics.alarm_metrics(metrics.contributions(scored(spark, rows), unit(spark, units_), threshold, d, r, h, gap)).first()


def test_episodes_debounce_and_refractory(spark):
    s = [0, 1, 0, 1, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    out = events.episodes(scored(spark, [(1, float(t), float(v)) for t, v in enumerate(s)]), 0.5, 2, 2).orderBy("t_start").collect()
    assert [(r.t_start, r.t_end) for r in out] == [(4, 7), (11, 12)]


def state_machine(values, threshold, d, r):
    out, run, quiet, start, last, top, peak = [], 0, 0, None, None, None, -math.inf
    for t, v in enumerate(values):
        if v >= threshold:
            run, quiet = run + 1, 0
            peak = max(peak, v)
            if start is None and run >= d:
                start, top = t, peak
            if start is not None:
                last, top = t, max(top, v)
        else:
            run, quiet = 0, quiet + 1
            if start is None:
                peak = -math.inf
            elif quiet >= r:
                out.append((start, last, top))
                start, peak = None, -math.inf
    if start is not None:
        out.append((start, last, top))
    return out


def test_episodes_equal_a_state_machine(spark):
    rng = random.Random(3)
    series = {k: [rng.random() for _ in range(40)] for k in range(60)}
    got = events.episodes(scored(spark, [(k, float(t), v) for k, vs in series.items() for t, v in enumerate(vs)]), 0.5, 2, 3).collect()
    want = sorted((k, *e) for k, vs in series.items() for e in state_machine(vs, 0.5, 2, 3))
    assert sorted((r.series_id, r.t_start, r.t_end, r.max_score) for r in got) == want


def test_two_series_alarm_metrics(spark):
    a, b = [0, 0, 1, 1, 0, 0, 0, 0, 0, 0], [0, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    rows = [(1, 10.0 * i, float(v)) for i, v in enumerate(a)] + [(2, 10.0 * i, float(v)) for i, v in enumerate(b)]
    m = alarm(spark, rows, [(1, 0.0, 100.0, 60.0, 0), (2, 0.0, 100.0, None, 0)], 0.5, 2, 2, 40.0)
    assert (m.sensitivity, m.lead_q50, m.false_episodes, m.exposure_hours * 3600) == (1, 30, 1, pytest.approx(160))
    assert m.false_per_hour == pytest.approx(22.5)


def test_lead_may_exceed_the_horizon(spark):
    m = alarm(spark, [(1, 10.0 * i, 1.0) for i in range(10)], [(1, 0.0, 90.0, 90.0, 0)], 0.5, 2, 2, 30.0)
    assert (m.sensitivity, m.false_episodes, m.lead_q50) == (1, 0, 80)


def test_every_associated_episode_is_not_false(spark):
    v = [0, 0, 0, 1, 1, 0, 1, 1, 0]
    m = alarm(spark, [(1, 10.0 * i, float(x)) for i, x in enumerate(v)], [(1, 0.0, 85.0, 85.0, 0)], 0.5, 2, 1, 60.0)
    assert (m.false_episodes, m.lead_q50) == (0, 45)


def test_event_without_enough_scores_has_no_exposure(spark):
    m = alarm(spark, [(1, 120.0, 1.0), (1, 130.0, 1.0)], [(1, 120.0, 200.0, 135.0, 0)], 0.5, 3, 3, 60.0)
    assert (m.events, m.exposure_hours) == (0, 0)


def test_merge_episodes(spark):
    rows = spark.createDataFrame([(1, 10.0, 20.0, 1.2), (1, 35.0, 45.0, 2.1), (1, 80.0, 90.0, 1.7)], "series_id long, t_start double, t_end double, max_score double")
    assert [(r.t_start, r.t_end, r.max_score) for r in events.merge_episodes(rows, 20).orderBy("t_start").collect()] == [(10, 45, 2.1), (80, 90, 1.7)]


def test_decluster_compares_with_the_event_before(spark):
    rows = spark.createDataFrame([(1, 0.0, 0, 0.4), (1, 3.0, 1, 1.2), (1, 7.0, 2, 0.8), (1, 20.0, 3, 0.9)], "series_id long, t double, i_detect int, severity double")
    assert [r.t for r in events.decluster(rows, 5).orderBy("t").collect()] == [3, 20]


def test_crossings_by_hand(spark):
    x, dx = [0, 0.2, 0.5, 0.2, -0.5, -0.2, 0.5], [0, 0.2, 0.3, -0.2, -0.6, 0.1, 0.7]
    rows = spark.createDataFrame([(1, i, float(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, dx, strict=True))], "series_id long, i int, t double, x double, dx double")
    out = events.crossings(rows, 0.4, -0.4, 1.0, 1.0).orderBy("t").collect()
    assert [r.side for r in out] == [1, -1, 1]
    assert out[0].t == pytest.approx(1 + 0.2 / 0.3) and out[0].i_detect == 2


def test_crossings_don_t_look_ahead(spark):
    rows = [(1, i, float(i), math.sin(i), math.cos(i)) for i in range(40)]
    schema = "series_id long, i int, t double, x double, dx double"
    early = lambda r: [x for x in events.crossings(spark.createDataFrame(r, schema), 0.5, -0.5, 1.0, 1.0).where("i_detect < 20").orderBy("t").collect()]
    assert early(rows) == early([(k, i, t, x if i < 20 else 9.0, d) for k, i, t, x, d in rows])


def test_intervals_touch(spark):
    make = lambda lo, hi: spark.createDataFrame([(1, lo, hi)], "series_id long, lo double, hi double")
    assert events.overlap_join(make(1.0, 2.0), make(2.0, 3.0)).count() == 1
    assert events.overlap_join(make(1.0, 1.9), make(2.0, 3.0)).count() == 0


def test_terminal_partition(spark):
    groups = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 5.0, 5.0), (2, 0, 1.0, 1.0)], "series_id long, cluster long, last_t double, retained_t double")
    out = {r.series_id: (r.heralded, r.cluster) for r in events.terminal_partition(groups, unit(spark, [(1, 0.0, 9.0, 5.5, 0), (2, 0.0, 9.0, 8.0, 0)]), 1.0).collect()}
    assert out == {1: (True, 1), 2: (False, None)}


def test_conformal_rank(spark):
    cal = spark.createDataFrame([(float(k),) for k in range(1, 10)], "score double")
    out = {round(r.alpha, 3): r["quantile"] for r in conformal.conformal_quantile(cal, [0.2, 0.05, 0.0, 1.0]).collect()}
    assert out == {0.2: 8, 0.05: math.inf, 0.0: math.inf, 1.0: -math.inf}


def aci_loop(cal, rows, alpha, gamma, delay):
    level, out, misses = alpha, [], []
    for k, (_, bound, target) in enumerate(rows):
        if delay and k >= delay:
            level += gamma * (alpha - misses[k - delay])
        rank = math.ceil(round((len(cal) + 1) * (1 - level), 9))
        q = math.inf if level <= 0 or rank > len(cal) else -math.inf if level >= 1 else sorted(cal)[rank - 1]
        out.append(level)
        misses.append(int(target > bound + q))
        if not delay:
            level += gamma * (alpha - misses[-1])
    return out, misses


@pytest.mark.parametrize("delay", [0, 3])
def test_aci_equals_a_loop(spark, delay):
    rng = random.Random(1)
    cal = [rng.random() for _ in range(20)]
    rows = [(float(k), 1.0, 1 + rng.random() * 1.3) for k in range(30)]
    got = conformal.aci(spark.createDataFrame([(1, *r) for r in rows], "series_id long, t double, bound double, target double"), spark.createDataFrame([(0.0, c) for c in cal], "bound double, target double"), 0.2, 0.05, delay).orderBy("t").collect()
    levels, misses = aci_loop(cal, rows, 0.2, 0.05, delay)
    assert [r.miss for r in got] == misses
    assert [r.level for r in got] == pytest.approx(levels)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.5), (1, 0.5), (1, 0.9)], "label int, score double")
    assert metrics.auc(df).first().auc == pytest.approx(0.875)


def test_calibration_by_hand(spark):
    df = spark.createDataFrame([(0, 0.1, 10.0), (0, 0.4, 1.0), (1, 0.8, 1.0)], "label int, p double, w double")
    m = metrics.calibration(df).first()
    assert m.brier == pytest.approx((10 * 0.01 + 0.16 + 0.04) / 12)
    assert m.ece == pytest.approx((10 * 0.1 + 0.4 + 0.2) / 12)


def test_recovery_needs_three_points(spark):
    make = lambda c: spark.createDataFrame([(300.0 + 10 * i, v) for i, v in enumerate(c)], "t double, coverage double")
    assert metrics.recovery_time(make([0.9, 0.9, 0.9, 0.8, 0.9]), 300, 0.9, 0.03).first().recovery is None
    assert metrics.recovery_time(make([0.8, 0.9, 0.9, 0.9, 0.9]), 300, 0.9, 0.03).first().recovery == 10


def test_causal_normalize_equals_least_squares(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=25) + 1e3
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "series_id long, i int, x double")
    got = [r.z for r in windows.causal_normalize(rows).orderBy("i").collect()]
    assert got[:2] == [0, 0]
    for i in range(3, 25):
        line = np.polyfit(np.arange(i), x[:i], 1)
        assert got[i] == pytest.approx((x[i] - np.polyval(line, i)) / x[:i].std(ddof=1), rel=1e-6)


def test_horizon_labels(spark):
    ends = spark.createDataFrame([(1, float(t)) for t in range(20)] + [(2, float(t)) for t in range(20)], "series_id long, t_end double")
    out = windows.label_windows(ends, unit(spark, [(1, 0.0, 19.0, 15.0, 0), (2, 0.0, 19.0, None, 0)]), 4.0, 2.0).collect()
    one = {r.t_end: r.label for r in out if r.series_id == 1}
    assert not any(9 <= t < 11 for t in one) and all(one[t] == 1 for t in (11, 12, 13, 14)) and 15 not in one
    assert max(r.t_end for r in out if r.series_id == 2) == 15


def test_forecast_target_and_truncation(spark):
    rows = spark.createDataFrame([(1, i, float(i), 0.01 * i) for i in range(21)], "series_id long, i int, t double, x double")
    out = {(r.t, r.horizon): r.target for r in windows.forecast_samples(rows, [3.0, 6.0]).collect()}
    assert out[5.0, 3.0] == pytest.approx(0.08) and (18.0, 3.0) not in out and (17.0, 3.0) in out


def test_neighbors(spark):
    rows = spark.createDataFrame([([0.0, 0.1, 5.0, 0.0, 9.0, 9.0, 9.0, 0.0], [0.0] * 8)], "w array<double>, wdx array<double>")
    assert scores.neighbor_score(rows, 0.11, 3).first().neighbor == -3


def test_alarm_score(spark):
    rows = spark.createDataFrame([(0.29,), (0.30,), (0.31,), (math.inf,)], "bound double")
    got = sorted(r.score for r in scores.alarm_score(rows, 0.5).collect())
    assert got[:3] == pytest.approx([29 / 30, 1, 31 / 30]) and got[3] > 1e308
    with pytest.raises(Exception, match="not a number"):
        scores.alarm_score(spark.createDataFrame([(math.nan,)], "bound double"), 0.5).collect()


def test_exact_intervals(spark):
    df = spark.createDataFrame([("a", k < 3) for k in range(10)] + [("b", False)] * 5 + [("c", True)] * 5, "g string, hit boolean")
    out = {r.g: (r.lo, r.hi) for r in resampling.proportion_ci(df, ["g"], "hit").collect()}
    assert out["a"] == pytest.approx((0.0667395, 0.6524529), abs=1e-6)
    assert out["b"] == pytest.approx((0, 0.5218238), abs=1e-6) and out["c"] == pytest.approx((0.4781762, 1), abs=1e-6)
    r = resampling.rate_ci(df.where("g = 'a'").selectExpr("g", "hit", "1.0D as e"), ["g"], "hit", "e").first()
    assert (r.lo * 10, r.hi * 10) == pytest.approx((0.6186721, 8.7672731), abs=1e-5)


def test_bootstrap_keeps_strata(spark):
    u = unit(spark, [(k, 0.0, 1.0, None, int(k >= 3)) for k in range(10)])
    draws = resampling.bootstrap_draws(u, 50, 1)
    sizes = draws.selectExpr("replicate", "times", "series_id < 3 as a").groupBy("replicate", "a").sum("times").collect()
    assert {(r.a, r["sum(times)"]) for r in sizes} == {(True, 3), (False, 7)}
    again = resampling.bootstrap_draws(u.repartition(7), 50, 1)
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, again.collect()))


def test_stratified_weights(spark):
    df = spark.createDataFrame([(k, k % 8 if k < 20 else 0) for k in range(24)], "id long, g int")
    out = resampling.stratified_sample(df, ["g"], 16, 2, "id").collect()
    assert len(out) == 16
    total = {}
    for r in out:
        total[r.g] = total.get(r.g, 0) + r.weight
    assert {g: round(v, 6) for g, v in total.items()} == {r.g: r["count"] for r in df.groupBy("g").count().collect()}


def test_tail_without_exceedances_is_the_prior(spark):
    empty = spark.createDataFrame([(0.1,)], "severity double")
    r = rates.tail_posterior(empty, 0.5, 4.0, 2.0, fixed=0.75).first()
    assert (r.exceedances, r.posterior_mean, r.mle) == (0, 2, None)
    r = rates.tail_posterior(spark.createDataFrame([(v,) for v in (0.9, 1.0, 1.1, 1.2)], "severity double"), 0.75, 1.0, 1.0).first()
    assert r.threshold < 1


def test_isotonic_pools(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 3.0, 1.0), (3.0, 2.0, 1.0), (4.0, 5.0, 1.0)], "x double, y double, w double")
    assert [r.fit for r in rates.isotonic(df, "x", "y", "w").orderBy("x").collect()] == [1, 2.5, 2.5, 5]


def test_interval_conflicts_and_splits(spark):
    make = lambda lo, hi: spark.createDataFrame([("s", lo, hi)], "name string, lo long, hi long")
    assert events.interval_conflicts(make(11500, 11600), make(11000, 11550)).count() == 1
    assert events.interval_conflicts(make(11500, 11600), make(11600, 11700)).count() == 0
    ranges = [("train", 0, 100), ("reserve", 100, 200)]
    df = dataset.assign_split(spark.createDataFrame([(1,), (150,)], "k long"), ranges, "k")
    with pytest.raises(Exception, match="outside split"):
        dataset.assert_split(df, "train").collect()


def test_manifest_finds_changes(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "series_id")
    path = str(tmp_path / "s")
    dataset.write_series(df, path, 30)
    known = spark.createDataFrame(dataset.manifest(spark, path).collect())
    assert dataset.verify_files(spark, path, known).count() == 0
    bad = known.limit(1).selectExpr("file", "'0' as sha256", "rows").unionByName(known.subtract(known.limit(1)))
    assert [r.fault for r in dataset.verify_files(spark, path, bad).collect()] == ["digest"]


def test_results_don_t_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(k, float(t), rng.random()) for k in range(20) for t in range(30)]
    one = events.episodes(scored(spark, rows), 0.5, 2, 2).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rng.shuffle(rows)
        other = events.episodes(scored(spark, rows).repartition(9), 0.5, 2, 2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_streams_equal_their_batch_forms(spark, tmp_path):
    """Three files are three micro-batches; what is open at the end of a stream is not out yet."""
    from pyspark.sql import functions as F

    from tidewatch.streaming import stateful
    from tidewatch.streaming.sources import run_to_end

    rng = random.Random(8)
    rows = [(k, float(t), rng.random() * 10, rng.random() + 0.1) for t in range(60) for k in range(8)]
    schema = "series_id long, t double, x double, dx double"
    whole = spark.createDataFrame([(k, int(t), t, x, d) for k, t, x, d in rows], "series_id long, i int, t double, x double, dx double")
    for part in range(3):
        spark.createDataFrame([r for r in rows if part * 20 <= r[1] < (part + 1) * 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = sorted((r.series_id, r.i, round(r.z, 6)) for r in run_to_end(stateful.stream_normalize(stream().select("series_id", "t", "x"))).collect())
    assert got == sorted((r.series_id, r.i, round(r.z, 6)) for r in windows.causal_normalize(whole).collect())
    own = run_to_end(stateful.stream_episodes(stream().select("series_id", "t", F.col("x").alias("score")), 5.0, 2, 2)).collect()
    batch = events.episodes(whole.select("series_id", "t", F.col("x").alias("score")), 5.0, 2, 2).collect()
    assert {tuple(r) for r in own} <= {tuple(r) for r in batch} and len(batch) - len(own) <= 8
    assert all(r.t_end >= 57 for r in batch if tuple(r) not in {tuple(x) for x in own})
    own = run_to_end(stateful.stream_crossings(stream(), 7.0, 3.0, 0.5, 2.0)).collect()
    batch = events.decluster(events.crossings(whole, 7.0, 3.0, 0.5, 0.5), 2.0).collect()
    key = lambda r: (r.series_id, r.side, round(r.t, 9), round(r.severity, 9))
    assert {key(r) for r in own} <= {key(r) for r in batch} and len(batch) - len(own) <= 8


def test_signal_functions():
    import numpy as np

    from tidewatch.functions import signal

    t = np.arange(64)
    assert signal.envelope(np.cos(2 * np.pi * t / 8)) == pytest.approx(np.ones(64), abs=1e-9)
    assert signal.dominant_period(np.cos(2 * np.pi * t / 8), 0.5, 1.0) == pytest.approx(4)
    assert signal.decorrelation_lag(np.array([1, 0.6, 0.2, 0.1, 0.04, 0.02]), 0.05) == pytest.approx(5 * 0.95 / 0.98)
    assert signal.decorrelation_time(np.ones(9), 2.0) == 2.0
    late = np.cos(2 * np.pi * t / 8) * np.where(t >= 32, 5.0, 1.0)
    assert signal.band_power(late, 8) > signal.band_power(np.cos(2 * np.pi * t / 8), 8)
    assert signal.band_power(np.cos(2 * np.pi * t / 8) * np.where(t >= 32, 0.1, 1.0), 8) == 0
    m0, m2 = signal.spectral_moments(2 * np.cos(2 * np.pi * t / 8), 1.0)
    assert m0 == pytest.approx(2) and math.sqrt(m2 / m0) == pytest.approx(2 * math.pi / 8)


def test_wave_group(spark):
    from tidewatch.operators import signal

    dt = 0.1
    x = [(2.0 if 8 <= i * dt < 16 else 0.2) * math.sin(2 * math.pi * i * dt / 2) for i in range(240)]
    df = spark.createDataFrame([(1, x)], "series_id long, x array<double>")
    out = signal.wave_groups(df, 3.0, 4.0, dt).collect()
    assert len(out) == 1 and out[0].lo == pytest.approx(8, abs=0.6) and out[0].hi == pytest.approx(16, abs=0.6) and out[0].height > 3.5


def test_envelope_forecast_is_the_best_scale(spark):
    import numpy as np

    from tidewatch.operators import fits

    rng = np.random.default_rng(3)
    top, target = rng.random(200) + 0.5, rng.random(200) * 3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(top, target, strict=True)], "top double, target double")
    for r in fits.fit_envelope(df, [0.5, 0.9]).collect():
        loss = lambda s: np.where(target > s * top, r.q * (target - s * top), (1 - r.q) * (s * top - target)).sum()  # noqa: E731, B023
        assert loss(r.scale) <= min(loss(s) for s in np.linspace(0, 6, 4001)) + 1e-9


def test_medoids(spark):
    from tidewatch.operators import fits

    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [9.0, 0.0]), (4, [9.1, 0.0])], "k long, v array<double>")
    assert {r.k: r.medoid for r in fits.medoids(df, "k", "v", 2).collect()} == {1: 1, 2: 1, 3: 4, 4: 4}


def test_one_expert_is_the_scalar_level(spark):
    rng = random.Random(2)
    cal = spark.createDataFrame([(0.0, rng.random()) for _ in range(15)], "bound double, target double")
    rows = spark.createDataFrame([(1, float(k), 1.0, 1 + rng.random() * 1.4) for k in range(25)], "series_id long, t double, bound double, target double")
    for delay in (0, 2):
        one = [r.level for r in conformal.dtaci(rows, cal, 0.2, [0.05], delay=delay).orderBy("t").collect()]
        assert one == pytest.approx([r.level for r in conformal.aci(rows, cal, 0.2, 0.05, delay).orderBy("t").collect()])


def test_bounds_don_t_see_unresolved_outcomes(spark):
    rng = random.Random(6)
    cal = spark.createDataFrame([(0.0, rng.random()) for _ in range(15)], "bound double, target double")
    base = [(1, float(k), 1.0, 1 + rng.random()) for k in range(12)]
    other = [(1, 0.0, 1.0, 9.0), *base[1:]]
    schema = "series_id long, t double, bound double, target double"
    for run in (lambda r: conformal.aci(r, cal, 0.2, 0.1, 6), lambda r: conformal.sliding_aci(r, cal, 0.2, 0.1, 10, 6), lambda r: conformal.dtaci(r, cal, 0.2, [0.05, 0.1], delay=6)):
        a, b = ([x.upper for x in run(spark.createDataFrame(r, schema)).orderBy("t").collect()] for r in (base, other))
        assert a[:6] == b[:6] and a[6] != b[6]


def test_trial_counts_equal_all_pairs(spark):
    from pyspark.sql import functions as F

    from tidewatch.operators import fits

    entries = spark.createDataFrame([(k, k % 3 if k % 11 else None, float(k * 7 % 40) if k % 13 else None) for k in range(200)], "entry_id long, kind int, critical double")
    groups = spark.createDataFrame([(k, k % 4, float(k * 3 % 50) if k % 9 else None) for k in range(300)], "group_id long, kind int, height double")
    pairs = fits.trial_grid(entries, groups, [0.5, 1.0]).groupBy("kind", "multiplier").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("hits"))
    got = fits.trial_counts(entries, groups, [0.5, 1.0])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
    assert got.count() == 6


def test_trial_grid_takes_all_series(spark, sf_dir):
    from pyspark.sql import functions as F

    from tidewatch.plans import registry

    series = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    fifth, whole = (registry.QUERIES[q](spark, sf_dir).where("multiplier = 1.0").agg(F.sum("n")).first()[0] for q in ("trial_grid", "trial_grid_all"))
    assert whole > 4 * fifth and whole <= series**2


def test_stream_crossings_use_difference_quotients(spark, sf_dir):
    from tidewatch.plans import registry

    own = {(r.series_id, r.t): (r.side, r.severity) for r in registry.QUERIES["stream_crossings"](spark, sf_dir).collect()}
    batch = {(r.series_id, r.t): (r.side, r.severity) for r in registry.QUERIES["declustered"](spark, sf_dir).collect()}
    assert own and all(batch[k][0] == side and abs(batch[k][1] - severity) < 1e-5 for k, (side, severity) in own.items())


def test_rate_draws_and_quantile_steps_are_those_of_production(spark, sf_dir, monkeypatch):
    from tidewatch.operators import fits
    from tidewatch.operators import rates as operators
    from tidewatch.plans import registry

    asked = {}
    draw, fit = operators.rate_draws, fits.fit_linear_quantile
    monkeypatch.setattr(operators, "rate_draws", lambda e, draws, seed: asked.update(draws=draws) or draw(e, draws, seed))
    monkeypatch.setattr(fits, "fit_linear_quantile", lambda *a, steps=200, **b: asked.update(steps=steps) or fit(*a, steps=1, **b))
    registry.QUERIES["rate_draws"](spark, sf_dir)
    registry.QUERIES["fit_linear_quantile"](spark, sf_dir)
    assert asked == {"draws": 512, "steps": 200}


def test_described_groups(spark):
    from tidewatch.functions import signal as fn
    from tidewatch.operators import signal

    t = np.arange(600) * 0.5
    x = (0.2 + np.exp(-(((t - 80) / 25) ** 2)) + np.exp(-(((t - 220) / 25) ** 2))) * np.cos(2 * np.pi * t / 8)
    series = spark.createDataFrame([(1, x.tolist()), (2, (0.1 * x).tolist()), (3, [9.0, 9.0])], "series_id long, x array<double>")
    got = sorted(signal.describe_groups(series, 0.5, 2.0, 8.0).collect(), key=lambda r: r.i_start)
    assert [r.series_id for r in got] == [1, 1]
    height = 2 * fn.envelope(x)
    high = np.flatnonzero(height >= 1.5)
    cuts = np.flatnonzero(np.diff(high) > 17)
    for r, part in zip(got, np.split(high, cuts + 1), strict=True):
        own = height[part[0] : part[-1] + 1]
        assert (r.i_start, r.i_end, r.i_top) == (part[0], part[-1], part[0] + int(own.argmax()))
        assert r.carrier_period == pytest.approx(8.0, abs=0.05)
        assert r.height == pytest.approx(own.max())
        assert r.cycles == pytest.approx(len(own) * 0.5 / r.carrier_period)
        assert r["shape"] == pytest.approx(np.interp(np.linspace(0, len(own) - 1, 9), np.arange(len(own)), own / own.max()).tolist())


def test_counts_captured_by_draws(spark):
    units = spark.createDataFrame([(1, 0.0, 10.0, 5.0, 0), (2, 0.0, 10.0, None, 0)], "series_id long, record_start double, record_end double, t_event double, stratum int")
    emitted = spark.createDataFrame([(1, 2.0, [0.1, 0.2]), (1, 6.0, [0.0, 0.5]), (2, 4.0, [0.0, 0.1])], "series_id long, t double, draws array<double>")
    drawn = rates.integrate_draws(emitted, units)
    assert {(r.series_id, r.draw): pytest.approx(r.expected) for r in drawn.collect()} == {(1, 0): 0.4, (1, 1): 2.8, (2, 0): 0.0, (2, 1): 0.6}
    expected = spark.createDataFrame([(1, 1.0), (2, 0.5)], "series_id long, expected double")
    (r,) = rates.count_capture(expected, drawn, units, ["stratum"]).collect()
    assert (r.n, r.predicted, r.realized, r.captured) == (2, 1.5, 1, True)
    assert (r.lo, r.hi) == pytest.approx((0.475, 3.325))
    (r,) = rates.count_capture(expected, drawn, units, ["stratum"], absorbing=True).collect()
    assert r.predicted == pytest.approx(2 - np.exp(-1) - np.exp(-0.5))


def test_coverage_cells_and_worst(spark):
    rows = spark.createDataFrame([(f, 0.1, int(k < m)) for f, m in ((0, 1), (1, 4)) for k in range(10)], "family int, alpha double, miss int")
    cells = metrics.coverage_cells(rows, ["family"])
    got = {r.family: r for r in cells.collect()}
    assert (got[0].n, got[0].covered, got[0].coverage) == (10, 9, 0.9)
    assert (got[0].lo, got[0].hi) == pytest.approx((0.554984, 0.997471), abs=1e-5)
    (worst,) = metrics.coverage_errors(cells, ["family"]).collect()
    assert (worst.cells, worst.worst_family) == (2, 1)
    assert (worst.mean_error, worst.max_error) == pytest.approx((0.15, 0.3))


def test_parts_by_quantiles(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 6, 7)], "age double")
    assert [r.part for r in rates.by_parts(rows, "age").orderBy("age").collect()] == [0, 0, 1, 1, 2, 2, 2]
    same = rates.by_parts(spark.createDataFrame([(1.0,), (1.0,)], "age double"), "age")
    assert {r.part for r in same.collect()} == {1}


def test_predicted_counts_and_their_attribution(spark):
    expected = spark.createDataFrame([(1, 2.0, 0), (2, 1.0, 0), (3, 4.0, 1), (4, 9.0, 2)], "series_id long, expected double, stratum int")
    tail = spark.createDataFrame([(0, 10, 5, 0.5), (1, 4, 1, 1.0)], "stratum int, n long, exceedances long, p_critical double")
    (total,) = rates.predicted_count(expected, tail, ["stratum"]).collect()
    assert total.predicted == pytest.approx(0.5 + 0.25 + 1.0)
    (total,) = rates.predicted_count(expected, tail, ["stratum"], absorbing=True).collect()
    assert total.predicted == pytest.approx(3 - math.exp(-0.5) - math.exp(-0.25) - math.exp(-1))
    got = rates.attribution(spark.createDataFrame([("baseline", 2.0), ("more", 3.0)], "variant string, predicted double")).collect()
    assert {r.variant: (r.shift, r.relative) for r in got} == {"baseline": (0.0, 0.0), "more": (1.0, 0.5)}


def test_forecast_quantiles_do_not_cross(spark):
    from tidewatch.operators import fits

    rows = spark.createDataFrame([(0.0,), (10.0,), (None,)], "top double")
    got = fits.predict_quantiles(rows, {0.9: [2.0, 0.5], 0.5: [1.0, 1.0], 0.95: [0.0, 2.0]}, ["top"]).collect()
    assert [r.quantiles for r in got] == [[1.0, 2.0, 2.0], [11.0, 11.0, 20.0], None]


def test_bounds_of_counts_of_any_size():
    """Against the Poisson tail added up term by term, and against known values where that is out of reach."""
    from tidewatch.functions import special

    def at_most(m, mean):
        return math.fsum(math.exp(j * math.log(mean) - mean - math.lgamma(j + 1)) for j in range(m + 1))

    for k in (0, 1, 7, 400, 10_000, 30_000):
        hi = special.gamma_quantile(0.975, np.array([k + 1.0]))[0]
        assert at_most(k, hi) == pytest.approx(0.025, rel=1e-9)
        if k:
            lo = special.gamma_quantile(0.025, np.array([float(k)]))[0]
            assert 1 - at_most(k - 1, lo) == pytest.approx(0.025, rel=1e-8)
    large = np.array([1e5, 1e6, 1e7, 1e9])
    hi, lo = special.gamma_quantile(0.975, large + 1), special.gamma_quantile(0.025, large)
    # the Cornish-Fisher expansion of a gamma quantile is as good as 1e-9 from counts of a hundred thousand on
    z = 1.959963984540054
    for found, a, s in ((hi, large + 1, z), (lo, large, -z)):
        near = a + s * np.sqrt(a) + (s * s - 1) / 3 + (s**3 - 7 * s) / (36 * np.sqrt(a)) - (3 * s**4 + 7 * s * s - 16) / (810 * a)
        assert np.abs(found / near - 1).max() < 1e-9
    # both branches of the gamma distribution agree where they meet
    a = np.full(5, special.LARGE * 1.0001)
    x = a + np.array([-250.0, -90.0, 0.0, 90.0, 250.0])
    wide = special.gamma_cdf(x, a)
    before, special.LARGE = special.LARGE, 1e12
    try:
        assert np.abs(special.gamma_cdf(x, a) - wide).max() < 1e-12
    finally:
        special.LARGE = before


def test_beta_and_negative_binomial_quantiles():
    from tidewatch.functions import special

    for n, k in ((10, 3), (1000, 1), (5000, 4999)):
        q = special.beta_quantile(0.975, np.array([k + 1.0]), np.array([float(n - k)]))[0]
        tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(q) + (n - j) * math.log1p(-q)) for j in range(k + 1))
        assert tail == pytest.approx(0.025, rel=1e-9)
    for r, share in ((0.5, 0.9), (12.5, 0.2), (3000.5, 0.6)):
        total, walk = 0.0, []
        for j in range(40_000):
            total += math.exp(math.lgamma(j + r) - math.lgamma(r) - math.lgamma(j + 1) + r * math.log(share) + j * math.log1p(-share))
            walk.append(total)
        for p in (0.025, 0.975):
            assert special.negative_binomial_quantile(p, np.array([r]), np.array([share]))[0] == sum(v < p for v in walk)
    q = special.negative_binomial_quantile(0.975, np.array([1e9 + 0.5]), np.array([0.5]))[0]
    assert abs(q - (1e9 + 1.959964 * math.sqrt(2e9))) < 10
    u, mean = np.array([0.0001, 0.3, 0.5, 0.999, 0.5]), np.array([3.0, 3.0, 250.0, 250.0, 0.0])
    for got, p, m in zip(special.poisson_quantile(u, mean), u, mean, strict=True):
        total, j = 0.0, 0
        while m and (total := total + math.exp(j * math.log(m) - m - math.lgamma(j + 1))) < p:
            j += 1
        assert got == j


def test_predicted_counts_have_no_cap(spark):
    from tidewatch.operators import counts

    df = spark.createDataFrame([("a", True, 2.0), ("b", False, 5.0)], "g string, hit boolean, h double").unionByName(spark.range(200_000).selectExpr("'c' as g", "true as hit", "1e-4D as h"))
    got = {r.g: (r.events, r.lo, r.hi) for r in counts.count_predictive(df, ["g"], "hit", "h", future=40.0).collect()}
    assert got["b"][0] == 0 and got["b"][1] == 0
    assert got["c"][0] == 200_000 and 397_000 < got["c"][1] < 400_000 < got["c"][2] < 403_500


def test_ranks_and_running_sums_by_ranges(spark):
    from pyspark.sql import functions as F

    from tidewatch.operators import ranks

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, rng.random() * 5, float("inf")]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, id long").repartition(7)
    key = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=key)
        want |= {r[2]: (k + 1, len(own)) for k, r in enumerate(own)}
    got = ranks.ranked(df, ["g"], ["x", "id"], ranks.range_of(df, "x", 16), "k", "n").collect()
    assert len(got) == len(rows) and {r.id: (r.k, r.n) for r in got} == want
    everything = ranks.ranked(df, [], ["id"], ranks.range_of(df, "id", 8), "k").collect()
    assert all(r.k == r.id + 1 for r in everything)
    none = ranks.ranked(df.where("false"), ["g"], ["x", "id"], ranks.range_of(df.where("false"), "x"), "k").collect()
    assert none == []
    values = df.where("x is not null").groupBy("g", "x").agg(F.count("*").alias("c"))
    for r in ranks.running(values, ["g"], "x", "c", ranks.range_of(values, "x", 5)).collect():
        own = [v for g, v, _ in rows if g == r.g and v is not None]
        assert (r.before, r.total) == (sum(v < r.x for v in own), len(own))


def test_largest_task_of_ranks_is_a_range(spark):
    """Three strata don't make three tasks: no window sorts more than a few ranges of one."""
    from tidewatch.operators import ranks

    df = spark.range(30_000).selectExpr("id", "id % 3 as g")
    own = df.withColumn("part", ranks.range_of(df, "id"))
    sizes = [r["count"] for r in own.groupBy("g", "part").count().collect()]
    assert len(sizes) >= 3 * 200 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_stratified_sample_shares_out_in_turns(spark):
    rng = random.Random(6)
    sizes = {"a": 3, "b": 40, "c": 7, "d": 1, "e": 22}
    rows = [(f"{s}{k}", s) for s, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, s string")
    for n in (1, 4, 5, 17, 33, 60, 73, 200):
        take, turn, left = dict.fromkeys(sizes, 0), 0, n
        while left and any(take[s] < sizes[s] for s in sizes):
            turn += 1
            for s in sorted(sizes):
                if left and sizes[s] >= turn:
                    take[s], left = take[s] + 1, left - 1
        got = resampling.stratified_sample(df, ["s"], n, 9, "id").collect()
        assert {s: sum(r.s == s for r in got) for s in sizes} == take
        assert sum(r.weight for r in got) == pytest.approx(sum(sizes[s] for s in sizes if take[s]))


def test_threshold_sweep_equals_one_threshold_at_a_time(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows, units_ = [], []
    for s in range(12):
        x = 0.0
        for k in range(rng.choice([1, 2, 30, 60])):
            x += rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0, 3.0])
            rows.append(("m" if s % 2 else "q", s, float(k), x if rng.random() > 0.05 else float("nan")))
        units_.append((s, 0.0, 60.0, rng.choice([None, 20.0, 41.0]), s % 3))
    sc = spark.createDataFrame(rows, "method string, series_id long, t double, score double")
    u = unit(spark, units_)
    grid = spark.createDataFrame([(m, v) for m in ("m", "q") for v in (-1e300, -2.0, 0.0, 0.5, 1.0, 4.0, 1e9)], "method string, threshold double")
    for d, r, gap in ((1, 1, 0.0), (2, 2, 3.0), (3, 2, 0.0)):
        crossed = sc.join(grid, "method")
        keys = ["method", "threshold"]
        want = metrics.alarm_metrics(metrics.contributions(crossed, u, F.col("threshold"), d, r, 10.0, gap, keys), keys)
        got = metrics.operating_curve(sc, u, grid, d, r, 10.0, gap).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_component_bootstrap_against_brute_force(spark):
    from tidewatch.operators import composed

    rng = np.random.default_rng(3)
    groups = [(int(i // 3), int(rng.integers(2)), float(rng.integers(0, 12))) for i in range(40)]
    entries = [(i, int(rng.integers(3))) for i in range(30)]
    responses = [(i, int(rng.integers(2)), int(rng.integers(3)), float(rng.integers(0, 12))) for i in range(90)]
    draws = composed.component_draws(spark.createDataFrame(groups, "source long, kind int, height double"), spark.createDataFrame(entries, "entry_id long, stratum int"), spark.createDataFrame(responses, "response_id long, kind int, stratum int, height double"), 2.0, 600, 5, 4.0)
    rows = draws.toPandas().sort_values("replicate")
    point = sum(sum(e == s for _, e in entries) / 30 * np.mean([r[3] <= h for r in responses if r[1] == k and r[2] == s]) for _, k, h in groups for s in range(3)) / 2.0
    assert len(rows) == 600 and np.allclose(rows["point"], point)
    # each source of uncertainty has the mean of the point rate, and their variances add up to about the joint one
    for c in ("joint", "groups", "entries", "responses"):
        assert abs(rows[c].mean() - point) < 4 * rows[c].std() / 600**0.5 + 1e-12
    parts = rows[["groups", "entries", "responses"]].var().sum()
    assert 0.75 < parts / rows["joint"].var() < 1.25
    assert abs(rows["count"].mean() - 4 * point) < 5 * (4 * point) ** 0.5 / 600**0.5 + 4 * rows["joint"].std() / 5
    summary = {r.component: r for r in composed.component_bootstrap(draws).collect()}
    assert summary["joint"].count_lo == sorted(rows["count"])[14] and summary["groups"].count_lo is None
    assert summary["entries"].lo == pytest.approx(np.quantile(rows["entries"], 0.025))


def walked(t, x, crossings, c):
    """The rules of an emission, one at a time, in plain Python."""
    from tidewatch.functions.signal import decorrelation_time

    out, begin, dt = [], t[0], float(np.median(np.diff(t)))
    raw = math.ceil(c.least / (1 - c.quantile))
    k = 1 if c.gated else 0
    while (now := begin + k * c.cadence) < t[-1] + c.cadence / 2:
        k += 1
        known = [e for e in crossings if e[0] <= now]
        if c.gated and (len([v for v in t if v <= now]) < 3 or len(known) < raw):
            continue
        first = begin if c.window is None else max(begin, now - c.window)
        back = first > begin and len([e for e in known if e[0] >= first]) < raw
        while True:
            start = begin if back else first
            past = [v for s, v in zip(t, x, strict=True) if start <= s <= now]
            gap = c.gap if c.gap is not None else decorrelation_time(np.array(past), dt) if len(past) >= 3 else dt
            own, chains = [e for e in known if e[0] >= start], []
            for e in own:
                if chains and e[0] - chains[-1][-1][0] <= gap:
                    chains[-1].append(e)
                else:
                    chains.append([e])
            kept = [max(chain, key=lambda e: (e[1], -e[0])) for chain in chains]
            level = c.threshold if c.threshold is not None else min(float(np.quantile([e[1] for e in kept], c.quantile)), float(np.nextafter(1, 0))) if kept else None
            beyond = [e[1] - level for e in kept if e[1] > level] if level is not None else []
            if not c.gated or len(beyond) >= c.least or back or first == begin:
                break
            back = True
        if level is None or (c.gated and len(beyond) < c.least):
            continue
        b = c.rate + sum(beyond)
        p = (c.exceedance if c.threshold is not None else len(beyond) / len(kept)) * (b / (b + 1 - level)) ** (c.shape + len(beyond))
        exposure = max(now - start, dt)
        out.append((round(now, 6), len(kept), len(beyond), round(exposure, 6), round(gap, 6), sum(e[2] > 0 for e in kept), round(level, 9), round(p, 9), round(len(kept) / exposure * p * 3600, 9), "full_history" if back else ""))
    return out


@pytest.mark.parametrize("changes", [{}, {"gap": None}, {"window": None, "gap": None}, {"gated": False, "threshold": 0.4, "exceedance": 0.2}, {"gated": False, "threshold": 0.4, "exceedance": 0.2, "gap": None}, {"least": 4}])
def test_emissions_equal_walking_each(spark, changes):
    from tidewatch.functions.emission import Config
    from tidewatch.operators.emissions import emission_paths

    rng = random.Random(12)
    config = Config(**{"cadence": 7.0, "shape": 3.0, "rate": 2.0, "window": 40.0, "least": 1, "refresh": 21.0, "gap": 2.5, "draws": 500} | changes)
    series, rows, events_ = {}, [], []
    for s in range(9):
        n = rng.choice([2, 3, 40, 200, 260])
        t = [0.5 * k for k in range(n)]
        x = [math.sin(k / 3) + rng.gauss(0, 0.4) for k in range(n)]
        cut = n if s != 4 else n // 2
        own = sorted((rng.random() * t[-1], rng.choice([0.2, 0.5, 0.9, 1.3, rng.random()]), rng.choice([-1, 1])) for _ in range(rng.choice([0, 3, 30, 60])))
        own = [e for e in own if e[0] <= (t[cut - 1] if cut else 0)]
        series[s] = (t[:cut], x[:cut], own)
        rows += [(s, k, a, v if k < cut else float("nan"), 0.0) for k, (a, v) in enumerate(zip(t, x, strict=True))]
        events_ += [(s, e[0], k, e[1], e[2]) for k, e in enumerate(own)]
    got = emission_paths(spark.createDataFrame(rows, "series_id long, i long, t double, x double, dx double"), spark.createDataFrame(events_, "series_id long, t double, i_detect long, severity double, side int"), config, draws=True).collect()
    for s, (t, x, own) in series.items():
        mine = sorted((r for r in got if r.series_id == s), key=lambda r: r.t)
        want = walked(t, x, own, config) if len(t) >= 3 else []
        assert [(round(r.t, 6), r.n, r.exceedances, round(r.exposure, 6), round(r.gap, 6), r.positive, round(r.threshold, 9), round(r.p_critical, 9), round(r.rate, 9), "full_history" if "full_history" in r.flags else "") for r in mine] == want
        held = None
        for r in mine:  # draws and intervals are renewed after `refresh` seconds only
            if held is None or r.t - held.t >= 21 - 1e-9:
                held = r
                assert r.drawn_at == r.t
            assert (r.lo, r.hi, r.draws) == (held.lo, held.hi, held.draws) and r.n == r.positive + r.negative and ("prior_dominated" in r.flags) == (r.exceedances < 3)
    assert got


def test_draws_of_a_rate_have_their_moments():
    from tidewatch.functions.emission import Config, Tail, draw_rates

    tail = Tail(40, 10, 0.6, False, 13.0, 5.0, 0.25, 0.0)
    for gated in (True, False):
        config = Config(cadence=1.0, shape=3.0, rate=2.0, gated=gated, draws=200_000)
        drawn = draw_rates(tail, 1800.0, config, [1, 2])
        chance, square = (5.0 / 5.4) ** 13, (5.0 / 5.8) ** 13
        # thinned Poisson counts are Poisson; unthinned ones are scaled
        second = 10 + 100 if gated else 0.0625 * (40 + 1600)
        mean, var = 10 * chance * 2, 4 * (second * square - 100 * chance**2)
        assert drawn.mean() == pytest.approx(mean, rel=0.01) and drawn.var() == pytest.approx(var, rel=0.03)
        assert np.array_equal(drawn, draw_rates(tail, 1800.0, config, [1, 2]))


def test_isotonic_equals_pooling_in_one_go(spark):
    rng = random.Random(9)
    for n, values, session_parts in ((3000, 700, "4"), (60, 60, "4"), (500, 3, "4"), (1, 1, "4")):
        rows = [(float(rng.randrange(values)), rng.choice([0.0, 1.0, rng.random()]), rng.choice([1.0, 2.5])) for _ in range(n)]
        points = {}
        for x, y, w in rows:
            a, b = points.get(x, (0.0, 0.0))
            points[x] = (a + w, b + w * y)
        stack = []
        for x in sorted(points):
            w, wy = points[x]
            stack.append([[x], w, wy])
            while len(stack) > 1 and stack[-2][2] / stack[-2][1] >= stack[-1][2] / stack[-1][1] - 1e-15:
                xs, w, wy = stack.pop()
                stack[-1] = [stack[-1][0] + xs, stack[-1][1] + w, stack[-1][2] + wy]
        want = {x: wy / w for xs, w, wy in stack for x in xs}
        got = {r.x: r.fit for r in rates.isotonic(spark.createDataFrame(rows, "x double, y double, w double").repartition(5), "x", "y", "w", fan=3).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)
    assert rates.isotonic(spark.createDataFrame([], "x double, y double, w double"), "x", "y", "w").count() == 0


def test_tiled_pairs_equal_all_pairs(spark):
    rng = random.Random(10)

    def intervals(n):
        out = []
        for k in range(n):
            lo = rng.choice([rng.random() * 100, float(rng.randrange(100)), -float(rng.randrange(30))])
            length = rng.choice([0.0, 0.01, 1.0, rng.random() * 5, 64.0, 5000.0, float("inf"), -3.0])
            out.append((rng.choice(["a", "b", None]), k, rng.choice([lo, None]) if rng.random() < 0.05 else lo, lo + length))
        return out

    a, b = intervals(120), intervals(150)
    schema = "key string, name long, lo double, hi double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for keys, touching in ((["key"], True), ([], False), ([], True)):
        meets = lambda x, y: x <= y if touching else x < y  # noqa: E731, B023
        want = sorted((p[1], q[1]) for p in a for q in b if None not in (p[2], q[2]) and (not keys or (p[0] is not None and p[0] == q[0])) and meets(p[2], q[3]) and meets(q[2], p[3]))
        met = events.tiled_pairs(left, right, "lo", "hi", keys, touching)
        assert sorted((r.a.name, r.b.name) for r in met.collect()) == want
    plan = events.interval_conflicts(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert events.tiled_pairs(left.where("false"), right, "lo", "hi", []).count() == 0


def test_online_levels_of_one_long_series_among_short_ones(spark):
    """Memory goes by rows: one series of 60,000 beside 12,000 of five would be 720 million cells as a matrix."""
    from pyspark.sql import functions as F

    long = spark.range(60_000).selectExpr("-1L as series_id", "double(id) as t")
    short = spark.range(60_000).selectExpr("id div 5 as series_id", "double(id % 5) as t")
    rows = long.unionByName(short).withColumns({"bound": F.lit(0.0), "target": F.expr("double(xxhash64(series_id, t) % 1000) / 100")})
    cal = spark.range(2000).selectExpr("0.0D as bound", "double(xxhash64(id) % 1000) / 100 as target", "double(id) as t")
    for out in (conformal.aci(rows, cal, 0.1, 0.01, 1), conformal.dtaci(rows, cal, 0.1, [0.01, 0.05]), conformal.sliding_aci(rows, cal, 0.1, 0.01, 50)):
        got = out.groupBy().agg(F.count("*").alias("n"), F.avg(F.when(F.col("series_id") == -1, F.col("miss"))).alias("miss"), F.avg((F.col("upper").isNull()).cast("int")).alias("none")).first()
        assert got.n == 120_000 and got.none == 0 and abs(got.miss - 0.1) < 0.02


def test_quota_of_first_rows(spark):
    units_ = spark.createDataFrame([(k, 0.0, 9.0, 1.0 if k % 3 else None, 0) for k in range(50)], "series_id long, record_start double, record_end double, t_event double, stratum long").repartition(4)
    got = sorted(r.series_id for r in dataset.take_rows(units_, 7).collect())
    assert got == sorted([k for k in range(50) if k % 3 == 0] + [k for k in range(50) if k % 3][:7])


def test_audit_finds_each_planted_fault(spark):
    nan, inf = float("nan"), float("inf")
    good = lambda s, event=None: [(s, k, 10.0 * k, nan if event is not None and 10.0 * k > event else 1.0, nan if event is not None and 10.0 * k > event else 0.0) for k in range(5)]
    rows = {s: good(s) for s in range(8)} | {8: good(8, 20.0), 9: good(9, 20.0), 10: good(10)}
    rows[1][2] = (1, 2, 5.0, 1.0, 0.0)
    rows[2][1] = (2, 1, 10.0, inf, 0.0)
    rows[3][1] = (3, 1, 10.0, None, 0.0)
    rows[4] = rows[4][:4]
    rows[5].append((5, 4, 40.0, 1.0, 0.0))
    rows[9][4] = (9, 4, 40.0, nan, 0.0)
    units_ = [(s, 0.0, 40.0, {8: 20.0, 9: 20.0, 7: 50.0}.get(s), 0) for s in range(10)] + [(6, 0.0, 40.0, None, 0)]
    got = sorted((r.rule, r.series_id) for r in dataset.audit_records(spark.createDataFrame([r for s in rows.values() for r in s], "series_id long, i long, t double, x double, dx double").repartition(3), unit(spark, units_)).collect())
    assert got == sorted([("time", 1), ("grid", 1), ("before", 2), ("before", 3), ("grid", 4), ("unique", 5), ("grid", 5), ("time", 5), ("unique", 6), ("event", 7), ("after", 9), ("unit", 10)])
    whole = [r for r in good(0) + good(8, 20.0)]
    clean = dataset.audit_records(spark.createDataFrame(whole, "series_id long, i long, t double, x double, dx double"), unit(spark, [(0, 0.0, 40.0, None, 0), (8, 0.0, 40.0, 20.0, 0)]))
    assert clean.count() == 0


def test_scan_checks_each_row(spark, tmp_path):
    path = f"file://{tmp_path}/series"
    spark.createDataFrame([(k, "train" if k % 2 else "test", '{"config_hash": "%s"}' % ("b" if k == 7 else "a")) for k in range(10)], "series_id long, split string, meta string").write.partitionBy("split").parquet(path)
    keys = lambda **a: sorted(r.series_id for r in dataset.read_series(spark, path, **a).select("series_id", "meta").collect())
    assert keys() == list(range(10)) and keys(split="train") == [1, 3, 5, 7, 9] and keys(split="train", limit=2) == [1, 3]
    assert keys(split="train", config_hash="a") == [1, 3, 5, 9] and keys(split="test", config_hash="a", checked=True) == [0, 2, 4, 6, 8]
    with pytest.raises(Exception, match="another configuration, series_id 7"):
        keys(split="train", config_hash="a", checked=True)


def test_tracking_follows_a_shift(spark):
    """A rate path that is the hazard two steps later has lag 2, in every draw of alike series."""
    from tidewatch.operators import counts

    grid = [float(k) for k in range(12)]
    hazard = [math.exp(-((g - 4.0) ** 2) / 2) / 2.5066282746310002 for g in grid]
    units_ = [(s, 0.0, 99.0, 4.0 if s % 2 else None, s % 2) for s in range(10)]
    paths = [(s, g, 3 * (hazard[k - 2] if k >= 2 else 0.0)) for s in range(10) for k, g in enumerate(grid)]
    got = counts.bootstrap_tracking(spark.createDataFrame(paths, "series_id long, t double, rate double"), unit(spark, units_), grid, 1.0, 4, 100, 3).first()
    assert (got.lag, got.lag_lo, got.lag_hi, got.replicates, got.estimable) == (2.0, 2.0, 2.0, 100, True)
    flat = counts.bootstrap_tracking(spark.createDataFrame([(s, g, 1.0) for s in range(10) for g in grid], "series_id long, t double, rate double"), unit(spark, units_), grid, 1.0, 4, 20, 3).first()
    assert (flat.lag, flat.estimable) == (0.0, False)


def test_timed_streams_take_rows_out_of_order(spark, tmp_path):
    """Rows spread over micro-batches, up to a minute late, give the batch operators' rows; what is open closes by timer."""
    import datetime as dt

    from tidewatch.streaming import sources, timed

    rng, base = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(k % 3, base + dt.timedelta(seconds=10 * (k // 3), microseconds=rng.randrange(1000)), rng.choice([0.0, 1.0, 2.0, 3.0])) for k in range(120)]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(60)))
    path, schema = f"file://{tmp_path}/in", "series_id long, ts timestamp, score double"
    for b in range(4):
        spark.createDataFrame(late[b * 30 : (b + 1) * 30], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(99, base + dt.timedelta(days=1), 0.0)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    zero = round(base.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    own = spark.createDataFrame([(s, float(round((ts - base).total_seconds() * 1e6)), v) for s, ts, v in rows], "series_id long, t double, score double")
    got = sources.run_to_end(timed.timed_episodes(stream, 2.0, 2, 2, "10 minutes", 1000.0)).collect()
    want = events.episodes(own, 2.0, 2, 2).collect()
    assert want and sorted(map(tuple, got)) == sorted((r.series_id, int(r.t_start) + zero, int(r.t_end) + zero, r.max_score) for r in want)
    # a short idle time splits a series where it is silent
    far = spark.createDataFrame([(1, base + dt.timedelta(seconds=s), 3.0) for s in (0, 10, 500, 510)] + [(2, base + dt.timedelta(days=1), 0.0)], schema).coalesce(1)
    far.write.parquet(f"file://{tmp_path}/far")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/far")
    split = sources.run_to_end(timed.timed_episodes(stream, 2.0, 2, 2, "0 seconds", 100.0)).collect()
    assert sorted((r.t_start - zero, r.t_end - zero) for r in split) == [(10_000_000, 10_000_000), (510_000_000, 510_000_000)]


def test_md5_heads_match_hashlib():
    import hashlib

    from tidewatch.functions.digest import md5_heads

    for prefix, start, stop in ((b"17|0|5|", 0, 1234), (b"", 8, 12), (b"x" * 49, 0, 12), (b"x" * 60, 95, 105), (b"a", 3, 3)):
        assert md5_heads(prefix, start, stop).tolist() == [int(hashlib.md5(prefix + b"%d" % k).hexdigest()[:8], 16) for k in range(start, stop)]


def _many_series(spark, n=9000):
    units = spark.range(n).selectExpr("id AS series_id", "id % 2 AS stratum")
    rows = spark.range(2 * n).selectExpr(f"id % {n} AS series_id", "CAST(id * 7 % 5 AS DOUBLE) AS score", "CAST(id * 13 % 3 = 0 AS INT) AS label")
    return units, rows


def test_draws_leave_blocks_as_one_row_for_each_key(spark):
    # 4,500 series a stratum are two blocks each; rows don't grow with replicates
    units, rows = _many_series(spark)
    packed = rows.groupBy("series_id", "score").count().withColumnRenamed("count", "c")
    got = resampling.drawn_vectors(packed, units, ["score"], ["c"], 20, 3).collect()
    assert len(got) == 4 * 5
    times = {(r.replicate, r.series_id): r.times for r in resampling.bootstrap_draws(units, 20, 3).collect()}
    want = np.zeros((5, 20))
    for r in packed.collect():
        want[int(r.score)] += [r.c * times.get((k, r.series_id), 0) for k in range(20)]
    sums = np.zeros((5, 20))
    for r in got:
        sums[int(r.score)] += resampling.unpack(r.c, 20)
    assert (sums == want).all()


def test_drawn_ranks_against_brute_force(spark):
    units, rows = _many_series(spark)
    draws = pd.DataFrame([r.asDict() for r in resampling.bootstrap_draws(units, 5, 3).collect()])
    all_rows = pd.DataFrame([r.asDict() for r in rows.collect()]).merge(draws, on="series_id")
    for r in resampling.drawn_ranks(rows, units, 5, 3, [-1.0, 1.0, 3.0, 9.0]).collect():
        own = all_rows[all_rows.replicate == r.replicate]
        pos, neg = (own[own.label == y].groupby("score").times.sum() for y in (1, 0))
        assert r.u == sum(p * n * (1.0 if a > b else 0.5 if a == b else 0.0) for a, p in pos.items() for b, n in neg.items())
        assert (r.p, r.n) == (pos.sum(), neg.sum())
        bins = own.groupby(np.searchsorted([1.0, 3.0], own.score, "right"))
        assert [b.n for b in r.bins] == bins.times.sum().tolist()
        assert [b.sq for b in r.bins] == bins.apply(lambda g: ((g.score - g.label) ** 2 * g.times).sum()).tolist()


def test_sums_of_draws_leave_out_what_is_not_drawn(spark):
    units = spark.createDataFrame([(k, 0) for k in range(4)], "series_id long, stratum int")
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "b", float("inf")), (9, "c", 1.0)], "series_id long, g string, v double")
    times = {(r.replicate, r.series_id): r.times for r in resampling.bootstrap_draws(units, 30, 5).collect()}
    got = {(r.g, r.replicate): r.v for r in resampling.drawn_sums(rows, units, ["g"], ["v"], 30, 5).collect()}
    assert got == {(g, k): v * times[k, s] for k in range(30) for s, g, v in ((0, "a", 1.0), (1, "b", float("inf"))) if (k, s) in times}


def test_equal_variances_tie(spark):
    # a window of one period and the next holds the same six values seven times, in other orders
    rows = spark.createDataFrame([([0.1, 0.7, 27.54, 0.9, 0.2, 143.28] * 2,)], "w array<double>")
    assert scores.ews_score(rows, "variance", 0.5, 12, 12).first().ews == 0.0


def test_crowded_intervals_are_dealt_to_many_tasks(spark):
    # 3,000 intervals of one place are no task of 9 million pairs
    one = spark.range(3000).selectExpr("id AS name", "id % 10 AS lo", "id % 10 + 100 AS hi")
    met = events.interval_conflicts(one, one)
    assert met.count() == 9_000_000
    sizes = met.groupBy(F_spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 9_000_000


def F_spark_partition_id():
    from pyspark.sql import functions as F

    return F.spark_partition_id()


def test_ungated_emissions_draw_nothing_unasked(monkeypatch):
    from tidewatch.functions import emission

    monkeypatch.setattr(emission, "draw_rates", lambda *a: pytest.fail("drawn"))
    config = emission.Config(cadence=10.0, shape=2.0, rate=1.0, gated=False, threshold=0.5, exceedance=0.3, draws=0)
    at = np.arange(0, 100.0)
    found = emission.emit(1, at, at, (np.array([20.0, 40.0]), np.array([0.6, 0.9]), np.array([1, -1])), config)
    assert len(found) and found[-1]["lo"] < found[-1]["rate"] < found[-1]["hi"]
    before = emission.garwood.cache_info().misses
    emission.emit(2, at, at, (np.array([20.0, 40.0]), np.array([0.6, 0.9]), np.array([1, -1])), config)
    assert emission.garwood.cache_info().misses == before


def test_sweep_holds_a_series_across_batches_in_tasks_of_its_own(spark):
    from tidewatch.functions.sweep import sweep
    from tidewatch.operators import metrics

    rng = random.Random(8)
    rows = [("m", s, float(t), float(rng.randrange(6))) for s in range(3) for t in range(150)]
    grid = spark.createDataFrame([("m", float(v)) for v in range(5)], "method string, threshold double")
    found = metrics.sweep_episodes(spark.createDataFrame(rows, "method string, series_id long, t double, score double"), grid, 2, 3, 4.0)
    # rows are dealt by series in as many tasks as are asked for, not as few as their bytes would give, and hold no thresholds
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1
    want = sorted((r.series_id, int(r.threshold) + 1, r.t_start, r.t_end) for r in found.collect())
    frame = pd.DataFrame([(m, s, t, int(v) + 1 if v < 5 else 5, 5) for m, s, t, v in rows], columns=["method", "series_id", "t", "level", "of"])
    for size in (1, 7, 150, 1000):
        parts = (frame.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(frame), size))
        out = pd.concat(list(sweep(parts, ["method", "series_id"], [], 2, 3, 4.0)))
        assert sorted(zip(out["series_id"], out["j"], out["t_start"], out["t_end"])) == want


def test_timed_state_is_asked_a_few_times_for_a_key(spark):
    from tidewatch.streaming import timed

    calls = []

    class State:
        def __init__(self, name):
            self.name, self.value = name, []

        def get(self):
            calls.append(f"{self.name}.get")
            return iter(self.value) if self.name == "waiting" else self.value or None

        def appendList(self, rows):
            calls.append("append")
            self.value += rows

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = []

    class Handle:
        def getListState(self, name, schema):
            return State(name)

        getValueState = getListState

        def registerTimer(self, at):
            calls.append(f"timer {at}")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 10

    one = timed.InOrder(lambda s, row: ((s[0] + row[1],), []), lambda s: (None, [s]), (0.0,), "total double", ["series_id", "total"], 1000)
    one.init(Handle())
    frames = [pd.DataFrame({"at": [3000, 2000], "x": [1.0, 2.0]}), pd.DataFrame({"at": [2500], "x": [4.0]})]
    assert list(one.handleInputRows((7,), iter(frames), Times())) == []
    assert calls == ["append", "append", "held.get", "timer 2", "update"]
    calls.clear()
    out = list(one.handleExpiredTimer((7,), Times(), None))
    assert [tuple(r) for f in out for r in f.itertuples(index=False)] == [(7, 7.0)]
    assert calls == ["waiting.get", "held.get", "clear", "clear"]


def test_steps_of_a_fit_are_few_tasks_whatever_the_partitions(spark):
    from tidewatch.operators import fits

    df = spark.range(1000).repartition(100).selectExpr("id % 10 / 10 AS x", "id % 7 / 7 AS y")
    sc = spark.sparkContext
    sc.setJobGroup("fit", "fit")
    try:
        fitted = fits.fit_linear_quantile(df, ["x"], "y", [0.5], steps=3)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(fitted[0.5]) == 2
    seen = sc.statusTracker()
    tasks = [seen.getStageInfo(s).numTasks for j in seen.getJobIdsForGroup("fit") for s in seen.getJobInfo(j).stageIds if seen.getStageInfo(s)]
    assert tasks and max(tasks) <= max(fits.PARTS, 2 * sc.defaultParallelism)


def test_methods_are_compared_without_computing_them_again(spark):
    from tidewatch.operators import metrics

    rows = spark.createDataFrame([("a", 2.0, 0.5), ("b", 1.0, 0.1)], "method string, false_per_hour double, sensitivity double")
    for out in (metrics.compare_methods(rows, "a"), metrics.compare_guards(rows, "a")):
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert {r.method: r.reduction for r in out.collect()} == {"a": 0.0, "b": 0.5}
    assert metrics.compare_methods(rows, "c").collect() == []


def test_ratio_reads_contributions_once(spark, tmp_path):
    # the estimate comes with the draws; series of no stratum count in it and are never drawn
    path = f"file://{tmp_path}/own"
    spark.createDataFrame([(k, k % 3, 1 + k % 2) for k in range(40)], "series_id long, a long, b long").write.parquet(path)
    own = spark.read.parquet(path)
    units = spark.createDataFrame([(k, None if k >= 36 else k % 2) for k in range(40)], "series_id long, stratum int")
    got = resampling.bootstrap_ratio(own, units, "a", "b", 30, 5)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    times = {(r.replicate, r.series_id): r.times for r in resampling.bootstrap_draws(units, 30, 5).collect()}
    drawn = [sum(k % 3 * times.get((r, k), 0) for k in range(36)) / sum((1 + k % 2) * times.get((r, k), 0) for k in range(36)) for r in range(30)]
    row = got.first()
    assert (row.estimate, row.replicates) == (sum(k % 3 for k in range(40)) / 60, 30)
    assert np.allclose([row.lo, row.hi], np.quantile(drawn, [0.025, 0.975]))
    empty = resampling.bootstrap_ratio(own.withColumn("b", F_lit(0)), units, "a", "b", 30, 5).first()
    assert (empty.estimate, empty.lo, empty.replicates) == (math.inf, None, 0)


def F_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


@pytest.mark.parametrize("groups", [None, 1, 2])
def test_timed_series_of_a_group_keep_apart(spark, tmp_path, groups):
    """Whatever the number of groups: rows out of order, series without an id, and times of silence give the same episodes."""
    import datetime as dt

    from tidewatch.streaming import sources, timed

    rng, base = random.Random(4), dt.datetime(2024, 1, 1)
    names = [None, 0, 3, 2**60 + 1]
    rows = [(s, base + dt.timedelta(seconds=10 * k + (400 if k > 20 else 0), microseconds=rng.randrange(1000)), rng.choice([0.0, 1.0, 2.0, 3.0])) for k in range(40) for s in names]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(60)))
    path, schema = f"file://{tmp_path}/in", "series_id long, ts timestamp, score double"
    for b in range(4):
        spark.createDataFrame(late[b * 40 : (b + 1) * 40], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(99, base + dt.timedelta(days=1), 0.0)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    got = sources.run_to_end(timed.timed_episodes(stream, 2.0, 2, 2, "10 minutes", 100.0, groups)).collect()
    zero = round(base.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    want = []
    for name in names:
        own = sorted((round((ts - base).total_seconds() * 1e6), v) for s, ts, v in rows if s == name)
        for spell in ([r for r in own if r[0] < 300e6], [r for r in own if r[0] >= 300e6]):
            df = spark.createDataFrame([(1, float(t), v) for t, v in spell], "series_id long, t double, score double")
            want += [(name, int(r.t_start) + zero, int(r.t_end) + zero, r.max_score) for r in events.episodes(df, 2.0, 2, 2).collect()]
    assert {r[0] for r in want} == set(names)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_timed_calls_go_by_groups_of_series():
    from tidewatch.streaming import timed

    calls = []

    class State:
        def __init__(self, name):
            self.name, self.value = name, []

        def get(self):
            calls.append(f"{self.name}.get")
            return iter(self.value) if self.name == "waiting" else self.value or None

        def appendList(self, rows):
            calls.append("append")
            self.value += rows

        def put(self, rows):
            calls.append("put")
            self.value = rows

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = []

    class Handle:
        def getListState(self, name, schema):
            return State(name)

        getValueState = getListState

        def registerTimer(self, at):
            calls.append(f"timer {at}")

    class Times:
        now = 10

        def getCurrentWatermarkInMs(self):
            return self.now

    group = timed.Together(lambda s, row: ((s[0] + row[1],), []), lambda s: (None, [s]), (0.0,), ["absent", "series_id", "at", "x"], ["series_id", "total"], 5000)
    group.init(Handle())
    frame = pd.DataFrame({"absent": False, "series_id": list(range(500)) * 2, "at": [2000] * 500 + [9000] * 250 + [30000] * 250, "x": 1.0})
    assert list(group.handleInputRows((7,), iter([frame]), Times())) == []
    assert calls == ["append", "held.get", "timer 2", "update"]
    calls.clear()
    # at 10 ms half of the series have been silent for 5 ms after their first row, the others go on
    done = [tuple(r) for f in group.handleExpiredTimer((7,), Times(), None) for r in f.itertuples(index=False)]
    assert sorted(done) == [(s, 1.0) for s in range(500)]
    assert calls == ["waiting.get", "held.get", "put", "timer 15", "update"]


@pytest.mark.parametrize("name", ["bootstrap_false_rate", "cluster_bootstrap"])
def test_ratio_queries_compute_their_episodes_once(spark, sf_dir, name):
    from tidewatch.plans import registry

    # with contributions computed twice there are 22 windows and 25 scans
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 12 and plan.count("Relation [") <= 14


def test_scores_at_risk_come_from_one_window(spark, sf_dir):
    from tidewatch.plans import registry

    # with scores joined with their own sums there are 14 scans and 12 joins
    plan = registry.QUERIES["bootstrap_false_rate"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 8 and plan.count("Join ") <= 6


def test_contributions_of_series_with_few_scores(spark):
    # no score in the record; fewer than the debounce; an event that nothing precedes; an episode before an event and a false one
    units = spark.createDataFrame([(1, 0.0, 10.0, None, 0), (2, 0.0, 10.0, None, 0), (3, 0.0, 10.0, 1.0, None), (4, 0.0, 40.0, 30.0, 2), (5, 0.0, 9.0, 5.0, 1)], "series_id long, record_start double, record_end double, t_event double, stratum int")
    rows = [(1, 11.0, 9.0), (2, 3.0, 9.0), (3, 2.0, 0.0), (3, 3.0, 9.0), *((4, float(t), 9.0 if t in (5, 6, 26, 27, 28) else 0.0) for t in range(41))]
    got = metrics.contributions(spark.createDataFrame(rows, "series_id long, t double, score double"), units, 5.0, 2, 2, 10.0, 3.0)
    # the series' stratum, exposure, opportunities, observable, detected, false_episodes, lead
    assert {r.series_id: tuple(r)[1:] for r in got.collect()} == {1: (0, 10.0, 0, 0, 0, 0, None), 2: (0, 10.0, 1, 0, 0, 0, None), 3: (None, 0.0, 0, 0, 0, 0, None), 4: (2, 30.0, 31, 1, 1, 1, 3.0), 5: (1, 0.0, 0, 0, 0, 0, None)}


def test_ranges_are_found_in_two_steps(spark):
    import bisect

    from tidewatch.operators.ranks import range_of

    values = [None, float("nan"), -1e9, *(float(k * k % 997) for k in range(3000))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for ranges in (2, 3, 5, 300):
        cuts = sorted(set(df.selectExpr(f"percentile_approx(v, array({', '.join(f'{k / ranges}D' for k in range(1, ranges))}), {20 * ranges})").first()[0]))
        got = df.select("v", range_of(df, "v", ranges).alias("r"))
        for r in got.collect():
            assert r.r == (0 if r.v is None else len(cuts) if math.isnan(r.v) else bisect.bisect_right(cuts, r.v))
    # no row meets all 299 cuts: a filter finds the run of cuts, another the place in it
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") > 1


def test_draw_hashes_are_those_of_hashlib():
    import hashlib

    from tidewatch.functions.digest import md5_heads

    for prefix, start, stop in ((b"23|1|5|", 0, 10100), (b"", 99990, 100100), (b"x" * 53, 5, 15), (b"x" * 60, 5, 15)):
        assert md5_heads(prefix, start, stop).tolist() == [int.from_bytes(hashlib.md5(prefix + b"%d" % k).digest()[:4], "big") for k in range(start, stop)]
