"""Crossings, runs, episodes and clusters: sequence operators as islands over ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def crossings(samples: DataFrame, high: float, low: float, critical_high: float, critical_low: float, scale: str | None = None) -> DataFrame:
    """Outward crossings of two levels: series_id, side, t, i_detect, outward_rate, critical_rate, severity.

    Time and rate are interpolated between the two samples around a level; severity is the outward rate over the
    critical rate (times the `scale` column of the later sample). Uses a sample and the one before it only.
    """
    w = _by(["series_id"], "i")
    prev = samples.withColumns({"px": F.lag("x").over(w), "pdx": F.lag("dx").over(w), "pt": F.lag("t").over(w)})
    side = F.when((F.col("px") < high) & (F.col("x") >= high), 1).when((F.col("px") > low) & (F.col("x") <= low), -1)
    found = prev.withColumn("side", side).where("side is not null")
    part = (F.when(F.col("side") == 1, high).otherwise(low) - F.col("px")) / (F.col("x") - F.col("px"))
    found = found.withColumn("f", part)
    critical = F.when(F.col("side") == 1, critical_high).otherwise(critical_low) * (F.col(scale) if scale else 1.0)
    out = found.select("series_id", "side", (F.col("pt") + F.col("f") * (F.col("t") - F.col("pt"))).alias("t"), F.col("i").alias("i_detect"), (F.col("side") * (F.col("pdx") + F.col("f") * (F.col("dx") - F.col("pdx")))).alias("outward_rate"), critical.alias("critical_rate"))
    return out.withColumn("severity", F.col("outward_rate") / F.col("critical_rate"))


def upcrossings(samples: DataFrame, level: float = 0.0) -> DataFrame:
    """series_id and the number of upward crossings of a level."""
    w = _by(["series_id"], "i")
    up = (F.lag("x").over(w) < level) & (F.col("x") >= level)
    return samples.withColumn("up", F.coalesce(up.cast("int"), F.lit(0))).groupBy("series_id").agg(F.sum("up").alias("n_up"))


def _chained(events: DataFrame, gap: float, keys: list[str]) -> DataFrame:
    w = _by(keys, "t", "i_detect")
    fresh = F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)
    return events.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(w)).drop("fresh")


def decluster(events: DataFrame, gap: float, keys: list[str] | None = None) -> DataFrame:
    """The event of largest severity (the first on ties) of each chain of events no more than gap apart; an event is
    compared with the raw event before it, not with the largest so far."""
    keys = keys or ["series_id"]
    best = Window.partitionBy(*keys, "cluster").orderBy(F.desc("severity"), "t", "i_detect")
    return _chained(events, gap, keys).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "cluster")


def clusters(events: DataFrame, gap: float, keys: list[str] | None = None) -> DataFrame:
    """Chains as in decluster(), one row each: cluster, first_t, last_t, n, retained_t and retained_severity."""
    keys = keys or ["series_id"]
    first = F.min_by(F.struct("t", "severity"), F.struct(-F.col("severity"), F.col("t"), F.col("i_detect")))
    return _chained(events, gap, keys).groupBy(*keys, "cluster").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"), first.alias("r")).select(*keys, "cluster", "first_t", "last_t", "n", F.col("r.t").alias("retained_t"), F.col("r.severity").alias("retained_severity"))


def cluster_members(events: DataFrame, gap: float, keys: list[str] | None = None) -> DataFrame:
    """Every event with its chain, as in decluster(), and whether it is the one retained; members stay rows, so that a
    chain of any length is none."""
    keys = keys or ["series_id"]
    best = Window.partitionBy(*keys, "cluster").orderBy(F.desc("severity"), "t", "i_detect")
    return _chained(events, gap, keys).withColumn("retained", F.row_number().over(best) == 1)


def runs_above(samples: DataFrame, limit: float, least: float = 0.0) -> DataFrame:
    """Maximal runs of samples above a limit, at least `least` seconds long: series_id, i_start, i_end, t_start, t_end, top."""
    w = _by(["series_id"], "i")
    marked = samples.withColumn("rn", F.row_number().over(w)).where(F.col("x") > limit)
    island = F.col("rn") - F.row_number().over(w)
    runs = marked.withColumn("island", island).groupBy("series_id", "island").agg(F.min("i").alias("i_start"), F.max("i").alias("i_end"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.max("x").alias("top"))
    return runs.where(F.col("t_end") - F.col("t_start") >= least).drop("island")


def episodes(scores: DataFrame, threshold: Column | float, debounce: int = 3, refractory: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Alarm episodes: keys, t_start, t_end, max_score.

    An episode opens at the debounce-th consecutive score that reaches the threshold and closes after `refractory`
    consecutive ones that don't; it ends at its last flag, and its maximum takes in the run that opened it. Runs of
    equal flags are islands; a quiet run of refractory scores starts a new segment, and a segment with a flagged run
    of debounce scores is an episode. threshold may be a column, so that many thresholds are one plan.
    """
    keys = keys or ["series_id"]
    flags = scores.withColumn("flag", (F.col("score") >= threshold).cast("int"))
    w = _by(keys, "t")
    rows = flags.withColumn("turn", F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("turn").over(w))
    rows = rows.withColumn("k", F.row_number().over(_by([*keys, "run"], "t")))
    runs = rows.groupBy(*keys, "run").agg(F.max("flag").alias("flag"), F.count("*").alias("n"), F.min(F.when(F.col("k") == debounce, F.col("t"))).alias("opens"), F.max("t").alias("last"), F.max("score").alias("top"))
    segment = F.sum(F.when((F.col("flag") == 0) & (F.col("n") >= refractory), 1).otherwise(0)).over(_by(keys, "run"))
    flagged = runs.withColumn("segment", segment).where("flag = 1")
    first = F.min(F.when(F.col("n") >= debounce, F.col("run"))).over(Window.partitionBy(*keys, "segment"))
    return flagged.withColumn("first", first).where("run >= first").groupBy(*keys, "segment").agg(F.min_by("opens", "run").alias("t_start"), F.max("last").alias("t_end"), F.max("top").alias("max_score")).drop("segment")


def merge_episodes(found: DataFrame, gap: float, keys: list[str] | None = None) -> DataFrame:
    """Episodes whose quiet gap is gap or less, merged: keys, t_start, t_end, max_score."""
    keys = keys or ["series_id"]
    w = _by(keys, "t_start", "t_end")
    fresh = F.when(F.col("t_start") - F.lag("t_end").over(w) > gap, 1).otherwise(0)
    return found.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(w)).groupBy(*keys, "chain").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max("max_score").alias("max_score")).drop("chain")


#: The coarsest level of tiles, which one tile fills.
TOP_LEVEL = 64


#: Rows of one side that meet as many of the other in a task, where intervals crowd.
CELL = 1024


def tiled_pairs(a: DataFrame, b: DataFrame, lo: str, hi: str, keys: list[str], touching: bool = True) -> DataFrame:
    """Rows of a and b, as structs a and b, whose intervals [lo, hi] overlap (touching: ends included) under equal keys.

    Intervals lie on tiles of their level, the first power of two (of the median length) that is no shorter than they are, so on
    two at most. A pair meets at the coarser of its two levels: each interval is put on tiles of its own level for the finer ones of the other side,
    and on tiles of each coarser level that the other side has. A pair counts in the tile that holds the later beginning, which both
    lie on, and so once. An interval whose ends are the wrong way round overlaps those that hold both, as the comparison of ends
    has it; null ends overlap nothing. Rows are multiplied by twice the number of levels at most; there are no pairs but those of a tile.
    """
    def lengths(df):
        return df.agg(F.percentile_approx(F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)), 0.5)).first()[0]

    base = float(lengths(a) or lengths(b) or 1.0)
    span = F.abs(F.col(hi) - F.col(lo)).cast("double")
    near = F.greatest(F.abs(F.col(lo)), F.abs(F.col(hi))).cast("double") < 2.0**52 * base
    level = F.when(~near | span.isNull(), TOP_LEVEL).when(span <= base, 0).otherwise(F.least(F.lit(TOP_LEVEL), F.ceil(F.log2(span / base)).cast("int")))
    level_of = lambda df: df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(F.struct(*df.columns).alias("row"), *(F.col(c).alias(f"_{c}") for c in keys), F.least(lo, hi).cast("double").alias("_lo"), F.greatest(lo, hi).cast("double").alias("_hi"), level.alias("own"))
    left, right = level_of(a), level_of(b)
    levels = [sorted(r[0] for r in side.select("own").distinct().collect()) for side in (left, right)]
    tile = lambda v, at: F.when(at >= TOP_LEVEL, F.lit(0)).otherwise(F.floor(v / (F.lit(base) * F.pow(F.lit(2.0), at)))).cast("long")

    def placed(side: DataFrame, others: list[int], name: str) -> DataFrame:
        """Tiles of own level, and of each coarser level of the other side."""
        more = F.filter(F.array(*(F.lit(x) for x in others)).cast("array<int>"), lambda x: x > F.col("own"))
        on = side.withColumn("at", F.explode(F.array_union(F.array("own"), more)))
        on = on.withColumn("tile", F.explode(F.sequence(tile(F.col("_lo"), F.col("at")), tile(F.col("_hi"), F.col("at")))))
        return on.select(F.col("row").alias(name), *(F.col(f"_{c}").alias(f"{name}_{c}") for c in keys), F.col("_lo").alias(f"{name}lo"), F.col("own").alias(f"{name}own"), F.col("at").alias(f"{name}at"), F.col("tile").alias(f"{name}tile"))

    x, y = placed(left, levels[1], "a"), placed(right, levels[0], "b")
    # a tile of many rows is a grid of cells, each of about CELL rows of both sides
    own = lambda name: [F.col(f"{name}_{c}").alias(f"_{c}") for c in keys] + [F.col(f"{name}at").alias("at"), F.col(f"{name}tile").alias("tile")]
    on = [*(f"_{c}" for c in keys), "at", "tile"]
    sizes = [side.groupBy(*own(name)).agg(F.ceil(F.count("*") / CELL).cast("int").alias(f"n{name}")) for side, name in ((x, "a"), (y, "b"))]
    grid = sizes[0].join(sizes[1], on)
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.sparkSession.sparkContext.defaultParallelism)

    def dealt(side: DataFrame, name: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))
        one = F.pmod(F.xxhash64(name), F.col(f"n{name}")).cast("int")
        out = side.select("*", *own(name)).join(grid, on).withColumn("ca" if name == "a" else "cb", one).withColumn("cb" if name == "a" else "ca", every)
        cells = [f"{name}{c}" for c in ("at", "tile", "ca", "cb")]
        return out.withColumnRenamed("ca", f"{name}ca").withColumnRenamed("cb", f"{name}cb").drop(*on, "na", "nb").repartition(tasks, *(f"{name}_{c}" for c in keys), *cells)

    x, y = dealt(x, "a", "b"), dealt(y, "b", "a")
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in keys] + [F.col(f"a{c}") == F.col(f"b{c}") for c in ("at", "tile", "ca", "cb")]
    met = x.join(y, same).where(F.col("aat") == F.greatest("aown", "bown"))
    ends = [F.col(f"{side}.{c}") for side, c in (("a", lo), ("b", hi), ("b", lo), ("a", hi))]
    over = (ends[0] <= ends[1]) & (ends[2] <= ends[3]) if touching else (ends[0] < ends[1]) & (ends[2] < ends[3])
    return met.where(over & (F.col("atile") == tile(F.greatest("alo", "blo"), F.col("aat")))).select("a", "b")


def overlap_join(a: DataFrame, b: DataFrame, key: str = "series_id") -> DataFrame:
    """Pairs of closed intervals (lo, hi) of a key that touch: key, a_lo, a_hi, b_lo, b_hi."""
    met = tiled_pairs(a.select(key, "lo", "hi"), b.select(key, "lo", "hi"), "lo", "hi", [key])
    return met.select(F.col(f"a.{key}").alias(key), F.col("a.lo").alias("a_lo"), F.col("a.hi").alias("a_hi"), F.col("b.lo").alias("b_lo"), F.col("b.hi").alias("b_hi"))


def preceded_by(units: DataFrame, groups: DataFrame, horizon: float) -> DataFrame:
    """series_id of each unit with an event, and whether a group overlaps the horizon before the event and starts
    before it."""
    met = units.where("t_event is not null").join(groups.select("series_id", "lo", "hi"), "series_id").where((F.col("lo") < F.col("t_event")) & (F.col("hi") >= F.col("t_event") - horizon)).select("series_id").distinct().withColumn("preceded", F.lit(True))
    return units.where("t_event is not null").select("series_id").join(met, "series_id", "left").select("series_id", F.coalesce("preceded", F.lit(False)).alias("preceded"))


def terminal_partition(groups: DataFrame, units: DataFrame, gap: float) -> DataFrame:
    """Each event's herald: the cluster whose last crossing is before the event, by gap at most, with no later
    retained crossing before the event: series_id, heralded, cluster (null if unheralded)."""
    w = Window.partitionBy("series_id").orderBy("retained_t", "cluster")
    ahead = groups.withColumn("next_t", F.lead("retained_t").over(w))
    events = units.where("t_event is not null").select("series_id", "t_event")
    met = ahead.join(events, "series_id").where((F.col("last_t") <= F.col("t_event")) & (F.col("t_event") - F.col("last_t") <= gap) & (F.col("next_t").isNull() | (F.col("next_t") > F.col("t_event"))))
    one = met.groupBy("series_id").agg(F.max_by("cluster", "last_t").alias("cluster"))
    return events.select("series_id").join(one, "series_id", "left").select("series_id", F.col("cluster").isNotNull().alias("heralded"), "cluster")


def merge_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping or touching intervals (lo, hi) of each key: keys, lo, hi, n."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("lo") <= reach, 0).otherwise(1)
    return df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w)).groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("island")


def interval_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of half-open ranges (name, lo, hi) of a and b that overlap: a_name, b_name, lo, hi of the overlap."""
    met = tiled_pairs(a.select("name", "lo", "hi"), b.select("name", "lo", "hi"), "lo", "hi", [], touching=False)
    return met.select(F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"), F.greatest("a.lo", "b.lo").alias("lo"), F.least("a.hi", "b.hi").alias("hi"))
