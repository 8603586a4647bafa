"""Levels from the shape of a series: consolidations, turning points' density, swing ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_session, frame
from .search import first_hit

#: Retracements of the dominant swing.
RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)


def first_outside(rows: DataFrame, bars: DataFrame, low: str, high: str, block: int = 64) -> DataFrame:
    """``rows`` (security_id, session, k, floor, ceiling) with reached_at: the first later session whose ``low`` column is under floor or whose ``high`` column is
    over ceiling; null while there is none."""
    keys = ["session", "floor", "ceiling"]
    asked = rows.select("security_id", F.struct(*keys).alias("id"), "k", "floor", "ceiling").distinct()
    outside = (F.col("_low") < F.col("floor")) | (F.col("_high") > F.col("ceiling"))
    found = first_hit(asked, bars, outside, low, high, block).select("security_id", *(F.col(f"id.{c}").alias(c) for c in keys), "reached_at")
    return rows.join(found, ["security_id", *keys], "left")


def consolidations(ranged: DataFrame, n: int = 10, widest: float = 2.0) -> DataFrame:
    """security_id, start, end, n_sessions, low, high, broken_at, side: stretches of at least ``n`` sessions in which every ``n`` sessions in a row span at most ``widest``
    ATRs (the ATR of their last). ``broken_at``: the first later session that closes outside; above, the old ceiling becomes support, below, the old
    floor resistance: ``side`` and ``level`` of the flipped boundary, null while unbroken."""
    span = F.max("high").over(frame(n)) - F.min("low").over(frame(n))
    tight = (F.count("*").over(frame(n)) == n) & (span <= widest * F.col("atr"))
    one = ranged.withColumn("tight", F.coalesce(tight, F.lit(False)))
    one = one.withColumn("run", F.sum(F.when(F.col("tight"), 0).otherwise(1)).over(by_session()))
    runs = one.where("tight").groupBy("security_id", "run").agg((F.min("k") - (n - 1)).alias("first"), F.max("k").alias("k"), F.max("session").alias("session"))
    inside = runs.withColumn("k_in", F.explode(F.sequence("first", "k"))).join(ranged.select("security_id", F.col("k").alias("k_in"), F.col("session").alias("s"), "low", "high"), ["security_id", "k_in"])
    found = inside.groupBy("security_id", "session", "k").agg(F.min("s").alias("start"), F.count("*").alias("n_sessions"), F.min("low").alias("floor"), F.max("high").alias("ceiling"))
    broken = first_outside(found, ranged, "close", "close").join(ranged.select("security_id", F.col("session").alias("reached_at"), F.col("close").alias("at_close")), ["security_id", "reached_at"], "left")
    up = F.col("at_close") > F.col("ceiling")
    return broken.select("security_id", "start", F.col("session").alias("end"), "n_sessions", F.col("floor").alias("low"), F.col("ceiling").alias("high"), F.col("reached_at").alias("broken_at"), F.when(up, "support").when(~up, "resistance").alias("side"), F.when(up, F.col("ceiling")).when(~up, F.col("floor")).alias("level"))


def density_levels(swings: DataFrame, volumes: DataFrame, state: DataFrame, sessions: int = 504, step: float = 0.05, gamma: float = 0.5, reach: float = 3.0) -> DataFrame:
    """security_id, as_of, level, density: the local maxima of the density of turning points on a grid of ``step`` ATRs around spot, as shares of the largest.

    ``swings``: security_id, t, level, seen_at, each turning point once; ``volumes``: security_id, k, volume, its weight; ``state``: security_id, as_of, k, spot, atr, atr14. A turning point
    counts in the ``sessions`` after it once it can be seen. Dates and turning points meet by stretches of ``sessions``; a date's turning points are few, so the grid is
    summed within one row. Plateaus count once, at their lower end."""
    points = swings.join(volumes.select("security_id", F.col("k").alias("t"), "volume"), ["security_id", "t"]).select("security_id", "t", "seen_at", "level", "volume", F.floor(F.col("t") / sessions).alias("stretch"))
    own = F.floor(F.col("k") / sessions)
    asked = state.where("atr is not null and atr14 is not null").withColumn("stretch", F.explode(F.array(own, own - 1)))
    known = asked.join(points, ["security_id", "stretch"]).where((F.col("seen_at") <= F.col("k")) & (F.col("t") > F.col("k") - sessions))
    one = known.groupBy("security_id", "as_of", "spot", "atr", "atr14").agg(F.array_sort(F.collect_list(F.struct("level", "volume"))).alias("points"))
    most = round(reach / step)
    at = lambda j: F.col("spot") + j * step * F.col("atr")
    mass = lambda p: F.aggregate("points", F.lit(0.0), lambda a, x: a + x["volume"] * F.exp(-F.pow((p - x["level"]) / (gamma * F.col("atr14")), 2) / 2))
    one = one.withColumn("f", F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda j: mass(at(j)))).withColumn("top", F.array_max("f"))
    f = lambda i: F.round(F.get("f", i) / F.col("top"), 9)
    peaks = F.filter(F.sequence(F.lit(1), F.lit(2 * most - 1)), lambda i: (f(i) > f(i - 1)) & (f(i) >= f(i + 1)))
    return one.where("top > 0").select("security_id", "as_of", F.explode(F.transform(peaks, lambda i: F.struct(at(i - most).alias("level"), f(i).alias("density")))).alias("x")).select("security_id", "as_of", "x.*")


def retracements(swings: DataFrame, state: DataFrame, sessions: int = 120, k_atr: float = 2.0) -> DataFrame:
    """security_id, as_of, source, level: ``RATIOS`` of the dominant swing: the widest move between two neighbouring turning points (k = ``k_atr``, of different sides) of the last
    ``sessions`` sessions that can be seen at as_of; of equal ones the latest. Levels count from the high down."""
    order = Window.partitionBy("security_id").orderBy("t", "side")
    legs = swings.where(F.col("k_atr") == k_atr).withColumns({c: F.lag(s).over(order) for c, s in (("p_side", "side"), ("p_level", "level"), ("p_t", "t"))}).where("p_side != side")
    legs = legs.select("security_id", "t", "p_t", "seen_at", F.greatest("level", "p_level").alias("high"), F.least("level", "p_level").alias("low"), F.floor(F.col("t") / sessions).alias("stretch"))
    own = F.floor(F.col("k") / sessions)
    asked = state.select("security_id", "as_of", "k", F.explode(F.array(own, own - 1)).alias("stretch"))
    known = asked.join(legs, ["security_id", "stretch"]).where((F.col("seen_at") <= F.col("k")) & (F.col("p_t") > F.col("k") - sessions))
    best = known.groupBy("security_id", "as_of").agg(F.max(F.struct(F.round(F.col("high") - F.col("low"), 9).alias("span"), "t", "high", "low")).alias("b"))
    levels = F.array(*(F.struct(F.lit(f"fib_{r}").alias("source"), (F.col("b.high") - r * (F.col("b.high") - F.col("b.low"))).alias("level")) for r in RATIOS))
    return best.select("security_id", "as_of", F.explode(levels).alias("x")).select("security_id", "as_of", "x.*")
