"""Feature groups of a security and session, scaled by its ATR where a price would otherwise leak its scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series
from .indicators import by_session, frame

KEY = ("security_id", "session")


def _in_atrs(x: Column) -> Column:
    return F.try_divide(x, F.nullif("atr", F.lit(0.0)))


def price(ranged: DataFrame) -> DataFrame:
    """Range, body and wicks, the close's place in the range, and its distance from the means of 5, 20 and 60 closes."""
    out = {
        "range_atr": _in_atrs(F.col("high") - F.col("low")), "body_atr": _in_atrs(F.col("close") - F.col("open")), "upper_wick": _in_atrs(F.col("high") - F.greatest("open", "close")), "lower_wick": _in_atrs(F.least("open", "close") - F.col("low")),
        "close_place": F.try_divide(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), **{f"from_mean{n}": _in_atrs(F.col("close") - F.avg("close").over(frame(n))) for n in (5, 20, 60)},
    }
    return ranged.select(*KEY, *(v.alias(k) for k, v in out.items()))


def volume(bars: DataFrame) -> DataFrame:
    """Volume against its means of 5, 20 and 60 sessions, the short mean against the long one, traded value, sessions of 20 without volume."""
    mean = lambda n: F.avg("volume").over(frame(n))
    out = {f"volume_{n}": F.try_divide(F.col("volume"), F.nullif(mean(n), F.lit(0.0))) for n in (5, 20, 60)}
    out |= {"volume_gain": F.try_divide(mean(5), F.nullif(mean(20), F.lit(0.0))), "adv20": F.avg(F.col("close") * F.col("volume")).over(frame(20)), "no_volume20": F.sum((F.col("volume") <= 0).cast("long")).over(frame(20))}
    return bars.select(*KEY, *(v.alias(k) for k, v in out.items()))


def structure(ranged: DataFrame) -> DataFrame:
    """Distance of the close from the extremes of the last session, week, month, 252 sessions and the year so far; sessions since those of the 252."""
    names = [f"{a}_{b}" for b in ("day", "week", "month") for a in ("prior_high", "prior_low")] + ["high_252", "low_252", "high_ytd", "low_ytd"]
    out = series.prior_extremes(ranged, ("week", "month"))
    ago = lambda value: F.col("k") - F.max(F.struct(value.alias("v"), "k")).over(frame(252)).getField("k")
    return out.select(*KEY, *(_in_atrs(F.col("close") - F.col(c)).alias(f"to_{c}") for c in names), ago(F.col("high")).alias("since_high_252"), ago(-F.col("low")).alias("since_low_252"))


def vwaps(ranged: DataFrame, periods: tuple[str, ...] = ("week", "month", "quarter", "year")) -> DataFrame:
    """Distance of the close from the volume-weighted prices of the periods so far, and how many of them lie within a quarter, half and whole ATR."""
    out = ranged
    for p in periods:
        out = series.vwap(out, p).withColumn(f"to_vwap_{p}", _in_atrs(F.col("close") - F.col("vwap"))).drop("vwap")
    within = lambda d: sum((F.coalesce((F.round(F.abs(f"to_vwap_{p}"), 9) <= d).cast("long"), F.lit(0)) for p in periods), F.lit(0))
    return out.select(*KEY, *(f"to_vwap_{p}" for p in periods), *(within(d).alias(n) for n, d in (("vwaps_025", 0.25), ("vwaps_05", 0.5), ("vwaps_1", 1.0))))


def anchored_vwap(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """security_id, session, vwap: the volume-weighted typical price since the last anchor (security_id, session) at or before the session; null before the first."""
    w = by_session().rowsBetween(Window.unboundedPreceding, 0)
    marked = bars.join(anchors.select(*KEY).distinct().withColumn("_anchor", F.lit(1)), list(KEY), "left").withColumn("_since", F.count("_anchor").over(w))
    run = Window.partitionBy("security_id", "_since").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    value = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")
    return marked.select(*KEY, F.when(F.col("_since") > 0, F.try_divide(F.sum(value).over(run), F.nullif(F.sum("volume").over(run), F.lit(0.0)))).alias("vwap"))


def round_numbers(zones: DataFrame, rungs: DataFrame) -> DataFrame:
    """security_id, as_of, zone_id, rungs_in, nearest_rung (ATRs from the center), coarsest (smallest rank within the zone): the round numbers (security_id, as_of, level, rank) of a zone's date."""
    met = zones.select("security_id", "as_of", "zone_id", "center", "lower", "upper", "atr").join(rungs.select("security_id", "as_of", "level", "rank"), ["security_id", "as_of"], "left")
    inside = F.col("level").between(F.col("lower"), F.col("upper"))
    return met.groupBy("security_id", "as_of", "zone_id").agg(F.count_if(inside).alias("rungs_in"), F.min(_in_atrs(F.abs(F.col("level") - F.col("center")))).alias("nearest_rung"), F.min(F.when(inside, F.col("rank"))).cast("long").alias("coarsest"))
