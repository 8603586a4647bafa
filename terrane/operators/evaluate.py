"""Joins of labels, regimes and forecasts; feature matrix; option and currency rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_session, frame
from .labels import bca_interval
from .series import vwap


def reactions_by_regime(labels: DataFrame, regimes: DataFrame) -> DataFrame:
    """regime, side, n, touch_rate, hold_rate: labels joined with the regime of their as_of; the regimes are one row a session."""
    both = labels.join(regimes.select(F.col("session").alias("as_of"), "regime"), "as_of")
    return both.groupBy("regime", "side").agg(F.count("*").alias("n"), F.avg("y_touch").alias("touch_rate"), F.avg("y_hold").alias("hold_rate"))


def base_currency(bars: DataFrame, fx: DataFrame) -> DataFrame:
    """security_id, session, ret: (1 + r) * (1 + f) - 1 with the currency's return of the same session."""
    r = bars.select("security_id", "session", (F.col("close") / F.lag("close").over(by_session()) - 1).alias("r"))
    f = fx.select("session", (F.col("close") / F.lag("close").over(by_session()) - 1).alias("f"))
    return r.join(f, "session").select("security_id", "session", ((1 + F.col("r")) * (1 + F.col("f")) - 1).alias("ret"))


def option_stamps(options: DataFrame, calendar: DataFrame, lag_minutes: int = 30) -> DataFrame:
    """Option rows of known sessions with available_at: the session's close plus a lag."""
    c = calendar.select("session", "close_ts")
    return options.join(c, "session").withColumn("available_at", F.col("close_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lag_minutes))).drop("close_ts")


def option_rules(options: DataFrame) -> DataFrame:
    """``options`` (spot, strike, iv, years, bid, ask) with strike to 0.001, iv_valid, quote_stale and gamma (null where iv is not valid)."""
    strike = F.round("strike", 3)
    valid = (F.col("iv") > 0.01) & (F.col("iv") < 5) & (F.col("years") > 0)
    sd = F.col("iv") * F.sqrt("years")
    d1 = (F.log(F.col("spot") / strike) + F.pow("iv", 2) / 2 * F.col("years")) / sd
    gamma = F.exp(-d1 * d1 / 2) / F.lit(2.5066282746310002) / (F.col("spot") * sd)
    return options.withColumns({"iv_valid": valid, "quote_stale": (F.col("bid") <= 0) | (F.col("ask") < F.col("bid")), "gamma": F.when(valid, gamma), "strike": strike})


def invalidated(weight: Column, event_score: Column, lower: Column, upper: Column, atr: Column, widen: float = 0.5) -> tuple[Column, Column, Column]:
    """(weight, lower, upper) after an event: the weight shrinks with the score; above 0.7 the zone widens by ``widen`` ATRs on both sides."""
    more = F.when(event_score > 0.7, widen * atr).otherwise(F.lit(0.0))
    return weight * (1 - event_score), lower - more, upper + more


def recency_center(members: DataFrame, half_life: float = 252.0, q: float = 0.5) -> DataFrame:
    """security_id, as_of, cluster, center, lower, upper, redundancy: the mean level weighted by exp(-age / half_life), levels without a date counting as new; edges ``q``
    ATRs apart around it; and the share of the cluster's candidates that repeat a source which it already has."""
    age = F.coalesce(F.datediff("as_of", "formed_at"), F.lit(0))
    w = F.exp(-age / half_life)
    one = members.groupBy("security_id", "as_of", "atr", "cluster").agg((F.sum(F.col("level") * w) / F.sum(w)).alias("center"), (1 - F.count_distinct("source") / F.count("*")).alias("redundancy"))
    half = q * F.col("atr") / 2
    return one.select("security_id", "as_of", "cluster", "center", (F.col("center") - half).alias("lower"), (F.col("center") + half).alias("upper"), "redundancy")


def approach(bars: DataFrame) -> DataFrame:
    """security_id, session and how price came there: velocity (ATRs over 5 sessions), down closes in a row, gap into the session, volume against its mean of 20, and the last close's distance from
    its week's volume-weighted price."""
    w = by_session()
    last = F.lag("close").over(w)
    week = vwap(bars, "week").withColumn("from_vwap", (F.col("close") - F.col("vwap")) / F.col("atr"))
    one = week.withColumns({"down": (F.col("close") < last).cast("int"), "gap_into": (F.col("open") - last) / F.col("atr"), "velocity": (F.col("close") - F.lag("close", 5).over(w)) / F.col("atr"), "volume_ratio": F.col("volume") / F.avg("volume").over(frame(20)), "vwap_dist": F.lag("from_vwap").over(w)})
    run = F.sum(1 - F.coalesce("down", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    one = one.withColumn("run", run)
    down = F.sum(F.coalesce("down", F.lit(0))).over(Window.partitionBy("security_id", "run").orderBy("session").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("down_run", down).select("security_id", "session", "velocity", "down_run", "gap_into", "volume_ratio", "vwap_dist")


def ablation(preds: DataFrame) -> DataFrame:
    """year (null: all), n, delta: Brier score of forecast b minus that of a (columns a, b, y, as_of)."""
    d = F.pow(F.col("b") - F.col("y"), 2) - F.pow(F.col("a") - F.col("y"), 2)
    return preds.rollup(F.year("as_of").alias("year")).agg(F.count("*").alias("n"), F.avg(d).alias("delta"))


def ablation_interval(deltas: DataFrame, times: int = 2000) -> DataFrame:
    """year (null: all), n, clusters, mean, low, high of ``delta`` (security_id, as_of, year, delta): the difference of two Brier scores with its interval, by resampling a security's dates."""
    cluster = ["security_id", "as_of"]
    whole = bca_interval(deltas, cluster, "delta", times=times).withColumn("year", F.lit(None).cast("int"))
    return bca_interval(deltas, cluster, "delta", ["year"], times=times).unionByName(whole)


def weekly_scores(preds: DataFrame, bins: int = 10) -> DataFrame:
    """as_of, bin, n, mean_p, mean_y of forecasts against what happened."""
    return preds.groupBy("as_of", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def feature_matrix(zones: DataFrame, by_zone: list[DataFrame], by_security: list[DataFrame], by_session: list[DataFrame]) -> DataFrame:
    """``zones`` with the feature groups of the zone itself, of its security at as_of, and of the market at as_of. Every group is one row for each of its keys, so nothing is multiplied."""
    at = lambda df: df.withColumnRenamed("session", "as_of")
    out = reduce(lambda a, b: a.join(b, ["security_id", "as_of", "zone_id"], "left"), by_zone, zones)
    out = reduce(lambda a, b: a.join(at(b), ["security_id", "as_of"], "left"), by_security, out)
    return reduce(lambda a, b: a.join(at(b), "as_of", "left"), by_session, out)
