"""What became of zones: reactions, identity that lasts, histories by identity, recall of turning points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..sources.staging import stage
from .labels import KEY, label_window
from .levels import band
from .trades import mirrored


def reactions(zones: DataFrame, bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The zone's key, side, t_touch, reaction, t_reaction of zones that are touched within the horizon: the furthest that price went away from the entry, in ATRs, from the session of the touch
    on; and the sessions from the touch to the first one that reacts by ``p.reaction`` ATRs, null if none does. Entry: the open of the touching bar if it lies in the zone, else the near edge."""
    rows = mirrored(label_window(zones, bars, p.horizon))
    w = Window.partitionBy(*KEY)
    hit = (F.col("m_low") <= F.col("near")) & (F.col("m_high") >= F.col("far"))
    rows = rows.withColumn("t_touch", F.min(F.when(hit, F.col("step"))).over(w)).where("t_touch is not null and step >= t_touch")
    entry = F.when(F.col("m_open").between(F.col("far"), F.col("near")), F.col("m_open")).otherwise(F.col("near"))
    rows = rows.withColumn("entry", F.max(F.when(F.col("step") == F.col("t_touch"), entry)).over(w))
    gain = (F.col("m_high") - F.col("entry")) / F.col("atr")
    reacts = F.col("m_high") >= F.col("entry") + p.reaction * F.col("atr")
    return rows.groupBy(*KEY, "side").agg(F.min("t_touch").cast("long").alias("t_touch"), F.max(gain).alias("reaction"), F.min(F.when(reacts, F.col("step") - F.col("t_touch"))).cast("long").alias("t_reaction"))


def chains(zones: DataFrame, links: DataFrame) -> DataFrame:
    """security_id, as_of, zone_id, root_as_of, root_zone: the first forerunner of each zone, by following ``links`` (``labels.match_zones``) back in time; a zone without one is its own.

    Pointer doubling: in each round every pointer moves on to where its target points, so a history of n dates takes log2(n) rounds; rounds are staged."""
    hop = stage(links.select("security_id", "as_of", "zone_id", F.col("prior_as_of").alias("to_as_of"), F.col("prior_zone").alias("to_zone")))
    while True:
        further = hop.select("security_id", F.col("as_of").alias("to_as_of"), F.col("zone_id").alias("to_zone"), F.col("to_as_of").alias("far_as_of"), F.col("to_zone").alias("far_zone"))
        moved = hop.join(further, ["security_id", "to_as_of", "to_zone"], "left")
        hop = stage(moved.select("security_id", "as_of", "zone_id", F.coalesce("far_as_of", "to_as_of").alias("to_as_of"), F.coalesce("far_zone", "to_zone").alias("to_zone"), F.col("far_as_of").isNotNull().alias("moved")))
        if not hop.where("moved").limit(1).count():
            break
        hop = hop.drop("moved")
    found = zones.select(*KEY).join(hop.drop("moved"), list(KEY), "left")
    return found.select(*KEY, F.coalesce("to_as_of", "as_of").alias("root_as_of"), F.coalesce("to_zone", "zone_id").alias("root_zone"))


def chain_history(found: DataFrame, labels: DataFrame, reacted: DataFrame) -> DataFrame:
    """The zone's key and what its forerunners showed by as_of: weeks, touches, holds, breaks, hold_ratio, flips, age (days since the root), decay63, decay252, last_touch_age, touch_gap (mean days between
    touches), reaction_mean, reaction_sd, state (UNTESTED, TESTED, CONFIRMED, BROKEN).

    ``found``: ``chains``; ``labels``: key, y_touch, y_hold, y_break, available_at; ``reacted``: ``reactions``. An outcome counts from the day on which its label was known: outcomes and questions
    of a chain share one order in time, along which sums run. A touch is dated by its zone's as_of."""
    facts = labels.join(reacted.select(*KEY, "reaction"), list(KEY), "left").join(found, list(KEY))
    chain = ["security_id", "root_as_of", "root_zone"]
    told = facts.select(*chain, F.to_date("available_at").alias("at"), F.lit(0).alias("ask"), F.lit("").alias("zone_id"), F.col("as_of").alias("seen"), "y_touch", "y_hold", "y_break", "reaction")
    asked = found.select(*chain, F.col("as_of").alias("at"), F.lit(1).alias("ask"), "zone_id")
    w = Window.partitionBy(*chain).orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    touch_day = F.when(F.col("y_touch") == 1, F.col("seen"))
    sums = {
        "weeks": F.count("seen"), "touches": F.sum(F.coalesce("y_touch", F.lit(0))), "holds": F.sum(F.coalesce("y_hold", F.lit(0))), "breaks": F.sum(F.coalesce("y_break", F.lit(0))),
        "first_touch": F.min(touch_day), "last_touch": F.max(touch_day), "reaction_mean": F.avg("reaction"), "reaction_sd": F.stddev_pop("reaction"),
    }
    rows = told.unionByName(asked, allowMissingColumns=True).select("*", *(x.over(w).alias(k) for k, x in sums.items())).where("ask = 1")
    age = F.datediff("at", "root_as_of").cast("long")
    gap = F.datediff("last_touch", "first_touch") / F.nullif(F.col("touches") - 1, F.lit(0))
    state = F.when(F.col("breaks") > 0, "BROKEN").when(F.col("holds") > 0, "CONFIRMED").when(F.col("touches") > 0, "TESTED").otherwise("UNTESTED")
    return rows.select(
        "security_id", F.col("at").alias("as_of"), "zone_id", "weeks", "touches", "holds", "breaks", (F.col("holds") / F.nullif("touches", F.lit(0))).alias("hold_ratio"), F.col("breaks").alias("flips"),
        age.alias("age"), F.exp(-age / 63).alias("decay63"), F.exp(-age / 252).alias("decay252"), F.datediff("at", "last_touch").cast("long").alias("last_touch_age"), gap.alias("touch_gap"),
        "reaction_mean", "reaction_sd", state.alias("state"),
    )


def captured(points: DataFrame, zones: DataFrame, dates: DataFrame, tolerance: float = 0.25, horizon: int = DEFAULT.horizon) -> DataFrame:
    """security_id, t, side, as_of, hit: every turning point once that lies in the horizon of a date, with the latest such date, and whether a zone of any of its dates was there: on the
    point's side (a high is resistance), its edges within ``tolerance`` ATRs of the point's level.

    ``points``: security_id, t (session number), side high or low, level, once each; ``zones``: with k, lower, upper, atr; ``dates``: security_id, as_of, k. Points meet zones by session and
    band of prices: a zone is listed under the bands that it reaches, a point under its own."""
    early = points.withColumn("k", F.explode(F.sequence(F.col("t") - horizon, F.col("t") - 1)))
    base = early.join(dates.select("security_id", "k", "as_of"), ["security_id", "k"]).groupBy("security_id", "t", "side").agg(F.max("as_of").alias("as_of"))
    room = tolerance * F.col("atr")
    listed = zones.select("security_id", "k", F.when(F.col("side") == "support", "low").otherwise("high").alias("side"), (F.col("lower") - room).alias("from"), (F.col("upper") + room).alias("to"))
    listed = listed.withColumn("band", F.explode(F.sequence(band(F.col("from")), band(F.col("to")))))
    met = early.withColumn("band", band(F.col("level"))).join(listed, ["security_id", "k", "side", "band"]).where(F.col("level").between(F.col("from"), F.col("to")))
    hits = met.select("security_id", "t", "side").distinct().withColumn("hit", F.lit(1))
    return base.join(hits, ["security_id", "t", "side"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def recall(found: DataFrame, regimes: DataFrame) -> DataFrame:
    """security_id, regime, points, hits, recall, and coarser (null): by security, by regime, of all. ``found``: ``captured``; points of dates without a regime count as regime none."""
    rows = found.join(regimes, "as_of", "left").withColumn("regime", F.coalesce("regime", F.lit("none")))
    one = rows.cube("security_id", "regime").agg(F.count("*").alias("points"), F.sum("hit").alias("hits"), F.grouping_id().alias("coarse"))
    return one.withColumn("recall", F.col("hits") / F.col("points"))
