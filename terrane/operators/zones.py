"""Candidates to zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

KEY = ("security_id", "as_of")


def clustered(candidates: DataFrame, eps: float = DEFAULT.cluster_eps) -> DataFrame:
    """``candidates`` with cluster (1, 2 … upward): a new one begins where a level lies more than eps ATRs above the first of the open one.
    A fold over the sorted levels of one security and date, which are few."""
    item = F.struct("level", "source", "lower", "upper", "family", *(c for c in ("formed_at", "available_at", "k_atr", "confirm_sessions", "atr_at_formation", "step", "rank") if c in candidates.columns))
    groups = candidates.groupBy(*KEY, "spot", "atr").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(acc, x):
        new = acc["first"].isNull() | ((x["level"] - acc["first"]) / F.col("atr") > eps)
        return F.struct(F.when(new, x["level"]).otherwise(acc["first"]).alias("first"), (acc["n"] + new.cast("long")).alias("n"), F.concat(acc["ids"], F.array(acc["n"] + new.cast("long"))).alias("ids"))

    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("ids"))
    ids = F.aggregate("items", start, step, lambda acc: acc["ids"])
    both = groups.withColumn("both", F.explode(F.arrays_zip("items", ids.alias("ids"))))
    return both.select(*KEY, "spot", "atr", F.col("both.ids").alias("cluster"), "both.items.*")


def geometry(members: DataFrame) -> DataFrame:
    """A zone for each cluster that does not hold the spot."""
    total = F.aggregate(F.array_sort(F.collect_list("level")), F.lit(0.0), lambda a, x: a + x)
    z = members.groupBy(*KEY, "spot", "atr", "cluster").agg(
        (total / F.count("*")).alias("center"), F.min("lower").alias("lower"), F.max("upper").alias("upper"), F.count("*").alias("n_sources"),
        F.count_distinct("family").alias("n_families"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"),
    ).where(~F.col("spot").between(F.col("lower"), F.col("upper")))
    return z.withColumns({"side": F.when(F.col("center") < F.col("spot"), "support").otherwise("resistance"), "width_atr": (F.col("upper") - F.col("lower")) / F.col("atr"), "distance_atr": (F.col("center") - F.col("spot")) / F.col("atr")})


def nearest(zones: DataFrame, most: int = DEFAULT.zones_per_side) -> DataFrame:
    """The nearest zones of each side with their names."""
    w = Window.partitionBy(*KEY, "side").orderBy(F.abs("distance_atr"), "center")
    tag = F.when(F.col("side") == "support", "S").otherwise("R")
    return zones.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).withColumn("zone_id", F.format_string("%s-%s-P0-%02d", F.col("security_id").cast("string"), tag, F.col("n"))).drop("n")


def zones(candidates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return nearest(geometry(clustered(candidates, p.cluster_eps)), p.zones_per_side)


def assigned(members: DataFrame, named: DataFrame) -> DataFrame:
    """Clustered candidates with their zone's name, "" where the cluster became none."""
    return members.join(named.select(*KEY, "cluster", "zone_id"), [*KEY, "cluster"], "left").withColumn("zone_id", F.coalesce("zone_id", F.lit("")))


def invalid_candidates(candidates: DataFrame) -> DataFrame:
    """Rows that break the invariant lower <= level <= upper, or have no time of availability."""
    bad = ~((F.col("lower") <= F.col("level")) & (F.col("level") <= F.col("upper"))) | F.col("available_at").isNull()
    return candidates.where(F.coalesce(bad, F.lit(True)))


def density_clusters(candidates: DataFrame, eps: float = DEFAULT.density_eps, widest: float = 1.0) -> DataFrame:
    """``candidates`` with cluster by single linkage: gaps over eps ATRs part them; a cluster wider than ``widest`` ATRs is split once at
    its widest gap (the lowest of equals)."""
    order = Window.partitionBy(*KEY).orderBy("level", "source")
    gap = F.round((F.col("level") - F.lag("level").over(order)) / F.col("atr"), 9)
    one = candidates.withColumn("gap", gap).withColumn("island", F.sum(F.when(F.col("gap") > eps, 1).otherwise(0)).over(order))
    inside = Window.partitionBy(*KEY, "island")
    one = one.withColumn("least", F.min("level").over(inside)).withColumn("span", (F.max("level").over(inside) - F.col("least")) / F.col("atr"))
    widest_gap = F.max(F.when(F.col("level") > F.col("least"), F.struct("gap", (-F.col("level")).alias("below")))).over(inside)
    one = one.withColumn("cut", F.when(F.col("span") > widest, -widest_gap["below"]))
    return one.withColumn("cluster", F.col("island") * 2 + F.when(F.col("level") >= F.col("cut"), 1).otherwise(0)).drop("gap", "least", "span", "cut", "island")


def deduped(candidates: DataFrame, within: float = 0.05) -> DataFrame:
    """Levels of one source that lie within ``within`` ATRs of the one below collapse to their mean."""
    order = Window.partitionBy(*KEY, "source").orderBy("level")
    far = (F.col("level") - F.lag("level").over(order)) / F.col("atr") > within
    one = candidates.withColumn("island", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(order))
    return one.groupBy(*KEY, "source", "spot", "atr", "island").agg(F.avg("level").alias("level"), F.count("*").alias("n")).drop("island")
