"""Streams: ticks to bars, sliding VWAP, flow imbalance, zone alerts, restated bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(ticks: DataFrame, size: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Ticks (key, ts, price, volume, seq) to bars of closed windows: in append mode a bar comes out only when the watermark has passed its end."""
    order = F.struct("ts", "seq")
    return ticks.withWatermark("ts", late).groupBy("key", F.window("ts", size)).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")).select("key", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "open", "high", "low", "close", "volume", "n")


def rolling_vwap(ticks: DataFrame, size: str = "30 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    agg = ticks.withWatermark("ts", late).groupBy("key", F.window("ts", size, slide)).agg((F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("vwap"), F.sum("volume").alias("volume"))
    return agg.select("key", F.col("window.start").alias("start"), "vwap", "volume")


def imbalance(flow: DataFrame, size: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Signed flow (key, ts, side = bid or ask, size) to (bid - ask) / (bid + ask) of each window."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0))
    agg = flow.withWatermark("ts", late).groupBy("key", F.window("ts", size)).agg(side("bid").alias("bid"), side("ask").alias("ask"))
    return agg.select("key", F.col("window.start").alias("start"), F.try_divide(F.col("bid") - F.col("ask"), F.col("bid") + F.col("ask")).alias("imbalance"))


def alerts(ticks: DataFrame, zones: DataFrame) -> DataFrame:
    """key, zone_id, ts, price of the first touch of each zone (key, zone_id, lower, upper): a join of the stream with a static table. A zone is reported once in the life of the stream; that it was
    is kept for each zone of the table that has been touched, and never expires. Of the touches of one batch the earliest counts, at the lower price if there are several; what
    arrives in a later batch comes after it."""

    def first(key, batches, state: GroupState):
        best = min(((r.ts, r.price) for pdf in batches for r in pdf.nsmallest(1, ["ts", "price"]).itertuples()), default=None)
        if best and not state.exists:
            state.update((True,))
            yield pd.DataFrame([(*key, *best)], columns=["key", "zone_id", "ts", "price"])

    types = dict(ticks.dtypes) | {"zone_id": dict(zones.dtypes)["zone_id"]}
    hit = ticks.join(zones.withColumnRenamed("key", "z_key"), (F.col("key") == F.col("z_key")) & F.col("price").between(F.col("lower"), F.col("upper")))
    out = ", ".join(f"{c} {types[c]}" for c in ("key", "zone_id", "ts", "price"))
    return hit.select("key", "zone_id", "ts", "price").groupBy("key", "zone_id").applyInPandasWithState(first, out, "reported boolean", "append", GroupStateTimeout.NoTimeout)


def route_restated(stream: DataFrame, known: DataFrame, good: str, aside: str, checkpoint: str, tolerance: float = 1e-6):
    """Start a query that writes new bars to ``good``, and bars that contradict a known one or have no close to ``aside``. Each batch overwrites the folder of its own number, so one that is
    run again after a failure leaves no row twice."""

    def each(batch: DataFrame, number: int) -> None:
        both = batch.join(known.select("key", "start", F.col("close").alias("known_close"), F.lit(True).alias("is_known")), ["key", "start"], "left").persist()
        odd = F.col("close").isNull() | F.coalesce(F.abs(F.col("close") - F.col("known_close")) > tolerance * F.abs("known_close"), F.lit(False))
        for path, rows in ((good, both.where(~odd & F.col("is_known").isNull())), (aside, both.where(odd))):
            rows.drop("known_close", "is_known").write.mode("overwrite").parquet(f"{path}/batch={number}")
        both.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def too_late(query) -> int:
    """How many rows a streaming query has left out so far because they came after the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
