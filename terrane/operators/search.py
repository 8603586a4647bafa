"""The first later session at which something holds, without comparing a history with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit(asked: DataFrame, bars: DataFrame, hit: Column, low: str = "low", high: str = "high", block: int = 64) -> DataFrame:
    """security_id, id, reached_at: for each row of ``asked`` (security_id, id, k and what ``hit`` needs) the first session after the k-th for which ``hit`` holds; rows without one are left out.

    ``hit`` is a condition on _low and _high that holds for a stretch of sessions, by its extremes, if it holds for one of them. A row looks at stretches of block**2 sessions first, of which even a long
    history has few, then at the blocks of its own and of the first such stretch that can hold it, then at the sessions of its own and of the first such block: never at more than a
    few times ``block`` rows. ``bars``: security_id, k, session and the two columns."""
    own, wide = F.floor(F.col("k") / block), F.floor(F.col("k") / block**2)
    one = bars.select("security_id", "session", F.col("k").alias("_k"), F.col(low).alias("_low"), F.col(high).alias("_high"), own.alias("_block"), wide.alias("_wide"))
    extremes = (F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    blocks = one.groupBy("security_id", "_wide", "_block").agg(*extremes)
    stretches = blocks.groupBy("security_id", "_wide").agg(*extremes)
    rows = asked.withColumns({"_own": own, "_far": wide})
    found = rows.join(stretches, "security_id").where((F.col("_wide") > F.col("_far")) & hit).groupBy("security_id", "id").agg(F.min("_wide").alias("_next"))
    rows = rows.join(found, ["security_id", "id"], "left")
    looked = rows.withColumn("_wide", F.explode(F.array_distinct(F.array("_far", F.coalesce("_next", "_far")))))
    found = looked.join(blocks, ["security_id", "_wide"]).where((F.col("_block") > F.col("_own")) & hit).groupBy("security_id", "id").agg(F.min("_block").alias("_at"))
    rows = rows.join(found, ["security_id", "id"], "left")
    looked = rows.withColumn("_block", F.explode(F.array_distinct(F.array("_own", F.coalesce("_at", "_own")))))
    met = looked.join(one.drop("_wide"), ["security_id", "_block"]).where((F.col("_k") > F.col("k")) & hit)
    return met.groupBy("security_id", "id").agg(F.min("session").alias("reached_at"))
