"""Memberships that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(membership: DataFrame) -> DataFrame:
    """index_id, security_id, start, end (exclusive, null: open): spells of one security in one index that overlap or touch become one; empty ones go."""
    end = F.coalesce("end", F.lit("9999-12-31").cast("date"))
    rows = membership.select("index_id", "security_id", "start", end.alias("end")).where("start < end")
    w = Window.partitionBy("index_id", "security_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("spell", F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(w))
    return rows.groupBy("index_id", "security_id", "spell").agg(F.min("start").alias("start"), F.nullif(F.max("end"), F.lit("9999-12-31").cast("date")).alias("end")).drop("spell")


def overlaps(membership: DataFrame, least: int = 2) -> DataFrame:
    """security_id, start, end (null: open), indices: the stretches in which a security is in the same ``least`` or more indices, from merged spells.

    A sweep: starts and ends of a security share one order, in which ends come first on a day (touching spells do not overlap); the running sum of their signs is the number of
    indices from there to the next change."""
    far = F.lit("9999-12-31").cast("date")
    spells = merged(membership)
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("sign")), F.struct(F.coalesce("end", far).alias("at"), F.lit(-1).alias("sign")))
    changes = spells.select("security_id", F.explode(ends).alias("c")).groupBy("security_id", "c.at").agg(F.sum("c.sign").alias("sign"))
    # A change of the set without a change of the number (one ends, another starts) is a change of day all the same, so stretches end at every day of the sweep.
    w = Window.partitionBy("security_id").orderBy("at")
    swept = changes.select("security_id", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("sign").over(w).alias("indices"))
    return swept.where(F.col("indices") >= least).select("security_id", "start", F.nullif("end", far).alias("end"), F.col("indices").cast("long").alias("indices"))


def shared_time(membership: DataFrame, until) -> DataFrame:
    """security_id, index_a, index_b (a < b), days in which the security is in both, up to ``until``: stretches with two indices or more meet the spells that cover them."""
    far = F.lit("9999-12-31").cast("date")
    spells = merged(membership)
    met = overlaps(membership).withColumnRenamed("start", "from").withColumnRenamed("end", "to").join(spells, "security_id")
    met = met.where((F.col("start") <= F.col("from")) & (F.coalesce("end", far) >= F.coalesce("to", far)))
    sets = met.groupBy("security_id", "from", "to").agg(F.array_sort(F.collect_list("index_id")).alias("all"))
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(F.filter("all", lambda b: b > a), lambda b: F.struct(a.alias("index_a"), b.alias("index_b")))))
    days = F.greatest(F.datediff(F.least(F.coalesce("to", far), until), "from"), F.lit(0))
    return sets.select("security_id", F.explode(pairs).alias("p"), days.alias("days")).groupBy("security_id", "p.index_a", "p.index_b").agg(F.sum("days").alias("days"))
