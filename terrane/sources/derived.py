"""Daily bars from a tick-like table: each shipment is a tick of its supplier's region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TICK_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")


def ticks(spark: SparkSession, sf_dir: str, key: str = "n_regionkey") -> DataFrame:
    """security_id, session, step (cents), volume and the columns that order the ticks of a session."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    step = (F.round(F.col("l_discount") * 100) - 5).cast("long") * 4
    return joined.select(F.col(key).cast("long").alias("security_id"), F.to_date("l_shipdate").alias("session"), step.alias("step"), F.col("l_quantity").alias("volume"), *TICK_ORDER)


def bars(spark: SparkSession, sf_dir: str, key: str = "n_regionkey", base_cents: int = 20_000) -> DataFrame:
    """security_id, session, open, high, low, close, volume, n_ticks, available_at, k (session number within the security).

    A security's price is a running sum over all its ticks. Sessions are summed first, so the long window runs over one row
    for each session; only the ticks of one session are ordered."""
    day = Window.partitionBy("security_id", "session").orderBy(*TICK_ORDER)
    cum = F.sum("step").over(day.rowsBetween(Window.unboundedPreceding, 0))
    t = ticks(spark, sf_dir, key).withColumn("cum", cum).withColumn("n", F.row_number().over(day))
    days = t.groupBy("security_id", "session").agg(
        F.max(F.when(F.col("n") == 1, F.col("step"))).alias("first"), F.max("cum").alias("top"), F.min("cum").alias("bottom"),
        F.sum("step").alias("move"), F.sum("volume").alias("volume"), F.count("*").alias("n_ticks"),
    )
    long = Window.partitionBy("security_id").orderBy("session")
    base = F.lit(base_cents) + F.coalesce(F.sum("move").over(long.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    price = lambda c: ((F.col("base") + F.col(c)).cast("double") / 100).alias
    out = days.withColumn("base", base).withColumn("k", F.row_number().over(long))
    return out.select("security_id", "session", price("first")("open"), price("top")("high"), price("bottom")("low"), price("move")("close"), "volume", "n_ticks", (F.col("session").cast("timestamp") + F.expr("interval 20 hours")).alias("available_at"), F.col("k").cast("long").alias("k"))
