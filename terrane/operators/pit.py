"""Point in time: what was knowable when, calendars, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR_COLUMNS = {"security_id": "long", "session": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "available_at": "timestamp"}


def checked_bars(df: DataFrame) -> DataFrame:
    """The bar columns, cast, NaN read as null; a missing column is an error."""
    if missing := [c for c in BAR_COLUMNS if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    clean = lambda c, t: F.when(~F.isnan(F.col(c).cast(t)), F.col(c).cast(t)) if t == "double" else F.col(c).cast(t)
    return df.select(*(clean(c, t).alias(c) for c, t in BAR_COLUMNS.items()))


def cut_time(as_of: Column, now: Column) -> Column:
    """The end of the as-of day or now, whichever is earlier."""
    return F.least(as_of.cast("date").cast("timestamp") + F.expr("interval 86399999999 microseconds"), now)


def visible(bars: DataFrame, as_of: Column, now: Column) -> DataFrame:
    return bars.where((F.col("session") <= as_of.cast("date")) & (F.col("available_at") <= cut_time(as_of, now)))


def rejected(wanted: DataFrame, bars: DataFrame, key: str = "security_id") -> DataFrame:
    """Keys that have no bar."""
    return wanted.select(key).distinct().join(bars.select(key).distinct(), key, "left_anti").withColumn("reason", F.lit("no bars"))


def week_ends(bars: DataFrame) -> DataFrame:
    """security_id, as_of: the last session of each ISO week."""
    return bars.groupBy("security_id", F.trunc("session", "week").alias("week")).agg(F.max("session").alias("as_of")).drop("week")


def asof_latest(facts: DataFrame, asof: DataFrame, keys: list[str], time: str, at: str, columns: list[str]) -> DataFrame:
    """``asof`` with the columns of the latest fact at or before its time. Facts and questions are put in one order and the last fact is
    carried along, so no history is multiplied by the questions."""
    kept = F.struct(*columns)
    one = facts.select(*keys, F.col(time).alias("_at"), F.lit(0).alias("_ask"), kept.alias("_fact"), F.lit(None).cast(asof.schema[at].dataType).alias(at))
    two = asof.select(*keys, F.col(at).cast(facts.schema[time].dataType).alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast(one.schema["_fact"].dataType).alias("_fact"), at)
    w = Window.partitionBy(*keys).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    out = one.unionByName(two).withColumn("_fact", F.last("_fact", ignorenulls=True).over(w)).where("_ask = 1")
    return out.select(*keys, at, *(F.col(f"_fact.{c}").alias(c) for c in columns))


def stamp_available(bars: DataFrame, calendar: DataFrame, fallback: str = "20:00", lag_minutes: int = 0) -> DataFrame:
    """``bars`` with known (a session of the calendar?) and available_at: the calendar's close or the fallback, plus the lag."""
    hours, minutes = (int(x) for x in fallback.split(":"))
    closes = calendar.select("session", F.col("close_ts").alias("_close")).dropDuplicates(["session"])
    usual = F.col("session").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes))
    out = bars.drop("available_at").join(closes, "session", "left")
    at = F.coalesce("_close", usual) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lag_minutes))
    return out.withColumn("known", F.col("_close").isNotNull()).withColumn("available_at", at).drop("_close")


def latest_known(facts: DataFrame, asof: DataFrame, keys: list[str], time: str, known: str, at: str, columns: list[str]) -> DataFrame:
    """``asof`` with the time and columns of the latest fact that was known by then: of the facts with ``known`` at or before ``at``, the one with the largest ``time``
    (of equals, the largest columns). Facts in the order in which they became known and questions share one order, along which the maximum runs."""
    kept = F.struct(time, *columns)
    one = facts.select(*keys, F.col(known).cast(asof.schema[at].dataType).alias(at), F.lit(0).alias("_ask"), kept.alias("_fact"))
    two = asof.select(*keys, at, F.lit(1).alias("_ask"), F.lit(None).cast(one.schema["_fact"].dataType).alias("_fact"))
    w = Window.partitionBy(*keys).orderBy(at, "_ask").rowsBetween(Window.unboundedPreceding, 0)
    out = one.unionByName(two).withColumn("_fact", F.max("_fact").over(w)).where("_ask = 1")
    return out.select(*keys, at, *(F.col(f"_fact.{c}").alias(c) for c in (time, *columns)))


def next_sessions(calendar: DataFrame, asof: DataFrame, n: int) -> DataFrame:
    """as_of, step, session: the n sessions strictly after each as_of. Sessions are numbered year by year, after a running sum over the years."""
    days = calendar.select("session").distinct().withColumn("year", F.year("session"))
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    asked = asof.select(F.col("as_of").alias("session")).distinct().withColumn("year", F.year("session"))
    years = days.groupBy("year").agg(F.count("*").alias("c")).unionByName(asked.select("year", F.lit(0).cast("long").alias("c"))).groupBy("year").agg(F.sum("c").alias("c"))
    years = years.select("year", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    both = days.withColumn("ask", F.lit(0)).unionByName(asked.withColumn("ask", F.lit(1))).join(years, "year")
    inside = Window.partitionBy("year").orderBy("session", "ask").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("ordinal", F.col("base") + F.sum(1 - F.col("ask")).over(inside))
    steps = both.where("ask = 1").select(F.col("session").alias("as_of"), "ordinal", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).withColumn("ordinal", F.col("ordinal") + F.col("step"))
    return steps.join(both.where("ask = 0").select("ordinal", "session"), "ordinal").select("as_of", F.col("step").cast("long").alias("step"), "session")
