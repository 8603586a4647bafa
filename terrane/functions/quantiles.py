"""Exact quantiles of a column of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of the rows on either side of an approximate quantile that is ranked exactly. Far above the approximation's own error of 1 in 10,000.
MARGIN = 0.002


def quantiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """One row with ``edges``: the quantiles ``at``, interpolated between neighbours. Null and NaN do not count; without rows: an empty array.

    An approximate quantile on either side bounds where the exact one lies. Rows below are only counted; the distinct values between the bounds are
    ranked. So no task sees more than a few thousandths of the distinct values, and equal values are counted before they are shuffled."""
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    around = lambda shift: F.percentile_approx("v", F.array(*(F.lit(min(1.0, max(0.0, x + shift))) for x in at)), 10_000)
    b = v.agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), around(-MARGIN).alias("lo"), around(MARGIN).alias("hi"))
    few = F.col("n") < 10_000  # the bounds are only sure to hold the ranks of larger columns
    b = b.select("n", *(F.when(few, F.array_repeat(F.col(e), len(at))).otherwise(F.col(c)).alias(c) for c, e in (("lo", "least"), ("hi", "most"))))
    met = v.groupBy("v").agg(F.count("*").alias("c")).crossJoin(F.broadcast(b))  # one row: bounded
    below = met.agg(*(F.coalesce(F.sum(F.when(F.col("v") < F.col("lo")[i], F.col("c"))), F.lit(0)).alias(f"b{i}") for i in range(len(at))))
    inside = met.select("v", "c", "n", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(at) - 1)), lambda i: F.col("v").between(F.get("lo", i), F.get("hi", i)))).alias("i"))
    w = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    place = F.get(F.array(*(F.lit(float(x)) for x in at)), F.col("i")) * (F.col("n") - 1)
    ranked = inside.crossJoin(F.broadcast(below)).withColumns({"upto": F.sum("c").over(w) + F.get(F.array(*(F.col(f"b{i}") for i in range(len(at)))), F.col("i")), "place": place})
    one = ranked.groupBy("i", "place").agg(F.min(F.when(F.col("upto") > F.floor("place"), F.col("v"))).alias("x"), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("v"))).alias("y"))
    edge = F.col("x") + (F.coalesce("y", "x") - F.col("x")) * (F.col("place") - F.floor("place"))
    return one.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", edge.alias("e")))), lambda s: s["e"]).alias("edges"))
