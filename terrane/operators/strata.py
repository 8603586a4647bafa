"""Evaluation by strata: deciles of distance, calibration with a logistic slope, lift over placebos, zones of naive levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..params import DEFAULT, Params
from .labels import fdr, resampled

#: Rounds of Newton's method for the logistic recalibration, and the last step that counts as still moving.
ROUNDS, STILL = 12, 1e-8
#: Log odds are cut here, on both sides.
FAR = 30.0


def deciles(rows: DataFrame, value: str, name: str = "decile") -> DataFrame:
    """``rows`` with the decile (0 to 9) of ``value`` among all rows, null where the value is; the nine edges are exact quantiles, a value on an edge is below it."""
    edges = F.broadcast(quantiles(rows, value, [i / 10 for i in range(1, 10)]).withColumnRenamed("edges", "_edges"))  # one row
    return rows.crossJoin(edges).withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter("_edges", lambda e: e < F.col(value))))).drop("_edges")


def recalibration(items: Column) -> Column:
    """The struct (a, b, moved) of P(y) = 1 / (1 + exp(-(a + b x))), fitted by Newton's method from a = 0, b = 1 to ``items``, an array of structs (x, n, s): n rows with x, of which s came
    true. ``moved``: the size of the last step; all NaN where the items do not settle two parameters."""
    zero = F.lit(0.0)
    sums = F.struct(*(zero.alias(c) for c in ("g", "gx", "h", "hx", "hxx")))

    def around(a: Column, b: Column) -> Column:
        def add(t: Column, i: Column) -> Column:
            mu = 1 / (1 + F.exp(-F.greatest(F.lit(-FAR), F.least(F.lit(FAR), a + b * i["x"]))))
            off, w = i["s"] - i["n"] * mu, i["n"] * mu * (1 - mu)
            return F.struct((t["g"] + off).alias("g"), (t["gx"] + off * i["x"]).alias("gx"), (t["h"] + w).alias("h"), (t["hx"] + w * i["x"]).alias("hx"), (t["hxx"] + w * i["x"] * i["x"]).alias("hxx"))

        return F.aggregate(items, sums, add)

    def solved(at: Column, t: Column) -> Column:
        d = t["h"] * t["hxx"] - t["hx"] * t["hx"]
        d = F.when(d > 1e-9 * t["h"] * t["hxx"], d).otherwise(F.lit(float("nan")))
        da, db = (t["hxx"] * t["g"] - t["hx"] * t["gx"]) / d, (t["h"] * t["gx"] - t["hx"] * t["g"]) / d
        return F.struct((at["a"] + da).alias("a"), (at["b"] + db).alias("b"), (F.abs(da) + F.abs(db)).alias("moved"))

    start = F.struct(zero.alias("a"), F.lit(1.0).alias("b"), zero.alias("moved"))
    # The inner array of one element is a name for the sums, which would be computed again for each use.
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda at, _: F.transform(F.array(around(at["a"], at["b"])), lambda t: solved(at, t))[0])


def calibration_by(preds: DataFrame, p: str, y: str, strata: list[str], bins: int = 10) -> DataFrame:
    """The strata, coarse (their grouping id), n, brier, log_loss, ece, intercept and slope; by all strata, without the last, and so on down to all rows.

    ece: over ``bins`` bins of equal mass, whose edges are exact quantiles of all rows. intercept, slope: of the log odds of the outcome on those of the forecast (1: neither too bold nor too
    timid); forecasts are rounded to 3 decimals for it and kept within 0.001 of 0 and 1, so that a stratum is fitted from at most 999 counts. Both are null where outcomes or forecasts
    do not vary, or a line separates them. Rows without a forecast or an outcome take no part; empty table: no rows."""
    rows = preds.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    edges = F.broadcast(quantiles(rows, p, [i / bins for i in range(1, bins)]).withColumnRenamed("edges", "_edges"))  # one row
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    p3 = F.least(F.greatest(F.round(p, 3), F.lit(0.001)), F.lit(0.999))
    rows = rows.crossJoin(edges).withColumns({"_bin": F.size(F.filter("_edges", lambda e: e < F.col(p))), "_p3": p3})
    sums = {"_n": F.count("*"), "_sp": F.sum(p), "_sy": F.sum(F.col(y).cast("double")), "_b": F.sum(F.pow(F.col(p) - F.col(y), 2)), "_ll": F.sum(-(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped)))}
    own = ["_bin", "_p3"]
    sets = [[*own, *strata[:k]] for k in range(len(strata), -1, -1)]
    counted = rows.groupingSets(sets, *own, *strata).agg(*(v.alias(k) for k, v in sums.items()), F.grouping_id().alias("coarse"))
    keys = [*strata, "coarse"]
    by_bin = counted.groupBy(*keys, "_bin").agg(*(F.sum(k).alias(k) for k in sums), F.collect_list(F.struct("_p3", "_n", "_sy")).alias("_items"))
    t = {k: F.sum(k) for k in sums}
    whole = by_bin.groupBy(*keys).agg(t["_n"].alias("n"), (t["_b"] / t["_n"]).alias("brier"), (t["_ll"] / t["_n"]).alias("log_loss"), (F.sum(F.abs(F.col("_sp") - F.col("_sy"))) / t["_n"]).alias("ece"), F.array_sort(F.flatten(F.collect_list("_items"))).alias("_items"))
    item = lambda i: F.struct(F.log(i["_p3"] / (1 - i["_p3"])).alias("x"), i["_n"].cast("double").alias("n"), i["_sy"].alias("s"))
    fit = whole.withColumn("_fit", recalibration(F.transform("_items", item)))
    kept = lambda c: F.when(F.col("_fit")["moved"] <= STILL, F.col("_fit")[c]).alias(c)
    return fit.select(*keys, "n", "brier", "log_loss", "ece", kept("a").alias("intercept"), kept("b").alias("slope"))


def lift(real: DataFrame, placebo: DataFrame, value: str, by: list[str], cluster: list[str], within: str, times: int = 2000, seed: int = 0) -> DataFrame:
    """``by``, n_real, n_placebo, lift, low, high, p, q: by how much the mean of ``value`` of real rows exceeds that of placebos in each cell of ``by`` that has both.

    Real rows and placebos of a cluster are drawn together: its weight is the same in all cells and both kinds. low, high: 95 % of the resampled lifts; p: two-sided, (1 + the smaller number of
    resamples on one side of 0) * 2 / (1 + resamples), at most 1; q: of Benjamini and Hochberg over the cells with the same ``within``. Rows whose value or cell is null take no part; a resample that drew no real row
    or no placebo of a cell does not count for it."""
    rows = real.select(*by, *cluster, value, F.lit("r").alias("_kind")).unionByName(placebo.select(*by, *cluster, value, F.lit("p").alias("_kind")))
    rows = rows.where(F.col(value).isNotNull()).dropna(subset=by)
    sums = rows.groupBy(*by, "_kind", *cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))

    def beside(df: DataFrame, keys: list[str], total: bool) -> DataFrame:
        of = lambda c, k: F.sum(F.when(F.col("_kind") == k, F.col(c)))
        mean = lambda k: of("s", k) / F.nullif(of("n", k).cast("double"), F.lit(0.0))
        counts = [of("n", "r").alias("n_real"), of("n", "p").alias("n_placebo")] if total else []
        return df.groupBy(*keys).agg(*counts, (mean("r") - mean("p")).alias("lift")).where("lift is not null")

    drawn = beside(resampled(sums, [*by, "_kind"], cluster, times, seed), [*by, "b"], False).withColumnRenamed("lift", "l")
    least = F.least(F.sum((F.col("l") <= 0).cast("long")), F.sum((F.col("l") >= 0).cast("long")))
    p = F.least(F.lit(1.0), 2.0 * (1 + least) / (1 + F.count("*")))
    spread = drawn.groupBy(*by).agg(F.percentile("l", F.lit(0.025)).alias("low"), F.percentile("l", F.lit(0.975)).alias("high"), p.alias("p"))
    cells = beside(sums, by, True).join(spread, by).withColumn("id", F.concat_ws("|", *(F.col(c).cast("string") for c in by)))
    return fdr(cells, "p", within).select(*by, "n_real", "n_placebo", "lift", "low", "high", "p", "q")


def naive_levels(state: DataFrame, facts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """security_id, as_of, k, spot, atr, zone_id (the source), lower, upper, center, side, distance_atr: what needs no search. Around each as_of's spot: high and low of the week that ends there, one and two
    ranges above and below, classic pivots of that week and the bands of 20 sessions. Levels that are not positive or whose zone holds the spot are left out.

    ``state``: security_id, as_of, k, spot, atr; ``facts``: security_id, as_of, high, low, close of the week, boll_up, boll_low (null while unknown)."""
    h, l, c, spot, atr = (F.col(x) for x in ("high", "low", "close", "spot", "atr"))  # noqa: E741
    pivot = (h + l + c) / 3
    known = {
        "week_high": h, "week_low": l, "atr_up1": spot + atr, "atr_up2": spot + 2 * atr, "atr_low1": spot - atr, "atr_low2": spot - 2 * atr, "pivot": pivot, "pivot_r1": 2 * pivot - l, "pivot_s1": 2 * pivot - h,
        "pivot_r2": pivot + (h - l), "pivot_s2": pivot - (h - l), "boll_up": F.col("boll_up"), "boll_low": F.col("boll_low"),
    }
    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("zone_id"), v.alias("center")) for n, v in known.items())))
    rows = state.where("atr is not null").join(facts, ["security_id", "as_of"]).select("security_id", "as_of", "k", "spot", "atr", levels.alias("x")).select("*", "x.*").drop("x")
    half = p.half_width * atr
    rows = rows.withColumns({"lower": F.col("center") - half, "upper": F.col("center") + half}).where((F.col("center") > 0) & ~spot.between(F.col("lower"), F.col("upper")))
    return rows.withColumns({"side": F.when(F.col("center") < spot, "support").otherwise("resistance"), "distance_atr": (F.col("center") - spot) / atr})


def base_rates(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n, touch_rate, touched, hold_rate (null where nothing was touched)."""
    touched = F.sum(F.col("y_touch").cast("long"))
    return labelled.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("y_touch").cast("double")).alias("touch_rate"), touched.alias("touched"), F.avg(F.col("y_hold").cast("double")).alias("hold_rate"))
