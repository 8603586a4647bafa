"""Volume profiles over several trailing windows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (5, 20, 60, 120, 252)
#: Parts of a unit of volume in which shares are counted: whole numbers, so what has been added can be taken away again without a rest.
UNIT = 1_000_000


def grids(state: DataFrame, part: float = 0.1) -> DataFrame:
    """``state`` (security_id, as_of, k, atr) with period, slot and width: dates are grouped by quarter and numbered, and share one grid of bins, ``part`` of the ATR at the quarter's first date
    wide. One grid a quarter is what lets windows slide; the ATR of 20 sessions hardly moves within one. Dates without an ATR before any other have no grid."""
    one = state.where("atr > 0").withColumn("period", F.trunc("as_of", "quarter"))
    w = Window.partitionBy("security_id", "period").orderBy("as_of")
    return one.withColumns({"slot": F.row_number().over(w), "width": F.first("atr").over(w) * part})


def _shares(bars: DataFrame) -> DataFrame:
    """``bars`` (low, high, volume, width and others) by the bins that their range covers: bin and v, the volume in units of 1 / UNIT, spread evenly over the range."""
    low, high, width = F.col("low"), F.col("high"), F.col("width")
    first, last = F.floor(low / width), F.floor(high / width)
    each = bars.withColumn("bin", F.explode(F.sequence(first, last)))
    inside = F.least(high, (F.col("bin") + 1) * width) - F.greatest(low, F.col("bin") * width)
    share = F.when(high > low, inside / (high - low)).otherwise(F.lit(1.0))
    return each.withColumn("v", F.floor(F.col("volume") * share * UNIT + 0.5).cast("long"))


def trailing_profile(bars: DataFrame, state: DataFrame, windows: tuple[int, ...] = WINDOWS, part: float = 0.1) -> DataFrame:
    """security_id, as_of, window, bin, width, volume: the volume of the last n sessions by price, for every n of ``windows`` and every date, in one pass.

    A bar is spread over its bins once for each quarter whose dates it can reach. For each window it then comes in at the first date from its session on and leaves at
    the first date n sessions later: two changes, however many dates lie between. Changes are summed by date, and running sums over a quarter's dates, at most some
    ninety, give the profiles. Bins without volume are left out. ``bars`` and ``state`` have k, the session's number."""
    dates = grids(state, part)
    asked = dates.select("security_id", "period", "width", "slot", "as_of", "k")
    ends = F.array_sort(F.collect_list(F.struct("slot", "k"))).alias("dates")
    quarter = asked.groupBy("security_id", "period", "width").agg(F.min("k").alias("first"), F.max("k").alias("last"), ends)
    # A quarter's bars are those of its dates and as many before as the longest window: met by stretches of that length.
    longest = max(windows)
    stretch = lambda c: F.floor(F.col(c) / longest)
    reach = quarter.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("first") - longest + 1) / longest), stretch("last"))))
    b = bars.select("security_id", "k", "low", "high", "volume", stretch("k").alias("stretch")).where("volume > 0")
    met = b.withColumnRenamed("k", "bar").join(reach, ["security_id", "stretch"]).where((F.col("bar") > F.col("first") - longest) & (F.col("bar") <= F.col("last")))
    from_ = lambda k: F.get(F.filter("dates", lambda d: d["k"] >= k), F.lit(0))["slot"]
    change = lambda n, at, sign: F.struct(F.lit(n).alias("window"), at.alias("slot"), F.lit(sign).alias("sign"))
    changes = [c for n in windows for c in (change(n, from_(F.col("bar")), 1), change(n, from_(F.col("bar") + n), -1))]
    used = F.filter(F.array(*changes), lambda c: c["slot"].isNotNull())
    # What comes and goes at one date is never seen.
    met = met.withColumn("changes", F.filter(used, lambda c: ~F.exists(used, lambda o: (o["window"] == c["window"]) & (o["slot"] == c["slot"]) & (o["sign"] != c["sign"]))))
    shares = _shares(met.where(F.size("changes") > 0)).select("security_id", "period", "bin", "v", F.explode("changes").alias("c"))
    summed = shares.groupBy("security_id", "period", "bin", "c.window", "c.slot").agg(F.sum(F.col("v") * F.col("c.sign")).alias("v"))
    # From each change on, every later date of the quarter shows the sum so far.
    w = Window.partitionBy("security_id", "period", "window", "bin").orderBy("slot")
    runs = summed.withColumns({"so_far": F.sum("v").over(w), "until": F.lead("slot").over(w)})
    last = dates.groupBy("security_id", "period", "width").agg(F.max("slot").alias("last"))
    runs = runs.where("so_far > 0").join(last, ["security_id", "period"])
    runs = runs.withColumn("slot", F.explode(F.sequence("slot", F.coalesce(F.col("until") - 1, "last"))))
    named = dates.select("security_id", "period", "slot", "as_of")
    return runs.join(named, ["security_id", "period", "slot"]).select("security_id", "as_of", "window", "bin", "width", (F.col("so_far") / UNIT).alias("volume"))


def trailing_levels(profile: DataFrame, share: float = 0.7) -> DataFrame:
    """security_id, as_of, window, total, poc, val, vah (prices) of ``trailing_profile``: the fullest bin (of equal ones the lower), and the smallest stretch around it, grown by the fuller neighbour at
    a time (the upper of equals), that holds ``share`` of the volume. Bins between without volume count 0.

    A profile is one array of its bins; the growth is a fold over as many steps as it has bins, and stops growing when it holds enough."""
    one = profile.groupBy("security_id", "as_of", "window", "width").agg(
        F.sum(F.round(F.col("volume") * UNIT).cast("long")).alias("total"), F.min("bin").alias("low"), F.max("bin").alias("high"),
        F.max_by("bin", F.struct("volume", -F.col("bin"))).alias("poc"), F.map_from_entries(F.collect_list(F.struct("bin", F.round(F.col("volume") * UNIT).cast("long")))).alias("at"),
    )
    v = lambda b: F.coalesce(F.try_element_at("at", b), F.lit(0).cast("long"))
    start = F.struct(F.col("poc").alias("lo"), F.col("poc").alias("hi"), v(F.col("poc")).alias("inside"))
    want = F.floor(F.col("total") * share)

    def grow(s, _):
        up = F.when(s["hi"] < F.col("high"), v(s["hi"] + 1)).otherwise(F.lit(-1).cast("long"))
        down = F.when(s["lo"] > F.col("low"), v(s["lo"] - 1)).otherwise(F.lit(-1).cast("long"))
        more = F.when(up >= down, F.struct(s["lo"].alias("lo"), (s["hi"] + 1).alias("hi"), (s["inside"] + up).alias("inside")))
        more = more.otherwise(F.struct((s["lo"] - 1).alias("lo"), s["hi"].alias("hi"), (s["inside"] + down).alias("inside")))
        return F.when((s["inside"] >= want) | ((up < 0) & (down < 0)), s).otherwise(more)

    area = one.withColumn("area", F.aggregate(F.sequence("low", "high"), start, grow))
    price = lambda b, part: (b + part) * F.col("width")
    return area.select("security_id", "as_of", "window", (F.col("total") / UNIT).alias("total"), price(F.col("poc"), 0.5).alias("poc"), price(F.col("area.lo"), 0).alias("val"), price(F.col("area.hi") + 1, 0).alias("vah"))
