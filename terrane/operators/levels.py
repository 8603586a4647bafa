"""Candidate levels: swings and round numbers, for every security and as-of date at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladder import ladder_steps, rungs_within, short_number
from ..params import DEFAULT, Params
from .indicators import by_session

COLUMNS = ("security_id", "as_of", "spot", "atr", "level", "lower", "upper", "source", "family", "timeframe", "formed_at", "available_at", "k_atr", "confirm_sessions", "atr_at_formation", "step", "rank")


def swings(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """security_id, t, side, level, formed_at, atr_at_formation, k_atr, confirm_sessions, available_at, seen_at: confirmed swings, once
    for each k. ``bars`` has k and atr. ``seen_at`` is the session number from which a reader can know the swing."""
    w, most = p.swing_window, p.confirm_most
    around, after = by_session().rowsBetween(-w, w), by_session().rowsBetween(1, most)
    found = bars.withColumns({
        "full": F.count("*").over(around) == 2 * w + 1, "is_high": F.col("high") >= F.max("high").over(around), "is_low": F.col("low") <= F.min("low").over(around),
        "ahead": F.collect_list(F.struct("low", "high", "available_at")).over(after),
    }).where(F.col("full") & F.col("atr").isNotNull() & (F.col("is_high") | F.col("is_low")))
    sides = F.filter(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("level"), F.col(f"is_{s}").alias("ok")) for s, c in (("high", "high"), ("low", "low")))), lambda x: x["ok"])
    one = found.select("*", F.explode(sides).alias("s")).select("*", "s.side", "s.level")
    one = one.withColumn("k_atr", F.explode(F.array(*(F.lit(float(k)) for k in p.swing_k))))
    far = F.transform("ahead", lambda x: F.when(F.col("side") == "high", F.col("level") - x["low"]).otherwise(x["high"] - F.col("level")) >= F.col("k_atr") * F.col("atr"))
    one = one.withColumn("m", F.array_position(far, True)).where("m > 0")
    return one.select("security_id", F.col("k").alias("t"), "side", "level", F.col("session").alias("formed_at"), F.col("atr").alias("atr_at_formation"), "k_atr", F.col("m").cast("long").alias("confirm_sessions"), F.col("ahead")[F.col("m") - 1]["available_at"].alias("available_at"), (F.col("k") + F.greatest("m", F.lit(w))).cast("long").alias("seen_at"))


#: Width of a band of prices, as a step of asinh(price): a twentieth of a price.
BAND = 0.05


def band(price: Column) -> Column:
    return F.floor(F.asinh(price) / BAND)


def swing_candidates(found: DataFrame, state: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The swings known at each as_of, within reach of spot. ``state``: security_id, as_of, k, spot, atr. Joined by bands of prices, so an as_of meets the swings of the
    bands in its reach, not all of the security's."""
    s = state.select("security_id", "as_of", F.col("k").alias("now_k"), "spot", "atr").where("atr is not null")
    reach = p.swing_keep * F.col("atr")
    s = s.withColumn("band", F.explode(F.sequence(band(F.col("spot") - reach), band(F.col("spot") + reach))))
    pairs = s.join(found.withColumn("band", band(F.col("level"))), ["security_id", "band"]).where((F.col("seen_at") <= F.col("now_k")) & (F.abs(F.col("level") - F.col("spot")) <= p.swing_keep * F.col("atr")))
    half = p.half_width * F.col("atr")
    out = pairs.withColumns({"lower": F.col("level") - half, "upper": F.col("level") + half, "source": F.concat(F.lit("swing_"), "side", F.lit("_k"), short_number(F.col("k_atr"))), "family": F.lit("A"), "timeframe": F.lit("1D"), "step": F.lit(None).cast("double"), "rank": F.lit(None).cast("long")})
    return out.select(*COLUMNS)


def round_candidates(state: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Round numbers near spot, each once, under the coarsest step that hits it."""
    s = state.where("atr is not null").select("security_id", "as_of", "spot", "atr", F.posexplode(ladder_steps(F.col("spot"), p.round_multipliers)).alias("rank", "step"))
    rungs = s.withColumn("level", F.explode(rungs_within(F.col("spot"), p.round_radius * F.col("atr"), F.col("step"))))
    first = Window.partitionBy("security_id", "as_of", "level").orderBy("rank")
    rungs = rungs.withColumn("n", F.row_number().over(first)).where("n = 1")
    half = p.half_width * F.col("atr")
    out = rungs.withColumns({"lower": F.col("level") - half, "upper": F.col("level") + half, "source": F.concat(F.lit("round_"), short_number(F.col("step"))), "family": F.lit("B"), "timeframe": F.lit("1D"), "formed_at": F.lit(None).cast("date"), "available_at": F.lit("0001-01-01 00:00:00").cast("timestamp"), "k_atr": F.lit(None).cast("double"), "confirm_sessions": F.lit(None).cast("long"), "atr_at_formation": F.lit(None).cast("double"), "rank": F.col("rank").cast("long")})
    return out.select(*COLUMNS)


GENERATORS = {}


def register_generator(name: str, make) -> None:
    """``make(panel, state, params) -> candidates``, joined with the built-in ones by ``candidates``."""
    GENERATORS[name] = make


def candidates(bars: DataFrame, state: DataFrame, p: Params = DEFAULT) -> DataFrame:
    out = swing_candidates(swings(bars, p), state, p).unionByName(round_candidates(state, p))
    for make in GENERATORS.values():
        out = out.unionByName(make(bars, state, p), allowMissingColumns=True)
    return out
