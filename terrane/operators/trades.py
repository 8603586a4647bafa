"""Trades of zones: a limit order at the near edge, a stop, a target and an expiry, with costs; one open trade a security at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .indicators import by_session, frame
from .labels import KEY, label_window
from .series import trading_spread

#: Costs of one side of a trade. Commission of a share (in currency) or of the value, duties of the value, slippage of the value.
COSTS = (
    ("US", 0.0005, 0.0, 0.0, 0.0002),
    ("HK", 0.0, 0.0003, 0.001057, 0.0005),
)
#: Fixed value: impact of an order of a day's whole volume, in daily deviations.
IMPACT = 0.1


def mirrored(rows: DataFrame) -> DataFrame:
    """``rows`` of zones and bars with near, far, m_open, m_high, m_low, m_close: prices of resistance zones change their sign, so one rule serves both sides."""
    sup = F.col("side") == "support"
    pick = lambda a, b: F.when(sup, F.col(a)).otherwise(-F.col(b))
    prices = {"m_open": ("open", "open"), "m_high": ("high", "low"), "m_low": ("low", "high"), "m_close": ("close", "close")}
    return rows.withColumns({"near": pick("upper", "lower"), "far": pick("lower", "upper")} | {k: pick(*v) for k, v in prices.items()})


def zone_trades(zones: DataFrame, bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The zone's key, side, k, reason, t_fill, t_exit, fill, exit, gross of the order that each zone places at as_of. Zones have k, the session's number.

    The order buys (sells short at resistance) at the near edge and is good for ``p.horizon`` sessions; a session that opens beyond the edge fills at its open. The stop lies
    ``p.breach`` ATRs behind the far edge, the target ``p.reaction`` ATRs from the fill, and what is open at the last session's close goes then: the first of these ends the trade.

    Within a session: one that opens beyond a barrier ends the trade at its open; else the stop comes before the target, which is the worse case. In the session
    of the fill the target counts only if the fill was at the open or the close is beyond it, as the high may have come before the fill; a fill beyond the stop ends
    at once. ``gross``: gain over the fill price, before costs. reason: stop, target, expiry; unfilled; open, where the horizon's sessions are not all there yet."""
    rows = mirrored(label_window(zones, bars, p.horizon)).withColumn("stop", F.col("far") - p.breach * F.col("atr"))
    w = Window.partitionBy(*KEY)
    rows = rows.withColumn("t_fill", F.min(F.when(F.col("m_low") <= F.col("near"), F.col("step"))).over(w))
    at_fill = F.col("step") == F.col("t_fill")
    rows = rows.withColumn("m_fill", F.max(F.when(at_fill, F.least("m_open", "near"))).over(w)).withColumn("target", F.col("m_fill") + p.reaction * F.col("atr"))
    o, h, low, c, stop, target = (F.col(x) for x in ("m_open", "m_high", "m_low", "m_close", "stop", "target"))
    end = lambda reason, price: F.struct(F.lit(reason).alias("reason"), price.alias("price"))
    last = F.when(F.col("step") == p.horizon, end("expiry", c))
    first_day = F.when((o <= F.col("near")) & (o <= stop), end("stop", o)).when(low <= stop, end("stop", stop)).when(((o <= F.col("near")) & (h >= target)) | (c >= target), end("target", target)).otherwise(last)
    later = F.when(o <= stop, end("stop", o)).when(o >= target, end("target", o)).when(low <= stop, end("stop", stop)).when(h >= target, end("target", target)).otherwise(last)
    rows = rows.withColumn("end", F.when(at_fill, first_day).when(F.col("step") > F.col("t_fill"), later))
    out = rows.groupBy(*KEY, "side", "k").agg(
        F.min("t_fill").cast("long").alias("t_fill"), F.max("m_fill").alias("m_fill"), F.count("*").alias("n"),
        F.min(F.when(F.col("end").isNotNull(), F.struct(F.col("step").cast("long").alias("step"), "end.reason", "end.price"))).alias("x"),
    )
    sign = F.when(F.col("side") == "support", 1).otherwise(-1)
    reason = F.when(F.col("t_fill").isNull(), F.when(F.col("n") < p.horizon, "open").otherwise("unfilled")).otherwise(F.coalesce("x.reason", F.lit("open")))
    gross = (F.col("x.price") - F.col("m_fill")) / F.abs("m_fill")
    return out.select(*KEY, "side", "k", reason.alias("reason"), "t_fill", F.col("x.step").alias("t_exit"), (sign * F.col("m_fill")).alias("fill"), (sign * F.col("x.price")).alias("exit"), gross.alias("gross"))


def one_at_a_time(trades: DataFrame) -> DataFrame:
    """The filled trades that are taken if a security holds one at a time: in the order of fills a trade is taken if it is filled after the session in which the one taken before ended.

    Of trades filled in one session only the first can be taken (the earliest date, then the zone's name), so there is one choice a session; a security's choices
    are then walked once, in a fold over an array of (fill, end). A trade that is still open blocks all later ones."""
    far = F.lit(1 << 40)
    filled = trades.where(F.col("t_fill").isNotNull()).withColumns({"k_fill": F.col("k") + F.col("t_fill"), "k_end": F.coalesce(F.col("k") + F.col("t_exit"), far)})
    first = Window.partitionBy("security_id", "k_fill").orderBy("as_of", "zone_id")
    filled = filled.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<bigint>").alias("taken"))
    take = lambda s, x: F.when(x["k_fill"] > s["end"], F.struct(x["k_end"].alias("end"), F.array_append(s["taken"], x["k_fill"]).alias("taken"))).otherwise(s)
    walk = filled.groupBy("security_id").agg(F.array_sort(F.collect_list(F.struct("k_fill", "k_end"))).alias("all"))
    taken = walk.select("security_id", F.explode(F.aggregate("all", start, take, lambda s: s["taken"])).alias("k_fill"))
    return filled.join(taken, ["security_id", "k_fill"], "left_semi").drop("k_fill", "k_end")


def trade_facts(bars: DataFrame) -> DataFrame:
    """security_id, as_of, spread, sigma, adv: what a trade costs is reckoned from what was known at as_of: the mean of 20 high-low spreads, the deviation of 20 returns and the mean traded
    value of 20 sessions."""
    spread = trading_spread(bars)
    ret = F.col("close") / F.lag("close").over(by_session()) - 1
    one = bars.withColumn("ret", ret).join(spread, ["security_id", "session"], "left")
    w = frame(20)
    return one.select("security_id", F.col("session").alias("as_of"), F.avg("spread").over(w).alias("spread"), F.stddev_samp("ret").over(w).alias("sigma"), F.avg(F.col("close") * F.col("volume")).over(w).alias("adv"))


def cost(market: Column, price: Column, spread: Column, sigma: Column, adv: Column, notional: float, costs=COSTS) -> Column:
    """What a round trip costs as a share of the price: on each side commission, duties, half the spread, slippage and impact; null for a market without costs."""
    side = F.lit(None).cast("double")
    for name, a_share, commission, duty, slippage in costs:
        impact = IMPACT * F.coalesce(sigma, F.lit(0.0)) * F.sqrt(notional / F.nullif(adv, F.lit(0.0)))
        fixed = a_share / price + commission + duty + slippage
        side = F.when(market == name, fixed + F.coalesce(spread, F.lit(0.0)) / 2 + F.coalesce(impact, F.lit(0.0))).otherwise(side)
    return 2 * side


def netted(trades: DataFrame, facts: DataFrame, markets: DataFrame, notional: float = 1000.0) -> DataFrame:
    """``trades`` with cost and net. facts: ``trade_facts``; markets: security_id, market, one row each."""
    rows = trades.join(facts, ["security_id", "as_of"], "left").join(markets, "security_id", "left")
    price = cost(F.col("market"), F.col("fill"), F.col("spread"), F.col("sigma"), F.col("adv"), notional)
    return rows.withColumn("cost", price).withColumn("net", F.col("gross") - F.col("cost")).drop("spread", "sigma", "adv", "market")


def trade_metrics(trades: DataFrame, sessions: DataFrame) -> DataFrame:
    """security_id, trades, stops, targets, expiries, hit_rate, mean_net, profit_factor, cost, held (sessions a trade), turnover (both sides of each trade, in notionals, a session of
    the security's history). ``sessions``: security_id, n."""
    done = trades.where(F.col("net").isNotNull())
    is_ = lambda r: F.count_if(F.col("reason") == r)
    one = done.groupBy("security_id").agg(
        F.count("*").alias("trades"), is_("stop").alias("stops"), is_("target").alias("targets"), is_("expiry").alias("expiries"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.avg("net").alias("mean_net"), F.avg("cost").alias("cost"),
        (F.sum(F.greatest("net", F.lit(0.0))) / F.nullif(F.abs(F.sum(F.least("net", F.lit(0.0)))), F.lit(0.0))).alias("profit_factor"),
        F.avg(F.col("t_exit") - F.col("t_fill") + 1).alias("held"),
    )
    return one.join(sessions, "security_id").withColumn("turnover", 2.0 * F.col("trades") / F.col("n")).drop("n")
