"""Profiles, zone histories, states, scores, options, text: the features around zones."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_session, frame


def liquidity_tier(bars: DataFrame, n: int = 60, large: float = 20_000.0, middle: float = 5_000.0, least: float = 0.8, price: float = 1.0) -> DataFrame:
    """security_id, session, adv and median_value (mean and median of the traded value of n sessions), traded (share of them with volume), tier 1 to 3: by the smaller of the two values; 3 with too few
    sessions traded or too low a price."""
    value = F.col("close") * F.col("volume")
    w = frame(n)
    sorted_ = F.array_sort(F.collect_list(value).over(w))
    half = F.size("sorted")
    middle_of = (F.get("sorted", F.floor((half - 1) / 2).cast("int")) + F.get("sorted", F.floor(half / 2).cast("int"))) / 2
    out = bars.select("security_id", "session", "close", F.avg(value).over(w).alias("adv"), sorted_.alias("sorted"), F.avg((F.col("volume") > 0).cast("double")).over(w).alias("traded")).withColumn("median_value", middle_of)
    low = F.least("adv", "median_value")
    poor = (F.col("traded") < least) | (F.col("close") < price)
    return out.select("security_id", "session", "adv", "median_value", "traded", F.when(poor, 3).when(low >= large, 1).when(low >= middle, 2).otherwise(3).alias("tier"))


def volume_profile(bars: DataFrame, period: str = "quarter", bin_size: float = 0.25) -> DataFrame:
    """security_id, period, bin, volume: each bar's volume spread evenly over the bins that its range covers; a bar without range gives all to its one bin."""
    low, high = F.floor(F.col("low") / bin_size), F.floor(F.col("high") / bin_size)
    spread = bars.select("security_id", F.trunc("session", period).alias("period"), F.explode(F.sequence(low, high)).alias("bin"), (F.col("volume") / (high - low + 1)).alias("v"))
    return spread.groupBy("security_id", "period", "bin").agg(F.sum("v").alias("volume"))


def volume_nodes(profile: DataFrame, reach: int = 3) -> DataFrame:
    """security_id, period, bin, smooth, node: the profile's bins, empty ones between included, smoothed with a normal weight of one bin (cut off after ``reach`` bins), of which the local maxima with at
    least 1.5 times the median (HVN) and the local minima with at most half of it (LVN) stay. Plateaus count once, at their lower end; the outermost bins have one neighbour."""
    span = profile.groupBy("security_id", "period").agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select("security_id", "period", F.explode(F.sequence("a", "b")).alias("bin"))
    full = span.join(profile, ["security_id", "period", "bin"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    order = Window.partitionBy("security_id", "period").orderBy("bin")
    near = F.collect_list(F.struct("bin", "volume")).over(order.rowsBetween(-reach, reach))
    weight = lambda x: F.exp(-F.pow((x["bin"] - F.col("bin")).cast("double"), 2) / 2)
    total = sum(math.exp(-(i**2) / 2) for i in range(-reach, reach + 1))
    one = full.withColumn("near", near).withColumn("smooth", F.round(F.aggregate("near", F.lit(0.0), lambda t, x: t + x["volume"] * weight(x)) / total, 6))
    middle = one.groupBy("security_id", "period").agg(F.percentile("smooth", F.lit(0.5)).alias("median"))
    below, above = F.lag("smooth").over(order), F.lead("smooth").over(order)
    peak = (F.coalesce(F.col("smooth") > below, F.lit(True))) & (F.coalesce(F.col("smooth") >= above, F.lit(True)))
    dip = (F.coalesce(F.col("smooth") < below, F.lit(True))) & (F.coalesce(F.col("smooth") <= above, F.lit(True)))
    one = one.withColumns({"peak": peak, "dip": dip}).join(middle, ["security_id", "period"])
    node = F.when(F.col("peak") & (F.col("smooth") >= F.round(1.5 * F.col("median"), 6)), "HVN").when(F.col("dip") & (F.col("smooth") <= F.round(0.5 * F.col("median"), 6)), "LVN")
    return one.withColumn("node", node).where("node is not null").select("security_id", "period", "bin", "smooth", "node")


def profile_features(profile: DataFrame, bin_size: float = 0.25) -> DataFrame:
    """security_id, period, poc (the price of the fullest bin, the lower of equals), total, share of the fullest bin, mean, skew, kurtosis, and the numbers of high and low volume nodes."""
    price = (F.col("bin") + 0.5) * bin_size
    one = profile.withColumn("price", price)
    w = Window.partitionBy("security_id", "period")
    one = one.withColumns({"total": F.sum("volume").over(w), "mean": F.sum(F.col("price") * F.col("volume")).over(w) / F.sum("volume").over(w)})
    d = F.col("price") - F.col("mean")
    m = lambda k: F.sum(F.col("volume") / F.col("total") * F.pow(d, k))
    moments = one.groupBy("security_id", "period").agg(F.max_by("price", F.struct(F.round("volume", 6), -F.col("bin"))).alias("poc"), F.max("total").alias("total"), (F.max("volume") / F.max("total")).alias("concentration"), F.max("mean").alias("mean"), (m(3) / F.nullif(F.pow(m(2), 1.5), F.lit(0.0))).alias("skew"), (m(4) / F.nullif(F.pow(m(2), 2), F.lit(0.0))).alias("kurtosis"))
    nodes = volume_nodes(profile).groupBy("security_id", "period").agg(*(F.sum((F.col("node") == n).cast("long")).alias(f"n_{n.lower()}") for n in ("HVN", "LVN")))
    return moments.join(nodes, ["security_id", "period"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_hvn", "n_lvn")})


def value_area(profile: DataFrame, share: float = 0.7) -> DataFrame:
    """security_id, period, val, vah (bins): grown from the fullest bin, taking the fuller neighbour each time (the upper of equals), until ``share`` of the
    volume lies inside. The profile of one period is a small group."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        bins, v = pdf["bin"].to_numpy(), pdf["volume"].round(6).to_numpy()
        by = dict(zip(bins.tolist(), v.tolist(), strict=True))
        lo = hi = int(bins[v.argmax()])
        inside, want = by[lo], share * v.sum()
        while inside < want - 1e-9:
            up, down = by.get(hi + 1, 0.0) if hi < bins[-1] else -1.0, by.get(lo - 1, 0.0) if lo > bins[0] else -1.0
            if up >= down:
                hi, inside = hi + 1, inside + up
            else:
                lo, inside = lo - 1, inside + down
        return pd.DataFrame([(pdf["security_id"].iloc[0], pdf["period"].iloc[0], lo, hi)], columns=["security_id", "period", "val", "vah"])

    return profile.groupBy("security_id", "period").applyInPandas(grow, "security_id long, period date, val long, vah long")


#: Days without an outcome after which a zone is retired.
UNMATCHED = 84


def next_state(state: str, breaks: int, outcome: str, days: float) -> str:
    """The state after an outcome (touch, hold, break) that comes ``days`` after the last one; ``breaks`` counts those before. UNTESTED becomes TESTED on a touch; a hold confirms; a break flips
    the zone, and a second one retires it, as do ``UNMATCHED`` days without an outcome. A flipped zone stays so until then."""
    if state == "RETIRED" or days > UNMATCHED:
        return "RETIRED"
    if outcome == "break":
        return "RETIRED" if breaks else "FLIPPED"
    if state == "FLIPPED":
        return state
    return "CONFIRMED" if outcome == "hold" else "TESTED" if state == "UNTESTED" else state


def zone_states(touches: DataFrame) -> DataFrame:
    """zone, ts, n, state, touches, holds, breaks after each dated outcome (zone, ts, n, outcome): ``next_state`` in the order of time, then n, in groups of one zone. Outcomes of a
    retired zone do not count."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, count, last = "UNTESTED", {"touch": 0, "hold": 0, "break": 0}, None
        rows = []
        for r in pdf.sort_values(["ts", "n"]).itertuples():
            days = (r.ts - last).total_seconds() / 86400 if last is not None else 0.0
            live = state != "RETIRED" and days <= UNMATCHED
            state, last = next_state(state, count["break"], r.outcome, days), r.ts
            count[r.outcome] += live
            rows.append((r.zone, r.ts, r.n, state, count["touch"], count["hold"], count["break"]))
        return pd.DataFrame(rows, columns=["zone", "ts", "n", "state", "touches", "holds", "breaks"])

    return touches.groupBy("zone").applyInPandas(fold, "zone long, ts timestamp, n long, state string, touches long, holds long, breaks long")


def adaptive_intervals(errors: DataFrame, alpha: float = 0.1, gamma: float = 0.02, start: float = 0.1) -> DataFrame:
    """security_id, session, alpha, coverage: alpha[t + 1] = clip(alpha[t] + gamma * (target - miss[t])), the level in force at each session before its outcome; and the share of the last 252
    sessions, this one included, whose interval held."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        now, out = start, []
        for miss in pdf["miss"]:
            out.append(now)
            now = min(max(now + gamma * (alpha - miss), 0.001), 0.5)
        return pdf[["security_id", "session", "miss"]].assign(alpha=out)

    held = 1 - F.avg("miss").over(frame(252))
    return errors.groupBy("security_id").applyInPandas(run, "security_id long, session date, miss double, alpha double").select("security_id", "session", "alpha", held.alias("coverage"))


def isotonic(preds: DataFrame, strata: list[str], p: str, y: str, least: int = 500) -> DataFrame:
    """The strata, p, level, fitted: isotonic fits of the outcome on the forecast (rounded to 3 decimals) in each stratum, where it has ``least`` rows or more; otherwise in the
    stratum without its last column, and so on down to all rows (level 0, whatever their number). ``level``: how many columns the fit used.

    Outcomes are counted by forecast for all levels in one pass, so a fit's group has at most 1001 rows: pool adjacent violators."""
    counted = preds.where(F.col(p).isNotNull()).rollup(F.round(p, 3).alias("_p"), *strata).agg(F.count("*").alias("_n"), F.sum(y).alias("_s"), F.grouping_id().alias("_g")).where("_p is not null")
    level = sum((F.when(F.col("_g").bitwiseAND(1 << i) == 0, 1).otherwise(0) for i in range(len(strata))), F.lit(0))
    counted = counted.withColumn("level", level)
    whole = Window.partitionBy("level", *strata)
    enough = counted.withColumn("_all", F.sum("_n").over(whole)).where((F.col("_all") >= least) | (F.col("level") == 0)).drop("_g", "_all")

    def pav(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        blocks: list[list[float]] = []
        for n, s in zip(pdf["_n"], pdf["_s"], strict=True):
            blocks.append([float(n), float(s), 1])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] > blocks[-1][1] / blocks[-1][0]:
                n2, s2, c2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + s2, blocks[-1][2] + c2]
        return pdf.assign(fitted=[s / n for n, s, c in blocks for _ in range(int(c))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in enough.schema) + ", fitted double"
    fits = enough.groupBy("level", *strata).applyInPandas(pav, schema)
    out = counted.where(F.col("level") == len(strata)).select(*strata, "_p")
    for k in range(len(strata), -1, -1):
        mine = fits.where(F.col("level") == k).select(*strata[:k], "_p", F.col("fitted").alias(f"_f{k}"))
        out = out.join(mine, [*strata[:k], "_p"], "left")
    found = [F.when(F.col(f"_f{k}").isNotNull(), F.lit(k)) for k in range(len(strata), -1, -1)]
    return out.select(*strata, F.col("_p").alias("p"), F.coalesce(*found).alias("level"), F.coalesce(*(F.col(f"_f{k}") for k in range(len(strata), -1, -1))).alias("fitted"))


def sequences(bars: DataFrame, n: int = 120) -> DataFrame:
    """security_id, as_of, k, first_close, last_close, steps: the last n bars, scaled by the ATR, as an array; only full windows."""
    item = F.struct(*((F.col(c) / F.col("atr")).alias(c) for c in ("open", "high", "low", "close")), "volume")
    return bars.where("atr is not null").withColumn("steps", F.collect_list(item).over(by_session().rowsBetween(-(n - 1), 0))).where(F.size("steps") == n).select("security_id", F.col("session").alias("as_of"), "steps")


def labelled_sequences(windows: DataFrame, zones: DataFrame, labels: DataFrame, regimes: DataFrame) -> DataFrame:
    """``sequences`` for each zone that has labels: security_id, as_of, zone_id, steps; what does not change over the window (side, distance_atr, width_atr, n_sources, n_families, regime, null
    where there is none); and the labels (y_touch, y_hold, y_break, t_touch, label_gap). ``regimes``: as_of, regime. Windows are joined last, as they are wide."""
    key = ["security_id", "as_of", "zone_id"]
    static = zones.select(*key, "side", "distance_atr", "width_atr", "n_sources", "n_families").join(labels.select(*key, "y_touch", "y_hold", "y_break", "t_touch", "label_gap"), key)
    return static.join(regimes.select("as_of", "regime"), "as_of", "left").join(windows, ["security_id", "as_of"])


def folds(rows: DataFrame, horizon: int = 7, embargo: int = 5) -> DataFrame:
    """Walk-forward folds: ``rows`` once for each fold (a year after the first) that uses them, with fold, role and weight.

    A fold validates on the rows of its year and trains on all earlier ones but those that ``purged`` takes out. All zones of one security and date have the
    same role; their weights, 1 / their number, sum to 1."""
    years = F.broadcast(rows.agg(F.year(F.min("as_of")).alias("first"), F.year(F.max("as_of")).alias("last")))  # one row
    used = rows.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("security_id", "as_of"))).crossJoin(years)
    used = used.withColumn("fold", F.explode(F.filter(F.sequence(F.year("as_of"), F.col("last")), lambda y: y > F.col("first")))).drop("first", "last")
    windows = used.where(F.year("as_of") == F.col("fold")).groupBy("fold").agg(F.min("as_of").alias("start"), F.max("as_of").alias("end"))
    train = purged(used.where(F.year("as_of") < F.col("fold")), windows, horizon, embargo).withColumn("role", F.lit("train"))
    return train.unionByName(used.where(F.year("as_of") == F.col("fold")).withColumn("role", F.lit("validate")))


def purged(train: DataFrame, windows: DataFrame, horizon: int = 7, embargo: int = 5) -> DataFrame:
    """The rows of ``train`` whose label window (as_of to ``horizon`` days after it) does not touch the validation window (start, end) of their fold, ``embargo`` days on either side
    included. One window a fold."""
    w = windows.withColumnRenamed("fold", "_fold")
    touch = (F.col("fold") == F.col("_fold")) & (F.date_add("as_of", horizon + embargo) >= F.col("start")) & (F.col("as_of") <= F.date_add("end", embargo))
    return train.join(w, touch, "left_anti")


def confidence(p: dict) -> F.Column:
    """Weighted components (columns by name) minus 0.3 of event risk, clipped to 0 … 1."""
    total = sum((F.col(k) * w for k, w in p.items()), F.lit(0.0)) - 0.3 * F.col("event_risk")
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def downgraded(score, level):
    """Confidence after drift: amber x 0.85; red x 0.7, at most 0.69."""
    return F.when(level == "amber", score * 0.85).when(level == "red", F.least(score * 0.7, F.lit(0.69))).otherwise(score)


def option_strikes(options: DataFrame) -> DataFrame:
    """underlying, strike, coi, poi (open interest of calls and puts), gex from rows (underlying, strike, kind = C or P, open_interest, gamma)."""
    call = F.col("kind") == "C"
    return options.groupBy("underlying", "strike").agg(*(F.sum(F.when(c, F.col("open_interest")).otherwise(0.0)).alias(n) for n, c in (("coi", call), ("poi", ~call))), F.sum(F.col("gamma") * F.col("open_interest") * F.when(call, 1).otherwise(-1)).alias("gex"))


def option_levels(options: DataFrame) -> DataFrame:
    """underlying, call_wall, put_wall, put_call_ratio, gamma_flip, from the sums by strike."""
    w = Window.partitionBy("underlying").orderBy("strike")
    by = option_strikes(options).withColumn("cum", F.round(F.sum("gex").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6))
    by = by.withColumn("flip", F.when((F.col("cum") >= 0) & (F.lag("cum").over(w) < 0), F.col("strike")))
    return by.groupBy("underlying").agg(F.max_by("strike", F.struct("coi", -F.col("strike"))).alias("call_wall"), F.max_by("strike", F.struct("poi", -F.col("strike"))).alias("put_wall"), (F.sum("poi") / F.nullif(F.sum("coi"), F.lit(0.0))).alias("put_call_ratio"), F.min("flip").alias("gamma_flip"))


def block_vwap(trades: DataFrame, size: float = 45.0, notional: float = 2_000_000.0) -> DataFrame:
    """key, vwap, n of trades of at least ``size``, or of a value of at least ``notional``."""
    value = F.col("price") * F.col("size")
    return trades.where((F.col("size") >= size) | (value >= notional)).groupBy("key").agg((F.sum(value) / F.sum("size")).alias("vwap"), F.count("*").alias("n"))


def chunks(docs: DataFrame, size: int = 8000) -> DataFrame:
    """doc_id, chunk, text: stretches of ``size`` characters of the whole text; null and empty texts have none."""
    n = F.ceil(F.length("text") / size)
    parts = docs.where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return parts.select("doc_id", "chunk", F.substring("text", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("text"))


def grounded(texts: DataFrame, facts: str) -> DataFrame:
    """``texts`` with n_numbers and ungrounded: numbers of ``text`` that no number of the array column ``facts`` matches within 0.5 % or 0.005."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.cast("double"))
    near = lambda x: F.exists(facts, lambda f: F.abs(x - f) <= F.greatest(F.abs(f) * 0.005, F.lit(0.005)))
    return texts.withColumn("numbers", numbers).withColumns({"n_numbers": F.size("numbers"), "ungrounded": F.size(F.filter("numbers", lambda x: ~near(x)))}).drop("numbers")


def text_features(rows: DataFrame, asof: DataFrame, half_life: float = 30.0) -> DataFrame:
    """key, as_of, value, days_since: the confidence-weighted mean of each day's documents, decayed with its age and averaged over the days up to as_of; and the days since
    the last one. Days and questions are put in one order: with weights that grow from the key's first day on instead of shrinking from as_of back, running sums
    serve every as_of. A key's days may span up to 900 half-lives."""
    one = rows.groupBy("key", "day").agg((F.sum(F.col("value") * F.col("conf")) / F.nullif(F.sum("conf"), F.lit(0.0))).alias("v"))
    both = one.select("key", F.col("day").alias("at"), F.lit(0).alias("ask"), "v").unionByName(asof.select("key", F.col("as_of").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("double").alias("v")))
    w = Window.partitionBy("key").orderBy("at", "ask")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    day = F.when(F.col("ask") == 0, F.col("at"))
    grown = F.when(F.col("v").isNotNull(), F.exp(F.datediff("at", F.min("at").over(Window.partitionBy("key"))) * (0.6931471805599453 / half_life)))
    both = both.withColumn("grown", grown).withColumns({"value": F.sum(F.col("v") * F.col("grown")).over(run) / F.sum("grown").over(run), "last": F.last(day, True).over(run)})
    return both.where("ask = 1").select("key", F.col("at").alias("as_of"), "value", F.datediff("at", "last").cast("long").alias("days_since"))


def zone_history(labels: DataFrame) -> DataFrame:
    """security_id, as_of, zone_id and what earlier weeks of the same side of the security showed: weeks, touch rate, hold rate. Weeks are summed first; the current one is left out."""
    weeks = labels.groupBy("security_id", "side", "as_of").agg(F.count("*").alias("n"), F.sum("y_touch").alias("t"), F.sum("y_hold").alias("h"))
    w = Window.partitionBy("security_id", "side").orderBy("as_of").rowsBetween(Window.unboundedPreceding, -1)
    past = weeks.select("security_id", "side", "as_of", F.count("*").over(w).alias("weeks"), (F.sum("t").over(w) / F.sum("n").over(w)).alias("past_touch"), (F.sum("h").over(w) / F.nullif(F.sum("t").over(w), F.lit(0))).alias("past_hold"))
    return labels.select("security_id", "as_of", "zone_id", "side").join(past, ["security_id", "side", "as_of"]).drop("side")
