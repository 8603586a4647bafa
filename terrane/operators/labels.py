"""What happened after: label windows, barriers, placebos, evaluation."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladder import draw
from ..functions.quantiles import quantiles
from ..params import DEFAULT, Params
from .touch import mixed

KEY = ("security_id", "as_of", "zone_id")


def label_window(zones: DataFrame, bars: DataFrame, horizon: int = DEFAULT.horizon) -> DataFrame:
    """``zones`` (with k, the session number at as_of) x the next sessions: step, open, high, low, close, available_at. An equi-join on the session
    number; steps without a bar are missing."""
    steps = zones.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("bar_k", F.col("k") + F.col("step"))
    b = bars.select("security_id", F.col("k").alias("bar_k"), "open", "high", "low", "close", "available_at")
    return steps.join(b, ["security_id", "bar_k"]).drop("bar_k")


def calendar_window(zones: DataFrame, bars: DataFrame, sessions: DataFrame, horizon: int = DEFAULT.horizon) -> DataFrame:
    """``zones`` x the next sessions of the calendar: step, session, open, high, low, close, and label_gap: whether a session of the window has no bar. Steps count the market's sessions, so a
    bar that a security misses leaves a hole with null prices instead of moving the window on. ``sessions``: as_of, step, session of ``pit.next_sessions``."""
    b = bars.select("security_id", "session", "open", "high", "low", "close")
    rows = zones.join(sessions.where(F.col("step") <= horizon), "as_of").join(b, ["security_id", "session"], "left")
    w = Window.partitionBy(*KEY)
    return rows.withColumn("label_gap", (F.count("close").over(w) < horizon))


def barrier_labels(zones: DataFrame, bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Touch, break and reaction of each zone over the horizon. Prices of resistance zones are mirrored first, so one rule serves both sides.

    touched: a bar overlaps the zone. Entry: the open of that bar if it lies in the zone, else the near edge. After entry the zone breaks when a bar's low is
    below the far edge by the breach buffer, and reacts when a high is above entry by the reaction threshold; in one bar the reaction counts first only
    if the bar opened at entry or above. hold: touched, reacted and not broken before. Columns of a zone that was not touched are null; label_gap: a
    bar of the horizon is missing."""
    rows = label_window(zones, bars, p.horizon)
    sup = F.col("side") == "support"
    lo, hi = F.when(sup, F.col("lower")).otherwise(-F.col("upper")), F.when(sup, F.col("upper")).otherwise(-F.col("lower"))
    rows = rows.withColumns({"lo_edge": lo, "hi_edge": hi, "m_open": F.when(sup, F.col("open")).otherwise(-F.col("open")), "m_high": F.when(sup, F.col("high")).otherwise(-F.col("low")), "m_low": F.when(sup, F.col("low")).otherwise(-F.col("high"))})
    w = Window.partitionBy(*KEY)
    hit = (F.col("m_low") <= F.col("hi_edge")) & (F.col("m_high") >= F.col("lo_edge"))
    rows = rows.withColumn("t_touch", F.min(F.when(hit, F.col("step"))).over(w)).withColumn("n_bars", F.count("*").over(w))
    entry = F.max(F.when(F.col("step") == F.col("t_touch"), F.when(F.col("m_open").between(F.col("lo_edge"), F.col("hi_edge")), F.col("m_open")).otherwise(F.col("hi_edge")))).over(w)
    rows = rows.withColumn("entry", entry)
    live = F.col("step") >= F.col("t_touch")
    breaks = live & (F.col("m_low") < F.col("lo_edge") - p.breach * F.col("atr"))
    reacts = live & (F.col("m_high") >= F.col("entry") + p.reaction * F.col("atr"))
    both_first = F.when(F.col("m_open") >= F.col("entry"), F.col("step") - 0.25).otherwise(F.col("step") + 0.25)
    out = rows.groupBy(*KEY, "side").agg(
        F.min("t_touch").alias("t_touch"), F.min(F.when(breaks, F.col("step"))).alias("t_break"), F.min(F.when(reacts, both_first)).alias("r"), F.max("entry").alias("entry_"), F.min("n_bars").alias("n_bars"), F.max("available_at").alias("available_at"),
    )
    touched, broke = F.col("t_touch").isNotNull(), F.col("t_break").isNotNull()
    held = F.col("r").isNotNull() & (~broke | (F.col("r") < F.col("t_break")))
    flag = lambda c: F.when(touched, c.cast("long"))
    return out.select(*KEY, "side", touched.cast("long").alias("y_touch"), flag(held).alias("y_hold"), flag(broke & ~held).alias("y_break"), flag(~held & ~broke).alias("unresolved"), F.col("t_touch").cast("long").alias("t_touch"), F.col("t_break").cast("long").alias("t_break"), F.when(F.col("side") == "support", F.col("entry_")).otherwise(-F.col("entry_")).alias("entry"), (F.col("n_bars") < p.horizon).alias("label_gap"), "available_at")


def placebos(zones: DataFrame, n: int = 5, jitter: float = 0.1, seed: int = 0) -> DataFrame:
    """n zones of the same width on the same side for each zone, its distance moved by at most ``jitter`` ATRs; those that overlap a real zone by over a quarter
    of their width are dropped. More are drawn than wanted and the first n that are free stay."""
    u = draw(F.lit(str(seed)), [F.col("zone_id"), F.col("as_of").cast("string"), F.col("draw").cast("string")], F.lit(1_000_001)) / 1_000_000
    drawn = zones.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(4 * n))))
    move = (2 * u - 1) * jitter * F.col("atr")
    drawn = drawn.withColumns({"move": move, "width": F.col("upper") - F.col("lower")}).select(*KEY, "side", "spot", "atr", "draw", "width", (F.col("lower") + F.col("move")).alias("lower"), (F.col("upper") + F.col("move")).alias("upper"), ((F.col("center") + F.col("move") - F.col("spot")) / F.col("atr")).alias("distance_atr"))
    drawn = drawn.where((F.col("distance_atr") < 0) == (F.col("side") == "support"))
    real = zones.select("security_id", "as_of", F.col("zone_id").alias("r_zone"), F.col("lower").alias("r_lower"), F.col("upper").alias("r_upper"))
    shared = F.least("upper", "r_upper") - F.greatest("lower", "r_lower")
    free = drawn.join(real.where("false") if jitter == 0 else real, (drawn.security_id == real.security_id) & (drawn.as_of == real.as_of) & (F.col("zone_id") != F.col("r_zone")) & (shared > 0.25 * F.col("width")), "left_anti")
    w = Window.partitionBy(*KEY).orderBy("draw")
    return free.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n", "width")


def match_zones(zones: DataFrame, weeks: int = 12, within: float = DEFAULT.identity_match) -> DataFrame:
    """zone -> the earlier zone of the same security and side that it continues: centers within ``within`` ATRs, in the last ``weeks`` weeks; the nearest in
    sources (Jaccard), then in price, then the latest. Joined by stretches of ``weeks`` weeks and the one before."""
    stretch = F.floor(F.datediff("as_of", F.lit("1970-01-01").cast("date")) / (7 * weeks))
    z = zones.select("security_id", "as_of", "zone_id", "side", "center", "atr", F.split("sources", ",").alias("s"))
    old = z.select("security_id", stretch.alias("stretch"), F.col("as_of").alias("prior_as_of"), F.col("zone_id").alias("prior_zone"), "side", F.col("center").alias("prior_center"), F.col("s").alias("ps"))
    gap = F.datediff("as_of", "prior_as_of")
    z = z.withColumn("stretch", F.explode(F.array(stretch, stretch - 1)))
    pairs = z.join(old, ["security_id", "side", "stretch"]).where((gap > 0) & (gap <= 7 * weeks) & (F.abs(F.col("center") - F.col("prior_center")) <= within * F.col("atr")))
    jaccard = F.size(F.array_intersect("s", "ps")) / F.size(F.array_union("s", "ps"))
    pairs = pairs.withColumn("jaccard", F.round(jaccard, 9)).where("jaccard > 0")
    w = Window.partitionBy("security_id", "as_of", "zone_id").orderBy(F.desc("jaccard"), F.round(F.abs(F.col("center") - F.col("prior_center")), 9), F.desc("prior_as_of"), "prior_zone")
    return pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select("security_id", "as_of", "zone_id", "prior_as_of", "prior_zone", "jaccard")


STRATA = ("bucket", "n_families", "regime")


def by_family(labelled: DataFrame) -> DataFrame:
    """``labelled`` (with sources) once for each family among a zone's sources: A for swings, B for round numbers."""
    family = F.array_distinct(F.transform(F.split("sources", ","), lambda x: F.when(x.startswith("round"), "B").otherwise("A")))
    return labelled.withColumn("family", F.explode(family))


def reaction_table(labelled: DataFrame, keys: tuple[str, ...] = STRATA) -> DataFrame:
    """Hold rates by ``keys`` (distance bucket, number of families and regime), and coarser from the right: grouping sets in one pass."""
    return labelled.where("y_touch = 1").rollup(*keys).agg(F.count("*").alias("n"), F.avg(F.col("y_hold").cast("double")).alias("hold_rate"), F.grouping_id().alias("coarse"))


def matched_control(real: DataFrame, placebo: DataFrame, keys: tuple[str, ...] = STRATA) -> DataFrame:
    """``reaction_table`` of real zones beside that of placebos, and lift: how much more often real zones hold."""
    all_keys = [*keys, "coarse"]
    b = reaction_table(placebo, keys).select(*(F.col(c).alias(f"_{c}") for c in all_keys), F.col("n").alias("n_placebo"), F.col("hold_rate").alias("placebo_rate"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in all_keys]
    joined = reaction_table(real, keys).join(b, same, "left")
    return joined.select(*all_keys, "n", "hold_rate", "n_placebo", "placebo_rate", (F.col("hold_rate") - F.col("placebo_rate")).alias("lift"))


def historical_frequency(labelled: DataFrame, alpha: float = 5.0, least: int = 200, fine: tuple[str, ...] = STRATA, middle: tuple[str, ...] = ("bucket", "n_families"), coarse: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """The ``fine`` keys, n, level, rate: the hold rate of the cell, smoothed towards the overall rate; where it has fewer than ``least`` touches that of its ``middle`` keys, and where
    these have fewer, of its ``coarse`` ones. ``level`` 3 to 1 tells which."""
    cells = labelled.where("y_touch = 1").groupBy(*fine).agg(F.count("*").alias("n3"), F.sum("y_hold").alias("h3"))
    sums = {f"{x}{k}": F.sum(f"{x}3").over(Window.partitionBy(*keys)) for k, keys in ((2, middle), (1, coarse)) for x in "nh"}
    rows = cells.withColumns(sums)
    base = F.broadcast(rows.agg((F.sum("h3") / F.sum("n3")).alias("base")))  # one row
    smooth = lambda k: (F.col(f"h{k}") + alpha * F.col("base")) / (F.col(f"n{k}") + alpha)
    pick = lambda f: F.when(F.col("n3") >= least, f(3)).when(F.col("n2") >= least, f(2)).otherwise(f(1))
    return rows.crossJoin(base).select(*fine, F.col("n3").alias("n"), pick(F.lit).alias("level"), pick(smooth).alias("rate"))


def calibration(preds: DataFrame, p: str, y: str, stratum: str, bins: int = 10) -> DataFrame:
    """The stratum (null: all rows), n, brier, log_loss, ece and slope. ece: over ``bins`` bins of equal mass, whose edges are exact quantiles of all rows; slope: of the outcome on the
    forecast, 1 if forecasts are neither too bold nor too timid."""
    edges = F.broadcast(quantiles(preds, p, [i / bins for i in range(1, bins)]))  # one row
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = preds.crossJoin(edges).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(p))))
    sums = {"n": F.count("*"), "sp": F.sum(p), "sy": F.sum(y), "spp": F.sum(F.col(p) * F.col(p)), "spy": F.sum(F.col(p) * F.col(y)), "b": F.sum(F.pow(F.col(p) - F.col(y), 2)), "ll": F.sum(-(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped)))}
    each = rows.groupBy(stratum, "bin").agg(*(v.alias(k) for k, v in sums.items()))
    whole = each.groupBy("bin").agg(*(F.sum(k).alias(k) for k in sums)).withColumn(stratum, F.lit(None).cast(preds.schema[stratum].dataType))
    t = {k: F.sum(k) for k in sums}
    spread = F.nullif(t["spp"] - t["sp"] * t["sp"] / t["n"], F.lit(0.0))
    return each.unionByName(whole).groupBy(stratum).agg(t["n"].alias("n"), (t["b"] / t["n"]).alias("brier"), (t["ll"] / t["n"]).alias("log_loss"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / t["n"]).alias("ece"), ((t["spy"] - t["sp"] * t["sy"] / t["n"]) / spread).alias("slope"))


def fdr(tests: DataFrame, p: str, group: str) -> DataFrame:
    """``tests`` with q: the smallest of m * p / rank over this and all higher ranks, within the group."""
    up = Window.partitionBy(group).orderBy(p, "id")
    rows = tests.withColumns({"rank": F.row_number().over(up), "m": F.count("*").over(Window.partitionBy(group))})
    down = Window.partitionBy(group).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("q", F.least(F.min(F.col(p) * F.col("m") / F.col("rank")).over(down), F.lit(1.0)))


#: Where the draws of a Poisson(1) number change, cut off at 6, which one in ten thousand exceeds; in parts of 2**31.
POISSON = tuple(int(x * 2**31) for x in (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582))


def resampled(sums: DataFrame, by: list[str], cluster: list[str], times: int, seed: int = 0) -> DataFrame:
    """by, b, s, n: of each group the sums of ``sums`` (s and n of each cluster) in each of ``times`` resamples, of which each gives every cluster a Poisson(1) weight. A cluster's row
    never becomes ``times`` rows: a task adds up weights times sums in one array of resamples for each group, a chunk of clusters at a time, and passes on one row for each
    resample; with more than 500 groups it passes on what it has and starts afresh."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cluster)).cast("binary")
    start = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % (1 << 31)
    numbers, cuts = mixed(np.arange(1, times + 1, dtype=np.int64)), np.array(POISSON)
    chunk = max(1, (1 << 20) // times)

    def passed_on(kept):
        for group, (s, n) in kept.items():
            yield pd.DataFrame({c: pd.Series([x] * times, dtype=object) for c, x in zip(by, group, strict=True)} | {"b": np.arange(1, times + 1), "s": s, "n": n})

    def add(batches):
        kept: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for group, rows in pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]:
                s, n = kept.setdefault(tuple(None if x != x else x for x in group), (np.zeros(times), np.zeros(times)))
                for at in range(0, len(rows), chunk):
                    part = rows.iloc[at : at + chunk]
                    w = np.searchsorted(cuts, mixed(part["start"].to_numpy(np.int64)[:, None] ^ numbers), "right").astype(float)
                    s += part["s"].to_numpy(float) @ w
                    n += part["n"].to_numpy(float) @ w
            if len(kept) > 500:
                yield from passed_on(kept)
                kept = {}
        yield from passed_on(kept)

    types = dict(sums.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "b long, s double, n double"])
    drawn = sums.select(*by, start.alias("start"), F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n"))
    return drawn.mapInPandas(add, schema).groupBy(*by, "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def cluster_bootstrap(rows: DataFrame, cluster: list[str], value: str, times: int = 2000, seed: int = 0, null: float = 0.5) -> DataFrame:
    """mean, low, high (95 %) of ``value`` by resampling clusters, and p: twice the smaller share of resamples on one side of ``null``. Clusters are summed first."""
    sums = rows.groupBy(*cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    means = resampled(sums, [], cluster, times, seed).select((F.col("s") / F.nullif("n", F.lit(0.0))).alias("m"))
    side = lambda c: F.avg(c.cast("double"))
    p = F.least(F.lit(1.0), 2 * F.least(side(F.col("m") <= null), side(F.col("m") >= null))).alias("p")
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), p)
    return sums.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(ci)


def bca_interval(rows: DataFrame, cluster: list[str], value: str, by: list[str] | None = None, times: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """``by``, n, clusters, mean, low, high: the bias-corrected and accelerated interval of the mean of ``value``, by resampling clusters, for each group of ``by``.

    The correction comes from the share of resamples under the mean, the acceleration from the means without one cluster each: these follow from the total minus a cluster's own
    sums, so their moments are one more aggregation. Where all resamples agree, or nothing can be left out, the interval is the mean itself."""
    by = by or []
    sums = rows.groupBy(*by, *cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n")).where("n > 0")
    total = sums.groupBy(*by).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.count("*").alias("clusters"))
    joined = (lambda a, b: a.join(b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*(f"_{c}" for c in by))) if by else (lambda a, b: a.crossJoin(b))
    renamed = lambda df: df.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in df.columns if c not in by))
    without = (F.col("ts") - F.col("s")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0)) - F.col("ts") / F.col("tn")
    off = joined(sums, renamed(total)).withColumn("d", without)
    power = lambda k: F.sum(F.pow("d", F.lit(float(k))))
    moments = off.groupBy(*by).agg(F.count("d").alias("c"), power(1).alias("d1"), power(2).alias("d2"), power(3).alias("d3"))
    drawn = resampled(sums, by, cluster, times, seed).select(*by, (F.col("s") / F.nullif("n", F.lit(0.0))).alias("m"))
    against = joined(drawn, renamed(total.select(*by, (F.col("ts") / F.col("tn")).alias("mean"))))
    under = against.groupBy(*by).agg(F.avg(F.when(F.col("m") < F.col("mean"), 1.0).when(F.col("m") == F.col("mean"), 0.5).otherwise(0.0)).alias("under"), F.sort_array(F.collect_list("m")).alias("means"))
    facts = joined(joined(total, renamed(moments)), renamed(under))

    def finish(batches):
        normal = NormalDist()
        for pdf in batches:
            low, high = [], []
            for r in pdf.itertuples():
                mean, means = r.ts / r.tn, np.asarray(r.means)
                centre = r.d1 / r.c if r.c else 0.0
                second, third = r.d2 - r.c * centre**2, r.d3 - 3 * centre * r.d2 + 3 * centre**2 * r.d1 - r.c * centre**3
                if not 0 < r.under < 1 or not second > 1e-300:
                    low.append(mean)
                    high.append(mean)
                    continue
                z0, a = normal.inv_cdf(r.under), -third / (6 * second**1.5)
                for out, z in ((low, normal.inv_cdf((1 - level) / 2)), (high, normal.inv_cdf((1 + level) / 2))):
                    at = normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
                    out.append(float(np.quantile(means, at)))
            yield pdf[[*by]].assign(n=pdf["tn"], clusters=pdf["clusters"], mean=pdf["ts"] / pdf["tn"], low=low, high=high)

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "n long, clusters long, mean double, low double, high double"])
    return facts.mapInPandas(finish, schema)


def drift(ref: DataFrame, cur: DataFrame, value: str, bins: int = 10, amber: float = 0.1, red: float = 0.25) -> DataFrame:
    """psi over bins of equal mass of the reference; of the two distribution functions the largest distance (ks) and the area between them (w1); and the level that psi stands for."""
    edges = F.broadcast(quantiles(ref, value, [i / bins for i in range(1, bins)]))
    both = ref.select(F.col(value).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionAll(cur.select(F.col(value).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    share = both.crossJoin(edges).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("v")))).groupBy("bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    tot = share.agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    a, b = F.greatest(F.col("r") / F.col("tr"), F.lit(1e-6)), F.greatest(F.col("c") / F.col("tc"), F.lit(1e-6))
    psi = share.crossJoin(F.broadcast(tot)).agg(F.sum((b - a) * F.log(b / a)).alias("psi"))
    # Running sums in two steps: over a bounded number of stretches of the values, and within each stretch.
    fine = F.broadcast(ref.agg(F.percentile_approx(value, F.array(*(F.lit(i / 256) for i in range(1, 256)))).alias("fine")))
    steps = both.groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).crossJoin(fine).withColumn("part", F.size(F.filter("fine", lambda e: e < F.col("v")))).drop("fine")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = steps.groupBy("part").agg(F.sum("r").alias("pr"), F.sum("c").alias("pc")).select("part", F.coalesce(F.sum("pr").over(before), F.lit(0)).alias("br"), F.coalesce(F.sum("pc").over(before), F.lit(0)).alias("bc"))
    run = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    starts = steps.groupBy("part").agg(F.min("v").alias("v0")).select("part", F.lead("v0").over(Window.orderBy("part")).alias("next_part"))
    cdf = steps.join(F.broadcast(base), "part").join(F.broadcast(starts), "part").crossJoin(F.broadcast(tot))  # at most 256 parts, one row of totals
    cdf = cdf.withColumn("d", F.abs((F.col("br") + F.sum("r").over(run)) / F.col("tr") - (F.col("bc") + F.sum("c").over(run)) / F.col("tc"))).withColumn("after", F.coalesce(F.lead("v").over(Window.partitionBy("part").orderBy("v")), "next_part", "v"))
    level = F.when(F.col("psi") > red, "red").when(F.col("psi") > amber, "amber").otherwise("green")
    return psi.crossJoin(cdf.agg(F.max("d").alias("ks"), F.sum(F.col("d") * (F.col("after") - F.col("v"))).alias("w1"))).withColumn("level", level)


def published(zones: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Zones good enough to show, ranked by p_touch * p_hold * reaction * confidence: the best two of each side, a third and fourth only if within a tenth of the second. A data
    quality under the lower limit (``dq``, of a security and date) suppresses all of its zones; ``event_risk`` above its limit suppresses the zone."""
    t = p.publish
    ok = zones.where((F.col("p_touch") >= t["p_touch"]) & (F.col("p_hold") >= t["p_hold"]) & (F.col("confidence") >= t["confidence"]) & (F.col("event_risk") <= t["event_risk"]) & (F.col("dq") >= t["dq"]))
    bad = zones.where(F.col("dq") < t["suppress"]).select("security_id", "as_of").distinct()
    ok = ok.join(bad, ["security_id", "as_of"], "left_anti").withColumn("score", F.col("p_touch") * F.col("p_hold") * F.col("reaction") * F.col("confidence"))
    w = Window.partitionBy("security_id", "as_of", "side").orderBy(F.desc(F.round("score", 9)), "zone_id")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ok = ok.withColumns({"rank": F.row_number().over(w), "second": F.nth_value("score", 2).over(full)})
    return ok.where((F.col("rank") <= 2) | ((F.col("rank") <= 4) & (F.round("score", 9) >= F.round(0.9 * F.col("second"), 9)))).drop("second")
