"""Queries of features, options and text."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import indicators, touch
from ..sources.derived import bars
from . import labels as LB
from .core import R, ranged, rounded, state_of, zones_and_state
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


def lines(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet")


register(
    "flt_10_liquidity_tier", lambda s, d: X.liquidity_tier(bars(s, d)),
    query("SELECT security_id, session, round(adv, 6) AS adv, round(m, 6) AS median_value, round(traded, 6) AS traded, CASE WHEN traded < 0.8 OR close < 1 THEN 3 WHEN least(adv, m) >= 20000 THEN 1 WHEN least(adv, m) >= 5000 THEN 2 ELSE 3 END AS tier FROM (SELECT *, avg(close * volume) OVER w AS adv, median(close * volume) OVER w AS m, avg((volume > 0)::INT) OVER w AS traded FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))", "bars"),
)
VP = {"vp": "SELECT security_id, period, bin, sum(v) AS volume FROM (SELECT security_id, CAST(date_trunc('quarter', session) AS DATE) AS period, unnest(range(floor(low / 0.25)::BIGINT, floor(high / 0.25)::BIGINT + 1)) AS bin, volume / (floor(high / 0.25) - floor(low / 0.25) + 1) AS v FROM bars) GROUP BY ALL"}
register("agg_8_volume_profile", lambda s, d: X.volume_profile(bars(s, d)), query("SELECT security_id, period, bin, round(volume, 6) AS volume FROM vp", "bars", extra=VP))
_GAUSS = sum(math.exp(-(i**2) / 2) for i in range(-3, 4))
_beside = lambda sign: f"(smooth {sign} coalesce(lag(smooth) OVER w, smooth {'-' if sign[0] == '>' else '+'} 1) AND smooth {sign}= coalesce(lead(smooth) OVER w, smooth))"
NODES = VP | {
    "full": "SELECT s.security_id, s.period, s.bin, coalesce(v.volume, 0) AS volume FROM (SELECT security_id, period, unnest(range(min(bin), max(bin) + 1)) AS bin FROM vp GROUP BY security_id, period) s LEFT JOIN vp v USING (security_id, period, bin)",
    "smoothed": f"SELECT a.security_id, a.period, a.bin, round(sum(b.volume * exp(-((b.bin - a.bin) ** 2) / 2.0)) / {_GAUSS!r}, 6) AS smooth FROM full_ a JOIN full_ b ON b.security_id = a.security_id AND b.period = a.period AND b.bin BETWEEN a.bin - 3 AND a.bin + 3 GROUP BY ALL",
    "nodes": f"SELECT * FROM (SELECT security_id, period, bin, smooth, CASE WHEN {_beside('>')} AND smooth >= round(1.5 * median, 6) THEN 'HVN' WHEN {_beside('<')} AND smooth <= round(0.5 * median, 6) THEN 'LVN' END AS node FROM smoothed JOIN (SELECT security_id, period, median(smooth) AS median FROM smoothed GROUP BY ALL) USING (security_id, period) WINDOW w AS (PARTITION BY security_id, period ORDER BY bin)) WHERE node IS NOT NULL",
}
NODES = {k if k != "full" else "full_": v for k, v in NODES.items()}
register("agg_9_volume_nodes", lambda s, d: X.volume_nodes(X.volume_profile(bars(s, d))), query("SELECT security_id, period, bin, smooth, node FROM nodes", "bars", extra=NODES))
register(
    "agg_10_profile_features", lambda s, d: X.profile_features(X.volume_profile(bars(s, d))),
    query("SELECT security_id, period, arg_max(price, (round(volume, 6), -bin)) AS poc, round(any_value(total), 6) AS total, round(max(volume) / any_value(total), 6) AS concentration, round(any_value(mean), 6) AS mean, round(sum(volume / total * (price - mean) ** 3) / nullif(sum(volume / total * (price - mean) ** 2) ** 1.5, 0), 6) AS skew, round(sum(volume / total * (price - mean) ** 4) / nullif(sum(volume / total * (price - mean) ** 2) ** 2, 0), 6) AS kurtosis, any_value(coalesce(hvn, 0))::BIGINT AS n_hvn, any_value(coalesce(lvn, 0))::BIGINT AS n_lvn FROM (SELECT *, sum(volume) OVER w AS total, sum(price * volume) OVER w / sum(volume) OVER w AS mean FROM (SELECT *, (bin + 0.5) * 0.25::DOUBLE AS price FROM vp) WINDOW w AS (PARTITION BY security_id, period)) LEFT JOIN (SELECT security_id, period, count(*) FILTER (node = 'HVN') AS hvn, count(*) FILTER (node = 'LVN') AS lvn FROM nodes GROUP BY ALL) USING (security_id, period) GROUP BY ALL", "bars", extra=NODES),
)
# A state: bounds, volume inside, volume wanted. Each step takes the fuller neighbour, the upper of equals; bins without volume count 0.
_AREA = {
    "vb": "SELECT security_id, period, bin, round(volume, 6) AS v FROM vp",
    "vs": "SELECT security_id, period, min(bin) AS first, max(bin) AS last, arg_max(bin, (v, -bin)) AS poc, max(v) AS top, 0.7 * sum(v ORDER BY bin) AS want FROM vb GROUP BY ALL",
    "grown": """SELECT security_id, period, first, last, want, poc AS lo, poc AS hi, top AS inside FROM vs
      UNION ALL SELECT security_id, period, first, last, want, CASE WHEN up >= down THEN lo ELSE lo - 1 END, CASE WHEN up >= down THEN hi + 1 ELSE hi END, inside + greatest(up, down) FROM (
        SELECT g.*, CASE WHEN g.hi < g.last THEN coalesce(u.v, 0) ELSE -1 END AS up, CASE WHEN g.lo > g.first THEN coalesce(d.v, 0) ELSE -1 END AS down
        FROM grown g LEFT JOIN vb u ON u.security_id = g.security_id AND u.period = g.period AND u.bin = g.hi + 1 LEFT JOIN vb d ON d.security_id = g.security_id AND d.period = g.period AND d.bin = g.lo - 1
        WHERE g.inside < g.want - 1e-9)""",
}
register("agg_9_value_area", lambda s, d: X.value_area(X.volume_profile(bars(s, d))), query("SELECT security_id, period, lo AS val, hi AS vah FROM grown QUALIFY row_number() OVER (PARTITION BY security_id, period ORDER BY hi - lo DESC) = 1", "bars", extra=VP | _AREA))


def _quantiles(s, d):
    series = ranged(s, d)
    return touch.path_quantiles(state_of(series), indicators.triples(series))


register("agg_24_path_quantiles", _quantiles, query("SELECT security_id, as_of, " + ", ".join(f"round(quantile_cont({c}, {x}), 6) AS {c}_q{int(x * 100):02d}" for c in ("high", "low", "close") for x in (0.05, 0.5, 0.95)) + " FROM (SELECT security_id, as_of, greatest(h1, h2, h3, h4, h5) AS high, least(l1, l2, l3, l4, l5) AS low, c5 AS close FROM walked) GROUP BY ALL", "walked"))


def _touches(s, d):
    """Events as outcomes at zones: a click touches, an error breaks, all others hold."""
    outcome = F.when(F.col("event_type") == "click", "touch").when(F.col("event_type") == "error", "break").otherwise("hold")
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("zone"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("n"), outcome.alias("outcome"))


_STATES = {
    "ev": "SELECT user_id AS zone, ts, event_id AS n, CASE event_type WHEN 'click' THEN 'touch' WHEN 'error' THEN 'break' ELSE 'hold' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events",
    "st": """SELECT zone, ts, n, i, CASE outcome WHEN 'break' THEN 'FLIPPED' WHEN 'hold' THEN 'CONFIRMED' ELSE 'TESTED' END AS state, (outcome = 'touch')::BIGINT AS touches, (outcome = 'hold')::BIGINT AS holds, (outcome = 'break')::BIGINT AS breaks FROM ev WHERE i = 1
      UNION ALL SELECT zone, ts, n, i, CASE WHEN NOT live THEN 'RETIRED' WHEN outcome = 'break' THEN CASE WHEN breaks > 0 THEN 'RETIRED' ELSE 'FLIPPED' END WHEN state = 'FLIPPED' THEN state WHEN outcome = 'hold' THEN 'CONFIRMED' ELSE state END,
        touches + (live AND outcome = 'touch')::BIGINT, holds + (live AND outcome = 'hold')::BIGINT, breaks + (live AND outcome = 'break')::BIGINT
      FROM (SELECT e.zone, e.ts, e.n, e.i, e.outcome, s.state, s.touches, s.holds, s.breaks, s.state <> 'RETIRED' AND epoch(e.ts) - epoch(s.ts) <= 84 * 86400 AS live FROM st s JOIN ev e ON e.zone = s.zone AND e.i = s.i + 1)""",
}
register("cmp_5_zone_states", lambda s, d: X.zone_states(_touches(s, d)), "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in _STATES.items()) + " SELECT zone, ts, n, state, touches, holds, breaks FROM st")
register("win_22_adaptive_intervals", lambda s, d: X.adaptive_intervals(indicators.true_range(bars(s, d)).select("security_id", "session", (F.col("tr") > 0.3).cast("double").alias("miss"))), query("SELECT security_id, session, round(alpha, 6) AS alpha, round(1 - avg(miss) OVER (PARTITION BY security_id ORDER BY session ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), 6) AS coverage FROM aci", "ranged", extra={"aci": "SELECT security_id, k, session, 0.1::DOUBLE AS alpha, (tr > 0.3)::INT::DOUBLE AS miss FROM ranged WHERE k = 1 UNION ALL SELECT r.security_id, r.k, r.session, least(greatest(a.alpha + 0.02 * (0.1 - a.miss), 0.001), 0.5), (r.tr > 0.3)::INT::DOUBLE FROM aci a JOIN ranged r ON r.security_id = a.security_id AND r.k = a.k + 1"}))
# The fit at i is the largest over j <= i of the smallest over k >= i of the mean outcome of j to k.
ISO = LB.ALL | {
    "ip": "SELECT security_id, side, round(exp(-abs(distance_atr) / 2), 3) AS p, y_touch AS y FROM lbl",
    "ic": "SELECT security_id, side, p, CASE WHEN grouping(security_id) = 1 THEN 0 WHEN grouping(side) = 1 THEN 1 ELSE 2 END AS level, count(*) AS n, sum(y) AS s FROM ip GROUP BY GROUPING SETS ((security_id, side, p), (security_id, p), (p))",
    "ie": "SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM (SELECT *, sum(n) OVER (PARTITION BY level, security_id, side) AS total FROM ic) WHERE total >= 500 OR level = 0 WINDOW w AS (PARTITION BY level, security_id, side ORDER BY p)",
    "im": "SELECT a.level, a.security_id, a.side, a.i AS j, b.i AS k, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n) AS m FROM ie a JOIN ie b ON a.level = b.level AND a.security_id IS NOT DISTINCT FROM b.security_id AND a.side IS NOT DISTINCT FROM b.side AND b.i >= a.i",
    "il": "SELECT *, min(m) OVER (PARTITION BY level, security_id, side, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS least FROM im",
    "fit": "SELECT e.level, e.security_id, e.side, e.p, max(l.least) AS fitted FROM ie e JOIN il l ON l.level = e.level AND l.security_id IS NOT DISTINCT FROM e.security_id AND l.side IS NOT DISTINCT FROM e.side AND l.k = e.i GROUP BY ALL",
}
register(
    "cmp_9_isotonic", lambda s, d: X.isotonic(LB.preds(s, d).join(LB.labelled(s, d).select("security_id", "as_of", "zone_id", "side"), ["security_id", "as_of", "zone_id"]), ["security_id", "side"], "p", "y"),
    query("SELECT c.security_id, c.side, round(c.p, 6) AS p, CASE WHEN f2.p IS NOT NULL THEN 2 WHEN f1.p IS NOT NULL THEN 1 ELSE 0 END AS level, round(coalesce(f2.fitted, f1.fitted, f0.fitted), 6) AS fitted FROM ic c LEFT JOIN fit f2 ON f2.level = 2 AND f2.security_id = c.security_id AND f2.side = c.side AND f2.p = c.p LEFT JOIN fit f1 ON f1.level = 1 AND f1.security_id = c.security_id AND f1.p = c.p LEFT JOIN fit f0 ON f0.level = 0 AND f0.p = c.p WHERE c.level = 2", "zones", extra=ISO),
)
register("cmp_16_sequences", lambda s, d: X.sequences(ranged(s, d)).select("security_id", "as_of", F.element_at("steps", 1)["close"].alias("first_close"), F.element_at("steps", -1)["close"].alias("last_close"), F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["volume"]).alias("volume")), query("SELECT security_id, session AS as_of, round(fc, 6) AS first_close, round(close / atr, 6) AS last_close, round(v, 6) AS volume FROM (SELECT *, first_value(close / atr) OVER w AS fc, sum(volume) OVER w AS v, count(*) OVER w AS n FROM atrs WHERE atr IS NOT NULL WINDOW w AS (PARTITION BY security_id ORDER BY session ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) WHERE n = 120", "atrs"))
register(
    "cmp_7_folds", lambda s, d: X.folds(zones_and_state(s, d)[2].select("security_id", "as_of", "zone_id")),
    query("""SELECT security_id, as_of, zone_id, fold, role, round(weight, 6) AS weight FROM (
      SELECT security_id, as_of, zone_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY security_id, as_of) AS weight FROM zones) z
      JOIN (SELECT fold, min(as_of) AS a, max(as_of) AS b FROM (SELECT year(as_of) AS fold, as_of FROM zones) GROUP BY fold HAVING fold > (SELECT min(year(as_of)) FROM zones)) f ON year(as_of) <= fold
      JOIN (VALUES ('train'), ('validate')) r(role) ON CASE role WHEN 'validate' THEN year(as_of) = fold ELSE year(as_of) < fold AND NOT (as_of + 12 >= a AND as_of <= b + 5) END""", "zones"),
)
register("fn_14_confidence", lambda s, d: lines(s, d).withColumn("event_risk", F.col("l_quantity") / 50).select("l_orderkey", "l_linenumber", "l_partkey", X.confidence({"l_discount": 4.0, "l_tax": 5.0}).alias("confidence")), "SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_discount * 4 + l_tax * 5 - 0.3 * (l_quantity / 50), 0), 1), 6) AS confidence FROM lineitem")
register("fn_15_downgrade", lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", X.downgraded(F.col("l_quantity") / 50, F.when(F.col("l_returnflag") == "A", "amber").when(F.col("l_returnflag") == "R", "red").otherwise("green")).alias("confidence")), "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE l_returnflag WHEN 'A' THEN l_quantity / 50 * 0.85 WHEN 'R' THEN least(l_quantity / 50 * 0.7, 0.69) ELSE l_quantity / 50 END, 6) AS confidence FROM lineitem")
_opt = lambda s, d: lines(s, d).select((F.col("l_suppkey") % 20).alias("underlying"), (F.floor(F.col("l_extendedprice") / 5000) * 5.0).alias("strike"), F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("kind"), F.col("l_quantity").alias("open_interest"), F.col("l_discount").alias("gamma"))
register(
    "agg_22_option_strikes", lambda s, d: X.option_strikes(_opt(s, d)),
    "SELECT l_suppkey % 20 AS underlying, floor(l_extendedprice / 5000) * 5.0::DOUBLE AS strike, sum(CASE l_linestatus WHEN 'O' THEN l_quantity ELSE 0 END)::DOUBLE AS coi, sum(CASE l_linestatus WHEN 'O' THEN 0 ELSE l_quantity END)::DOUBLE AS poi, round(sum(l_discount * l_quantity * CASE l_linestatus WHEN 'O' THEN 1 ELSE -1 END), 6) AS gex FROM lineitem GROUP BY ALL",
)
register(
    "agg_22_option_levels", lambda s, d: X.option_levels(_opt(s, d)),
    "WITH o AS (SELECT l_suppkey % 20 AS underlying, floor(l_extendedprice / 5000) * 5.0::DOUBLE AS strike, l_linestatus = 'O' AS call, l_quantity AS oi, l_discount AS g FROM lineitem), b AS (SELECT underlying, strike, sum(CASE WHEN call THEN oi ELSE 0 END) AS coi, sum(CASE WHEN call THEN 0 ELSE oi END) AS poi, sum(g * oi * CASE WHEN call THEN 1 ELSE -1 END) AS gex FROM o GROUP BY ALL), c AS (SELECT *, round(sum(gex) OVER (PARTITION BY underlying ORDER BY strike ROWS UNBOUNDED PRECEDING), 6) AS cum FROM b), f AS (SELECT *, lag(cum) OVER (PARTITION BY underlying ORDER BY strike) AS pc FROM c) SELECT underlying, arg_max(strike, (coi, -strike)) AS call_wall, arg_max(strike, (poi, -strike)) AS put_wall, round(sum(poi) / nullif(sum(coi), 0), 6) AS put_call_ratio, min(strike) FILTER (cum >= 0 AND pc < 0) AS gamma_flip FROM f GROUP BY underlying",
)
register("agg_23_block_vwap", lambda s, d: X.block_vwap(lines(s, d).select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("price"))), "SELECT l_suppkey AS key, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS vwap, count(*) AS n FROM lineitem WHERE l_quantity >= 45 OR l_extendedprice * l_quantity >= 2000000 GROUP BY l_suppkey")
register("fn_17_chunks", lambda s, d: X.chunks(s.read.parquet(f"{d}/documents.parquet"), 1000).select("doc_id", "chunk", F.md5(F.col("text").cast("binary")).alias("md5")), "SELECT doc_id, chunk, md5(substring(text, (chunk * 1000 + 1)::INT, 1000)) AS md5 FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS chunk FROM documents WHERE length(text) > 0)")
register("fn_16_grounding", lambda s, d: X.grounded(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.array(*(F.lit(float(x)) for x in (129.38, 555.0, 1.0, 34.0))).alias("facts")), "facts").select("doc_id", "n_numbers", "ungrounded"), "SELECT doc_id, len(x) AS n_numbers, len(list_filter(x, lambda v: NOT (abs(v - 129.38) <= 129.38 * 0.005 OR abs(v - 555.0) <= 555 * 0.005 OR abs(v - 1.0) <= 0.005 OR abs(v - 34.0) <= 34 * 0.005))) AS ungrounded FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?'), lambda v: v::DOUBLE) AS x FROM documents)")
_tf = lambda s, d: s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 10).alias("key"), F.to_date("ts").alias("day"), "value", F.lit(1.0).alias("conf"))
register("agg_25_text_features", lambda s, d: X.text_features(_tf(s, d), _tf(s, d).select("key", F.col("day").alias("as_of")).distinct()), "WITH e AS (SELECT user_id % 10 AS key, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL) SELECT a.key, a.day AS as_of, round(sum(e.v * exp(-(a.day - e.day) * 0.6931471805599453 / 30)) / sum(exp(-(a.day - e.day) * 0.6931471805599453 / 30)), 6) AS value, min(a.day - e.day) AS days_since FROM e a JOIN e ON e.key = a.key AND e.day <= a.day GROUP BY ALL")
register("win_21_zone_history", lambda s, d: X.zone_history(LB.labelled(s, d)), query("SELECT l.security_id, l.as_of, l.zone_id, w.weeks, round(w.pt, 6) AS past_touch, round(w.ph, 6) AS past_hold FROM lbl l JOIN (SELECT security_id, side, as_of, count(*) OVER w AS weeks, sum(t) OVER w / sum(n) OVER w AS pt, sum(h) OVER w / nullif(sum(t) OVER w, 0) AS ph FROM (SELECT security_id, side, as_of, count(*) AS n, sum(y_touch) AS t, sum(y_hold) AS h FROM lbl GROUP BY ALL) WINDOW w AS (PARTITION BY security_id, side ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) w USING (security_id, side, as_of)", "zones", extra=LB.ALL))
