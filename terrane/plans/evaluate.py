"""Queries of evaluation joins and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import features as X
from ..operators import panel as P
from ..operators import series as S
from ..operators import zones as Z
from ..sources.derived import bars
from ..sources.staging import stage
from . import core
from . import labels as LB
from . import series as SQ
from .core import CALENDAR, _calendar, candidates, ranged, rounded, zones_and_state
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


O, win, INDEX = SQ.O, SQ.win, SQ.INDEX
_regime_sql = SQ.ORACLE["win_18_regimes"]
register("jon_12_reactions_by_regime", lambda s, d: E.reactions_by_regime(LB.labelled(s, d), S.regimes(S.market(bars(s, d))).where("regime is not null")), query(f"SELECT regime, side, count(*) AS n, round(avg(y_touch), 6) AS touch_rate, round(avg(y_hold), 6) AS hold_rate FROM lbl JOIN (SELECT session AS as_of, regime FROM ({_regime_sql}) WHERE regime IS NOT NULL) r USING (as_of) GROUP BY ALL", "zones", extra=LB.ALL))
register("jon_18_base_currency", lambda s, d: E.base_currency(bars(s, d).where("security_id < 4"), bars(s, d).where("security_id = 4")), query(f"SELECT b.security_id, b.session, round((1 + b.r) * (1 + f.r) - 1, 6) AS ret FROM (SELECT *, close / lag(close) OVER {O} - 1 AS r FROM bars) b JOIN (SELECT *, close / lag(close) OVER {O} - 1 AS r FROM bars) f ON f.security_id = 4 AND f.session = b.session WHERE b.security_id < 4", "bars"))
_rows = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("session"))
register("jon_14_option_stamps", lambda s, d: E.option_stamps(_rows(s, d), _calendar(s, d)), f"SELECT l_orderkey, l_linenumber, l_partkey, session, close_ts + INTERVAL 30 MINUTE AS available_at FROM (SELECT *, CAST(l_shipdate AS DATE) AS session FROM lineitem) JOIN ({CALENDAR}) c USING (session)")
register(
    "fn_12_option_rules", lambda s, d: E.option_rules(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(20000.0).alias("spot"), F.col("l_extendedprice").alias("strike"), (F.col("l_discount") * 3).alias("iv"), (F.col("l_quantity") / 50).alias("years"), (F.col("l_tax") - 0.01).alias("bid"), F.col("l_discount").alias("ask"))).select("l_orderkey", "l_linenumber", "l_partkey", "strike", "iv_valid", "quote_stale", (F.col("gamma") * 1000).alias("gamma_k")),
    "SELECT l_orderkey, l_linenumber, l_partkey, round(k, 6) AS strike, v AS iv_valid, (bid <= 0 OR ask < bid) AS quote_stale, CASE WHEN v THEN round(exp(-(d1 ** 2) / 2) / 2.5066282746310002 / (20000.0 * sd) * 1000, 6) END AS gamma_k FROM (SELECT *, (ln(20000.0 / k) + iv ** 2 / 2 * t) / nullif(sd, 0) AS d1 FROM (SELECT *, iv * sqrt(t) AS sd, iv > 0.01 AND iv < 5 AND t > 0 AS v FROM (SELECT *, round(l_extendedprice, 3) AS k, l_discount * 3 AS iv, l_quantity / 50 AS t, l_tax - 0.01 AS bid, l_discount AS ask FROM lineitem)))",
)
_inv = lambda s, d: (lambda w: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", *(c.alias(n) for c, n in zip(w, ("weight", "lower", "upper"), strict=True))))(E.invalidated(F.lit(1.0), F.col("l_quantity") / 50, F.col("l_extendedprice") - 1, F.col("l_extendedprice") + 1, F.lit(2.0)))
register("fn_21_event_invalidation", _inv, "SELECT l_orderkey, l_linenumber, l_partkey, round(1 - l_quantity / 50, 6) AS weight, round(l_extendedprice - 1 - m, 6) AS lower, round(l_extendedprice + 1 + m, 6) AS upper FROM (SELECT *, CASE WHEN l_quantity / 50 > 0.7 THEN 1.0::DOUBLE ELSE 0 END AS m FROM lineitem)")
register(
    "fn_8_recency_center", lambda s, d: E.recency_center(Z.clustered(candidates(s, d))),
    query("SELECT security_id, as_of, cluster, round(c, 6) AS center, round(c - 0.25 * atr, 6) AS lower, round(c + 0.25 * atr, 6) AS upper, round(redundancy, 6) AS redundancy FROM (SELECT security_id, as_of, atr, cluster, sum(level * w) / sum(w) AS c, 1 - count(DISTINCT source)::DOUBLE / count(*) AS redundancy FROM (SELECT *, exp(-coalesce(as_of - formed_at, 0) / 252.0) AS w FROM members) GROUP BY ALL)", "members"),
)
register(
    "win_17_approach", lambda s, d: E.approach(ranged(s, d)),
    query(f"SELECT security_id, session, round(velocity, 6) AS velocity, sum(dn) OVER (PARTITION BY security_id, run ORDER BY session ROWS UNBOUNDED PRECEDING)::BIGINT AS down_run, round(gap_into, 6) AS gap_into, round(vr, 6) AS volume_ratio, round(lag(fv) OVER {O}, 6) AS vwap_dist FROM (SELECT *, sum(1 - dn) OVER (PARTITION BY security_id ORDER BY session ROWS UNBOUNDED PRECEDING) AS run, (close - lag(close, 5) OVER {O}) / atr AS velocity, (open - pc) / atr AS gap_into, volume / avg(volume) OVER {win(20)} AS vr FROM (SELECT *, coalesce(close < pc, false)::INT AS dn, (close - sum((high + low + close) / 3 * volume) OVER v / sum(volume) OVER v) / atr AS fv FROM atrs WINDOW v AS (PARTITION BY security_id, date_trunc('week', session) ORDER BY session ROWS UNBOUNDED PRECEDING)))", "atrs"),
)
register("cmp_10_ablation", lambda s, d: E.ablation(LB.preds(s, d).select("as_of", F.col("p").alias("a"), F.lit(0.5).alias("b"), "y")), query("SELECT year(as_of) AS year, count(*) AS n, round(avg((0.5 - y) ** 2 - (p - y) ** 2), 6) AS delta FROM pr GROUP BY ROLLUP (year(as_of))", "zones", extra=LB.PRED))
register("cmp_11_weekly_scores", lambda s, d: E.weekly_scores(LB.preds(s, d)), query("SELECT as_of, least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM pr GROUP BY ALL", "zones", extra=LB.PRED))


SP = ("security_id", "session")
_atrs = lambda x, name: f"round(({x}) / nullif(atr, 0), 6) AS {name}"
register(
    "cmp_13_price", lambda s, d: P.price(ranged(s, d)),
    query("SELECT security_id, session, " + ", ".join([_atrs("high - low", "range_atr"), _atrs("close - open", "body_atr"), _atrs("high - greatest(open, close)", "upper_wick"), _atrs("least(open, close) - low", "lower_wick"), "round((close - low) / nullif(high - low, 0), 6) AS close_place", *(_atrs(f"close - avg(close) OVER {win(n)}", f"from_mean{n}") for n in (5, 20, 60))]) + " FROM atrs", "atrs"),
)
register(
    "cmp_13_volume", lambda s, d: P.volume(bars(s, d)),
    query("SELECT security_id, session, " + ", ".join(f"round(volume / nullif(avg(volume) OVER {win(n)}, 0), 6) AS volume_{n}" for n in (5, 20, 60)) + f", round(avg(volume) OVER {win(5)} / nullif(avg(volume) OVER {win(20)}, 0), 6) AS volume_gain, round(avg(close * volume) OVER {win(20)}, 6) AS adv20, sum((volume <= 0)::INT) OVER {win(20)}::BIGINT AS no_volume20 FROM bars", "bars"),
)
_EXT = [f"{a}_{b}" for b in ("day", "week", "month") for a in ("prior_high", "prior_low")] + ["high_252", "low_252", "high_ytd", "low_ytd"]
register(
    "cmp_13_structure", lambda s, d: P.structure(ranged(s, d)),
    query("SELECT a.security_id, a.session, " + ", ".join(_atrs(f"close - x.{c}", f"to_{c}") for c in _EXT) + f", a.k - arg_max(a.k, (a.high, a.k)) OVER w AS since_high_252, a.k - arg_max(a.k, (-a.low, a.k)) OVER w AS since_low_252 FROM atrs a JOIN ({SQ.ORACLE['win_9_prior_extremes']}) x USING (security_id, session) WINDOW w AS (PARTITION BY a.security_id ORDER BY a.session ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)", "atrs"),
)
_PER = ("week", "month", "quarter", "year")
register(
    "cmp_13_vwaps", lambda s, d: P.vwaps(ranged(s, d)),
    query("SELECT security_id, session, " + ", ".join(f"round(d_{p}, 6) AS to_vwap_{p}" for p in _PER) + ", " + ", ".join("(" + " + ".join(f"coalesce((round(abs(d_{p}), 9) <= {x})::INT, 0)" for p in _PER) + f")::BIGINT AS {n}" for n, x in (("vwaps_025", 0.25), ("vwaps_05", 0.5), ("vwaps_1", 1))) + " FROM (SELECT security_id, session, " + ", ".join(f"(close - sum((high + low + close) / 3 * volume) OVER w_{p} / sum(volume) OVER w_{p}) / nullif(atr, 0) AS d_{p}" for p in _PER) + " FROM atrs WINDOW " + ", ".join(f"w_{p} AS (PARTITION BY security_id, date_trunc('{p}', session) ORDER BY session ROWS UNBOUNDED PRECEDING)" for p in _PER) + ")", "atrs"),
)
_anchors = lambda s, d: ranged(s, d).where("tr > 2 * atr").select(*SP)
register(
    "agg_7_anchored_vwap", lambda s, d: P.anchored_vwap(bars(s, d), _anchors(s, d)),
    query("SELECT security_id, session, CASE WHEN since > 0 THEN round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 6) END AS vwap FROM (SELECT *, sum(coalesce(tr > 2 * atr, false)::INT) OVER (PARTITION BY security_id ORDER BY session ROWS UNBOUNDED PRECEDING) AS since FROM atrs) WINDOW w AS (PARTITION BY security_id, since ORDER BY session ROWS UNBOUNDED PRECEDING)", "atrs"),
)
register(
    "cmp_13_round_numbers", lambda s, d: P.round_numbers(zones_and_state(s, d)[2], candidates(s, d).where("family = 'B'")),
    query("SELECT z.security_id, z.as_of, z.zone_id, count(*) FILTER (level BETWEEN z.lower AND z.upper) AS rungs_in, round(min(abs(level - z.center) / nullif(z.atr, 0)), 6) AS nearest_rung, min(rank) FILTER (level BETWEEN z.lower AND z.upper)::BIGINT AS coarsest FROM zones z LEFT JOIN rungs r USING (security_id, as_of) GROUP BY ALL", "zones", "rungs"),
)


def _matrix(s, d):
    """All groups read the bars that ``ranged`` wrote, and each is written before they are joined: as one plan they are too much for a small driver."""
    r, _, found = zones_and_state(s, d)
    found = stage(found)
    geometry = found.select("security_id", "as_of", "zone_id", "side", "distance_atr", F.abs("distance_atr").alias("distance"), "width_atr", "n_sources", "n_families")
    index = S.market(r)
    by_zone = [P.round_numbers(found, candidates(s, d).where("family = 'B'")), X.zone_history(LB.labelled(s, d))]
    by_security = [
        r.select(*SP, "atr"), P.price(r), P.volume(r), P.structure(r), P.vwaps(r), S.volatility(r).select(*SP, *SQ._vols), S.momentum(r).select(*SP, "roc10", "stochastic14", "obv_slope", "drawdown", "run_length"), S.trend(r),
        S.bands(r).select(*SP, "sma20", "sma50", "sma200", "ema20"), S.factors(r, index), S.relative_strength(r, index), E.approach(r).select(*SP, "velocity", "down_run", "gap_into", "vwap_dist"), X.liquidity_tier(r).select(*SP, "tier"),
    ]
    by_session = [S.regimes(index), S.breadth(r).select("session", "breadth", "dispersion")]
    return E.feature_matrix(geometry, *([stage(g) for g in groups] for groups in (by_zone, by_security, by_session)))


def _matrix_sql():
    """The groups' own SQL, joined on their keys."""
    from . import features as FQ

    group = lambda name, of, columns: (of[name], columns)
    by_zone = [group("cmp_13_round_numbers", ORACLE, "rungs_in, nearest_rung, coarsest"), group("win_21_zone_history", FQ.ORACLE, "weeks, past_touch, past_hold")]
    by_security = [
        group("win_2_wilder_atr", core.ORACLE, "atr"), group("cmp_13_price", ORACLE, "* EXCLUDE (security_id, session)"), group("cmp_13_volume", ORACLE, "* EXCLUDE (security_id, session)"), group("cmp_13_structure", ORACLE, "* EXCLUDE (security_id, session)"), group("cmp_13_vwaps", ORACLE, "* EXCLUDE (security_id, session)"),
        group("win_13_volatility", SQ.ORACLE, "* EXCLUDE (security_id, session)"), group("win_16_momentum", SQ.ORACLE, "roc10, stochastic14, obv_slope, drawdown, run_length"), group("win_16_trend", SQ.ORACLE, "rsi14, macd_hist, adx14"), group("win_12_bands", SQ.ORACLE, "sma20, sma50, sma200, ema20"), group("win_19_factors", SQ.ORACLE, "* EXCLUDE (security_id, session)"),
        group("jon_17_relative_strength", SQ.ORACLE, "* EXCLUDE (security_id, session)"), group("win_17_approach", ORACLE, "velocity, down_run, gap_into, vwap_dist"), group("flt_10_liquidity_tier", FQ.ORACLE, "tier"),
    ]
    by_session = [group("win_18_regimes", SQ.ORACLE, "trend_z, vol_rank, regime"), group("agg_29_breadth", SQ.ORACLE, "breadth, dispersion")]
    sql = f"SELECT * FROM (SELECT security_id, as_of, zone_id, side, distance_atr, abs(distance_atr) AS distance, width_atr, n_sources, n_families FROM ({core.ORACLE['srt_1_nearest_zones']}))"
    for q, c in by_zone:
        sql += f" LEFT JOIN (SELECT security_id, as_of, zone_id, {c} FROM ({q})) USING (security_id, as_of, zone_id)"
    for q, c in by_security:
        sql += f" LEFT JOIN (SELECT security_id, session AS as_of, {c} FROM ({q})) USING (security_id, as_of)"
    for q, c in by_session:
        sql += f" LEFT JOIN (SELECT session AS as_of, {c} FROM ({q})) USING (as_of)"
    return sql


register("cmp_13_feature_matrix", _matrix, _matrix_sql())
