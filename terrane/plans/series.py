"""Queries over bar series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources.derived import bars
from .core import R, ranged, rounded
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


def win(n):
    return f"(PARTITION BY security_id ORDER BY session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


O = "(PARTITION BY security_id ORDER BY session)"  # noqa: E741
RUN = "(PARTITION BY security_id ORDER BY session ROWS UNBOUNDED PRECEDING)"
INDEX = "SELECT session, avg(close) AS close, 0 AS security_id FROM bars GROUP BY session"

for _p in ("week", "month", "quarter", "year"):
    register(f"agg_6_bars_by_{_p}", lambda s, d, p=_p: S.resample(bars(s, d), p), query(f"SELECT security_id, CAST(date_trunc('{_p}', session) AS DATE) AS period, round(arg_min(open, session), 6) AS open, max(high) AS high, min(low) AS low, round(arg_max(close, session), 6) AS close, sum(volume) AS volume, count(*) AS n FROM bars GROUP BY ALL", "bars"))
register("agg_7_vwap", lambda s, d: S.vwap(bars(s, d), "month").select("security_id", "session", "vwap"), query("SELECT security_id, session, round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 6) AS vwap FROM bars WINDOW w AS (PARTITION BY security_id, date_trunc('month', session) ORDER BY session ROWS UNBOUNDED PRECEDING)", "bars"))
_ext = ["prior_high_day", "prior_low_day", "prior_high_week", "prior_low_week", "prior_high_month", "prior_low_month", "prior_high_quarter", "prior_low_quarter", "high_252", "low_252", "high_ytd", "low_ytd"]
register(
    "win_9_prior_extremes", lambda s, d: S.prior_extremes(bars(s, d)).select("security_id", "session", *_ext),
    query("SELECT b.security_id, b.session, lag(b.high) OVER o AS prior_high_day, lag(b.low) OVER o AS prior_low_day, " + ", ".join(f"{p[0]}.hi AS prior_high_{p}, {p[0]}.lo AS prior_low_{p}" for p in ("week", "month", "quarter")) + ", max(b.high) OVER (PARTITION BY b.security_id ORDER BY b.session ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS high_252, min(b.low) OVER (PARTITION BY b.security_id ORDER BY b.session ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS low_252, max(b.high) OVER y AS high_ytd, min(b.low) OVER y AS low_ytd FROM bars b " + " ".join(f"JOIN p_{p} {p[0]} ON {p[0]}.security_id = b.security_id AND {p[0]}.period = date_trunc('{p}', b.session)" for p in ("week", "month", "quarter")) + " WINDOW o AS (PARTITION BY b.security_id ORDER BY b.session), y AS (PARTITION BY b.security_id, year(b.session) ORDER BY b.session ROWS UNBOUNDED PRECEDING)", "bars", extra={f"p_{p}": f"SELECT *, lag(h) OVER (PARTITION BY security_id ORDER BY period) AS hi, lag(l) OVER (PARTITION BY security_id ORDER BY period) AS lo FROM (SELECT security_id, date_trunc('{p}', session) AS period, max(high) AS h, min(low) AS l FROM bars GROUP BY ALL)" for p in ("week", "month", "quarter")}),
)
register("win_10_gaps", lambda s, d: S.gaps(bars(s, d)), query("SELECT g.security_id, g.session, g.kind, round(g.edge, 6) AS edge, min(b.session) AS filled_at FROM (SELECT security_id, session, CASE WHEN low > ph THEN 'up' ELSE 'down' END AS kind, CASE WHEN low > ph THEN ph ELSE pl END AS edge FROM (SELECT *, lag(high) OVER o AS ph, lag(low) OVER o AS pl FROM bars WINDOW o AS (PARTITION BY security_id ORDER BY session)) WHERE low > ph OR high < pl) g LEFT JOIN bars b ON b.security_id = g.security_id AND b.session > g.session AND CASE WHEN g.kind = 'up' THEN b.low <= g.edge ELSE b.high >= g.edge END GROUP BY ALL", "bars"))
EMA20 = {"ema": "SELECT security_id, k, session, close AS e FROM bars WHERE k = 1 UNION ALL SELECT b.security_id, b.k, b.session, e.e + (b.close - e.e) * (2 / 21::DOUBLE) FROM ema e JOIN bars b ON b.security_id = e.security_id AND b.k = e.k + 1"}
register(
    "win_12_bands", lambda s, d: S.bands(ranged(s, d)).select("security_id", "session", "sma20", "sma50", "sma200", "boll_up", "boll_low", "ema20", "keltner_up", "keltner_low"),
    query("SELECT b.security_id, b.session, " + ", ".join(f"CASE WHEN b.k >= {n} THEN round(avg(close) OVER w{n}, 6) END AS sma{n}" for n in (20, 50, 200)) + ", CASE WHEN b.k >= 20 THEN round(avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20, 6) END AS boll_up, CASE WHEN b.k >= 20 THEN round(avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20, 6) END AS boll_low, round(e, 6) AS ema20, round(e + 1.5 * atr, 6) AS keltner_up, round(e - 1.5 * atr, 6) AS keltner_low FROM atrs b JOIN ema USING (security_id, k) WINDOW " + ", ".join(f"w{n} AS (PARTITION BY b.security_id ORDER BY b.session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (20, 50, 200)), "atrs", extra=EMA20),
)
_ln2 = 0.6931471805599453
_rets = (1, 2, 5, 10, 20, 60)
_vols = [*(f"ret_{n}" for n in _rets), "sigma5", "sigma20", "sigma60", "parkinson20", "garman_klass20", "rogers_satchell20", "vol_pctile"]
VOL = {
    "rets": "SELECT *, " + ", ".join(f"ln(close / lag(close, {n}) OVER {O}) AS ret_{n}" for n in _rets) + f", ln(high / low) ** 2 / {4 * _ln2} AS pk, 0.5 * ln(high / low) ** 2 - {2 * _ln2 - 1} * ln(close / open) ** 2 AS gk, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars",
    "vols": "SELECT *, " + ", ".join(f"stddev_samp(ret_1) OVER {win(n)} AS sigma{n}" for n in (5, 20, 60)) + ", " + ", ".join(f"sqrt(greatest(avg({c}) OVER {win(20)}, 0)) AS {n}20" for c, n in (("pk", "parkinson"), ("gk", "garman_klass"), ("rs", "rogers_satchell"))) + " FROM rets",
    "ranks": f"SELECT *, list(round(sigma20, 12)) OVER {win(756)} AS past FROM vols",
}
register(
    "win_13_volatility", lambda s, d: S.volatility(bars(s, d)).select("security_id", "session", *_vols),
    query(f"SELECT security_id, session, {R(*_vols[:-1])}, CASE WHEN sigma20 IS NOT NULL THEN round(len(list_filter(past, lambda x: x <= round(sigma20, 12)))::DOUBLE / len(list_filter(past, lambda x: x IS NOT NULL)), 6) END AS vol_pctile FROM ranks", "bars", extra=VOL),
)
register(
    "win_16_momentum", lambda s, d: S.momentum(bars(s, d)).select("security_id", "session", "roc10", "stochastic14", "obv", "obv_slope", "drawdown", "run_length"),
    query(f"SELECT security_id, session, round(roc10, 6) AS roc10, round(stochastic14, 6) AS stochastic14, round(obv, 6) AS obv, round((obv - lag(obv, 20) OVER {O}) / nullif(sum(volume) OVER {win(20)}, 0), 6) AS obv_slope, round(drawdown, 6) AS drawdown, run_length FROM (SELECT *, close / lag(close, 10) OVER {O} - 1 AS roc10, (close - min(low) OVER {win(14)}) / nullif(max(high) OVER {win(14)} - min(low) OVER {win(14)}, 0) AS stochastic14, sum(sg * volume) OVER {RUN} AS obv, close / max(close) OVER {RUN} - 1 AS drawdown, row_number() OVER (PARTITION BY security_id, run_id ORDER BY session) AS run_length FROM (SELECT *, sum(CASE WHEN sg = psg THEN 0 ELSE 1 END) OVER {RUN} AS run_id FROM (SELECT *, lag(sg) OVER {O} AS psg FROM (SELECT *, coalesce(sign(close - lag(close) OVER {O}), 0) AS sg FROM bars))))", "bars"),
)
# The means of gains, losses, ranges and directed moves: sums of fourteenths up to session 15, Wilder's rule after.
_mean = lambda m, x: f"CASE WHEN i.k <= 15 THEN t.{m} + i.{x} / 14 ELSE (13 * t.{m} + i.{x}) / 14 END AS {m}"
TREND = {
    "moves": "SELECT security_id, session, k, close, greatest(close - pc, 0) AS g, greatest(pc - close, 0) AS l, tr, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS p, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS m FROM (SELECT *, high - lag(high) OVER o AS u, lag(low) OVER o - low AS d FROM ranged WINDOW o AS (PARTITION BY security_id ORDER BY session))",
    "means": f"SELECT security_id, session, k, close AS fast, close AS slow, 0.0::DOUBLE AS ag, 0.0::DOUBLE AS al, 0.0::DOUBLE AS ap, 0.0::DOUBLE AS am FROM moves WHERE k = 1 UNION ALL SELECT i.security_id, i.session, i.k, t.fast + (i.close - t.fast) * 2 / 13, t.slow + (i.close - t.slow) * 2 / 27, {', '.join(_mean(m, x) for m, x in (('ag', 'g'), ('al', 'l'), ('ap', 'p'), ('am', 'm')))} FROM means t JOIN moves i ON i.security_id = t.security_id AND i.k = t.k + 1",
    "dxs": "SELECT *, fast - slow AS macd, CASE WHEN k >= 15 THEN CASE WHEN ap + am > 0 THEN 100 * abs(ap - am) / (ap + am) ELSE 0 END END AS dx FROM means",
    "signals": "SELECT security_id, session, k, ag, al, macd, 0.0::DOUBLE AS signal, 0.0::DOUBLE AS adx FROM dxs WHERE k = 1 UNION ALL SELECT d.security_id, d.session, d.k, d.ag, d.al, d.macd, s.signal + (d.macd - s.signal) * 2 / 10, CASE WHEN d.k < 15 THEN 0 WHEN d.k <= 28 THEN s.adx + d.dx / 14 ELSE (13 * s.adx + d.dx) / 14 END FROM signals s JOIN dxs d ON d.security_id = s.security_id AND d.k = s.k + 1",
}
register(
    "win_16_trend", lambda s, d: S.trend(bars(s, d)),
    query("SELECT security_id, session, CASE WHEN k >= 15 AND ag + al > 0 THEN round(100 * ag / (ag + al), 6) END AS rsi14, round(macd - signal, 6) AS macd_hist, CASE WHEN k >= 28 THEN round(adx, 6) END AS adx14 FROM signals", "ranged", extra=TREND),
)
register(
    "win_18_regimes", lambda s, d: S.regimes(S.market(bars(s, d))),
    query(f"SELECT session, round(trend_z, 6) AS trend_z, round(vol_rank, 6) AS vol_rank, CASE WHEN vol_rank >= 0.9 THEN 'high_vol' WHEN trend_z > 1 THEN 'bull' WHEN trend_z < -1 THEN 'bear' WHEN abs(trend_z) <= 0.25 THEN 'range' WHEN trend_z > 0 THEN 'weak_bull' WHEN trend_z IS NOT NULL THEN 'weak_bear' END AS regime FROM (SELECT session, (close / sma - 1) / nullif(sigma * sqrt(20.0), 0) AS trend_z, CASE WHEN sigma IS NOT NULL THEN len(list_filter(past, lambda x: x <= sigma))::DOUBLE / len(list_filter(past, lambda x: x IS NOT NULL)) WHEN len(list_filter(past, lambda x: x IS NOT NULL)) > 0 THEN 0.0 END AS vol_rank FROM (SELECT session, close, sigma, CASE WHEN count(*) OVER {win(200)} = 200 THEN avg(close) OVER {win(200)} END AS sma, list(sigma) OVER {win(756)} AS past FROM (SELECT *, round(stddev_samp(ret) OVER {win(20)}, 12) AS sigma FROM (SELECT *, ln(close / lag(close) OVER {O}) AS ret FROM idx))))", "bars", extra={"idx": INDEX}),
)
_days = (1, 5, 20, 60, 120)
register("jon_17_relative_strength", lambda s, d: S.relative_strength(bars(s, d), S.market(bars(s, d))), query("SELECT b.security_id, b.session, " + ", ".join(f"round(b.r{n} - i.r{n}, 6) AS rs_{n}" for n in _days) + " FROM (SELECT *, " + ", ".join(f"close / lag(close, {n}) OVER {O} - 1 AS r{n}" for n in _days) + " FROM bars) b JOIN (SELECT *, " + ", ".join(f"close / lag(close, {n}) OVER {O} - 1 AS r{n}" for n in _days) + " FROM idx) i USING (session)", "bars", extra={"idx": INDEX}))
_rank = lambda c: f"round(percent_rank() OVER (PARTITION BY session ORDER BY {c} NULLS FIRST), 6)"
register(
    "win_19_factors", lambda s, d: S.factors(bars(s, d), S.market(bars(s, d))),
    query(f"SELECT security_id, session, round(beta, 6) AS beta, round(corr, 6) AS corr, round(idio_vol, 6) AS idio_vol, CASE WHEN mom IS NOT NULL THEN {_rank('mom')} END AS mom_rank, {_rank('calm')} AS low_vol_rank, {_rank('adv')} AS liquidity_rank FROM (SELECT *, covar_pop(x, y) OVER {win(60)} / nullif(var_pop(y) OVER {win(60)}, 0) AS beta, CASE WHEN isnan(corr(x, y) OVER {win(60)}) THEN NULL ELSE corr(x, y) OVER {win(60)} END AS corr, sqrt(greatest(var_pop(x) OVER {win(60)} - (covar_pop(x, y) OVER {win(60)}) ** 2 / nullif(var_pop(y) OVER {win(60)}, 0), 0)) AS idio_vol, -round(stddev_pop(x) OVER {win(60)}, 9) AS calm FROM (SELECT b.security_id, b.session, x, mom, adv, y FROM (SELECT *, ln(close / lag(close) OVER {O}) AS x, ln(close / lag(close, 20) OVER {O}) AS mom, round(avg(close * volume) OVER {win(20)}, 6) AS adv FROM bars) b JOIN (SELECT *, ln(close / lag(close) OVER {O}) AS y FROM idx) i USING (session) WHERE x IS NOT NULL AND y IS NOT NULL))", "bars", extra={"idx": INDEX}),
)
register("agg_29_breadth", lambda s, d: S.breadth(bars(s, d)), query(f"SELECT session, round(avg(above), 6) AS breadth, round(stddev_pop(ret), 6) AS dispersion, count(*) AS n FROM (SELECT session, CASE WHEN count(*) OVER {win(50)} = 50 THEN (close > round(avg(close) OVER {win(50)}, 9))::INT::DOUBLE END AS above, ln(close / lag(close) OVER {O}) AS ret FROM bars) GROUP BY session", "bars"))
register(
    "fn_5_pivots", lambda s, d: S.pivots(bars(s, d)),
    query("SELECT security_id, session, unnest(['p','r1','s1','r2','s2','r3','s3','h3','h4','l3','l4']) AS source, round(unnest([p, 2*p-low, 2*p-high, p+(high-low), p-(high-low), high+2*(p-low), low-2*(high-p), close+(high-low)*1.1/4, close+(high-low)*1.1/2, close-(high-low)*1.1/4, close-(high-low)*1.1/2]), 6) AS level FROM (SELECT *, (high + low + close) / 3 AS p FROM bars)", "bars"),
)
register("fn_6_volatility_envelope", lambda s, d: S.volatility(bars(s, d)).select("security_id", "session", *(S.envelope(F.col("close"), F.col("sigma20"), k).alias(n) for n, k in (("up1", 1.0), ("low1", -1.0), ("up2", 2.0), ("low2", -2.0)))), query(f"SELECT security_id, session, " + ", ".join(f"round(close * exp({k} * sg * sqrt(5.0)), 6) AS {n}" for n, k in (("up1", 1), ("low1", -1), ("up2", 2), ("low2", -2))) + f" FROM (SELECT *, stddev_samp(ret) OVER {win(20)} AS sg FROM (SELECT *, ln(close / lag(close) OVER {O}) AS ret FROM bars))", "bars"))
register("fn_20_spread_proxy", lambda s, d: S.trading_spread(bars(s, d)), query("SELECT security_id, session, round(greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0), 6) AS spread FROM (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0)) - sqrt(gamma / (3 - 2 * sqrt(2.0))) AS a FROM (SELECT *, ln(high / low) ** 2 + ln(h1 / l1) ** 2 AS beta, ln(greatest(high, h1) / least(low, l1)) ** 2 AS gamma FROM (SELECT *, lag(high) OVER o AS h1, lag(low) OVER o AS l1 FROM bars WINDOW o AS (PARTITION BY security_id ORDER BY session)))) WHERE a IS NOT NULL", "bars"))
register(
    "agg_26_return_metrics", lambda s, d: S.drawdown_metrics(bars(s, d)),
    query(f"SELECT security_id, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 6) AS sharpe, round(avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * sqrt(252.0), 6) AS sortino, round(min(dd), 6) AS max_drawdown, round(avg((ret > 0)::INT), 6) AS hit_rate, round(sum(greatest(ret, 0)) / abs(sum(least(ret, 0))), 6) AS profit_factor FROM (SELECT security_id, close / lag(close) OVER {O} - 1 AS ret, close / max(close) OVER {RUN} - 1 AS dd FROM bars) GROUP BY security_id", "bars").replace("avg(least(ret, 0) ** 2)", "avg(CASE WHEN ret IS NOT NULL THEN least(ret, 0) ** 2 END)").replace("sum(greatest(ret, 0))", "sum(CASE WHEN ret IS NOT NULL THEN greatest(ret, 0) END)").replace("sum(least(ret, 0))", "sum(CASE WHEN ret IS NOT NULL THEN least(ret, 0) END)"),
)
register("fn_13_date_keys", lambda s, d: bars(s, d).select("session").distinct().select("session", F.extract(F.lit("YEAROFWEEK"), "session").cast("long").alias("iso_year"), F.weekofyear("session").alias("iso_week"), F.trunc("session", "month").alias("month"), F.quarter("session").alias("quarter")), query("SELECT DISTINCT session, isoyear(session) AS iso_year, weekofyear(session) AS iso_week, CAST(date_trunc('month', session) AS DATE) AS month, quarter(session) AS quarter FROM bars", "bars"))
register("fn_18_feature_pairs", lambda s, d: S.bands(ranged(s, d)).select("security_id", "session", *(x for c in ("sma20", "sma50") for x in (F.col(c), F.col(c).isNotNull().cast("long").alias(f"{c}_available")))), query(f"SELECT security_id, session, CASE WHEN k >= 20 THEN round(avg(close) OVER {win(20)}, 6) END AS sma20, (k >= 20)::INT AS sma20_available, CASE WHEN k >= 50 THEN round(avg(close) OVER {win(50)}, 6) END AS sma50, (k >= 50)::INT AS sma50_available FROM bars", "bars"))
register("fn_19_price_limits", lambda s, d: bars(s, d).withColumn("last", F.lag("close").over(Window.partitionBy("security_id").orderBy("session"))).select("security_id", "session", *(F.least(F.greatest(F.col(c), F.coalesce(F.col("last") * 0.999, F.col(c))), F.coalesce(F.col("last") * 1.001, F.col(c))).alias(c) for c in ("high", "low", "close"))), query("SELECT security_id, session, " + ", ".join(f"round(least(greatest({c}, coalesce(pc * 0.999, {c})), coalesce(pc * 1.001, {c})), 6) AS {c}" for c in ("high", "low", "close")) + " FROM ranged", "ranged"))
register("srt_4_cross_rank", lambda s, d: S.volatility(bars(s, d)).where("ret_20 is not null").select("security_id", "session", F.rank().over(Window.partitionBy("session").orderBy(F.desc(F.round("ret_20", 9)))).alias("rank")), query(f"SELECT security_id, session, rank() OVER (PARTITION BY session ORDER BY round(r, 9) DESC) AS rank FROM (SELECT *, ln(close / lag(close, 20) OVER {O}) AS r FROM bars) WHERE r IS NOT NULL", "bars"))
register("win_20_vol_decile", lambda s, d: S.volatility(bars(s, d)).where("sigma20 is not null").select("security_id", "session", F.ntile(10).over(Window.partitionBy("session").orderBy(F.round("sigma20", 9), "security_id")).alias("decile")), query(f"SELECT security_id, session, ntile(10) OVER (PARTITION BY session ORDER BY round(sg, 9), security_id) AS decile FROM (SELECT *, stddev_samp(ret) OVER {win(20)} AS sg FROM (SELECT *, ln(close / lag(close) OVER {O}) AS ret FROM bars)) WHERE sg IS NOT NULL", "bars"))
