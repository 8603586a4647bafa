"""Queries of levels from shapes, fits and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits as T
from ..operators import indicators, levels, spine
from ..operators import series as S
from ..operators import shapes as H
from ..sources.derived import bars
from . import data as D
from . import labels as LB
from . import series as SQ
from .core import R, ranged, rounded, state_of, zones_and_state
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


O, win = SQ.O, SQ.win
CONS = {
    "tight": f"SELECT *, coalesce(count(*) OVER {win(10)} = 10 AND max(high) OVER {win(10)} - min(low) OVER {win(10)} <= 2 * atr, false) AS ok FROM atrs",
    "runs": f"SELECT security_id, run, min(k) - 9 AS first, max(k) AS k, max(session) AS session FROM (SELECT *, sum((NOT ok)::INT) OVER {SQ.RUN} AS run FROM tight) WHERE ok GROUP BY ALL",
    "cons": "SELECT r.security_id, r.k, r.session, min(b.session) AS start, count(*) AS n_sessions, min(b.low) AS low, max(b.high) AS high FROM runs r JOIN bars b ON b.security_id = r.security_id AND b.k BETWEEN r.first AND r.k GROUP BY ALL",
    "broken": "SELECT c.*, (SELECT min(b.session) FROM bars b WHERE b.security_id = c.security_id AND b.k > c.k AND (b.close < c.low OR b.close > c.high)) AS broken_at FROM cons c",
}
register(
    "win_11_consolidations", lambda s, d: H.consolidations(ranged(s, d)),
    query("SELECT c.security_id, c.start, c.session AS \"end\", c.n_sessions, round(c.low, 6) AS low, round(c.high, 6) AS high, broken_at, CASE WHEN b.close > c.high THEN 'support' WHEN b.close < c.low THEN 'resistance' END AS side, round(CASE WHEN b.close > c.high THEN c.high WHEN b.close < c.low THEN c.low END, 6) AS level FROM broken c LEFT JOIN bars b ON b.security_id = c.security_id AND b.session = c.broken_at", "atrs", extra=CONS),
)


def _state14(s, d):
    series = ranged(s, d)
    atr14 = indicators.smoothed(series.select("security_id", "session", "tr"), "tr", "atr14", 14).select("security_id", F.col("session").alias("as_of"), "atr14")
    return series, state_of(series).join(atr14, ["security_id", "as_of"])


def _density(s, d):
    series, state = _state14(s, d)
    found = levels.swings(series).where("k_atr = 0.5").select("security_id", "t", "side", "level", "seen_at")
    return H.density_levels(found, series.select("security_id", "k", "volume"), state)


DENSITY = {
    "w14": "SELECT security_id, 14::BIGINT AS k, sum(tr ORDER BY k) / 14 AS atr14 FROM ranged WHERE k <= 14 GROUP BY security_id HAVING count(*) = 14 UNION ALL SELECT r.security_id, r.k, (w.atr14 * 13 + r.tr) / 14 FROM w14 w JOIN ranged r ON r.security_id = w.security_id AND r.k = w.k + 1",
    "pts": "SELECT s.*, b.volume FROM swings s JOIN bars b ON b.security_id = s.security_id AND b.k = s.t WHERE s.k_atr = 0.5",
    "known": "SELECT t.security_id, t.as_of, t.spot, t.atr, w.atr14, p.level, p.volume FROM state t JOIN w14 w USING (security_id, k) JOIN pts p ON p.security_id = t.security_id AND p.seen_at <= t.k AND p.t > t.k - 504 WHERE t.atr IS NOT NULL",
    "dens": "SELECT security_id, as_of, spot, atr, j, sum(volume * exp(-(((spot + j * 0.05 * atr - level) / (0.5 * atr14)) ** 2) / 2)) AS f FROM known CROSS JOIN (SELECT unnest(range(-60, 61)) AS j) GROUP BY ALL",
    "share": "SELECT *, round(f / max(f) OVER (PARTITION BY security_id, as_of), 9) AS g FROM dens",
}
register(
    "fn_7_density_levels", _density,
    query("SELECT security_id, as_of, round(spot + j * 0.05 * atr, 6) AS level, round(g, 6) AS density FROM (SELECT *, lag(g) OVER w AS before, lead(g) OVER w AS after FROM share WINDOW w AS (PARTITION BY security_id, as_of ORDER BY j)) WHERE g > before AND g >= after", "swings", "state", extra=DENSITY),
)
LEGS = {
    "legs": "SELECT * FROM (SELECT security_id, t, seen_at, side, level, lag(side) OVER w AS p_side, lag(level) OVER w AS p_level, lag(t) OVER w AS p_t FROM swings WHERE k_atr = 2.0 WINDOW w AS (PARTITION BY security_id ORDER BY t, side)) WHERE p_side <> side",
    "dominant": "SELECT s.security_id, s.as_of, greatest(level, p_level) AS high, least(level, p_level) AS low FROM state s JOIN legs l ON l.security_id = s.security_id AND l.seen_at <= s.k AND l.p_t > s.k - 120 AND l.t > s.k - 240 QUALIFY row_number() OVER (PARTITION BY s.security_id, s.as_of ORDER BY round(abs(level - p_level), 9) DESC, t DESC, high DESC) = 1",
}
register(
    "fn_5_fibonacci", lambda s, d: (lambda x: H.retracements(levels.swings(x), state_of(x)))(ranged(s, d)),
    query(f"SELECT security_id, as_of, 'fib_' || r AS source, round(high - r * (high - low), 6) AS level FROM dominant CROSS JOIN (SELECT unnest({list(H.RATIOS)}::DOUBLE[]) AS r)", "swings", "state", extra=LEGS),
)


def _touches(s, d):
    series, _, found = zones_and_state(s, d)
    decile = S.volatility(bars(s, d)).where("sigma20 is not null").select("security_id", F.col("session").alias("as_of"), F.ntile(10).over(SQ.Window.partitionBy("session").orderBy(F.round("sigma20", 9), "security_id")).alias("decile"))
    labels = LB.L.barrier_labels(LB.zoned(s, d)[1], series).where("y_touch = 1").select("security_id", "as_of", "zone_id", "entry")
    return found.join(labels, ["security_id", "as_of", "zone_id"]).join(decile, ["security_id", "as_of"]).select("decile", F.round((F.col("entry") - F.col("center")) / F.col("atr"), 6).alias("offset"))


FIT = LB.ALL | {
    "dec": f"SELECT security_id, session AS as_of, ntile(10) OVER (PARTITION BY session ORDER BY round(sg, 9), security_id) AS decile FROM (SELECT *, stddev_samp(ret) OVER {win(20)} AS sg FROM (SELECT *, ln(close / lag(close) OVER {O}) AS ret FROM bars)) WHERE sg IS NOT NULL",
    "off": "SELECT decile, round((CASE l.side WHEN 'support' THEN entry_ ELSE -entry_ END - z.center) / z.atr, 6) AS e FROM lbl l JOIN zones z USING (security_id, as_of, zone_id) JOIN dec USING (security_id, as_of) WHERE y_touch = 1",
    "scored": f"SELECT decile, q, count(*) AS n, round(sum(ln(greatest(CASE WHEN abs(e) <= q / 2 THEN 0.8 / q ELSE 0 END + 0.2 * exp(-((e / (q / 2)) ** 2) / 2) / (q / 2 * 2.5066282746310002), 1e-300))), 6) AS ll FROM off CROSS JOIN (SELECT unnest({list(T.WIDTHS)}::DOUBLE[]) AS q) GROUP BY ALL",
}
register("fn_9_width_fit", lambda s, d: T.fit_width(_touches(s, d), ["decile"], "offset"), query("SELECT decile, n, q, ll AS log_likelihood FROM scored QUALIFY row_number() OVER (PARTITION BY decile ORDER BY ll DESC, q) = 1", "zones", extra=FIT))
register(
    "fn_10_traded_prices", lambda s, d: spine.traded_prices(bars(s, d), D.actions(s).where("kind = 'split'"), F.lit("1996-12-31").cast("date")),
    query("SELECT b.security_id, b.session, round(close * coalesce(exp(sum(ln(ratio))), 1), 6) AS raw_close, round(volume / coalesce(exp(sum(ln(ratio))), 1), 6) AS raw_volume FROM bars b LEFT JOIN (SELECT * FROM acts WHERE kind = 'split' AND ex_date <= DATE '1996-12-31') a ON a.security_id = b.security_id AND a.ex_date > b.session GROUP BY b.security_id, b.session, close, volume", "bars", extra={"acts": D.ACTIONS}),
)


def _deflated(s, d):
    """Every security and year is a trial."""
    one = bars(s, d).select("security_id", "session", F.year("session").alias("year"), (F.col("close") / F.lag("close").over(indicators.by_session()) - 1).alias("r"))
    return T.deflated_sharpe(T.moments(one, ["security_id"], "r"), T.moments(one, ["security_id", "year"], "r"))


register("agg_27_deflated_sharpe", _deflated)
FEATURES = ["distance", "width_atr", "n_sources", "n_families", "sigma20", "drawdown"]


def _features(s, d):
    """Zones with y_touch and the features of a model."""
    series, _, found = zones_and_state(s, d)
    y = LB.L.barrier_labels(LB.zoned(s, d)[1], series).select("security_id", "as_of", "zone_id", "y_touch")
    facts = S.momentum(S.volatility(bars(s, d))).select("security_id", F.col("session").alias("as_of"), "sigma20", "drawdown")
    rows = found.join(y, ["security_id", "as_of", "zone_id"], "left").join(facts, ["security_id", "as_of"], "left")
    return rows.select("security_id", "as_of", "zone_id", "y_touch", F.abs("distance_atr").alias("distance"), "width_atr", "n_sources", "n_families", "sigma20", "drawdown")


def _modelled(s, d):
    return T.outcome_models(_features(s, d), FEATURES, "y_touch", "year(as_of) < 1997").select("security_id", "as_of", "zone_id", "y_touch", "p_linear", "p_trees", "p")


register("cmp_8_models", _modelled)
