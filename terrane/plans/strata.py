"""Queries of evaluation by market, regime and decile; lift over placebos; naive levels; labelled sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import labels as L
from ..operators import series as S
from ..operators import strata as T
from . import histories as HQ
from . import labels as LB
from .core import ranged, rounded, zones_and_state
from .features import ORACLE as FEATURES
from .sql import _mixed, query
from .trades import _markets

QUERIES, ORACLE = {}, {}
CUTS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
STRATA = ["market", "regime", "decile"]


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


def far(rows):
    return T.deciles(rows.withColumn("far", F.round(F.abs("distance_atr"), 9)), "far")


def stratified(s, d):
    """Forecasts that nearer zones are touched more, with what came of it, by market, regime and decile of distance."""
    rows = far(LB.labelled_by_regime(s, d).join(_markets(s, d), "security_id"))
    return rows.select(*L.KEY, *STRATA, F.exp(-F.abs("distance_atr") / 2).alias("p"), F.col("y_touch").cast("double").alias("y"))


PRED = LB.ALL | LB.REGIMES | {
    "st": "SELECT l.*, reg.regime, CASE WHEN security_id = 2 THEN 'HK' ELSE 'US' END AS market, round(abs(distance_atr), 9) AS far FROM lbl l JOIN reg USING (as_of)",
    "dq": f"SELECT quantile_cont(far, {CUTS}) AS e FROM st",
    "pr": "SELECT security_id, as_of, zone_id, market, regime, len(list_filter(e, lambda x: x < far)) AS decile, exp(-abs(distance_atr) / 2) AS p, y_touch::DOUBLE AS y FROM st CROSS JOIN dq",
}
_sets = "((market, regime, decile, {0}), (market, regime, {0}), (market, {0}), ({0}))"
_g = "concat_ws('|', coarse, coalesce(market, ''), coalesce(regime, ''), coalesce(decile::VARCHAR, ''))"


def newton(before: str) -> str:
    """One round of Newton's method for the two parameters of each group g of ``cx`` (x, n, s)."""
    return f"""SELECT g, a + (hxx * g0 - hx * gx) / d AS a, b + (h * gx - hx * g0) / d AS b, abs((hxx * g0 - hx * gx) / d) + abs((h * gx - hx * g0) / d) AS moved FROM (
      SELECT *, CASE WHEN h * hxx - hx * hx > 1e-9 * h * hxx THEN h * hxx - hx * hx END AS d FROM (
        SELECT g, any_value(a) AS a, any_value(b) AS b, sum(s - n * mu) AS g0, sum((s - n * mu) * x) AS gx, sum(n * mu * (1 - mu)) AS h, sum(n * mu * (1 - mu) * x) AS hx, sum(n * mu * (1 - mu) * x * x) AS hxx FROM (
          SELECT cx.*, a, b, 1 / (1 + exp(-greatest(-{T.FAR}::DOUBLE, least({T.FAR}::DOUBLE, a + b * x)))) AS mu FROM cx JOIN {before} USING (g)) GROUP BY g))"""


CALIBRATED = PRED | {
    "pe": f"SELECT quantile_cont(p, {CUTS}) AS e FROM pr",
    "pb": "SELECT market, regime, decile, p, y, len(list_filter(e, lambda x: x < p)) AS bin, least(greatest(round(p, 3), 0.001), 0.999)::DOUBLE AS p3, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM pr CROSS JOIN pe",
    "cc": f"""SELECT market, regime, decile, bin, p3, grouping(market, regime, decile) AS coarse, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) ** 2) AS b, sum(-(y * ln(c) + (1 - y) * ln(1 - c))) AS ll
      FROM pb GROUP BY GROUPING SETS {_sets.format('bin, p3')}""",
    "cx": f"SELECT {_g} AS g, ln(p3 / (1 - p3)) AS x, sum(n)::DOUBLE AS n, sum(sy) AS s FROM cc GROUP BY {_g}, p3",
    "n0": "SELECT DISTINCT g, 0::DOUBLE AS a, 1::DOUBLE AS b FROM cx",
    **{f"n{i}": newton(f"n{i - 1}") for i in range(1, T.ROUNDS + 1)},
    "cb": f"SELECT market, regime, decile, coarse, {_g} AS g, bin, sum(n) AS n, sum(sp) AS sp, sum(sy) AS sy, sum(b) AS b, sum(ll) AS ll FROM cc GROUP BY ALL",
}
register(
    "agg_14_calibration_strata", lambda s, d: T.calibration_by(stratified(s, d), "p", "y", STRATA),
    query(
        f"""SELECT market, regime, decile, coarse, n, brier, log_loss, ece, CASE WHEN moved <= {T.STILL} THEN round(f.a, 6) END AS intercept, CASE WHEN moved <= {T.STILL} THEN round(f.b, 6) END AS slope FROM (
          SELECT market, regime, decile, coarse, g, sum(n)::BIGINT AS n, round(sum(b) / sum(n), 6) AS brier, round(sum(ll) / sum(n), 6) AS log_loss, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM cb GROUP BY ALL)
        LEFT JOIN n{T.ROUNDS} f USING (g)""", "zones", extra=CALIBRATED, once=("cc", "cx", *(f"n{i}" for i in range(T.ROUNDS + 1))),
    ),
)

_same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in ("level", *STRATA))
_part = "level, market, regime, decile"
ISO = PRED | {
    "ip": "SELECT market, regime, decile, round(p, 3) AS p, y FROM pr",
    "ic": f"SELECT market, regime, decile, p, CASE grouping(market, regime, decile) WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS level, count(*) AS n, sum(y) AS s FROM ip GROUP BY GROUPING SETS {_sets.format('p')}",
    "ie": f"SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM (SELECT *, sum(n) OVER (PARTITION BY {_part}) AS total FROM ic) WHERE total >= 500 OR level = 0 WINDOW w AS (PARTITION BY {_part} ORDER BY p)",
    "im": f"SELECT a.level, a.market, a.regime, a.decile, a.i AS j, b.i AS k, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n) AS m FROM ie a JOIN ie b ON {_same('a', 'b')} AND b.i >= a.i",
    "il": f"SELECT *, min(m) OVER (PARTITION BY {_part}, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS least FROM im",
    "fit": f"SELECT e.level, e.market, e.regime, e.decile, e.p, max(l.least) AS fitted FROM ie e JOIN il l ON {_same('e', 'l')} AND l.k = e.i GROUP BY ALL",
}
register(
    "cmp_9_isotonic_strata", lambda s, d: X.isotonic(stratified(s, d), STRATA, "p", "y"),
    query(
        """SELECT c.market, c.regime, c.decile, round(c.p, 6) AS p, CASE WHEN f3.p IS NOT NULL THEN 3 WHEN f2.p IS NOT NULL THEN 2 WHEN f1.p IS NOT NULL THEN 1 ELSE 0 END AS level,
        round(coalesce(f3.fitted, f2.fitted, f1.fitted, f0.fitted), 6) AS fitted FROM ic c LEFT JOIN fit f3 ON f3.level = 3 AND f3.market = c.market AND f3.regime = c.regime AND f3.decile = c.decile AND f3.p = c.p
        LEFT JOIN fit f2 ON f2.level = 2 AND f2.market = c.market AND f2.regime = c.regime AND f2.p = c.p LEFT JOIN fit f1 ON f1.level = 1 AND f1.market = c.market AND f1.p = c.p
        LEFT JOIN fit f0 ON f0.level = 0 AND f0.p = c.p WHERE c.level = 3""", "zones", extra=ISO, once=("pr", "ic", "ie", "fit"),
    ),
)

CELL = ["family", "bucket", "regime"]
_cell = ", ".join(CELL)
_rate = lambda kind: f"sum(w * s) FILTER (kind = '{kind}') / nullif(sum(w * n) FILTER (kind = '{kind}'), 0)"
LIFT = HQ.BY_FAMILY | {
    "sm": " UNION ALL ".join(f"SELECT {_cell}, '{k}' AS kind, security_id, as_of, sum(y_hold)::DOUBLE AS s, count(*)::DOUBLE AS n, 1::DOUBLE AS w FROM {x} WHERE y_hold IS NOT NULL GROUP BY ALL" for k, x in (("r", "fl"), ("p", "fp"))),
    "wt": f"""SELECT security_id, as_of, b, ({LB._weight})::DOUBLE AS w FROM (SELECT *, {_mixed(f"xor({LB._start}, {_mixed('b')})")} AS x
      FROM (SELECT DISTINCT security_id, as_of FROM sm) CROSS JOIN (SELECT unnest(range(1, 2001)) AS b))""",
    "dr": f"SELECT {_cell}, b, {_rate('r')} - {_rate('p')} AS l FROM (SELECT sm.* EXCLUDE w, b, wt.w FROM sm JOIN wt USING (security_id, as_of)) GROUP BY ALL",
    "sp": f"SELECT {_cell}, quantile_cont(l, 0.025) AS low, quantile_cont(l, 0.975) AS high, least(1, 2 * (1 + least(count(*) FILTER (l <= 0), count(*) FILTER (l >= 0)))::DOUBLE / (1 + count(*))) AS p FROM dr WHERE l IS NOT NULL GROUP BY ALL",
    "ce": f"SELECT {_cell}, sum(n) FILTER (kind = 'r')::BIGINT AS n_real, sum(n) FILTER (kind = 'p')::BIGINT AS n_placebo, {_rate('r')} - {_rate('p')} AS lift FROM sm GROUP BY ALL",
    "bh": f"SELECT *, row_number() OVER (PARTITION BY regime ORDER BY p, family || '|' || bucket) AS rank, count(*) OVER (PARTITION BY regime) AS m FROM ce JOIN sp USING ({_cell}) WHERE lift IS NOT NULL",
}
register(
    "agg_17_lift", lambda s, d: T.lift(HQ._by_family(s, d), HQ._placebos_by_family(s, d), "y_hold", CELL, ["security_id", "as_of"], "regime"),
    query(
        f"""SELECT {_cell}, n_real, n_placebo, round(lift, 6) AS lift, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p,
        round(least(min(p * m / rank) OVER (PARTITION BY regime ORDER BY rank DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS q FROM bh""", "zones", extra=LIFT, once=("fl", "fp", "sm", "wt"),
    ),
)


def naive(s, d):
    """Bars and naive levels of each as_of."""
    series, state, _ = zones_and_state(s, d)
    week = S.resample(series, "week").select("security_id", F.col("period").alias("week"), "high", "low", "close")
    bands = S.bands(series).select("security_id", F.col("session").alias("as_of"), "boll_up", "boll_low")
    dates = state.select("security_id", "as_of", F.trunc("as_of", "week").alias("week"))
    facts = dates.join(week, ["security_id", "week"]).join(bands, ["security_id", "as_of"]).drop("week")
    return series, T.naive_levels(state, facts)


def _naive_rates(s, d):
    series, found = naive(s, d)
    rows = L.barrier_labels(found, series).join(found.select(*L.KEY, "distance_atr"), list(L.KEY))
    return T.base_rates(far(rows).withColumnRenamed("zone_id", "source"), ["source", "decile"])


_levels = {
    "week_high": "high", "week_low": "low", "atr_up1": "spot + atr", "atr_up2": "spot + 2 * atr", "atr_low1": "spot - atr", "atr_low2": "spot - 2 * atr", "pivot": "pp", "pivot_r1": "2 * pp - low", "pivot_s1": "2 * pp - high",
    "pivot_r2": "pp + (high - low)", "pivot_s2": "pp - (high - low)", "boll_up": "boll_up", "boll_low": "boll_low",
}
NAIVE = {
    "wk": "SELECT security_id, date_trunc('week', session) AS week, max(high) AS high, min(low) AS low, arg_max(close, session) AS close FROM bars GROUP BY ALL",
    "bo": """SELECT security_id, session AS as_of, CASE WHEN k >= 20 THEN avg(close) OVER w + 2 * stddev_pop(close) OVER w END AS boll_up, CASE WHEN k >= 20 THEN avg(close) OVER w - 2 * stddev_pop(close) OVER w END AS boll_low
      FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "nl": f"""SELECT security_id, as_of, k, spot, atr, unnest([{', '.join(f"'{n}'" for n in _levels)}]) AS zone_id, unnest([{', '.join(_levels.values())}]) AS center FROM (
      SELECT s.security_id, s.as_of, s.k, s.spot, s.atr, high, low, (high + low + close) / 3 AS pp, boll_up, boll_low FROM state s JOIN wk ON wk.security_id = s.security_id AND wk.week = date_trunc('week', s.as_of)
      JOIN bo ON bo.security_id = s.security_id AND bo.as_of = s.as_of WHERE atr IS NOT NULL)""",
    "nz": """SELECT *, center - 0.1 * atr AS lower, center + 0.1 * atr AS upper, CASE WHEN center < spot THEN 'support' ELSE 'resistance' END AS side, (center - spot) / atr AS distance_atr, 1 AS n_families
      FROM nl WHERE center > 0 AND NOT (spot BETWEEN center - 0.1 * atr AND center + 0.1 * atr)""",
}
NAIVE_LABELS = NAIVE | LB.label_ctes("nz") | {
    "nf": "SELECT zone_id AS source, y_touch, y_hold, round(abs(distance_atr), 9) AS far FROM lbl",
    "nq": f"SELECT quantile_cont(far, {CUTS}) AS e FROM nf",
}
register(
    "agg_13_naive_zones", lambda s, d: naive(s, d)[1].select(*L.KEY, "side", "lower", "upper", "distance_atr"),
    query("SELECT security_id, as_of, zone_id, side, round(lower, 6) AS lower, round(upper, 6) AS upper, round(distance_atr, 6) AS distance_atr FROM nz", "state", extra=NAIVE),
)
register(
    "agg_13_naive_levels", _naive_rates,
    query("""SELECT source, len(list_filter(e, lambda x: x < far)) AS decile, count(*) AS n, round(avg(y_touch), 6) AS touch_rate, sum(y_touch)::BIGINT AS touched, round(avg(y_hold), 6) AS hold_rate
      FROM nf CROSS JOIN nq GROUP BY ALL""", "state", extra=NAIVE_LABELS),
)


def _sequences(s, d):
    series, state, found = zones_and_state(s, d)
    labels = L.barrier_labels(found.join(state.select("security_id", "as_of", "k"), ["security_id", "as_of"]), series)
    rows = X.labelled_sequences(X.sequences(ranged(s, d)), found, labels, LB.regimes(s, d))
    ends = [F.element_at("steps", i)["close"].alias(n) for i, n in ((1, "first_close"), (-1, "last_close"))]
    return rows.select(*L.KEY, *ends, "side", "regime", "distance_atr", "width_atr", "n_sources", "n_families", "y_touch", "y_hold", "t_touch", "label_gap")


register(
    "cmp_16_labelled_sequences", _sequences,
    query(
        f"""SELECT z.security_id, z.as_of, z.zone_id, q.first_close, q.last_close, z.side, reg.regime, round(z.distance_atr, 6) AS distance_atr, round(z.width_atr, 6) AS width_atr, z.n_sources, z.n_families,
        l.y_touch, l.y_hold, l.t_touch, l.n_bars < 5 AS label_gap FROM zones z JOIN ({FEATURES['cmp_16_sequences']}) q ON q.security_id = z.security_id AND q.as_of = z.as_of
        JOIN lbl l ON l.security_id = z.security_id AND l.as_of = z.as_of AND l.zone_id = z.zone_id LEFT JOIN reg ON reg.as_of = z.as_of""", "zones", extra=LB.ALL | LB.REGIMES,
    ),
)
