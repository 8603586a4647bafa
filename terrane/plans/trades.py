"""Queries of zone trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trades as T
from ..sources.derived import bars
from .core import rounded
from .labels import ZK, zoned
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    ORACLE[name] = sql


def trades(s, d):
    series, z = zoned(s, d)
    return T.zone_trades(z, series)


def _markets(s, d):
    """Asia's bars trade in HK, all others in the US."""
    ids = s.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("security_id"))
    return ids.select("security_id", F.when(F.col("security_id") == 2, "HK").otherwise("US").alias("market"))


def taken(s, d):
    return T.netted(T.one_at_a_time(trades(s, d)), T.trade_facts(bars(s, d)), _markets(s, d))


_day1 = """CASE WHEN o <= near AND o <= stop THEN {'reason': 'stop', 'price': o} WHEN lo <= stop THEN {'reason': 'stop', 'price': stop}
  WHEN (o <= near AND h >= target) OR c >= target THEN {'reason': 'target', 'price': target} WHEN step = 5 THEN {'reason': 'expiry', 'price': c} END"""
_later = """CASE WHEN o <= stop THEN {'reason': 'stop', 'price': o} WHEN o >= target THEN {'reason': 'target', 'price': o} WHEN lo <= stop THEN {'reason': 'stop', 'price': stop}
  WHEN h >= target THEN {'reason': 'target', 'price': target} WHEN step = 5 THEN {'reason': 'expiry', 'price': c} END"""
TRADES = ZK | {
    "tw": """SELECT z.security_id, z.as_of, z.zone_id, z.side, z.k, z.atr, b.k - z.k AS step, CASE side WHEN 'support' THEN z.upper ELSE -z.lower END AS near,
      CASE side WHEN 'support' THEN z.lower ELSE -z.upper END - 0.25 * z.atr AS stop, CASE side WHEN 'support' THEN b.open ELSE -b.open END AS o,
      CASE side WHEN 'support' THEN b.high ELSE -b.low END AS h, CASE side WHEN 'support' THEN b.low ELSE -b.high END AS lo, CASE side WHEN 'support' THEN b.close ELSE -b.close END AS c
      FROM zk z JOIN bars b ON b.security_id = z.security_id AND b.k BETWEEN z.k + 1 AND z.k + 5""",
    "tf": "SELECT *, min(step) FILTER (lo <= near) OVER (PARTITION BY security_id, as_of, zone_id) AS t_fill FROM tw",
    "tg": "SELECT *, fill + 0.5 * atr AS target FROM (SELECT *, max(CASE WHEN step = t_fill THEN least(o, near) END) OVER (PARTITION BY security_id, as_of, zone_id) AS fill FROM tf)",
    "te": f"SELECT *, CASE WHEN step = t_fill THEN {_day1} WHEN step > t_fill THEN {_later} END AS e FROM tg",
    "td": """SELECT security_id, as_of, zone_id, side, k, min(t_fill) AS t_fill, max(fill) AS m_fill, count(*) AS n, min(step) FILTER (e IS NOT NULL) AS t_exit, arg_min(e, step) FILTER (e IS NOT NULL) AS x
      FROM te GROUP BY ALL""",
    "tr": """SELECT security_id, as_of, zone_id, side, k, t_fill, t_exit, CASE WHEN t_fill IS NULL THEN CASE WHEN n < 5 THEN 'open' ELSE 'unfilled' END ELSE coalesce(x.reason, 'open') END AS reason,
      CASE side WHEN 'support' THEN m_fill ELSE -m_fill END AS fill, CASE side WHEN 'support' THEN x.price ELSE -x.price END AS exit, (x.price - m_fill) / abs(m_fill) AS gross FROM td""",
}
_round = "round(fill, 6) AS fill, round(exit, 6) AS exit"
register(
    "cmp_12_zone_trades", trades,
    query(f"SELECT security_id, as_of, zone_id, side, k, reason, t_fill, t_exit, {_round}, round(gross, 6) AS gross FROM tr", "zones", extra=TRADES),
)
# A security's trades one after another: the next is the first that is filled after the one before has ended.
TAKEN = TRADES | {
    "tc": """SELECT * FROM (SELECT *, k + t_fill AS k_fill, coalesce(k + t_exit, 1099511627776) AS k_end FROM tr WHERE t_fill IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY security_id, k_fill ORDER BY as_of, zone_id) = 1""",
    "tn": "SELECT *, (SELECT min(k_fill) FROM tc b WHERE b.security_id = a.security_id AND b.k_fill > a.k_end) AS after FROM tc a",
    "tt": """SELECT * FROM tn QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY k_fill) = 1
      UNION ALL SELECT n.* FROM tt JOIN tn n ON n.security_id = tt.security_id AND n.k_fill = tt.after""",
    "fa": """SELECT security_id, session AS as_of, avg(spread) OVER w AS spread, stddev_samp(ret) OVER w AS sigma, avg(close * volume) OVER w AS adv FROM (
      SELECT *, CASE WHEN a IS NOT NULL THEN greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0) END AS spread FROM (
        SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0)) - sqrt(gamma / (3 - 2 * sqrt(2.0))) AS a FROM (
          SELECT *, ln(high / low) ** 2 + ln(h1 / l1) ** 2 AS beta, ln(greatest(high, h1) / least(low, l1)) ** 2 AS gamma FROM (
            SELECT *, CASE WHEN k > 1 THEN lag(high) OVER o END AS h1, CASE WHEN k > 1 THEN lag(low) OVER o END AS l1, close / lag(close) OVER o - 1 AS ret
            FROM bars WINDOW o AS (PARTITION BY security_id ORDER BY session)))
        ) WHERE true) WINDOW w AS (PARTITION BY security_id ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "co": """SELECT t.*, 2 * (CASE WHEN t.security_id = 2 THEN 0.0::DOUBLE / fill + 0.0003 + 0.001057 + 0.0005 ELSE 0.0005::DOUBLE / fill + 0.0002 END
      + coalesce(spread, 0) / 2 + coalesce(0.1 * coalesce(sigma, 0) * sqrt(1000.0 / nullif(adv, 0)), 0)) AS cost FROM tt t LEFT JOIN fa USING (security_id, as_of)""",
}
register(
    "cmp_12_one_at_a_time", taken,
    query(f"SELECT security_id, as_of, zone_id, side, k, reason, t_fill, t_exit, {_round}, round(gross, 6) AS gross, round(cost, 6) AS cost, round(gross - cost, 6) AS net FROM co", "zones", extra=TAKEN),
)
register(
    "cmp_12_trade_metrics", lambda s, d: T.trade_metrics(taken(s, d), bars(s, d).groupBy("security_id").agg(F.count("*").alias("n"))),
    query(
        """SELECT security_id, count(*) AS trades, count(*) FILTER (reason = 'stop') AS stops, count(*) FILTER (reason = 'target') AS targets, count(*) FILTER (reason = 'expiry') AS expiries,
        round(avg((net > 0)::INT), 6) AS hit_rate, round(avg(net), 6) AS mean_net, round(avg(cost), 6) AS cost, round(sum(greatest(net, 0)) / nullif(abs(sum(least(net, 0))), 0), 6) AS profit_factor,
        round(avg(t_exit - t_fill + 1), 6) AS held, round(2.0 * count(*) / any_value(b.n), 6) AS turnover
        FROM (SELECT *, gross - cost AS net FROM co) JOIN (SELECT security_id, count(*) AS n FROM bars GROUP BY security_id) b USING (security_id) WHERE net IS NOT NULL GROUP BY security_id""", "zones", extra=TAKEN,
    ),
)
