"""Queries of trailing volume profiles."""

from __future__ import annotations

from ..operators import profiles as P
from .core import ranged, rounded, state_of
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    ORACLE[name] = sql


def trailing(s, d):
    series = ranged(s, d)
    return P.trailing_profile(series, state_of(series))


# Every date with every bar of its windows.
TRAILING = {
    "gr": """SELECT security_id, as_of, k, first_value(atr) OVER (PARTITION BY security_id, date_trunc('quarter', as_of) ORDER BY as_of) * 0.1::DOUBLE AS width FROM state WHERE atr > 0""",
    "sp": """SELECT g.security_id, g.as_of, g.width, b.low, b.high, b.volume, g.k - b.k AS age, unnest(range(floor(b.low / g.width)::BIGINT, floor(b.high / g.width)::BIGINT + 1)) AS bin
      FROM gr g JOIN bars b ON b.security_id = g.security_id AND b.k BETWEEN g.k - 251 AND g.k WHERE b.volume > 0""",
    "sv": """SELECT security_id, as_of, width, age, bin, floor(volume * (CASE WHEN high > low THEN (least(high, (bin + 1) * width) - greatest(low, bin * width)) / (high - low) ELSE 1.0 END) * 1000000 + 0.5)::BIGINT AS v FROM sp""",
    "tp": """SELECT security_id, as_of, n AS "window", bin, width, sum(v)::BIGINT AS v FROM sv JOIN (VALUES (5), (20), (60), (120), (252)) w(n) ON age < n GROUP BY ALL HAVING sum(v) > 0""",
}
register("agg_8_trailing_profile", trailing, query('SELECT security_id, as_of, "window"::BIGINT AS "window", bin, round(width, 6) AS width, round(v / 1000000, 6) AS volume FROM tp', "state", extra=TRAILING))
LEVELS = TRAILING | {
    "ts": """SELECT security_id, as_of, "window", width, sum(v)::BIGINT AS total, min(bin) AS low, max(bin) AS high, arg_max(bin, (v, -bin)) AS poc, max(v)::BIGINT AS top FROM tp GROUP BY ALL""",
    "tw": """SELECT *, poc AS lo, poc AS hi, top AS inside FROM ts
      UNION ALL SELECT security_id, as_of, "window", width, total, low, high, poc, top, CASE WHEN up >= down THEN lo ELSE lo - 1 END, CASE WHEN up >= down THEN hi + 1 ELSE hi END, inside + greatest(up, down) FROM (
        SELECT t.*, CASE WHEN t.hi < t.high THEN coalesce(u.v, 0) ELSE -1 END AS up, CASE WHEN t.lo > t.low THEN coalesce(d.v, 0) ELSE -1 END AS down
        FROM tw t LEFT JOIN tp u ON u.security_id = t.security_id AND u.as_of = t.as_of AND u."window" = t."window" AND u.bin = t.hi + 1
        LEFT JOIN tp d ON d.security_id = t.security_id AND d.as_of = t.as_of AND d."window" = t."window" AND d.bin = t.lo - 1 WHERE t.inside < floor(t.total * 0.7::DOUBLE)) WHERE up >= 0 OR down >= 0""",
}
register(
    "agg_8_trailing_levels", lambda s, d: P.trailing_levels(trailing(s, d)),
    query(
        """SELECT security_id, as_of, "window"::BIGINT AS "window", round(total / 1000000, 6) AS total, round((poc + 0.5::DOUBLE) * width, 6) AS poc, round(lo * width, 6) AS val, round((hi + 1) * width, 6) AS vah
        FROM tw QUALIFY row_number() OVER (PARTITION BY security_id, as_of, "window" ORDER BY hi - lo DESC) = 1""", "state", extra=LEVELS, once=("tp",),
    ),
)
