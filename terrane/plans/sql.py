"""SQL building blocks of the oracles, as named common table expressions."""

from __future__ import annotations

from ..operators.touch import MIX
from ..params import DEFAULT


def _mixed(x: str) -> str:
    """``operators.touch.mixed`` as SQL."""
    for times, plus, shift in MIX:
        x = f"((({x}) * {times} + {plus}) & 2147483647)"
        x = f"xor({x}, {x} >> {shift})"
    return x


CTES = {
    "ticks": """SELECT n_regionkey::BIGINT AS security_id, CAST(l_shipdate AS DATE) AS session, l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount,
  (CAST(round(l_discount*100) AS BIGINT) - 5) * 4 AS step FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "priced": """SELECT *, CAST(20000 + sum(step) OVER o AS BIGINT) AS px, row_number() OVER (PARTITION BY security_id, session ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS n,
  count(*) OVER (PARTITION BY security_id, session) AS cnt FROM ticks
  WINDOW o AS (PARTITION BY security_id ORDER BY session, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount ROWS UNBOUNDED PRECEDING)""",
    "bars": """SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY session) AS k, CAST(session AS TIMESTAMP) + INTERVAL 20 HOUR AS available_at FROM (
  SELECT security_id, session, max(px) FILTER (n = 1)::DOUBLE / 100 AS open, max(px)::DOUBLE / 100 AS high, min(px)::DOUBLE / 100 AS low, max(px) FILTER (n = cnt)::DOUBLE / 100 AS close, sum(l_quantity) AS volume, count(*) AS n_ticks
  FROM priced GROUP BY security_id, session)""",
    "ranged": """SELECT *, CASE WHEN k = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (
  SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY session) AS pc FROM bars)""",
    "wilder": """SELECT security_id, 20::BIGINT AS k, sum(tr ORDER BY k) / 20 AS atr FROM ranged WHERE k <= 20 GROUP BY security_id HAVING count(*) = 20
  UNION ALL SELECT r.security_id, r.k, (w.atr * 19 + r.tr) / 20 FROM wilder w JOIN ranged r ON r.security_id = w.security_id AND r.k = w.k + 1""",
    "atrs": "SELECT r.*, w.atr FROM ranged r LEFT JOIN wilder w USING (security_id, k)",
    "state": """SELECT a.security_id, a.session AS as_of, a.k, a.close AS spot, a.atr FROM atrs a
  JOIN (SELECT security_id, max(session) AS session FROM bars GROUP BY security_id, date_trunc('week', session)) w USING (security_id, session)""",
    "swing_bars": """SELECT *, max(high) OVER a AS hh, min(low) OVER a AS ll, count(*) OVER a AS c FROM atrs WINDOW a AS (PARTITION BY security_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "swing_sides": """SELECT security_id, k AS t, session, atr, 'high' AS side, high AS level FROM swing_bars WHERE c = 7 AND atr IS NOT NULL AND high >= hh
  UNION ALL SELECT security_id, k, session, atr, 'low', low FROM swing_bars WHERE c = 7 AND atr IS NOT NULL AND low <= ll""",
    "swings": """SELECT *, t + greatest(confirm_sessions, 3) AS seen_at FROM (
  SELECT s.security_id, s.t, s.side, s.level, s.session AS formed_at, s.atr AS atr_at_formation, kk AS k_atr, min(b.k) - s.t AS confirm_sessions
  FROM swing_sides s CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0)) v(kk) JOIN bars b ON b.security_id = s.security_id AND b.k BETWEEN s.t + 1 AND s.t + 20
  WHERE CASE WHEN s.side = 'high' THEN s.level - b.low ELSE b.high - s.level END >= kk * s.atr GROUP BY s.security_id, s.t, s.side, s.level, s.session, s.atr, kk)""",
    "swing_cand": """SELECT t.security_id, t.as_of, t.spot, t.atr, s.level, s.level - 0.1 * t.atr AS lower, s.level + 0.1 * t.atr AS upper, 'swing_' || s.side || '_k' || regexp_replace(printf('%.6f', s.k_atr), '\\.?0+$', '') AS source, 'A' AS family, s.formed_at
  FROM state t JOIN swings s ON s.security_id = t.security_id AND s.seen_at <= t.k AND abs(s.level - t.spot) <= 6 * t.atr""",
    "ladder": """SELECT *, e / 10 AS step, 0 AS rank FROM (SELECT *, pow(10.0::DOUBLE, floor(log10(spot))) AS e FROM state WHERE atr IS NOT NULL)
  UNION ALL SELECT *, e / 20, 1 FROM (SELECT *, pow(10.0::DOUBLE, floor(log10(spot))) AS e FROM state WHERE atr IS NOT NULL)
  UNION ALL SELECT *, e / 100, 2 FROM (SELECT *, pow(10.0::DOUBLE, floor(log10(spot))) AS e FROM state WHERE atr IS NOT NULL)
  UNION ALL SELECT *, e / 100 / 2, 3 FROM (SELECT *, pow(10.0::DOUBLE, floor(log10(spot))) AS e FROM state WHERE atr IS NOT NULL)""",
    "rungs": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, as_of, level ORDER BY rank) AS first FROM (
  SELECT security_id, as_of, spot, atr, step, rank, round(unnest(range(ceil((spot - 3 * atr) / step - 1e-9)::BIGINT, floor((spot + 3 * atr) / step + 1e-9)::BIGINT + 1)) * step, 6) AS level FROM ladder) WHERE level > 0) WHERE first = 1""",
    "round_cand": """SELECT security_id, as_of, spot, atr, level, level - 0.1 * atr AS lower, level + 0.1 * atr AS upper, 'round_' || regexp_replace(printf('%.6f', step), '\\.?0+$', '') AS source, 'B' AS family, CAST(NULL AS DATE) AS formed_at FROM rungs""",
    "cand": """SELECT *, row_number() OVER (PARTITION BY security_id, as_of ORDER BY level, source, lower) AS i FROM (SELECT * FROM swing_cand UNION ALL SELECT * FROM round_cand)""",
    "folded": """SELECT security_id, as_of, i, level AS first, 1::BIGINT AS cluster FROM cand WHERE i = 1
  UNION ALL SELECT c.security_id, c.as_of, c.i, CASE WHEN (c.level - f.first) / c.atr > 0.5 THEN c.level ELSE f.first END, f.cluster + CASE WHEN (c.level - f.first) / c.atr > 0.5 THEN 1 ELSE 0 END
  FROM folded f JOIN cand c ON c.security_id = f.security_id AND c.as_of = f.as_of AND c.i = f.i + 1""",
    "members": "SELECT c.*, f.cluster FROM cand c JOIN folded f USING (security_id, as_of, i)",
    "geometry": """SELECT *, CASE WHEN center < spot THEN 'support' ELSE 'resistance' END AS side, (upper - lower) / atr AS width_atr, (center - spot) / atr AS distance_atr FROM (
  SELECT security_id, as_of, spot, atr, cluster, sum(level ORDER BY level) / count(*) AS center, min(lower) AS lower, max(upper) AS upper, count(*) AS n_sources, count(DISTINCT family) AS n_families, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources
  FROM members GROUP BY ALL) WHERE NOT (spot BETWEEN lower AND upper)""",
    "zones": """SELECT *, printf('%d-%s-P0-%02d', security_id, CASE side WHEN 'support' THEN 'S' ELSE 'R' END, n) AS zone_id FROM (
  SELECT *, row_number() OVER (PARTITION BY security_id, as_of, side ORDER BY abs(distance_atr), center) AS n FROM geometry) WHERE n <= 4""",
    "triples": "SELECT security_id, session, k, high / pc AS h, low / pc AS l, close / pc AS c FROM ranged WHERE k > 1",
    "cells": f"SELECT path, {', '.join(f'max(x) FILTER (step = {n}) AS x{n}' for n in range(1, 6))} FROM (SELECT path, step, {_mixed('path * 8 + step')} AS x FROM (SELECT unnest(range({DEFAULT.paths})) AS path) CROSS JOIN (SELECT unnest(range(1, 6)) AS step)) GROUP BY path",
    "picks": f"""SELECT security_id, as_of, spot, path, {', '.join(f"greatest(k - 500, 1) + 1 + {_mixed(f'xor(x{n}, base)')} % least(500, k - 1) AS p{n}" for n in range(1, 6))}
  FROM (SELECT *, ('0x' || substr(md5('0|' || security_id || '|' || as_of), 1, 8))::BIGINT % 2147483648 AS base FROM state WHERE k > 1) CROSS JOIN cells""",
    "walked": f"""SELECT p.security_id, p.as_of, p.path, {', '.join(f"spot * {''.join(f't{i}.c * ' for i in range(1, n))}t{n}.{x} AS {x}{n}" for n in range(1, 6) for x in 'hlc')}
  FROM picks p {' '.join(f'JOIN triples t{n} ON t{n}.security_id = p.security_id AND t{n}.k = p.p{n}' for n in range(1, 6))}""",
}

NEEDS = {
    "priced": ["ticks"], "bars": ["priced"], "ranged": ["bars"], "wilder": ["ranged"], "atrs": ["wilder"], "state": ["atrs"], "swing_bars": ["atrs"], "swing_sides": ["swing_bars"],
    "swings": ["swing_sides", "bars"], "swing_cand": ["state", "swings"], "ladder": ["state"], "rungs": ["ladder"], "round_cand": ["rungs"], "cand": ["swing_cand", "round_cand"], "folded": ["cand"],
    "members": ["folded"], "geometry": ["members"], "zones": ["geometry"], "triples": ["ranged"], "picks": ["state", "cells"], "walked": ["picks", "triples"],
}


def query(select: str, *ctes: str, extra: dict[str, str] | None = None, once: tuple[str, ...] = ()) -> str:
    """``WITH RECURSIVE`` the named expressions and all that they need, then ``select``. ``once``: names of ``extra`` that a recursion reads, to be computed once."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in ctes:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{k} AS {'MATERIALIZED ' * (k in once)}({v})" for k, v in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select
