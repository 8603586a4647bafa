"""Queries of the data spine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pit
from ..operators import spine as D
from ..sources.derived import bars
from .core import CALENDAR, R, _calendar, rounded
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


# Small dimension tables, the same text for both engines.
ACTIONS = "SELECT * FROM (VALUES (0, DATE '1995-03-01', DATE '1995-02-01', 'split', 2.0), (0, DATE '1996-05-01', DATE '1996-04-15', 'bonus', 0.5), (1, DATE '1997-01-10', DATE '1997-06-01', 'split', 3.0), (2, DATE '1994-07-07', DATE '1994-07-01', 'split', 1.5)) t(security_id, ex_date, available_at, kind, ratio)"
GAIN = "CASE kind WHEN 'split' THEN 1 / ratio WHEN 'bonus' THEN 1 / (1 + ratio) END"
MEMBERS = "SELECT * FROM (VALUES ('IX', 0, DATE '1993-01-01', DATE '1995-06-01'), ('IX', 1, DATE '1994-01-01', CAST(NULL AS DATE)), ('IY', 2, DATE '1992-01-01', DATE '1997-01-01'), ('IY', 9, DATE '1992-01-01', CAST(NULL AS DATE))) t(index_id, security_id, start, \"end\")"
SYMBOLS = "SELECT * FROM (VALUES ('a', 'S0', 0, DATE '1990-01-01', DATE '1995-01-01'), ('a', 'S0', 1, DATE '1995-01-01', CAST(NULL AS DATE)), ('a', 'S2', 2, DATE '1990-01-01', CAST(NULL AS DATE))) t(source, symbol, sid, start, \"end\")"


def table(spark, sql):
    """The same literal table in Spark."""
    return spark.sql(sql.replace('"end"', "`end`"))


def actions(spark):
    a = table(spark, ACTIONS).withColumns({"ratio": F.col("ratio").cast("double"), "security_id": F.col("security_id").cast("long"), **{c: F.lit(None).cast("double") for c in ("amount", "close_before", "offer")}})
    return a.withColumn("gain", D.action_gain())


def weekly(spark, d):
    return pit.week_ends(bars(spark, d))


register("fn_11_action_gains", lambda s, d: bars(s, d).select("security_id", "session", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r).cast("double").alias("ratio"), F.lit(a).cast("double").alias("amount"), F.lit(o).cast("double").alias("offer")) for k, r, a, o in (("split", 2, 0, 0), ("bonus", 0.25, 0, 0), ("dividend", 0, 1.5, 0), ("rights", 0.2, 0, 150), ("spinoff", 0, 20, 0))))).alias("x"), F.col("close").alias("close_before")).select("security_id", "session", "close_before", "x.*").select("security_id", "session", "kind", D.action_gain().alias("gain")), query("SELECT security_id, session, unnest(['split','bonus','dividend','rights','spinoff']) AS kind, round(unnest([0.5, 1 / 1.25, 1 - 1.5 / close, (close + 0.2 * 150) / 1.2 / close, 1 - 20 / close]), 6) AS gain FROM bars", "bars"))
_adj = query("SELECT b.security_id, b.session, round(close, 6) AS close, round(coalesce(exp(sum(ln(g))), 1), 6) AS factor, round(close * coalesce(exp(sum(ln(g))), 1), 6) AS adjusted FROM bars b LEFT JOIN (SELECT *, {g} AS g FROM acts WHERE ex_date <= DATE '1996-12-31' AND available_at <= DATE '1996-12-31') a ON a.security_id = b.security_id AND a.ex_date > b.session GROUP BY b.security_id, b.session, close".replace("{g}", GAIN), "bars", extra={"acts": ACTIONS})
register("jon_7_adjusted_asof", lambda s, d: D.adjust_asof(bars(s, d), actions(s), F.lit("1996-12-31").cast("date")), _adj)
register("win_14_adjustment_factor", lambda s, d: D.adjust_asof(bars(s, d), actions(s), F.lit("1996-12-31").cast("date")).select("security_id", "session", "factor"), f"SELECT security_id, session, factor FROM ({_adj})")
register("jon_8_members_at", lambda s, d: D.members_at(table(s, MEMBERS).withColumn("security_id", F.col("security_id").cast("long")), weekly(s, d).select("as_of").distinct()), query("SELECT index_id, m.security_id, as_of FROM (SELECT DISTINCT as_of FROM state) s JOIN mem m ON start <= as_of AND as_of < coalesce(\"end\", DATE '9999-12-31')", "state", extra={"mem": MEMBERS}))
register("jon_9_symbols", lambda s, d: D.resolve_symbols(bars(s, d).select(F.lit("a").alias("source"), F.concat(F.lit("S"), (F.col("security_id") % 3).cast("string")).alias("symbol"), "session").distinct(), table(s, SYMBOLS).withColumn("security_id", F.col("sid").cast("long")).drop("sid")), query("SELECT b.source, b.symbol, b.session, sid::BIGINT AS security_id FROM (SELECT DISTINCT 'a' AS source, 'S' || (security_id % 3) AS symbol, session FROM bars) b LEFT JOIN sym y ON y.source = b.source AND y.symbol = b.symbol AND start <= session AND session < coalesce(\"end\", DATE '9999-12-31')", "bars", extra={"sym": SYMBOLS}))
_b2 = lambda s, d: bars(s, d).where("k % 17 != 0").withColumn("close", F.when(F.col("k") % 13 == 0, F.col("close") * 1.01).otherwise(F.col("close")))
RECON = "SELECT a.security_id, a.session, a.close AS close_a, b.close AS close_b, CASE WHEN b.close IS NULL THEN 'only_a' WHEN abs(a.close - b.close) <= 0.001 * abs(a.close) OR round(abs(a.close - b.close), 9) <= 0.01 THEN 'pass' ELSE 'fail' END AS status FROM bars a LEFT JOIN (SELECT security_id, session, CASE WHEN k % 13 = 0 THEN close * 1.01 ELSE close END AS close FROM bars WHERE k % 17 <> 0) b USING (security_id, session)"
register("jon_15_reconciled", lambda s, d: D.reconcile(bars(s, d), _b2(s, d)), query(f"SELECT security_id, session, {R('close_a', 'close_b')}, status FROM ({RECON})", "bars"))
register("agg_20_pass_rates", lambda s, d: D.recon_summary(D.reconcile(bars(s, d), _b2(s, d))), query(f"SELECT security_id, count(*) AS n, round(avg((status = 'pass')::INT), 6) AS pass_rate FROM ({RECON}) GROUP BY ROLLUP (security_id)", "bars"))
register(
    # Figures of a session become known 3 to 30 days later, not always in order.
    "jon_16_latest_known", lambda s, d: pit.latest_known(bars(s, d).select("security_id", "session", F.date_add("session", (3 + F.col("k") * 7 % 28).cast("int")).alias("known"), F.col("close").alias("value")), weekly(s, d), ["security_id"], "session", "known", "as_of", ["value"]),
    query("SELECT s.security_id, s.as_of, max(b.session) AS session, round(arg_max(b.close, b.session), 6) AS value FROM state s LEFT JOIN bars b ON b.security_id = s.security_id AND b.session + (3 + b.k * 7 % 28)::INT <= s.as_of GROUP BY ALL", "state"),
)
register(
    # The first session of each month is an event, announced up to 60 days ahead or known up to 9 days late.
    "jon_19_event_context", lambda s, d: D.event_context(bars(s, d).groupBy("security_id", F.trunc("session", "month").alias("m")).agg(F.min("session").alias("event_date")).select("security_id", "event_date", F.date_sub("event_date", (F.month("event_date") * 7 % 70 - 9).cast("int")).alias("available_at")), weekly(s, d)),
    query("SELECT s.security_id, s.as_of, s.as_of - max(e.day) FILTER (e.day <= s.as_of) AS days_since, min(e.day) FILTER (e.day > s.as_of) - s.as_of AS days_to FROM state s LEFT JOIN (SELECT security_id, min(session) AS day, min(session) - (month(min(session)) * 7 % 70 - 9)::INT AS known FROM bars GROUP BY security_id, date_trunc('month', session)) e ON e.security_id = s.security_id AND e.known <= s.as_of GROUP BY s.security_id, s.as_of", "state"),
)
CLOSURES = "SELECT * FROM (VALUES (DATE '1995-07-04', 'full'), (DATE '1996-07-04', 'full'), (DATE '1995-11-24', 'half'), (DATE '1996-12-24', 'half')) t(session, kind)"
register("jon_20_open_sessions", lambda s, d: D.open_sessions(_calendar(s, d), table(s, CLOSURES)), f"WITH cal AS ({CALENDAR}), clo AS ({CLOSURES}) SELECT c.session, c.close_ts, coalesce(h.kind = 'half', false) AS half_day FROM cal c LEFT JOIN clo h USING (session) WHERE h.kind IS DISTINCT FROM 'full'")
BANDS = "SELECT * FROM (VALUES ('HK', 0.0, 1000.0, 0.05), ('HK', 1000.0, 1500.0, 0.1), ('HK', 1500.0, 2000.0, 0.2)) t(market, lo, hi, tick)"
register("jon_21_tick_size", lambda s, d: D.tick_size(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.lit("HK").alias("market"), F.col("p_retailprice").alias("price")), s.sql(BANDS).select("market", *(F.col(c).cast("double").alias(c) for c in ("lo", "hi", "tick")))), f"SELECT p_partkey, 'HK' AS market, round(p_retailprice, 6) AS price, coalesce(tick::DOUBLE, 0.01) AS tick FROM part LEFT JOIN ({BANDS}) b ON p_retailprice >= lo AND p_retailprice < hi")
_new = lambda s, d: bars(s, d).withColumn("close", F.when((F.col("security_id") == 2) & (F.col("k") > 100), F.col("close") * 1.02).otherwise(F.col("close")))
register(
    "set_5_incremental_load", lambda s, d: D.incremental(bars(s, d).where("session < date '1998-01-01'"), _new(s, d)),
    query("SELECT b.security_id, b.session, round(CASE WHEN b.security_id = 2 AND k > 100 THEN close * 1.02 ELSE close END, 6) AS close, CASE WHEN b.security_id = 2 THEN 'restate' ELSE 'append' END AS action FROM bars b WHERE session >= DATE '1998-01-01'", "bars"),
)
register(
    "set_6_calendar_mismatch", lambda s, d: D.calendar_mismatch(bars(s, d), _calendar(s, d)),
    query("SELECT l.security_id, c.session, 'no_bar' AS kind FROM calendar c JOIN (SELECT security_id, min(session) AS a, max(session) AS b FROM bars GROUP BY ALL) l ON c.session BETWEEN a AND b WHERE NOT EXISTS (SELECT 1 FROM bars x WHERE x.security_id = l.security_id AND x.session = c.session) UNION ALL SELECT security_id, session, 'no_session' FROM bars WHERE session NOT IN (SELECT session FROM calendar)", "bars", extra={"calendar": CALENDAR}),
)
register("set_7_survivors", lambda s, d: D.members_at(table(s, MEMBERS).withColumn("security_id", F.col("security_id").cast("long")), weekly(s, d).select("as_of").distinct()).groupBy("index_id", "security_id").agg(F.count("*").alias("weeks"), F.max("as_of").alias("last_seen")).join(bars(s, d).groupBy("security_id").agg(F.max("session").alias("last_bar")), "security_id", "left"), query("SELECT index_id, m.security_id::BIGINT AS security_id, count(*) AS weeks, max(as_of) AS last_seen, any_value(last_bar) AS last_bar FROM (SELECT DISTINCT as_of FROM state) s JOIN mem m ON start <= as_of AND as_of < coalesce(\"end\", DATE '9999-12-31') LEFT JOIN (SELECT security_id, max(session) AS last_bar FROM bars GROUP BY ALL) b ON b.security_id = m.security_id GROUP BY ALL", "state", extra={"mem": MEMBERS}))
_w252 = "(PARTITION BY security_id ORDER BY session ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
register(
    "agg_18_quality", lambda s, d: D.quality(bars(s, d)).select("security_id", "session", "score", "blockers"),
    query(f"SELECT security_id, session, round(0.25 * a + 0.2 + 0.15 * b + 0.15 * c + 0.15 * e + 0.1 * f, 6) AS score, concat_ws(',', CASE WHEN a < 0.5 THEN 'c_ohlc' END, CASE WHEN b < 0.5 THEN 'c_positive' END, CASE WHEN c < 0.5 THEN 'c_volume' END, CASE WHEN e < 0.5 THEN 'c_jump' END, CASE WHEN f < 0.5 THEN 'c_stale' END) AS blockers FROM (SELECT security_id, session, avg((low <= least(open, close) AND greatest(open, close) <= high)::INT) OVER {_w252} AS a, avg((low > 0)::INT) OVER {_w252} AS b, avg((volume > 0)::INT) OVER {_w252} AS c, avg(coalesce(abs(close / pc - 1) <= 0.01, true)::INT) OVER {_w252} AS e, avg(coalesce(close <> pc, true)::INT) OVER {_w252} AS f FROM ranged)", "ranged"),
)
register("agg_19_coverage", lambda s, d: D.coverage_by_year(D.members_at(table(s, MEMBERS).withColumn("security_id", F.col("security_id").cast("long")), weekly(s, d).select("as_of").distinct()), bars(s, d)), query("SELECT index_id, year, count(*) AS members, count(h.security_id) AS with_bars FROM (SELECT DISTINCT index_id, m.security_id, year(as_of) AS year FROM (SELECT DISTINCT as_of FROM state) s JOIN mem m ON start <= as_of AND as_of < coalesce(\"end\", DATE '9999-12-31')) x LEFT JOIN (SELECT DISTINCT security_id, year(session) AS year FROM bars) h USING (security_id, year) GROUP BY ALL", "state", extra={"mem": MEMBERS}))
register(
    "agg_30_chosen_source", lambda s, d: D.choose_source(bars(s, d).groupBy("security_id", F.when(F.col("k") % 3 == 0, "a").when(F.col("k") % 3 == 1, "b").otherwise("c").alias("source")).agg(F.min("session").alias("first"), F.max("session").alias("last")), bars(s, d).groupBy("security_id").agg(F.min("session").alias("from"), F.date_sub(F.max("session"), 5).alias("to")), ("c", "a", "b")),
    query("SELECT security_id, arg_min(source, CASE source WHEN 'c' THEN 1 WHEN 'a' THEN 2 ELSE 3 END) AS source FROM (SELECT security_id, CASE k % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, min(session) AS f, max(session) AS l FROM bars GROUP BY ALL) JOIN (SELECT security_id, min(session) AS a, max(session) - 5 AS b FROM bars GROUP BY ALL) USING (security_id) WHERE f <= a AND l >= b GROUP BY security_id", "bars"),
)
SPLITS = "SELECT b.security_id, b.session AS ex_date, CASE WHEN k % 2 = 0 THEN 2.0::DOUBLE ELSE 1.001 END AS ratio FROM bars b WHERE k % 50 = 7"
register("win_15_split_state", lambda s, d: D.split_state(bars(s, d), bars(s, d).where("k % 50 = 7").select("security_id", F.col("session").alias("ex_date"), F.when(F.col("k") % 2 == 0, 2.0).otherwise(1.001).alias("ratio"))), query(f"SELECT security_id, ex_date, ratio, round(step, 6) AS step, CASE WHEN step IS NULL THEN 'unknown' WHEN abs(step) < 0.25 * abs(ln(ratio)) THEN 'applied' WHEN abs(step + ln(ratio)) < 0.25 * abs(ln(ratio)) THEN 'not_applied' ELSE 'ambiguous' END AS state FROM (SELECT s.*, ln(r.close / r.pc) AS step FROM ({SPLITS}) s JOIN ranged r ON r.security_id = s.security_id AND r.session = s.ex_date)", "ranged"))
register("agg_28_load_status", lambda s, d: D.load_status(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("dataset"), F.col("ts").alias("at"), F.col("event_id").alias("run"), (F.col("event_id") % 3).alias("failed"), F.lit(2).alias("total")), F.lit("2024-02-01 12:00:00").cast("timestamp")), "SELECT event_type AS dataset, ts AS at, CASE WHEN ts < TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 2 DAY THEN 'stale' WHEN event_id % 3 = 0 THEN 'ok' WHEN event_id % 3 < 2 THEN 'partial' ELSE 'error' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")


def _leak(s, d):
    """Candidates of past dates with and without later rows: the difference must be empty."""
    from . import core

    full = core.ranged(s, d)
    cut = full.where("session <= date '1996-06-30'")
    at = [core.levels.candidates(x, core.state_of(x)).where("as_of <= date '1996-06-23'").select(*core.CAND) for x in (full, cut)]
    gone = at[0].exceptAll(at[1]).withColumn("side", F.lit("only_full"))
    return gone.unionByName(at[1].exceptAll(at[0]).withColumn("side", F.lit("only_cut"))).groupBy("side").agg(F.count("*").alias("n")).union(at[0].agg(F.lit("compared"), F.count("*")))


register("set_4_leakage_probe", _leak, query("SELECT 'compared' AS side, count(*) AS n FROM cand WHERE as_of <= DATE '1996-06-23'", "cand"))
