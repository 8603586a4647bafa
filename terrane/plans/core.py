"""Queries of the zone path: bars, ranges, swings, rungs, clusters, zones, touch probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import indicators, levels, pit, touch, zones
from ..params import DEFAULT
from ..sources.derived import bars
from ..sources.staging import stage
from .sql import query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


_RANGED: dict[tuple[str, str], DataFrame] = {}


def ranged(spark, d) -> DataFrame:
    """Bars with ranges. Several branches of a plan and several queries of a session read them, so they are written once, into the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RANGED:
        _RANGED[key] = stage(indicators.wilder_atr(bars(spark, d)))
    return _RANGED[key]


def state_of(series: DataFrame) -> DataFrame:
    """security_id, as_of, k, spot, atr, last_session of each week's last session."""
    facts = series.select("security_id", "session", "k", F.col("close").alias("spot"), "atr", F.col("session").alias("last_session"))
    return pit.asof_latest(facts, pit.week_ends(series), ["security_id"], "session", "as_of", ["k", "spot", "atr", "last_session"])


def candidates(spark, d) -> DataFrame:
    series = ranged(spark, d)
    return levels.candidates(series, state_of(series))


def zones_and_state(spark, d):
    series = ranged(spark, d)
    state = state_of(series)
    return series, state, zones.zones(levels.candidates(series, state))


def touched(spark, d) -> DataFrame:
    series, state, found = zones_and_state(spark, d)
    z = found.join(state.select("security_id", "as_of", "k"), ["security_id", "as_of"])
    p_ = touch.touch_probabilities(z, indicators.triples(series))
    return found.select("security_id", "as_of", "zone_id", "side", "lower", "upper", "center").join(p_, ["security_id", "as_of", "zone_id"])


CAND = ["security_id", "as_of", "level", "lower", "upper", "source", "family"]
ZONE = ["security_id", "as_of", "zone_id", "side", "lower", "upper", "center", "distance_atr", "width_atr", "n_sources", "n_families", "sources"]
R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)

QUERIES, ORACLE = {}, {}


def register(name: str, run, sql: str | None = None, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, d: rounded(run(spark, d), digits)
    if sql:
        ORACLE[name] = sql


register("src_7_bars", lambda s, d: bars(s, d).drop("n_ticks"), query(f"SELECT security_id, session, {R('open', 'high', 'low', 'close', 'volume')}, available_at, k FROM bars", "bars"))
register(
    "flt_1_visible_bars",
    lambda s, d: pit.visible(bars(s, d), F.lit("1995-06-30"), F.lit("1995-06-30 19:59:59").cast("timestamp")).groupBy("security_id").agg(F.count("*").alias("n"), F.max("session").alias("last_session")),
    query("SELECT security_id, count(*) AS n, max(session) AS last_session FROM bars WHERE session <= DATE '1995-06-30' AND available_at <= TIMESTAMP '1995-06-30 19:59:59' GROUP BY ALL", "bars"),
)
register(
    "flt_2_session_cut",
    lambda s, d: bars(s, d).where("session <= date '1996-01-01'").groupBy("security_id").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")),
    query("SELECT security_id, count(*) AS n, round(sum(volume), 6) AS volume FROM bars WHERE session <= DATE '1996-01-01' GROUP BY ALL", "bars"),
)
register(
    "flt_3_checked_bars",
    lambda s, d: pit.rejected(s.read.parquet(f"{d}/nation.parquet").select((F.col("n_regionkey") + 2).cast("long").alias("security_id")), pit.checked_bars(bars(s, d))),
    query("SELECT DISTINCT n_regionkey::BIGINT + 2 AS security_id, 'no bars' AS reason FROM nation WHERE n_regionkey + 2 NOT IN (SELECT security_id FROM bars)", "bars"),
)
register("flt_4_spot", lambda s, d: state_of(ranged(s, d)).select("security_id", "as_of", "spot", "last_session"), query("SELECT security_id, as_of, round(spot, 6) AS spot, as_of AS last_session FROM state", "state"))
register("flt_5_levels_in_reach", lambda s, d: candidates(s, d).where("family = 'A' and abs(level - spot) <= 3 * atr").groupBy("security_id", "as_of").agg(F.count("*").alias("n")), query("SELECT security_id, as_of, count(*) AS n FROM swing_cand WHERE abs(level - spot) <= 3 * atr GROUP BY ALL", "swing_cand"))
register(
    "flt_6_zones_without_spot",
    lambda s, d: zones.geometry(zones.clustered(candidates(s, d))).groupBy("security_id", "as_of", "side").agg(F.count("*").alias("n")),
    query("SELECT security_id, as_of, side, count(*) AS n FROM geometry GROUP BY ALL", "geometry"),
)
register("flt_7_zone_contents", lambda s, d: zones_and_state(s, d)[2].select("security_id", "as_of", "zone_id", "n_sources", "n_families", "sources", F.col("spot").between(F.col("lower"), F.col("upper")).alias("contains_spot")), query("SELECT security_id, as_of, zone_id, n_sources, n_families, sources, spot BETWEEN lower AND upper AS contains_spot FROM zones", "zones"))
register("flt_8_invalid_candidates", lambda s, d: zones.invalid_candidates(candidates(s, d)).select(*CAND), query(f"SELECT security_id, as_of, {R('level', 'lower', 'upper')}, source, family FROM cand WHERE NOT (lower <= level AND level <= upper)", "cand"))


def _calendar(s, d) -> DataFrame:
    """Sessions of the calendar: every ship date that is no Sunday; Fridays close two hours early."""
    days = s.read.parquet(f"{d}/lineitem.parquet").select(F.to_date("l_shipdate").alias("session")).distinct().where("dayofweek(session) != 1")
    return days.select("session", (F.col("session").cast("timestamp") + F.when(F.dayofweek("session") == 6, F.expr("interval 18 hours")).otherwise(F.expr("interval 21 hours"))).alias("close_ts"))


CALENDAR = "SELECT session, CAST(session AS TIMESTAMP) + CASE WHEN dayofweek(session) = 5 THEN INTERVAL 18 HOUR ELSE INTERVAL 21 HOUR END AS close_ts FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem) WHERE dayofweek(session) <> 0"
register(
    "jon_1_stamped_bars", lambda s, d: pit.stamp_available(bars(s, d), _calendar(s, d), "20:00", 15).select("security_id", "session", "known", "available_at"),
    query("SELECT security_id, session, close_ts IS NOT NULL AS known, coalesce(close_ts, CAST(session AS TIMESTAMP) + INTERVAL 20 HOUR) + INTERVAL 15 MINUTE AS available_at FROM bars LEFT JOIN calendar USING (session)", "bars", extra={"calendar": CALENDAR}),
)
register("jon_2_is_session", lambda s, d: bars(s, d).select("session").distinct().join(_calendar(s, d).select("session", F.lit(True).alias("x")), "session", "left").select("session", F.col("x").isNotNull().alias("is_session")), query("SELECT DISTINCT session, session IN (SELECT session FROM calendar) AS is_session FROM bars", "bars", extra={"calendar": CALENDAR}))
register(
    "jon_3_next_sessions", lambda s, d: pit.next_sessions(_calendar(s, d), bars(s, d).select(F.col("session").alias("as_of")), 5),
    query("SELECT as_of, n AS step, session FROM (SELECT a.as_of, c.session, row_number() OVER (PARTITION BY as_of ORDER BY c.session) AS n FROM (SELECT DISTINCT session AS as_of FROM bars) a JOIN calendar c ON c.session > a.as_of AND c.session <= a.as_of + 40) WHERE n <= 5", "bars", extra={"calendar": CALENDAR}),
)
register("jon_4_asof_state", lambda s, d: state_of(ranged(s, d)).drop("last_session"), query(f"SELECT security_id, as_of, k, {R('spot', 'atr')} FROM state", "state"))
register("jon_5_swing_candidates", lambda s, d: candidates(s, d).where("family = 'A'").select(*CAND), query(f"SELECT security_id, as_of, {R('level', 'lower', 'upper')}, source, family FROM swing_cand", "swing_cand"))


def _assigned(s, d) -> DataFrame:
    members = zones.clustered(candidates(s, d))
    return zones.assigned(members, zones.nearest(zones.geometry(members))).select(*CAND, "zone_id")


register("jon_6_candidates_with_zone", _assigned, query(f"SELECT m.security_id, m.as_of, {R('level')}, round(m.lower, 6) AS lower, round(m.upper, 6) AS upper, source, family, coalesce(z.zone_id, '') AS zone_id FROM members m LEFT JOIN (SELECT security_id, as_of, cluster, zone_id FROM zones) z USING (security_id, as_of, cluster)", "zones"))
register("agg_1_zone_geometry", lambda s, d: zones.geometry(zones.clustered(candidates(s, d))).select("security_id", "as_of", "center", "lower", "upper", "side", "width_atr", "distance_atr"), query(f"SELECT security_id, as_of, {R('center', 'lower', 'upper')}, side, {R('width_atr', 'distance_atr')} FROM geometry", "geometry"))
register("agg_2_zone_sources", lambda s, d: zones.geometry(zones.clustered(candidates(s, d))).select("security_id", "as_of", "center", "n_sources", "n_families", "sources"), query("SELECT security_id, as_of, round(center, 6) AS center, n_sources, n_families, sources FROM geometry", "geometry"))
_hit = " OR ".join(f"(l{n} <= z.upper AND h{n} >= z.lower)" for n in range(1, 6))
TOUCH = f"SELECT security_id, as_of, zone_id, {{}} FROM (SELECT z.security_id, z.as_of, z.zone_id, z.side, z.lower, z.upper, z.center, avg(({_hit})::INT) AS p_touch, avg((least(l1, l2, l3, l4, l5) < z.lower)::INT) AS p_low_below, avg((greatest(h1, h2, h3, h4, h5) > z.upper)::INT) AS p_high_above FROM zones z JOIN walked w USING (security_id, as_of) GROUP BY ALL)"
register("agg_3_p_touch", lambda s, d: touched(s, d).select("security_id", "as_of", "zone_id", "p_touch"), query(TOUCH.format(R("p_touch")), "zones", "walked"))
register("agg_4_p_outside", lambda s, d: touched(s, d).select("security_id", "as_of", "zone_id", "p_low_below", "p_high_above"), query(TOUCH.format(R("p_low_below", "p_high_above")), "zones", "walked"))


def _runs(s, d) -> DataFrame:
    series = ranged(s, d)
    state = state_of(series)
    n = levels.candidates(series, state).groupBy("security_id", "as_of").agg(F.count("*").alias("n_candidates"))
    return state.join(n, ["security_id", "as_of"], "left").select("security_id", "as_of", "last_session", "spot", F.col("atr").alias("atr20"), F.col("k").alias("n_bars"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.lit(DEFAULT.paths).cast("long").alias("n_paths"), F.lit(DEFAULT.lookback).cast("long").alias("lookback"))


register("agg_5_run_summary", _runs, query("SELECT s.security_id, s.as_of, s.as_of AS last_session, round(s.spot, 6) AS spot, round(s.atr, 6) AS atr20, s.k AS n_bars, count(c.level) AS n_candidates, 10000::BIGINT AS n_paths, 500::BIGINT AS lookback FROM state s LEFT JOIN cand c USING (security_id, as_of) GROUP BY ALL", "cand"))
register("win_1_true_range", lambda s, d: indicators.true_range(bars(s, d)).select("security_id", "session", "tr"), query("SELECT security_id, session, round(tr, 6) AS tr FROM ranged", "ranged"))
register("win_2_wilder_atr", lambda s, d: ranged(s, d).select("security_id", "session", "atr"), query("SELECT security_id, session, round(atr, 6) AS atr FROM atrs", "atrs"))
register("win_3_atr_at_as_of", lambda s, d: state_of(ranged(s, d)).where("atr is not null").select("security_id", "as_of", "atr"), query("SELECT security_id, as_of, round(atr, 6) AS atr FROM state WHERE atr IS NOT NULL", "state"))
register(
    "win_4_swing_test",
    lambda s, d: (lambda w: bars(s, d).withColumns({"hh": F.max("high").over(w), "ll": F.min("low").over(w), "c": F.count("*").over(w)}))(indicators.by_session().rowsBetween(-3, 3)).where("c = 7 and (high >= hh or low <= ll)").select("security_id", "session", (F.col("high") >= F.col("hh")).alias("is_high"), (F.col("low") <= F.col("ll")).alias("is_low")),
    query("SELECT security_id, session, high >= hh AS is_high, low <= ll AS is_low FROM swing_bars WHERE c = 7 AND (high >= hh OR low <= ll)", "swing_bars"),
)
SW = ["security_id", "t", "side", "level", "formed_at", "k_atr", "confirm_sessions"]
register("win_5_swing_confirmation", lambda s, d: levels.swings(ranged(s, d)).select(*SW, "seen_at"), query(f"SELECT security_id, t, side, {R('level')}, formed_at, k_atr, confirm_sessions, seen_at FROM swings", "swings"))
register("win_6_swing_available_at", lambda s, d: levels.swings(ranged(s, d)).select("security_id", "t", "side", "k_atr", "available_at"), query("SELECT s.security_id, s.t, s.side, s.k_atr, b.available_at FROM swings s JOIN bars b ON b.security_id = s.security_id AND b.k = s.t + s.confirm_sessions", "swings"))
register("win_7_bar_triples", lambda s, d: indicators.triples(bars(s, d)), query("SELECT security_id, session, k, round(h, 12) AS h, round(l, 12) AS l, round(c, 12) AS c FROM triples", "triples"), 12)


def _walks(s, d) -> DataFrame:
    series = ranged(s, d)
    return touch.path_steps(state_of(series), indicators.triples(series))


register("win_8_paths", _walks, query("SELECT security_id, as_of, step, round(max(high), 6) AS high, round(min(low), 6) AS low, round(avg(close), 6) AS close FROM (SELECT security_id, as_of, unnest([1, 2, 3, 4, 5])::BIGINT AS step, unnest([h1, h2, h3, h4, h5]) AS high, unnest([l1, l2, l3, l4, l5]) AS low, unnest([c1, c2, c3, c4, c5]) AS close FROM walked) GROUP BY ALL", "walked"))
register("srt_1_nearest_zones", lambda s, d: zones_and_state(s, d)[2].select(*ZONE), query(f"SELECT security_id, as_of, zone_id, side, {R('lower', 'upper', 'center', 'distance_atr', 'width_atr')}, n_sources, n_families, sources FROM zones", "zones"))
register(
    "srt_2_zone_order",
    lambda s, d: zones_and_state(s, d)[2].select("security_id", "as_of", "zone_id", F.row_number().over(Window.partitionBy("security_id", "as_of").orderBy(F.abs("distance_atr"), F.desc("side"), "center")).alias("rank")),
    query("SELECT security_id, as_of, zone_id, row_number() OVER (PARTITION BY security_id, as_of ORDER BY abs(distance_atr), side DESC, center) AS rank FROM zones", "zones"),
)
register("srt_5_last_500", lambda s, d: indicators.triples(bars(s, d)).withColumn("n", F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("k")))).where("n <= 500").drop("n"), query("SELECT security_id, session, k, round(h, 12) AS h, round(l, 12) AS l, round(c, 12) AS c FROM triples QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY k DESC) <= 500", "triples"), 12)
register("set_1_all_candidates", lambda s, d: candidates(s, d).select(*CAND), query(f"SELECT security_id, as_of, {R('level', 'lower', 'upper')}, source, family FROM cand", "cand"))
register("set_2_rungs_once", lambda s, d: candidates(s, d).where("family = 'B'").select("security_id", "as_of", "level", "step", "rank"), query("SELECT security_id, as_of, round(level, 6) AS level, step, rank::BIGINT AS rank FROM rungs", "rungs"))
register(
    "fn_1_ladder_steps", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.posexplode(levels.ladder_steps(F.col("p_retailprice")))).select("p_partkey", F.col("pos").alias("rank"), F.col("col").alias("step")),
    "SELECT p_partkey, rank::BIGINT AS rank, round(step, 6) AS step FROM (SELECT p_partkey, unnest([0, 1, 2, 3]) AS rank, unnest([e / 10, e / 20, e / 100, e / 100 / 2]) AS step FROM (SELECT p_partkey, pow(10.0::DOUBLE, floor(log10(p_retailprice))) AS e FROM part WHERE p_retailprice > 0))",
)
register(
    "fn_2_rungs_within", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.explode(levels.rungs_within(F.col("p_retailprice"), F.lit(15.0), F.lit(5.0))).alias("rung")),
    "SELECT p_partkey, round(rung, 6) AS rung FROM (SELECT p_partkey, unnest(range(ceil((p_retailprice - 15) / 5 - 1e-9)::BIGINT, floor((p_retailprice + 15) / 5 + 1e-9)::BIGINT + 1)) * 5.0::DOUBLE AS rung FROM part) WHERE rung > 0",
)
register("fn_3_round_candidates", lambda s, d: candidates(s, d).where("family = 'B'").select(*CAND, "rank"), query(f"SELECT security_id, as_of, {R('level')}, round(level - 0.1 * atr, 6) AS lower, round(level + 0.1 * atr, 6) AS upper, 'round_' || regexp_replace(printf('%.6f', step), '\\.?0+$', '') AS source, 'B' AS family, rank::BIGINT AS rank FROM rungs", "rungs"))
register("fn_4_swing_columns", lambda s, d: levels.swings(ranged(s, d)).select("security_id", "formed_at", F.concat(F.lit("swing_"), "side", F.lit("_k"), levels.short_number(F.col("k_atr"))).alias("source"), "atr_at_formation"), query("SELECT security_id, formed_at, 'swing_' || side || '_k' || regexp_replace(printf('%.6f', k_atr), '\\.?0+$', '') AS source, round(atr_at_formation, 6) AS atr_at_formation FROM swings", "swings"))
register("cmp_1_clusters", lambda s, d: zones.clustered(candidates(s, d)).select("security_id", "as_of", "level", "source", "cluster"), query("SELECT security_id, as_of, round(level, 6) AS level, source, cluster FROM members", "members"))
register("cmp_3_zone_touch_probability", touched, query(TOUCH.format("side, " + R("lower", "upper", "center", "p_touch", "p_low_below", "p_high_above")), "zones", "walked"))
