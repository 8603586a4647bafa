"""The stream operators over a table: the same functions give the same rows in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import bars as S
from ..streaming import approach as AP
from ..streaming import states as T
from . import features as FQ
from .core import rounded
from .features import _touches

QUERIES, ORACLE = {}, {}


def ticks(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def register(name, run, sql):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    ORACLE[name] = sql


_sizes = {"": "1 day", "_5m": "5 minutes", "_15m": "15 minutes", "_30m": "30 minutes", "_1h": "1 hour", "_4h": "4 hours"}
for _name, _size in _sizes.items():
    register(
        f"str_1_tick_bars{_name}", lambda s, d, size=_size: S.bars(ticks(s, d), size),
        f"SELECT event_type AS key, time_bucket(INTERVAL '{_size}', ts) AS start, time_bucket(INTERVAL '{_size}', ts) + INTERVAL '{_size}' AS \"end\", arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume, count(*) AS n FROM events GROUP BY ALL",
    )
register("str_2_rolling_vwap", lambda s, d: S.rolling_vwap(ticks(s, d), "30 minutes", "10 minutes"), "SELECT event_type AS key, start, round(avg(value), 6) AS vwap, count(*)::DOUBLE AS volume FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) - unnest([0, 1, 2]) * INTERVAL 10 MINUTE AS start FROM events) GROUP BY ALL")
register("str_3_flow_imbalance", lambda s, d: S.imbalance(s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 7).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", "ask").otherwise("bid").alias("side"), F.col("value").alias("size"))), "SELECT user_id % 7 AS key, time_bucket(INTERVAL 30 MINUTE, ts) AS start, round((sum(value * (event_type <> 'click')::INT) - sum(value * (event_type = 'click')::INT)) / nullif(sum(value), 0), 6) AS imbalance FROM events GROUP BY ALL")
ZONES = "SELECT * FROM (VALUES ('click', 'c1', 1.0, 2.0), ('click', 'c2', 50.0, 51.0), ('view', 'v1', 0.5, 0.7)) t(key, zone_id, lower, upper)"


def _alerts(s, d, files=1):
    """What a stream of all ticks, in ``files`` batches that come in any order, reports as touched."""
    zones = s.sql(ZONES).select("key", "zone_id", *(F.col(c).cast("double").alias(c) for c in ("lower", "upper")))
    return T.run_once(ticks(s, d), lambda live: S.alerts(live, zones), files)


register("str_4_touches", lambda s, d: _alerts(s, d, 4).select("key", "zone_id"), f"SELECT DISTINCT z.key, z.zone_id FROM events JOIN ({ZONES}) z ON event_type = z.key AND value BETWEEN lower AND upper")
register(
    "str_4_first_touches", _alerts,
    f"SELECT key, zone_id, ts, round(price, 6) AS price FROM (SELECT z.key, z.zone_id, ts, value AS price, row_number() OVER (PARTITION BY z.key, z.zone_id ORDER BY ts, value) AS n FROM events JOIN ({ZONES}) z ON event_type = z.key AND value BETWEEN lower AND upper) WHERE n = 1",
)
register("str_5_zone_states", lambda s, d: T.run_once(_touches(s, d), T.zone_states).where("n is not null"), FQ.ORACLE["cmp_5_zone_states"])


_SENTINEL = "TIMESTAMP '2025-01-01 00:00:00'"


def _approaches(s, d):
    """Events as closed sessions of their user's zone; a row of another zone at the end moves the watermark past all that is due."""
    e = s.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("user_id").cast("long").alias("zone"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("n"), (F.col("value") / 10).cast("double").alias("distance"))
    last = s.sql(f"SELECT -1L AS zone, {_SENTINEL} AS ts, 0L AS n, 0.0D AS distance")
    before = s.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", AP.PROVIDER)
    try:
        return T.run_once(rows.unionByName(last), AP.approaches).where("zone >= 0")
    finally:
        s.conf.set("spark.sql.streaming.stateStore.providerClass", before)


register(
    "str_5_approaches", _approaches,
    f"""WITH r AS (SELECT user_id::BIGINT AS zone, ts, event_id AS n, abs(value / 10) <= 1 AS near FROM events),
    v AS (SELECT *, sum(near::INT) OVER (PARTITION BY zone ORDER BY ts, n ROWS UNBOUNDED PRECEDING) AS visit FROM r),
    f AS (SELECT *, sum((NOT near)::INT) OVER (PARTITION BY zone, visit ORDER BY ts, n ROWS UNBOUNDED PRECEDING) AS far FROM v),
    g AS (SELECT *, lag(far) OVER (PARTITION BY zone ORDER BY ts, n) AS before FROM f)
    SELECT zone, ts, CASE WHEN near THEN 'APPROACHING' ELSE 'UNTESTED' END AS state FROM g WHERE CASE WHEN near THEN visit = 1 OR before >= 5 ELSE visit > 0 AND far = 5 END
    UNION ALL SELECT zone, max(ts) + INTERVAL 84 DAY, 'RETIRED' FROM r GROUP BY zone""",
)


def _restated(s, d):
    """The day's bars of all ticks, streamed against bars of which every close of a click differs and those of errors are not known."""
    bars = S.bars(ticks(s, d)).select("key", F.col("start").alias("ts"), "start", "close")
    known = bars.where("key != 'error'").withColumn("close", F.when(F.col("key") == "click", F.col("close") + 1).otherwise(F.col("close")))
    folder = T.shared_folder(s)
    bars.write.parquet(f"{folder}/in")
    S.route_restated(s.readStream.schema(bars.schema).parquet(f"{folder}/in"), known, f"{folder}/good", f"{folder}/aside", f"{folder}/checkpoint").awaitTermination()
    both = [s.read.schema(bars.schema).parquet(f"{folder}/{x}").withColumn("kept", F.lit(x)) for x in ("good", "aside")]
    return both[0].unionByName(both[1]).select("key", "start", "close", "kept")


register("str_6_restated", _restated, "SELECT key, start, round(close, 6) AS close, CASE key WHEN 'click' THEN 'aside' ELSE 'good' END AS kept FROM (SELECT event_type AS key, time_bucket(INTERVAL 1 DAY, ts) AS start, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL) WHERE key IN ('click', 'error')")
