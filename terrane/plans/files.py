"""Queries of files: tables are written as the outside writes them, read back by the sources, and compared with what they were made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators, touch, zones
from ..params import DEFAULT
from ..sources import lake, vendors
from ..sources.derived import bars
from ..streaming.states import shared_folder
from . import core
from .core import R, candidates, ranged, rounded, state_of, zones_and_state
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


def _columns(dialect):
    """The dialect's file columns from bars; what bars do not have is 0."""
    own = {"date": F.col("session").cast("string"), **{c: F.col(c) for c in ("open", "high", "low", "close", "volume")}}
    return [own.get(c.lower(), F.lit(0)).alias(c) for c in vendors.HEADERS[dialect].split(",")]


def _written(s, d, dialect):
    """A file of the dialect for each security; on every tenth session a first version of the row, and rows without a close at the start of each month."""
    rows = bars(s, d).withColumn("version", F.explode(F.when(F.col("k") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    rows = rows.withColumn("close", F.when(F.dayofmonth("session") == 1, F.lit(None)).when(F.col("version") == 0, F.col("close") + 1).otherwise(F.col("close")))
    path = shared_folder(s)
    rows.repartition("security_id").sortWithinPartitions("security_id", "session", "version").select("security_id", *_columns(dialect)).write.option("header", True).partitionBy("security_id").csv(path)
    parsed, _ = vendors.parse(vendors.read_lines(s, f"{path}/*/*.csv"), dialect)
    got = vendors.last_of_session(parsed)
    return got.select(F.regexp_extract("path", "security_id=([0-9]+)", 1).cast("long").alias("security_id"), "session", "open", "high", "low", "close", "volume")


_close = "CASE WHEN day(session) = 1 THEN NULL ELSE close END"
for _n, _dialect in (("src_1", "stooq"), ("src_2", "tiingo"), ("src_3", "yahoo")):
    register(f"{_n}_{_dialect}_files", lambda s, d, x=_dialect: _written(s, d, x), query(f"SELECT security_id, session, {R('open', 'high', 'low')}, round({_close}, 6) AS close, round(volume, 6) AS volume FROM bars" + (" WHERE day(session) <> 1" if _dialect == "yahoo" else ""), "bars"))


def _rejected(s, d):
    """The files of two dialects, read as one of them."""
    path = shared_folder(s)
    rows = bars(s, d)
    for x in ("stooq", "yahoo"):
        rows.repartition("security_id").select("security_id", *_columns(x)).write.option("header", True).partitionBy("security_id").csv(f"{path}/{x}")
    _, bad = vendors.parse(vendors.read_lines(s, [f"{path}/stooq/*/*.csv", f"{path}/yahoo/*/*.csv"]), "stooq")
    return bad.select(F.regexp_extract("path", "/(stooq|yahoo)/", 1).alias("dialect"), F.regexp_extract("path", "security_id=([0-9]+)", 1).cast("long").alias("security_id"), "reason")


register("src_4_rejected_files", _rejected, query("SELECT DISTINCT 'yahoo' AS dialect, security_id, 'not stooq' AS reason FROM bars", "bars"))
register(
    "src_5_snapshots", lambda s, d: vendors.pick_snapshots(s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("/raw/c"), (F.col("o_custkey") % 97).cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 11 == 0, ".txt").otherwise(".csv")).alias("path")).distinct(), F.lit("1994-06-30").cast("date")).select("symbol", "fetched"),
    "SELECT 'c' || c AS symbol, coalesce(max(day) FILTER (day <= DATE '1994-06-30'), max(day)) AS fetched FROM (SELECT o_custkey % 97 AS c, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 11 <> 0) GROUP BY c",
)
register(
    "src_6_symbols", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "HK").otherwise("US").alias("market"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" b"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string")).alias("ticker")).select("c_custkey", *(vendors.symbol(p, F.col("ticker"), F.col("market")).alias(p) for p in ("stooq", "tiingo", "yahoo"))),
    "SELECT c_custkey, code || CASE market WHEN 'HK' THEN '.HK' ELSE '.US' END AS stooq, CASE market WHEN 'US' THEN code END AS tiingo, code || CASE market WHEN 'HK' THEN '.HK' ELSE '' END AS yahoo FROM (SELECT *, CASE WHEN market = 'HK' AND c_custkey % 3 <> 0 AND length(t) < 4 THEN lpad(t, 4, '0') ELSE t END AS code FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'HK' ELSE 'US' END AS market, CASE WHEN c_custkey % 3 = 0 THEN 'B' || c_custkey ELSE c_custkey::VARCHAR END AS t FROM customer))",
)


def _lake(s, d):
    """Bars in the lake by market and year; one market is written again, with other volumes."""
    rows = bars(s, d).select(F.when(F.col("security_id") < 3, "US").otherwise("HK").alias("market"), F.year("session").alias("year"), "security_id", "session", "close", "volume")
    path = shared_folder(s)
    lake.write_lake(rows, path)
    lake.write_lake(rows.where("market = 'HK'").withColumn("volume", F.col("volume") * 2), path)
    return lake.read_lake(s, path, ["US", "HK"], 1993, 1999)


register("src_8_lake", _lake, query("SELECT CASE WHEN security_id < 3 THEN 'US' ELSE 'HK' END AS market, year(session) AS year, security_id, session, round(close, 6) AS close, round(volume * CASE WHEN security_id < 3 THEN 1 ELSE 2 END, 6) AS volume FROM bars WHERE year(session) BETWEEN 1993 AND 1999", "bars"))


def _last(s, d):
    """The state of each security's last week, of which dumps are made."""
    series = ranged(s, d)
    state = state_of(series)
    last = state.groupBy("security_id").agg(F.max("as_of").alias("as_of"))
    return series, state.join(last, ["security_id", "as_of"])


def _dumped(s, d):
    """The six tables of the last forecast of every security, as CSV files, and how many rows come back."""
    series, state = _last(s, d)
    found = core.levels.candidates(series, state)
    tables = {"run": state, "bars": series.select("security_id", "session", "open", "high", "low", "close", "volume", "tr", "atr"), "candidates": found, "zones": zones.zones(found), "triples": indicators.triples(series), "paths": touch.path_rows(state, indicators.triples(series))}
    path = shared_folder(s)
    lake.dump(tables, path)
    back = [s.read.option("header", True).csv(f"{path}/{t}").groupBy("security_id").agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), F.col("security_id").cast("long").alias("security_id"), "n") for t in tables]
    out = back[0]
    for b in back[1:]:
        out = out.unionByName(b)
    return out


_LAST = {"fin": "SELECT security_id, max(as_of) AS as_of FROM state GROUP BY security_id"}
_fin = lambda t, of: f"SELECT '{t}' AS \"table\", security_id, count(*) AS n FROM {of} JOIN fin USING (security_id, as_of) GROUP BY security_id"
register(
    "src_10_dump", _dumped,
    query(" UNION ALL ".join([_fin("run", "state"), "SELECT 'bars', security_id, count(*) FROM bars GROUP BY security_id", _fin("candidates", "cand"), _fin("zones", "zones"), "SELECT 'triples', security_id, count(*) FROM triples GROUP BY security_id", f"SELECT 'paths', security_id, {DEFAULT.paths * DEFAULT.horizon} FROM fin"]), "zones", "triples", extra=_LAST),
)


def _documents(s, d):
    series, state, found = zones_and_state(s, d)
    docs = lake.forecast_documents(state, found.withColumn("p_touch", F.lit(0.5)))
    path = shared_folder(s)
    docs.write.parquet(path)
    return lake.flattened(s.read.parquet(path)).select("security_id", "as_of", "spot", "zone_id", "side", "lower", "upper", "center")


register("src_11_forecast_documents", _documents, query(f"SELECT security_id, as_of, zone_id, side, {R('spot', 'lower', 'upper', 'center')} FROM zones", "zones"))


def _trials(s, d):
    """A trial for each event type and day, appended in two runs."""
    rows = s.read.parquet(f"{d}/events.parquet").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("sharpe"), F.max("ts").cast("timestamp").alias("at")).select(F.concat_ws("@", "event_type", F.col("day").cast("string")).alias("trial"), "at", "sharpe", F.lit("{}").alias("params"))
    path = shared_folder(s)
    for half in (0, 1):
        lake.append_trials(rows.where(F.pmod(F.crc32(F.col("trial").cast("binary")), F.lit(2)) == half), path)
    return lake.read_trials(s, path).select("trial", "sharpe")


register("src_12_trials", _trials, "SELECT event_type || '@' || CAST(ts AS DATE) AS trial, round(avg(value), 6) AS sharpe FROM events GROUP BY event_type, CAST(ts AS DATE)")
