import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from terrane.operators import features, pit
from terrane.plans.stream import ticks
from terrane.sources import lake, vendors
from terrane.streaming import bars as stream
from terrane.streaming import states

FILES = {
    "stooq/A/2026-01-02.csv": ("stooq", "Date,Open,High,Low,Close,Volume\n2026-01-01,1,2,0.5,1.5,10\n2026-01-02,1,2,0.5,,10\n2026-01-01,1,2,0.5,1.7,11\n"),
    "tiingo/B/2026-01-02.csv": ("tiingo", vendors.HEADERS["tiingo"] + "\n2026-01-01T00:00:00.000Z,4,3,1,2,9,0,0,0,0,0,0,1\n"),
    "yahoo/C/2026-01-02.csv": ("yahoo", "Date,Open,High,Low,Close,Adj Close,Volume\n2026-01-01,1,2,0.5,1.5,1.5,10\n2026-01-02,1,,0.5,1,,\n"),
    "yahoo/D/2026-01-02.csv": ("yahoo", "<html>\n<body>\n"),
}


@pytest.fixture
def folder(tmp_path):
    for name, (_, text) in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_dialects(spark, folder):
    got = {}
    for d in vendors.HEADERS:
        bars, bad = vendors.parse(vendors.read_lines(spark, f"{folder}/{d}/*/*.csv"), d)
        got[d] = sorted((str(r.session), r.open, r.high, r.low, r.close, r.volume) for r in vendors.last_of_session(bars).collect())
        assert [r.reason for r in bad.collect()] == (["not yahoo"] if d == "yahoo" else [])
    assert got["stooq"] == [("2026-01-01", 1.0, 2.0, 0.5, 1.7, 11.0), ("2026-01-02", 1.0, 2.0, 0.5, None, 10.0)]
    assert got["tiingo"] == [("2026-01-01", 2.0, 3.0, 1.0, 4.0, 9.0)] and got["yahoo"] == [("2026-01-01", 1.0, 2.0, 0.5, 1.5, 10.0)]


def test_snapshots_and_symbols(spark):
    files = spark.createDataFrame([(f"/raw/s/{s}/{d}.csv",) for s, d in (("A", "2026-01-01"), ("A", "2026-02-01"), ("A", "notes"), ("B", "2026-03-01"))], "path string")
    got = {r.symbol: str(r.fetched) for r in vendors.pick_snapshots(files, F.lit("2026-01-15").cast("date")).collect()}
    assert got == {"A": "2026-01-01", "B": "2026-03-01"}
    rows = spark.createDataFrame([("5", "HK"), ("12345", "HK"), ("aapl", "US"), ("x", "JP")], "t string, m string")
    assert [r[0] for r in rows.select(vendors.symbol("yahoo", F.col("t"), F.col("m"))).collect()] == ["0005.HK", "12345.HK", "AAPL", None]


def test_point_in_time_cut(spark):
    day = datetime.date(2026, 9, 11)
    bars = spark.createDataFrame([(1, day, 1.0, 1.0, 1.0, float("nan"), 1.0, datetime.datetime(2026, 9, 11, 20))], "security_id long, session date, open double, high double, low double, close double, volume double, available_at timestamp")
    now = lambda t: F.lit(t).cast("timestamp")
    assert pit.visible(bars, F.lit("2026-09-11"), now("2026-09-11 15:30:00")).count() == 0
    assert pit.visible(bars, F.lit("2026-09-11"), now("2026-09-11 20:00:00")).count() == 1
    assert pit.checked_bars(bars).head().close is None
    with pytest.raises(ValueError):
        pit.checked_bars(bars.drop("low"))


def test_lake_documents_trials(spark, tmp_path):
    rows = spark.createDataFrame([("US", 2026, 1, "2026-01-02", 1.0), ("HK", 2026, 2, "2026-01-02", 2.0)], "market string, year int, security_id long, session string, close double")
    lake.write_lake(rows, f"{tmp_path}/lake")
    lake.write_lake(rows.where("market = 'US'").withColumn("close", F.lit(9.0)), f"{tmp_path}/lake")
    assert {(r.market, r.close) for r in spark.read.parquet(f"{tmp_path}/lake").collect()} == {("US", 9.0), ("HK", 2.0)}
    run = spark.sql("select 1L as security_id, date '2026-01-02' as as_of, 100.0D as spot, 2.0D as atr")
    zones = spark.sql("select 1L as security_id, date '2026-01-02' as as_of, x as zone_id, 'support' as side, 1.0D as lower, 2.0D as upper, 1.5D as center, y as distance_atr, 0.5D as p_touch from values ('b', -2.0D), ('a', -1.0D) t(x, y)")
    docs = lake.forecast_documents(run, zones)
    assert [r.zone_id for r in lake.flattened(docs).collect()] == ["a", "b"]
    lake.dump({"run": run}, f"{tmp_path}/dump")
    assert spark.read.option("header", True).csv(f"{tmp_path}/dump/run").count() == 1
    trials = spark.sql("select 'a' as trial, timestamp '2026-01-01 00:00:00' as at, 1.0D as sharpe, '{}' as params")
    lake.append_trials(trials, f"{tmp_path}/trials")
    lake.append_trials(trials, f"{tmp_path}/trials")
    assert lake.read_trials(spark, f"{tmp_path}/trials").count() == 2


def run_stream(spark, sf, tmp_path, make):
    source = f"{tmp_path}/in"
    table = ticks(spark, sf)
    table.repartition(1).sortWithinPartitions("ts").write.parquet(source)
    live = spark.readStream.schema(table.schema).parquet(source)
    q = make(live).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return table, spark.sql("select * from out")


def test_stream_bars_are_the_closed_batch_bars(spark, sf, tmp_path):
    table, out = run_stream(spark, sf, tmp_path, stream.bars)
    got = {tuple(r) for r in out.collect()}
    want = {tuple(r) for r in stream.bars(table).collect()}
    last = max(w[2] for w in want)
    assert got and got <= want and {w for w in want - got} <= {w for w in want if w[2] == last}


def test_stream_alerts(spark, sf, tmp_path):
    zones = spark.sql("select * from values ('click', 'c', 0.0D, 1000.0D), ('view', 'low', -5.0D, -1.0D), ('error', 'e', 0.0D, 1000.0D) t(key, zone_id, lower, upper)")
    table, out = run_stream(spark, sf, tmp_path, lambda live: stream.alerts(live, zones))
    got = [(r.key, r.zone_id, r.ts) for r in out.collect()]
    seen = {k: {r.ts for r in table.where(F.col("key") == k).collect()} for k in ("click", "error")}
    assert sorted(g[:2] for g in got) == [("click", "c"), ("error", "e")] and all(t in seen[k] for k, _, t in got)


def test_alerts_come_once_in_the_life_of_a_stream(spark, tmp_path):
    """Weeks and batches later a touched zone is not reported again; one that was not touched before is; of one batch's touches the earliest counts, at the lower price."""
    at = lambda day, minute=0: datetime.datetime(2024, 1, day, 12, minute)
    zones = spark.sql("select * from values ('k', 'a', 1.0D, 2.0D), ('k', 'b', 5.0D, 6.0D), ('m', 'a', 1.0D, 2.0D) t(key, zone_id, lower, upper)")
    parts = [[("k", at(1, 9), 1.5), ("k", at(1, 3), 1.75), ("k", at(1, 3), 1.25), ("k", at(1), 3.0)], [("k", at(20), 1.5), ("k", at(20), 5.5), ("m", None, None)], [("m", at(25), 2.0), ("k", at(28), 1.0)]]
    in_parts(spark, parts, "key string, ts timestamp, price double", f"{tmp_path}/in")
    live = spark.readStream.schema("key string, ts timestamp, price double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.alerts(live, zones).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("k", "a", at(1, 3), 1.25), ("k", "b", at(20), 5.5), ("m", "a", at(25), 2.0)]


def test_restated_bars_go_aside(spark, tmp_path):
    new = spark.sql("select 'k' as key, x as start, y as close from values (1, 1.0D), (2, 2.5D), (3, 3.0D), (4, null) t(x, y)")
    new.write.parquet(f"{tmp_path}/in")
    known = spark.sql("select 'k' as key, x as start, y as close from values (1, 1.0D), (2, 2.0D) t(x, y)")
    for turn in range(2):  # the second time as after a failure: the batch is run again
        live = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
        stream.route_restated(live, known, f"{tmp_path}/good", f"{tmp_path}/aside", f"{tmp_path}/ck{turn}").awaitTermination(60)
        assert [r.start for r in spark.read.parquet(f"{tmp_path}/good").collect()] == [3] and sorted(r.start for r in spark.read.parquet(f"{tmp_path}/aside").collect()) == [2, 4]


def in_parts(spark, rows, schema, folder):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_zone_states_online_are_those_of_the_batch(spark, tmp_path):
    r = random.Random(3)
    day = lambda i: datetime.datetime(2026, 1, 1) + datetime.timedelta(i)
    rows = [(r.randint(1, 6), day(i), i, r.choice(["touch", "hold", "hold", "break"])) for i in range(60)] + [(9, day(0), 100, "hold"), (1, day(200), 101, "touch")]
    rows.sort(key=lambda x: x[1])
    schema = "zone long, ts timestamp, n long, outcome string"
    live = states.zone_states(in_parts(spark, [rows[:20], rows[20:21], rows[21:61], rows[61:]], schema, f"{tmp_path}/in"))
    q = live.writeStream.format("memory").queryName("zones").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.sql("select * from zones").collect()
    want = features.zone_states(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(x) for x in got if x.n is not None) == sorted(tuple(x) for x in want)
    over = {x.zone: x for x in got if x.n is None}
    assert 9 in over and over[9].state == "RETIRED" and over[9].ts == day(84)


def test_late_rows_are_counted(spark, tmp_path):
    t = lambda h: datetime.datetime(2026, 1, 1, h)
    parts = [[("k", t(1), 1.0, 1.0, 1)], [("k", t(9), 2.0, 1.0, 2)], [("k", t(10), 3.0, 1.0, 3)], [("k", t(2), 3.0, 1.0, 4), ("k", t(11), 3.0, 1.0, 5)]]
    live = in_parts(spark, parts, "key string, ts timestamp, price double, volume double, seq long", f"{tmp_path}/in")
    q = stream.bars(live, "1 hour").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert stream.too_late(q) == 1 and t(2) not in {r.start for r in spark.sql("select * from late").collect()}


def test_paged_pull_of_a_sql_table(spark):
    """Written to an embedded database, pulled in four ranges by number and by date, and resumed with new keys alone."""
    import datetime

    from pyspark.sql import functions as F

    url, driver = "jdbc:derby:memory:bars;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1000).select(F.expr("nullif(id + 1, -1)").alias("ID"), F.expr("nullif(date_add(DATE '2026-01-01', CAST(id % 90 AS INT)), DATE '1900-01-01')").alias("DAY_"), (F.col("id") / 8).cast("float").alias("PX"))
    rows.write.jdbc(url, "BARS", mode="overwrite", properties={"driver": driver})
    want = sorted(tuple(r) for r in rows.select("ID", "DAY_", F.col("PX").cast("double")).collect())
    for column in ("ID", "DAY_"):
        got = lake.pull_jdbc(spark, url, "BARS", column, 4, driver=driver)
        sizes = got.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert sorted(tuple(r) for r in got.collect()) == want and dict(got.dtypes)["PX"] == "double" and len(sizes) == 4 and min(sizes) > 150
    last = got.agg(F.max("ID")).first()[0]
    assert lake.pull_jdbc(spark, url, "BARS", "ID", 4, after=str(last), driver=driver) is None
    spark.createDataFrame([(1001, datetime.date(2026, 5, 1), 1.5), (1002, datetime.date(2026, 5, 1), 2.5), (1003, datetime.date(2026, 5, 2), 3.5)], "ID long, DAY_ date, PX float").write.jdbc(url, "BARS", mode="append", properties={"driver": driver})
    assert sorted(r.ID for r in lake.pull_jdbc(spark, url, "BARS", "ID", 2, after=str(last), driver=driver).collect()) == [1001, 1002, 1003]
    assert sorted(r.ID for r in lake.pull_jdbc(spark, url, "BARS", "DAY_", 2, after="DATE('2026-05-01')", driver=driver).collect()) == [1003]
    spark.createDataFrame([(None, None, 9.0)], "ID long, DAY_ date, PX float").write.jdbc(url, "BARS", mode="append", properties={"driver": driver})
    assert lake.pull_jdbc(spark, url, "BARS", "ID", 4, driver=driver).count() == 1004


def test_approaches_of_late_and_missing_sessions(spark):
    """The stream, fed out of order and with gaps, equals the table; zones retire by gap and at the end."""
    import datetime

    from terrane.streaming import approach

    r = random.Random(5)
    start = datetime.datetime(2026, 1, 1)
    rows = []
    for zone in range(8):
        day = 0
        for n in range(60):
            day += r.choice([1, 1, 1, 2, 5] + ([90] if zone > 5 and n == 30 else []))
            rows.append((zone, start + datetime.timedelta(days=day, hours=r.randint(0, 23)), n, r.choice([0.2, 1.0, -0.5, 1.5, -3.0, 2.0, 2.0, 2.0])))
    rows.append((9, start, 0, 9.0))
    end = (99, datetime.datetime(2030, 1, 1), 0, 0.0)
    late = "3 days"
    shuffled = sorted(rows, key=lambda x: x[1] + datetime.timedelta(hours=r.randint(0, 70)))
    schema = "zone long, ts timestamp, n long, distance double"
    folder = states.shared_folder(spark)
    for part in (*(shuffled[i : i + 60] for i in range(0, len(shuffled), 60)), [end]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in the order of their time
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", approach.PROVIDER)
    try:
        live = approach.approaches(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), late)
        live.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted((x.zone, x.ts, x.state) for x in spark.read.parquet(f"{folder}/out").where("zone < 99").collect())
    table = approach.approach_table(spark.createDataFrame(rows, schema), F.lit("2029-12-29").cast("timestamp"))
    want = sorted((x.zone, x.ts, x.state) for x in table.collect())
    assert got == want and sum(s == "RETIRED" for _, _, s in got) == 9 and sum(s == "UNTESTED" for _, _, s in got) > 3
    plain = []
    for zone in range(8):
        state, out, last = "UNTESTED", 0, None
        for _, ts, _, distance in sorted(x for x in rows if x[0] == zone):
            if last and ts - last > datetime.timedelta(84):
                break
            last = ts
            state, out, changed = approach.moved(state, out, distance)
            plain += [(zone, ts, state)] if changed else []
        plain.append((zone, last + datetime.timedelta(84), "RETIRED"))
    assert got == sorted([*plain, (9, start + datetime.timedelta(84), "RETIRED")])
