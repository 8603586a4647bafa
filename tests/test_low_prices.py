"""Prices at and below zero: logarithms and quotients that are no finite numbers, against the same SQL."""

import datetime
import math
import os

import pytest
from pyspark.sql import functions as F

from terrane.functions.floats import ln, ratio, spread
from terrane.operators import series
from terrane.plans import registry
from tests.oracle import TABLES, differences

# A Tuesday that is the seventh session of fifty of two securities (a split of win_15_split_state), and the day after.
DOWN, UP = "1995-09-19", "1995-09-20"
#: Cents at which a security closes on the first day; their mean is negative.
CLOSES = {0: 0, 1: 0, 2: -400, 3: -1000, 4: 400}


@pytest.fixture(scope="session")
def low(spark, sf, tmp_path_factory):
    """The smallest tables with ticks more in two sessions: in the first every security falls to ``CLOSES``, in the second it comes back."""
    import duckdb

    out = str(tmp_path_factory.mktemp("low"))
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{sf}/{t}.parquet", f"{out}/{t}.parquet")
    con = duckdb.connect()
    places = f"JOIN '{sf}/supplier.parquet' ON l_suppkey = s_suppkey JOIN '{sf}/nation.parquet' ON s_nationkey = n_nationkey"
    facts = con.execute(f"SELECT n_regionkey, 20000 + CAST(sum((round(l_discount * 100) - 5) * 4) FILTER (l_shipdate < TIMESTAMP '{UP} 00:00:00') AS BIGINT), min(s_suppkey) FROM '{sf}/lineitem.parquet' {places} GROUP BY 1").fetchall()
    con.execute(f"CREATE TABLE line AS SELECT * FROM '{sf}/lineitem.parquet'")
    for security, cents, supplier in facts:
        whole, rest = divmod(int(cents) - CLOSES[security], 20)
        for day, sign in ((DOWN, -1), (UP, 1)):
            step = f"(5 + {sign} * CASE WHEN i < {whole} THEN 5 ELSE {rest // 4} END) / 100"
            con.execute(f"INSERT INTO line BY NAME SELECT 1000000000 + i AS l_orderkey, 1 AS l_partkey, {supplier} AS l_suppkey, 1 AS l_linenumber, 1.0 AS l_quantity, 100.0 AS l_extendedprice, {step} AS l_discount, 0.0 AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '{day} 00:00:00' AS l_shipdate FROM range({whole + 1}) t(i)")
    con.execute(f"COPY line TO '{out}/lineitem.parquet' (FORMAT parquet)")
    return out


def test_bars_reach_zero(spark, low):
    bars = registry.QUERIES["src_7_bars"](spark, low)
    at = {r.security_id: r.close for r in bars.where(F.col("session") == datetime.date.fromisoformat(DOWN)).collect()}
    assert at == {k: v / 100 for k, v in CLOSES.items()} and bars.where("low = 0").count() > 1 and bars.where("low < 0").count() > 1


NAMES = """win_13_volatility win_20_vol_decile agg_29_breadth win_19_factors cmp_13_feature_matrix win_16_momentum jon_17_relative_strength win_18_regimes fn_20_spread_proxy win_15_split_state fn_6_volatility_envelope srt_4_cross_rank""".split()


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, low, name):
    assert differences(spark, low, name, registry.QUERIES[name], registry.ORACLE[name]) == ""


def test_doubles(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 0.0), (0.0, -2.0), (-3.0, 2.0), (None, 0.0), (1.0, None)]
    got = spark.createDataFrame(rows, "a double, b double").select(ratio(F.col("a"), F.col("b")).alias("q"), ln(ratio(F.col("a"), F.col("b"))).alias("l")).collect()
    same = lambda x, y: x is y or (x is not None and y is not None and (x == y or (math.isnan(x) and math.isnan(y))))
    assert all(same(r.q, w) for r, w in zip(got, [0.5, inf, -inf, nan, nan, -0.0, -1.5, None, None], strict=True))
    assert all(same(r.l, w) for r, w in zip(got, [math.log(0.5), inf, nan, nan, nan, -inf, nan, None, None], strict=True))
    one = spark.createDataFrame([(1, nan), (2, nan), (2, 1.0), (3, None)], "g int, x double").groupBy("g").agg(spread(F.count("x"), F.var_pop("x")).alias("v")).collect()
    assert all(same(r.v, {1: 0.0, 2: nan, 3: None}[r.g]) for r in one)


def test_factors_of_flat_prices(spark):
    """A correlation with what does not vary is null, as in the SQL."""
    rows = [(i, datetime.date(2026, 1, 1 + n), 10.0 + i * n * n, 5.0) for i in (0, 1, 2) for n in range(6)]
    bars = spark.createDataFrame(rows, "security_id long, session date, close double, volume double")
    got = series.factors(bars, series.market(bars)).collect()
    assert len(got) == 15 and all(r.corr is None for r in got if r.security_id == 0) and all(r.corr is not None for r in got if r.security_id and r.session.day > 2)
