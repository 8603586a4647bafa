"""Operators without SQL, on small hand-made tables."""

import datetime
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions.ladder import ladder_steps, rungs_within, short_number
from terrane.functions.quantiles import quantiles
from terrane.operators import evidence, features, fits, histories, indicators, labels, membership, profiles, shapes, spine, survival, touch, trades
from terrane.plans.core import candidates
from terrane.operators import zones

DAY = datetime.date(2026, 1, 2)


def test_ladder(spark):
    row = spark.range(1).select(ladder_steps(F.lit(182.4)).alias("s"), rungs_within(F.lit(182.4), F.lit(12.0), F.lit(5.0)).alias("r"), *(short_number(F.lit(x)).alias(f"n{i}") for i, x in enumerate((10, 0.5, 0.05, 1.5, 2)))).head()
    assert row.s == [10.0, 5.0, 1.0, 0.5] and row.r == [175.0, 180.0, 185.0, 190.0] and [row[f"n{i}"] for i in range(5)] == ["10", "0.5", "0.05", "1.5", "2"]


def test_draws_cover_all_rows_evenly():
    numbers = touch.cells(10_000, 5)
    assert len(np.unique(numbers)) == numbers.size and np.array_equal(numbers[:7], touch.cells(7, 5))
    for m in (2, 97, 500):
        for start in ((0, 3, DAY), (0, 4, DAY)):
            seen = np.bincount(touch.draws(*start, numbers, m).ravel(), minlength=m)
            assert ((seen - numbers.size / m) ** 2 / (numbers.size / m)).sum() < m + 6 * (2 * m) ** 0.5  # chi squared
    one, two = touch.draws(0, 3, DAY, numbers, 100), touch.draws(0, 4, DAY, numbers, 100)
    assert abs(np.corrcoef(one.ravel(), two.ravel())[0, 1]) < 0.02 and abs(np.corrcoef(one.T)[~np.eye(5, dtype=bool)]).max() < 0.04


def test_touch_probabilities_against_each_path(spark):
    """All 10,000 paths walked one by one in plain Python."""
    rng = np.random.default_rng(1)
    h, l, c = 1 + rng.random(30) / 50, 1 - rng.random(30) / 50, 1 + (rng.random(30) - 0.5) / 50
    triples = spark.createDataFrame([(1, k + 2, float(h[k]), float(l[k]), float(c[k])) for k in range(30)], "security_id long, k long, h double, l double, c double")
    zones = [(1, DAY, 31, 50.0, "a", 50.4, 51.0), (1, DAY, 31, 50.0, "b", 48.0, 49.0), (1, DAY, 31, 50.0, "far", 90.0, 91.0)]
    frame = spark.createDataFrame(zones, "security_id long, as_of date, k long, spot double, zone_id string, lower double, upper double")
    index = touch.draws(0, 1, DAY, touch.cells(10_000, 5), 30).tolist()
    want = {z[4]: [0, 0, 0] for z in zones}
    for path in index:
        now, bars = 50.0, []
        for i in path:
            bars.append((now * h[i], now * l[i]))
            now *= c[i]
        for *_, name, lower, upper in zones:
            want[name][0] += any(lo <= upper and hi >= lower for hi, lo in bars)
            want[name][1] += min(lo for _, lo in bars) < lower
            want[name][2] += max(hi for hi, _ in bars) > upper
    got = {r.zone_id: [round(x * 10_000) for x in (r.p_touch, r.p_low_below, r.p_high_above)] for r in touch.touch_probabilities(frame, triples).collect()}
    assert got == want and 0 < got["a"][0] < 10_000


def test_path_steps():
    high, low, close = touch.simulate(100.0, np.array([1.1, 1.2]), np.array([0.9, 0.8]), np.array([1.0, 1.1]), np.array([[1, 0]]))
    assert np.allclose(high, [[120, 121]]) and np.allclose(low, [[80, 99]]) and np.allclose(close, [[110, 110]])


def test_wilder_warm_up(spark):
    rows = [(1, DAY + datetime.timedelta(i), 10.0 + i % 3, 9.0, 9.5) for i in range(5)] + [(2, DAY, 1.0, 1.0, 1.0)]
    got = indicators.wilder_atr(spark.createDataFrame(rows, "security_id long, session date, high double, low double, close double"), 3).orderBy("security_id", "session").collect()
    assert [r.tr for r in got[:5]] == [1.0, 2.0, 3.0, 1.0, 2.0]
    assert [r.atr if r.atr is None else round(r.atr, 6) for r in got] == [None, None, 2.0, round(5 / 3, 6), round((5 / 3 * 2 + 2) / 3, 6), None]


def test_value_area(spark):
    p = spark.createDataFrame([(1, DAY, b, v) for b, v in ((1, 10.0), (2, 50.0), (3, 20.0), (4, 15.0), (5, 5.0))], "security_id long, period date, bin long, volume double")
    r = features.value_area(p).head()
    assert (r.val, r.vah) == (2, 3)


def test_isotonic_is_the_pooled_mean(spark):
    rows = [(1, 0.1, 1.0), (1, 0.2, 0.0), (1, 0.3, 1.0), (1, 0.4, 1.0), (2, 0.2, 1.0)]
    got = features.isotonic(spark.createDataFrame(rows, "s long, p double, y double"), ["s"], "p", "y", least=3).orderBy("s", "p").collect()
    assert [(r.s, r.level, r.fitted) for r in got] == [(1, 1, 0.5), (1, 1, 0.5), (1, 1, 1.0), (1, 1, 1.0), (2, 0, 2 / 3)]


def test_zone_states(spark):
    ts = lambda i: datetime.datetime(2026, 1, 1) + datetime.timedelta(i)
    rows = [(1, ts(i), 0, o) for i, o in enumerate(["touch", "hold", "break", "hold", "break", "touch"])] + [(2, ts(0), 0, "hold"), (2, ts(80), 0, "touch"), (2, ts(170), 0, "touch"), (2, ts(171), 0, "break")]
    got = features.zone_states(spark.createDataFrame(rows, "zone long, ts timestamp, n long, outcome string")).orderBy("zone", "ts").collect()
    assert [r.state for r in got] == ["TESTED", "CONFIRMED", "FLIPPED", "FLIPPED", "RETIRED", "RETIRED", "CONFIRMED", "CONFIRMED", "RETIRED", "RETIRED"]
    assert (got[5].touches, got[5].holds, got[5].breaks) == (1, 2, 2) and (got[9].touches, got[9].holds, got[9].breaks) == (1, 1, 0)


def test_published(spark):
    names = "security_id long, as_of date, zone_id string, side string, p_touch double, p_hold double, confidence double, dq double, reaction double, event_risk double"
    rows = [(1, DAY, f"z{i}", "support", 0.9, s, 0.9, 0.9, 1.0, 0.1) for i, s in enumerate((0.9, 0.8, 0.75, 0.66))]
    rows += [(1, DAY, "r", "resistance", 0.5, 0.9, 0.9, 0.9, 1.0, 0.1), (1, DAY, "e", "resistance", 0.9, 0.9, 0.9, 0.9, 1.0, 0.8), (2, DAY, "q", "support", 0.9, 0.9, 0.9, 0.9, 1.0, 0.1), (2, DAY, "low", "support", 0.9, 0.9, 0.9, 0.6, 1.0, 0.1)]
    assert sorted(r.zone_id for r in labels.published(spark.createDataFrame(rows, names)).collect()) == ["z0", "z1", "z2"]


@pytest.mark.parametrize("rows", [1, 7, 30_000])
def test_quantiles_are_exact(spark, rows):
    rng = np.random.default_rng(rows)
    values = np.concatenate([np.round(rng.normal(size=rows), 2), np.full(rows // 3, 0.25)])
    at = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    assert np.allclose(quantiles(df, "v", at).head().edges, np.quantile(values, at), atol=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).head().edges == []


def test_folds_train_on_the_past_alone(spark):
    day = lambda y, m, d: datetime.date(y, m, d)
    rows = [(1, day(2020, 6, 1), "a"), (1, day(2020, 6, 1), "b"), (1, day(2020, 12, 28), "c"), (1, day(2021, 1, 4), "d"), (1, day(2022, 3, 1), "e")]
    got = {(r.zone_id, r.fold, r.role, r.weight) for r in features.folds(spark.createDataFrame(rows, "security_id long, as_of date, zone_id string")).collect()}
    assert got == {("a", 2021, "train", 0.5), ("b", 2021, "train", 0.5), ("d", 2021, "validate", 1.0), ("a", 2022, "train", 0.5), ("b", 2022, "train", 0.5), ("c", 2022, "train", 1.0), ("d", 2022, "train", 1.0), ("e", 2022, "validate", 1.0)}


def test_events_nobody_had_announced_are_not_seen(spark):
    day = lambda m, d: datetime.date(2026, m, d)
    events = [(1, day(1, 10), day(1, 12)), (1, day(3, 1), day(2, 10)), (1, day(2, 20), day(2, 25)), (1, day(6, 1), day(1, 1))]
    asked = [(1, day(1, 11)), (1, day(1, 12)), (1, day(2, 9)), (1, day(2, 10)), (1, day(2, 22)), (1, day(3, 1)), (1, day(6, 1)), (2, day(1, 1))]
    got = spine.event_context(spark.createDataFrame(events, "security_id long, event_date date, available_at date"), spark.createDataFrame(asked, "security_id long, as_of date"))
    plain = []
    for s, t in asked:
        known = [e for i, e, a in events if i == s and a <= t]
        plain.append((s, t, min(((t - e).days for e in known if e <= t), default=None), min(((e - t).days for e in known if e > t), default=None)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain)


def test_first_outside_against_a_scan(spark):
    rng = np.random.default_rng(2)
    price = np.round(100 + np.cumsum(rng.normal(size=300)), 2)
    bars = spark.createDataFrame([(1, DAY + datetime.timedelta(i), i + 1, float(p)) for i, p in enumerate(price)], "security_id long, session date, k long, close double")
    rows = bars.select("security_id", "session", "k", (F.col("close") - 4).alias("floor"), (F.col("close") + 4).alias("ceiling"))
    want = {}
    for i, p in enumerate(price):
        lo, hi = float(p) - 4, float(p) + 4
        want[i + 1] = next((DAY + datetime.timedelta(int(j)) for j in range(i + 1, 300) if price[j] < lo or price[j] > hi), None)
    assert {r.k: r.reached_at for r in shapes.first_outside(rows, bars, "close", "close", 16).collect()} == want


def test_deflated_sharpe(spark):
    normal = statistics.NormalDist()
    found = spark.createDataFrame([(1, 250, 0.1, -0.5, 4.0)], "security_id long, n long, sharpe double, skew double, kurtosis double")
    trials = [0.01, 0.05, -0.02, 0.08]
    r = fits.deflated_sharpe(found, spark.createDataFrame([(x,) for x in trials], "sharpe double")).head()
    best = statistics.stdev(trials) * ((1 - 0.5772) * normal.inv_cdf(0.75) + 0.5772 * normal.inv_cdf(1 - 1 / (4 * math.e)))
    want = normal.cdf((0.1 - best) * 249**0.5 / (1 + 0.5 * 0.1 + 3 / 4 * 0.01) ** 0.5)
    assert abs(r.expected_best - best) < 1e-12 and abs(r.deflated - want) < 1e-12


def test_outcome_models_learn_on_train_rows_alone(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 2))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 0] > 0).astype(int)  # trees can say it, a line cannot
    rows = [(DAY + datetime.timedelta(i % 400), float(a), float(b), int(c) if i % 400 < 300 else None) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    got = fits.outcome_models(spark.createDataFrame(rows + [(DAY, None, 0.0, 1)], "as_of date, a double, b double, y long"), ["a", "b"], "y", "as_of < date '2026-10-01'").collect()
    new = [(r, int(r.a * r.b + 0.3 * r.a > 0)) for r in got if r.y is None]
    right = lambda c: np.mean([(r[c] >= 0.5) == bool(t) for r, t in new])
    assert len(got) == 1200 and len(new) == 300 and right("p_trees") > 0.85 and right("p") > 0.85 and right("p") > right("p_linear")


def test_zones_do_not_depend_on_partitions(spark, sf):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return sorted(tuple(r) for r in zones.zones(candidates(spark, sf)).select("zone_id", "as_of", "center", "sources").collect())

    try:
        assert rows(1) == rows(16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def _trade(spark, bars, side="support", lower=99.0, upper=100.0, atr=2.0):
    """reason, steps of fill and exit, fill and exit of one zone over these (open, high, low, close)."""
    z = spark.createDataFrame([(1, DAY, "z", side, lower, upper, atr, 10)], "security_id long, as_of date, zone_id string, side string, lower double, upper double, atr double, k long")
    b = spark.createDataFrame([(1, 11 + i, *map(float, x), DAY) for i, x in enumerate(bars)], "security_id long, k long, open double, high double, low double, close double, available_at date")
    r = trades.zone_trades(z, b).first()
    return (r.reason, r.t_fill, r.t_exit, r.fill, r.exit)


def test_zone_trades_by_hand(spark):
    """Near edge 100, stop 99 - 0.5 = 98.5, target a gain of 1."""
    flat, dip = (103, 104, 102, 103), (101, 101, 99.5, 100.2)
    run = lambda *bars, **kw: _trade(spark, bars, **kw)
    assert run(*[flat] * 5) == ("unfilled", None, None, None, None)
    assert run(flat, flat) == ("open", None, None, None, None)
    assert run(dip, (100.5, 101.2, 100, 101), flat, flat, flat) == ("target", 1, 2, 100.0, 101.0)
    assert run(dip, (100.5, 101.2, 98, 99), flat, flat, flat) == ("stop", 1, 2, 100.0, 98.5)  # both in one session: the worse
    assert run(dip, (98, 98.2, 97, 98), flat, flat, flat) == ("stop", 1, 2, 100.0, 98.0)  # opens beyond the stop
    assert run(dip, (102, 103, 101.5, 102), flat, flat, flat) == ("target", 1, 2, 100.0, 102.0)  # opens beyond the target
    assert run((99.7, 100, 99.4, 99.9), (100, 100.5, 99.6, 100), *[(100, 100.4, 99.6, 100.1)] * 3) == ("expiry", 1, 5, 99.7, 100.1)  # a gap over the limit fills at the open
    assert run((98, 99, 97.5, 98.6), *[flat] * 4) == ("stop", 1, 1, 98.0, 98.0)  # a gap over limit and stop
    assert run((101.5, 102, 99.5, 100.1), *[(100, 100.4, 99.6, 100.1)] * 4) == ("expiry", 1, 5, 100.0, 100.1)  # the high may have come before the fill
    assert run((101.5, 102, 99.5, 101.3), *[flat] * 4) == ("target", 1, 1, 100.0, 101.0)  # the close cannot
    assert run((99.8, 101, 99.5, 100), *[flat] * 4) == ("target", 1, 1, 99.8, 100.8)
    assert run(flat, flat, flat, flat, dip) == ("expiry", 5, 5, 100.0, 100.2)
    assert run(dip, (100, 100.5, 99.5, 100)) == ("open", 1, None, 100.0, None)
    assert run((98, 99.5, 97.5, 98.8), (98.5, 99, 97.9, 98.2), flat, flat, flat, side="resistance") == ("target", 1, 2, 99.0, 98.0)


def test_one_trade_at_a_time_by_hand(spark):
    rows = [("a", 0, 1, 3), ("b", 0, 3, 4), ("c", 0, 4, 5), ("d", 2, 2, 3), ("e", 4, 1, None), ("f", 9, 1, 2)]  # filled at 1, 3, 4, 4, 5, 10
    t = spark.createDataFrame([(1, DAY + datetime.timedelta(k), z, k, f, x) for z, k, f, x in rows] + [(2, DAY, "g", 0, 2, 2), (2, DAY, "h", 0, 3, 3), (2, DAY, "u", 0, None, None)], "security_id long, as_of date, zone_id string, k long, t_fill long, t_exit long")
    got = sorted((r.security_id, r.zone_id) for r in trades.one_at_a_time(t).collect())
    assert got == [(1, "a"), (1, "c"), (1, "f"), (2, "g"), (2, "h")]  # c is open to 5, so e waits, and f is the next


def _bca(rows, times=2000, level=0.95):
    """mean, low, high of (cluster, y) rows, in plain Python with the library's draws."""
    import hashlib

    by = {}
    for c, y in rows:
        if y is not None:
            s, n = by.get(c, (0.0, 0))
            by[c] = (s + y, n + 1)
    mix = lambda x: int(touch.mixed(np.array([x], dtype=np.int64))[0])
    start = {c: int(hashlib.md5(f"0|{c}".encode()).hexdigest()[:8], 16) % 2**31 for c in by}
    ts, tn = sum(s for s, _ in by.values()), sum(n for _, n in by.values())
    means = []
    for b in range(1, times + 1):
        w = {c: sum(mix(start[c] ^ mix(b)) >= x for x in labels.POISSON) for c in by}
        means.append(sum(w[c] * by[c][0] for c in by) / sum(w[c] * by[c][1] for c in by))
    mean, normal = ts / tn, statistics.NormalDist()
    under = sum(1.0 if m < mean else 0.5 if m == mean else 0.0 for m in means) / times
    left = [(ts - s) / (tn - n) for s, n in by.values()]
    centre = sum(left) / len(left)
    a = sum((centre - x) ** 3 for x in left) / (6 * sum((centre - x) ** 2 for x in left) ** 1.5)
    z0 = normal.inv_cdf(under)
    at = [normal.cdf(z0 + (z0 + normal.inv_cdf(q)) / (1 - a * (z0 + normal.inv_cdf(q)))) for q in ((1 - level) / 2, (1 + level) / 2)]
    return (mean, *(float(np.quantile(means, q)) for q in at))


def test_bca_interval_against_plain(spark):
    r = np.random.default_rng(4)
    rows = [(g, f"c{r.integers(25)}", None if r.random() < 0.05 else float(r.exponential() if g == "a" else r.integers(2))) for g in ("a", "b", None) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, c string, y double").repartition(3)
    for by in ([], ["g"]):
        got = {x.g if by else "all": (x.mean, x.low, x.high) for x in labels.bca_interval(df, ["c"], "y", by, times=300).collect()}
        for g in (("a", "b", None) if by else ("all",)):
            want = _bca([(c, y) for h, c, y in rows if not by or h == g], 300)
            assert got[g] == pytest.approx(want, rel=1e-9) and want[1] < want[0] < want[2]
    one = labels.bca_interval(spark.createDataFrame([("c", 1.0), ("c", 0.0)], "c string, y double"), ["c"], "y").first()
    assert (one.mean, one.low, one.high, one.clusters) == (0.5, 0.5, 0.5, 1)
    assert labels.bca_interval(df.where("false"), ["c"], "y", ["g"]).count() == 0


def _zone_rows(spark, rows):
    """Zones of one security: (week, zone, side, center, sources)."""
    made = [(1, DAY + datetime.timedelta(7 * w), z, side, c, 1.0, src) for w, z, side, c, src in rows]
    return spark.createDataFrame(made, "security_id long, as_of date, zone_id string, side string, center double, atr double, sources string")


def test_history_of_a_zone_that_moved_twice(spark):
    """Weeks 0, 1, 3, 4 of one zone under changing names; another zone in between; a split into two."""
    z = _zone_rows(spark, [(0, "a", "support", 10.0, "x,y"), (1, "b", "support", 10.2, "x"), (1, "q", "support", 12.0, "x"), (3, "c", "support", 10.4, "x,z"), (4, "d", "support", 10.5, "z"), (4, "e", "support", 10.3, "x"), (30, "f", "support", 10.5, "z")])
    links = labels.match_zones(z)
    got = {(r.as_of, r.zone_id): (r.root_as_of, r.root_zone) for r in histories.chains(z, links).collect()}
    week = lambda n: DAY + datetime.timedelta(7 * n)
    root = (week(0), "a")
    assert got == {(week(0), "a"): root, (week(1), "b"): root, (week(3), "c"): root, (week(4), "d"): root, (week(4), "e"): root, (week(1), "q"): (week(1), "q"), (week(30), "f"): (week(30), "f")}
    outcome = {"a": (1, 1, 0, 0.9), "b": (0, None, None, None), "c": (1, 0, 1, 0.1), "d": (1, 1, 0, 2.0), "e": (0, None, None, None), "q": (1, 1, 0, 1.0), "f": (0, None, None, None)}
    lab = spark.createDataFrame([(1, r.as_of, r.zone_id, *outcome[r.zone_id][:3], datetime.datetime.combine(r.as_of, datetime.time(20)) + datetime.timedelta(30 if r.zone_id == "c" else 5)) for r in z.collect()], "security_id long, as_of date, zone_id string, y_touch long, y_hold long, y_break long, available_at timestamp")
    re_ = spark.createDataFrame([(1, r.as_of, r.zone_id, outcome[r.zone_id][3]) for r in z.collect() if outcome[r.zone_id][3] is not None], "security_id long, as_of date, zone_id string, reaction double")
    h = {(r.as_of, r.zone_id): r for r in histories.chain_history(histories.chains(z, links), lab, re_).collect()}
    assert [h[week(0), "a"][c] for c in ("weeks", "touches", "state", "last_touch_age", "hold_ratio")] == [0, 0, "UNTESTED", None, None]
    c = h[week(3), "c"]
    assert (c.weeks, c.touches, c.holds, c.breaks, c.age, c.last_touch_age, c.touch_gap, c.state, c.reaction_mean) == (2, 1, 1, 0, 21, 21, None, "CONFIRMED", 0.9)
    d = h[week(4), "d"]  # the outcome of c is known only after that week
    assert (d.weeks, d.touches, d.breaks, d.age, d.state) == (2, 1, 0, 28, "CONFIRMED") and d.decay63 == pytest.approx(math.exp(-28 / 63))


def test_chains_of_many_weeks(spark):
    z = _zone_rows(spark, [(w, f"z{w}", "support", 10.0, "x") for w in range(70)])
    got = {r.root_zone for r in histories.chains(z, labels.match_zones(z)).collect()}
    assert got == {"z0"}


def test_turning_points_count_once(spark):
    """Two dates see the point at session 13; a zone of the earlier one holds it. The point at 30 lies in no horizon."""
    dates = spark.createDataFrame([(1, DAY, 10), (1, DAY + datetime.timedelta(2), 12), (2, DAY, 10)], "security_id long, as_of date, k long")
    z = spark.createDataFrame([(1, 10, "resistance", 99.0, 100.0, 2.0), (1, 12, "support", 99.0, 100.0, 2.0), (2, 10, "support", 1.0, 900.0, 2.0)], "security_id long, k long, side string, lower double, upper double, atr double")
    points = spark.createDataFrame([(1, 13, "high", 100.4), (1, 13, "low", 98.4), (1, 14, "high", 100.6), (1, 30, "high", 99.5), (2, 11, "low", 50.0), (2, 11, "high", 50.0)], "security_id long, t long, side string, level double")
    got = {(r.security_id, r.t, r.side): (r.as_of, r.hit) for r in histories.captured(points, z, dates).collect()}
    later = DAY + datetime.timedelta(2)
    assert got == {(1, 13, "high"): (later, 1), (1, 13, "low"): (later, 0), (1, 14, "high"): (later, 0), (2, 11, "low"): (DAY, 1), (2, 11, "high"): (DAY, 0)}
    table = {(r.security_id, r.regime): (r.points, r.hits) for r in histories.recall(histories.captured(points, z, dates), spark.createDataFrame([(DAY, "bull")], "as_of date, regime string")).collect()}
    assert table[None, None] == (5, 2) and table[1, "none"] == (3, 1) and table[None, "bull"] == (2, 1)


def test_trailing_profiles_by_hand(spark):
    """Ten sessions at 10 to 11 with volume 8, then ten at 12 without a range; dates at sessions 9 to 19; bins of 0.5."""
    day = lambda k: datetime.date(2026, 1, 1) + datetime.timedelta(k)
    bars = spark.createDataFrame([(1, k, 10.0, 11.0, 8.0) if k < 10 else (1, k, 12.0, 12.0, 3.0) for k in range(20)] + [(2, 0, 5.0, 5.0, 0.0)], "security_id long, k long, low double, high double, volume double")
    state = spark.createDataFrame([(1, day(k), k, 5.0) for k in range(9, 20)] + [(1, day(100), 18, 5.0), (2, day(0), 0, 5.0), (1, day(8), 8, None)], "security_id long, as_of date, k long, atr double")
    got = {}
    for r in profiles.trailing_profile(bars, state, (5, 10)).collect():
        got.setdefault((r.as_of, r.window), {})[r.bin] = r.volume
    for k, d in [(k, day(k)) for k in range(9, 20)] + [(18, day(100))]:
        for n in (5, 10):
            old, new = sum(k - n < j < 10 for j in range(k + 1)), sum(k - n < j and j >= 10 for j in range(k + 1))
            want = ({20: 4.0 * old, 21: 4.0 * old} if old else {}) | ({24: 3.0 * new} if new else {})
            assert {b: v for b, v in got[d, n].items() if v} == want
    levels_ = {(r.as_of, r.window): (r.poc, r.val, r.vah, r.total) for r in profiles.trailing_levels(profiles.trailing_profile(bars, state, (5, 10))).collect()}
    assert levels_[day(9), 10] == (10.25, 10.0, 11.0, 80.0) and levels_[day(19), 10] == (12.25, 12.0, 12.5, 30.0)
    assert levels_[day(12), 10] == (10.25, 10.0, 11.0, 65.0)


def test_overlaps_by_hand(spark):
    d = lambda m: datetime.date(2026, m, 1)
    rows = [("A", 1, d(1), d(4)), ("B", 1, d(4), d(6)), ("A", 2, d(1), d(4)), ("A", 2, d(3), d(7)), ("B", 2, d(2), d(5)), ("C", 2, d(4), None), ("B", 3, d(1), d(1)), ("A", 3, d(1), None), ("B", 3, d(2), None)]
    m = spark.createDataFrame(rows, "index_id string, security_id long, start date, end date")
    got = sorted((r.security_id, r.start, r.end, r.indices) for r in membership.overlaps(m).collect())
    assert got == [(2, d(2), d(4), 2), (2, d(4), d(5), 3), (2, d(5), d(7), 2), (3, d(2), None, 2)]  # touching is no overlap, and a spell twice is one
    days = {(r.security_id, r.index_a, r.index_b): r.days for r in membership.shared_time(m, F.lit(d(3))).collect()}
    assert days == {(2, "A", "B"): 28, (2, "A", "C"): 0, (2, "B", "C"): 0, (3, "A", "B"): 28}


def test_time_to_break_by_counts(spark):
    """Person-periods by hand, and a model without a say of features that comes near the counted hazards."""
    lab = [(1, DAY, f"z{i}", 1, b, t, k, False) for i, (b, t, k) in enumerate([(1, 1, 1), (1, 1, 3), (0, 2, None), (1, 4, 5), (0, 5, None)] * 60)] + [(1, DAY, "gap", 1, 0, 1, None, True), (1, DAY, "none", 0, None, None, None, False)]
    rows = spark.createDataFrame(lab, "security_id long, as_of date, zone_id string, y_touch long, y_break long, t_touch long, t_break long, label_gap boolean").withColumn("x", F.rand(3))
    table = {r.step: r for r in survival.hazard_table(survival.person_periods(rows), ["security_id"]).collect()}
    counts = {1: (300, 60), 2: (180, 60), 3: (120, 60), 4: (60, 0)}
    assert {k: (r.at_risk, r.breaks) for k, r in table.items()} == counts
    assert table[3].survival == pytest.approx(0.8 * (2 / 3) * 0.5) and table[4].survival == table[3].survival and table[2].p_break == pytest.approx(0.8 / 3)
    got = survival.time_to_break(rows, ["x"], "true").where("zone_id = 'z0'").orderBy("step").collect()
    assert all(a.p_survival > b.p_survival for a, b in zip(got, got[1:])) and got[0].t_break_q50 == 3
    assert [g.p_hazard for g in got[:3]] == pytest.approx([0.2, 1 / 3, 0.5], abs=0.08)


def test_sections_and_evidence_by_hand(spark):
    text = "intro\n# One\nalpha beta\n# Two\ngamma " + "x" * 30
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "# Only"), (5, "\n\n")], "doc_id long, text string")
    found = evidence.sections(docs, "# ", r"# \w+")
    got = sorted((r.doc_id, r.section, r["name"], r.start, r.text) for r in found.collect())
    assert got == [(1, 0, "", 0, "intro\n"), (1, 1, "# One", 6, "# One\nalpha beta\n"), (1, 2, "# Two", 23, "# Two\ngamma " + "x" * 30), (4, 0, "# Only", 0, "# Only"), (5, 0, "", 0, "\n\n")]
    c = evidence.section_chunks(found, 20)
    assert [(r.start, r.text) for r in c.where("doc_id = 1 and section = 2").orderBy("chunk").collect()] == [(23, text[23:43]), (43, text[43:63]), (63, text[63:])]
    rows = [(1, 1, 0, "risk", 0.5, 0.5, "alpha", None), (1, 2, 1, "risk", 0.5, 0.5, "xx", None), (1, 1, 0, "risk", 0.5, 0.5, "gamma", "evidence"), (1, 1, 0, "risk", 0.5, 0.5, "", "evidence"), (1, 1, 0, "risk", 0.5, 0.5, None, "evidence"), (1, 1, 0, "risk", 1.5, 0.5, "alpha", "value"), (1, 1, 0, "risk", None, 0.5, "alpha", "value"), (1, 1, 0, "risk", 0.5, 2.0, "alpha", "confidence"), (1, 1, 0, "mood", 0.5, 0.5, "alpha", "unknown feature"), (1, 1, 9, "risk", 0.5, 0.5, "alpha", "no chunk")]
    asked = spark.createDataFrame([(*r[:7],) for r in rows], "doc_id long, section long, chunk long, feature string, value double, confidence double, evidence string")
    ranges = spark.createDataFrame([("risk", 0.0, 1.0)], "feature string, low double, high double")
    told = evidence.checked(asked, c, ranges).collect()
    assert sorted((str(r.evidence), str(r.value), str(r.feature), r.chunk, str(r.confidence), str(r.reason)) for r in told) == sorted((str(r[6]), str(r[4]), r[3], r[2], str(r[5]), str(r[7])) for r in rows)
    assert all((text[r.start : r.end] == r.evidence) if r.reason is None else r.start is None for r in told)


def test_a_missing_session_inside_the_window_shows(spark):
    day = lambda i: DAY + datetime.timedelta(i)
    z = spark.createDataFrame([(1, DAY, "z"), (2, DAY, "z")], "security_id long, as_of date, zone_id string")
    bars = spark.createDataFrame([(s, day(i), 1.0, 1.0, 1.0, float(i)) for s in (1, 2) for i in range(8) if (s, i) != (2, 3)], "security_id long, session date, open double, high double, low double, close double")
    steps = spark.createDataFrame([(DAY, i, day(i)) for i in range(1, 7)], "as_of date, step long, session date")
    got = {(r.security_id, r.step): (r.close, r.label_gap) for r in labels.calendar_window(z, bars, steps).collect()}
    assert got == {(s, i): (None if (s, i) == (2, 3) else float(i), s == 2) for s in (1, 2) for i in range(1, 6)}
