"""Evaluation by strata against plain versions."""

import math
from collections import defaultdict

import numpy as np

from terrane.operators import labels, strata
from terrane.operators.touch import mixed

NUMBERS = np.random.default_rng(17)


def logistic(p, y):
    """Intercept and slope by plain descent on the negative log likelihood's exact Newton direction, in numpy."""
    x = np.log(p / (1 - p))
    design, at = np.stack([np.ones_like(x), x], 1), np.array([0.0, 1.0])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-design @ at))
        at = at + np.linalg.solve(design.T @ (design * (mu * (1 - mu))[:, None]), design.T @ (y - mu))
    return at


def test_slope_of_calibration(spark):
    rows = []
    for stratum, tilt in (("a", 1.0), ("b", 0.5), ("c", 2.0)):
        p = np.round(NUMBERS.uniform(0.02, 0.98, 1500), 3)
        y = NUMBERS.random(1500) < 1 / (1 + np.exp(-(0.3 + tilt * np.log(p / (1 - p)))))
        rows += [("m", stratum, float(a), float(b)) for a, b in zip(p, y, strict=True)]
    rows += [("m", "same", 0.5, float(i % 2)) for i in range(10)] + [("m", "split", 0.2 + 0.1 * i, float(i > 2)) for i in range(6)] + [("m", "sure", 1.0, 1.0), ("m", "none", None, 1.0), ("m", "none", 0.5, None)]
    got = {r.stratum: r for r in strata.calibration_by(spark.createDataFrame(rows, "market string, stratum string, p double, y double"), "p", "y", ["market", "stratum"]).where("coarse = 0").collect()}
    for s in "abc":
        p, y = (np.array([r[i] for r in rows if r[1] == s]) for i in (2, 3))
        assert np.allclose([got[s].intercept, got[s].slope], logistic(p, y), atol=1e-7) and got[s].n == 1500
        assert math.isclose(got[s].brier, ((p - y) ** 2).mean()) and math.isclose(got[s].log_loss, -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    assert all(got[s].slope is None and got[s].intercept is None for s in ("same", "split", "sure")) and "none" not in got


def test_levels_of_strata_and_empty_table(spark):
    rows = [(m, s, 0.1 * (i % 9 + 1), float(i % 3 == 0)) for i, (m, s) in enumerate([("x", "u"), ("x", "v"), ("y", "u"), ("y", None)] * 10)]
    df = spark.createDataFrame(rows, "market string, stratum string, p double, y double")
    got = [(r.market, r.stratum, r.coarse, r.n) for r in strata.calibration_by(df, "p", "y", ["market", "stratum"]).collect()]
    assert sorted(got, key=str) == sorted([("x", "u", 0, 10), ("x", "v", 0, 10), ("y", "u", 0, 10), ("y", None, 0, 10), ("x", None, 1, 20), ("y", None, 1, 20), (None, None, 3, 40)], key=str)
    assert strata.calibration_by(df.limit(0), "p", "y", ["market", "stratum"]).collect() == []


def test_deciles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "v double")
    got = {r.v: r.decile for r in strata.deciles(df, "v").collect()}
    assert got[None] is None and [sum(d == k for d in got.values()) for k in range(10)] == [10] * 10 and got[0.0] == 0 and got[99.0] == 9
    same = strata.deciles(spark.createDataFrame([(1.0,)] * 30, "v double"), "v").collect()
    assert {r.decile for r in same} == {0}


def test_lift_against_each_resample(spark):
    """Every resample added up in plain Python; cells without placebos, and null values and cells, take no part."""
    real, placebo = [], []
    for cluster in range(40):
        for cell, p_real, p_placebo in (("a", 0.9, 0.3), ("b", 0.5, 0.5)):
            real += [(cell, "u", cluster, int(NUMBERS.random() < p_real)) for _ in range(NUMBERS.integers(0, 4))]
            placebo += [(cell, "u", cluster, int(NUMBERS.random() < p_placebo)) for _ in range(NUMBERS.integers(0, 6))]
    real += [("alone", "u", 1, 1), ("a", "u", 2, None), (None, "u", 2, 1)]
    schema = "cell string, regime string, cluster long, y long"
    times = 200
    got = {r.cell: r for r in strata.lift(spark.createDataFrame(real, schema), spark.createDataFrame(placebo, schema), "y", ["cell", "regime"], ["cluster"], "regime", times).collect()}
    assert got.keys() == {"a", "b"}
    import hashlib

    weight = {}
    for c in range(40):
        start = int(hashlib.md5(f"0|{c}".encode()).hexdigest()[:8], 16) % (1 << 31)
        weight[c] = np.searchsorted(np.array(labels.POISSON), mixed(np.int64(start) ^ mixed(np.arange(1, times + 1, dtype=np.int64))), "right")
    ps = {}
    for cell, r in got.items():
        mean = {}
        for kind, rows in (("r", real), ("p", placebo)):
            s, n = defaultdict(float), defaultdict(float)
            for name, _, c, y in rows:
                if name == cell and y is not None:
                    s[c] += y
                    n[c] += 1
            mean[kind] = (sum(weight[c] * s[c] for c in n) / sum(weight[c] * n[c] for c in n), sum(s.values()) / sum(n.values()), sum(n.values()))
        drawn = mean["r"][0] - mean["p"][0]
        assert math.isclose(r.lift, mean["r"][1] - mean["p"][1]) and (r.n_real, r.n_placebo) == (mean["r"][2], mean["p"][2])
        assert np.allclose([r.low, r.high], np.quantile(drawn, [0.025, 0.975]))
        ps[cell] = min(1.0, 2 * (1 + min((drawn <= 0).sum(), (drawn >= 0).sum())) / (1 + times))
        assert math.isclose(r.p, ps[cell])
    ranked = sorted(ps, key=ps.get)
    assert math.isclose(got[ranked[1]].q, ps[ranked[1]]) and math.isclose(got[ranked[0]].q, min(2 * ps[ranked[0]], ps[ranked[1]]))
    assert got["a"].lift > 0.3 and got["a"].q < 0.05 < got["b"].q


def test_naive_levels(spark):
    state = spark.sql("select 1L as security_id, date'2024-01-05' as as_of, 30L as k, 10.0D as spot, 1.0D as atr union all select 2L, date'2024-01-05', 3L, 10.0D, null union all select 3L, date'2024-01-05', 30L, 1.0D, 2.0D")
    facts = spark.sql("select x as security_id, date'2024-01-05' as as_of, 12.0D as high, 9.95D as low, 10.0D as close, 13.0D as boll_up, cast(null as double) as boll_low from values (1L), (2L), (3L) t(x)")
    got = {(r.security_id, r.zone_id): r for r in strata.naive_levels(state, facts).collect()}
    assert {k[0] for k in got} == {1, 3}
    one = {k[1]: r for k, r in got.items() if k[0] == 1}
    assert "week_low" not in one and "boll_low" not in one  # the zone holds the spot; not known
    assert one["week_high"].side == "resistance" and math.isclose(one["week_high"].lower, 11.9) and math.isclose(one["atr_low2"].distance_atr, -2) and math.isclose(one["pivot"].center, 31.95 / 3)
    assert (3, "atr_low1") not in got and (3, "atr_low2") not in got  # not a price
