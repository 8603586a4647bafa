"""Touch probability by resampling past sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

#: Sessions to a chunk of one security's as-of dates.
CHUNK = 250
#: Multipliers, increments and shifts of ``mixed``. Products of numbers below 2**31 stay below 2**62, so SQL can say the same.
MIX = ((1103515245, 12345, 16), (22695477, 1, 15))


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**31 (int64) that look drawn at random, from different numbers below 2**31; no two meet."""
    for times, plus, shift in MIX:
        x = (x * times + plus) & 0x7FFFFFFF
        x = x ^ (x >> shift)
    return x


def cells(paths: int, horizon: int) -> np.ndarray:
    """A number for every path and step (paths x steps), the same for all securities and dates."""
    return mixed(np.arange(paths, dtype=np.int64)[:, None] * 8 + np.arange(1, horizon + 1))


def start(seed: int, security: int, as_of) -> int:
    """A number below 2**31 for a security and date."""
    return int(hashlib.md5(f"{seed}|{security}|{as_of}".encode()).hexdigest()[:8], 16) & 0x7FFFFFFF


def draws(seed: int, security: int, as_of, numbers: np.ndarray, m: int) -> np.ndarray:
    """Reproducible row numbers below m for the ``cells``."""
    return mixed(numbers ^ start(seed, security, as_of)) % m


def simulate(spot: float, h: np.ndarray, l: np.ndarray, c: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """Highs, lows and closes (paths x steps): each step multiplies the close before it."""
    close = np.empty(index.shape)
    now = np.full(len(index), spot)
    high, low = np.empty(index.shape), np.empty(index.shape)
    for s in range(index.shape[1]):
        i = index[:, s]
        high[:, s], low[:, s] = now * h[i], now * l[i]
        now = close[:, s] = now * c[i]
    return high, low, close


def _walked(asked: DataFrame, triples: DataFrame, p: Params, each: Callable[..., Iterator[tuple]], columns: str) -> DataFrame:
    """security_id, as_of and what ``each`` (rows of ``asked`` of one date, highs, lows, closes) yields. ``asked`` has security_id, as_of, k, spot. Paths never become rows: a
    security's sessions and dates meet in chunks of as-of dates, each with the sessions its lookback reaches."""
    last = F.col("k") + p.lookback - 1
    reach = triples.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("k") / CHUNK), F.floor(last / CHUNK))))
    names = ["security_id", "as_of", *(c.split()[0] for c in columns.split(", "))]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("k")
        k = right["k"].to_numpy()
        h, l, c = (right[x].to_numpy(float) for x in "hlc")  # noqa: E741
        out, numbers = [], cells(p.paths, p.horizon)
        for (security, as_of, now, spot), rows in left.groupby(["security_id", "as_of", "k", "spot"]):
            a, b = np.searchsorted(k, now - p.lookback, "right"), np.searchsorted(k, now, "right")
            if b > a:
                walks = simulate(spot, h[a:b], l[a:b], c[a:b], draws(p.seed, security, as_of, numbers, b - a))
                out += [(security, as_of, *row) for row in each(rows, *walks)]
        return pd.DataFrame(out, columns=names)

    reach = reach.select(F.col("security_id").alias("r_security"), F.col("chunk").alias("r_chunk"), "k", "h", "l", "c")
    both = asked.withColumn("chunk", F.floor(F.col("k") / CHUNK)).groupBy("security_id", "chunk").cogroup(reach.groupBy("r_security", "r_chunk"))
    return both.applyInPandas(run, f"security_id long, as_of date, {columns}")


def touch_probabilities(zones: DataFrame, triples: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``zones`` (security_id, as_of, k, spot, zone_id, lower, upper) with p_touch, p_low_below, p_high_above."""

    def each(rows, high, low, close):
        least, most = low.min(1), high.max(1)
        for z in rows.itertuples():
            yield z.zone_id, float(((low <= z.upper) & (high >= z.lower)).any(1).mean()), float((least < z.lower).mean()), float((most > z.upper).mean())

    asked = zones.select("security_id", "as_of", "k", "spot", "zone_id", "lower", "upper")
    return _walked(asked, triples, p, each, "zone_id string, p_touch double, p_low_below double, p_high_above double")


def path_steps(state: DataFrame, triples: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """security_id, as_of, step, high, low, close: the highest high, the lowest low and the mean close of all paths after each step."""

    def each(rows, high, low, close):
        for s in range(close.shape[1]):
            yield s + 1, float(high[:, s].max()), float(low[:, s].min()), float(close[:, s].mean())

    return _walked(state.select("security_id", "as_of", "k", "spot"), triples, p, each, "step long, high double, low double, close double")


def path_rows(state: DataFrame, triples: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """security_id, as_of, path, step, high, low, close: every path, for dumps of few dates: ``paths * horizon`` rows for each."""

    def each(rows, high, low, close):
        for path in range(len(close)):
            for s in range(close.shape[1]):
                yield path, s + 1, float(high[path, s]), float(low[path, s]), float(close[path, s])

    return _walked(state.select("security_id", "as_of", "k", "spot"), triples, p, each, "path long, step long, high double, low double, close double")


def path_quantiles(state: DataFrame, triples: DataFrame, p: Params = DEFAULT, at: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """security_id, as_of and the points ``at`` (5, 50 and 95 %) of each path's high, low and last close."""
    names = [f"{c}_q{round(x * 100):02d}" for c in ("high", "low", "close") for x in at]

    def each(rows, high, low, close):
        yield tuple(float(x) for v in (high.max(1), low.min(1), close[:, -1]) for x in np.quantile(v, at))

    return _walked(state.select("security_id", "as_of", "k", "spot"), triples, p, each, ", ".join(f"{n} double" for n in names))
