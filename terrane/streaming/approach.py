"""Zones that price comes near to and leaves, as a stream with two timers, and the same from a table."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import UNMATCHED

OUT = "zone long, ts timestamp, state string"
#: How near is near, in ATRs, and the closed sessions outside after which a zone counts as untested again.
NEAR, OUTSIDE = 1.0, 5
#: A day in microseconds, as times are kept; timers and watermarks have milliseconds.
_DAY = 86_400_000_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


def _ts(micros: int) -> datetime.datetime:
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=micros)


class Approach(StatefulProcessor):
    """Rows of a zone wait until the watermark has passed them, so they are taken in the order of time, however late they came. Two timers of different kinds: event time, at which a zone
    that no session has matched for ``UNMATCHED`` days retires, and a count of closed sessions outside, which a missing session does not move."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "state string, outside long, last long")
        self.waiting = handle.getListState("waiting", "at long, n long, distance double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for pdf in rows:
            for ts, n, distance in zip(pdf["ts"], pdf["n"], pdf["distance"], strict=True):
                self.waiting.appendValue((_micros(ts), int(n), float(distance)))
                times.add(_micros(ts) // 1000 + 1)
        for ms in times:
            self.handle.registerTimer(max(ms, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in waiting if x[0] <= now]
        state, outside, last = self.kept.get() if self.kept.exists() else ("UNTESTED", 0, None)
        out = []
        for at, _, distance in due:
            if state != "RETIRED" and last is not None and at - last > UNMATCHED * _DAY:
                state = "RETIRED"
                out.append((_ts(last + UNMATCHED * _DAY), state))
            if state == "RETIRED":
                continue
            last = at
            state, outside, changed = moved(state, outside, distance)
            if changed:
                out.append((_ts(at), state))
        if len(due) < len(waiting):
            self.waiting.put([x for x in waiting if x[0] > now])
        elif waiting:
            self.waiting.clear()
        if state != "RETIRED" and last is not None:
            over = last + UNMATCHED * _DAY
            if over <= now:  # what could have come before has come
                state = "RETIRED"
                out.append((_ts(over), state))
            elif due:
                self.handle.registerTimer(over // 1000 + 1)
        if last is not None:
            self.kept.update((state, outside, last))
        if out:
            yield pd.DataFrame({"zone": [key[0]] * len(out), "ts": [t for t, _ in out], "state": [s for _, s in out]})

    def close(self) -> None:
        pass


def moved(state: str, outside: int, distance: float) -> tuple[str, int, bool]:
    """The state and the count after a closed session, and whether the state changed."""
    if abs(distance) <= NEAR:
        return "APPROACHING", 0, state == "UNTESTED"
    if state == "APPROACHING":
        return ("UNTESTED", 0, True) if outside + 1 == OUTSIDE else (state, outside + 1, False)
    return state, outside, False


def approaches(sessions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """zone, ts, state of every change, of a stream of closed sessions (zone, ts, n, distance in ATRs): APPROACHING when price comes near, UNTESTED again after ``OUTSIDE`` closed sessions in a row
    away from the zone, RETIRED after ``UNMATCHED`` days without a session. Sessions of one moment are taken in the order of n. Needs the RocksDB state store."""
    keyed = sessions.select("zone", "ts", "n", "distance").withWatermark("ts", late).groupBy("zone")
    return keyed.transformWithStateInPandas(Approach(), OUT, "Append", "EventTime")


def approach_table(sessions: DataFrame, until) -> DataFrame:
    """``approaches`` of a table, for all that has happened by ``until``: rows up to it, and retirements due by then."""
    w = Window.partitionBy("zone").orderBy("ts", "n")
    over = F.expr(f"interval {UNMATCHED} days")
    rows = sessions.where(F.col("ts") <= until).withColumns({"before": F.lag("ts").over(w), "next": F.lead("ts").over(w)})
    # A gap ends the history: what comes after it is not seen.
    gap = F.coalesce(F.col("ts") > F.col("before") + over, F.lit(False))
    rows = rows.withColumn("gone", F.max(gap.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("gone = 0")
    near = F.abs("distance") <= NEAR
    rows = rows.withColumn("near", near).withColumn("visit", F.sum(near.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("zone", "visit").orderBy("ts", "n")
    rows = rows.withColumn("far", F.sum((~F.col("near")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    far_before = F.lag("far").over(w)
    state = F.when(F.col("near") & ((F.col("visit") == 1) | (far_before >= OUTSIDE)), "APPROACHING").when(~F.col("near") & (F.col("visit") > 0) & (F.col("far") == OUTSIDE), "UNTESTED")
    changes = rows.withColumn("state", state).where("state is not null").select("zone", "ts", "state")
    last = rows.groupBy("zone").agg((F.max("ts") + over).alias("ts")).where(F.col("ts") <= until)
    return changes.unionByName(last.select("zone", "ts", F.lit("RETIRED").alias("state")))
