"""Zone states as a stream, and streams run to their end."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.features import UNMATCHED, next_state

OUT = "zone long, ts timestamp, n long, state string, touches long, holds long, breaks long"
KEPT = "state string, touches long, holds long, breaks long, last timestamp"


def zone_states(outcomes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``operators.features.zone_states`` of a stream of outcomes (zone, ts, n, outcome): a row for each outcome as it arrives, and one, with null n, at the time at which ``UNMATCHED`` days
    have passed without any. The state of a zone is a few numbers. Outcomes of one batch are taken in the order of time; one that comes in a later
    batch than its successor is taken after it."""

    def step(key, batches, state: GroupState):
        now, touches, holds, breaks, last = state.get if state.exists else ("UNTESTED", 0, 0, 0, None)
        if state.hasTimedOut:
            over = last + datetime.timedelta(days=UNMATCHED)
            state.update(("RETIRED", touches, holds, breaks, last))
            yield pd.DataFrame([(key[0], over, None, "RETIRED", touches, holds, breaks)], columns=["zone", "ts", "n", "state", "touches", "holds", "breaks"]).astype({"n": "Int64"})
            return
        count, rows = {"touch": touches, "hold": holds, "break": breaks}, []
        for r in pd.concat(list(batches)).sort_values(["ts", "n"]).itertuples():
            days = (r.ts - pd.Timestamp(last)).total_seconds() / 86400 if last is not None else 0.0
            live = now != "RETIRED" and days <= UNMATCHED
            now, last = next_state(now, count["break"], r.outcome, days), r.ts.to_pydatetime()
            count[r.outcome] += live
            rows.append((r.zone, r.ts, r.n, now, count["touch"], count["hold"], count["break"]))
        state.update((now, int(count["touch"]), int(count["hold"]), int(count["break"]), last))
        if now != "RETIRED":
            state.setTimeoutTimestamp(max(int(last.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) + UNMATCHED * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["zone", "ts", "n", "state", "touches", "holds", "breaks"])

    return outcomes.withWatermark("ts", late).groupBy("zone").applyInPandasWithState(step, OUT, KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints; in the machine's own only where none is named and all runs here."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{(place or tempfile.mkdtemp(prefix='terrane-')).rstrip('/')}/{uuid.uuid4().hex}"


def run_once(source: DataFrame, make: Callable[[DataFrame], DataFrame], files: int = 1) -> DataFrame:
    """What the stream operator ``make`` gives for all of ``source``, which is written as files in the order of its column ts, streamed, and run to its end."""
    spark = source.sparkSession
    folder = shared_folder(spark)
    source.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    live = make(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    query = live.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{folder}/out")
