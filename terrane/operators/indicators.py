"""Series over one security's sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_session():
    """A security's rows in the order of sessions."""
    return Window.partitionBy("security_id").orderBy("session")


def frame(n: int):
    """The last n rows, this one included."""
    return by_session().rowsBetween(-(n - 1), 0)


def true_range(bars: DataFrame) -> DataFrame:
    last = F.lag("close").over(by_session())
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)))


def smoothed(df: DataFrame, column: str, out: str, n: int, weight: float | None = None, seeded: bool = True) -> DataFrame:
    """The recurrence ``y = y + (x - y) * weight`` (1 / n unless given) in the order of sessions. ``seeded``: it starts on the n-th row
    with the mean of the first n and is null before; otherwise it starts with the first value. One pass for each security."""
    a = weight if weight is not None else 1.0 / n

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        x, y = pdf[column].to_numpy(float), np.full(len(pdf), np.nan)
        start = n - 1 if seeded else 0
        if len(x) > start:
            y[start] = x[: start + 1].sum() / (start + 1)
            for i in range(start + 1, len(x)):
                y[i] = ((1 / a - 1) * y[i - 1] + x[i]) * a if seeded else y[i - 1] + (x[i] - y[i - 1]) * a
        return pdf.assign(**{out: pd.Series(y, index=pdf.index).astype(object).where(~np.isnan(y), None)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"
    return df.groupBy("security_id").applyInPandas(run, schema)


def wilder_atr(bars: DataFrame, n: int = 20) -> DataFrame:
    """``bars`` with tr and atr: the mean of the first n true ranges on row n, then ((n - 1) * atr + tr) / n."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        tr, atr = pdf["tr"].to_numpy(float), [None] * len(pdf)
        if len(tr) >= n:
            now = atr[n - 1] = float(tr[:n].sum() / n)
            for i in range(n, len(tr)):
                now = atr[i] = float((now * (n - 1) + tr[i]) / n)
        return pdf.assign(atr=pd.Series(atr, index=pdf.index, dtype=object))

    ranged = true_range(bars)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", atr double"
    return ranged.groupBy("security_id").applyInPandas(run, schema)


def triples(bars: DataFrame) -> DataFrame:
    """security_id, session, k, h, l, c: high, low and close over the close before; the first session has none."""
    last = F.lag("close").over(by_session())
    return bars.select("security_id", "session", "k", *((F.col(x) / last).alias(x[0]) for x in ("high", "low", "close"))).where(F.col("c").isNotNull())
