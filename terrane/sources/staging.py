"""Tables that cut the lineage of iterative jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..streaming.states import shared_folder


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the folder that driver and executors share, and read back: what is computed once survives lost executors."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
