"""What the training-data operators share: staging, Arrow passes, broadcasts of checked size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow types by the names used in the DDL strings of this subpackage.
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine's own only where none is named and all run on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="terrane-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: a cut in the lineage that
    survives lost executors."""
    spark = df.sparkSession
    light_batches(spark)
    path = f"{shared_dir(spark)}/terrane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_pass(df: DataFrame, ddl: dict[str, str], each: Callable[[pa.RecordBatch], dict], done: Callable[[], None] | None = None) -> DataFrame:
    """One Arrow pass over every batch. ``each`` maps a batch to columns named as in ``ddl``; ``done`` is called at the end of a task, to give back what it
    has kept: Python workers live on."""
    schema = pa.schema([(k, ARROW[v]) for k, v in ddl.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                out = each(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        if done:
            done()

    light_batches(df.sparkSession)
    return df.mapInArrow(light(run), ", ".join(f"`{k}` {v}" for k, v in ddl.items()))


def light(run: Callable) -> Callable:
    """``run`` (batches to batches), after whose end the worker's memory goes back to the system: workers live on, two beside each executor's heap, and what one task has freed would be
    kept for the next one."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def light_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Fewer rows and bytes to an Arrow batch, unless the session says otherwise: texts are long, and a batch is held several times over."""
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(value))


def pieces_of(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes, so that Python never holds much text at once."""
    rows = max(1, min(batch.num_rows, most * max(1, batch.num_rows) // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def small(df: DataFrame, most: int, weight=None) -> DataFrame:
    """``df`` marked for broadcast if it is staged and has at most ``most`` rows, or a total ``weight`` (a column, for rows of unbounded width) of at most that;
    otherwise as it is, for a shuffled join."""
    size = df.limit(most + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def id_hash_mod(column_name: str, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``; null where the id is null."""
    return F.pmod(F.crc32(F.col(column_name).cast("string").cast("binary")), F.lit(divisor))


#: Columns that operators know by name; all others are renamed while an operator works.
KNOWN = ("doc_id", "text", "n_chars")


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every unknown column under a name that clashes with no operator's, and the way back."""
    inner = [c if c in KNOWN else f"__{i}" for i, c in enumerate(docs.columns)]
    names = list(docs.columns)
    return docs.toDF(*inner), lambda df: df.select(*(F.col(a).alias(b) for a, b in zip(inner, names, strict=True)))
