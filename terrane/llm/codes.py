"""Operator 13: vectors as codes of product codebooks, in integers throughout.

A component x becomes floor(256 * x); a vector is cut into ``PARTS`` equal parts, and each part's code is the nearest entry of its codebook. Parts
and entries, padded with zeros to a power of two, go through an integer Walsh-Hadamard transform, which multiplies squared distances by its size. The
squared differences of the transformed values are added up in sequency order (fewest sign changes first, where most of the difference lies): after the first one a guess is measured in
full, and entries whose sum exceeds the guess's are dropped as soon as it does. What is left at the end is exact; ties go to the lower index.

Codebooks start as the parts of the ``ENTRIES`` smallest ids (nulls last, repeated ids in the order of their vectors). A round's sums are made in the tasks, added up in Spark by entry and
position, and only these few numbers reach the driver. Sums travel in limbs of 40 bits, and batches whose numbers could leave 64 bits are computed with Python's integers,
so values of any size are exact; an error or sum of errors of 2**63 or more is null.

Rows whose vector is null or holds a null or non-finite component are left out. With fewer kept rows than entries there are as many entries as rows. Shorter
vectors, and lengths that ``PARTS`` does not divide, are padded with zeros. Repeated rows stay. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_LIMB = 40


def walsh(size: int) -> np.ndarray:
    """The Hadamard matrix of a power of two, rows in sequency order."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def padded(size: int) -> int:
    return 1 << max(0, size - 1).bit_length()


def safe(size: int) -> int:
    """Components below this keep all sums of a transformed part of this padded size within 64 bits."""
    return math.isqrt((1 << 63) // (4 * size**3))


def integers(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """rows x PARTS x size of floor(SCALE * x); of Python's integers where 64 bits might not do."""
    column = common.column(batch, "embedding")
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * np.float64(SCALE))
    if flat.size and not np.abs(flat).max() < safe(padded(size)):
        flat = np.array([math.floor(x * SCALE) if math.isfinite(x * SCALE) else int(x) * SCALE for x in column.flatten().to_pylist()], object)
    out = np.zeros((len(length), PARTS * size), object if flat.dtype == object else np.int64)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    out[row, place] = flat
    return out.reshape(len(length), PARTS, size)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``part`` (rows x size) the index of the nearest row of ``book``, and the squared distance."""
    m = padded(part.shape[1])
    h = walsh(m)[:, : part.shape[1]]  # the padding is zero
    wide = part.dtype == object or book.dtype == object or (book.size and np.abs(book).max() >= safe(m))
    if wide:
        part, book, h = part.astype(object), book.astype(object), h.astype(object)
    t, e = part @ h.T, book @ h.T
    rows_at = np.arange(len(t))
    first = (t[:, :1] - e[None, :, 0]) ** 2
    guess = first.argmin(1)
    bound = ((t - e[guess]) ** 2).sum(1)
    rows, cols = np.nonzero((first <= bound[:, None]).astype(bool))
    so_far = first[rows, cols]
    for j in range(1, m):
        so_far = so_far + (t[rows, j] - e[cols, j]) ** 2
        left = (so_far <= bound[rows]).astype(bool)
        rows, cols, so_far = rows[left], cols[left], so_far[left]
    starts = np.searchsorted(rows, rows_at)
    best = np.minimum.reduceat(so_far, starts) if len(rows) else so_far
    hit = np.flatnonzero((so_far == best[rows]).astype(bool))
    return cols[hit[np.searchsorted(rows[hit], rows_at)]], best // m


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows x PARTS of codes, and the errors by row."""
    codes, error = np.zeros(x.shape[:2], np.int64), 0
    for p in range(PARTS):
        codes[:, p], far = nearest(x[:, p], books[p])
        error = error + far.astype(object if far.dtype == object else np.int64)
    return codes, error


def kept(vectors: DataFrame) -> DataFrame:
    """The rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", finite))


def _limbs(x: int) -> list[tuple[int, int]]:
    sign, x, out, k = (-1 if x < 0 else 1), abs(int(x)), [], 0
    while x:
        if low := x & ((1 << _LIMB) - 1):
            out.append((k, sign * low))
        x >>= _LIMB
        k += 1
    return out


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks after ``rounds`` rounds: PARTS x entries x size (of objects where numbers are large)."""
    spark = vectors.sparkSession
    common.light_batches(spark)
    rows = kept(vectors).select("vec_id", "embedding")
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return np.zeros((PARTS, 0, 1), np.int64)
    size = max(1, -(-longest // PARTS))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    start = pa.RecordBatch.from_arrays([pa.array([list(r.embedding) for r in first], pa.list_(pa.float64()))], ["embedding"])
    books = integers(start, size).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, k, size = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)  # as many numbers as a few hundred vectors

    def add(batches):
        total = np.zeros((parts, k, size + 1), object)
        for batch in batches:
            for piece in common.pieces_of(batch):
                x = integers(piece, size)
                codes, _ = assigned(x, shared.value)
                mine = np.zeros((parts, k, size + 1), x.dtype)
                for p in range(parts):
                    np.add.at(mine[p], codes[:, p], np.concatenate([x[:, p], np.ones((len(x), 1), x.dtype)], 1))
                total += mine.astype(object)
        found = [(i, limb, value) for i, x in enumerate(total.ravel().tolist()) if x for limb, value in _limbs(x)]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["cell", "limb", "value"])

    sums = rows.select("embedding").mapInArrow(common.light(add), "cell long, limb long, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value"))
    total = np.zeros(parts * k * (size + 1), object)
    for r in sums.collect():  # a few numbers for each number of the codebooks
        total[r.cell] += r.value << (_LIMB * r.limb)
    total = total.reshape(parts, k, size + 1)
    out = books.astype(object)
    for p, e in np.argwhere(total[:, :, size].astype(bool)):
        out[p, e] = [s // total[p, e, size] for s in total[p, e, :size]]
    small = max((abs(x) for x in out.ravel().tolist()), default=0) < 1 << 62
    return out.astype(np.int64) if small else out


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of the rows that take part."""
    size = books.shape[2]
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rows = kept(vectors).select("vec_id", "label", "embedding")

    def run(batches):
        for batch in batches:
            for piece in common.pieces_of(batch):
                codes, error = assigned(integers(piece, size), shared.value)
                error = [x if x < 1 << 63 else None for x in error.tolist()]
                code = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([common.column(piece, "vec_id"), common.column(piece, "label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    common.light_batches(vectors.sparkSession)
    types = dict(rows.dtypes)
    return rows.mapInArrow(common.light(run), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel().tolist()).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """The contract's columns. A label may hold most rows: its sum is one row after counting, and is sent to the rows if labels are few."""
    books = fit(vectors)
    rows = common.stage(encode(vectors, books))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("error").isNull()).alias("lost"))
    sums = common.small(common.stage(sums.select("of", F.expr("if(lost > 0, null, try_cast(total as bigint))").alias("label_error"))), 100_000)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
