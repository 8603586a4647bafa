"""Operator 8: best-fit packing with exact complements.

A document becomes its ids and an end mark. Only documents longer than ``size`` are cut: the first piece
takes what is left over, all others are full. Which pieces share a sequence depends on nothing but the
number of pieces of each length, at most ``size`` numbers, so the plan is made from that histogram alone:

1. full pieces stand alone;
2. exact fills: from the longest length down, two, three or four lengths that sum to ``size`` (the
   complement is looked up in the tables of single, pair and triple sums) are used as often as the counts allow;
3. what is left is placed best-fit decreasing, a length's whole count at a time.

Spark numbers the pieces of each length (counts by partition, then an offset) and each finds its sequence
in the plan by its number. The plan has a few entries for each length, however many documents there are.

Null text counts as empty: one piece holding the end mark alone. Rows are kept one for one, repeated rows
and ids included. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

SIZE = 1024
END = 2


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, kept: int = bpe.KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and doc_row (unique for each input row). ``kept``: units that a worker keeps."""
    path, mark = path or bpe.vocabulary_path(), np.uint32(end).astype("<u4").tobytes()

    def each(batch: pa.RecordBatch) -> dict:
        out = defaultdict(list)
        encoder = bpe.encoder(path)
        encoder.kept = kept
        ids = encoder.encode_many(common.texts(batch))
        for doc, row, raw in zip(common.column(batch, "doc_id").to_pylist(), common.column(batch, "doc_row").to_pylist(), ids, strict=True):
            raw += mark
            n = len(raw) // 4
            first = n % size or size
            for k, stop in enumerate(range(first, n + 1, size)):
                start = max(0, stop - size) if k else 0
                for name, value in (("doc_id", doc), ("doc_row", row), ("piece", k), ("start", start), ("length", stop - start), ("ids_crc32", zlib.crc32(raw[4 * start : 4 * stop]))):
                    out[name].append(value)
        return {k: out[k] for k in ("doc_id", "doc_row", "piece", "start", "length", "ids_crc32")}

    ddl = {"doc_id": "long", "doc_row": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
    return common.arrow_pass(docs.select("doc_id", "text").withColumn("doc_row", F.monotonically_increasing_id()), ddl, each, bpe.forget)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, how many, first sequence, offset): pieces of this length with these numbers go
    to consecutive sequences at this offset. ``counts``: pieces by length, at most ``size`` entries."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, out, sequences = np.zeros(size + 1, np.int64), [], 0

    def fill(parts: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for p in parts:
            out.append((p, int(used[p]), times, sequences, offset))
            used[p] += times
            left[p] -= times
            offset += p
        sequences += times

    def times(parts: list[int]) -> int:
        return int(min(left[p] // parts.count(p) for p in parts))

    if left[size]:
        fill([size], int(left[size]))
    for longest in range(size - 1, 0, -1):
        while left[longest] and (parts := _complement(left, longest, size)):
            fill(parts, times(parts))
    # Best fit decreasing of the residue. open_[r]: groups of sequences with room r, as (first sequence, how many).
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        while left[length]:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                first, n = open_[room].pop()
                rooms[room] = bool(open_[room])
                take = min(n, int(left[length]))
                if take < n:
                    open_[room].append((first + take, n - take))
                    rooms[room] = True
            else:
                room, first = size, sequences
                # as many to a sequence as fit: the rest of this length follows into the room that is left
                take = -(-int(left[length]) // (size // length))
                sequences += take
            out.append((length, int(used[length]), take, first, size - room))
            used[length] += take
            left[length] -= take
            open_[room - length].append((first, take))
            rooms[room - length] = True
    return out


def _complement(left: np.ndarray, longest: int, size: int) -> list[int] | None:
    """One, two or three available lengths, none above ``longest``, that fill ``size`` with it exactly."""
    gap, left = size - longest, left.copy()
    left[longest] -= 1
    have = left > 0
    have[longest + 1 :] = False
    if gap <= longest and have[gap]:
        return [longest, gap]
    if pair := _pair(left, have, gap):
        return [longest, *pair]
    for second in np.flatnonzero(have[1:gap])[::-1] + 1:  # the triple: its longest part, then a pair for the rest
        left[second] -= 1
        pair = _pair(left, (left > 0) & have, gap - int(second))
        left[second] += 1
        if pair:
            return [longest, int(second), *pair]
    return None


def _pair(left: np.ndarray, have: np.ndarray, gap: int) -> list[int] | None:
    """Two available lengths that sum to ``gap``, as even as can be."""
    if gap < 2:
        return None
    both = have[1:gap] & have[1:gap][::-1]
    if gap % 2 == 0 and left[gap // 2] < 2:
        both[gap // 2 - 1] = False
    found = np.flatnonzero(both[: (gap + 1) // 2])
    return [gap - int(found[-1]) - 1, int(found[-1]) + 1] if len(found) else None


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``number``: 0, 1, 2 … within ``key``. Each partition numbers its own rows and adds what the
    partitions before it hold, so a key with many rows is never gathered. ``df`` must be staged and must carry
    ``part`` (the partition that made the row) and the columns ``doc_row`` and ``piece`` that order its rows."""
    counts = df.groupBy("part", key).agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("part", key).orderBy("doc_row", "piece")
    return df.join(starts, ["part", key]).withColumn("number", F.col("before") + F.row_number().over(own) - 1).drop("part", "before")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, kept: int = bpe.KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece's place."""
    made = common.stage(pieces(docs, path, size, end, kept).withColumn("part", F.spark_partition_id()))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by_length = defaultdict(list)
    for length, first, _, sequence, offset in plan(counts, size):
        by_length[length].append((first, sequence, offset))
    table = {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for k, v in by_length.items()}
    table = docs.sparkSession.sparkContext.broadcast(table)

    def each(batch: pa.RecordBatch) -> dict:
        lengths, numbers = (np.asarray(common.column(batch, x)) for x in ("length", "number"))
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            first, sequences, offsets = table.value[int(length)]
            rows = np.flatnonzero(lengths == length)
            k = np.searchsorted(first, numbers[rows], "right") - 1
            sequence[rows], offset[rows] = sequences[k] + numbers[rows] - first[k], offsets[k]
        return {c: common.column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

    ddl = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "sequence_id": "long", "offset": "long"}
    return common.arrow_pass(numbered(made, "length"), ddl, each)
