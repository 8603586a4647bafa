"""Operator 5: nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) is applied to each unit
vector, and the signed axis nearest to the result is its hash. ``TABLES`` such hashes make the index; a
query probes the ``PROBES`` nearest axes of each table. A bucket holds sketches, not vectors: unit vectors in bytes, with a
known bound of the error. What a bucket holds is compared with its queries in blocks of bounded size, and each block passes on
those that the bounds leave a place among its best ``k``; buckets that are large are split on both sides. Over all blocks the bounds
decide again, and only what is left meets the vectors themselves, for the exact cosine in double precision. So the sketches lose no
neighbour that the buckets hold. A query that finds fewer than ``k`` is compared with all rows, in blocks. Equal
vectors are indexed once, with their ``k + 1`` smallest ids, of which no more can be among the ``k`` nearest of anything.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
id; vectors of different lengths never meet. A repeated id is a row of its own: a query leaves out the rows
with its own id, and it is answered once, for that id's smallest bytes. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TABLES = 16
PROBES = 6
#: Hashes that are joined into one bucket number: more for very many rows.
HASHES = 1
#: Vectors, and queries, in one block.
BLOCK = 4096
EVERY = 50
SEED = 5


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """The pseudo-rotation number (table, part) of the rows of ``x``, padded to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng((SEED, table, part)).choice([-1.0, 1.0], (3, size))
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = y * s
        h = 1
        while h < size:
            y = y.reshape(len(x), -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), size)
            h *= 2
        y /= np.sqrt(size)
    return y


def buckets(x: np.ndarray, table: int, probes: int = 1, hashes: int = HASHES) -> np.ndarray:
    """The ``probes`` best buckets of each row of ``x`` in a table (rows x probes)."""
    best, value = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for part in range(hashes):
        y = rotated(x, table, part)
        signed = np.concatenate([y, -y], 1)
        top = np.argsort(-signed, 1, kind="stable")[:, :probes]
        score = np.take_along_axis(signed, top, 1)
        best = (best[:, :, None] * signed.shape[1] + top[:, None, :]).reshape(len(x), -1)
        value = (value[:, :, None] + score[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(-value, 1, kind="stable")[:, :probes]
        best, value = np.take_along_axis(best, keep, 1), np.take_along_axis(value, keep, 1)
    return best


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, raw (little-endian doubles), key of the vectors that take part."""

    def each(batch: pa.RecordBatch) -> dict:
        ids, raws = [], []
        for i, v in zip(common.column(batch, "vec_id").to_pylist(), common.column(batch, "embedding").to_pylist(), strict=True):
            if i is not None and v and None not in v:
                x = np.asarray(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    raws.append((x + 0.0).astype("<f8").tobytes())
        return {"vec_id": ids, "raw": raws}

    return common.arrow_pass(table.select("vec_id", "embedding"), {"vec_id": "long", "raw": "binary"}, each).withColumn("key", F.md5("raw"))


def unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), "<f8").reshape(len(raws), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketch(x: np.ndarray) -> np.ndarray:
    """Of unit vectors: the largest component (float32), then each component as a signed byte of it."""
    most = np.abs(x).max(1, keepdims=True).astype("<f4")
    parts = np.rint(x / most * 127).clip(-127, 127).astype(np.int8)
    return np.concatenate([most.view(np.uint8), parts.view(np.uint8)], 1)


def sketched(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that sketches stand for (float32) and how far from them the real ones may lie."""
    x = np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), -1)
    most = np.ascontiguousarray(x[:, :4]).view("<f4")
    return np.ascontiguousarray(x[:, 4:]).view(np.int8) * (most / np.float32(127)), most[:, 0] * np.float32(x.shape[1] ** 0.5 / 254 * 1.0001)


def distinct(found: DataFrame, k: int) -> DataFrame:
    """raw, ids, mark, near: each vector once, with its k + 1 smallest ids, a 64-bit hash and its sketch. The limit per vector holds before the shuffle, too."""
    w = Window.partitionBy("key").orderBy("vec_id")
    few = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    one = few.groupBy("key").agg(F.first("raw").alias("raw"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return _near(one.select("raw", "ids", F.xxhash64("raw").alias("mark")), {"raw": "binary", "ids": "array<long>", "mark": "long"})


def _near(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the sketches of its vectors ``raw``."""

    def each(batch: pa.RecordBatch) -> dict:
        raws = common.column(batch, "raw").to_pylist()
        near: list[bytes] = [b""] * len(raws)
        for size in {len(r) for r in raws}:
            mine = [i for i, r in enumerate(raws) if len(r) == size]
            for i, row in zip(mine, sketch(unit([raws[i] for i in mine])), strict=True):
                near[i] = row.tobytes()
        return {c: common.column(batch, c) for c in columns} | {"near": near}

    return common.arrow_pass(df, columns | {"near": "binary"}, each)


def _listed(df: DataFrame, name: str, tables: int, probes: int, hashes: int) -> DataFrame:
    """``name``, near, bucket: a row of ``df`` for each of its buckets."""

    def each(batch: pa.RecordBatch) -> dict:
        raws = common.column(batch, "raw").to_pylist()
        rows, bucket = [], []
        for size in sorted({len(r) for r in raws}):
            mine = [i for i, r in enumerate(raws) if len(r) == size]
            x = unit([raws[i] for i in mine])
            for t in range(tables):
                b = buckets(x, t, probes, hashes)
                rows.append(np.repeat(mine, b.shape[1]))
                bucket.append((b.ravel() * tables + t) * 100_003 + size)
        at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        return {c: common.column(batch, c).take(at) for c in (name, "near")} | {"bucket": np.concatenate(bucket) if bucket else []}

    return common.arrow_pass(df.select(name, "raw", "near"), {name: "long", "near": "binary", "bucket": "long"}, each)


def likely_in_block(q_ids: list[int], q_near: list[bytes], marks: list[int], near: list[bytes], k: int) -> list[tuple[int, int, float, float]]:
    """(query_id, mark, least and most that the cosine can be) of those of the block that may be among the k + 1 nearest of each query."""
    out = []
    for size in {len(r) for r in q_near}:
        mine = [i for i, r in enumerate(near) if len(r) == size]
        asked = [i for i, r in enumerate(q_near) if len(r) == size]
        if not mine:
            continue
        x, x_off = sketched([near[i] for i in mine])
        y, y_off = sketched([q_near[i] for i in asked])
        rough = y @ x.T
        off = y_off[:, None] + x_off * (1 + y_off[:, None]) + np.float32(1e-5)
        for row, i in enumerate(asked):
            least, most = rough[row] - off[row], rough[row] + off[row]
            keep = np.flatnonzero(most >= np.partition(least, -k - 1)[-k - 1]) if len(least) > k + 1 else range(len(least))
            out += [(q_ids[i], marks[mine[j]], float(least[j]), float(most[j])) for j in keep]
    return out


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``q`` and the same row of ``x``, by sums of one fixed order. Rows are scaled by powers of two first, which changes no digit."""
    two = lambda v: np.ldexp(1.0, -np.frexp(np.abs(v).max(-1, keepdims=True))[1])
    q, x = q * two(q), x * two(x)
    return (x * q).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def _in_blocks(asked: DataFrame, listed: DataFrame, k: int) -> DataFrame:
    """query_id, mark, least, most: the likely ones of every block. Buckets are cut into blocks by hashes of both sides' ids; how many follows
    from the buckets' counts, of which there are as many as buckets, whatever the number of rows."""

    def cuts(df: DataFrame) -> dict[int, int]:
        return {r["bucket"]: -(-r["n"] // BLOCK) for r in df.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).collect()}

    spark = asked.sparkSession
    sides = []
    for n, df in enumerate((asked, listed)):
        found = cuts(df)
        rows = spark.createDataFrame([*found.items()] or [(-1, 1)], f"bucket long, cut{n} int")
        sides.append(F.broadcast(rows))
    both = lambda df: df.join(sides[0], "bucket", "left").join(sides[1], "bucket", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("cut0", "cut1")})
    seat = lambda ids, cut: F.pmod(F.xxhash64(ids), F.col(cut)).cast("int")
    all_of = lambda cut: F.explode(F.sequence(F.lit(0), F.col(cut) - 1))
    q = both(asked).withColumn("i", seat("query_id", "cut0")).withColumn("j", all_of("cut1")).select("bucket", "i", "j", "query_id", "near")
    v = both(listed).withColumn("j", seat("mark", "cut1")).withColumn("i", all_of("cut0")).select("bucket", "i", "j", "mark", "near")

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            rows = likely_in_block(left.column("query_id").to_pylist(), left.column("near").to_pylist(), right.column("mark").to_pylist(), right.column("near").to_pylist(), k)
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("query_id", pa.int64()), ("mark", pa.int64()), ("least", pa.float64()), ("most", pa.float64())))})

    keys = ["bucket", "i", "j"]
    return q.groupBy(keys).cogroup(v.groupBy(keys)).applyInArrow(merge, "query_id long, mark long, least double, most double")


def _exact(likely: DataFrame, asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest of the likely ones, by the vectors themselves."""
    one = likely.groupBy("query_id", "mark").agg(F.max("least").alias("least"), F.max("most").alias("most"))
    w = Window.partitionBy("query_id").orderBy(F.desc("least"), "mark")
    cut = F.min(F.when(F.col("place") == k + 1, F.col("least"))).over(Window.partitionBy("query_id"))
    left = one.withColumn("place", F.row_number().over(w)).withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("most") >= F.col("cut"))).select("query_id", "mark")
    pairs = left.join(asked.select("query_id", F.col("raw").alias("q_raw")), "query_id").join(index.select("mark", "raw", "ids"), "mark")

    def each(batch: pa.RecordBatch) -> dict:
        q, x = (common.column(batch, c).to_pylist() for c in ("q_raw", "raw"))
        score = np.full(len(x), np.nan)
        for size in {len(r) for r in x}:
            mine = [i for i, r in enumerate(x) if len(r) == size == len(q[i])]
            if mine:
                score[mine] = cosines(*(np.frombuffer(b"".join(v[i] for i in mine), "<f8").reshape(len(mine), -1) for v in (q, x)))
        return {"query_id": common.column(batch, "query_id"), "ids": common.column(batch, "ids"), "score": score}

    scored = common.arrow_pass(pairs, {"query_id": "long", "ids": "array<long>", "score": "double"}, each).where(~F.isnan("score"))
    by_id = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return by_id.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(table: DataFrame, k: int = 5, every: int = EVERY, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``."""
    found = common.stage(vectors(table))
    index = common.stage(distinct(found, k))
    asked = found.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("raw").alias("raw"))
    asked = common.stage(_near(asked, {"query_id": "long", "raw": "binary"}))
    likely = _in_blocks(common.stage(_listed(asked, "query_id", tables, probes, hashes)), common.stage(_listed(index, "mark", tables, 1, hashes)), k)
    first = common.stage(_exact(likely, asked, index, k))
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = common.stage(asked.join(enough, "query_id", "left_anti"))
    if few.limit(1).count():
        whole = lambda df, name: df.select(name, "near", F.lit(0).cast("long").alias("bucket"))
        rest = _exact(_in_blocks(whole(few, "query_id"), whole(index, "mark"), k), few, index, k)
        first = first.join(few.select("query_id"), "query_id", "left_anti").unionByName(rest)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(table: DataFrame) -> DataFrame:
    return search(table)
