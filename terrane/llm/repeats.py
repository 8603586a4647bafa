"""Operator 6: bytes covered by repeated strings of 200 bytes, from merged shards of sampled suffixes.

Every window of ``SPAN`` bytes picks one of the suffixes that start in it (the one whose first eight bytes hash lowest, the
first of equals), so equal windows pick the suffix at the same place, and about one suffix in seventy is
picked. A shard (one slice of the scan) lists its picked suffixes; the lists of all shards are interleaved by
the suffixes' first ``DEPTH`` bytes. Blocks with one suffix are settled and never looked at again. In a block
with more, each suffix has a surrounding: the bytes that the windows which picked it cover. Equal surroundings are one from the
shard on, with a mark if several suffixes have it, and the distinct ones of a block are refined, window by window, to the full depth:
windows that fall into one class are repeated, and so are all windows of a surrounding that several have. Where a surrounding
has repeated windows goes back to its suffixes by a join. So no suffix is sorted twice, and a unique text costs one key for each
seventy bytes.

Which windows are repeated is decided by 128-bit hashes of their whole 200 bytes. A block with more than
``HOT`` distinct surroundings is not gathered: its windows become rows, which Spark sorts into classes. Texts that occur twice are repeated throughout
if they hold 200 bytes, and take part in the merge once for each shard. Null text counts as empty. Rows are kept
one for one, repeated rows and ids included. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN = 200
DEPTH = 64
#: Distinct surroundings of one block that one task refines; larger blocks are refined by Spark.
HOT = 50_000
#: Surroundings that a task remembers, so as to pass each on once.
KEPT = 200_000
#: Rows of flags that are broadcast; more are joined by a shuffle.
SMALL = 200_000
#: Bits of the filter of repeated blocks: 16 for each, at most so many (64 MB).
FILTER_BITS = 1 << 29
#: Bytes of text in one shard.
SHARD = 2 << 20
#: Windows whose suffixes are picked at once. Places within such a stretch are packed in the low 24 bits of the hashes.
STRETCH = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


def _least(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    """For each of ``n`` places from ``at`` on: of the ``width`` places from there on, the one whose eight bytes hash lowest."""
    n += width - 1
    if n > int(_PLACE) + 1:
        raise ValueError(f"{n} places do not fit into the low 24 bits")
    value = np.ndarray((n,), "<u8", raw, at, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    value = (value & ~_PLACE) | np.arange(n, dtype=np.uint64)
    done = 1
    while done < width:  # value[i]: the least of the ``done`` places from i on
        step = min(done, width - done)
        value = np.minimum(value[:-step], value[step:])
        done += step
    return (value & _PLACE).astype(np.int64) + at


def picked(texts: list[bytes], span: int = SPAN, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """Of a shard: (text number, suffix start, first window start, last window start) of every picked suffix,
    starts counted within the text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    use = np.flatnonzero(lengths >= span)
    nothing = np.zeros(0, np.int64)
    if not len(use):
        return nothing, nothing, nothing, nothing
    raw = b"".join(texts[i] for i in use) + bytes(8)
    n = len(raw) - 8
    starts = np.concatenate([[0], np.cumsum(lengths[use])])
    valid = np.zeros(n, bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        valid[a : b - span + 1] = True
    runs = []
    for at in range(0, n - span + 1, STRETCH):
        count = min(STRETCH, n - span + 1 - at)
        window = np.flatnonzero(valid[at : at + count])
        if len(window):
            suffix, window = _least(raw, at, count, span - depth + 1)[window], window + at
            new = np.flatnonzero(np.concatenate([[True], (np.diff(suffix) != 0) | (np.diff(window) != 1)]))
            runs.append((window[new], window[np.append(new[1:], len(window)) - 1], suffix[new]))
    first, last, suffix = (np.concatenate(x) for x in zip(*runs, strict=True))
    new = np.flatnonzero(np.concatenate([[True], (suffix[1:] != suffix[:-1]) | (first[1:] != last[:-1] + 1)]))  # runs cut by a stretch's end are one
    first, last, suffix = first[new], last[np.append(new[1:], len(last)) - 1], suffix[new]
    text = np.searchsorted(starts, suffix, "right") - 1
    base = starts[text]
    return use[text], suffix - base, first - base, last - base


def _shards(batch: pa.RecordBatch):
    """(k1, k2, texts) of a batch, SHARD bytes at a time, each text once a shard."""
    k1, k2 = (common.column(batch, c).to_pylist() for c in ("k1", "k2"))
    held, size = {}, 0
    for a, b, text in zip(k1, k2, common.column(batch, "bytes").to_pylist(), strict=True):
        if text and (a, b) not in held:
            held[a, b] = text
            size += len(text)
            if size >= SHARD:
                yield [*held], [*held.values()]
                held, size = {}, 0
    if held:
        yield [*held], [*held.values()]


def _keys(texts: list[bytes], text: np.ndarray, suffix: np.ndarray, depth: int) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(texts[t][s : s + depth]) for t, s in zip(text.tolist(), suffix.tolist(), strict=True)), np.uint64, len(text)).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    common.light_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text), "bytes": text.cast("binary")})


def _blocks(keyed: DataFrame, span: int, depth: int) -> DataFrame:
    """key, n of the blocks with several suffixes: the interleaved lists of all shards."""

    def lists(batches):
        for batch in batches:
            for part in common.pieces_of(batch):
                for _, texts in _shards(part):
                    keys, n = np.unique(_keys(texts, *picked(texts, span, depth)[:2], depth), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    return keyed.select("k1", "k2", "bytes").mapInArrow(common.light(lists), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _filter(blocks: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the column ``key``, of bounded size: a key whose bit is clear is not there. Built in Spark, 2**17 bits to a row."""
    bits = 1 << 17
    want = 16 * blocks.count()
    while bits < want and bits < most_bits:
        bits *= 2
    low = bits - 1

    def build(table: pa.Table) -> pa.Table:
        at = np.asarray(table.column("bit")) & 0x1FFFF
        flags = np.zeros(1 << 17, np.uint8)
        flags[at] = 1
        return pa.table({"chunk": pa.array([int(table.column("chunk")[0].as_py())], pa.int64()), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    placed = blocks.select(F.col("key").bitwiseAND(F.lit(low)).alias("bit")).withColumn("chunk", F.shiftright("bit", 17))
    out = np.zeros(bits // 8, np.uint8)
    for row in placed.groupBy("chunk").applyInArrow(build, "chunk long, flags binary").collect():
        out[row.chunk << 14 : (row.chunk + 1) << 14] = np.frombuffer(row.flags, np.uint8)
    return out


def _has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & (len(bitmap) * 8 - 1)
    return ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def _found(batches, bitmap: np.ndarray, span: int, depth: int):
    """Of each shard, the suffixes whose blocks may have several: (key, k1, k2, start of the first window, surroundings, their digests as
    rows of two numbers)."""
    for batch in batches:
        for part in common.pieces_of(batch):
            for ids, texts in _shards(part):
                text, suffix, first, last = picked(texts, span, depth)
                keys = _keys(texts, text, suffix, depth)
                keep = _has(bitmap, keys)
                text, first, last = text[keep], first[keep], last[keep]
                around = [texts[t][a : b + span] for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True)]
                digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, around)), "<i8").reshape(-1, 2)
                id_ = np.array(ids, np.int64).reshape(-1, 2)[text]
                yield keys[keep], id_[:, 0], id_[:, 1], first, around, digests


def _surroundings(keyed: DataFrame, bitmap: np.ndarray, span: int, depth: int) -> DataFrame:
    """key, d1, d2, around, many. A task passes a surrounding on once, and once more without its bytes, with ``many`` set, if another suffix of
    the task has it, too. k1, k2, start tell which suffix a row stands for."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap)

    def lists(batches):
        seen: dict[tuple[int, int], tuple[int, int, int] | None] = {}
        for key, k1, k2, start, around, digests in _found(batches, shared.value, span, depth):
            if len(seen) > KEPT:
                seen = {}
            at, once = [], []
            for i, (d, member) in enumerate(zip(zip(*digests.T.tolist(), strict=True), zip(k1.tolist(), k2.tolist(), start.tolist(), strict=True), strict=True)):
                if d not in seen:
                    seen[d] = member
                    at.append(i)
                    once.append(True)
                elif seen[d] is not None and seen[d] != member:
                    seen[d] = None
                    at.append(i)
                    once.append(False)
            columns = [key[at], digests[at, 0], digests[at, 1], k1[at], k2[at], start[at]]
            own = pa.array([around[i] if o else None for i, o in zip(at, once, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), own], ["key", "d1", "d2", "k1", "k2", "start", "around"])

    return keyed.select("k1", "k2", "bytes").mapInArrow(common.light(lists), "key long, d1 long, d2 long, k1 long, k2 long, start long, around binary")


def _runs(flags: np.ndarray, span: int) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1 + span).tolist()


def refined(block: list[tuple[bytes, bool]], span: int = SPAN) -> list[tuple[list[int], list[int]]]:
    """(starts, ends) of the repeated ranges in each of a block's distinct surroundings (bytes, whether several suffixes have it)."""
    flags = [np.full(len(around) - span + 1, many, bool) for around, many in block]
    if len(block) > 1:
        seen: dict[bytes, tuple[int, int]] = {}
        digest = xxhash.xxh3_128_digest
        for n, (around, _) in enumerate(block):
            for i in range(len(flags[n])):
                other = seen.setdefault(digest(around[i : i + span]), (n, i))
                if other != (n, i):
                    flags[n][i] = flags[other[0]][other[1]] = True
    return [_runs(f, span) for f in flags]


def _settled(surroundings: DataFrame, span: int, hot: int) -> DataFrame:
    """d1, d2, starts, ends of the surroundings with repeated windows; with ``around`` and ``many`` instead, those of blocks with
    more than ``hot``, which are still open. Blocks arrive sorted, one after another."""
    names = ["d1", "d2", "starts", "ends", "around", "many"]

    def merge(batches):
        out: list[tuple] = []
        block: list[list] = []  # [d1, d2, first suffix, bytes, many]
        key, open_ = None, False

        def settle():
            if open_:
                out.extend((d1, d2, None, None, around, many) for d1, d2, _, around, many in block)
            elif len(block) > 1 or block and block[0][4]:
                found = refined([(around, many) for *_, around, many in block], span)
                out.extend((d1, d2, *f, None, None) for (d1, d2, *_), f in zip(block, found, strict=True) if f[0])
            block.clear()

        for batch in batches:
            columns = [common.column(batch, c).to_pylist() for c in ("key", "d1", "d2", "k1", "k2", "start", "around")]
            for k, d1, d2, *member, around in zip(*columns, strict=True):
                if k != key:
                    settle()
                    key, open_ = k, False
                if block and block[-1][0] == d1 and block[-1][1] == d2:
                    block[-1][3] = block[-1][3] or around
                    block[-1][4] |= block[-1][2] != member
                else:
                    open_ = open_ or len(block) > hot
                    if open_:
                        settle()
                    block.append([d1, d2, member, around, False])
                if len(out) > 5000:
                    yield _table(out)
                    out = []
        settle()
        yield _table(out)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return surroundings.repartition("key").sortWithinPartitions("key", "d1", "d2").mapInArrow(common.light(merge), "d1 long, d2 long, starts array<int>, ends array<int>, around binary, many boolean")


def _by_windows(still: DataFrame, span: int) -> DataFrame:
    """d1, d2, starts, ends of open surroundings: each of their windows is a row, and rows with one digest are a class."""

    def windows(batches):
        for batch in batches:
            around = common.column(batch, "around").to_pylist()
            n = np.array([len(x) - span + 1 for x in around], np.int64)
            row, at = pa.array(np.repeat(np.arange(len(n)), n)), np.concatenate([np.arange(x, dtype=np.int32) for x in n]) if len(n) else np.zeros(0, np.int32)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[i : i + span]) for x in around for i in range(len(x) - span + 1)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c).take(row) for c in ("d1", "d2", "many")), pa.array(at), pa.array(digests[:, 0]), pa.array(digests[:, 1])], ["d1", "d2", "many", "at", "w1", "w2"])

    listed = common.stage(still.select("d1", "d2", "around", "many").mapInArrow(common.light(windows), "d1 long, d2 long, many boolean, at int, w1 long, w2 long"))
    one = F.struct("d1", "d2", "at")
    classes = listed.groupBy("w1", "w2").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.max("many").alias("several")).where("low != high or several").select("w1", "w2")
    hit = listed.join(classes, ["w1", "w2"], "left_semi").groupBy("d1", "d2").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    return hit.withColumn("ends", F.transform("starts", lambda x: x + F.lit(span)))


def _members(keyed: DataFrame, blocks: np.ndarray, flagged: np.ndarray, span: int, depth: int) -> DataFrame:
    """d1, d2, k1, k2, start of the suffixes whose surroundings may have repeated windows."""
    shared = keyed.sparkSession.sparkContext.broadcast((blocks, flagged))

    def lists(batches):
        blocks, flagged = shared.value
        for _, k1, k2, start, _, digests in _found(batches, blocks, span, depth):
            keep = _has(flagged, digests[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (digests[:, 0], digests[:, 1], k1, k2, start)], ["d1", "d2", "k1", "k2", "start"])

    return keyed.select("k1", "k2", "bytes").mapInArrow(common.light(lists), "d1 long, d2 long, k1 long, k2 long, start long")


def repeated(docs: DataFrame, span: int = SPAN, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """k1, k2 (a text's key), copies, starts, ends: the repeated ranges of every text that has any, not yet joined, and how
    many rows hold the text."""
    keyed = _keyed(docs)
    blocks = _filter(common.stage(_blocks(keyed, span, depth)))
    settled = common.stage(_settled(_surroundings(keyed, blocks, span, depth), span, hot))
    flags, still = settled.where("around is null").select("d1", "d2", "starts", "ends"), settled.where("around is not null")
    if still.limit(1).count():
        flags = common.stage(flags.unionByName(_by_windows(still, span)))
    members = _members(keyed, blocks, _filter(flags.select(F.col("d1").alias("key"))), span, depth)
    moved = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct((x["starts"] + F.col("start")).alias("start"), (x["ends"] + F.col("start")).alias("end")))
    ranges = members.join(common.small(flags, SMALL), ["d1", "d2"]).groupBy("k1", "k2").agg(F.flatten(F.collect_list(moved)).alias("r"))
    copies = keyed.select("k1", "k2").groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    both = ranges.join(copies, ["k1", "k2"], "full")
    return both.select("k1", "k2", F.coalesce("copies", F.lit(1)).alias("copies"), F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))


def merged(starts: list[int] | None, ends: list[int] | None, copies: int, length: int, span: int = SPAN) -> list[tuple[int, int]]:
    """The ranges joined where they touch or overlap; the whole of a text with copies."""
    if copies and copies > 1:
        return [(0, length)] if length >= span else []
    out: list[list[int]] = []
    for a, b in sorted(zip(starts or (), ends or (), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _with_ranges(docs: DataFrame, span: int) -> DataFrame:
    found = common.stage(repeated(docs, span))
    return _keyed(docs).join(found, ["k1", "k2"], "left")


def _cuts(batch: pa.RecordBatch, span: int):
    columns = [common.column(batch, c).to_pylist() for c in ("bytes", "starts", "ends", "copies")]
    for raw, starts, ends, copies in zip(*columns, strict=True):
        yield raw, merged(starts, ends, copies, len(raw), span)


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def each(batch: pa.RecordBatch) -> dict:
        cuts = list(_cuts(batch, span))
        return {
            "doc_id": common.column(batch, "doc_id"), "n_bytes": [len(raw) for raw, _ in cuts], "n_removed": [sum(b - a for a, b in s) for _, s in cuts],
            "n_spans": [len(s) for _, s in cuts], "kept_sha256": [hashlib.sha256(_kept(raw, s)).hexdigest() for raw, s in cuts],
        }

    rows = _with_ranges(docs.select("doc_id", "text"), span).select("doc_id", "bytes", "starts", "ends", "copies")
    return common.arrow_pass(rows, {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}, each)


def cut(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (characters that are cut through go as a whole) and n_chars counted
    anew, if there. Rows of which nothing is left go; rows that were empty stay."""
    docs, back = common.shielded(docs)
    columns = docs.columns
    n_chars = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        for batch in batches:
            texts = []
            for raw, spans in _cuts(batch, span):
                texts.append(_kept(raw, spans).decode("utf-8", "ignore") if spans else None)
            now = [old if new is None else new for new, old in zip(texts, common.column(batch, "text").to_pylist(), strict=True)]
            keep = pa.array([new is None or new.strip() != "" for new in texts], pa.bool_())
            out = [batch.column(i) for i in range(len(columns))]
            out[columns.index("text")] = pa.array(now, pa.string())
            if n_chars is not None:
                old = out[n_chars]
                out[n_chars] = pa.array([c if new is None else len(new) for new, c in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(keep)

    rows = _with_ranges(docs, span).select(*columns, "bytes", "starts", "ends", "copies")
    return back(rows.mapInArrow(common.light(run), docs.schema))
