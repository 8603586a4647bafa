"""Operator 11: phrase collocations, by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z only), cut into pieces at ``. , ; : ! ?`` and line breaks and these into words at spaces and tabs, all on the
UTF-8 bytes of an Arrow batch: no Python string is made for a word. Prefix sums of byte polynomials give every word's hash, prefix sums of
word polynomials every n-gram's (modulo 2**64); a fingerprint is the mixed n-gram hash with n and the language. Three passes:

1. words and pairs, 2. phrases of three and four words whose pairs are all frequent: a task counts the fingerprints of a block, packs them by
bucket (their leading bits) and the shuffle adds them up by bucket. Only leading bits travel: phrases that share them are counted together, which
can let a rare phrase through but never loses a frequent one. What is frequent becomes a bitmap of at most ``BITMAP`` bits, indexed by leading bits.
3. occurrences that the bitmaps let through are verified against the text: a block's words are compared byte by byte with the word that stands for
their hash, phrases are told apart by exact words, and only these phrases are written out and summed in Spark by language and text. So
counts are exact, whatever collides; a bitmap that is too small for its phrases costs shuffle, not results.

Null text counts as empty, null ``lang`` as ``und``. Repeated rows count as often as they occur. Ties in score go to the higher count, then to
the smaller phrase in the order of UTF-8 bytes. Empty table, or nothing frequent: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A phrase is a candidate from this count on; words of the longest; rows of a language that are reported.
LEAST, WORDS, TOP = 30, 4, 2000
#: A candidate goes if a longer one that holds it has COVER percent of its occurrences.
COVER = 80
#: Words that a task counts before it passes them on; bytes that are looked at once.
BLOCK, SECTION = 500_000, 1 << 19
#: Bytes of text to a bucket of the shuffle, fewest buckets, and most bits of a bitmap of frequent fingerprints (64 MB).
BUCKET_BYTES, BUCKETS, BITMAP = 32 << 20, 2048, 1 << 29

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte classes: 0 of a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = 2
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_POWERS: dict[tuple[str, bool], np.ndarray] = {}


def _powers(base: str, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0, 1, … modulo 2**64, or of its inverse; kept by the worker and grown as needed."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        b = pow(_BASES[base], -1, 1 << 64) if inverse else _BASES[base]
        have = np.full(max(n, 1024), b, np.uint64)
        have[0] = 1
        _POWERS[(base, inverse)] = have = np.multiply.accumulate(have)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _prefix(values: np.ndarray, base: str) -> np.ndarray:
    """0 and the running sums of values[i] * base ** i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=out[1:])
    return out


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of each word, from prefix sums over the section; a word of more than a section is summed up in stretches."""
    if len(raw) <= 2 * SECTION:
        p = _prefix(_BYTES[raw], "byte")
        return _mixed((p[ends] - p[starts]) * _powers("byte", len(raw), True)[starts])
    out = np.zeros(len(starts), np.uint64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        total = 0
        for at in range(a, b, SECTION):
            part = _prefix(_BYTES[raw[at : min(b, at + SECTION)]], "byte")[-1]
            total += int(part) * pow(_BASES["byte"], at - a, 1 << 64)
        out[i] = total % (1 << 64)
    return _mixed(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on, from prefix sums over the words; equal words in a row give equal hashes anywhere."""
    p = _prefix(words, "word")
    m = max(0, len(words) - n + 1)
    return (p[n : n + m] - p[:m]) * _powers("word", m, True)


class Section:
    """The words of a stretch of text in their order: raw (lower-cased bytes), starts, ends, hashes, piece (a number that changes where words are in
    different pieces), lang (a hash of their document's language), doc (row of the batch). The first ``carried`` are the last of the section before."""

    def __init__(self, raw, starts, ends, hashes, piece, doc, lang, carried):
        self.raw, self.starts, self.ends, self.hashes, self.piece, self.doc, self.lang, self.carried = raw, starts, ends, hashes, piece, doc, lang, carried

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places (number of the first word) of the phrases of n words that end in this section, and their fingerprints."""
        m = max(0, len(self.hashes) - n + 1)
        at = np.flatnonzero(self.piece[:m] == self.piece[n - 1 : n - 1 + m])
        at = at[at + n > self.carried]
        return at, _mixed(gram_hashes(self.hashes, n)[at] + self.lang[at] * np.uint64(2 * n + 1))


def sections(batch: pa.RecordBatch) -> Iterator[Section]:
    """The batch's texts in stretches of about ``SECTION`` bytes that end between words; phrases over their ends are found through carried words."""
    text = common.column(batch, "text").fill_null("")
    text = pa.concat_arrays([text]) if text.offset else text
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[: len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    names = [x if x is not None else "und" for x in common.column(batch, "lang").to_pylist()]
    langs = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
    at, stop, last, pieces = int(offsets[0]), int(offsets[-1]), None, 0
    while at < stop:
        end = min(stop, at + SECTION)
        if end < stop and (cuts := np.flatnonzero(_CLASS[data[at:end]])).size:
            end = at + int(cuts[-1]) + 1
        while end < stop and not _CLASS[data[end - 1]]:  # a word of more than a section: up to the next separator
            cuts = np.flatnonzero(_CLASS[data[end : end + SECTION]])
            end = end + int(cuts[0]) + 1 if cuts.size else min(stop, end + SECTION)
        raw = _LOWER[data[at:end]]
        kind = _CLASS[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = kind == 0
        step = np.diff(inside)
        starts, after = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        first = np.unique(offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "left")] - at)
        glued = first[(inside[first] & inside[first + 1]).astype(bool)]  # words end where documents do
        if len(glued):
            starts, after = np.sort(np.concatenate([starts, glued])), np.sort(np.concatenate([after, glued]))
        doc = np.searchsorted(offsets, starts + at, "right") - 1
        breaks = np.cumsum(kind == 2)[starts] if len(starts) else starts
        piece = pieces + breaks + doc
        pieces += int((kind == 2).sum())
        hashes = word_hashes(raw, starts, after)
        if last is not None:
            s = Section(raw, *(np.concatenate([a, b]) for a, b in zip(last, (starts, after, hashes, piece, doc), strict=True)), None, len(last[0]))
        else:
            s = Section(raw, starts, after, hashes, piece, doc, None, 0)
        s.lang = langs[s.doc] if len(s.doc) else np.zeros(0, np.uint64)
        yield s
        keep = WORDS - 1
        last = (np.full(min(keep, len(s.starts)), -1), np.full(min(keep, len(s.starts)), -1), s.hashes[-keep:], s.piece[-keep:], s.doc[-keep:])
        at = end


class Frequent:
    """A set of fingerprints by their leading bits; may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.shift = bits, np.uint64(64 - log)

    def has(self, prints: np.ndarray) -> np.ndarray:
        at = prints >> self.shift
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _packed(prints: list[np.ndarray], log: int, least: int) -> Iterator[pa.RecordBatch]:
    """A block's fingerprints by bucket: their next 32 bits, sorted, and counts up to ``least``."""
    if not prints:
        return
    values, counts = np.unique(np.concatenate(prints) >> np.uint64(32 - log), return_counts=True)
    counts = np.minimum(counts, least).astype("<u4" if least > 255 else np.uint8)
    low = values.astype("<u4")
    ends = np.searchsorted(values, np.arange(1, (1 << log) + 1, dtype=np.uint64) << np.uint64(32))
    begins = np.concatenate([[0], ends[:-1]])
    some = np.flatnonzero(ends > begins)
    for at in range(0, len(some), 1024):
        part = [(int(b), low[begins[b] : ends[b]].tobytes(), counts[begins[b] : ends[b]].tobytes()) for b in some[at : at + 1024]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.binary()), pa.array([x[2] for x in part], pa.binary())], ["bucket", "prints", "counts"])


def frequent(docs: DataFrame, sizes: tuple[int, ...], log: int, least: int, known: list) -> Frequent:
    """The fingerprints of phrases of ``sizes`` words that occur ``least`` times or more; longer ones only where all their pairs are in ``known``."""
    spark = docs.sparkSession

    def count(batches):
        block, held = [], 0
        pairs = known[0].value if known else None
        for batch in batches:
            for part in common.pieces_of(batch):
                for s in sections(part):
                    good = None
                    if pairs is not None:
                        at, prints = s.fingerprints(2)
                        good = np.zeros(len(s.hashes) + WORDS, bool)
                        good[at] = pairs.has(prints)
                        if s.carried:  # pairs that end among the carried words have passed before
                            good[: s.carried - 1] = True
                    for n in sizes:
                        at, prints = s.fingerprints(n)
                        if good is not None:
                            prints = prints[np.logical_and.reduce([good[at + i] for i in range(n - 1)])]
                        block.append(prints)
                    held += len(s.hashes)
                    if held >= BLOCK:
                        yield from _packed(block, log, least)
                        block, held = [], 0
        yield from _packed(block, log, least)

    def add(table: pa.Table) -> pa.Table:
        prints = np.frombuffer(b"".join(table["prints"].to_pylist()), "<u4")
        n = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4" if least > 255 else np.uint8)
        order = np.argsort(prints, kind="stable")
        prints, n = prints[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        often = prints[first][np.add.reduceat(n, first) >= least]
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int64()), "n": pa.array([len(often)], pa.int64()), "prints": pa.array([often.tobytes()], pa.binary())})

    common.light_batches(spark)
    blocks = docs.select("text", "lang").mapInArrow(common.light(count), "bucket long, prints binary, counts binary")
    found = common.stage(blocks.groupBy("bucket").applyInArrow(add, "bucket long, n long, prints binary").where("n > 0"))
    total = found.agg(F.sum("n")).first()[0] or 0
    width = max(log + 3, 16)
    while 1 << width < min(BITMAP, 64 * total):
        width += 1

    def bits(batch: pa.RecordBatch) -> dict:
        out = []
        for bucket, prints in zip(common.column(batch, "bucket").to_pylist(), common.column(batch, "prints").to_pylist(), strict=True):
            lead = np.frombuffer(prints, "<u4") >> np.uint32(32 - (width - log))
            flags = np.zeros(1 << (width - log), np.uint8)
            flags[lead] = 1
            out.append(np.packbits(flags, bitorder="little").tobytes())
        return {"bucket": common.column(batch, "bucket"), "bits": out}

    whole = np.zeros(1 << (width - 3), np.uint8)
    share = 1 << (width - log - 3)
    for row in common.arrow_pass(found.select("bucket", "prints"), {"bucket": "long", "bits": "binary"}, bits).collect():  # at most BITMAP bits in all
        whole[row.bucket * share : (row.bucket + 1) * share] = np.frombuffer(bytes(row.bits), np.uint8)
    return Frequent(whole, width)


class _Words:
    """Exact numbers of a block's words, by their bytes."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def of(self, s: Section) -> np.ndarray:
        """The numbers of the section's own words. Each is compared with the first word of its hash, byte by byte; what differs is looked up by itself."""
        starts, ends, hashes = s.starts[s.carried :], s.ends[s.carried :], s.hashes[s.carried :]
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        stand_in = first[inverse]
        length = ends - starts
        wrong = length != length[stand_in]
        order = np.argsort(length, kind="stable")
        size, begin = np.unique(length[order], return_index=True)
        for n, group in zip(size.tolist(), np.split(order, begin[1:]), strict=True):
            step = max(1, (1 << 20) // n)
            for at in range(0, len(group), step):
                g = group[at : at + step]
                column = np.arange(n)
                wrong[g] |= (s.raw[starts[g][:, None] + column] != s.raw[np.minimum(starts[stand_in[g]][:, None] + column, len(s.raw) - 1)]).any(1)
        raw, number = s.raw.tobytes(), self.number
        get = lambda i: number.setdefault(raw[starts[i] : ends[i]], len(number))
        out = np.fromiter(map(get, first.tolist()), np.int64, len(first))[inverse]
        for i in np.flatnonzero(wrong).tolist():
            out[i] = get(i)
        return out


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of these tables of numbers (below 2**31) and how often each occurs."""
    rows = np.concatenate(grams)
    code = rows[:, 0]
    for i in range(1, rows.shape[1]):
        _, code = np.unique(code << 32 | rows[:, i], return_inverse=True)
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return rows[first], n


def counted(docs: DataFrame, often: dict[int, object], least: int = LEAST) -> DataFrame:
    """lang, phrase, words, f of all phrases that occur ``least`` times in a language; ``often``: a broadcast set of fingerprints by number of words."""

    def count(batches):
        words, grams, held = _Words(), {}, 0
        for batch in batches:
            for part in common.pieces_of(batch):
                names = [x if x is not None else "und" for x in common.column(part, "lang").to_pylist()]
                last = np.zeros(0, np.int64)
                for s in sections(part):
                    number = np.concatenate([last[len(last) - s.carried :], words.of(s)])
                    last = number[-(WORDS - 1) :]
                    held += len(number)
                    by_lang: dict[str, list[int]] = {}
                    for doc in np.unique(s.doc).tolist():
                        by_lang.setdefault(names[doc], []).append(doc)
                    for n, frequent_ in often.items():
                        at, prints = s.fingerprints(n)
                        at = at[frequent_.value.has(prints)]
                        for lang, docs_ in by_lang.items():
                            mine = at if len(by_lang) == 1 else at[np.isin(s.doc[at], docs_)]
                            if len(mine):
                                grams.setdefault((lang, n), []).append(np.stack([number[mine + i] for i in range(n)], 1))
                if held >= BLOCK:
                    yield from written(words, grams)
                    words, grams, held = _Words(), {}, 0
        yield from written(words, grams)

    def written(words, grams):
        text = [w.decode("utf-8", "surrogatepass") for w in words.number]
        for (lang, n), found in grams.items():
            rows, times = _distinct(found)
            for at in range(0, len(rows), 20_000):
                phrases = [" ".join([text[i] for i in r]) for r in rows[at : at + 20_000].tolist()]
                k = len(phrases)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(phrases, pa.string()), pa.array([n] * k, pa.int64()), pa.array(times[at : at + k], pa.int64())], ["lang", "phrase", "words", "f"])

    common.light_batches(docs.sparkSession)
    rows = docs.select("text", "lang").mapInArrow(common.light(count), "lang string, phrase string, words long, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def totals(docs: DataFrame) -> DataFrame:
    """lang, n: all word occurrences, counted by the separators' ends in Spark."""
    spaced = F.translate(F.coalesce("text", F.lit("")), "\t\n\u000b\f\r.,;:!?", " " * 11)
    words = F.regexp_count(spaced, F.lit("[^ ]+"))
    return docs.groupBy(F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.sum(words.cast("long")).alias("n"))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, f: phrases of one to ``WORDS`` words with at least ``least`` occurrences, exactly."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    log = (BUCKETS - 1).bit_length()
    while (BUCKET_BYTES << log) < size and log < 24:
        log += 1
    share = spark.sparkContext.broadcast
    short = share(frequent(docs, (1, 2), log, least, []))
    long = share(frequent(docs, (3, 4), log, least, [short]))
    return counted(docs, {1: short, 2: short, 3: long, 4: long}, least)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    known = common.stage(frequent_phrases(docs, least))
    split = F.split("phrase", " ")
    cand = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    join = lambda a, n: F.array_join(F.slice(split, a, n), " ")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k").cast("int")).alias("first"), join((F.col("k") + 1).cast("int"), (F.col("words") - F.col("k")).cast("int")).alias("rest"))
    left, right = (known.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("first", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.*")
    longer = cand.where("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2).cast("long"), F.col("words") - 1)))
    longer = longer.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("words") - F.col("m") + 1)))
    holds = longer.select("lang", join(F.col("from").cast("int"), F.col("m").cast("int")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = lowest.join(holds, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * wide("most") < cover * wide("a")))
    # The first of each language are the first of its parts' first.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals(docs), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs)
