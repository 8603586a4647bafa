"""Operator 9: a convolutional text classifier for toxicity.

A word's embedding is the sum of two rows of hashed tables, which two words hardly ever share both. Filters
of several widths run over the whole text, the maximum over all places of each filter is kept, and a
logistic layer joins them. Every labelled row that may be learned from is: three quarters, by a hash of the id, train the
network, the others set a threshold for each language; a text's language is told from its own words (a naive Bayes over
the same hashed words, learned from all of these rows), never from the lang column.

The rows are dealt to shards of about ``SHARD`` characters, as many as it takes. In each round every shard trains the
network it was sent over its own rows once (numpy, Adagrad; only the places that won the maximum get a gradient), and Spark
averages what the shards have changed, row of the tables by row, over the shards that changed it. The sums are of integers, so
they do not depend on the order. Thresholds come from counts of the held rows by language and by steps of their logits. The
driver holds one network and the sums, whose sizes do not grow with the rows.

``score`` is the logistic of the distance to the threshold, so 0.5 is the threshold in every language. Null
text counts as empty; an empty text has no filter's maximum and scores by the bias alone. With no
labelled rows of both kinds every text scores 0. Rows are kept one for one, repeated rows included. Empty table: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of training text in a shard: bounds what one task holds and trains on in a round.
SHARD = 24_000_000
BUCKETS = 1 << 16
WIDTH = 16
FILTERS = 8
SIZES = (1, 2, 3)
#: Rounds: times that every training row is learned from.
EPOCHS = 8
BATCH = 32
RATE = 0.15
#: Share of the labelled rows that sets the thresholds; the others train.
HELD = 0.25
#: Steps of a logit in which held rows are counted.
STEPS = 256
#: Changes are summed as integers of this unit.
UNIT = 2.0**-32
#: Words in one matrix product: bounds the memory of a task.
CHUNK = 60_000
KEPT = 300_000

_WORD = re.compile(r"[^\W_]+")


class Hashes(dict):
    """Word -> crc32; keeps at most ``KEPT`` of them."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < KEPT:
            self[word] = h
        return h


_HASHES = Hashes()


def hashed(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint32, len(words))


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.table = (r.standard_normal((2 * BUCKETS, WIDTH)) * 0.1).astype(np.float32)
        taps = sum(SIZES)
        self.filters = (r.standard_normal((WIDTH, taps * FILTERS)) * 0.3).astype(np.float32)
        self.shift = np.zeros(len(SIZES) * FILTERS, np.float32)
        self.out = (r.standard_normal(len(SIZES) * FILTERS) * 0.3).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.thresholds: dict[int, float] = {}
        self.langs: list[str] = []
        self.lang_table = np.zeros((BUCKETS, 0), np.float32)
        self.trained = False

    @staticmethod
    def rows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h & (BUCKETS - 1)).astype(np.int64), (h >> 16).astype(np.int64) % BUCKETS + BUCKETS

    def _joined(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of the documents one after another, each followed by max(SIZES) - 1 empty places; the
        first place of each document; the hashes by place (0 where empty); whether a place has a word."""
        gap = max(SIZES) - 1
        lengths = np.array([len(d) + gap for d in docs])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        h, real = np.zeros(lengths.sum(), np.uint32), np.zeros(lengths.sum(), bool)
        for d, at in zip(docs, starts, strict=True):
            h[at : at + len(d)] = d
            real[at : at + len(d)] = True
        a, b = self.rows(h)
        e = self.table[a] + self.table[b]
        e[~real] = 0
        return e, starts, h, real

    def _convolved(self, e: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Every filter's value at every place that has a word (places x filters); others never win."""
        raw, out, at = e @ self.filters, np.zeros((len(e), len(SIZES) * FILTERS), np.float32), 0
        for i, size in enumerate(SIZES):
            o = out[:, i * FILTERS : (i + 1) * FILTERS]
            for tap in range(size):
                o[: len(e) - tap] += raw[tap:, at : at + FILTERS]
                at += FILTERS
        out += self.shift
        out[~real] = -1e9
        return out

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        out, at = np.zeros(len(docs), np.float32), 0
        while at < len(docs):
            stop, n = at, 0
            while stop < len(docs) and (stop == at or n + len(docs[stop]) < CHUNK):
                n += len(docs[stop])
                stop += 1
            part = docs[at:stop]
            if n > 2 * CHUNK:  # one very long text: the maxima of its stretches, which overlap by a filter's width
                d, step = part[0], CHUNK
                stretches = [d[i : i + step + max(SIZES) - 1] for i in range(0, len(d), step)]
                pooled = np.max([self._pooled([s]) for s in stretches], axis=0)
            else:
                pooled = self._pooled(part)
            out[at:stop] = pooled @ self.out + self.bias
            at = stop
        return out

    def _pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        e, starts, _, real = self._joined(docs)
        return np.maximum(np.maximum.reduceat(self._convolved(e, real), starts, axis=0), 0)

    def squares(self) -> dict[str, np.ndarray]:
        return {k: np.full_like(getattr(self, k), 1e-3) for k in PARTS}

    def epoch(self, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, squares: dict[str, np.ndarray], order: np.ndarray) -> None:
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            self._step([docs[i] for i in rows], labels[rows], weight[rows], squares)

    def _step(self, docs, labels, weight, squares) -> None:
        e, starts, h, real = self._joined(docs)
        conv = self._convolved(e, real)
        ends = np.append(starts[1:], len(e))
        best = np.array([conv[a:b].argmax(0) + a for a, b in zip(starts, ends, strict=True)])  # documents x filters
        pooled = np.take_along_axis(conv, best, 0)
        live = pooled > 0
        pooled = pooled * live
        p = 1 / (1 + np.exp(-(pooled @ self.out + self.bias)))
        g = ((p - labels) * weight / len(docs)).astype(np.float32)
        d_pool = g[:, None] * self.out * live
        grads = {"out": pooled.T @ g, "bias": np.array([g.sum()], np.float32), "shift": d_pool.sum(0), "filters": np.zeros_like(self.filters)}
        touched, values = [], []
        column = 0
        for i, size in enumerate(SIZES):
            f = slice(i * FILTERS, (i + 1) * FILTERS)
            for tap in range(size):
                place = np.minimum(best[:, f] + tap, len(e) - 1)  # documents x FILTERS
                inside = best[:, f] + tap < len(e)
                d = d_pool[:, f] * inside
                grads["filters"][:, column : column + FILTERS] = np.einsum("bfw,bf->wf", e[place], d)
                touched.append(place.ravel())
                values.append((d[:, :, None] * self.filters[:, column : column + FILTERS].T).reshape(-1, WIDTH))
                column += FILTERS
        for k, v in grads.items():
            squares[k] += v * v
            getattr(self, k)[...] -= RATE * v / np.sqrt(squares[k])
        place, value = np.concatenate(touched), np.concatenate(values)
        keep = np.abs(e[place]).sum(1) > 0
        for rows in self.rows(h[place[keep]]):
            unique, where = np.unique(rows, return_inverse=True)
            total = np.zeros((len(unique), WIDTH), np.float32)
            np.add.at(total, where, value[keep])
            squares["table"][unique] += total * total
            self.table[unique] -= RATE * total / np.sqrt(squares["table"][unique])

    def learn_languages(self, counts: dict[str, np.ndarray]) -> None:
        """``counts``: documents by bucket of their words, for each language."""
        self.langs = sorted(counts)
        if counts:
            table = np.stack([counts[k] for k in self.langs], 1) + 0.1
            self.lang_table = np.log(table / table.sum(0)).astype(np.float32)

    def languages(self, docs: list[np.ndarray]) -> np.ndarray:
        if not self.langs:
            return np.zeros(len(docs), int)
        return np.array([int(self.lang_table[d & (BUCKETS - 1)].sum(0).argmax()) for d in docs], int)

    def calibrate(self, counts: list[tuple[int, int, int, int]]) -> None:
        """``counts``: language, step of the logit, clean rows, toxic rows. For each language, and for all together (-1), the threshold with the fewest errors,
        both kinds of error weighing alike only as often as they occur."""
        lang, step, clean, toxic = np.array(sorted(counts), np.int64).T
        for k in (-1, *range(len(self.langs))):
            mine = (lang == k) | (k < 0)
            if k < 0 or toxic[mine].sum() >= 5:
                self.thresholds[k] = _threshold(step[mine], clean[mine], toxic[mine])

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(docs))
        t = np.array([self.thresholds.get(int(k), self.thresholds[-1]) for k in self.languages(docs)])
        return 1 / (1 + np.exp(-np.clip(self.logits(docs).astype(np.float64) - t, -30, 30)))


def _threshold(steps: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors."""
    steps, where = np.unique(steps, return_inverse=True)
    clean, toxic = (np.bincount(where, n, len(steps)) for n in (clean, toxic))
    x = (steps + 0.5) / STEPS
    cuts = np.concatenate([[x[0] - 2], (x[1:] + x[:-1]) / 2, [x[-1] + 2]])
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    room = np.concatenate([[1.0], np.diff(x), [1.0]])
    good = np.flatnonzero(errors == errors.min())
    return float(cuts[good[room[good].argmax()]])


#: The network's parameters, as ``packed`` puts them in rows of ``WIDTH``.
PARTS = ("table", "filters", "shift", "out", "bias")


def packed(parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.resize(np.append(p := parts[k].ravel(), np.zeros(-p.size % WIDTH, np.float32)), (-(-p.size // WIDTH), WIDTH)) for k in PARTS])


def unpacked(flat: np.ndarray, like: Network) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in PARTS:
        p = getattr(like, k)
        out[k] = flat[at : at - (-p.size // WIDTH)].ravel()[: p.size].reshape(p.shape).copy()
        at -= -p.size // WIDTH
    return out


def _known(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of all labels to learn from, once each."""
    return labels.select("doc_id", "toxic").where((common.id_hash_mod("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).distinct()


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text, lang of every row to learn from: of an id with several texts one, chosen by its hash. The texts are whole."""
    known = common.small(common.stage(_known(labels)), 1 << 18)
    one = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text", "lang"), "text", "lang")).alias("one")
    return docs.select("doc_id", "text", "lang").join(known, "doc_id").groupBy("doc_id", "toxic").agg(one).select("doc_id", "toxic", "one.*")


#: Its name while it drew a sample.
training_sample = training_rows


class Shard:
    """Training rows in the order of their ids' crc32: their hashed words, labels, whether they are held for the thresholds, languages."""

    ddl = {"shard": "long", "words": "binary", "lengths": "binary", "toxic": "binary", "held": "binary", "langs": "array<string>"}

    def __init__(self, batch: pa.RecordBatch, row: int):
        cell = lambda c, kind: np.frombuffer(common.column(batch, c)[row].as_buffer() or b"", kind)
        ends = np.cumsum(cell("lengths", "<i8"))
        self.number = common.column(batch, "shard")[row].as_py()
        self.docs = np.split(cell("words", "<u4"), ends[:-1])
        self.toxic, self.held = cell("toxic", "<f4"), cell("held", "?")
        self.langs = common.column(batch, "langs")[row].as_py()

    def part(self, mask: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        return [self.docs[i] for i in np.flatnonzero(mask)], self.toxic[mask]


def shards(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each shard, columns as ``Shard.ddl``; an id's shard follows from its hash."""
    rows = common.stage(training_rows(docs, labels).select("doc_id", "toxic", "lang", "text", F.length("text").alias("chars")))
    total = rows.agg(F.sum("chars")).first()[0] or 0
    count = max(1, -(-total // SHARD))

    def each(batch: pa.RecordBatch) -> dict:
        words = [hashed(t) for t in common.texts(batch)]
        return {c: common.column(batch, c) for c in ("shard", "doc_id", "toxic", "lang")} | {"words": [w.astype("<u4").tobytes() for w in words]}

    def joined(table: pa.Table) -> pa.Table:
        ids, toxic = table["doc_id"].to_pylist(), table["toxic"].to_pylist()
        crc = [zlib.crc32(str(i).encode()) for i in ids]
        order = sorted(range(len(ids)), key=lambda i: (crc[i], ids[i], toxic[i]))
        words = [table["words"][i].as_buffer() for i in order]
        cells = {
            "shard": table["shard"][0].as_py(), "words": b"".join(words), "lengths": np.array([w.size // 4 for w in words], "<i8").tobytes(),
            "toxic": np.array([toxic[i] for i in order], "<f4").tobytes(), "held": np.array([crc[i] < HELD * 2**32 for i in order]).tobytes(),
            "langs": [table["lang"][i].as_py() for i in order],
        }
        return pa.table({k: pa.array([cells[k]], common.ARROW[v]) for k, v in Shard.ddl.items()})

    at = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(count)).alias("shard")
    hashes = common.arrow_pass(rows.select(at, "doc_id", "toxic", "lang", "text"), {"shard": "long", "doc_id": "long", "toxic": "int", "lang": "string", "words": "binary"}, each)
    return common.stage(hashes.groupBy("shard").applyInArrow(joined, ", ".join(f"{k} {v}" for k, v in Shard.ddl.items())))


def by_shard(made: DataFrame, ddl: dict[str, str], each) -> DataFrame:
    """The columns that ``each`` makes of every shard."""

    schema = pa.schema([(k, common.ARROW[v]) for k, v in ddl.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = each(Shard(batch, i))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    common.light_batches(made.sparkSession)
    return made.mapInArrow(common.light(run), ", ".join(f"`{k}` {v}" for k, v in ddl.items()))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    made, net, context = shards(docs, labels), Network(), docs.sparkSession.sparkContext
    sizes = by_shard(made, {"held": "boolean", "toxic": "int"}, lambda s: {"held": s.held, "toxic": s.toxic.astype(int)})
    sizes = {(r.held, r.toxic): r.n for r in sizes.groupBy("held", "toxic").agg(F.count("*").alias("n")).collect()}
    if not all(sizes.get((False, k), 0) + sizes.get((True, k), 0) for k in (0, 1)):
        return net
    aside = all(sizes.get((False, k)) for k in (0, 1))  # else too few to hold any back: all rows train
    n = [sizes.get((False, k), 0) + (0 if aside else sizes.get((True, k), 0)) for k in (0, 1)]
    weigh = np.array([0.5 * sum(n) / n[0], 0.5 * sum(n) / n[1]], np.float32)
    net.learn_languages(_languages(made))
    squares = net.squares()
    for k in range(EPOCHS):
        sent = context.broadcast((net, squares))
        _round(made, net, squares, sent, k, weigh, aside)
        sent.destroy()
    net.trained = True
    sent = context.broadcast(net)
    every = not aside or not any(sizes.get((True, k)) for k in (0, 1))
    net.calibrate(_held_counts(made, sent, every))
    sent.destroy()
    return net


def _languages(made: DataFrame) -> dict[str, np.ndarray]:
    """Documents by bucket of their words, for each language."""

    def each(s: Shard) -> dict:
        out = {"lang": [], "bucket": [], "n": []}
        counts: dict[str, np.ndarray] = {}
        for d, k in zip(s.docs, s.langs, strict=True):
            if k:
                counts.setdefault(k, np.zeros(BUCKETS, np.int64))[np.unique(d & (BUCKETS - 1))] += 1
        for k, c in counts.items():
            rows = np.append(np.flatnonzero(c), -1)  # the last: a language may have no words
            out["lang"] += [k] * len(rows)
            out["bucket"].append(rows)
            out["n"].append(np.append(c[rows[:-1]], 0))
        return {"lang": out["lang"], **{c: np.concatenate(out[c] or [np.zeros(0, np.int64)]) for c in ("bucket", "n")}}

    table = by_shard(made, {"lang": "string", "bucket": "long", "n": "long"}, each).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    for part in table.to_batches():
        lang, bucket, n = (common.column(part, c).to_numpy(zero_copy_only=False) for c in ("lang", "bucket", "n"))
        for k in set(lang.tolist()):
            mine = (lang == k) & (bucket >= 0)
            counts.setdefault(k, np.zeros(BUCKETS))[bucket[mine]] = n[mine]
    return counts


def _round(made: DataFrame, net: Network, squares: dict[str, np.ndarray], sent, number: int, weigh: np.ndarray, aside: bool) -> None:
    """Every shard trains over its rows once; ``net`` and ``squares`` take the mean of the changes."""
    columns = [f"{c}{i}" for c in "vs" for i in range(WIDTH)]

    def each(s: Shard) -> dict:
        start, begun = sent.value
        mine, own = Network.__new__(Network), {k: v.copy() for k, v in begun.items()}
        mine.__dict__ |= start.__dict__ | {k: getattr(start, k).copy() for k in PARTS}
        docs, labels = s.part(~s.held if aside else np.ones(len(s.held), bool))
        r = np.random.default_rng(s.number)
        for _ in range(number + 1):
            order = r.permutation(len(docs))
        mine.epoch(docs, labels, weigh[labels.astype(int)], own, order)
        moved = np.hstack([packed({k: getattr(mine, k) for k in PARTS}), packed(own)]).astype(np.float64)
        moved -= np.hstack([packed({k: getattr(start, k) for k in PARTS}), packed(begun)])
        rows = np.flatnonzero(moved.any(1))
        return {"row": rows} | dict(zip(columns, np.rint(moved[rows] / UNIT).astype(np.int64).T, strict=True))

    moved = by_shard(made, {"row": "long"} | {c: "long" for c in columns}, each)
    mean = moved.groupBy("row").agg(*((F.sum(c) / F.count("*") * UNIT).cast("float").alias(c) for c in columns)).toArrow()
    rows = mean["row"].to_numpy()
    for parts, c in (({k: getattr(net, k) for k in PARTS}, "v"), (squares, "s")):
        flat = packed(parts)
        flat[rows] += np.stack([mean[f"{c}{i}"].to_numpy() for i in range(WIDTH)], 1) if len(rows) else 0
        for k, v in unpacked(flat, net).items():
            parts[k][...] = v


def _held_counts(made: DataFrame, sent, every: bool) -> list[tuple[int, int, int, int]]:
    """Language as its words tell it, step of the logit, clean and toxic rows of the held rows, or of all."""

    def each(s: Shard) -> dict:
        docs, toxic = s.part(s.held | every)
        logits = sent.value.logits(docs).astype(np.float64)
        return {"lang": sent.value.languages(docs), "step": np.floor(np.clip(logits, -1000, 1000) * STEPS).astype(np.int64), "toxic": toxic.astype(int)}

    rows = by_shard(made, {"lang": "long", "step": "long", "toxic": "int"}, each)
    return [tuple(r) for r in rows.groupBy("lang", "step").agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).collect()]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def each(batch: pa.RecordBatch) -> dict:
        s = shared.value.scores([hashed(t) for t in common.texts(batch)])
        return {"doc_id": common.column(batch, "doc_id"), "held_out": common.column(batch, "held_out"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    rows = docs.select("doc_id", "text", F.coalesce(common.id_hash_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return common.arrow_pass(rows, {"doc_id": "long", "held_out": "boolean", "score": "double", "predicted": "int"}, each)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
