"""Operator 2: language of every document, and of the spans of a text that mixes languages.

Training counts hashed character n-grams of words by language over a bounded sample of the labelled rows
(``SAMPLE`` rows of each language expected, chosen by a hash of the row, spread over all of them). A run of
letters is cut where its script changes and into words of at most ``LONGEST`` characters, so all of it is read. The script
of a word narrows its candidates to the languages that were seen with that script; a naive Bayes score for
each candidate follows from its n-grams. Viterbi with a switching penalty turns the scores of a text's words
into spans of one language each. The document's language is the one whose spans hold the most letters; its
score is that share, weighted by how far the spans' scores lie above those of the runner-up.

A text that is null or has no letter is ``und`` with score 0. With nothing to learn from, every text is
``und``. Ties go to the language that sorts first. Rows are kept one for one, repeated rows included. Text
is judged whole. Only text is used for a prediction. Letters are what Unicode calls so: fractions, raised digits and numerals are none. Empty table: no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each language to learn from, in expectation. All languages there are.
SAMPLE = 1500
#: Buckets of the n-gram table: it holds BUCKETS * languages float32 numbers (16 MB for 64 languages).
BUCKETS = 1 << 16
#: Characters of a word; longer runs of letters are several words.
LONGEST = 40
#: Nats that a change of language costs, and the most that one word can say for a language.
SWITCH = 12.0
CLIP = 6.0
#: Distinct words whose scores a task keeps, and that it scores at once, for up to ``USUAL`` languages; fewer for more.
KEPT = 200_000
ONCE = 20_000
USUAL = 64

_WORD = re.compile(r"[^\W\d_]+")
#: First code point of each script range; words are told apart by their first letter's range.
SCRIPTS = (0x0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB80, 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0)


#: Ranges whose letters stand in one word, by the range that they are joined to; signs that may stand in any word.
JOINED = {0x250: 0x0, 0x1E00: 0x0, 0x1F00: 0x370, 0xAC00: 0x1100}
ANY = "\u02b0-\u02ff\u3005-\u3007"


def _pieces(most: int = LONGEST) -> re.Pattern:
    """Matches up to ``most`` letters of one script. What it finds in a run of letters, joined, is the run."""
    classes: dict[int, str] = {}
    for first, after in zip(SCRIPTS, (*SCRIPTS[1:], 0x110000), strict=True):
        at = JOINED.get(first, first)
        classes[at] = classes.get(at, ANY) + f"{re.escape(chr(first))}-{re.escape(chr(after - 1))}"
    return re.compile("|".join(f"[{c}]{{1,{most}}}" for c in classes.values()))


_PIECE = _pieces()


def split(runs: list[str]) -> list[str]:
    """The words that runs of letters are cut into."""
    out = []
    for run in runs:
        if len(run) <= LONGEST and run.isascii():
            out.append(run)
        elif run.isalpha():
            out += _PIECE.findall(run)
        else:  # numbers such as fractions and numerals are no letters
            out += [p for letters in _letters(run).split() for p in _PIECE.findall(letters)]
    return out


def _letters(run: str) -> str:
    """The run with a space in the place of each character that is no letter."""
    return "".join(c if c.isalpha() else " " for c in run)


def script(word: str) -> int:
    return int(np.searchsorted(SCRIPTS, ord(word[0]), "right"))


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 2, 3, 4: the bucket of the n-gram that starts at each character of the joined words, ``-1``
    where it would leave its word; and where each word starts. Words are lower-cased, marked at both ends
    and hashed as a whole in the place of their first character's one-gram."""
    marked = [f"<{w.lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    room = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
    out, h = [], codes * np.uint64(0x9E3779B97F4A7C15)
    whole = np.full(len(codes), -1, np.int64)
    whole[starts] = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in marked), np.int64, len(marked))
    out.append(whole)
    for n in (2, 3, 4):
        ahead = np.zeros_like(codes)
        ahead[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ahead * np.uint64(0x94D049BB133111EB) + np.uint64(n)
        out.append(np.where(room >= n, ((h ^ (h >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int64), -1))
    return out, starts


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows to learn from: a language and a remainder other than 2."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.id_hash_mod("doc_id", 4) != 2))


class Model:
    """Languages, the n-gram table of log probabilities and the scripts that each language was seen with."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        totals = counts.sum(1, keepdims=True) + 0.2 * BUCKETS
        self.table = np.ascontiguousarray(np.log((counts + 0.2) / totals).astype(np.float32).T)
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        self.allowed = share > 0.001  # language x script
        self.table = np.vstack([self.table, np.zeros(len(langs), np.float32)])  # the last row: no n-gram there
        self.words: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"words": {}, "rows": self.rows[:0]}

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores of each word by language, the best at 0 and none below ``-CLIP``; all 0 where the
        word's script belongs to no language."""
        buckets, starts = grams(words)
        total, n = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        for b in buckets:
            total += np.add.reduceat(self.table[b], starts, axis=0)
            n += np.add.reduceat((b >= 0).astype(np.float64), starts)
        length = np.fromiter(map(len, words), np.float64, len(words))
        raw = total / n[:, None] * np.minimum(4.0, 1 + length / 2)[:, None]
        allowed = self.allowed[:, np.searchsorted(SCRIPTS, [ord(w[0]) for w in words], "right")].T
        raw = np.where(allowed, raw, -1e9)
        out = np.maximum(raw - raw.max(1, keepdims=True), -CLIP)
        out[~allowed.any(1)] = 0
        return out.astype(np.float32)

    def forget(self) -> None:
        """Give back the words that a task has met."""
        self.words, self.rows = {}, self.rows[:0].copy()

    def learn(self, found: set[str]) -> None:
        """Score the words that are not in the table yet; it starts afresh when it holds ``KEPT`` words."""
        kept, once = (max(1, x * USUAL // max(USUAL, len(self.langs))) for x in (KEPT, ONCE))
        new = [w for w in found if w not in self.words]
        if len(self.words) + len(new) > kept:
            self.words, self.rows, new = {}, self.rows[:0], list(found)
        for at in range(0, len(new), once):
            part = new[at : at + once]
            self.words.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.rows = np.vstack([self.rows, self.score(part)])

    def emissions(self, words: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))]

    def states(self, e: np.ndarray) -> np.ndarray:
        """Viterbi path of the words' scores ``e`` (words x languages)."""
        n, k = e.shape
        best = int(e.sum(0).argmax())
        if n == 1 or k == 1 or self._holds(e, best):
            return np.full(n, best)
        score, back = e[0].astype(np.float64), np.empty((n, k), np.int32)
        own = np.arange(k)
        for t in range(1, n):
            top = int(score.argmax())
            stay = score >= score[top] - SWITCH
            back[t] = np.where(stay, own, top)
            score = np.where(stay, score, score[top] - SWITCH) + e[t]
        path = np.empty(n, np.int64)
        path[-1] = int(score.argmax())
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    @staticmethod
    def _holds(e: np.ndarray, best: int) -> bool:
        """Whether no stretch gains more by leaving ``best`` than the switches cost: then one language is optimal."""
        gain = np.concatenate([[0.0], np.cumsum((e.max(1) - e[:, best]).astype(np.float64))])
        if gain[-1] <= SWITCH:  # even all of it
            return True
        others = np.delete(e, best, 1).max(1).astype(np.float64) - e[:, best]
        gain = np.concatenate([[0.0], np.cumsum(others)])
        low = np.minimum.accumulate(gain)
        return gain.max() <= SWITCH and gain[-1] - low.min() <= SWITCH and (gain - low).max() <= 2 * SWITCH

    def label(self, text: str) -> list[tuple[int, int, str]]:
        """Spans of a text as (start, end, language)."""
        runs = ((m.start(), m[0] if m[0].isalpha() else _letters(m[0])) for m in _WORD.finditer(text))
        parts = ((at + k.start(), k[0]) for at, run in runs for k in re.finditer(r"\S+", run))
        found = [(at + p.start(), at + p.end()) for at, run in parts for p in _PIECE.finditer(run)]
        if not found or not self.langs:
            return []
        words = [text[a:b] for a, b in found]
        self.learn(set(words))
        path = self.states(self.emissions(words))
        cuts = np.flatnonzero(np.diff(path)) + 1
        return [(found[a][0], found[b - 1][1], self.langs[path[a]]) for a, b in zip([0, *cuts], [*cuts, len(path)], strict=True)]

    def verdicts(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        parts = [split(_WORD.findall(t)) for t in texts]
        self.learn(set().union(*parts))
        out = []
        for words in parts:
            e = self.emissions(words)
            out.append(self._verdict(words, e, self.states(e)) if words else ("und", 0.0))
        return out

    def _verdict(self, words: list[str], e: np.ndarray, path: np.ndarray) -> tuple[str, float]:
        letters = np.bincount(path, weights=np.fromiter(map(len, words), np.float64, len(words)), minlength=e.shape[1])
        best = int(letters.argmax())
        mine = e[path == best].astype(np.float64).sum(0)
        rival = np.delete(mine, best).max(initial=mine[best] - 50)
        sure = 1 / (1 + np.exp(-min(50.0, mine[best] - rival)))
        return self.langs[best], float(letters[best] / letters.sum() * sure)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts in Spark; the driver gets one table of fixed size."""
    common.light_batches(docs.sparkSession)
    rows = training_rows(docs)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS) + 1)))
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))))
    part = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    width = BUCKETS + len(SCRIPTS) + 1

    def count(batches):
        total = {}
        for batch in batches:
            for lang, text in zip(common.column(batch, "lang").to_pylist(), common.texts(batch), strict=True):
                row = total.setdefault(lang, np.zeros(width, np.int64))
                words = list(set(split(_WORD.findall(text))))
                if words:
                    scripts = np.searchsorted(SCRIPTS, [ord(w[0]) for w in words], "right")
                    cells = np.concatenate([b[b >= 0] for b in grams(words)[0]] + [BUCKETS + scripts])
                    row += np.bincount(cells, minlength=width)
        cells = [(k, i, int(v[i])) for k, v in total.items() for i in np.flatnonzero(v).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.string()), pa.array([c[1] for c in cells], pa.int64()), pa.array([c[2] for c in cells], pa.int64())], ["lang", "cell", "n"])

    chosen = rows.where(F.col("lang").isin(langs) & part).select("lang", "text")
    cells = chosen.mapInArrow(common.light(count), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), width))
    counts[[langs.index(k) for k in cells["lang"]], cells["cell"]] = cells["n"]
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> dict:
        got = shared.value.verdicts(common.texts(batch))
        return {"doc_id": common.column(batch, "doc_id"), "held_out": common.column(batch, "held_out"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    rows = docs.select("doc_id", "text", F.coalesce(common.id_hash_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return common.arrow_pass(rows, {"doc_id": "long", "held_out": "boolean", "lang_pred": "string", "score": "double"}, each, lambda: shared.value.forget())


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end, lang: the stretches of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> dict:
        rows = [(d, *s) for d, t in zip(common.column(batch, "doc_id").to_pylist(), common.texts(batch), strict=True) for s in shared.value.label(t)]
        return {n: [r[i] for r in rows] for i, n in enumerate(("doc_id", "start", "end", "lang"))}

    return common.arrow_pass(docs.select("doc_id", "text"), {"doc_id": "long", "start": "long", "end": "long", "lang": "string"}, each, lambda: shared.value.forget())


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a language: those that come out as ``und`` go. All columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    names = docs.columns
    at = names.index("text")
    common.light_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in common.pieces_of(batch):
                keep = [g[0] != "und" for g in shared.value.verdicts([t or "" for t in part.column(at).to_pylist()])]
                yield part.filter(pa.array(keep, pa.bool_()))
        shared.value.forget()

    return docs.mapInArrow(common.light(run), docs.schema)
