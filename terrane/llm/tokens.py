"""Operator 12: token counts, by batch encoding in Arrow functions that return lengths only.

The vocabulary lower-cases, composes (NFC) and splits a text so that white space is never part of a token: between words the text may be
cut without changing a token, as nothing composes, matches or merges over white space. A text of any length is therefore cut into its words, a word of
over ``LONGEST`` characters further before its digits and where a plain letter meets a plain sign. The words of a slice of texts that a task has not met yet are
dealt to batches of about ``BATCH`` bytes, the library encodes a batch at a time, and only the numbers of tokens are kept; a text's count is the sum
of its words' counts. What is kept of words is bounded by ``KEPT`` words, after which a task starts afresh.

Special strings inside a text are what the library makes of them by default: one token. Null text counts as empty: 0 bytes, 0 tokens. Rows are kept one for one, repeated rows
and ids included. Empty table: no rows.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 2048
#: Bytes of a batch of words; words whose counts a task keeps; characters of a word that is kept whole.
BATCH, KEPT, LONGEST = 1 << 18, 600_000, 256
#: White space to Python but not to the vocabulary.
_APART = re.compile("[\x1c-\x1f]").search
#: What the vocabulary and Python agree on, beside the four above.
_SPACE = re.compile(r"[^\S\x1c-\x1f]+").split
_CUT = re.compile(r"(?=[0-9])|(?<=[A-Za-zÀ-ÖØ-öø-ÿа-яА-Яぁ-んァ-ヶ一-龥가-힣])(?=[.,;:!?。、])").split


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words(text: str) -> list[str]:
    """The text's words, at whose borders no token spans."""
    return [w for w in _SPACE(text) if w] if _APART(text) else text.split()


class Counter:
    """Numbers of tokens, by way of the words that the task has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, int] = {}

    def lengths(self, parts: list[str]) -> list[int]:
        """Numbers of tokens of these texts, encoded in batches of about ``BATCH`` bytes, the long ones first."""
        out, order = [0] * len(parts), sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        at = 0
        while at < len(order):
            stop, size = at, 0
            while stop < len(order) and (stop == at or size + len(parts[order[stop]]) <= BATCH):
                size += len(parts[order[stop]]) + 16
                stop += 1
            for i, e in zip(order[at:stop], self.library.encode_batch_fast([parts[i] for i in order[at:stop]], add_special_tokens=False), strict=True):
                out[i] = len(e)
            at = stop
        return out

    def count(self, texts: list[str]) -> list[int]:
        cut = [words(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, set().union(*cut)
        long = [w for w in new if len(w) > LONGEST]
        pieces = [_CUT(w) for w in long]
        short = sorted(new.difference(long))
        self.known.update(zip(short, self.lengths(short), strict=True))
        flat = iter(self.lengths([p for ps in pieces for p in ps if p]))
        self.known.update((w, sum(next(flat) for p in ps if p)) for w, ps in zip(long, pieces, strict=True))
        get = self.known.__getitem__
        out = [sum(map(get, c)) for c in cut]
        for w in long:  # they hardly repeat, and would hold much text
            del self.known[w]
        return out


_COUNTERS: dict[str, Counter] = {}


def forget() -> None:
    for c in _COUNTERS.values():
        c.known = {}


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    path = path or vocabulary_path()

    def each(batch: pa.RecordBatch) -> dict:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        n = _COUNTERS[path].count(common.texts(batch))
        return {"doc_id": common.column(batch, "doc_id"), "n_bytes": common.column(batch, "n_bytes"), "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return common.arrow_pass(rows, {"doc_id": "long", "n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, each, forget)


def report(docs: DataFrame) -> DataFrame:
    return count(docs)
