"""Operator 10: byte-level BPE by distinct words, and decoding by an id-to-piece table.

The text is cut into units before every space that follows something other than white space. There a unit always starts at
a token boundary of the vocabulary's own splitting rule, whatever the characters, so a unit's ids do not depend on its
neighbours: it is encoded once and its ids are put back by position. Counting over all documents finds the units that are
frequent everywhere; that head of the table (at most ``HEAD`` rows) is encoded once for the whole job and broadcast. A unit
outside the head is encoded once in each task that meets it, which spares a shuffle of every occurrence of rare words.

The table's keys are units without the space before them; the start of a text, which has none, is marked.

A unit of characters whose class is certain is put together from its words' ids; others, and those that hold a special
token, go to the tokenizers library as a whole, once each. Null text counts as empty and has no ids. Rows are kept one
for one, repeated rows and ids included.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of the broadcast head of the word table: at most about 10 MB.
HEAD = 1 << 17
#: Units, and words, that a task keeps before it starts afresh: bounds the memory of a Python worker.
KEPT = 600_000

#: The vocabulary's splitting rule for text that ``_PLAIN`` lets through.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")

#: Only characters whose class (letter, digit, white space, other) is certain, and no special token.
_PLAIN = re.compile(r"(?!.*<\|)[\t\n\x0b\x0c\r\x20-\x7eÀ-ɏ]*", re.DOTALL).fullmatch
#: Where a space may follow white space, units are found by looking at each character.
_BREAKS = tuple(f"{c} " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_WIDE = re.compile(r"[^\S\x00-\x7f] ").search
_CUT = re.compile(r"(?<=\S)(?= )").split
#: Marks the key of a text's start: half a character, which no text holds.
START = "\udfff"
#: Units that are longer are not kept in the table.
LONGEST = 128


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces(path: str) -> list[bytes]:
    """The bytes of every id, special tokens included; the id-to-piece table (its size is the vocabulary's)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["id"]: x["content"] for x in spec["added_tokens"]}
    known = spec["model"]["vocab"] | {v: k for k, v in special.items()}
    byte = _byte_of_char()
    out = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        out[i] = token.encode() if i in special else bytes(byte[c] for c in token)
    return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by way of a table of distinct units."""

    def __init__(self, path: str, head: dict[str, bytes] | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["id"] for x in spec["added_tokens"]}
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.newline = ranks[b"\n"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ordinary = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.head, self.units, self.words = head or {}, dict(head or {}), {}
        self.kept = KEPT

    def _learn_words(self, words: set[str]) -> None:
        """Encode each new word once. Words hold no newline, so one parts them in a single call."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.kept:
            self.words, new = {}, list(words)
        plain = [w for w in new if "\n" not in w and not w.isspace()]
        ids = np.asarray(self.ordinary("\n".join(plain)), "<u4")
        ends = np.append(np.flatnonzero(ids == self.newline), len(ids)).tolist()
        raw, at = ids.tobytes(), 0
        for word, end in zip(plain, ends, strict=True) if plain else ():
            self.words[word] = raw[4 * at : 4 * end]
            at = end + 1
        for word in set(new).difference(plain):
            self.words[word] = array("I", self.ordinary(word)).tobytes()

    def learn(self, found: set[str]) -> None:
        """Add the units of these keys to the table: a unit is put together from the ids of its words."""
        new = [k for k in found if k not in self.units]
        if len(self.units) + len(new) > len(self.head) + self.kept:
            self.units = dict(self.head)
            new = [k for k in found if k not in self.units]
        texts = [" " + k if k[:1] != START else k[1:] for k in new]
        if not _PLAIN("".join(texts)):
            odd = [i for i, t in enumerate(texts) if not _PLAIN(t)]
            self.units.update((new[i], self.whole(texts[i])) for i in odd)
            for i in reversed(odd):
                del new[i], texts[i]
        for at in range(0, len(new), 100_000):
            parts = [_WORD.findall(t) for t in texts[at : at + 100_000]]
            self._learn_words({w for p in parts for w in p})
            word = self.words.__getitem__
            self.units.update(zip(new[at:], [word(p[0]) if len(p) == 1 else b"".join(map(word, p)) for p in parts], strict=False))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        walks = gc.isenabled()
        gc.disable()  # the tables hold no cycles, and walking them again and again costs half the time
        try:
            cut = [keys(t) for t in texts]
            found = set().union(*cut)
            long = [k for k in found if len(k) > LONGEST]
            self.learn(found.difference(long) if long else found)
            self.units.update((k, array("I", self.ordinary(unit(k))).tobytes() if _PLAIN(unit(k)) else self.whole(unit(k))) for k in long)
            known = self.units.__getitem__
            out = [b"".join(map(known, k)) for k in cut]
            for k in long:  # they hardly repeat, and the table would hold too much text
                del self.units[k]
            return out
        finally:
            if walks:
                gc.enable()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def keys(text: str) -> list[str]:
    """The keys of the text's units: it is cut before every space that follows something other than white space."""
    if any(x in text for x in _BREAKS) or not text.isascii() and _WIDE(text):
        first, *others = _CUT(text)
        return [START + first, *(u[1:] for u in others)]
    out = text.split(" ")
    if out[0] or len(out) == 1:
        out[0] = START + out[0]
    else:  # the space that the text begins with belongs to its first unit
        out[:2] = [f"{START} {out[1]}"]
    return out


def unit(key: str) -> str:
    """A key's unit of text."""
    return key[1:] if key.startswith(START) else " " + key


_ENCODERS: dict = {}


def encoder(path: str, head: dict[str, bytes] | None = None) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = (path, id(head) if head else 0)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, head)
    return _ENCODERS[key]


def forget() -> None:
    """Give back the units and words that the worker's encoder has learned."""
    for enc in _ENCODERS.values():
        enc.units, enc.words = dict(enc.head), {}


def word_table(docs: DataFrame, path: str, head: int = HEAD) -> dict[str, bytes]:
    """The ``head`` most frequent units over all documents, each encoded once, by their keys; starts of texts are left out."""

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in common.pieces_of(batch):
                for text in common.texts(part):
                    seen.update(keys(text)[1:])
                if len(seen) > KEPT:  # a unit met once so far costs more to ship than to encode again
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    common.light_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(common.light(count), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "unit").limit(head)
    encoded = common.arrow_pass(top, {"unit": "string", "ids": "binary"}, lambda b: _encoded(b, path))
    return {r.unit: bytes(r.ids) for r in encoded.collect()}


def _counted(seen: dict[str, int]) -> pa.RecordBatch:
    often = {k: v for k, v in seen.items() if v > 1 and len(k) <= 64}
    return pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], ["unit", "n"])


def _encoded(batch: pa.RecordBatch, path: str) -> dict:
    words, enc = common.texts(batch, "unit"), encoder(path)
    enc.learn(set(words))
    return {"unit": words, "ids": [enc.units[w] for w in words]}


def encode_decode(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """Each document's ids and the text they decode to: doc_id, n_tokens, ids (binary, little-endian unsigned
    32-bit), decoded. Empty table: no rows."""
    path = path or vocabulary_path()
    return common.arrow_pass(docs.select("doc_id", "text"), {"doc_id": "long", "n_tokens": "long", "ids": "binary", "decoded": "string"}, _coder(docs, path, head, lambda ids, decoded: {"ids": ids, "decoded": decoded}), forget)


def digests(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """As ``encode_decode``, with digests in place of ids and text."""
    path = path or vocabulary_path()
    hexed = lambda ids, decoded: {"ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded]}
    return common.arrow_pass(docs.select("doc_id", "text"), {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, _coder(docs, path, head, hexed), forget)


_TABLES: dict = {}


def _coder(docs: DataFrame, path: str, head: int, finish):
    table = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, head))

    def each(batch: pa.RecordBatch) -> dict:
        enc = encoder(path, table.value)
        if path not in _TABLES:
            _TABLES[path] = pieces(path)
        piece = _TABLES[path].__getitem__
        ids = enc.encode_many(common.texts(batch))
        decoded = [b"".join(map(piece, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in ids]
        return {"doc_id": common.column(batch, "doc_id"), "n_tokens": [len(x) // 4 for x in ids]} | finish(ids, decoded)

    return each
