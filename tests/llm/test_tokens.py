import random
import sys

import pytest
from tokenizers import Tokenizer

from terrane.llm import tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


def whole(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_every_white_space(library):
    """What Python splits at is never part of a token, but for the four signs that are left out."""
    count = tokens.Counter(tokens.vocabulary_path()).count
    spaces = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]
    texts = [f"ab{c}cd{c}{c}'s é{c}́x" for c in spaces]
    assert count(texts) == [whole(library, t) for t in texts]


def test_awkward_strings(library, monkeypatch):
    """Random strings of awkward parts, with words cut wherever that is held to be safe."""
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "'s", "'S", "'", "'re", "it's", "A", "é", "é", "́", "ſ", "İ", "Σ", "ß", "9", "12", "٣", "½", ".", ",", "!?", "。", "日本語", "한국", "각", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|endoftext", "‍", "👍🏽", "﻿", "_", "-", "x" * 30, "1.5", "a.b,c", "̸", "=", "Å", "\x00", " "]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(6000)]
    for longest in (256, 3):
        monkeypatch.setattr(tokens, "LONGEST", longest)
        got = tokens.Counter(tokens.vocabulary_path()).count(texts)
        want = [whole(library, t) for t in texts]
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_bounds(library, monkeypatch):
    """A table that starts afresh, and batches of a few bytes."""
    monkeypatch.setattr(tokens, "KEPT", 5)
    monkeypatch.setattr(tokens, "BATCH", 20)
    c = tokens.Counter(tokens.vocabulary_path())
    for t in ("one two three", "four five six seven eight", "nine one one", "", "word " * 500):
        assert c.count([t, t + " more"]) == [whole(library, t), whole(library, t + " more")]


def test_rows(spark, library):
    rows = [(1, "Hello WORLD", "a"), (1, "Hello WORLD", "a"), (2, None, "b"), (None, "", "c"), (3, "word " * 3000, None), (4, "z" * 200_000 + "1," * 100_000 + "日本" * 50_000, "d"), (5, "é<|endoftext|>", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in tokens.report(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(((i, len((t or "").encode()), whole(library, t), whole(library, t) > 2048) for i, t, _ in rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == want
    assert tokens.report(docs.where("false")).count() == 0
