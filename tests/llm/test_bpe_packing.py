import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrane.llm import bpe, packing

ODD = [None, "", " ", "  a", "a  b", "a\n b", "a \n\nb", "it's 'll we've", "x_y __a 12a3", "<|endoftext|>a", "naïve ²³ ½ × ÷", "日本語 テスト", "a\x85b\x1cc", "ab\t\tc d", " lead", "trail ", "é" * 5000, "a\r\n b", "long words " * 3000, "a", "a", "“curly” — dash…", "Привет, мир!  как дела?", "a\u00a0 b \u2003 c", "x <|endoftext|> y<|endoftext|>z", "a\x00 b", " \x1c a", "😀 🇩🇪 e\u0301", "x" * 400 + " y"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def table(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, length long")


def test_ids_and_text_as_the_library(spark, sf, library):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = bpe.encode_decode(table(spark, texts), head=50).collect()
    want = Counter()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i if i % 7 else None, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in rows) == want


def test_digests_and_empty(spark):
    df = table(spark, ["a b", None])
    got = {r.n_tokens: r for r in bpe.digests(df).collect()}
    assert got[2].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(df.limit(0)).collect() == []
    assert packing.pack(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    size = r.choice([8, 16, 64, 1024])
    counts = Counter(min(size, max(1, int(r.expovariate(3 / size)))) for _ in range(r.randint(0, 2000)))
    sequences, seen = defaultdict(list), defaultdict(set)
    for length, first, n, sequence, offset in packing.plan(dict(counts), size):
        for i in range(n):
            assert first + i not in seen[length]
            seen[length].add(first + i)
            sequences[sequence + i].append((offset, length))
    assert {k: len(v) for k, v in seen.items()} == counts and all(max(v) == counts[k] - 1 for k, v in seen.items())
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    least = -(-sum(k * v for k, v in counts.items()) // size)
    assert len(sequences) <= least * 1.02 + 1


def test_pieces_and_places(spark, library):
    texts = ODD + ["word " * n for n in (1022, 1023, 1024, 2047, 2048, 5000)]
    rows = packing.pack(table(spark, texts)).collect()
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i if i % 7 else None, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
