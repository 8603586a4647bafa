import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from terrane.llm import repeats


def plain(rows, span=200):
    """The contract by counting every window."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = Counter()
    for (d, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[d, len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé ", k=r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(20, 80)) for _ in range(6)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "y" * 200, "z" * 201, "ab" * 300, "=" * 5000, text(20_000)]
    for _ in range(40):
        t = text(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(t))
            p = r.choice(passages)
            cut = r.randint(0, len(p) // 3)
            t = t[:at] + p[cut:] + t[at:]
        texts.append(t)
    near = text(100)
    texts += [near[:i] + "#" + near[i:] for i in range(0, len(near), 40)]
    texts += [texts[15]] * 3 + [passages[0], passages[0]]
    return [(i if i % 11 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,hot", [(0, 50_000), (1, 3)])
def test_against_every_window(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "SHARD", 4000)
    rows = made(seed)
    monkeypatch.setattr(repeats.repeated, "__defaults__", (200, 64, hot))
    got = repeats.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == plain(rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = repeats.report(docs).collect()
    assert Counter(tuple(r) for r in got) == plain([tuple(r) for r in docs.collect()])


def test_cut(spark):
    r = random.Random(5)
    passage = "é" + "".join(r.choices("abcdefgh ", k=300))
    rows = [(1, "mine " + passage + "_own", None, 3), (2, passage + " too", 7, 4), (3, passage, 1, 5), (4, "", 0, 6), (5, None, None, 7)]
    got = {x.doc_id: x for x in repeats.cut(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, copies long")).collect()}
    assert got[1].text == "mine _own" and got[1].n_chars == 9 and got[2].text == " too" and 3 not in got
    assert got[4].text == "" and got[5].text is None and got[2].copies == 4


def test_text_longer_than_places_have_bits(spark):
    letters = np.random.default_rng(3).integers(97, 123, 18_000_000, np.uint8).tobytes().decode()
    early, late = letters[1_000_000:1_000_400], letters[17_000_000:17_000_300]
    rows = [(1, letters), (2, "<" + early + ">"), (3, "<" + late + ">")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {1: (18_000_000, 700, 2), 2: (402, 400, 1), 3: (302, 300, 1)}


@pytest.mark.parametrize("stretch", [137, 4096])
def test_stretches_pick_the_same(monkeypatch, stretch):
    texts = [(t or "").encode() for _, t in made(2)]
    whole = repeats.picked(texts)
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    assert all(np.array_equal(a, b) for a, b in zip(whole, repeats.picked(texts), strict=True))


def test_empty(spark):
    assert repeats.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
