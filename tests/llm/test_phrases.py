import random
import re
from collections import Counter

import numpy as np
import pytest

from terrane.llm import phrases


def plain(rows, least, top=2000, cover=80):
    """The contract by brute force."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    key = (lang, tuple(words[i : i + size]))
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        if any(g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= cover * a for (g, q), b in cand.items()):
            continue
        score, k, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine)]
    return sorted(ranked)


def corpus(seed=3, n=120):
    r = random.Random(seed)
    vocabulary = ["Der", "die", "ÉTÉ", "naïve", "x", "new", "york", "City", "日本", "b-c", "'s", " nb"]
    rows = []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randint(0, 40))
        if r.random() < 0.5:
            words += ["new", "york", "city", "hall"]
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", ":"]) for w in words)
        rows.append((text, r.choice(["en", "en", None, "de", "und"])))
    return rows + [(None, "en"), ("", None), (" .,", "de"), *rows[:7]]


@pytest.mark.parametrize("section,block", [(1 << 19, 500_000), (64, 200)])
def test_like_brute_force(spark, monkeypatch, section, block):
    rows = corpus()
    monkeypatch.setattr(phrases, "SECTION", section)
    monkeypatch.setattr(phrases, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, g, "y") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(3)
    got = sorted(tuple(x) for x in phrases.collocations(docs, 5, 20).collect())
    want = plain(rows, 5, 20)
    assert got == want and len(want) > 40


def test_sections_by_hand(monkeypatch):
    """Whatever the stretches, the same fingerprints; documents, also those that touch without a separator, do not run together."""
    import pyarrow as pa

    texts = ["one two three", "four five", "", None, "six. seven eight nine ten", "w" * 300, "a b c d e f"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], ["text", "lang"])
    seen = []
    for section in (1 << 21, 7, 1):
        monkeypatch.setattr(phrases, "SECTION", section)
        found = {n: Counter() for n in range(1, 5)}
        for b in (batch, batch.slice(1, 6)):
            for s in phrases.sections(b):
                for n in found:
                    found[n].update(s.fingerprints(n)[1].tolist())
        seen.append(found)
    assert seen[0] == seen[1] == seen[2]
    assert [len(seen[0][n]) for n in range(1, 5)] == [17, 11, 7, 4]


def test_words_that_share_a_hash(monkeypatch, spark):
    """All words get one of three hashes: counts stay exact, as they are taken from the text."""
    real = phrases.word_hashes
    monkeypatch.setattr(phrases, "word_hashes", lambda *a: real(*a) % np.uint64(3))
    rows = corpus(9, 60)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([g for _, g in rows])], ["text", "lang"])
    words, numbers = phrases._Words(), []
    for s in phrases.sections(batch):
        numbers += words.of(s).tolist()
    names = [w.decode() for w in words.number]
    want = [w for t, _ in rows for p in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for w in re.findall(r"[^\x20\x09]+", p)]
    assert [names[i] for i in numbers] == want


def test_small_bitmap_and_empty(spark, monkeypatch):
    rows = corpus(5, 80)
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    monkeypatch.setattr(phrases, "BITMAP", 1 << 16)
    assert sorted(tuple(x) for x in phrases.collocations(docs, 4).collect()) == plain(rows, 4)
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs, 10**6).count() == 0


def test_very_long_text(spark):
    text = "to be or not to be " * 60_000 + "z" * 5_000_000
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert sorted(tuple(x) for x in phrases.collocations(docs).collect()) == plain([(text, "en")], 30)
