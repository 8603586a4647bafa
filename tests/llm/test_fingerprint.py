import hashlib
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrane.llm import fingerprint

TEXTS = [None, "", "a", "Straße  x", "STRASSE x ", "ﬁne ①", "fine 1", "été", "été", "ÉTÉ", "a b\tc", "a b c", "long text " * 20_000, "x y", "x y", "x  y", "日本 語", "😀😀😀b"]


def form(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", t).strip()


def plain(rows):
    rows = [(d, t or "") for d, t in rows]
    out = []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        out.append((d, t, t[: len(t) - half] + n[:half], n))
    return out


def expected(rows):
    return Counter((d, len(t), hashlib.sha256(e.encode()).hexdigest(), float(form(t) == form(e)), float(form(t) == form(n))) for d, t, e, n in plain(rows))


def got(df):
    rows = df.collect()
    return rows, Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows)


@pytest.mark.parametrize("hash_", [None, lambda f: (F.length(f).cast("long"), F.lit(1).cast("long"))])
def test_against_plain(spark, monkeypatch, hash_):
    if hash_:
        monkeypatch.setattr(fingerprint, "wide", hash_)
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    rows = [(3 * i, t) for i, t in enumerate(TEXTS)][::-1] + [(None, "last")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, place string, t int").repartition(4)
    found, counted = got(fingerprint.report(df))
    assert counted == expected(rows)
    by = {}
    for d, t, e, _ in plain(rows):
        row = next(r for r in found if r.doc_id == d)
        for text, print_ in ((t, row.fingerprint), (e, row.edited_fingerprint)):
            assert by.setdefault(form(text), print_) == print_
    assert len(set(by.values())) == len(by)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    assert got(fingerprint.report(docs))[1] == expected(rows)


def test_single_empty_and_repeated(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert got(fingerprint.report(one))[1] == expected([(1, "abcd")])
    assert fingerprint.report(one.limit(0)).collect() == []
    many = spark.createDataFrame([(1, "b"), (1, "b"), (1, "a"), (None, None), (None, None)], "doc_id long, text string")
    assert len(fingerprint.report(many).collect()) == 5
