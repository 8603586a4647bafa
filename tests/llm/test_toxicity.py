import zlib

import numpy as np
import pytest

from terrane.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def net(tables):
    return toxicity.train(*tables)


def test_held_out(tables, net):
    docs, labels = tables
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), net).where("held_out").join(labels, "doc_id").collect()
    english = [r for r in got if r.toxic == 0 or r.score >= 0.5]
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)
    assert sum(r.predicted for r in english if r.toxic == 0) <= 0.02 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxic_words_in_long_clean_text(spark, net):
    clean = "the thing and that of " * 30_000
    rows = [(1, clean), (2, clean + " you stupid idiot scum loser moron trash pathetic " + clean), (3, None), (3, None), (4, ""), (None, "x")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()
    by = {r.doc_id: r.predicted for r in got}
    assert len(got) == 6 and by[2] == 1 and by[1] == by[3] == by[4] == by[None] == 0


def test_stretches_of_long_texts_give_the_same_maxima(net, monkeypatch):
    r = np.random.default_rng(0)
    docs = [r.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 2, 3, 50, 500, 7)]
    whole = net.logits(docs)
    monkeypatch.setattr(toxicity, "CHUNK", 20)
    assert np.allclose(whole, net.logits(docs), atol=1e-4)


def test_gradient(monkeypatch):
    """A step moves every parameter against the numerical gradient of the loss."""
    n = toxicity.Network(3)
    docs, y = [np.array([5, 9, 70000], np.uint32), np.array([8, 5], np.uint32)], np.array([1.0, 0.0], np.float32)
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * n.logits(docs)))))
    for name in ("out", "filters", "bias", "table"):
        p = getattr(n, name)
        where = np.unravel_index(5, p.shape) if name == "table" else np.unravel_index(0, p.shape)
        base, was = loss(), float(p[where])
        p[where] += 1e-2
        slope = loss() - base
        p[where] = was
        m = toxicity.Network(3)
        squares = {k: np.full_like(getattr(m, k), 1e-3) for k in ("table", "filters", "shift", "out", "bias")}
        m._step(docs, y, np.ones(2, np.float32), squares)
        moved = float(getattr(m, name)[where]) - was
        assert abs(slope) < 1e-5 or slope * moved < 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.report(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.report(docs.limit(0), labels.limit(0)).collect() == []


def test_training_rows_are_whole_and_one_for_an_id(spark):
    long = "word " * 50_000 + "end"
    docs = spark.createDataFrame([(1, long, "en", "x"), (2, "a", "en", "x"), (2, "b", "en", "x"), (2, "b", "de", "x"), (None, "c", "en", "x")], "doc_id long, text string, lang string, toxic string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity.training_sample(docs, labels).collect()
    assert sorted((r.doc_id, r.toxic) for r in got) == [(1, 1), (2, 0)] and [r.text for r in got if r.doc_id == 1] == [long]


def many(spark):
    rows = [(i, "bad word" if i % 2 else "good word", "en", i % 2) for i in range(14_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic")


def test_every_labelled_row_is_learned_from(spark):
    docs, labels = many(spark)
    want = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(14_000))
    assert toxicity.training_sample(docs, labels).count() == want > 2 * 3000


def test_shards_learn_together_whatever_the_layout(spark, monkeypatch):
    docs, labels = many(spark)
    monkeypatch.setattr(toxicity, "SHARD", 25_000)
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    made = toxicity.shards(docs, labels).collect()
    assert len(made) == 4 and sum(len(r.lengths) // 8 for r in made) == toxicity.training_rows(docs, labels).count()
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(7), labels.repartition(3))
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in toxicity.PARTS) and a.thresholds == b.thresholds
    got = toxicity.score(docs.limit(200), a).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
