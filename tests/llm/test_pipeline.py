import random
from collections import defaultdict

import corpus_pipeline
from terrane.llm import bpe, packing
from tests.llm.test_jaccard import plain as plain_jaccard
from tests.llm.test_repeats import plain as plain_repeats


def docs_of(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: "the and of " + " ".join(r.choices(words, k=n))
    passage, base = text(70), text(150)
    rows = [(i, text(60), "en" if i % 2 else None, "s", 1) for i in range(20)]
    rows += [(30, base, "en", "s", 1), (31, base + " more", "en", "s", 1), (32, base, "en", "s", 1)]
    rows += [(40, text(40) + passage + " " + text(30), "en", "s", 1), (41, text(50) + passage + "_" + text(50), "en", "s", 1)]
    rows += [(50, None, "en", "s", None), (51, "12 34", "en", "s", 5), (52, text(30) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_stage(spark, tmp_path):
    docs = docs_of(spark)
    language, near, repeated, redacted, packed = (f for _, f in corpus_pipeline.STAGES)
    a = language(spark, docs, "")
    kept = {r.doc_id: r for r in a.collect()}
    assert set(docs.toPandas().doc_id) - set(kept) == {50, 51} and a.columns == docs.columns
    b = near(spark, a, "")
    want = {c for (_, n, c), _ in plain_jaccard([(r.doc_id, r.text) for r in kept.values()]).items()}
    rows = {r.doc_id: r for r in b.collect()}
    assert set(rows) == want and not {31, 32} & set(rows) and b.columns == docs.columns
    c = {r.doc_id: r for r in repeated(spark, b, "").collect()}
    left = {x[0]: x[1] - x[2] for x in plain_repeats([(r.doc_id, r.text) for r in rows.values()])}
    assert {k: len(r.text.encode()) for k, r in c.items()} == left and all(c[k].n_chars == len(c[k].text) for k in (40, 41))
    d = redacted(spark, repeated(spark, b, ""), "")
    texts = {r.doc_id: r.text for r in d.collect()}
    assert texts[52].endswith(" [assign]\"") and d.columns == docs.columns and {k: v for k, v in texts.items() if k != 52} == {k: r.text for k, r in c.items() if k != 52}
    encoder, pieces = bpe.Encoder(bpe.vocabulary_path()), defaultdict(int)
    for r in packed(spark, d, "").collect():
        pieces[r.doc_id] += r.length
    assert pieces == {k: len(encoder.encode(t)) // 4 + 1 for k, t in texts.items()}


def test_run(spark, tmp_path):
    docs_of(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() == 24 and packing.SIZE == 1024
    empty = tmp_path / "empty"
    docs_of(spark).limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_stages_go_in_light_batches_and_keep_few_units(spark, monkeypatch):
    docs, name, made = docs_of(spark), "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name, None)
    monkeypatch.setattr(corpus_pipeline, "KEPT", 50)
    whole = packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **k: made.append(k["kept"]) or whole(*a, **k))
    try:
        spark.conf.unset(name)
        got = corpus_pipeline.packed(spark, docs, "").drop("sequence_id", "offset").collect()
        assert int(spark.conf.get(name)) == corpus_pipeline.BATCH and made == [50]
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert sorted(got) == sorted(whole(docs).drop("sequence_id", "offset").collect())
