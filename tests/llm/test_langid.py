import itertools

import numpy as np
import pytest

from terrane.llm import langid


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs)


def test_held_out_accuracy(docs, model):
    got = langid.predict(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_uses_text_alone(spark, docs, model):
    rows = [(1, "the and of that", "de", 0), (1, "the and of that", None, 1), (None, None, "en", 2), (4, "", "en", 3), (5, "12 34 ...", "en", 4), (6, "x " * 40000, None, 5)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), model).collect()
    assert [r.lang_pred for r in got[:2]] == ["en", "en"] and {(r.lang_pred, r.score) for r in got if r.doc_id in (None, 4, 5)} == {("und", 0.0)}
    assert len(got) == 6
    kept = langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), model)
    assert sorted(r.score for r in kept.collect()) == [0, 1, 5]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.report(empty).collect()] == [("und", 0.0)]
    assert langid.report(empty.limit(0)).collect() == []


def test_mixed_text_is_cut_into_spans(model):
    text = "the and of that thing with " * 10 + "der und die nicht sich auf " * 10
    spans = model.label(text)
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[1][0] - 270) <= 12


def test_viterbi_is_the_best_path(model):
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        for scale in (3, 10, 30):
            e = (-r.random((n, 3)) * scale).astype(np.float32)
            value = lambda p: sum(float(e[i, s]) for i, s in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
            best = max(value(p) for p in itertools.product(range(3), repeat=n))
            assert abs(value(model.states(e).tolist()) - best) < 1e-4


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "привет мир это русский текст" if i % 2 else "hello world this is english text", "ru" if i % 2 else "en") for i in range(40)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    e = m.score(["слово", "word"])
    assert e[0].tolist() == [-langid.CLIP, 0.0] and e[1].tolist() == [0.0, -langid.CLIP]


def test_runs_are_read_to_their_end(spark):
    rows = [(i, ("слово и текст", "word and text", "你好世界中文", "これはほんです")[i % 4], ("ru", "en", "zh", "ja")[i % 4]) for i in range(80)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.label("word" * 60 + "你好世界" * 120) == [(0, 240, "en"), (240, 720, "zh")]
    assert m.verdicts(["word" * 10 + "слово" * 40])[0][0] == "ru" and m.verdicts(["你好世界" + "これはほん" * 20])[0][0] == "ja"


def test_pieces_are_the_whole_run():
    run = "Việtngữ" + "п" * 95 + "x𠀀𠀁한국어"
    got = langid.split([run, "plain", "b" * 81, "п\u02bcять"])
    assert got == ["Việtngữ", "п" * 40, "п" * 40, "п" * 15, "x", "𠀀𠀁", "한국어", "plain", "b" * 40, "b" * 40, "b", "п\u02bcять"]


def test_all_languages_are_learned(spark):
    names = [f"l{i:02d}" for i in range(70)]
    own = [chr(97 + i % 26) * 3 + chr(97 + i // 26) * 3 for i in range(70)]
    rows = [(k * 70 + i, f"{own[i]} {own[i]}z", names[i]) for k in range(6) for i in range(70)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == names and [v[0] for v in m.verdicts([f"{w} {w}z" for w in own])] == names


def test_numbers_are_no_letters(model):
    """Fractions, raised digits, circled numbers and numerals are not letters; beside letters they only part them."""
    for text in ("½", "²", "①", "Ⅷ", "x²"[1:], "〇", "½ ² 3", "٣"):
        assert model.verdicts([text]) == [("und", 0.0)] and model.label(text) == []
    assert langid.split(["ab½cd", "é²", "²"]) == ["ab", "cd", "é"]
    assert model.verdicts(["the½thing and that"])[0][0] != "und"
    assert [text[a:b] for text in ["½the thing²"] for a, b, _ in model.label(text)] == ["the thing"]
