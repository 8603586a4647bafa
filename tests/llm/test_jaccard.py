import random
from collections import Counter

import pytest

from terrane.llm import jaccard
from terrane.llm.components import components


def plain(rows):
    """n_shingles and component_id of (doc_id, text) rows, all pairs compared."""
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[max(root(i), root(j))] = min(root(i), root(j))
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[root(i)] = min(lowest.get(root(i), d), d)
    return Counter((d, len(s), lowest.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    texts = [None, "", " \t", "one two", "One  two", "one two three", "a b c d e", "a b c d e"]
    for _ in range(12):
        base = r.choices(vocabulary, k=r.randint(5, 120))
        for _ in range(r.randint(1, 6)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 20))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words + (passage if r.random() < 0.3 else [])))
    texts.append(" ".join(r.choices(vocabulary, k=20_000)))
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[-2]), (3, texts[-2])]


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    rows = made(seed)
    got = jaccard.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = jaccard.report(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain([tuple(r) for r in docs.collect()])


def test_keep_one(spark):
    rows = [(7, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (9, None), (9, None), (2, "x y")]
    docs = spark.createDataFrame([(*r, "m", i) for i, r in enumerate(rows)], "doc_id long, text string, node string, n long")
    assert sorted(((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()), key=str) == sorted([(5, "a b c d e f"), (9, None), (9, None), (2, "x y")], key=str)


def test_keep_one_tells_components_apart(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:-1], x]) for x in ("x", "y", "z")]
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (1, "g h i j k l"), (4, "g h i j k l"), (1, "m n o p q r"), *((None, t) for t in near)]
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    alike = [(d, t) for d, t in got if t in near]
    assert len(alike) == 1 and got == Counter([rows[0], rows[1], rows[4], alike[0]])


def test_keep_one_of_frames_without_an_order(spark):
    """Rows that come out of a shuffle, a join and a coalesce: every group keeps one row, and clean documents stay."""
    from pyspark.sql import functions as F

    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("g"), i), F.lit(5000)).cast("string"))))
    base = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.floor(F.col("id") / 30)).alias("g")).select("id", words.alias("text"))
    want = {t: min(i) for t, i in ((r.text, r.ids) for r in base.groupBy("text").agg(F.collect_list("id").alias("ids")).collect())}
    shuffled = base.groupBy("id").agg(F.first("text").alias("text")).withColumnRenamed("id", "doc_id")
    joined = base.select("id").repartition(7).join(base, "id").withColumnRenamed("id", "doc_id")
    for docs in (shuffled, joined, shuffled.coalesce(2)):
        got = [(r.text, r.doc_id) for r in jaccard.keep_one(docs).collect()]
        assert sorted(got) == sorted(want.items())


def test_sets_that_share_64_bits(spark):
    """Nodes that clash are told apart by the other 64 bits."""
    rows = [(i, i, i, 2, 5 if i < 3 else 9, i % 2 if i < 3 else 0, [1], [i], None) for i in range(5)]
    ddl = "doc_id long, text_key long, text_key2 long, n long, node long, check long, bits array<long>, prefix array<long>, slot array<long>"
    sketched, nodes = jaccard._nodes(spark.createDataFrame(rows, ddl))
    node = {r.doc_id: r.node for r in sketched.collect()}
    assert node[0] == node[2] != node[1] and node[3] == node[4] == 9 and nodes.count() == 3


def test_a_large_group_of_near_copies(spark):
    """Copies with a word or two changed, around a passage that many others share."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(12))
    rows += [(2000 + i, passage + " " + " ".join(f"q{r.randrange(300)}" for _ in range(30))) for i in range(300)]
    got = jaccard.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows)


def test_empty(spark):
    assert jaccard.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([((i * 7919) % 10007, ((i + 1) * 7919) % 10007) for i in range(200)] + [(-1, -2)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert len(set(got.values())) == 2 and len(got) == 203 and got[-1] == got[-2]
