"""Operator 3: exact n-gram Jaccard join, with components.

A document's set holds 64-bit hashes of its distinct shingles; documents with the same set are one node. A pair
that reaches the threshold shares ``NUM * (n_a + n_b) / (NUM + DEN)`` shingles or more. In any fixed order of the
shingles, its first shared one then stands at a place ``pos`` in both sets with ``n - pos`` no less than that, so a node
need only be listed under its first ``n - ceil(0.8 n) + 1``. The order puts the shingles that very many documents share
last (by counts over all documents), so a common passage lists nobody but those made of little else.

A set is told by 128 bits: the first 64 are its node, and in the rare case that two sets share these, both get nodes that tell them apart. Texts are fetched by 128 bits as well.

A tile is what one shingle lists, in bands of sizes; linked sets lie in the same or neighbouring bands. Signatures are
parity bitmaps: the bits that differ bound the symmetric difference from below, so ``(|A| + |B| - differing bits) / 2``
bounds the overlap from above. What passes is decided on the sorted sets.

A group of near copies is never spelt out as pairs. In each of ``ROUNDS`` rounds a node is compared with at most two centres
of its tiles that are in other components than its own. The centre is the node with the fewest shingles before the tile's own:
rarer ones are what tells a copy from the text that it was made from, so the centre is what most of the group is close to.
Rounds go on, up to ``MOST_ROUNDS``, while they find links and the pairs left in the tiles are more than ``PAIRS`` times their listings.
Then nodes of one tile that are still in different components, and whose places and sizes let them reach the threshold, are
compared, all of them: no two linked sets stay apart.

The hash stands for the shingle: two different shingles of one pair meet with chance 2**-64. A text without words
is linked with nothing. Null text counts as empty. Rows are kept one for one, repeated rows and ids
included. A null id takes part but is never a component's id unless the component has no other. Empty
table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
#: Linked when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Shingles that the order knows as frequent: at most 8 MB to every task.
HOT = 1 << 19
#: A block of this many shingles is counted in a task before what repeats in it is passed on.
BLOCK = 1_500_000
#: Times that a shingle must occur in a block to be passed on.
REPEATS = 2
#: Rounds of comparisons with centres; more of them where many pairs are left.
ROUNDS = 3
MOST_ROUNDS, PAIRS = 8, 20
#: Listings of one shingle that one task looks through for a second node.
TILE = 1_000_000

_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes (int64) of the distinct shingles; bytes.split cuts at the six ASCII white-space characters
    and bytes.lower changes A-Z alone, which is the contract's wording."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = out * _K + h[i : len(h) - size + 1 + i]
        return np.unique(_mixed(out).view(np.int64))


def _counted(block: list[np.ndarray]) -> pa.RecordBatch:
    value, n = np.unique(np.concatenate(block) if block else np.zeros(0, np.int64), return_counts=True)
    keep = n >= REPEATS
    return pa.RecordBatch.from_arrays([pa.array(value[keep]), pa.array(n[keep].astype(np.int64))], ["shingle", "n"])


def frequent_shingles(docs: DataFrame, words: int = WORDS, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, the most frequent last, at most ``most``, and their counts. Sets of a block with the same smallest
    shingles (copies) count once. Any result gives right links: it only orders the search."""

    def count(batches):
        block, held, seen = [], 0, set()
        for batch in batches:
            for text in common.texts(batch):
                s = shingle_set(text, words)
                if (key := s.tobytes()[:64]) in seen and len(s):
                    continue
                seen.add(key)
                block.append(s)
                held += len(s)
                if held >= BLOCK:
                    yield _counted(block)
                    block, held, seen = [], 0, set()
        yield _counted(block)

    common.light_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(common.light(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(most).toPandas().sort_values(["n", "shingle"])
    return top["shingle"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def signature(s: np.ndarray) -> np.ndarray:
    """Parity bitmap (int64 words) of 64 bits or more, about twice as many as the set has members."""
    bits = 64
    while bits < 2 * len(s) and bits < 1 << 16:
        bits *= 2
    odd = np.bincount((s.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def text_keys() -> list:
    """128 bits of the text, as two columns."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit("second"), text).alias("text_key2")]


def sketches(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int = WORDS) -> DataFrame:
    """A row for each document: doc_id, text_key, text_key2, n, node, check; and bits, prefix, slot of the first document with its set in a
    task, null for the others. ``slot`` spreads the listings of shingles with over ``TILE`` of them; null: there are none."""
    shingles, counts = frequent
    ranked = np.argsort(shingles, kind="stable")
    heavy = {int(k): int(n) // TILE + 1 for k, n in zip(shingles[counts > TILE], counts[counts > TILE], strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast((shingles[ranked], ranked.astype(np.int32), heavy))

    def run(batches):
        hot, rank, heavy = shared.value
        seen = set()
        for batch in batches:
            for part in common.pieces_of(batch):
                out = {"n": [], "node": [], "check": [], "bits": [], "prefix": [], "slot": []}
                for text in common.texts(part):
                    s = shingle_set(text, words)
                    n = len(s)
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    node = (whole >> 64) - (1 << 63)
                    out["n"].append(n)
                    out["node"].append(node)
                    out["check"].append((whole & ((1 << 64) - 1)) - (1 << 63))
                    if not n or whole in seen:
                        for c in ("bits", "prefix", "slot"):
                            out[c].append(None)
                        continue
                    seen.add(whole)
                    order = _ordered(s, hot, rank)[: n - (NUM * n + DEN - 1) // DEN + 1]
                    slots = [heavy.get(x, 0) for x in order.tolist()] if heavy else ()
                    out["bits"].append(signature(s))
                    out["prefix"].append(order)
                    out["slot"].append([x and 1 + node % x for x in slots] if any(slots) else None)
                yield pa.RecordBatch.from_arrays([*(common.column(part, c) for c in ("doc_id", "text_key", "text_key2")), *(pa.array(v, common.ARROW[ddl[c]]) for c, v in out.items())], [*ddl])

    ddl = {"doc_id": "long", "text_key": "long", "text_key2": "long", "n": "long", "node": "long", "check": "long", "bits": "array<long>", "prefix": "array<long>", "slot": "array<long>"}
    common.light_batches(docs.sparkSession)
    rows = docs.select("doc_id", *text_keys(), "text")
    return rows.mapInArrow(common.light(run), ", ".join(f"{k} {v}" for k, v in ddl.items()))


def _ordered(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set with its frequent shingles last, by rank."""
    if not len(hot):
        return s
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    if not is_hot.any():
        return s
    late = s[is_hot]
    return np.concatenate([s[~is_hot], late[np.argsort(rank[at[is_hot]], kind="stable")]])


def listings(sketched: DataFrame) -> DataFrame:
    """shingle, node, n, pos, band: the listings of shingles that list two nodes or more. Both branches read the same shuffle, in
    which a shingle with very many listings is spread over its slots."""
    listed = sketched.where("prefix is not null").select("node", "n", "slot", F.posexplode("prefix").alias("pos", "shingle"))
    listed = listed.withColumn("slot", F.coalesce(F.get("slot", F.col("pos")), F.lit(0).cast("long"))).repartition("shingle", "slot")
    tiles = listed.groupBy("shingle", "slot").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high or slot > 0").select("shingle", "slot")
    band = F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).cast("int")
    return listed.join(tiles, ["shingle", "slot"], "left_semi").distinct().drop("slot").withColumn("band", band)


def _may_link(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures let them reach the threshold."""
    facts = nodes.select("node", "n", "bits")
    a = facts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = facts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    both = pairs.join(a, "a").join(b, "b").where((DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b")))
    size = F.least(F.size("bits_a"), F.size("bits_b"))
    folded = lambda bits: F.when(F.size(bits) == size, F.col(bits)).otherwise(F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y)))
    differing = F.aggregate(F.zip_with(folded("bits_a"), folded("bits_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.floor((F.col("n_a") + F.col("n_b") - differing) / 2)
    return both.where(DEN * most >= NUM * (F.col("n_a") + F.col("n_b") - most)).select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles of the wanted nodes, from one text of each. Copies are left out within each task before anything is shuffled."""
    keys = common.small(common.stage(nodes.join(wanted, "node", "left_semi").select("text_key", "text_key2", "node")), 1_000_000)
    chosen = docs.select("text", *text_keys()).join(keys, ["text_key", "text_key2"]).select("node", "text")

    def run(batches):
        seen = set()
        for batch in batches:
            for part in common.pieces_of(batch):
                new = {}
                for node, text in zip(common.column(part, "node").to_pylist(), common.texts(part), strict=True):
                    if node not in seen:
                        seen.add(node)
                        new[node] = shingle_set(text, words)
                yield pa.RecordBatch.from_arrays([pa.array([*new], pa.int64()), pa.array([*new.values()], pa.list_(pa.int64()))], ["node", "shingles"])

    return chosen.mapInArrow(common.light(run), "node long, shingles array<long>").dropDuplicates(["node"])


def linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by the intersection of their sorted sets. Only the sets of pairs that the bounds let pass
    are made."""
    pairs = common.stage(_may_link(nodes, pairs))
    if not pairs.limit(1).count():
        return pairs
    sets = common.stage(_sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words))
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))

    def each(batch: pa.RecordBatch) -> dict:
        keep = []
        for i in range(batch.num_rows):
            x, y = (common.column(batch, c)[i].values.to_numpy() for c in ("set_a", "set_b"))
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # two sorted runs: a merge
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(DEN * same >= NUM * (len(both) - same))
        mask = pa.array(keep, pa.bool_())
        return {c: common.column(batch, c).filter(mask) for c in ("a", "b")}

    return common.arrow_pass(pairs.join(a, "a").join(b, "b"), {"a": "long", "b": "long"}, each)


def _split(listed: DataFrame, label: DataFrame | None) -> DataFrame:
    """The listings of tiles whose nodes are in different components, with label."""
    named = listed.withColumn("label", F.col("node")) if label is None else listed.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tiles = named.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("shingle")
    return common.stage(named.join(tiles, "shingle", "left_semi"))


def _reach():
    """Whether the places of a shared shingle in sets a and b leave room for the overlap that the threshold asks for. If it is the first
    one that they share, all that they share lies from there on. It holds for the first, so each linked pair passes in one tile at least."""
    return NUM * (F.col("n_a") + F.col("n_b")) <= (NUM + DEN) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))


def _side(listed: DataFrame, side: str) -> DataFrame:
    return listed.select("shingle", "band", *(F.col(c).alias(f"{c}_{side}" if c != "node" else side) for c in ("node", "n", "pos", "label")))


def _stars(listed: DataFrame, turn: int) -> DataFrame:
    """At most two pairs for each node: with the centres of its tiles that are in other components. The first turn stays within a band; the third and
    later ones take centres as they come."""
    first = F.col("pos") if turn < 2 else F.xxhash64("node", F.lit(turn))
    best = F.min(F.struct(first.alias("first"), F.xxhash64("node", F.lit(turn)).alias("mark"), "node", "n", "pos", "label")).alias("c")
    centres = listed.groupBy("shingle", "band").agg(best).select("shingle", "band", *(F.col(f"c.{c}").alias(c) for c in ("node", "n", "pos", "label")))
    centres = _side(centres, "b")
    if turn:
        centres = centres.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    met = _side(listed, "a").join(centres, ["shingle", "band"]).where((F.col("label_a") != F.col("label_b")) & _reach())
    near, any_ = F.min(F.struct("pos_b", "b")).getField("b"), F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("mark"), "b")).getField("b")
    return met.groupBy("a").agg(near.alias("near"), any_.alias("any")).select("a", F.explode(F.array_distinct(F.array("near", "any"))).alias("b"))


def _rest(listed: DataFrame) -> DataFrame:
    """All pairs of one tile and neighbouring bands whose nodes are in different components and whose places let them reach the threshold."""
    one = _side(listed, "a").withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    met = one.join(_side(listed, "b"), ["shingle", "band"]).where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _reach())
    return met.select("a", "b").distinct()


def _many(listed: DataFrame) -> bool:
    """Whether the tiles hold more than ``PAIRS`` times as many pairs as listings."""
    tiles = listed.groupBy("shingle", "band").agg(F.count("*").cast("double").alias("n"))
    total = tiles.agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).first()
    return (total.pairs or 0) > PAIRS * (total.n or 0)


def _nodes(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches and their nodes, where different sets have different nodes: sets that share their first 64 bits are named anew by all 128."""
    while True:
        facts = (F.first("n").alias("n"), F.first(F.struct("text_key", "text_key2")).alias("k"), F.first("bits", ignorenulls=True).alias("bits"), F.min("check").alias("low"), F.max("check").alias("high"))
        nodes = common.stage(sketched.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low_id"), *facts).select("node", "n", "low_id", "k.*", "bits", "low", "high"))
        clash = nodes.where("low != high").select("node", F.lit(True).alias("clash"))
        if not clash.limit(1).count():
            return sketched, nodes.drop("low", "high")
        sketched = common.stage(sketched.join(clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("clash"))


def cluster(docs: DataFrame, words: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_key, text_key2, n_shingles, component_id, node, label for every row of ``docs``. The label tells components apart, which
    the smallest id does not where ids repeat or are null."""
    sketched, nodes = _nodes(common.stage(sketches(docs, frequent_shingles(docs, words), words)))
    listed = common.stage(listings(sketched))
    links, label, turn, last = None, None, 0, False
    while True:
        listed = _split(listed, label)
        last = last or (turn >= rounds and not (turn < MOST_ROUNDS and _many(listed)))
        more = common.stage(linked(docs, nodes, _rest(listed) if last else _stars(listed, turn), words))
        found = more.limit(1).count() > 0
        if found:
            links = more if links is None else common.stage(links.unionByName(more))
            label = components(links)
        if last:
            break
        turn, last = turn + 1, not found  # centres that link nothing have done what they can
    label = label if label is not None else nodes.select("node", F.col("node").alias("label"))
    named = nodes.join(label, "node", "left").select("node", "low_id", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("low_id").alias("component_id"))
    by_node = named.join(lowest, "label").select("node", "component_id", "label")
    rows = sketched.select("doc_id", "text_key", "text_key2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return rows.join(by_node, "node", "left").select("doc_id", "text_key", "text_key2", "n_shingles", component, "node", "label")


def report(docs: DataFrame) -> DataFrame:
    return cluster(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, of several texts with that id that with the smallest digest, and of rows that
    agree in both any one. Texts without words stay.

    Rows are found again by id and digest of the text, not by a number: what a number is drawn for may differ from one reading of ``docs`` to the next."""
    docs, back = common.shielded(docs)
    key = ["doc_id", "text_key", "text_key2"]
    groups = common.stage(cluster(docs).where("n_shingles > 0").groupBy(*key, "label").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *key))
    kept = groups.groupBy("label").agg(first.alias("k")).select(*(F.col(f"k.{c}").alias(f"k_{c}") for c in key))
    same = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("text_key") == F.col("k_text_key")) & (F.col("text_key2") == F.col("k_text_key2"))
    marks = groups.join(kept, same, "left").where("k_text_key is null or n > 1").select(*(F.col(c).alias(f"m_{c}") for c in key), F.col("k_text_key").isNotNull().alias("repeated"))
    marks = common.stage(marks)
    several = marks.where("repeated").limit(1).count() > 0
    marks = common.small(marks, 1_000_000)
    same = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("text_key") == F.col("m_text_key")) & (F.col("text_key2") == F.col("m_text_key2"))
    marked = docs.select("*", *text_keys()).join(marks, same, "left")
    out = marked.where("m_text_key is null").select(*docs.columns)
    if several:
        out = out.unionByName(marked.where("repeated").dropDuplicates(key).select(*docs.columns))
    return back(out)
