"""Operator 4: canonical exact fingerprints, with SQL functions alone.

The canonical form of a text is its compatibility composition (NFKC), case-folded, composed again, with every
run of white space folded into one space and none at the ends. A fingerprint is a 128-bit xxhash of that
form. Texts that meet in one bucket are compared byte by byte; should two different forms ever meet, their
fingerprints get the rank of their form within the bucket as a suffix. Equal texts therefore have equal
fingerprints, and different forms have different ones. Likeness is 1 for equal fingerprints and 0 for others.

The next document (descending id, nulls last, rows with one id in the order of their text's hash and text) is
found without a global sort: quantiles of the id cut the rows into buckets, and the first row of each bucket
is also sent to the bucket before it. Null text counts as empty. Rows are kept one for one, repeated
rows and ids included; a single row is its own next document. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows to a bucket in the search for the next document, and the most buckets.
BUCKET_ROWS = 2000
MOST_BUCKETS = 1 << 14
_LOWEST = -(1 << 62)


def canonical(text):
    """The canonical form; the two static methods are those of the Unicode library that Spark brings."""
    call = lambda method, x: F.java_method(F.lit(method[0]), F.lit(method[1]), x, F.lit(True))
    compose, fold = ("com.ibm.icu.text.Normalizer", "compose"), ("com.ibm.icu.lang.UCharacter", "foldCase")
    folded = call(compose, call(fold, call(compose, F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def wide(form) -> tuple:
    """128 bits in two longs."""
    return F.xxhash64(form), F.xxhash64(F.lit("wide"), form)


def in_buckets(docs: DataFrame) -> DataFrame:
    """doc_id, text, place, bucket, guest: every row in its bucket, and each bucket's first rows as guests in the bucket before."""
    place = F.coalesce("doc_id", F.lit(_LOWEST).cast("long"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))
    n = docs.count()
    k = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 100 * k)).head()[0] if k > 1 else None
    cuts = F.lit(sorted(set(cuts or [])) or [_LOWEST]).cast("array<bigint>")
    steps = F.lit([1 << i for i in range(MOST_BUCKETS.bit_length(), -1, -1)])
    bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.try_element_at(cuts, at + s) <= F.col("place"), at + s).otherwise(at))
    rows = rows.withColumn("bucket", bucket)
    heads = dict(sorted((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.max("place").alias("head")).collect()))
    order = list(heads)
    before = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    by_bucket = lambda known, kind: F.get(F.lit([known.get(b, -1) for b in range(max(order, default=0) + 1)]).cast(f"array<{kind}>"), F.col("bucket"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(by_bucket(before, "int").alias("bucket"), F.lit(1).alias("guest"))
    seats = F.when(by_bucket(heads, "bigint") == F.col("place"), F.array(own, guest)).otherwise(F.array(own))
    return rows.select("doc_id", "text", "place", F.explode(seats).alias("seat")).select("doc_id", "text", "place", "seat.*")


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, edited."""
    w = Window.partitionBy("bucket").orderBy("guest", F.desc("place"), F.xxhash64("text"), "text")
    rows = in_buckets(docs).withColumn("next_text", F.lead("text").over(w)).where("guest = 0")
    return rows.select("doc_id", "text", "next_text", _edited("text", "next_text").alias("edited"))


def _edited(text: str, following: str):
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def _raw(text):
    """The key of a text as it is: 128 bits."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("raw"), text).alias("b"))


def hashed(docs: DataFrame) -> DataFrame:
    """The compact rows from which everything else follows; t, x: keys of the text and of the next text."""
    rows = with_edits(docs)
    h, e, n = wide(canonical(F.col("text"))), wide(canonical(F.col("edited"))), wide(canonical(F.col("next_text")))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), _raw(F.col("text")).alias("t"), _raw(F.col("next_text")).alias("x"), *(c.alias(f"{a}{i}") for a, pair in (("h", h), ("e", e), ("n", n)) for i, c in enumerate(pair)))


def collisions(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """h0, h1, form, t, x: the forms (of texts t, or of texts t edited with x) in buckets where different forms meet. Only texts
    whose bucket holds more than one row are read again."""
    both = rows.select("h0", "h1").unionAll(rows.select(F.col("e0").alias("h0"), F.col("e1").alias("h1")))
    shared = common.stage(both.groupBy("h0", "h1").agg(F.count("*").alias("n")).where("n > 1").select("h0", "h1"))
    shared = common.small(shared, 1_000_000)
    own = rows.join(shared, ["h0", "h1"], "left_semi").select("h0", "h1", "t").distinct()
    edited = common.stage(rows.select(F.col("e0").alias("h0"), F.col("e1").alias("h1"), "t", "x").join(shared, ["h0", "h1"], "left_semi").distinct())
    keys = common.small(common.stage(own.select("t").unionAll(edited.select("t")).unionAll(edited.select("x")).distinct()), 1_000_000)
    texts = docs.select(_raw(F.col("text")).alias("t"), F.coalesce("text", F.lit("")).alias("text")).join(keys, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    forms = own.join(texts, "t").select("h0", "h1", "t", F.lit(None).cast("struct<a:bigint,b:bigint>").alias("x"), canonical(F.col("text")).alias("form"))
    if edited.limit(1).count():
        following = texts.select(F.col("t").alias("x"), F.col("text").alias("next_text"))
        forms = forms.unionByName(edited.join(texts, "t").join(following, "x").select("h0", "h1", "t", "x", canonical(_edited("text", "next_text")).alias("form")))
    meet = forms.groupBy("h0", "h1").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low != high").select("h0", "h1")
    meet = common.stage(meet)
    return forms.join(meet, ["h0", "h1"], "left_semi") if meet.limit(1).count() else meet


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = common.stage(hashed(docs))
    found = collisions(docs, rows)
    rank = {a: F.lit("") for a in "hen"}
    if "form" in found.columns:
        order = Window.partitionBy("h0", "h1").orderBy("form")
        ranked = common.stage(found.select("t", "x", F.concat(F.lit("-"), F.dense_rank().over(order)).alias("rank")))
        own = ranked.where("x is null").select("t", F.col("rank").alias("rank_h")).distinct()
        edit = ranked.where("x is not null").select("t", "x", F.col("rank").alias("rank_e")).distinct()
        rows = rows.join(own, "t", "left").join(edit, ["t", "x"], "left").join(own.select(F.col("t").alias("x"), F.col("rank_h").alias("rank_n")), "x", "left")
        rank = {a: F.coalesce(f"rank_{a}", F.lit("")) for a in "hen"}
    print_ = {a: F.concat(F.lower(F.lpad(F.hex(f"{a}0"), 16, "0")), F.lower(F.lpad(F.hex(f"{a}1"), 16, "0")), rank[a]) for a in "hen"}
    same = lambda a, b: F.when(print_[a] == print_[b], 1.0).otherwise(0.0)
    return rows.select("doc_id", "n_chars", "edited_sha256", print_["h"].alias("fingerprint"), print_["e"].alias("edited_fingerprint"), same("h", "e").alias("near_edited"), same("h", "n").alias("near_next"))
