"""Operator 7: personal data, by base patterns and by bootstrapped contextual extraction.

The base patterns (email, ip, card, phone) seed the search. The words beside a seed - the one and the two before
it, the one and the two after it, without the seed's shape, and the word before it with that shape - are its
lexical patterns; so are those of every other token that looks like an identifier. Spark keeps the graph of
patterns and instances as counted edges and scores it in rounds: a pattern is as good as the mean score of its
distinct instances, shrunk towards nought while these are few; an instance is, to a pattern, as good as one minus
the product of the failings of its better patterns at other words, so that no pattern vouches for itself; seeds
stay at 1. Instances that are no seeds are reported as kind ``found`` at places where a pattern of high
confidence stands beside them. As words alone make a pattern, confidence passes to shapes that no seed has.

Only the edges go through the rounds: their number follows the identifiers in the text, not its length, and
a pattern that is very frequent (a hot key) is one row after counting. Null text counts as empty: no spans.
Rows are kept one for one, repeated rows and ids included. Empty table: no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .secrets import _zipped, written

KINDS = ("email", "ip", "card", "phone", "found")
ROUNDS = 3
#: A pattern's confidence is sum of scores / (distinct instances + SHRINK); it is trusted from TRUST on.
SHRINK = 2.0
TRUST = 0.8
#: A pattern speaks for an instance from this confidence on.
VOICE = 0.5

# The base patterns, written so that a text of any length is read once: what stands before an @ is found from the @ back, runs of digits are
# entered at their first digit only and not given back.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]").search
#: What may be an identifier (``identifier`` decides, once for each run): groups of digits, or a whole run of the signs of one.
_TOKEN = re.compile(r"(?<![A-Za-z0-9@+])(?:\+?\(?[0-9]++(?:[\x20()./-]{1,3}+[0-9]++)*(?![._/+-]?[A-Za-z0-9@])|\+?[A-Za-z0-9@][A-Za-z0-9@._/+-]*+)")
_LEFT = re.compile(r"(?:([^\W\d_]{2,24})[^\w\n]{1,3})?([^\W\d_]{2,24})[^\w\n]{1,4}\Z")
_RIGHT = re.compile(r"[^\w\n]{1,4}([^\W\d_]{2,24})(?!\w)(?:[^\w\n]{1,3}([^\W\d_]{2,24})(?!\w))?")


def _small(part: str) -> bool:
    """At most 255, without leading zeros."""
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int, str]]:
    """Leftmost, non-overlapping: an @ with a local part before it, cut off at the end of the match before, and a domain of two labels or more after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            out.append((start, free, "email"))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by kind as listed and then by start."""
    out = []
    if "@" in text:
        out += emails(text)
    if _DIGIT(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(_small(p.lstrip("0")) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def shape(token: str) -> str:
    return re.sub(r"9{5,}", "9+", re.sub(r"a{4,}", "a+", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", token))))


def contexts(text: str, start: int, end: int, form: str) -> list[str]:
    """The lexical patterns of a place, as side:word or side:word:more. What is alike up to the word is one group."""
    out = []
    if m := _LEFT.search(text, max(0, start - 64), start):
        word = f"l:{m[2].lower()}"
        out += [word, f"{word}:<{form}>", *([f"{word}:{m[1].lower()}"] if m[1] else [])]
    if m := _RIGHT.match(text, end, end + 64):
        word = f"r:{m[1].lower()}"
        out += [word, *([f"{word}:{m[2].lower()}"] if m[2] else [])]
    return out


def identifier(token: str) -> bool:
    digits = sum(c in "0123456789" for c in token)
    return digits >= 5 or "@" in token or (digits > 0 and any(c.isalpha() for c in token))


def occurrences(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, instance, seed?, patterns joined by tabs) of seeds and, between them, of other identifier-like tokens."""
    if not base and not _DIGIT(text) and "@" not in text:
        return []
    out, taken = [], sorted(base)
    for s, e, _ in taken:
        out.append((s, e, text[s:e], True, "\t".join(contexts(text, s, e, shape(text[s:e])))))
    at = 0
    for a, b, _ in [*taken, (len(text), len(text), "")]:
        for m in _TOKEN.finditer(text, at, a) if at < a else ():
            token = m[0].rstrip("./-")
            s, e = m.start(), m.start() + len(token)
            if identifier(token) and not (m.end() == a < len(text) and text[a].isalnum() and text[a - 1].isalnum()):
                out.append((s, e, token, False, "\t".join(contexts(text, s, e, shape(token)))))
        at = max(at, b)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One pass: doc_row, doc_id, base spans and occurrences, as parallel arrays."""

    def each(batch: pa.RecordBatch) -> dict:
        base, seen = [], []
        for text in common.texts(batch):
            spans = base_spans(text)
            base.append(spans)
            seen.append(occurrences(text, spans))
        out = {c: common.column(batch, c) for c in ("doc_id", "doc_row")}
        out |= {f"base_{n}": [[s[i] for s in r] for r in base] for i, n in enumerate(("start", "end", "kind"))}
        return out | {f"seen_{n}": [[s[i] if n != "seed" else int(s[i]) for s in r] for r in seen] for i, n in enumerate(("start", "end", "instance", "seed", "patterns"))}

    ddl = {"doc_id": "long", "doc_row": "long", "base_start": "array<long>", "base_end": "array<long>", "base_kind": "array<string>", "seen_start": "array<long>", "seen_end": "array<long>", "seen_instance": "array<string>", "seen_seed": "array<long>", "seen_patterns": "array<string>"}
    return common.arrow_pass(docs.select("doc_id", "text").withColumn("doc_row", F.monotonically_increasing_id()), ddl, each)


def seen(scanned: DataFrame) -> DataFrame:
    names = ("start", "end", "instance", "seed", "patterns")
    return scanned.select("doc_row", F.explode(F.arrays_zip(*(F.col(f"seen_{n}").alias(n) for n in names))).alias("o")).select("doc_row", "o.*")


def patterns(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, confidence: the graph's patterns after the last round."""
    edges = seen(scanned).where("patterns != ''").select("instance", "seed", F.explode(F.split("patterns", "\t")).alias("pattern"))
    edges = common.stage(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    scores = edges.select("pattern", F.col("seed").cast("double").alias("score"))
    confidence = lambda: scores.groupBy("pattern").agg((F.sum("score") / (F.count("*") + SHRINK)).alias("confidence"))
    word = F.substring_index("pattern", ":", 2).alias("word")
    for _ in range(rounds):
        speaks = confidence().where(F.col("confidence") >= VOICE)
        words = edges.where("seed = 0").join(speaks, "pattern").groupBy("instance", word).agg(F.log1p(-F.least(F.max("confidence"), F.lit(0.999))).alias("own"))
        words = common.stage(words)
        whole = words.groupBy("instance").agg(F.sum("own").alias("all"))
        told = edges.select("*", word).join(whole, "instance", "left").join(words, ["instance", "word"], "left")
        others = 1 - F.exp(F.coalesce("all", F.lit(0.0)) - F.coalesce("own", F.lit(0.0)))
        scores = common.stage(told.select("pattern", F.when(F.col("seed") == 1, 1.0).otherwise(others).alias("score")))
    return confidence()


def discovered(scanned: DataFrame, rounds: int = ROUNDS, trust: float = TRUST) -> DataFrame:
    """doc_row, start, end of identifiers that no base pattern knows."""
    good = common.stage(patterns(scanned, rounds).where(F.col("confidence") >= trust))
    others = seen(scanned).where("seed = 0 and patterns != ''").select("doc_row", "start", "end", F.explode(F.split("patterns", "\t")).alias("pattern"))
    return others.join(good, "pattern", "left_semi").select("doc_row", "start", "end").distinct()


def find(docs: DataFrame, rounds: int = ROUNDS, trust: float = TRUST) -> DataFrame:
    """doc_id, base: array<struct<start,end,kind>>, spans: the same with what was discovered, by kind and start."""
    scanned = common.stage(scan(docs))
    new = discovered(scanned, rounds, trust).groupBy("doc_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.lit("found").alias("kind")))).alias("new"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    return scanned.select("doc_id", "doc_row", _zipped("base").alias("base")).join(new, "doc_row", "left").select("doc_id", "base", F.concat("base", F.coalesce("new", empty)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, from ``find``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(docs).select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
