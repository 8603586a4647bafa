"""Operator 1: secrets, with multipart credentials linked by an interval join.

Strong (base) spans stand by themselves: assignments, access identifiers, long hex runs. Weak parts do not:
short access identifiers and account names, short or keyless secrets, and endpoints. A weak part counts only
where complementary parts lie in its scope: the document, within ``REACH`` code points. An access identifier
and a secret near each other are linked; an endpoint is reported if both lie near it.

Spark joins parts by (document row, stretch of ``REACH`` code points), each part being listed under every
stretch that it covers and the identifiers also under the two beside these, so no document's parts are paired
all with all, and parts of any length meet.

Null text counts as empty: no spans. Rows are kept one for one, repeated rows and ids included. Empty table:
no rows. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
#: Code points between two parts of one credential.
REACH = 200

# The strong patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12

# The weak patterns, whose group "v" is the part. All but the access prefixes and keyless secrets need a separator.
PREFIXES = ("akia", "asia", "ghp_", "sk_")
WEAK_ACCESS = re.compile(r"""(?:AKIA|ASIA|ghp_|sk_)(?P<v>[A-Za-z0-9]{6,})|\b(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account)["']?\x20*[:=]\x20*["']?(?P<w>[A-Za-z0-9_.@+-]{3,})""", re.A | re.I)
WEAK_SECRET = re.compile(r"""\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|auth|credential|private_?key|secret_?access_?key)["']?\x20*[:=]\x20*["']?(?P<v>[^\s"',;]{6,})""", re.A | re.I)
KEYLESS = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}""", re.A | re.I)


def strong(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def weak(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of parts that count only together, clear of the base spans."""
    out = []
    separated = ":" in text or "=" in text
    low = "" if separated else text.lower()
    if separated or any(p in low for p in PREFIXES):
        out += [(*m.span("w" if m["w"] else "v"), "weak_access") for m in WEAK_ACCESS.finditer(text)]
    if separated:
        out += [(*m.span("v"), "weak_secret") for m in WEAK_SECRET.finditer(text)]
        out += [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)]
    out += [(*m.span(), "weak_secret") for m in KEYLESS.finditer(text) if _mixed(m[0])]
    starts, ends = _union(taken)
    clear, last = [], {}
    for part in sorted(set(out)):
        before = bisect_left(starts, part[1]) - 1  # the last base stretch that starts before the part's end
        # Parts of one kind are kept in order and do not overlap, so the last of them ends last.
        if (before < 0 or ends[before] <= part[0]) and part[0] >= last.get(part[2], 0):
            clear.append(part)
            last[part[2]] = part[1]
    return clear


def _union(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans (sorted by start) cover."""
    starts, ends = [], []
    for s, e, _ in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _mixed(x: str) -> bool:
    return any(c.isdigit() for c in x) and any(c.islower() for c in x) and any(c.isupper() for c in x)


def scan(docs: DataFrame) -> DataFrame:
    """One pass: doc_row (unique), doc_id, text_key, base spans and weak parts as parallel arrays."""

    def each(batch: pa.RecordBatch) -> dict:
        base, loose = [], []
        for text in common.texts(batch):
            spans = strong(text)
            base.append(spans)
            loose.append(weak(text, spans))
        out = {c: common.column(batch, c) for c in ("doc_id", "doc_row", "text_key")}
        for name, rows in (("base", base), ("weak", loose)):
            out |= {f"{name}_start": [[s[0] for s in r] for r in rows], f"{name}_end": [[s[1] for s in r] for r in rows], f"{name}_kind": [[s[2] for s in r] for r in rows]}
        return out

    ddl = {"doc_id": "long", "doc_row": "long", "text_key": "string"} | {f"{a}_{b}": t for a in ("base", "weak") for b, t in (("start", "array<long>"), ("end", "array<long>"), ("kind", "array<string>"))}
    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    return common.arrow_pass(keyed.withColumn("doc_row", F.monotonically_increasing_id()), ddl, each)


def _zipped(name: str):
    return F.arrays_zip(*(F.col(f"{name}_{x}").alias(x) for x in ("start", "end", "kind")))


def _stretches(start: str, end: str, reach: int, more: int = 0):
    """Every stretch that start to end - 1 covers, and ``more`` on both sides."""
    return F.explode(F.sequence(F.floor(F.col(start) / reach) - more, F.floor((F.col(end) - 1) / reach) + more)).alias("stretch")


def link(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts whose complement lies in their scope: doc_row, start, end, kind."""
    parts = scanned.where(F.size("weak_start") > 0).select("doc_row", F.explode(F.concat(_zipped("base"), _zipped("weak"))).alias("p")).select("doc_row", "p.*")
    role = F.when(F.col("kind").isin("access", "weak_access"), "id").when(F.col("kind") == "endpoint", "place").otherwise("secret")
    parts = parts.withColumn("role", role)
    ids = parts.where("role = 'id'").select("doc_row", F.col("start").alias("i_start"), F.col("end").alias("i_end"), F.col("kind").alias("i_kind"), _stretches("start", "end", reach, 1))
    secrets = parts.where("role = 'secret'").select("doc_row", _stretches("start", "end", reach), "start", "end", "kind")
    near = (F.col("start") < F.col("i_end") + reach) & (F.col("i_start") < F.col("end") + reach)
    pairs = ids.join(secrets, ["doc_row", "stretch"]).where(near & ((F.col("start") >= F.col("i_end")) | (F.col("i_start") >= F.col("end"))))
    found = pairs.select("doc_row", F.explode(F.array(F.struct(F.col("i_start").alias("start"), F.col("i_end").alias("end"), F.col("i_kind").alias("kind")), F.struct("start", "end", "kind"))).alias("p")).select("doc_row", "p.*")
    credentials = pairs.select("doc_row", F.least("i_start", "start").alias("c_start"), F.greatest("i_end", "end").alias("c_end")).distinct()
    credentials = credentials.select("*", _stretches("c_start", "c_end", reach, 1))
    places = parts.where("role = 'place'").select("*", _stretches("start", "end", reach)).join(credentials, ["doc_row", "stretch"]).where((F.col("start") < F.col("c_end") + reach) & (F.col("c_start") < F.col("end") + reach))
    found = found.unionByName(places.select("doc_row", "start", "end", "kind"))
    return found.where(F.col("kind").isin("weak_access", "weak_secret", "endpoint")).distinct()


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, text_key, base: array<struct<start,end,kind>>, spans: the same with the linked parts, in order."""
    scanned = common.stage(scan(docs))
    linked = link(scanned, reach).groupBy("doc_row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    ordered = F.array_sort(F.transform(F.concat(_zipped("base"), F.coalesce("linked", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"))), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return scanned.join(linked, "doc_row", "left").select("doc_id", "text_key", _zipped("base").alias("base"), F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def written(spans):
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, from ``find``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(docs).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span's text replaced by ``[kind]``. Spans are a function of the text, so they are
    joined back by its digest; overlapping spans are replaced as one. n_chars, if there, is counted anew. Texts are put together in one walk over their spans."""
    docs, back = common.shielded(docs)
    hits = find(docs).where(F.size("spans") > 0).groupBy("text_key").agg(F.first("spans").alias("redact_spans"))
    hits = common.small(common.stage(hits), 1_000_000, F.size("redact_spans") + 2)
    keyed = docs.withColumn("text_key", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(hits, "text_key", "left").drop("text_key")
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for part in common.pieces_of(batch):
                columns = part.columns[:-1]
                spans = part.column(part.num_columns - 1).to_pylist()
                if any(s is not None for s in spans):
                    texts = [t if s is None else redacted(t, s) for t, s in zip(columns[text_at].to_pylist(), spans, strict=True)]
                    columns[text_at] = pa.array(texts, columns[text_at].type)
                    if chars_at is not None:
                        old = columns[chars_at].to_pylist()
                        columns[chars_at] = pa.array([n if s is None else len(t) for n, t, s in zip(old, texts, spans, strict=True)], columns[chars_at].type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    return back(keyed.select(*docs.columns, "redact_spans").mapInArrow(common.light(run), docs.schema))


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each stretch of spans (in order of their starts) replaced by the kind of its first one."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])
