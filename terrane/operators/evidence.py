"""Sections of texts, chunks that keep their place, and checks of what was extracted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sections(docs: DataFrame, heading: str, name: str) -> DataFrame:
    """doc_id, section (its number), name, start (code points), text: a text is cut before each line that begins with ``heading``; what stands before the first is a section as well. ``name``: the pattern
    at a section's beginning that names it ('' if it does not match). Sections joined are the text; null and empty texts have none."""
    rows = docs.where("length(text) > 0").select("doc_id", F.split("text", f"(?dm)(?=^(?:{heading}))").alias("parts"))
    sizes = F.transform("parts", F.length)
    # Where each part starts: the sizes so far, in one walk over them.
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    parts = rows.select("doc_id", F.posexplode(F.arrays_zip(F.slice(starts, 1, F.size("parts")).alias("start"), F.col("parts").alias("text"))).alias("section", "p"))
    return parts.where("length(p.text) > 0").select("doc_id", F.col("section").cast("long").alias("section"), F.regexp_extract("p.text", f"^(?:{name})", 0).alias("name"), F.col("p.start").cast("long").alias("start"), "p.text")


def section_chunks(found: DataFrame, size: int = 8000) -> DataFrame:
    """doc_id, section, name, chunk, start, text: each section in stretches of at most ``size`` characters, with the place of each in the whole text."""
    n = F.ceil(F.length("text") / size)
    parts = found.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    text = F.substring("text", (F.col("chunk") * size + 1).cast("int"), F.lit(size))
    return parts.select("doc_id", "section", "name", "chunk", (F.col("start") + F.col("chunk") * size).alias("start"), text.alias("text"))


def checked(extracted: DataFrame, chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """``extracted`` (doc_id, section, chunk, feature, value, confidence, evidence) with name (of the section), start and end of the evidence in the whole text, and reason, null if all is well.

    Reasons, the first that holds: no chunk, unknown feature, value (missing or outside the feature's range), confidence (missing or outside 0 to 1), evidence (missing, empty or not
    word for word in the chunk). ``ranges``: feature, low, high, one row each."""
    key = ["doc_id", "section", "chunk"]
    rows = extracted.join(chunks.select(*key, "name", F.col("start").alias("_start"), F.col("text").alias("_text")), key, "left").join(ranges, "feature", "left")
    at = F.instr("_text", F.col("evidence"))
    within = lambda c, low, high: F.coalesce(F.col(c).between(low, high), F.lit(False))
    reason = (
        F.when(F.col("_text").isNull(), "no chunk").when(F.col("low").isNull(), "unknown feature").when(~within("value", F.col("low"), F.col("high")), "value")
        .when(~within("confidence", F.lit(0.0), F.lit(1.0)), "confidence").when(F.coalesce(F.length("evidence"), F.lit(0)) == 0, "evidence").when(at == 0, "evidence")
    )
    start = F.when(reason.isNull(), F.col("_start") + at - 1)
    return rows.select(*extracted.columns, "name", start.alias("start"), (start + F.length("evidence")).alias("end"), reason.alias("reason"))
