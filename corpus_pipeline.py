"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

1. language ID: documents whose text has no language (``und``: null or without a letter) go;
2. n-gram Jaccard join: one document of each group of near-duplicates stays, the one with the smallest id;
3. suffix-array dedup: bytes covered by repeated strings of 200 bytes are cut out of the text; documents of which nothing
   is left go;
4. secret scans: every secret, weak parts of linked credentials included, is replaced by its kind in brackets;
5. best-fit packing: the remaining texts become pieces of sequences of 1024 tokens.

All stages but the last return the columns of documents. An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import common, jaccard, langid, packing, repeats, secrets

#: Bytes of an Arrow batch, and units that a worker of the last stage keeps: less than in the operators alone, as by then executors have filled their heaps.
BATCH = 1 << 20
KEPT = 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.light_batches(spark, size=BATCH)
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.light_batches(spark, size=BATCH)
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.light_batches(spark, size=BATCH)
    return repeats.cut(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.light_batches(spark, size=BATCH)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.light_batches(spark, size=BATCH)
    return packing.pack(docs, kept=KEPT)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("redacted", redacted),
    ("packed", packed),
]

#: A tokenizer and a trained model stand in the way of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over ``documents``; what each returns is written and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir))
    return docs
