"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, secrets, encoding.

Each stage reads what the one before kept. All but the last return the columns of documents; the last returns a row of
digests per document that is left. Stages handle nulls, empty and very long texts, repeated rows and empty tables as
their operators define; rows without an id are kept and removed like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import bpe, decontaminate, quality, secrets, simhash
from rollbook.llm.frames import keep, prepare, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.learn(docs, table(prepare(spark), sf_dir, "labels", "doc_id", "quality"))
    return docs.where(quality.accepted(quality.scorer(model)(F.col("text"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return simhash.one_per_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, table(prepare(spark), sf_dir, "benchmark", "item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values masked."""
    prepare(spark)
    return secrets.redact(docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents left."""
    prepare(spark)
    # smaller slices: the workers of the stages before still hold memory
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, slice_bytes=1 << 20)
    return bpe.digests(encoded)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("byte-level bpe", to_ids),
]

# A boosted model, 64-bit XXH64 fingerprints and BPE merges are not expressible in SQL; tests hold the stages against
# plain Python versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
