"""Registered queries of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontaminate, langid, periods, quality, secrets, simhash, spans, templates, tokenfile, topk, warc
from .frames import held_out, prepare, table
from .oracles import ORACLES as ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return fn(prepare(spark), root)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_decontaminate(spark, root):
    """Benchmark items that documents hold, with the shingles found."""
    return decontaminate.contained_items(table(spark, root, "documents", "doc_id", "text"), table(spark, root, "benchmark", "item_id", "text"))


@register
def op2_quality(spark, root):
    """Quality score of every document."""
    docs = table(spark, root, "documents", "doc_id", "text")
    model = quality.learn(docs, table(spark, root, "labels", "doc_id", "quality"))
    scored = quality.scored(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", quality.accepted(F.col("score")).cast("int").alias("predicted"))


@register
def op3_token_planes(spark, root):
    """Token ids written as files of shuffled planes, read back."""
    files = tokenfile.write_ids(table(spark, root, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_ids(files)


@register
def op4_language(spark, root):
    """Language of every document."""
    docs = table(spark, root, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


@register
def op5_simhash(spark, root):
    """SimHash fingerprints and components of near-duplicates."""
    return simhash.near_duplicates(table(spark, root, "documents", "doc_id", "text"))


@register
def op6_warc(spark, root):
    """Pages written to a WARC archive, read back."""
    return warc.archive(table(spark, root, "pages", "page_id", "url", "html"))


# The rules of the query: host, start of the path, verdict.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@register
def op7_url_templates(spark, root):
    """Verdict on every page's url, by rule or by path template."""
    return templates.judge(table(spark, root, "pages", "page_id", "url"), RULES)


@register
def op8_byte_bpe(spark, root):
    """Byte-level BPE ids of every document and their round trip."""
    import public_tokenizers

    encoded = bpe.encode(table(spark, root, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(encoded)


@register
def op9_secrets(spark, root):
    """Secret spans of every document, with those that corpus-wide ownership adds."""
    return secrets.digests(secrets.find_secrets(table(spark, root, "documents", "doc_id", "text", "source")))


@register
def op10_top_k(spark, root):
    """The 20 best inner products of every twentieth vector against all."""
    return topk.top_k(table(spark, root, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20, scale=64)


@register
def op11_vector_codes(spark, root):
    """Product codes of every vector, their errors, and the errors' sum per label."""
    return codes.with_label_errors(codes.compress(table(spark, root, "embeddings", "vec_id", "embedding", "label"), "label"))


@register
def op12_periodic_runs(spark, root):
    """Periodic runs of words in every document, a tenth of which repeat a stretch of themselves."""
    return periods.digests(periods.find_runs(periods.planted(table(spark, root, "documents", "doc_id", "text"))))


@register
def op13_repeated_spans(spark, root):
    """Every document without the words of windows that occur more than once."""
    return spans.digests(spans.without_repeats(table(spark, root, "documents", "doc_id", "text")))
