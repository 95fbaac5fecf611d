"""The registered queries of this subpackage: thin uses of its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, minhash, mixing, pii, quality, substrings, suffixes, topk, toxicity, variants, vectors, whitening
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]

#: Place of the public vocabulary that encoding uses by default.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *map(count, pii.BASE), F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all vectors of a label."""
    return vectors.near_copies(table(spark, sf_dir, "embeddings"))


@query
def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that start earlier too."""
    left = suffixes.without_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: Texts that score this much are taken for toxic.
TOXIC_FROM = 0.7


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; held-out ids never train the model."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    done = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), VOCABULARY, decoded=True)
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a transcript, its roles found again, and its canonical text."""
    turns = table(spark, sf_dir, "conversations")
    parsed = chat.parse(chat.transcripts(turns), chat.fit(turns))
    roles = F.transform("turns", lambda t: t["role"])
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(roles, ",").alias("roles"), (roles == F.col("roles")).alias("as_given"),
        F.sha2(chat.rendered(F.col("turns")).cast("binary"), 256).alias("rendered_sha256"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    rows = quality.ledger(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = ~quality.passes(F.col("failures"), "base")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & quality.passes(F.col("failures"))).alias("kept"), "failures")


@query
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the word windows that occur twice or more."""
    left = substrings.without_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents."""
    return minhash.near_copies(documents(spark, sf_dir))


@query
def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every twentieth vector, among all."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four leading components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent long word with its near words' count, form and root."""
    return variants.spelling_variants(documents(spark, sf_dir))
