"""A training corpus out of raw documents, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm import bpe, minhash, mixing, pii, toxicity
from traitloom.llm.common import col
from traitloom.llm.queries import TOXIC_FROM, VOCABULARY, table
from traitloom.session import scratch

#: Similarity in percent from which texts count as copies here.
SIMILAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the limit of toxicity; the columns stay as they are."""
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(scored.columns[-1]) < TOXIC_FROM).select(*map(col, docs.columns))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Documents without words, or without id, stay.  Rows that repeat as a whole
    stay together, as they are one document.
    """
    copies = minhash.near_copies(docs, SIMILAR).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*map(col, docs.columns))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with as many words, as the mix takes."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and the text they decode to."""
    return bpe.encode(docs, VOCABULARY, decoded=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic), ("near_copies", distinct_texts), ("personal_data", redacted), ("mixing", mixed), ("encoding", encoded)]

#: No SQL form: the stages hold trained models, a tokenizer and seeded draws.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
