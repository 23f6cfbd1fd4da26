"""A corpus pipeline of five stages over ``documents``; each keeps rows whole or changes their texts, the last encodes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, decontam, pii, quality, simhash
from lacuna.llm.common import table, written
from lacuna.llm.queries import pattern, quality_model, tokenizer_path


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the texts as they are now; null where either is."""
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("bigint")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; fitted on labels of the stage's own input."""
    return quality.keep_good(docs, quality_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by fingerprint: that with the smallest id, then hash of its text."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; documents that are mostly such passages go."""
    return measured(decontam.clean(docs, table(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return measured(pii.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document; one whose ids do not decode to its text fails the job."""
    return bpe.encode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern()).select("doc_id", "ids")


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("pii", redact), ("tokens", encode)]

#: Classifier, fingerprints and tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
