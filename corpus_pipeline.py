"""A corpus pipeline of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import bpe, decontaminate, pii, simhash, toxicity
from vicinal.llm.queries import PATTERN, RANKS, remainder
from vicinal.sources import scratch_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic."""
    docs = docs.select(*COLUMNS)
    learn = table(spark, sf_dir, "labels").filter(remainder(3) != 1)
    return toxicity.keep_clean(docs, toxicity.fit(docs, learn))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of near duplicates."""
    return simhash.keep_one(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the names of their kinds."""
    found = pii.find(docs, keep=("lang", "source")).withColumn("clean", pii.redacted())
    return found.select("doc_id", F.col("clean").alias("text"), F.col("kept_lang").alias("lang"), F.col("kept_source").alias("source"), F.length("clean").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return bpe.round_trip(docs, RANKS, PATTERN).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("byte_bpe", encode),
]
#: The stages are learned models, fingerprints and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
