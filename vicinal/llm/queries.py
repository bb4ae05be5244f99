"""Registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import bpe, cas, decontaminate, language, pii, scoring, simhash, spotsigs, toxicity, warc
from vicinal.sources import scratch_path, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
VOCABULARY = 50_256  # ids of the rank file; the next stands for the beginning of a text
WORD_TOKENIZER, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2


def remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Target: documents rated of good quality; background: all documents."""
    good = table(spark, folder, "labels").filter("quality = 1")
    return scoring.score(table(spark, folder, "documents"), good, RANKS, PATTERN, VOCABULARY)


def op2_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    found = spotsigs.compare_edited(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, folder, "documents"), RANKS, PATTERN))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.summary(pii.find(table(spark, folder, "documents")))


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.FactorizationMachine:
    learn = table(spark, folder, "labels").filter(remainder(3) != 1)
    return toxicity.fit(table(spark, folder, "documents"), learn)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.score(table(spark, folder, "documents"), toxicity_model(spark, folder))
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.fit(docs.filter(remainder(4) != 2)))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "store")
    cas.write(table(spark, folder, "documents"), path, WORD_TOKENIZER, END_ID)
    return cas.read(spark, path)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, folder, "pages"), path)
    found = warc.read_pages(spark, path)
    return found.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_spotsigs, op3_decontamination, op4_simhash, op5_byte_bpe, op6_pii, op7_toxicity, op8_language, op9_token_store, op10_warc)}


#: Twenty bits of the digest at a time give four letters of base32.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h),
s AS (SELECT h, first, list_transform(range(8), lambda g: ('0x' || substr(h, 5 * g::INT + 1, 5))::INT) AS v FROM f),
b AS (
  SELECT h, first, array_to_string(list_transform(v, lambda x:
    substr(a, (x >> 15) + 1, 1) || substr(a, ((x >> 10) & 31) + 1, 1) || substr(a, ((x >> 5) & 31) + 1, 1) || substr(a, (x & 31) + 1, 1)), '') AS payload_digest
  FROM s, (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a)
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN b USING (h)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for those of the queries that it can express: models, walks, XXH64 and tokenizers are beyond it."""
    return {"op10_warc": WARC_SQL}
