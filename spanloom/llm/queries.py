"""The registered queries of this package and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import byte_bpe, centroids, decontamination, divergence, licences, near_duplicates, neighbours, private, quotes, repeats, sorted_tokens, toxicity, warc

HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, lexicon)
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sorted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_tokens.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))[0]


def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.report(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_hash_prefix_forest, op2_licence_scan, op3_near_duplicates, op4_warc, op5_toxicity, op6_decontamination, op7_sorted_tokens, op8_repeats, op9_byte_bpe, op10_quotes,
    op11_divergence, op12_centroids, op13_private,
)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLE_SQL = {
    "op2_licence_scan": licences.sql(),
    "op3_near_duplicates": near_duplicates.SQL,
    "op4_warc": """
with p as (select page_id, sha1(coalesce(html, '')) payload_digest, strlen(coalesce(html, ''))::bigint payload_bytes from pages),
g as (select payload_digest, max(page_id) original from p where payload_bytes >= 1000 group by 1 having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when original <> page_id then 'revisit' else 'response' end record_type, case when original <> page_id then original end refers_to
from p left join g using (payload_digest)""",
    "op10_quotes": quotes.SQL,
    "op11_divergence": divergence.SQL,
    "op12_centroids": centroids.sql(),
    "op13_private": private.sql(),
}
