"""A cleaning pipeline over ``documents``: each stage calls one operator of spanloom.llm on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the shared folder and
reads it again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import byte_bpe, decontamination, near_duplicates, repeats, toxicity
from spanloom.llm.workers import fresh
from spanloom.runtime import ensure_workers, table, written

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC, by a lexicon learned from the labels of the documents at hand. Null and empty
    texts have no hits and stay; repeated rows fare alike; without labels all stay."""
    ensure_workers(spark)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, hits = fresh(docs.columns, "__score"), fresh(docs.columns, "__n_hits")
    return toxicity.scored(docs, lexicon, True, (score, hits)).filter(F.col(score) < TOXIC).drop(score, hits)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Documents without words stay, and those
    without an id that are linked to none with one."""
    ensure_workers(spark)
    row = fresh(docs.columns, "__row")
    kept = near_duplicates.labelled(docs.select("doc_id", "text")).filter("kept or component_id is null").select(F.col("row_key").alias(row))
    return docs.join(kept.distinct(), near_duplicates.row_key() == F.col(row), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that also start earlier; n_chars follows the text. All rows stay,
    null, empty and wholly repeated texts too."""
    ensure_workers(spark)
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, told by id and text: one without an id goes if an item is in its own."""
    ensure_workers(spark)
    rows = docs.select(near_duplicates.row_key().alias("doc_id"), "text")
    row = fresh(docs.columns, "__row")
    leaks = decontamination.links(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct()
    return docs.join(leaks, near_duplicates.row_key() == F.col(row), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of the token ids of each document that is left; a row for each row, null texts count as empty."""
    ensure_workers(spark)
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Several stages are beyond SQL (a learned lexicon, edit distances, merges by rank); tests compare with brute force.
ORACLE_SQL = None
