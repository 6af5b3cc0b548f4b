"""The training-data pipeline: stages over ``documents``, each working on what the one before it kept.

Toxic documents go; one document of each near-duplicate group stays (the one of the smallest id); documents that leak a
benchmark item go; secrets are replaced within the texts; what is left is encoded. Rows without an id have no duplicates and
leak nothing; rows that share an id are one document. Null and empty texts are one group of copies (those with an id), long texts are read
whole, empty tables give empty results with their columns, and columns beyond those of documents, whatever their names, stay with their
rows up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import byte_bpe, decontaminate, queries, secrets, simhash, toxicity
from tablesmith.llm.components import cut, small

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, queries.toxicity_index(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = cut(simhash.near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")))
    gone = found.filter("doc_id <> component_id").select("doc_id")
    repeated = found.filter("doc_id = component_id AND rows > 1").select("doc_id")
    kept = docs.join(small(gone, gone.count()), "doc_id", "left_anti")
    if n := repeated.count():
        again = small(repeated, n)
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", *queries.bpe_digests(), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", hide_secrets),
    ("byte_bpe", encode),
]
#: The neighbour search, the mined links and the merges are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
