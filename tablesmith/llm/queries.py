"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import align, byte_bpe, decontaminate, hnsw, language_id, license_scan, license_sql, lm_score, phrase_sql, phrases, secrets, simhash, token_files, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(k: int) -> Column:
    """crc32 of the doc_id as text, mod ``k``."""
    return F.crc32(F.col("doc_id").cast("string")) % k


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *count, F.sha2(secrets.join_spans(of(*secrets.BASE)), 256).alias("base_sha256"), secrets.join_spans(F.col("spans")).alias("spans"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(table(spark, sf_dir, "documents"), fold(7) != 2)
    return out.select("doc_id", F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    out = url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), bad, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def toxicity_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Index:
    return toxicity.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_index(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "neighbours", "terms")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, fold(3) != 1)
    out = language_id.identify(docs, model)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def bpe_digests() -> list[Column]:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", *bpe_digests())


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write(table(spark, sf_dir, "documents"), token_files.new_folder(spark), public_tokenizers.path("byte_bpe_50k.json")).digests()


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_lm_score, op3_license_scan, op4_simhash_near_dedup, op5_url_filter, op6_toxicity, op7_embedding_near_dedup, op8_language_id, op9_decontamination, op10_byte_bpe, op11_tokenizer_alignment, op12_token_files, op13_phrase_mining)}
ORACLE_SQL = {"op3_license_scan": license_sql.sql(), "op13_phrase_mining": phrase_sql.SQL}
