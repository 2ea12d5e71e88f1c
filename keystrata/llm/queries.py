"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, near_dups, packing, pii, secrets, substring_dups, token_counts, topk, warc
from .common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer_path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language_id.fit(language_id.training_rows(docs))
    return language_id.predict(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), prototypes)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def op4_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dups.remove_repeats(table(spark, sf_dir, "documents")).drop("intervals")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def repository():
    """The tables have no repository: a source's documents in one language stand for it."""
    return F.concat("source", F.lit("/"), "lang")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return secrets.scan(docs, repository=repository()).drop("source", "lang")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.report(warc.layout(pages), warc.layout(warc.drilled(pages)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs, pii.fit(docs))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_minhash_near_dups": op4_minhash_near_dups,
    "op5_secret_scans": op5_secret_scans,
    "op6_pii": op6_pii,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_exact_topk": op8_exact_topk,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLES: dict[str, str] = {
    "op4_minhash_near_dups": near_dups.ORACLE_SQL,
    "op9_substring_dedup": substring_dups.ORACLE_SQL,
    "op7_warc_fixity": warc.ORACLE_SQL,
    "op8_exact_topk": topk.ORACLE_SQL,
    "op5_secret_scans": secrets.ORACLE_SQL,
    "op10_benchmark_decontamination": decontamination.ORACLE_SQL,
}
