"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bit_sliced, decontaminate, html_text, importance, license_scan, mixing, ngram_join, sql, substring_dedup, token_codes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_codes.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), size=5, percent=75).drop("text_hash", "group_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"), window=13)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out("doc_id")))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: 85 % of the documents, by how much likelier they are among those labelled as good than among all."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return importance.resample(docs, importance.target_texts(docs, labels), share=0.85).filter("kept").drop("kept", "text_hash")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_codes": op1_token_codes,
    "op2_ngram_join": op2_ngram_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_importance": op5_importance,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_bit_sliced": op9_bit_sliced,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": sql.OP2,
    "op3_substring_dedup": sql.OP3,
    "op8_decontamination": sql.OP8,
    "op9_bit_sliced": sql.OP9,
}
