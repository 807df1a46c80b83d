"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_consensus, importance, language_id, lm_scoring, lsh_forest, mixing, ngram_join, packing, pii_surrogates, quality_ledger, sharding, spelling, spotsigs
from ._frames import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lm_scoring.held_out("doc_id", 7, 2)
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lm_scoring.held_out("doc_id", 4, 2)
    model = language_id.fit(docs, ~held)
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op5_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    base_failed = F.col("failed").bitwiseAND(F.lit(quality_ledger.BASE).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), quality_ledger.verdict().alias("kept"), "failed")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("row_key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.main_text(table(spark, sf_dir, "pages"))


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.replace(docs, count="n_entities")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_lm_scoring, op3_language_id, op4_spotsigs, op5_quality_ledger, op6_mixing, op7_packing, op8_html_consensus, op9_lsh_forest, op10_pii_surrogates, op11_spelling, op12_ngram_join, op13_importance)}
