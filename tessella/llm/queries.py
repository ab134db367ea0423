"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, dominance, jaccard, language, lm, ogg, packing, repeats, sharding, sql, token_counts, token_store, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_groups(table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.text_round_trip(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.sales_above(table(spark, sf_dir, "sales"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_sharding, op3_token_counts, op4_jaccard_join, op5_lm, op6_packing, op7_warc, op8_token_store, op9_ogg, op10_decontaminate, op11_divergence, op12_dominance, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": sql.JACCARD, "op10_decontaminate": sql.CONTAMINATION, "op11_divergence": sql.DIVERGENCE, "op12_dominance": sql.DOMINANCE, "op13_substring_dedup": sql.REPEATS}
