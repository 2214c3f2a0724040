"""The queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm import chat, decontam, html_extract, licenses, line_dedup, near_dup, packing, periodic, quality, ranked_search, token_output, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """Path of the public tokenizer file that the packing queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), word_bpe())


def op4_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.summary(token_output.packed_sequences(table(spark, sf_dir, "documents"), word_bpe()))


def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


def op11_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


def op13_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.kept_digests(docs, line_dedup.keep_bitmaps(docs))


QUERIES = {
    "op1_divergence_rules": op1_divergence_rules,
    "op2_cgk_decontamination": op2_cgk_decontamination,
    "op3_best_two_fit": op3_best_two_fit,
    "op4_block_rules": op4_block_rules,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_toxic_segments": op6_toxic_segments,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_patience_licenses": op8_patience_licenses,
    "op9_packed_matrices": op9_packed_matrices,
    "op10_prefix_targets": op10_prefix_targets,
    "op11_limited_accumulators": op11_limited_accumulators,
    "op12_dyadic_runs": op12_dyadic_runs,
    "op13_line_bitmaps": op13_line_bitmaps,
}

ORACLE: dict[str, str] = {
    "op1_divergence_rules": quality.oracle_sql(),
    "op11_limited_accumulators": ranked_search.ORACLE_SQL,
    "op13_line_bitmaps": line_dedup.ORACLE_SQL,
}
