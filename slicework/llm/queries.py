"""The queries of this subpackage, over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slicework.llm import align, bpe, decontaminate, html, langid, license, lines, pst, quality, repair, repeats, sharding, simhash
from slicework.llm.shared import table


def vocabulary() -> tuple[str, str]:
    """The installed byte-level vocabulary for many languages, and the pattern that splits text for it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op1_tag_path_ratios(table(spark, sf_dir, "pages"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.op2_suffix_tree(table(spark, sf_dir, "documents"))


def op3_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op3_hash_tree(table(spark, sf_dir, "documents"))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op4_robust_outliers(table(spark, sf_dir, "documents"))


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5_golay_simhash(table(spark, sf_dir, "documents"))


def op6_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.op6_canonical_digest(table(spark, sf_dir, "documents"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op7_language_mixture(table(spark, sf_dir, "documents"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op8_fuzzy_lines(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op9_byte_bpe(table(spark, sf_dir, "documents"), *vocabulary())


def op10_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10_latent_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op11_grammar_repair(table(spark, sf_dir, "conversations"))


def op12_lyndon_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op12_lyndon_repeats(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.op13_token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tag_path_ratios, op2_suffix_tree, op3_hash_tree, op4_robust_outliers, op5_golay_simhash, op6_canonical_digest, op7_language_mixture, op8_fuzzy_lines, op9_byte_bpe, op10_latent_leaks, op11_grammar_repair, op12_lyndon_repeats, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op3_hash_tree": sharding.oracle(), "op6_canonical_digest": license.oracle()}
