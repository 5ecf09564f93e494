"""The registered queries opN_<name>: each operator, with production parameters, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, fill_middle, jaccard_join, language_id, licenses, mixing, quality, substring_dedup, suffix_dedup, token_counts, token_output, vector_codes
from .common import table


def tokenizer_file(name: str) -> str:
    """A public vocabulary file: in the folder MILLRACE_TOKENIZERS names, else the installed one."""
    if folder := os.environ.get("MILLRACE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_table(table(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"]), k=4, num=85, den=100)


def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents", ["doc_id", "text"]), length=50).drop("spans")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer_file("word_bpe_49k.json"), limit=2048)


def op6_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return decontaminate.contamination(documents, benchmark, window=10).drop("spans")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents", ["doc_id", "text", "source"])).drop("removed_lines")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents", ["doc_id", "text"]), length=20).drop("spans")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents", ["doc_id", "text"])))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_table(table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]), parts=4, entries=256, rounds=4)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer_file("byte_bpe_50k.tiktoken"), byte_bpe.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import pipeline

    ops = (op1_token_planes, op2_jaccard_join, op3_fair_mix, op4_suffix_dedup, op5_token_counts, op6_fm_decontaminate, op7_language, op8_licenses, op9_line_frequency, op10_substring_dedup, op11_fill_middle, op12_vector_codes, op13_byte_bpe)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Left out: operators 1, 5 and 13 (tokenizer libraries), 7 (a trained model), 8 (compression), and the pipeline, which holds 7 and 1."""
    return {
        "op2_jaccard_join": jaccard_join.SQL,
        "op3_fair_mix": mixing.SQL,
        "op4_suffix_dedup": suffix_dedup.SQL,
        "op6_fm_decontaminate": decontaminate.SQL,
        "op9_line_frequency": quality.SQL,
        "op10_substring_dedup": substring_dedup.SQL,
        "op11_fill_middle": fill_middle.SQL,
        "op12_vector_codes": vector_codes.SQL,
    }
