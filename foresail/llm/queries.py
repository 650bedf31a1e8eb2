"""The queries of this package, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, hilbert, kneser, media, ngram_join, packing, periodic, pii, quality, spelling, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> dict[str, str]:
    """Places of the public tokenizer files, and their pre-token pattern."""
    import public_tokenizers as public

    return {"json": public.path("byte_bpe_50k.json"), "ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_read(spark, sf_dir, "documents"))


def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary()
    return packing.piece_digests(packing.pack_documents(_read(spark, sf_dir, "documents"), v["json"], v["ranks"], v["pattern"]))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary()
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), v["ranks"], v["pattern"])


#: Both turns of the extra conversation say this.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], own.schema)
    return chat.read_back(chat.format_turns(chat.text_parts(own.unionByName(extra))))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(_read(spark, sf_dir, "documents"))


def op7_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(_read(spark, sf_dir, "documents"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_digests(_read(spark, sf_dir, "pages"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_hilbert(_read(spark, sf_dir, "documents"))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_table(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(_read(spark, sf_dir, "documents"))


def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.score_table(_read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_table(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_hierarchical_packing,
        op3_byte_bpe,
        op4_chat_formatting,
        op5_media_columns,
        op6_quality_rules,
        op7_crf_personal_data,
        op8_warc_derivatives,
        op9_hilbert_shards,
        op10_compression_toxicity,
        op11_periodic_runs,
        op12_kneser_ney,
        op13_spelling_variants,
    )
}
ORACLE_SQL: dict[str, str] = {"op8_warc_derivatives": warc.oracle()}
