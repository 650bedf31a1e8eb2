"""The corpus pipeline: quality rules, toxicity, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresail.llm import ngram_join, packing, pii, quality, queries, toxicity
from foresail.llm.common import materialize

#: Columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score this much or more are rejected.
TOXIC = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cascade; null, empty and short texts go.

    Repeated rows get the same verdict, null ids stay with their text, an empty table gives no rows.
    """
    return quality.keep_quality(docs.select(COLUMNS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC by a model of the labelled texts in sf_dir.

    Null and empty texts score as texts without toxic windows; repeated rows get the same score; null ids stay; an
    empty table gives no rows, and no labels at all let every document stay.
    """
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_rows(docs.select(COLUMNS), model, keep_below=TOXIC)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least id, and of repeated rows one.

    Null texts and texts without words are in no class but that of their own row; null ids come after all others.
    """
    return ngram_join.keep_first(docs.select(COLUMNS))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the kinds of personal data in its place; n_chars is that of the new text, null for a null text.

    Every row stays, repeated ones too; null ids stay; an empty table gives no rows.
    """
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences as their pieces: source, token ids, sequence, offset, window and step group.

    A null or empty text is the end id alone; repeated rows are packed each; null ids stay; an empty table gives none.
    """
    v = queries.vocabulary()
    return packing.pack_documents(docs, v["json"], v["ranks"], v["pattern"])


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copy_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]
#: Compression lengths, hashes of tokens and a trained field are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
