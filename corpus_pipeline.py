"""From documents to training sequences: five stages, each by one operator of parchmint.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return
the columns of documents. Every stage takes an empty table, nulls in any column and texts of any length; rows that repeat a doc_id
with one text are judged alike, and each stage says what it does with null texts. The operators' docstrings say what else holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchmint.llm import classifier, lines, minhash, mixing, packing
from parchmint.llm.common import collected_garbage, stored, sweep, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the byte network predicts to be of low quality go. A null text counts as empty; an empty one has a score like any other."""
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(classifier.score_column(model)(docs["text"]) >= 0.5)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages of several lines that also occur earlier go; n_chars follows the text. Null texts stay null, with a null n_chars; empty texts and rows without doc_id stay as they are."""
    return lines.without_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near duplicates (five words, 0.8) the document with the smallest doc_id stays.

    Null and empty texts and rows without doc_id are like nothing, so they stay; rows that repeat a doc_id stay or go together.
    """
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every document as often as its source's rate and its own coin say. Null and empty texts have size 0; null sources are one source."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of at most 4096 tokens with their places in sequences. Null and empty texts are one piece of the end id; a document that the mix took twice is packed twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", repeated_lines),
    ("minhash_near_dedup", near_copies),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]

#: SQL can express neither the network nor the tokenizer; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage wrote for itself, and its input, is deleted once its result is written, and the driver's free memory given back."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        sweep(spark, docs, before)
        collected_garbage(spark)
    return docs
