"""Corpus pipeline: documents to packed training sequences.

Stages, each over all rows its predecessor kept: quality classifier, line
de-duplication, near-duplicate removal, mixing of sources, packing.  Every
stage's result is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import table
from visitlens.llm.jaccard_join import keep_one_of_each
from visitlens.llm.line_dedup import dedup_lines
from visitlens.llm.mixing import mixed_corpus
from visitlens.llm.packing import pack_documents
from visitlens.llm.quality import classify, train
from visitlens.llm.queries import QUALITY_FLOOR
from visitlens.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model, score_col="__score").where(F.col("__score") >= QUALITY_FLOOR).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the text of the lines it keeps; NULL stays NULL."""
    kept = dedup_lines(docs.withColumn("__id", F.col("doc_id")), id_col="__id")
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    out = {"text": text.alias("text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("kept_text")).cast("long").alias("n_chars")}
    return kept.select(*[out.get(c, F.col(c)) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a document once per pass that takes it."""
    return mixed_corpus(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, packed into sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Boosted trees and tokenisers are no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
