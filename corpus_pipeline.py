"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``braidline.llm``.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each as Parquet and reads it as the next one's
docs. All but the last give the columns of ``documents``; decisions take effect at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.llm.common import forget, give_back, settle, table
from braidline.llm.decontaminate import decontaminate
from braidline.llm.line_dedup import dedup_lines
from braidline.llm.ngram_join import ngram_join
from braidline.llm.quality import score_quality
from braidline.llm.queries import public_file
from braidline.llm.sentencepieces import encode_texts


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id isn't among ``ids``; rows without id stay."""
    return docs.join(ids.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


def _afresh(stage: Callable) -> Callable:
    """The stage, begun when the executors have given back what the one before took."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return begun


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, for low quality or toxicity, go. The workers' tables are given back when
    all is scored, as the next stage runs no Python that could."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    give_back(spark)
    return _without(docs, scored.where("rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is similar to go; n_chars follows the text."""
    changed = dedup_lines(docs.withColumn("_before", F.length("text")))
    return changed.withColumn("n_chars", F.when(F.length("text") != F.col("_before"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


@_afresh
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; links are at 0.8 over five words."""
    return _without(docs, ngram_join(docs, size=5, num=4, den=5).where("doc_id <> component_id"))


@_afresh
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


@_afresh
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded: doc_id, n_tokens and the digests of ids and decoded text."""
    return encode_texts(docs, public_file("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("line_dedup", lines), ("ngram_join", near_copies), ("decontaminate", benchmark), ("sentencepiece", tokens)]

#: A learned classifier and a tokenizer's vocabulary can't be put in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)  # a table of ours; the input is none
    return docs
