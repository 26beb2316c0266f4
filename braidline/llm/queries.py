"""The operators' queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table
from .decontaminate import decontaminate
from .embedding_dups import embedding_dups
from .line_dedup import line_verdicts
from .ngram_join import ngram_join
from .pii import scan_pii
from .quality import score_quality
from .secrets import scan_secrets
from .sentencepieces import encode_texts
from .token_counts import TokenRollup, count_tokens
from .warc import archive


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), public_file("piece_bpe_32k.model"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = archive(table(spark, sf_dir, "pages"))
    return places.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: provisional counts from the lengths, the tokenizer's counts as revisions, and
    deletes of those whose text a smaller id has; the first is committed again at the end, which changes nothing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", "lang", "text", "n_chars")
    name = F.lit("byte_bpe_50k").alias("tokenizer")
    rollup = TokenRollup(spark, shared_path(spark, "rollup"))
    first = docs.select(F.lit("insert").alias("op"), "doc", "source", "lang", name, F.ceil(F.coalesce("n_chars", F.lit(0)) / 4).alias("tokens"))
    rollup.commit("1-insert", first)
    counted = count_tokens(docs, public_file("byte_bpe_50k.tiktoken"), "doc", "text")
    rollup.commit("2-revise", counted.select(F.lit("revise").alias("op"), F.col("id").alias("doc"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), name, "tokens"))
    texts = docs.select("doc", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    smallest = texts.groupBy("digest").agg(F.min("doc").alias("first"))
    copies = texts.join(smallest, "digest").where("doc <> first").select("doc").distinct()
    none = F.lit(None).cast("string")
    rollup.commit("3-delete", copies.select(F.lit("delete").alias("op"), "doc", none.alias("source"), none.alias("lang"), none.alias("tokenizer"), F.lit(0).alias("tokens")))
    rollup.commit("1-insert", first)
    return rollup.totals()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_ranges", "items")


def op7_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups(table(spark, sf_dir, "embeddings"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("findings")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_sentencepiece, op4_warc, op5_token_counts, op6_decontamination, op7_embedding_dups, op8_secrets, op9_ngram_join, op10_pii)}
