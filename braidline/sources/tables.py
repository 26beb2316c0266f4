"""Lineage graphs read off the driver's tables: what a scan of engine results would give, at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, source, target, kind, file, line): a cyclic column graph, an edge for each line item."""
    n = lambda c, m: F.pmod(c, F.lit(m)).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("SYN.T"), n(F.col("l_suppkey"), 40), F.lit(".C"), F.col("l_linenumber").cast("string")).alias("source"),
        F.concat(F.lit("SYN.T"), n(F.col("l_partkey"), 40), F.lit(".C"), n(F.col("l_linenumber"), 3)).alias("target"),
        F.when(F.col("l_returnflag") == "A", "DIRECT").when(F.col("l_returnflag") == "N", "TRANSFORM").otherwise("INDIRECT_FILTER").alias("kind"),
        F.concat(F.lit("f"), n(F.col("l_orderkey"), 20), F.lit(".sql")).alias("file"),
        F.pmod(F.col("l_orderkey").cast("long"), F.lit(500)).alias("line"),
    )


def key_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, source, target, kind): region -> nation -> customer and supplier, customer -> order."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda label, c: F.concat(F.lit(label + "."), F.col(c).cast("string"))
    parts = [
        t("nation").select(F.col("n_nationkey").cast("long").alias("ord"), node("REGION", "n_regionkey").alias("source"), node("NATION", "n_nationkey").alias("target")),
        t("customer").select((F.col("c_custkey").cast("long") + 10**9).alias("ord"), node("NATION", "c_nationkey").alias("source"), node("CUSTOMER", "c_custkey").alias("target")),
        t("supplier").select((F.col("s_suppkey").cast("long") + 2 * 10**9).alias("ord"), node("NATION", "s_nationkey").alias("source"), node("SUPPLIER", "s_suppkey").alias("target")),
        t("orders").select((F.col("o_orderkey").cast("long") + 3 * 10**9).alias("ord"), node("CUSTOMER", "o_custkey").alias("source"), node("ORDERS", "o_orderkey").alias("target")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("kind", F.lit("DIRECT"))


def engine_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column graph as an engine with losses and inventions would report it."""
    truth = column_graph(spark, sf_dir).withColumn("key", (F.col("ord") / 10).cast("long"))
    kept = truth.where("key % 17 <> 0")
    wrong = truth.where("key % 23 = 0").withColumn("source", F.concat("source", F.lit("X")))
    return kept.unionByName(wrong).drop("key")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, severity, code, message) from the events."""
    code = F.element_at(F.array(*[F.lit(c) for c in ("PARSE_FAILED", "DYNAMIC_SQL", "DYNAMIC_SQL_PARTIAL", "UNRESOLVED", "SQL_NOT_ANALYZED")]), (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.pmod(F.col("user_id"), F.lit(20)).cast("string"), F.lit(".sql")).alias("file"), F.pmod(F.col("event_id"), F.lit(500)).cast("long").alias("line"), F.lit("warning").alias("severity"), code.alias("code"), F.concat(F.lit("event "), F.col("event_type")).alias("message"))
