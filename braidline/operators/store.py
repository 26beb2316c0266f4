"""A lineage store of three content-addressed tables: column references, evidence, assertions; loading again adds nothing.

Ids are hashes of content (names, not surrogate numbers), so that loads in any order and from many writers agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import column_of, content_id, link_of, schema_of, table_of


def column_refs(edges: DataFrame) -> DataFrame:
    """(id, schema_name, table_name, column_name, dblink): a whole table has no column name."""
    names = edges.select(F.col("source").alias("name")).unionByName(edges.select(F.col("target").alias("name"))).distinct()
    parts = names.select("name", table_of(F.col("name")).alias("t"), column_of(F.col("name")).alias("c"))
    parts = parts.select("name", schema_of(F.col("t")).alias("schema_name"), F.when(F.instr("t", ".") > 0, F.expr("substring(t, instr(t, '.') + 1)")).otherwise(F.col("t")).alias("table_name"), F.when(F.col("c") != "*", F.col("c")).alias("column_name"), link_of(F.col("t")).alias("dblink"))
    return parts.select(content_id(F.col("schema_name"), F.col("table_name"), F.col("column_name")).alias("id"), "schema_name", "table_name", "column_name", "dblink", "name")


def evidence(edges: DataFrame, revision: str) -> DataFrame:
    """(id, revision, path, body): where assertions come from."""
    rows = edges.select(F.lit(revision).alias("revision"), F.col("file").alias("path"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("body")).distinct()
    return rows.select(content_id(F.col("revision"), F.col("path"), F.col("body")).alias("id"), "revision", "path", "body")


def assertions(edges: DataFrame) -> DataFrame:
    """(id, target, sources, kind): one for each statement's edge, its sources sorted."""
    grouped = edges.groupBy("file", "line", "target", "kind").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return grouped.select(content_id(F.col("target"), F.col("sources"), F.col("kind")).alias("id"), "target", "sources", "kind").distinct()


def new_rows(incoming: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    """What a load adds: rows of new ids, each once."""
    return incoming.dropDuplicates([key]).join(present.select(key), key, "left_anti")


def append(incoming: DataFrame, path: str, key: str = "id") -> int:
    """Load into the table at ``path``; the number of rows added."""
    spark = incoming.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    fresh = new_rows(incoming, spark.read.parquet(path), key) if exists else incoming.dropDuplicates([key])
    before = spark.read.parquet(path).count() if exists else 0
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def edge_view(edges: DataFrame) -> DataFrame:
    """(from_name, to_name, kind) through the column references, schema in front even where it is empty."""
    refs = column_refs(edges)
    shown = refs.select("name", F.concat(F.col("schema_name"), F.lit("."), F.col("table_name"), F.lit("."), F.coalesce("column_name", F.lit("*"))).alias("shown"))
    out = edges.select("source", "target", "kind").distinct()
    out = out.join(shown.select(F.col("name").alias("source"), F.col("shown").alias("from_name")), "source").join(shown.select(F.col("name").alias("target"), F.col("shown").alias("to_name")), "target")
    return out.select("from_name", "to_name", "kind")


def sources_for(view: DataFrame, name: str) -> DataFrame:
    return view.where(F.col("to_name") == name).select("from_name", "kind").distinct()


def validity(history: DataFrame, key: list[str], at: str) -> DataFrame:
    """Each version with the time at which the next one takes over (null: still valid)."""
    return history.withColumn("valid_to", F.lead(at).over(Window.partitionBy(*key).orderBy(at)))
