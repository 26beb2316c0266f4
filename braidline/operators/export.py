"""The viewer's form of a graph: typed objects and relationships, in a fixed order; and the way back, with warnings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import kind, object_id, place, schema_of, table_of, viewer_type

#: Fixed value: the order of object types.
TYPES = ("schema", "table", "column", "program", "dynamic")


def objects(edges: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(id, type, name, parent). Sources that are unknown stand as one dynamic object for each statement."""
    known = edges.where("source is not null")
    names = known.select(F.col("source").alias("name")).unionByName(edges.select(F.col("target").alias("name"))).distinct()
    t = table_of(F.col("name"))
    column = names.where("not endswith(name, '.*')").select(object_id(F.col("name")).alias("id"), F.lit("column").alias("type"), "name", object_id(t).alias("parent"))
    tables = names.select(t.alias("name"))
    if relations is not None:
        tables = tables.unionByName(relations.select(F.col("source").alias("name"))).unionByName(relations.select(F.col("target").alias("name")))
    tables = tables.distinct().select(object_id(F.col("name")).alias("id"), F.lit("table").alias("type"), "name", object_id(schema_of(F.col("name"))).alias("parent"))
    schemas = tables.select(schema_of(F.col("name")).alias("name")).where("name <> ''").distinct().select(object_id(F.col("name")).alias("id"), F.lit("schema").alias("type"), "name", F.lit(None).cast("string").alias("parent"))
    out = schemas.unionByName(tables).unionByName(column)
    if {"unit", "subprogram"} <= set(edges.columns):
        program = F.concat_ws(".", "unit", "subprogram")
        out = out.unionByName(edges.select(object_id(program).alias("id"), F.lit("program").alias("type"), program.alias("name"), F.lower("unit").alias("parent")).where("id <> ''"))
    unknown = edges.where("source is null").select(F.concat(F.lit("dynamic:"), F.lower("file"), F.lit(":"), F.col("line").cast("string")).alias("id"))
    out = out.unionByName(unknown.select("id", F.lit("dynamic").alias("type"), F.col("id").alias("name"), F.lit(None).cast("string").alias("parent")))
    return out.groupBy("id", "type").agg(F.min("name").alias("name"), F.min("parent").alias("parent"))


def relationships(edges: DataFrame) -> DataFrame:
    """(type, source, target, kind, places): one for each type, pair and kind."""
    where = place(F.col("file"), F.col("line"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    source = F.coalesce(object_id(F.col("source")), F.concat(F.lit("dynamic:"), F.lower("file"), F.lit(":"), F.col("line").cast("string")))
    rows = edges.select(viewer_type(F.col("kind")).alias("type"), source.alias("source"), object_id(F.col("target")).alias("target"), kind(F.col("kind")).alias("kind"), where.alias("place"))
    return rows.groupBy("type", "source", "target", "kind").agg(F.array_sort(F.collect_set("place")).alias("places"))


def write_viewer(edges: DataFrame, path: str, relations: DataFrame | None = None) -> None:
    """One JSON file, written row by row by the driver."""
    rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    parts = {"objects": objects(edges, relations).orderBy(rank, "id"), "relationships": relationships(edges).orderBy("type", "source", "target", "kind")}
    with open(path, "w", encoding="utf-8") as f:
        for n, (key, rows) in enumerate(parts.items()):
            f.write(("{" if n == 0 else ",\n") + f'"{key}": [')
            for k, r in enumerate(rows.toJSON().toLocalIterator()):
                f.write((",\n" if k else "\n") + json.dumps(json.loads(r), ensure_ascii=False, sort_keys=True))
            f.write("]")
        f.write("}\n")


def read_viewer(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, edges and warnings: relationships whose ends aren't objects are left out and named."""
    raw = spark.read.schema("objects array<struct<id:string,type:string,name:string,parent:string>>, relationships array<struct<type:string,source:string,target:string,kind:string,places:array<string>>>").json(path, multiLine=True)
    nodes = raw.select(F.inline("objects")).where("id is not null").dropDuplicates(["id"])
    edges = raw.select(F.posexplode("relationships").alias("ord", "r")).select("ord", "r.*")
    ids = nodes.select(F.col("id").alias("known"))
    whole = edges.join(ids, F.col("source") == F.col("known"), "left_semi").join(ids, F.col("target") == F.col("known"), "left_semi")
    lost = edges.join(whole.select("ord"), "ord", "left_anti").select(F.concat(F.lit("no such object: "), F.coalesce("source", F.lit("?")), F.lit(" -> "), F.coalesce("target", F.lit("?"))).alias("warning"))
    return {"nodes": nodes, "edges": whole, "warnings": lost}
