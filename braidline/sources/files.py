"""Readers and writers: source trees, DDL catalogues, engine results."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF = "struct<table:string,column:string>"
LOCATION = "struct<file:string,package:string,procedure:string,line:long,layer:string,interface:string,artifact:string,step_path:string,adapter:string>"
ENGINE = f"edges array<struct<target:{REF},sources:array<{REF}>,kind:string,transform:string,hops:long,location:{LOCATION}>>, relations array<struct<source:string,target:string,operation:string,method:string,location:{LOCATION}>>, diagnostics array<struct<severity:string,code:string,message:string,location:{LOCATION}>>"


def sql_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content): packages/**/*.sql where there are such files, else every *.sql but catalog.sql."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").load(root).select("path", "content").where(~F.col("path").rlike(r"(^|/)catalog\.sql$"))
    packaged = found.where(F.col("path").rlike("/packages/"))
    return found if packaged.select("path").isEmpty() else packaged


def decoded(files: DataFrame) -> DataFrame:
    """(path, text, encoding): UTF-8, else CP949; text is null where neither reads it."""
    shape = "path string, text string, encoding string"

    def run(batches):
        for batch in batches:
            text, how = [], []
            for raw in batch.column(1).to_pylist():
                for name in ("utf-8", "cp949"):
                    try:
                        text.append((raw or b"").decode(name))
                        how.append(name)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append(None)
                    how.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(how, pa.string())], ["path", "text", "encoding"])

    return files.select("path", "content").mapInArrow(run, shape)


def catalog_columns(ddl: DataFrame, text: str = "text") -> DataFrame:
    """(table, ordinal, column) of every CREATE TABLE; constraints aren't columns, several columns may share a line."""
    one = ddl.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?is)CREATE\s+TABLE\s+[\w$#.\"]+\s*\(.*?\)\s*;"), 0)).alias("t"))
    named = one.select(F.upper(F.regexp_replace(F.regexp_extract("t", r"(?is)CREATE\s+TABLE\s+([\w$#.\"]+)", 1), '"', "")).alias("table"), F.regexp_extract("t", r"(?is)\((.*)\)\s*;", 1).alias("body"))
    parts = named.select("table", F.split(F.regexp_replace("body", r"\([^()]*\)", ""), ",").alias("p"))
    kept = parts.select("table", F.filter(F.transform("p", lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~F.upper(x).rlike("^(CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK)\\b")).alias("p"))
    return kept.select("table", F.posexplode("p").alias("ordinal", "c")).select("table", F.col("ordinal").cast("long").alias("ordinal"), F.upper(F.regexp_extract("c", r'^"?([\w$#]+)', 1)).alias("column"))


def columns_of(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """(name, ordinal, column): by the exact name without link, else by a short name of one table only."""
    short = catalog.select("table").distinct().withColumn("short", F.substring_index("table", ".", -1))
    unique = short.groupBy("short").agg(F.count("*").alias("n"), F.min("table").alias("by_short")).where("n = 1")
    wanted = names.select("name", F.upper(F.substring_index("name", "@", 1)).alias("full")).withColumn("short", F.substring_index("full", ".", -1))
    exact = catalog.select(F.col("table").alias("full"), F.lit(1).alias("has")).distinct()
    told = wanted.join(exact, "full", "left").join(unique, "short", "left").select("name", F.when(F.col("has") == 1, F.col("full")).otherwise(F.col("by_short")).alias("table"))
    return told.join(catalog, "table").select("name", "ordinal", "column")


def read_engine(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """edges, relations and diagnostics of engine JSON; a file without edges isn't one. Malformed items are skipped."""
    raw = spark.read.schema(ENGINE).json(path, multiLine=True)
    if raw.where("edges is not null").isEmpty():
        raise ValueError(f"{path} holds no edges")
    numbered = raw.select(F.posexplode("edges").alias("ord", "e")).where("e.target.table is not null")
    edges = numbered.select(F.col("ord").cast("long").alias("ord"), "e.*").select("ord", F.concat("target.table", F.lit("."), F.coalesce("target.column", F.lit("*"))).alias("target"), F.explode_outer("sources").alias("s"), "kind", "transform", "hops", "location.file", "location.line")
    edges = edges.select("ord", F.concat("s.table", F.lit("."), F.coalesce("s.column", F.lit("*"))).alias("source"), "target", "kind", "transform", "hops", "file", "line")
    relations = raw.select(F.inline("relations")).select("source", "target", F.coalesce("operation", F.lit("WRITE")).alias("operation"), F.coalesce("method", F.lit("static")).alias("method"), "location.file", "location.line")
    return {"edges": edges, "relations": relations, "diagnostics": raw.select(F.inline("diagnostics")).select("severity", "code", "message", "location.file", "location.line")}


def engine_rows(rows: DataFrame, what: str) -> DataFrame:
    """Rows of an analysis in the shape of engine JSON."""
    place = F.struct("file", F.col("unit").alias("package"), F.col("subprogram").alias("procedure"), F.col("line").cast("long").alias("line"))
    some = rows.where(F.col("what") == what).orderBy("file", "ord")
    if what == "edge":
        return some.select(F.struct(F.col("target").alias("table"), F.col("column")).alias("target"), "sources", "kind", "transform", F.col("hops").cast("long").alias("hops"), place.alias("location"))
    if what == "relation":
        return some.select(F.col("sources")[0]["table"].alias("source"), "target", F.col("kind").alias("operation"), "method", place.alias("location"))
    return some.select(F.col("kind").alias("severity"), "code", "message", place.alias("location"))


def write_engine(rows: DataFrame, path: str) -> None:
    """The contract's single JSON file, written by the driver (a report of bounded size, row by row)."""
    with open(path, "w", encoding="utf-8") as f:
        for n, (key, what) in enumerate((("edges", "edge"), ("relations", "relation"), ("diagnostics", "diagnostic"))):
            f.write("{" if n == 0 else ",\n")
            f.write(f'"{key}": [')
            for k, r in enumerate(engine_rows(rows, what).toJSON().toLocalIterator()):
                f.write((",\n" if k else "\n") + json.dumps(json.loads(r), ensure_ascii=False))
            f.write("]")
        f.write("}\n")


def chain_sample(spark: SparkSession, n: int) -> DataFrame:
    """n tables in a chain."""
    return spark.range(n - 1).select(F.col("id").alias("ord"), F.format_string("SYN.T%05d.C", "id").alias("source"), F.format_string("SYN.T%05d.C", F.col("id") + 1).alias("target"), F.lit("DIRECT").alias("kind"))
