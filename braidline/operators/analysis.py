"""Lineage of texts and statements as DataFrames: one task per part of the files, no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REF = pa.struct([("table", pa.string()), ("column", pa.string())])
ROWS = pa.schema([("what", pa.string()), ("file", pa.string()), ("unit", pa.string()), ("subprogram", pa.string()), ("line", pa.int64()), ("ord", pa.int64()), ("target", pa.string()), ("column", pa.string()), ("sources", pa.list_(REF)), ("kind", pa.string()), ("transform", pa.string()), ("hops", pa.int64()), ("method", pa.string()), ("code", pa.string()), ("message", pa.string())])
SHAPE = "what string, file string, unit string, subprogram string, line long, ord long, target string, column string, sources array<struct<table:string,column:string>>, kind string, transform string, hops long, method string, code string, message string"


MOST_COLUMNS = 1_000_000


def catalog_map(catalog: DataFrame | None, files: DataFrame | None = None, most: int = MOST_COLUMNS) -> dict[str, list[str]]:
    """A catalogue of tables as the driver's dictionary, which every task gets. One of more than ``most`` columns is cut
    to the tables whose short name occurs as a word in ``files`` (text); if that is still too much, it is an error."""
    out: dict[str, list[str]] = {}
    if catalog is not None:
        if files is not None and catalog.count() > most:
            words = files.select(F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"[\w$#]+"), 0))).alias("word")).distinct()
            catalog = catalog.join(words, F.substring_index(F.upper("table"), ".", -1) == F.col("word"), "left_semi")
        if (n := catalog.count()) > most:
            raise ValueError(f"a catalogue of {n} columns is too large to send to every task")
        for r in catalog.orderBy("table", "ordinal").toLocalIterator():
            out.setdefault(r["table"], []).append(r["column"])
    return out


def analyze_sources(files: DataFrame, catalog: dict[str, list[str]] | None = None, **flags: bool) -> DataFrame:
    """Edges, relations, diagnostics and statements of each (path, text), as tagged rows."""
    shared = files.sparkSession.sparkContext.broadcast(catalog or {})

    def run(batches):
        from braidline.plans.flow import analyze_text

        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    rows = [{"what": "diagnostic", "file": path, "ord": 0, "kind": "error", "code": "DECODE_FAILED", "message": "neither UTF-8 nor CP949"}]
                else:
                    rows = analyze_text(path, text, shared.value, **flags)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ROWS)

    return files.select("path", "text").mapInArrow(run, SHAPE)


def edge_pairs(rows: DataFrame) -> DataFrame:
    """(file, line, ord, source, target, kind, hops): a row for each source of each edge."""
    edges = rows.where("what = 'edge'").select("file", "line", "ord", F.concat("target", F.lit("."), F.coalesce("column", F.lit("*"))).alias("target"), F.explode("sources").alias("s"), "kind", "hops")
    return edges.select("file", "line", "ord", F.concat("s.table", F.lit("."), F.coalesce("s.column", F.lit("*"))).alias("source"), "target", "kind", "hops")


def analyze_statements(statements: DataFrame, catalog: dict[str, list[str]] | None = None, **flags: bool) -> DataFrame:
    """Single statements (id, sql), each as a source of its own; equal texts are read once for each row."""
    wrapped = statements.select(F.col("id").cast("string").alias("path"), F.concat(F.lit("PROCEDURE p IS BEGIN "), "sql", F.lit("; END;")).alias("text"))
    return analyze_sources(wrapped, catalog, **flags)
