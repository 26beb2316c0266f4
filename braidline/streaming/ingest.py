"""Incremental lineage: a folder of sources as a stream, each batch analysed and loaded into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..operators.analysis import analyze_sources, edge_pairs
from ..sources.files import decoded

SOURCES = "path string, text string"


def source_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, text) of files as they appear, in the encodings that the batch reader knows."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.sql").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return decoded(raw).select("path", "text")


def ingest(spark: SparkSession, folder: str, store_path: str, catalog: dict[str, list[str]] | None = None):
    """Start the stream. Names and variables are local to a file, so no state crosses batches; ids are hashes of
    content, so a batch that runs twice adds nothing the second time."""

    def load(batch: DataFrame, _: int) -> None:
        edges = edge_pairs(analyze_sources(batch, catalog)).persist()
        store.append(store.column_refs(edges), f"{store_path}/column_ref")
        store.append(store.evidence(edges, "stream"), f"{store_path}/evidence")
        store.append(store.assertions(edges), f"{store_path}/assertion")
        edges.unpersist()

    return source_stream(spark, folder).writeStream.foreachBatch(load).option("checkpointLocation", f"{store_path}/_progress").trigger(availableNow=True).start()


def latest(events: DataFrame) -> DataFrame:
    """The newest of a table of focus events (seq, event)."""
    return events.agg(F.max_by("event", "seq").alias("event"), F.max("seq").alias("seq"))
