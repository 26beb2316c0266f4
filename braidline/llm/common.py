"""Plumbing that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: sha256 of nothing
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: What this Python worker keeps from task to task.
_kept: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; with a local master, the working folder's
    ``.braidline`` stands in for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.braidline"


def kept(kind: tuple, make: Callable):
    """Something that tasks of one kind share in a Python worker. Workers are reused: what tasks of another kind left is
    freed first, so that the tables of several operators never add up."""
    if kind not in _kept:
        free()
        _kept[kind] = make()
    return _kept[kind]


def free() -> None:
    """Drop what the worker keeps and give the memory back."""
    if _kept:
        _kept.clear()
        gc.unfreeze()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def give_back(spark: SparkSession) -> int:
    """Executors keep the heap and Python workers the tables that the last operator took, and the next one's come on top.
    Tasks on all cores have both freed. Gives the number of tasks; they read no data."""
    tasks = 2 * spark.sparkContext.defaultParallelism

    def run(batches):
        free()
        yield from batches

    asked = spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long").select(F.expr("reflect('java.lang.System', 'gc')").alias("done"))
    return len(asked.collect())


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/braidline/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back. A lost executor costs nothing.
    The shuffle files that led to it are of no more use; the driver is asked to notice."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._braidline_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove tables made by ``settle`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_braidline_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch holds: very long texts come side by side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(df: DataFrame, id_col: str, text_col: str, null_is_empty: bool = True) -> DataFrame:
    """Only the two columns that count, as (id, body): other columns, whatever their names, never matter."""
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")) if null_is_empty else F.col(f"`{text_col}`").cast("string")
    return df.select(F.col(f"`{id_col}`").alias("id"), body.alias("body"))


def sha_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def span_list(spans: Iterable[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end, by start, then kind as listed."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))
