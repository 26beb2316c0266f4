"""Token counts in delta-maintained rollups.

A batch of events becomes signed rows: an insert adds a document's count, a delete takes away what the document holds,
a revised count takes away the old and adds the new. Each batch leaves two folders: its signed rows by document (the
ledger, in which later batches look up what a document holds) and their sums by source, language and tokenizer version
(the delta). Totals are the sums of the deltas. A batch is committed once its delta is complete; committing it again
does nothing, and a batch that broke off is written anew, whatever it left.

So that no commit reads the whole history, every ``compact_every`` batches are summed into a base, which holds one row
for each document and tokenizer; a base counts once its list of batches is complete. The ledger is dealt into ``BUCKETS``
folders by document; a commit reads those that its documents fall into. One writer at a time is assumed.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, settle, small_batches, text_rows

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc string, source string, lang string, tokenizer string, docs long, tokens long"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
BUCKETS = 16


def batch_folder(batch: str) -> str:
    """A folder's name for any batch name: what is readable of it, then its digest."""
    return f"batch-{re.sub('[^A-Za-z0-9-]', '-', batch)[:40]}-{hashlib.sha256(batch.encode()).hexdigest()[:24]}"


class TokenRollup:
    """Rollups under one folder of the shared store. Events have the columns op ('insert', 'delete', 'revise'), doc,
    source, lang, tokenizer, tokens; nulls in source, lang and tokenizer are values of their own, null tokens count as 0,
    events without doc or with another op are ignored.

    Within a batch the order of rows doesn't matter. For each document and tokenizer first deletes apply (one without
    tokenizer takes all of the document's), then inserts, then revisions: of several inserts and of several revisions
    the largest count holds; an insert of what is there after the deletes does nothing, and so does a delete or a
    revision of what isn't."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 16):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _complete(self, kind: str, last: str = "") -> list[str]:
        """Names of the folders under ``kind`` whose part ``last`` is complete."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.folder}/{kind}")):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path(f"{self.folder}/{kind}")))
        return [n for n in names if fs.exists(path(f"{self.folder}/{kind}/{n}{last}/_SUCCESS"))]

    def _base(self) -> tuple[str | None, list[str]]:
        """The newest base and the batches in it."""
        bases = self._complete("base", "/names")
        if not bases:
            return None, []
        return bases[-1], [r.name for r in self.spark.read.schema("name string").parquet(f"{self.folder}/base/{bases[-1]}/names").collect()]

    def committed(self) -> list[str]:
        return sorted(set(self._base()[1]) | set(self._complete("delta")))

    def _read(self, kind: str, shape: str) -> DataFrame:
        base, inside = self._base()
        paths = [f"{self.folder}/{kind}/{n}" for n in self._complete("delta") if n not in set(inside)]
        paths += [f"{self.folder}/base/{base}/{kind}"] if base else []
        parts = [self.spark.read.schema(shape).parquet(p) for p in paths]
        out = parts[0] if parts else self.spark.createDataFrame([], shape)
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def held(self, buckets: list[int] | None = None) -> DataFrame:
        """What each document holds now, in some buckets or all."""
        rows = self._read("ledger", LEDGER + ", bucket int")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy("doc", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups without documents are gone."""
        return self._read("delta", DELTA).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0")

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply a batch, whatever its name; False if it was committed before."""
        name = batch_folder(batch)
        if name in self.committed():
            return False
        new = events.where("doc is not null and op in ('insert', 'delete', 'revise')").select("op", F.col("doc").cast("string").alias("doc"), *KEYS, F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
        most = F.max(F.when(F.col("op") == "insert", F.struct("tokens", "source", "lang")))
        new = settle(new.groupBy("doc", "tokenizer").agg(most.alias("put"), F.max(F.when(F.col("op") == "revise", F.col("tokens"))).alias("revised"), F.max(F.col("op") == "delete").alias("cut")), "events")
        buckets = sorted(r[0] for r in new.select(_bucket().alias("b")).distinct().collect())  # BUCKETS at most
        now = self.held(buckets).select(F.col("doc").alias("d"), F.col("tokenizer").alias("t"), F.col("source").alias("s"), F.col("lang").alias("l"), F.col("tokens").alias("k"))
        touched = new.groupBy("doc").agg(F.max(F.col("cut") & F.col("tokenizer").isNull()).alias("all_cut")).withColumnRenamed("doc", "of")
        both = now.join(touched.select("of"), F.col("d") == F.col("of"), "left_semi").join(new, (F.col("d") == F.col("doc")) & F.col("t").eqNullSafe(F.col("tokenizer")), "full_outer")
        both = both.withColumn("who", F.coalesce("doc", "d")).join(touched, F.col("who") == F.col("of"))
        was = F.col("d").isNotNull()
        stays = was & ~F.coalesce("cut", F.lit(False)) & ~F.col("all_cut")
        tokenizer = F.when(was, F.col("t")).otherwise(F.col("tokenizer"))
        row = lambda s, l, docs, tokens: F.struct(s.alias("source"), l.alias("lang"), tokenizer.alias("tokenizer"), F.lit(docs).cast("long").alias("docs"), tokens.alias("tokens"))
        before = F.when(was, row(F.col("s"), F.col("l"), -1, -F.col("k")))
        after = F.when(stays, row(F.col("s"), F.col("l"), 1, F.coalesce("revised", "k"))).when(F.col("put").isNotNull(), row(F.col("put.source"), F.col("put.lang"), 1, F.coalesce("revised", "put.tokens")))
        signed = both.select(F.col("who").alias("doc"), F.explode(F.array(before, after)).alias("r")).where("r is not null").select("doc", "r.*")
        rows = signed.groupBy("doc", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        self._write_ledger(rows, f"ledger/{name}")
        self._write_delta(self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/{name}"), f"delta/{name}")
        forget(new)
        if len(self._complete("delta")) - len(self._base()[1]) >= self.compact_every:
            self.compact()
        return True

    def _write_ledger(self, rows: DataFrame, place: str) -> None:
        rows.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{place}")

    def _write_delta(self, rows: DataFrame, place: str) -> None:
        rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.folder}/{place}")

    def compact(self) -> None:
        """Sum all batches into a new base. Interrupted, it leaves a base without list, which never counts."""
        names = self.committed()
        place = f"base/{len(self._complete('base', '/names')):08d}"
        self._write_ledger(self.held(), f"{place}/ledger")
        self._write_delta(self._read("delta", DELTA), f"{place}/delta")
        self.spark.createDataFrame([(n,) for n in names], "name string").write.mode("overwrite").parquet(f"{self.folder}/{place}/names")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc"), F.lit(BUCKETS)).cast("int")


def count_tokens(df: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens) for each row, by a byte-level BPE whose ranks lie in ``ranks_file``; null counts as empty."""
    small_batches(df.sparkSession)
    rows = text_rows(df, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(code.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], ["id", "tokens"])

    return rows.mapInArrow(run, f"id {id_type}, tokens long")
