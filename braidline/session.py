"""Questions to engine results by path: graphs are kept while their file stays the same, the last four at most."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import kind
from .operators import graph, text
from .sources.files import read_engine

KEPT = 4


class LineageSession:
    """``grain`` of a question: column, table, or auto (table if the file has relations)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, OrderedDict()

    def _graph(self, path: str) -> dict[str, DataFrame]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        status = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(target)
        key = (path, status.getModificationTime(), status.getLen())
        if key not in self.held:
            for old in [k for k in self.held if k[0] == path] or list(self.held)[: max(0, len(self.held) - KEPT + 1)]:
                for df in self.held.pop(old).values():
                    df.unpersist()
            self.held[key] = {name: df.persist() for name, df in read_engine(self.spark, path).items()}
        self.held.move_to_end(key)
        return self.held[key]

    def edges(self, path: str, grain: str = "auto") -> DataFrame:
        found = self._graph(path)
        if grain == "table" or grain == "auto" and not found["relations"].isEmpty():
            return found["relations"].select(F.monotonically_increasing_id().alias("ord"), F.concat("source", F.lit(".*")).alias("source"), F.concat("target", F.lit(".*")).alias("target"), F.lit("DIRECT").alias("kind"), "file", "line")
        return found["edges"]

    def query(self, path: str, name: str, grain: str = "column", **options) -> str:
        return text.query_text(self.edges(path, grain), name if grain == "column" else f"{name}.*", **options)

    def path(self, path: str, source: str, target: str, **options) -> str:
        return text.path_text(self.edges(path, "column"), source, target, **options)

    def diagnose(self, path: str, budget: int = 1500) -> str:
        return text.diagnose_text(self._graph(path)["diagnostics"], budget)

    def explain(self, path: str, name: str, budget: int = 1500) -> str:
        """The first 20 edges into a name, the rest counted by file."""
        edges = self.edges(path, "column").where(F.upper("target") == name.upper()).orderBy("ord")
        shown = edges.limit(20).collect()
        rest = edges.join(edges.limit(20).select("ord"), "ord", "left_anti").groupBy("file").count().orderBy(F.desc("count"), "file").limit(20).collect()
        return text.cut_to_budget([f"{name.upper()}: {len(shown)} edges shown", *(f"  {r['source']} [{r['kind']}] {r['file']}:{r['line']}" for r in shown), *(f"  and {r['count']} in {r['file']}" for r in rest)], budget)

    def stats(self, path: str) -> dict[str, int]:
        found = self._graph(path)
        out = {f"kind {r['k']}": r["n"] for r in found["edges"].groupBy(kind(F.col("kind")).alias("k")).agg(F.count("*").alias("n")).collect()}
        out |= {f"code {r['code']}": r["n"] for r in found["diagnostics"].groupBy("code").agg(F.count("*").alias("n")).collect()}
        return out | {"nodes": graph.nodes(found["edges"].where("source is not null")).count()}
