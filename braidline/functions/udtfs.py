"""Table functions for SQL: lineage_edges(text) and lineage_statements(text)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="line int, target string, source string, kind string, hops int")
class LineageEdges:
    """The edges of a source text or of one statement, a row for each source."""

    def eval(self, text: str):
        from braidline.plans.flow import analyze_text

        if text is None:
            return
        whole = text if text.lstrip().upper().startswith(("CREATE", "PACKAGE", "PROCEDURE", "FUNCTION", "TRIGGER")) else f"PROCEDURE p IS BEGIN {text.rstrip().rstrip(';')}; END;"
        for r in analyze_text("", whole, {}):
            for s in r["sources"] or [] if r["what"] == "edge" else []:
                yield r["line"], f"{r['target']}.{r['column'] or '*'}", f"{s['table']}.{s['column'] or '*'}", r["kind"], r["hops"]


@udtf(returnType="unit string, subprogram string, line int, kind string, sql string")
class LineageStatements:
    """The statements of a source text."""

    def eval(self, text: str):
        from braidline.plans.flow import analyze_text

        for r in analyze_text("", text, {}) if text is not None else []:
            if r["what"] == "statement":
                yield r["unit"], r["subprogram"], r["line"], r["kind"], r["transform"]


@udtf(returnType="key string, depth int")
class LineageWalk:
    """The nodes within ``depth`` hops upstream of ``seed`` in a table of edges (source, target) given as TABLE WITH
    SINGLE PARTITION; with PARTITION BY a walk in each part. The part's edges come together: for large graphs there is
    ``operators.graph.walk``."""

    def __init__(self):
        self.before: dict[str, list[str]] = {}
        self.seed, self.depth = None, 0

    def eval(self, row, seed: str, depth: int):
        self.seed, self.depth = seed, depth
        if row["source"] is not None and row["target"] is not None:
            self.before.setdefault(row["target"].upper(), []).append(row["source"].upper())

    def terminate(self):
        front = [self.seed.upper()] if self.seed else []
        seen = set(front)
        for level in range((self.depth or 0) + 1):
            for key in front:
                yield key, level
            front = list(dict.fromkeys(s for key in front for s in self.before.get(key, ()) if s not in seen))
            seen.update(front)


def register(spark: SparkSession) -> None:
    spark.udtf.register("lineage_walk", LineageWalk)
    spark.udtf.register("lineage_edges", LineageEdges)
    spark.udtf.register("lineage_statements", LineageStatements)
