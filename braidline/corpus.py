"""Generate, analyse, score: packages rendered from statement templates, with the edges that they must give.

A package is made from its number alone (a hash chooses the statements), so that any task can make any package and the
same seed gives the same bytes. Truth comes from the templates, never from the rendered text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import templates

#: Statements by difficulty: 0 plain copies, 1 joins and tests, 2 views, stars and upserts, 3 flow and recursion.
TIERS: dict[str, int] = {
    **dict.fromkeys(("insert_select_edges", "unqualified_edges", "hint_edges"), 0),
    **dict.fromkeys(("insert_join_edges", "update_edges", "delete_filters", "case_decode_edges", "exists_filters", "scalar_subquery_edges"), 1),
    **dict.fromkeys(("merge_edges", "cte_edges", "inline_view_edges", "pivot_edges", "pivot_table_edges", "unpivot_edges", "aggregate_edges", "analytic_edges", "outer_join_marker_edges", "dblink_edges", "select_into_values"), 2),
    **dict.fromkeys(("connect_by_filters", "bulk_collect_forall", "cursor_loop", "query_loop", "rowtype_field", "rowtype_shadowed", "assignment_chain", "accumulate_var", "control_flow_edges"), 3),
}


def _pick(seed: int, *what: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, *what)).encode(), digest_size=6).digest(), "little")


def package(seed: int, number: int, statements: int, most_tier: int = 3) -> tuple[str, list[tuple[str, str, str, int]]]:
    """(text, truth): truth rows are (target, source, kind, tier)."""
    names = sorted(n for n, t in TIERS.items() if t <= most_tier)
    body, truth = [], {}
    for k in range(statements):
        name = names[_pick(seed, number, k) % len(names)]
        n, r = str(number * 1000 + k), str(_pick(seed, number, k, 1) % 50)
        fill = lambda s, n=n, r=r: s.replace("{n}", n).replace("{r}", r)
        declared, run, rows = templates.FLOWS[name] if name in templates.FLOWS else ("", templates.STATEMENTS[name][0] + ";", templates.STATEMENTS[name][1])
        body.append(f"  -- {name} {n}\n  PROCEDURE P{k} IS\n    {fill(declared)}\n  BEGIN\n    {fill(run)}\n  END P{k};\n")
        truth.update({(fill(t), fill(s), kind, TIERS[name]): None for t, s, kind in rows})
    return f"PACKAGE BODY SYN.PKG{number} IS\n{''.join(body)}END PKG{number};\n/\n", list(truth)


def packages(spark: SparkSession, n: int, statements: int = 20, seed: int = 20260812, most_tier: int = 3) -> DataFrame:
    """(path, text, truth) of ``n`` packages."""
    edge = pa.struct([("target", pa.string()), ("source", pa.string()), ("kind", pa.string()), ("tier", pa.int64())])

    def run(batches):
        for batch in batches:
            made = [package(seed, k, statements, most_tier) for k in batch.column(0).to_pylist()]
            rows = [[dict(zip(("target", "source", "kind", "tier"), t, strict=True)) for t in truth] for _, truth in made]
            yield pa.RecordBatch.from_arrays([pa.array([f"packages/pkg{k:05d}.sql" for k in batch.column(0).to_pylist()]), pa.array([m[0] for m in made]), pa.array(rows, pa.list_(edge))], ["path", "text", "truth"])

    return spark.range(n).mapInArrow(run, "path string, text string, truth array<struct<target:string,source:string,kind:string,tier:long>>")


def interfaces(spark: SparkSession, n: int, seed: int = 20260812) -> DataFrame:
    """(interface, steps, truth) of ``n`` integration interfaces: truth rows are (target, source, kind, hops)."""
    edge = pa.struct([("target", pa.string()), ("source", pa.string()), ("kind", pa.string()), ("hops", pa.int64())])
    names = sorted(templates.PIPELINES)

    def one(k: int) -> tuple[str, list[dict]]:
        steps, rows = templates.PIPELINES[names[_pick(seed, k) % len(names)]]
        fill = lambda s: s.replace("{n}", str(k)).replace("{r}", str(_pick(seed, k, 1) % 40))
        return fill(steps), [{"target": fill(t), "source": fill(s) or None, "kind": kind, "hops": hops} for t, s, kind, hops in rows]

    def run(batches):
        for batch in batches:
            made = [one(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"IF{k:04d}" for k in batch.column(0).to_pylist()]), pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.list_(edge))], ["interface", "steps", "truth"])

    return spark.range(n).mapInArrow(run, "interface string, steps string, truth array<struct<target:string,source:string,kind:string,hops:long>>")


def write(made: DataFrame, folder: str) -> None:
    """Truth and manifest as JSON lines, sources as a table (path, text) from which a tree can be laid out."""
    made.select("path", "text").write.mode("overwrite").json(f"{folder}/sources")
    made.select(F.col("path").alias("file"), F.explode("truth").alias("t")).select("file", "t.*").write.mode("overwrite").json(f"{folder}/truth")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    made.select(F.col("path").alias("file"), lines.alias("lines"), F.size("truth").alias("edges"), F.array_max(F.transform("truth", lambda t: t["tier"])).alias("tier")).write.mode("overwrite").json(f"{folder}/manifest")


def write_interfaces(made: DataFrame, folder: str) -> None:
    """Interfaces' files as a table (interface, path, text) from which a tree can be laid out, their truth, and a manifest
    with what each holds."""
    from .sources.artefacts import artefacts

    artefacts(made).write.mode("overwrite").json(f"{folder}/artefacts")
    made.select("interface", F.explode("truth").alias("t")).select("interface", "t.*").write.mode("overwrite").json(f"{folder}/truth")
    files = made.sparkSession.read.schema("interface string, path string, text string").json(f"{folder}/artefacts")
    adapter = F.col("path").startswith("adpt/")
    held = files.groupBy("interface").agg(F.sort_array(F.collect_list("path")).alias("artefacts"), F.count_if(adapter).alias("adapters"), F.sum(F.octet_length("text")).alias("bytes"))
    severed = made.select("interface", F.size(F.filter("truth", lambda t: t["kind"] == "SEVERED")).alias("severed"), F.size("truth").alias("edges"))
    held.join(severed, "interface").write.mode("overwrite").json(f"{folder}/manifest")


def ceiling(made: DataFrame) -> DataFrame:
    """What an analyser that reads each statement alone could reach: (tier, reachable, blocked)."""
    rows = made.select(F.explode("truth").alias("t")).select("t.*")
    blocked = F.col("kind") == "VIA_VARIABLE"
    return rows.groupBy("tier").agg(F.count_if(~blocked).alias("reachable"), F.count_if(blocked).alias("blocked"))


def scored(made: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the analyser by tier; an edge beyond the truth counts against tier -1."""
    from .operators.analysis import analyze_sources, edge_pairs
    from .operators.score import compared, rates

    truth = made.select(F.col("path").alias("file"), F.explode("truth").alias("t")).select("file", "t.*")
    engine = edge_pairs(analyze_sources(made.select("path", "text")))
    keys = ["file", "source", "target", "kind"]
    both = compared(truth, engine, keys).join(truth.select(*keys, "tier").groupBy(keys).agg(F.max("tier").alias("tier")), keys, "left")
    return rates(both.withColumn("tier", F.coalesce("tier", F.lit(-1))), ["tier"])


def checks(made: DataFrame) -> DataFrame:
    """Self-validation from the text alone: (check_name, total, failed)."""
    truth = made.select("path", "text", F.explode("truth").alias("t"))
    column = F.substring_index("t.source", ".", -1)
    parts = [
        truth.select(F.lit("source column stands in the text").alias("check_name"), F.contains("text", column).alias("ok")),
        truth.select(F.lit("target table stands in the text").alias("check_name"), F.contains("text", F.regexp_replace("t.target", r"\.[^.]*$", "")).alias("ok")),
        made.select(F.lit("BEGIN and END balance").alias("check_name"), (F.regexp_count("text", F.lit(r"\bBEGIN\b")) <= F.regexp_count("text", F.lit(r"\bEND\b"))).alias("ok")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("check_name").agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("failed"))


def every_truth(packages_: DataFrame, interfaces_: DataFrame) -> DataFrame:
    """The truth of packages and of interfaces together: (origin, place, target, source, kind, tier, hops)."""
    a = packages_.select(F.lit("package").alias("origin"), F.col("path").alias("place"), F.explode("truth").alias("t")).select("origin", "place", "t.*")
    b = interfaces_.select(F.lit("interface").alias("origin"), F.col("interface").alias("place"), F.explode("truth").alias("t")).select("origin", "place", "t.*")
    return a.unionByName(b, allowMissingColumns=True)


def columns_beside_blobs(truth: DataFrame, adapters: DataFrame) -> DataFrame:
    """Write edges whose column their adapter doesn't write: ``truth`` (interface, adapter, column) against ``adapters``
    (interface, adapter, update_columns). Edges without column or adapter, and adapters without a list, don't count."""
    told = truth.where("adapter is not null and `column` is not null").join(adapters.where("update_columns is not null"), ["interface", "adapter"])
    return told.where(~F.array_contains("update_columns", F.col("column"))).select("interface", "adapter", "column")
