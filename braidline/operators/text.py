"""Bounded answers as text: walks, paths, diagnostics; cut to a budget by whole lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import parse_kinds
from . import graph

LETTERS_A_TOKEN = 3


def cut_to_budget(lines: list[str], budget: int, keep: int = 1) -> str:
    """Lines within ``budget`` tokens; the first ``keep`` always stay, and a cut is said."""
    room, out = budget * LETTERS_A_TOKEN, []
    for n, line in enumerate(lines):
        room -= len(line) + 1
        if room < 0 and n >= keep:
            return "\n".join([*out, f"... {len(lines) - n} lines beyond the budget of {budget}"])
        out.append(line)
    return "\n".join(out)


def _seed(edges: DataFrame, query: str) -> tuple[str | None, str]:
    known = graph.nodes(edges)
    found = graph.resolve_seeds(known, query).orderBy("key").limit(9).collect()
    if len(found) == 1:
        return found[0]["key"], ""
    if found:
        return None, f"Ambiguous: {query}\n" + "\n".join(f"  {r['key']}" for r in found[:8])
    near = [r["key"] for r in graph.candidates(known, query).collect()]
    return None, f"No match: {query}" + ("\n" + "\n".join(f"  {k}" for k in near) if near else "")


def query_text(edges: DataFrame, query: str, depth: int = 2, budget: int = 1500, kinds: str = "value", downstream: bool = False) -> str:
    """The nodes within ``depth`` of a name, with the edges walked."""
    depth, budget = max(0, min(8, depth)), max(64, min(20_000, budget))
    key, why = _seed(edges, query)
    if key is None:
        return why
    wanted = parse_kinds(kinds)
    found = graph.walk(edges, edges.sparkSession.createDataFrame([(key,)], "key string"), depth, wanted, downstream, table_seed="FILTER" in wanted)
    rows = graph.walked_edges(edges, found, depth, wanted, downstream).orderBy("ord").limit(budget).collect()
    return cut_to_budget([f"{key}: {'downstream' if downstream else 'upstream'}, depth {depth}, {len(rows)} edges", *(f"  {r['source']} -> {r['target']} [{r['kind']}]" for r in rows)], budget)


def path_text(edges: DataFrame, source: str, target: str, kinds: str = "value", most: int = 8) -> str:
    """A shortest path between two names."""
    a, why = _seed(edges, source)
    b, why_b = _seed(edges, target)
    if a is None or b is None:
        return why or why_b
    got = graph.shortest_paths(edges, a, most, parse_kinds(kinds)).where(F.col("key") == b).first()
    return f"{got['hops']} hops: {got['path']}" if got else f"No path: {a} > {b}"


def diagnose_text(diagnostics: DataFrame, budget: int = 1500) -> str:
    urgent = F.when(F.startswith("code", F.lit("DYNAMIC")) | (F.col("code") == "UNRESOLVED"), 0).when(F.col("code") == "PARSE_FAILED", 1).otherwise(2)
    rows = diagnostics.select("file", "line", "code", "message", urgent.alias("p")).distinct().orderBy("p", "file", "line", "code").limit(budget).collect()
    return cut_to_budget([f"{len(rows)} diagnostics", *(f"  {r['code']} {r['file']}:{r['line']} {r['message']}" for r in rows)], budget)


def diagnostics_beside(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """What to tell beside an answer over tables: the diagnostics of the walk's ``files`` (file) and those without file;
    for a walk without files only what may hide tables, dynamic statements and failed parses."""
    walked = files.where("file is not null and file <> ''").select("file").distinct()
    told = diagnostics.select("file", "line", "code", "message").distinct()
    hiding = told.where(F.col("code").isin("DYNAMIC_SQL", "DYNAMIC_SQL_PARTIAL", "PARSE_FAILED"))
    here = told.join(walked, "file", "left_semi").unionByName(told.where("coalesce(file, '') = ''").join(walked.limit(1).select(F.lit(1).alias("_some")), F.lit(1) == F.col("_some"), "left_semi"))
    return here.unionByName(hiding.join(walked.limit(1).select(F.lit(1).alias("_some")), F.lit(1) == F.col("_some"), "left_anti"))


def recommendations(shares: dict[str, float], codes: dict[str, int], files: int) -> list[str]:
    """What a run's figures suggest, by fixed thresholds."""
    out = []
    slow = max(shares, key=shares.get, default=None)
    if slow and shares[slow] >= 0.5:
        out.append(f"{slow} takes {shares[slow]:.0%} of the time")
    if codes.get("PARSE_FAILED", 0) > 0:
        out.append(f"{codes['PARSE_FAILED']} of {files} files can't be parsed")
    if codes.get("DYNAMIC_SQL", 0) > codes.get("DYNAMIC_SQL_PARTIAL", 0):
        out.append("dynamic statements hide tables")
    if codes.get("STAR_UNRESOLVED", 0):
        out.append("a catalogue would resolve stars")
    return out
