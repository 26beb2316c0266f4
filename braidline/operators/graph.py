"""Questions over a lineage graph held as a table of edges (source, target, kind, ord): seeds, walks, paths, chains.

Walks go level by level; a level is one equi-join of the new nodes with the edges and one anti-join with what was seen,
so that cycles end. Each level of an unbounded walk is cut with ``checkpoint`` where the session has a checkpoint
folder, so plans stay short and a lost executor repeats one level only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import kind, kind_allowed, table_of


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; without one (on one machine) the plan goes on as it is."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def nodes(edges: DataFrame) -> DataFrame:
    """(key, display): upper-cased names with the spelling seen first."""
    both = edges.select("ord", F.col("source").alias("name")).unionByName(edges.select("ord", F.col("target").alias("name")))
    return both.groupBy(F.upper("name").alias("key")).agg(F.min_by("name", F.struct("ord", "name")).alias("display"))


def resolve_seeds(known: DataFrame, query: str) -> DataFrame:
    """(key, how): the exact name if there is one, else all names that end in it; more than one is ambiguous."""
    up = query.upper()
    found = known.where((F.col("key") == up) | F.endswith("key", F.lit("." + up))).withColumn("exact", F.col("key") == up)
    counted = found.crossJoin(F.broadcast(found.agg(F.max("exact").alias("any_exact"), F.count("*").alias("n"))))
    kept = counted.where(~F.col("any_exact") | F.col("exact"))
    return kept.select("key", F.when(F.col("any_exact"), "exact").when(F.col("n") == 1, "suffix").otherwise("ambiguous").alias("how"))


def candidates(known: DataFrame, query: str, most: int = 8) -> DataFrame:
    """(key, score): suggestions; 0 for the last part or an ending, 1 for a beginning or any part."""
    up = query.upper()
    key = F.col("key")
    score = F.when((F.substring_index(key, ".", -1) == up) | F.endswith(key, F.lit(up)), 0).when(F.contains(key, F.lit(up)), 1)
    return known.select("key", score.cast("long").alias("score")).where("score is not null").orderBy("score", "key").limit(most)


def _turned(edges: DataFrame, downstream: bool) -> DataFrame:
    a, b = ("source", "target") if downstream else ("target", "source")
    return edges.select(F.upper(a).alias("here"), F.upper(b).alias("there"), "kind")


def walk(edges: DataFrame, seeds: DataFrame, depth: int, kinds: set[str], downstream: bool = False, table_seed: bool = False) -> DataFrame:
    """(key, depth): nodes within ``depth`` hops of ``seeds`` (key). With ``table_seed`` the seeds' whole tables count
    as seeds, too, as filters point at them. At a seed, unresolved and severed edges count whatever ``kinds`` says."""
    start = seeds.select("key")
    if table_seed:
        start = start.unionByName(start.select(F.concat(table_of(F.col("key")), F.lit(".*")).alias("key")))
    seen = start.distinct().withColumn("depth", F.lit(0).cast("long"))
    front, steps = seen, _turned(edges, downstream)
    for level in range(1, depth + 1):
        usable = kind_allowed(F.col("kind"), kinds, F.lit(level == 1))
        reached = front.join(steps.where(usable), F.col("key") == F.col("here")).select(F.col("there").alias("key")).distinct()
        front = reached.join(seen, "key", "left_anti").withColumn("depth", F.lit(level).cast("long"))
        if depth > 3:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen


def walked_edges(edges: DataFrame, found: DataFrame, depth: int, kinds: set[str], downstream: bool = False) -> DataFrame:
    """The edges a walk went along, each identity once with its smallest ord."""
    end = "source" if downstream else "target"
    inner = edges.join(found.where(F.col("depth") < depth).select(F.col("key").alias("k"), "depth"), F.upper(end) == F.col("k"))
    inner = inner.where(kind_allowed(F.col("kind"), kinds, F.col("depth") == 0))
    return inner.groupBy("source", "target", "kind").agg(F.min("ord").alias("ord"))


def reachable(edges: DataFrame, seeds: DataFrame, kinds: set[str], downstream: bool = True) -> DataFrame:
    """All (key) that edges of these kinds lead to, seeds included."""
    steps = _turned(edges.where(kind(F.col("kind")).isin(*sorted(kinds))), downstream).select("here", "there").distinct()
    seen = cut(seeds.select("key").distinct())
    front = seen
    while True:
        front = cut(front.join(steps, F.col("key") == F.col("here")).select(F.col("there").alias("key")).distinct().join(seen, "key", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def shortest_paths(edges: DataFrame, source: str, most: int, kinds: set[str]) -> DataFrame:
    """(key, hops, path): for each node within ``most`` hops a shortest directed path, of equals the first by name."""
    steps = _turned(edges.where(kind(F.col("kind")).isin(*sorted(kinds))), True).select("here", "there").distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(source.upper(), 0, source.upper())], "key string, hops long, path string")
    front = seen
    for hop in range(1, most + 1):
        reached = front.join(steps, F.col("key") == F.col("here")).select(F.col("there").alias("key"), F.concat_ws(" > ", "path", "there").alias("path"))
        front = reached.groupBy("key").agg(F.min("path").alias("path")).join(seen, "key", "left_anti").select("key", F.lit(hop).cast("long").alias("hops"), "path")
        if most > 3:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen


def simple_paths(edges: DataFrame, starts: Column, most: int, ends: Column | None = None) -> DataFrame:
    """(head, tail, hops, path): all paths without a repeated node, of ``most`` hops or fewer, from nodes where
    ``starts`` holds (a condition on ``source``)."""
    steps = edges.select(F.col("source"), F.col("target")).distinct()
    now = steps.where(starts).where("source <> target").select(F.col("source").alias("head"), F.col("target").alias("tail"), F.array("source", "target").alias("path"))
    every = now
    for hop in range(1, most):
        if hop > 2:
            now = cut(now)
            if now.isEmpty():
                break
        now = now.join(steps, F.col("tail") == F.col("source")).where(~F.array_contains("path", F.col("target"))).select("head", F.col("target").alias("tail"), F.concat("path", F.array("target")).alias("path"))
        every = every.unionByName(now)
    out = every.select("head", "tail", (F.size("path") - 1).cast("long").alias("hops"), F.array_join("path", ">").alias("path"))
    return out.where(ends) if ends is not None else out


def top_chains(edges: DataFrame, most: int, shown: int = 5) -> DataFrame:
    """(head, tail, hops, path): the ``shown`` longest simple paths of ``most`` hops at most; of those between two nodes
    with equal length the last by name, and so in order."""
    every = simple_paths(edges, F.lit(True), most)
    once = every.groupBy("head", "tail", "hops").agg(F.max("path").alias("path"))
    return once.orderBy(F.desc("hops"), F.desc("path")).limit(shown)


def traverse(edges: DataFrame, start: str, downstream: bool = False, max_depth: int = 12, max_nodes: int = 2000, max_edges: int = 5000) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes (key, depth), edges (ord, source, target, kind), truncated): a walk in breadth-first order within bounds,
    edges of a node by their ord. Each level is one join; the driver holds no more than the bounds allow."""
    spark, first = edges.sparkSession, start.upper()
    here, there = ("source", "target") if downstream else ("target", "source")
    named = edges.select("ord", "source", "target", "kind", F.upper(here).alias("here"), F.upper(there).alias("there"))
    depth: dict[str, int] = {}
    rows, truncated = [], False
    if not named.where((F.col("here") == first) | (F.col("there") == first)).isEmpty():
        depth[first] = 0
    front, level = list(depth), 0
    while front:
        at = spark.createDataFrame(list(enumerate(front)), "place long, here string")
        step = named.join(F.broadcast(at), "here").orderBy("place", "ord")
        if level == max_depth:
            truncated |= not step.isEmpty()
            break
        front, level = [], level + 1
        got = step.limit(max_edges - len(rows) + 1 + max_nodes).collect()
        for r in got:
            if len(rows) >= max_edges:
                truncated = True
                break
            if r.there not in depth:
                if len(depth) >= max_nodes:
                    truncated = True
                    continue
                depth[r.there] = level
                front.append(r.there)
            rows.append((r.ord, r.source, r.target, r.kind))
        truncated |= len(rows) < max_edges and len(got) == max_edges - len(rows) + 1 + max_nodes
    kept = spark.createDataFrame(rows, "ord long, source string, target string, kind string")
    return spark.createDataFrame(list(depth.items()), "key string, depth long"), kept, truncated


def levels(edges: DataFrame, starts: Column) -> DataFrame:
    """(level, n): on how many ways each level is reached from the nodes where ``starts`` holds (a condition on
    ``source``), which are level 1. Only nodes with edges of their own are walked, each once with the number of ways to it. A cycle
    is an error, as there are ways of any length."""
    steps = edges.select("source", "target")
    out = cut(steps.groupBy("source").agg(F.count("*").alias("out")))
    inner = cut(steps.join(out.select(F.col("source").alias("target")), "target", "left_semi"))
    front = cut(out.where(starts).select(F.col("source").alias("name"), F.lit(1).cast("long").alias("ways")))
    found: list[tuple[int, int]] = []
    n, most = front.count(), out.count() + 1
    while n:
        found.append((len(found) + 1, n))
        if len(found) > most:
            raise ValueError("the edges hold a cycle")
        n = front.join(out, F.col("name") == F.col("source")).agg(F.sum(F.col("ways") * F.col("out"))).first()[0]
        front = cut(front.join(inner, F.col("name") == F.col("source")).groupBy(F.col("target").alias("name")).agg(F.sum("ways").alias("ways")))
    return edges.sparkSession.createDataFrame(found, "level long, n long")


def direct_datasets(edges: DataFrame, dataset: str) -> DataFrame:
    """(dataset, side): the tables right before (up) and behind (down) a table."""
    rolled = edges.select(table_of(F.col("source")).alias("s"), table_of(F.col("target")).alias("t")).where("s <> t")
    up = rolled.where(F.upper("t") == dataset.upper()).select(F.col("s").alias("dataset"), F.lit("up").alias("side"))
    return up.unionByName(rolled.where(F.upper("s") == dataset.upper()).select(F.col("t").alias("dataset"), F.lit("down").alias("side"))).distinct()


def longest_chains(edges: DataFrame, most: int) -> DataFrame:
    """(tail, hops): how long the longest simple path is that ends in a node, up to ``most``."""
    return simple_paths(edges, F.lit(True), most).groupBy("tail").agg(F.max("hops").alias("hops"))


def datasets(edges: DataFrame) -> DataFrame:
    """Edges between tables, self loops left out, with how many columns stand behind each."""
    rolled = edges.select(table_of(F.col("source")).alias("source"), table_of(F.col("target")).alias("target"), "kind", "ord")
    return rolled.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.min(kind(F.col("kind"))).alias("kind"))


def dataset_summary(edges: DataFrame) -> DataFrame:
    """For each table its columns and the edges that cross its border, in and out."""
    sides = edges.select(table_of(F.col("source")).alias("s"), table_of(F.col("target")).alias("t"), "source", "target")
    columns = sides.select(F.col("s").alias("dataset"), F.col("source").alias("node")).unionByName(sides.select(F.col("t").alias("dataset"), F.col("target").alias("node"))).groupBy("dataset").agg(F.countDistinct("node").alias("n_columns"))
    out = sides.where("s <> t").groupBy(F.col("s").alias("dataset")).agg(F.count("*").alias("n_out"))
    into = sides.where("s <> t").groupBy(F.col("t").alias("dataset")).agg(F.count("*").alias("n_in"))
    return columns.join(into, "dataset", "left").join(out, "dataset", "left").na.fill(0, ["n_in", "n_out"])
