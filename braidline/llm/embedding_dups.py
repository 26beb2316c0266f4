"""Embedding near-duplicates: one small-world graph for each shard, every shard queried by all vectors.

Equal vectors are one class. Classes are dealt over shards by a hash; each shard's graph is built once and written to
the shared folder. All classes, in blocks, query every shard. A beam that comes back full of links is widened for its
queries until it reaches beyond the threshold (past an eighth of the shard the rest is scanned). Before that, an audit
in each shard compares queries with a scan, first a sample from other shards, then the shard's own vectors, each until
enough links other than to themselves are seen, and widens the shard's beam until the recall of both passes. Cosines are
checked in double precision. A block's links leave their task as counts and as a spanning forest, so that a dense
cluster costs a row for each vector and shard, not one for each pair.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle, small_batches
from .components import components
from .hnsw import Graph

SLACK = 1e-4  # single against double precision
ENOUGH = 300  # links that an audit is to see


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def probes(vectors: np.ndarray, q: np.ndarray, threshold: float, step: int, own: np.ndarray | None = None):
    """Those of ``q`` that have links, and their links, as far as ENOUGH are seen; ``own``: their places in vectors."""
    asked, true, seen = [q[:0]], [np.zeros((0, len(vectors)), bool)], 0
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        t = part @ vectors.T >= threshold
        if own is not None:
            t[np.arange(len(part)), own[lo : lo + step]] = False
        some = t.any(1)
        asked.append(part[some])
        true.append(t[some])
        seen += int(t.sum())
        if seen >= ENOUGH:
            break
    return np.concatenate(asked), np.concatenate(true)


def audited_beam(graph: Graph, vectors: np.ndarray, threshold: float, beam: int, recall: float, sample: int, others: np.ndarray) -> int:
    """The narrowest beam, doubled from ``beam``, whose recall passes for ``others``, vectors of other shards, and for
    the shard's own, ``sample`` at a time."""
    if beam * 8 >= len(vectors):  # scanned anyway
        return beam
    order = np.random.default_rng(11).permutation(len(vectors))
    for q, true in (probes(vectors, others, threshold, sample), probes(vectors, vectors[order], threshold, sample, order)):
        while len(q) and beam * 8 < len(vectors):
            links = lost = 0
            for lo in range(0, len(q), 512):
                ids, sims = graph.search(q[lo : lo + 512], beam)
                for t, i, s in zip(true[lo : lo + 512], ids, sims, strict=True):
                    if s[-1] < threshold - SLACK or i[-1] < 0:  # full beams are widened later, for these queries alone
                        links += int(t.sum())
                        lost += int(t.sum()) - int(t[i[(s >= threshold - SLACK) & (i >= 0)]].sum())
            if lost <= (1 - recall) * links:
                break
            beam *= 2
    return beam


def near(graph: Graph, vectors: np.ndarray, q: np.ndarray, threshold: float, beam: int):
    """(query rows, vector rows) with cosine >= threshold, in double precision."""
    left, out_q, out_v = np.arange(len(q)), [], []
    while len(left):
        if beam * 8 >= len(vectors):
            for lo in range(0, len(left), 256):
                r, c = np.nonzero(q[left[lo : lo + 256]] @ vectors.T >= threshold)
                out_q.append(left[lo + r])
                out_v.append(c)
            break
        again = []
        for lo in range(0, len(left), 512):
            part = left[lo : lo + 512]
            ids, sims = graph.search(q[part], beam)
            full = (sims[:, -1] >= threshold - SLACK) & (ids[:, -1] >= 0)
            again.append(part[full])
            r, c = np.nonzero((sims >= threshold - SLACK) & (ids >= 0) & ~full[:, None])
            v = ids[r, c]
            sure = np.einsum("bd,bd->b", q[part[r]], vectors[v]) >= threshold
            out_q.append(part[r[sure]])
            out_v.append(v[sure])
        left, beam = np.concatenate(again), beam * 4
    return (np.concatenate(out_q), np.concatenate(out_v)) if out_q else (np.zeros(0, int), np.zeros(0, int))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that suffice to connect what (a, b) connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def embedding_dups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, shards: int = 8, shard_rows: int = 50_000, beam: int = 48, recall: float = 0.97, audit: int = 64, asking: int = 2048, block: int = 4096) -> DataFrame:
    """A row for each input row: its id, n_links (other vectors linked directly), component_id (smallest id reachable)
    and kept (it is that id). Vectors that are null, zero or hold null or non-finite components link with nothing;
    vectors of different lengths never link. ``shards`` is the least number; a shard takes about ``shard_rows``
    classes. ``asking`` vectors, chosen by a hash, audit the shards that they aren't in. Rows that share an id are
    different vectors of one component."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    whole = F.expr("v is not null and size(v) > 0 and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity')) and exists(v, c -> c <> 0)")
    good = rows.where(whole)
    classes = settle(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    n = classes.count()
    shards = max(shards, -(-n // shard_rows))
    sharded = classes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))

    asks: dict = {}
    for r in sharded.orderBy(F.xxhash64("v"), "rep").select("dim", "shard", "v").limit(asking).toLocalIterator():
        asks.setdefault(r.dim, []).append((r.shard, np.array(r.v, np.float64)))

    def packed(batches, size, build):
        """Rows of (dim, shard) or of dim, in packs."""
        held: dict = {}
        for batch in batches:
            dims, shard, reps, weights = (batch.column(k).to_pylist() for k in (0, 1, 2, 3))
            for d, s, r, w, v in zip(dims, shard, reps, weights, batch.column(4).to_pylist(), strict=True):
                own = held.setdefault((d, s), ([], [], []))
                own[0].append(r)
                own[1].append(w)
                own[2].append(v)
                if size and len(own[0]) >= size:
                    yield build(d, s, *held.pop((d, s)))
        for (d, s), own in held.items():
            yield build(d, s, *own)

    def index(batches):
        def build(d, s, reps, weights, vectors):
            x = unit(np.array(vectors, np.float64))
            graph = Graph(x)
            others = [v for shard, v in asks.get(d, []) if shard != s]
            wide = audited_beam(graph, x, threshold, beam, recall, audit, unit(np.array(others)) if others else x[:0])
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s], pa.int32()), pa.array([pickle.dumps((np.array(reps), np.array(weights), x, graph, wide), 5)], pa.binary())], ["dim", "shard", "graph"])

        yield from packed(batches, 0, build)

    def blocks(batches):
        def build(d, s, reps, weights, vectors):
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([pickle.dumps((np.array(reps), unit(np.array(vectors, np.float64))), 5)], pa.binary())], ["dim", "vectors"])

        yield from packed(batches, block, build)

    small_batches(spark, 1024)
    columns = ["dim", "shard", "rep", "weight", "v"]
    graphs = settle(sharded.repartition(shards, "dim", "shard").select(columns).mapInArrow(index, "dim int, shard int, graph binary"), "graphs")
    asked = settle(sharded.withColumn("shard", F.lit(0)).select(columns).mapInArrow(blocks, "dim int, vectors binary"), "blocks")

    def query(batches):
        """Rows of a shard: its graph first, then the blocks that ask it."""
        graph = None
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if kind == 0:
                    reps, weights, x, graph, wide = pickle.loads(blob)
                    continue
                ids, q = pickle.loads(blob)
                a, b = near(graph, x, q, threshold, wide)
                other = ids[a] != reps[b]
                a, b = a[other], b[other]
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, a, weights[b])
                some = np.flatnonzero(links)
                joined = forest(ids[a], reps[b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[some], np.array([p for p, _ in joined], np.int64)])), pa.array(np.concatenate([np.full(len(some), -1, np.int64), np.array([p for _, p in joined], np.int64)])), pa.array(np.concatenate([links[some], np.zeros(len(joined), np.int64)]))],
                    ["a", "b", "n"],
                )

    # Every block meets every shard. A graph is sent once to each of the ``turns`` tasks that its shard is dealt to, and
    # the blocks stream past it.
    small_batches(spark, 1)
    turns = max(1, -(-2 * spark.sparkContext.defaultParallelism // shards))
    turn = F.array(*(F.lit(k) for k in range(turns)))
    served = graphs.select("dim", "shard", F.explode(turn).alias("turn"), F.lit(0).alias("kind"), F.col("graph").alias("blob"))
    there = graphs.select("dim", "shard")
    meeting = asked.join(there, "dim").select("dim", "shard", F.pmod(F.crc32("vectors"), F.lit(turns)).cast("int").alias("turn"), F.lit(1).alias("kind"), F.col("vectors").alias("blob"))
    met = served.unionByName(meeting).repartition(2 * shards * turns, "dim", "shard", "turn").sortWithinPartitions("dim", "shard", "turn", "kind").select("kind", "blob")
    found = settle(met.mapInArrow(query, "a long, b long, n long"), "found")
    small_batches(spark)
    forget(graphs, asked)
    direct = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    group = components(found.where("n = 0").select("a", "b"))
    told = classes.join(direct, "rep", "left").join(group.withColumnRenamed("id", "rep"), "rep", "left")
    told = told.select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(told, "v")
    alone = rows.where(~F.coalesce(whole, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
