"""Connected components of a link table, by repeated contraction.

In each round every node joins its smallest neighbour under an order drawn anew from a hash, so that long chains shrink
as fast as stars; links are then renamed, and those inside one node go. Each round is written to the shared folder.
Nothing is collected, and no node's neighbours come together in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each node of ``links`` (a, b): the smallest id that links reach. Links to itself, repeated
    links and both directions are allowed; a node without links isn't in the result. No links: no rows."""
    links = settle(links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    names = settle(nodes.select("id", F.col("id").alias("root")), "names")
    live, turn = links.where("a <> b"), 0
    while not live.isEmpty():
        turn += 1
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = live.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("w")))
        best = both.groupBy("u").agg(F.min(key("w")).alias("m")).select("u", F.least(key("u"), F.col("m"))["v"].alias("to"))
        moves = settle(best, "moves")
        left = live.join(moves.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").join(moves.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
        after = settle(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "links")
        renamed = settle(names.join(moves.select(F.col("u").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "names")
        forget(names, links, moves)
        names, links, live = renamed, after, after
    forget(links)
    smallest = names.groupBy("root").agg(F.min("id").alias("component"))
    out = settle(names.join(smallest, "root").select("id", "component"), "components")
    forget(names)
    return out
