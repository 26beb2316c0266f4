"""Accuracy of one set of edges against known truth, as set algebra over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coarse


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, tgt), upper-cased, database links cut off the column grain."""
    name = lambda c: F.regexp_replace(F.upper(c), r"@[^.]*", "")
    return edges.select(name("source").alias("src"), name("target").alias("tgt")).distinct()


def compared(truth: DataFrame, engine: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' keys with in_truth and in_engine."""
    t, e = truth.select(keys).distinct().withColumn("in_truth", F.lit(1)), engine.select(keys).distinct().withColumn("in_engine", F.lit(1))
    return t.join(e, keys, "full").na.fill(0, ["in_truth", "in_engine"])


def rates(both: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; 0 where there is nothing to divide by."""
    counts = [F.count_if((F.col("in_truth") == 1) & (F.col("in_engine") == 1)).alias("tp"), F.count_if((F.col("in_truth") == 0) & (F.col("in_engine") == 1)).alias("fp"), F.count_if((F.col("in_truth") == 1) & (F.col("in_engine") == 0)).alias("fn")]
    out = (both.groupBy(*by) if by else both).agg(*counts)
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = out.withColumns({"p": p, "r": r})
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return out.select(*(by or []), "tp", "fp", "fn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f, 4).alias("f1"))


def kind_accuracy(truth: DataFrame, engine: DataFrame) -> DataFrame:
    """Over the pairs of both: whose kinds meet exactly, whose meet coarsely; exact is null where no word is shared."""
    t = truth.groupBy("source", "target").agg(F.collect_set("kind").alias("tk"), F.collect_set(coarse(F.col("kind"))).alias("tc"))
    e = engine.groupBy("source", "target").agg(F.collect_set("kind").alias("ek"), F.collect_set(coarse(F.col("kind"))).alias("ec"))
    both = t.join(e, ["source", "target"])
    out = both.agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap("tk", "ek")).alias("exact_n"), F.count_if(F.arrays_overlap("tc", "ec")).alias("coarse_n"))
    share = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) / F.col("n"), 4))
    return out.select("n", F.when(F.col("exact_n") > 0, share("exact_n")).alias("exact"), share("coarse_n").alias("coarse"))


def tiers(truth: DataFrame, engine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rates by the tier of the file; files that the manifest doesn't have are tier -1."""
    both = compared(truth, engine, ["file", "source", "target"])
    placed = both.join(manifest, "file", "left").withColumn("tier", F.coalesce("tier", F.lit(-1)).cast("long"))
    return rates(placed, ["tier"])


def two_hops(edges: DataFrame) -> DataFrame:
    """Distinct (deep, mid, tgt) with deep -> mid -> tgt and deep other than tgt."""
    p = edges.select("source", "target").distinct()
    a, b = p.select(F.col("source").alias("deep"), F.col("target").alias("mid")), p.select(F.col("source").alias("mid"), F.col("target").alias("tgt"))
    return a.join(b, "mid").where("deep <> tgt").select("deep", "mid", "tgt")


def multi_hop(truth: DataFrame, engine: DataFrame) -> DataFrame:
    """How many of the truth's two-hop chains the engine has whole."""
    chains, have = two_hops(truth), engine.select("source", "target").distinct()
    first = chains.join(have.select(F.col("source").alias("deep"), F.col("target").alias("mid"), F.lit(1).alias("x")), ["deep", "mid"], "left")
    both = first.join(have.select(F.col("source").alias("mid"), F.col("target").alias("tgt"), F.lit(1).alias("y")), ["mid", "tgt"], "left")
    done = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    return both.agg(F.count("*").alias("total"), done.alias("completed")).withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("completed") / F.col("total"), 4)).otherwise(0.0))


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ``a`` that ``b`` lacks."""
    return a.select("source", "target").distinct().join(b.select("source", "target").distinct(), ["source", "target"], "left_anti")


def parse_rate(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Share of the files without a PARSE_FAILED diagnostic."""
    bad = diagnostics.where("code = 'PARSE_FAILED'").select("file").distinct().withColumn("bad", F.lit(1))
    return files.select("file").distinct().join(bad, "file", "left").agg(F.count("*").alias("files"), F.count("bad").alias("failed")).withColumn("rate", F.when(F.col("files") > 0, F.round((F.col("files") - F.col("failed")) / F.col("files"), 4)).otherwise(0.0))


def dynamic_buckets(diagnostics: DataFrame, relations: DataFrame) -> DataFrame:
    """Dynamic statements: unresolved, partly known, fully known (a relation by literal without a partial mark)."""
    partial = diagnostics.where("code = 'DYNAMIC_SQL_PARTIAL'").select("file", "line").distinct()
    literal = relations.where("method = 'dynamic-literal'").select("file", "line").distinct()
    full = literal.join(partial, ["file", "line"], "left_anti")
    unresolved = diagnostics.where("code = 'DYNAMIC_SQL'").select("file", "line").distinct()
    parts = [d.select(F.lit(name).alias("bucket")) for name, d in (("unresolved", unresolved), ("partial", partial), ("full", full))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("bucket").agg(F.count("*").alias("n"))


def flow_pairs(relationships: DataFrame) -> DataFrame:
    """(source, target, kind) of another engine's relationships (type, source, target), whose ids are
    ``column.<table>.<column>`` or ``table.<table>``; other types and ids don't count."""
    kinds = F.when(F.col("type") == "direct", "VALUE").when(F.col("type") == "indirect", "FILTER").when(F.col("type") == "dynamic_sql", "DYNAMIC")

    def key(c: str) -> Column:
        return F.when(F.col(c).rlike(r"^column\.[^.]+(\.[^.]+)+$"), F.upper(F.regexp_replace(c, r"^column\.", ""))).when(F.col(c).rlike(r"^table\.."), F.concat(F.upper(F.regexp_replace(c, r"^table\.", "")), F.lit(".*")))

    out = relationships.select(key("source").alias("source"), key("target").alias("target"), kinds.alias("kind"))
    return out.dropna().distinct()
