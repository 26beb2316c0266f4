"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word 3-grams. Sets are dealt into size bands so narrow that linked sets lie in
the same band or in neighbouring ones; a set takes part in its own band's instance and in the next one's. Linked sets
of an instance with sizes up to r differ in at most k = 2 r (1 - t) / (1 + t) features. The feature domain is cut into
n1 parts, each again into n2; with n1 = ceil((k + 1) / 2) some part holds one difference at most, so some n2 - 1 of its
n2 pieces agree. One signature for each part and each such subset of pieces finds every linked pair; nothing is
approximate. A subset without features would be the same for every such set: in its place a set gives the prefix of its
features in a fixed order, of which linked sets share one.

Equal sets are one class from the start. Documents that share a signature are candidates; instead of listing the pairs
of a bucket, each member is first compared with the bucket's leader, and one leader for each document at first, if sizes and
parity sketches let the two link: then
only those pairs of a bucket are compared whose components still differ. So groups of thousands of near copies cost a
few comparisons for each member, and no link that joins two components goes unseen.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, kept, settle, small_batches, text_rows
from .components import components

SKETCH = 8  # 64-bit words of a parity sketch
WIDE, FOLDED = 128, 32  # words of that which large sets have besides, as it is stored and as it is joined
LARGE = 800  # features
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word n-grams; word hashes are remembered in a bounded table."""

    def __init__(self, size: int = 3, remembered: int = 250_000):
        self.size, self.remembered, self.known = size, remembered, {}

    def _word(self, word: bytes) -> int:
        import xxhash

        if len(self.known) >= self.remembered:
            self.known.clear()
        got = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes. A-Z are lower-cased, ASCII white space parts words; with fewer words
        than a shingle takes, the whole sequence is one; without words the set is empty."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        get, learn = self.known.get, self._word
        got = np.array([get(w) or learn(w) for w in words], np.uint64)
        size = min(self.size, len(got))
        n = len(got) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = mix(out * GOLD + got[k : k + n])
        return np.unique(out)


@lru_cache(maxsize=64)
def bands(top: int, num: int, den: int) -> tuple[tuple[int, int], ...]:
    """Size bands (first, last): sets whose sizes are within num/den of each other share one or are neighbours."""
    out, low = [], 1
    while low <= top:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return tuple(out)


def signatures(features: np.ndarray, num: int, den: int) -> np.ndarray:
    """One number for each instance, part and subset of pieces."""
    n = len(features)
    if not n:
        return np.zeros(0, np.uint64)
    every = bands(1 << (int(n * den // num) + 1).bit_length(), num, den)
    lows = np.array([b[0] for b in every])
    own = int(np.searchsorted(lows, n, side="right")) - 1
    out, bare = [], False
    for number in (own, own + 1):
        most = 2 * every[number][1] * (den - num) // (den + num)
        parts = (most + 2) // 2
        pieces = 4 if most <= 12 else 2  # small sets have room for more selective subsets
        seeded = mix(features + np.uint64((number + 1) * int(GOLD) % (1 << 64)))
        place = (seeded % np.uint64(parts * pieces)).astype(np.int64)
        sums = np.zeros(parts * pieces, np.uint64)
        np.add.at(sums, place, mix(seeded ^ MIX1))
        sums = sums.reshape(parts, pieces)
        left = (sums.sum(axis=1, dtype=np.uint64)[:, None] - sums).reshape(-1)  # all pieces of the part but one
        size = np.bincount(place, minlength=parts * pieces).reshape(parts, pieces)
        held = (size.sum(axis=1)[:, None] - size).reshape(-1) > 0
        bare |= not held.all()
        tags = np.arange(parts * pieces, dtype=np.uint64) + np.uint64(number) * np.uint64(1 << 32)
        out.append(mix(left[held] + mix(tags[held] + GOLD)))
    if bare:
        out.append(np.sort(mix(features ^ MIX2))[: n - -(-n * num // den) + 1])
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def parity(features: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """64 bits a word, each the parity of the features that hash to it: two sets differ in at least as many features as
    bits."""
    counts = np.bincount((mix(features + GOLD) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


MARKS = [f"s{k}" for k in range(SKETCH)]


def _sizes(rows: DataFrame, size: int, id_type: str) -> DataFrame:
    """(id, n, key, wide, s0 ..) for each row: the size of its set, its digest and its parity sketches; ``wide`` for large
    sets only."""

    def run(batches):
        shingler = kept(("shingles", size), lambda: Shingler(size))
        for batch in batches:
            n, key, wide, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                features = shingler.of(text)
                n.append(len(features))
                key.append(hashlib.blake2b(features.tobytes(), digest_size=16).digest())
                wide.append(parity(features, WIDE) if len(features) > LARGE else None)
                bits.append(parity(features))
            bits = np.array(bits, np.int64).reshape(len(n), SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(wide, pa.list_(pa.int64())), *(pa.array(bits[:, k]) for k in range(SKETCH))], ["id", "n", "key", "wide", *MARKS])

    return rows.mapInArrow(run, f"id {id_type}, n long, key binary, wide array<long>, " + ", ".join(f"{m} long" for m in MARKS))


def _signed(rows: DataFrame, size: int, num: int, den: int, id_type: str) -> DataFrame:
    """(sig, id); a text that stands several times in one partition is signed once."""

    def run(batches):
        shingler, seen = kept(("shingles", size), lambda: Shingler(size)), set()
        for batch in batches:
            ids, sigs = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                features = shingler.of(text)
                key = hashlib.blake2b(features.tobytes(), digest_size=16).digest()
                if len(features) and key not in seen:
                    if len(seen) < 200_000:
                        seen.add(key)
                    got = signatures(features, num, den)
                    sigs.append(got)
                    ids.append(np.full(len(got), k, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(ids)))], ["sig", "id"])

    return rows.mapInArrow(run, f"sig long, id {id_type}")


def _sets(rows: DataFrame, size: int, id_type: str) -> DataFrame:
    def run(batches):
        shingler = kept(("shingles", size), lambda: Shingler(size))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler.of(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "features"])

    return rows.mapInArrow(run, f"id {id_type}, features binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, id_type: str) -> DataFrame:
    """Those (a, b) that link."""
    sided = pairs.join(sets.select(F.col("id").alias("a"), F.col("features").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("features").alias("y")), "b")

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), num, den) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sided.select("a", "b", "x", "y").mapInArrow(run, f"a {id_type}, b {id_type}")


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Do sizes and sketches let two sets link? Two sets differ in at least as many features as their sketches in bits."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = reduce(add, (F.bit_count(F.col(f"{x}.{k}").bitwiseXOR(F.col(f"{y}.{k}"))) for k in MARKS))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (differ * (num + den) <= (n + m) * (den - num))


def _differ(words: list[tuple[Column, Column]], n: Column, m: Column, num: int, den: int) -> Column:
    """Do sketches rule out that sets of n and m features link?"""
    return reduce(add, (F.bit_count(x.bitwiseXOR(y)) for x, y in words)) * (num + den) > (n + m) * (den - num)


def _folded(wide: str) -> list[Column]:
    """FOLDED words of a wide sketch: words that lie FOLDED apart fall together, as their features' hashes do."""
    word = lambda k: F.coalesce(F.get(wide, F.lit(k)), F.lit(0))
    return [reduce(lambda a, b: a.bitwiseXOR(b), (word(j) for j in range(k, WIDE, FOLDED))).alias(f"w{k}") for k in range(FOLDED)]


def _close(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b and more) whose sets may link; only their sets are gathered."""
    both = pairs.alias("p").join(marks.alias("x"), F.col("p.a") == F.col("x.id")).join(marks.alias("y"), F.col("p.b") == F.col("y.id"))
    return both.where(_may_link("x", "y", num, den)).select("p.*").distinct()


def _gathered(rows: DataFrame, pairs: DataFrame, size: int, id_type: str) -> DataFrame:
    """The sets that occur in ``pairs``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return settle(_sets(rows.join(wanted, "id", "left_semi"), size, id_type), "sets")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component yet."""
    ends = pairs.join(groups.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(groups.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    return ends.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """A row for each input row: its id, n_shingles (size of its set) and component_id, the smallest id reachable over
    links, itself included; two documents link when their sets' Jaccard similarity is num/den or more. Null and empty
    texts have an empty set and link with nothing. Rows that share an id are one document with several sets; rows without
    id lead nothing, and have the component of a document with the same set, if there is one."""
    spark = df.sparkSession
    small_batches(spark)
    rows = text_rows(df, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()

    sizes = settle(_sizes(rows, size, id_type), "sizes")
    rows = rows.where("id is not null")
    sketch = [F.first(m).alias(m) for m in MARKS]
    first = settle(sizes.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.max("n").alias("n"), *sketch), "first")
    marks = first.select(F.col("rep").alias("id"), "n", *MARKS)
    reps = settle(sizes.where("n > 0 and id is not null").join(first.select("key", "rep"), "key").select("id", "rep").distinct(), "reps")

    # Each member of a bucket beside the bucket's leader; buckets of one leave nothing.
    ordered = Window.partitionBy("sig").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bucketed = _signed(rows, size, num, den, id_type).withColumn("leader", F.first("id").over(ordered)).where("id <> leader")
    bucketed = settle(bucketed, "buckets")
    named = bucketed.groupBy("id", "leader").agg(F.count("*").alias("shared"))
    named = named.join(reps, "id").select(F.col("rep").alias("a"), "leader", "shared").join(reps.select(F.col("id").alias("leader"), F.col("rep").alias("b")), "leader").where("a <> b")
    met = named.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("shared").alias("shared"))
    led = settle(_close(met, marks, num, den), "led")
    sets = _gathered(rows, led, size, id_type)

    best = led.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    links = settle(_verified(best, sets, num, den, id_type), "linked")
    groups, direct = components(links), links
    rest = settle(_verified(_apart(led.select("a", "b"), groups).join(best, ["a", "b"], "left_anti"), sets, num, den, id_type), "linked")
    forget(groups, sets)
    links = links.unionByName(rest)
    groups = components(links)

    # What leaders didn't join: members of one bucket in different components.
    member = bucketed.join(reps, "id").select("sig", F.col("rep").alias("id")).join(groups, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
    torn = member.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    open_ = settle(member.join(torn, "sig").distinct().join(marks, "id"), "open")
    wide = sizes.where("wide is not null and id is not null").join(first.select("key", F.col("rep").alias("id")), ["key", "id"]).select("id", "n", "wide").dropDuplicates(["id", "n"])
    met = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & _may_link("x", "y", num, den)
    small, large = open_.where(F.col("n") * num <= LARGE * den), open_.where(F.col("n") > LARGE).join(wide, ["id", "n"]).select("sig", "id", "component", "n", *MARKS, *_folded("wide"))
    pairs = small.alias("x").join(small.alias("y"), met & (F.least("x.n", "y.n") <= LARGE)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = pairs.unionByName(large.alias("x").join(large.alias("y"), met & ~_differ([(F.col(f"x.w{k}"), F.col(f"y.w{k}")) for k in range(FOLDED)], F.col("x.n"), F.col("y.n"), num, den)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    pairs = met_again = settle(pairs.distinct().join(led.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    # Of the pairs left, the large ones are looked at through the whole of their sketches.
    both = pairs.join(wide.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("x")), "a", "left").join(wide.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("y")), "b", "left")
    apart = _differ([(F.get("x", F.lit(k)), F.get("y", F.lit(k))) for k in range(WIDE)], F.col("na"), F.col("nb"), num, den)
    pairs = both.where(~F.coalesce(apart, F.lit(False))).select("a", "b").distinct()
    pairs = settle(pairs, "pairs")
    sets = _gathered(rows, pairs, size, id_type)
    last = settle(_verified(pairs, sets, num, den, id_type), "linked")
    forget(groups, bucketed, open_, led, sets, pairs)
    final = components(links.unionByName(last).unionByName(reps.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")))

    # Rows without id go by their set.
    named = sizes.where("id is not null").select("id", "n", F.col("id").alias("name"))
    nameless = sizes.where("id is null").join(first.select("key", F.col("rep").alias("name")), "key", "left").select("id", "n", "name")
    out = named.unionByName(nameless).join(final.select(F.col("id").alias("name"), "component"), "name", "left")
    out = settle(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "name").alias("component_id")), "joined")
    forget(sizes, first, reps, direct, rest, met_again, last, final)
    return out
