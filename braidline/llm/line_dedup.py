"""Line dedup: an exact set-similarity join over the lines of all documents, in DataFrame functions alone.

A line is the set of its distinct lower-cased words. Equal sets are one class. The words of a set are ordered by rarity
and only a prefix of them is joined: two sets with Jaccard similarity of ``num``/``den`` or more share a word there. The
lengths of the sets, the positions of the shared word and parity maps of the sets bound their overlap, all within the
join's condition: 64 bits for short sets, 256 for long ones, for which 64 are too dense. Sets for which 256 are too
dense have longer prefixes and must share more words there. What is left is verified on the whole sets. A line goes if an
earlier line, by document id and line number, is that similar to it.

One witness suffices, so a group of near copies isn't listed pair by pair. First each class meets a few leaders: the
earliest classes that share a key, made of words of its prefix, and its band of lengths. Only classes that no leader
beats are then joined with all earlier ones, in rounds over the words, so that the shuffle of one round only is on disk;
after the first round the likeliest pairs are verified and who is beaten by them leaves, too. The smaller set of a pair
is joined by a shorter prefix, and in bands of sizes.

Words count as equal if their 64-bit hashes are. A sketch of fixed size reaches every task: how often the words of a
hash bucket occur in the corpus. It makes the order by rarity; any order gives the same result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, settle, text_rows

RARITY_BITS, CANDIDATE_BITS = 17, 23
LEADING, PARTS = 3, 4  # rarest words that look for leaders; parts of a key's classes, of which one has its own leader
ROUNDS = 4  # parts of the words that are joined one after the other
STEPS = 3  # of the similarity that a band of the join is wide
LONG, DENSE = 56, 256  # words from which a set has a wide parity map, and from which that is dense
QUARTERS = ("q1", "q2", "q3")  # of the wide map; the parity map is the sum of all four


def _plain(body: Column) -> Column:
    """Lower case, with spaces for other white space inside lines."""
    low = F.lower(body)
    odd = F.lit(False)
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(body, F.lit(c))
    return F.when(odd, F.translate(low, "\t\r\x0b\x0c", "    ")).otherwise(low)


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << RARITY_BITS) - 1).cast("long"))


def _cut(rows: DataFrame) -> DataFrame:
    """(id, line, text), lines counted from 0."""
    return rows.select("id", F.posexplode(F.split(_plain(F.col("body")), "\n", -1)).alias("line", "text"))


def _sets(lines: DataFrame) -> DataFrame:
    """(id, line, h): lines as arrays of their distinct words' hashes."""
    hashes = F.array_distinct(F.transform(F.split("text", " ", -1), lambda w: F.xxhash64(w)))
    return lines.select("id", "line", F.array_remove(hashes, F.xxhash64(F.lit(""))).alias("h"))


def _rarity(sets: DataFrame) -> Column:
    """For each hash bucket a number, at most 127, that grows with how many lines have its words; a constant array of a
    fixed size."""
    counted = sets.select(F.explode("h").alias("w")).groupBy(_bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("n"))
    every = sets.sparkSession.range(1 << RARITY_BITS).withColumnRenamed("id", "bucket").join(counted, "bucket", "left")
    scaled = every.select("bucket", F.least(F.floor(3 * F.log2(1 + F.coalesce("n", F.lit(0)))), F.lit(127)).cast("string").alias("n"))
    ordered = scaled.agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("a"))
    return F.split(F.lit(ordered.select(F.array_join(F.transform("a", lambda s: s["n"]), ",")).first()[0]), ",").cast("array<bigint>")


def _parity(h: Column) -> Column:
    """64 bits: the parity of the number of words that hash to each."""
    one, low = F.lit(1).cast("long"), F.lit(63).cast("long")
    return F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(low).cast("int"))))


def _quarter(h: Column, k: int) -> Column:
    """The parity map of a quarter of the words, for long sets."""
    own = F.filter(h, lambda x: x.bitwiseAND(F.lit(192).cast("long")) == F.lit(64 * k).cast("long"))
    return F.when(F.size(h) >= LONG, _parity(own)).otherwise(F.lit(0).cast("long"))


def _place(*key: str) -> Column:
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << CANDIDATE_BITS) - 1))


def _flagged(rows: DataFrame, *key: str) -> Column:
    """Is a bit of fixed number, by the hash of ``key``, set by one of ``rows``? True for each of their keys, and for some
    others."""
    place = _place(*key)
    bits = rows.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = rows.sparkSession.range(1 << (CANDIDATE_BITS - 6)).withColumnRenamed("id", "word").join(words, "word", "left")
    ordered = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("a"))
    flags = ordered.select(F.transform("a", lambda s: s["bits"]).alias("flags")).scalar()
    return F.call_function("getbit", F.get(flags, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1


def _shared(n: Column) -> Column:
    """How many words of the prefixes two sets of this size or more must share, if they are similar: more than one where
    even wide parity maps are too dense."""
    return F.when(n < DENSE, 1).otherwise(1 + 2 * F.shiftright(n, 6).cast("int"))


def _set_hash() -> Column:
    """64 bits that name a set; with ``_classes``' other 32 bits and the size they name a class."""
    return F.xxhash64(F.sort_array("h"))


def _classes(rows: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, line, x, y, n) for each line with words, and for each class its first line, how many lines it has, its prefix
    and parity maps. Texts are cut once, for the counts and for the lines."""
    sets = settle(_sets(_cut(rows)), "sets")
    rarity = _rarity(sets)
    # without nulls, as the type says, ranks are sorted as plain numbers
    rank = lambda h: F.shiftleft(F.coalesce(F.get(rarity, _bucket(h).cast("int")), F.lit(0).cast("long")), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    ranked = sets.select("id", "line", _set_hash().alias("x"), F.sort_array(F.transform("h", rank)).alias("r"))
    size = F.size("r")
    longest = F.least(size - F.floor((size * num + den - 1) / den).cast("int") + _shared(size), size)
    prefix = F.transform(F.slice("r", F.lit(1), longest), lambda r: r.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int"))
    named = ranked.select("id", "line", "x", F.hash("r").alias("y"), size.alias("n"), _parity(F.col("r")).alias("p"), *(_quarter(F.col("r"), k).alias(q) for k, q in enumerate(QUARTERS, 1)), prefix.alias("prefix"))
    lines = settle(named, "lines")
    forget(sets)
    classes = lines.where("n > 0").groupBy("x", "y", "n").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("p", *QUARTERS, "prefix")))
    return lines, settle(classes, "classes")


def _tuples(classes: DataFrame, prefix: Column, *more: str) -> DataFrame:
    """A row for each class and word of its prefix: the word (31 bits of its hash are enough to meet), the class, its
    first line, its parity maps, ``more`` columns, and ``m``: its size, the word's place, and whether it is beaten
    already."""
    each = classes.select(F.posexplode(prefix).alias("at", "w"), "x", "n", "p", *QUARTERS, *more, "out", F.col("first.id").alias("id"), F.col("first.line").alias("line"))
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 1)).bitwiseOR(F.col("out"))
    return each.select("w", packed.alias("m"), "x", "p", *QUARTERS, *more, "id", "line")


def _band(n: Column, num: int, den: int, steps: int) -> Column:
    """Never falls as ``n`` grows; similar sets are in one band or, with a step or more, in neighbouring ones."""
    return F.floor(F.log(n) / F.lit(steps * math.log(den / num))).cast("int")


def _n(t: str) -> Column:
    return F.shiftright(F.col(f"{t}.m"), 32)


def _earlier(a: str, b: str) -> Column:
    c = lambda t, k: F.col(f"{t}.{k}")
    return (c(a, "id") < c(b, "id")) | ((c(a, "id") == c(b, "id")) & (c(a, "line") < c(b, "line")))


def _apart(a: str, b: str) -> Column:
    """In how many bits the parity maps differ, of 256 if both sets are long, else of 64: the sets differ in as many words
    at least."""
    parts = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("p", *QUARTERS)]
    last = reduce(lambda x, y: x.bitwiseXOR(y), parts)
    return F.when(F.least(_n(a), _n(b)) >= LONG, reduce(lambda x, y: x + y, map(F.bit_count, [*parts[1:], last]))).otherwise(F.bit_count(parts[0]))


def _may_match(a: str, b: str, num: int, den: int) -> Column:
    """Do lengths, positions and parity maps let ``a`` and ``b`` be similar? Positions as the first words that both must
    share have them."""
    left = lambda t: _n(t) - F.shiftright(F.col(f"{t}.m").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    total = _n(a) + _n(b)
    return (
        (F.least(_n(a), _n(b)) * den >= F.greatest(_n(a), _n(b)) * num)
        & ((F.least(left(a), left(b)) + _shared(F.least(_n(a), _n(b))) - 1) * (num + den) >= total * num)
        & (F.bit_count(F.col(f"{a}.p").bitwiseXOR(F.col(f"{b}.p"))) * (num + den) <= total * (den - num))
        & (_apart(a, b) * (num + den) <= total * (den - num))
    )


def _round(told: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, need, apart): the classes that share a word of round ``k`` and may be similar, ``a`` earlier and ``b`` not beaten
    yet. The smaller set of a pair, ``s``, brings a shorter prefix, as the larger one's size bounds the overlap it needs,
    and goes to each band of sizes where a larger similar set, ``l``, can be."""
    size, n = F.col("n"), F.shiftright("m", 32)
    short = size - F.floor((2 * size * num + num + den - 1) / (num + den)).cast("int") + _shared(size)
    here = F.pmod("w", F.lit(ROUNDS)) == k
    band = lambda n: _band(n, num, den, STEPS)
    smaller = _tuples(told, F.slice("prefix", F.lit(1), short)).where(here).withColumn("band", F.explode(F.sequence(band(n), band(F.floor(n * den / num)))))
    larger = _tuples(told, F.col("prefix")).where(here).withColumn("band", band(n))
    open_ = lambda t: F.col(f"{t}.m").bitwiseAND(F.lit(1)) == 0
    first = _earlier("s", "l")
    turn = F.when(first, open_("l")).otherwise((_n("s") < _n("l")) & _earlier("l", "s") & open_("s"))
    met = smaller.alias("s").join(larger.alias("l"), (F.col("s.w") == F.col("l.w")) & (F.col("s.band") == F.col("l.band")) & (_n("s") <= _n("l")) & _may_match("s", "l", num, den) & turn)
    return met.select(F.when(first, F.col("s.x")).otherwise(F.col("l.x")).alias("a"), F.when(first, F.col("l.x")).otherwise(F.col("s.x")).alias("b"), _shared(_n("s")).alias("need"), _apart("s", "l").alias("apart"))


def _best(met: DataFrame) -> DataFrame:
    """(a, b): for each b up to two of the ``a`` it met whose parity maps are least apart from its own."""
    by = F.struct("apart", "a")
    best = met.groupBy("b").agg(*(F.min(F.when(F.pmod("a", F.lit(2)) == k, by)).alias(f"a{k}") for k in (0, 1)))
    return best.select(F.explode(F.array_compact(F.array("a0.a", "a1.a"))).alias("a"), "b")


def _told(classes: DataFrame, beaten: DataFrame) -> DataFrame:
    """The classes, and as ``out`` whether they are beaten. Few are: only classes that may be among them are joined."""
    none = F.lit(0).cast("long")
    asked = classes.drop("y", "copies").withColumn("_may", _flagged(beaten, "x"))
    some = asked.where("_may").join(beaten.withColumn("out", F.lit(1).cast("long")), "x", "left").withColumn("out", F.coalesce("out", none))
    return settle(asked.where("not _may").withColumn("out", none).unionByName(some).drop("_may"), "told")


def _beaten(pairs: DataFrame, classes: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """(x): the second of those ``pairs`` (a, b) whose whole sets are similar enough. Only the sets that occur in pairs
    are gathered: bit maps of fixed size find their rows and lines, a join confirms them."""
    some = pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    wanted = settle(classes.join(some, "x").select("x", "first.id", "first.line"), "wanted")
    sets = _sets(_cut(rows.where(_flagged(wanted, "id"))).where(_flagged(wanted, "id", "line"))).withColumn("x", _set_hash()).join(wanted, ["id", "line", "x"]).select("x", "h").dropDuplicates(["x"])
    both = pairs.join(sets.select(F.col("x").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("x").alias("b"), F.col("h").alias("hb")), "b")
    out = settle(both.where(F.size(F.array_intersect("ha", "hb")) * (num + den) >= (F.size("ha") + F.size("hb")) * num).select(F.col("b").alias("x")).distinct(), "beaten")
    forget(wanted)
    return out


def _leaders(open_: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): for each class up to two earlier ones that look most like it among the leaders of its keys. Keys are its
    rarest words and, as these may be just what sets it apart from its group, pairs of prefix words that a hash chooses.
    Leaders of a key and band of lengths are the earliest class and the earliest of a part of the classes, another part
    for another key: so a class whose group has several variants meets several."""
    by_hash = F.sort_array("prefix")
    pair = lambda k: F.hash(F.get(by_hash, F.lit(k)), F.get(by_hash, F.lit(k + 1)))
    keys = F.when(F.size("prefix") < 5, F.slice("prefix", 1, LEADING)).otherwise(F.concat(F.slice("prefix", 1, LEADING - 1), F.array(pair(0), pair(1))))
    leading = _tuples(open_.withColumn("out", F.lit(0).cast("long")), keys).withColumn("band", _band(F.shiftright("m", 32), num, den, 1))
    first, part = F.struct("id", "line", "x", "m", "p", *QUARTERS), F.pmod(F.xxhash64("x", "w"), F.lit(PARTS))
    leaders = leading.groupBy("w", "band").agg(F.min(first).alias("a0"), F.min(F.when(part == 0, first)).alias("a1"))
    met = leading.alias("b").join(leaders, ["w", "band"])
    tried = [F.when(_earlier(a, "b") & _may_match(a, "b", num, den), F.struct(_apart(a, "b").alias("apart"), F.col(f"{a}.x").alias("a"))) for a in ("a0", "a1")]
    met = met.select(F.explode(F.array_compact(F.array(*tried))).alias("by"), F.col("b.x").alias("b"))
    return _best(met.select("by.apart", "by.a", "b"))


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """(id, line): the lines, counted from 0, for which an earlier line has a similarity of num/den or more. Lines without
    words never go. Rows that share an id are one document: their lines of one number stay or go alike. Null texts have
    no lines; those of rows without id can't be named and neither go nor make others go, as if they came last."""
    rows = text_rows(df, id_col, text_col).where("id is not null")
    lines, classes = _classes(rows, num, den)
    # A set so small that one more word makes it another has only the copies of its class.
    open_ = classes.where(F.col("n") * (den - num) >= num)
    led = settle(_leaders(open_, num, den), "led")
    beaten = _beaten(led, classes, rows, num, den)

    # Of what the first round's words find only the likeliest is verified: who is beaten needs no other pairs.
    told = _told(open_, beaten)
    met = [settle(_round(told, 0, num, den), "met")]
    tried = settle(_best(met[0].join(led, ["a", "b"], "left_anti")), "tried")
    soon = _beaten(tried, classes, rows, num, den)
    beaten, was = beaten.unionByName(soon).distinct(), beaten
    forget(told)
    told = _told(open_, beaten)
    met += [settle(_round(told, k, num, den), "met") for k in range(1, ROUNDS)]
    forget(told)
    left = reduce(DataFrame.unionByName, met).join(soon.withColumnRenamed("x", "b"), "b", "left_anti")
    shared = left.groupBy("a", "b").agg(F.count("*").alias("k"), F.max("need").alias("need"))
    pairs = settle(shared.where("k >= need").select("a", "b").join(led.unionByName(tried), ["a", "b"], "left_anti"), "pairs")
    forget(*met)
    later = _beaten(pairs, classes, rows, num, den)
    every = beaten.unionByName(later)
    forget(led, tried, pairs)

    # A class of one line that isn't beaten loses nothing: only the other classes meet their lines.
    told = classes.select("x", "y", "n", "first", "copies").where((F.col("copies") > 1) | _flagged(every, "x"))
    known = told.join(every.distinct().withColumn("beaten", F.lit(True)), "x", "left").withColumn("beaten", F.coalesce("beaten", F.lit(False)))
    known = settle(known.where("beaten or copies > 1").select("x", "y", "n", "first", "beaten"), "known")
    gone = lines.select("id", "line", "x", "y", "n").where(_flagged(known, "x") & (F.col("n") > 0)).join(known, ["x", "y", "n"])
    gone = settle(gone.where((F.struct("id", "line") != F.col("first")) | F.col("beaten")).select("id", "line").distinct(), "gone")
    forget(lines, classes, was, soon, later, known)
    return gone


def line_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each input row: its id, n_lines, n_removed and removed (line numbers, ascending, comma-joined)."""
    rows = text_rows(df, id_col, text_col)
    gone = repeated_lines(df, id_col, text_col, **options).groupBy("id").agg(F.array_sort(F.collect_list("line")).alias("gone"))
    sizes = rows.select("id", (F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n", -1)))).cast("long").alias("n_lines"))
    out = sizes.join(gone, "id", "left").withColumn("gone", F.filter(F.coalesce("gone", F.array().cast("array<int>")), lambda k: k < F.col("n_lines")))
    return out.select(F.col("id").alias(id_col), "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with repeated lines taken out of its texts; null texts stay null, texts all of whose lines went are
    empty."""
    gone = repeated_lines(df, id_col, text_col, **options).groupBy("id").agg(F.collect_set("line").alias("_gone")).withColumnRenamed("id", "_id")
    joined = df.join(gone, F.col(f"`{id_col}`") == F.col("_id"), "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda text, k: ~F.array_contains("_gone", k)), "\n")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(f"`{text_col}`")).otherwise(kept)).drop("_id", "_gone")
