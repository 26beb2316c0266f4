"""PII: personal data and the terms that give it away, in DataFrame functions alone.

Personal data are found by patterns; quantifiers are possessive, so that no text, however long, makes the matcher
recurse. Matches are placed by the lengths of the stretches between them. Then information-theoretic sanitisation: a
context is what stands in a line within ``reach`` words of an entity (a value found). Over the whole corpus, in lines,
how strongly a term reveals an entity is their pointwise mutual information as a share of the entity's own information, log(N n(e,t) / n(e) n(t)) /
log(N / n(e)); 1 means that the term never occurs without the entity. The share of a term's lines that have the entity
is smoothed, so that single sightings count, but for less. Terms at or beyond ``remove`` are to be removed, those at or
beyond ``generalise`` to be generalised, wherever they stand in the entity's context; ``sanitise`` does both.

A bit map of fixed size, passed as a scalar subquery, keeps words that never stand beside an entity out of the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, text_rows

#: \G: a match may begin where the one before ended; else an address begins where no character of its class precedes.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"
FLAG_BITS = 20


def luhn(digits: Column) -> Column:
    """Does a string of digits pass Luhn's test?"""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _spans(kind: str, pattern: str, possible: Column, passes) -> Column:
    """Matches of one kind that pass, with their places in code points. ``possible``: a cheap necessary test."""
    found, gaps = F.regexp_extract_all("body", F.lit(pattern), 0), F.split("body", pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, k))
        match = F.get(found, k)
        end = start + F.length(match)
        own = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), match.alias("value"))
        return F.struct(end.alias("at"), F.when(passes(match), F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    steps = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(possible, F.aggregate(steps, begin, step)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (with body) and their base spans, by kind."""
    body = F.col("body")
    digits = _digits
    return rows.withColumns(
        {
            "email": _spans("email", EMAIL, F.instr(body, "@") > 0, lambda m: F.lit(True)),
            "ip": _spans("ip", IP, body.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
            "card": _spans("card", CARD, body.rlike(CARD), lambda m: (F.length(digits(m)) <= 19) & luhn(digits(m))),
            "phone": _spans("phone", PHONE, F.instr(body, "+") > 0, lambda m: F.length(digits(m)).between(10, 15)),
        }
    )


def _spaced(line: Column) -> Column:
    return F.translate(line, "\t\r\x0b\x0c", "    ")


def _words(line: Column) -> Column:
    return F.split(F.lower(_spaced(line)), " ", -1)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _flags(terms: DataFrame) -> DataFrame:
    place = F.xxhash64("term").bitwiseAND(F.lit((1 << FLAG_BITS) - 1))
    bits = terms.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = terms.sparkSession.range(1 << (FLAG_BITS - 6)).withColumnRenamed("id", "word").join(bits, "word", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("a")).select(F.transform("a", lambda s: s["bits"]).alias("flags"))


def entity_lines(found: DataFrame) -> DataFrame:
    """(key, line_start, line, spans): each line that holds an entity. Lines and spans are sorted together once, so that
    the work is linear in a text, however many entities it holds."""
    each = found.dropDuplicates(["key"])
    none = F.lit(None)
    lines = each.select("key", F.posexplode(F.split("body", "\n", -1)).alias("no", "line"))
    before = Window.partitionBy("key").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("key", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int").alias("at"), F.lit(0).alias("t"), "line", none.cast(SPAN).alias("s"))
    spans = each.select("key", F.explode("base").alias("s")).select("key", F.col("s.start").alias("at"), F.lit(1).alias("t"), none.cast("string").alias("line"), "s")
    to_here = Window.partitionBy("key").orderBy("at", "t").rowsBetween(Window.unboundedPreceding, 0)
    both = lines.unionByName(spans).withColumn("line_start", F.max(F.when(F.col("t") == 0, F.col("at"))).over(to_here))
    held = both.groupBy("key", "line_start").agg(F.max("line").alias("line"), F.collect_list("s").alias("spans"))
    return held.where(F.size("spans") > 0)


def contexts(found: DataFrame, reach: int) -> DataFrame:
    """(key, entity, line_start, term, start, end): the words within ``reach`` words of an entity in its line; words that
    share a character with an entity are none."""
    held = settle(entity_lines(found), "lines")
    own = ["key", "line_start"]
    words = held.select(*own, F.posexplode(F.split(_spaced(F.col("line")), " ", -1)).alias("k", "word"))
    before = Window.partitionBy(*own).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("start", (F.col("line_start") + F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))).cast("int"))
    words = words.select(*own, "start", (F.col("start") + F.length("word")).alias("end"), F.lit(0).alias("t"), "k", F.lower("word").alias("term"))
    spans = held.select(*own, F.explode("spans").alias("s")).select(*own, "s.start", "s.end", F.lit(1).alias("t"), F.lit(None).cast("int").alias("k"), F.col("s.value").alias("term"))
    forth = Window.partitionBy(*own).orderBy("start", "t", "end").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*own).orderBy(F.desc("start"), F.desc("t"), F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    span = F.col("t") == 1
    both = words.unionByName(spans).withColumn("place", F.max("k").over(forth)).withColumn("covered", F.max(F.when(span, F.col("end"))).over(forth)).withColumn("next", F.min(F.when(span, F.col("start"))).over(back))
    both = settle(both, "words")
    free = ~F.coalesce((F.col("covered") > F.col("start")) | (F.col("next") < F.col("end")), F.lit(False))
    terms = both.where(~span & free & F.col("term").rlike("[\\p{L}\\p{N}]")).select(*own, F.floor(F.col("k") / reach).alias("bin"), "k", "term", "start", "end")
    entities = both.where(span).select(*own, F.col("term").alias("entity"), "place").distinct()
    entities = entities.withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("place") / reach) + d)))
    near = terms.join(entities, [*own, "bin"]).where(F.abs(F.col("k") - F.col("place")) <= reach)
    return near.select("key", "entity", "line_start", "term", "start", "end").distinct()


def _scanned(rows: DataFrame, support: int, remove: float, generalise: float, smooth: float, reach: int) -> DataFrame:
    """(key, base, more) for each of ``rows`` (id, body, key): base spans and those of revealing terms."""
    found = base_spans(rows).withColumn("base", F.concat("email", "ip", "card", "phone"))
    base = settle(found.select("key", "base", F.when(F.size("base") > 0, F.col("body")).alias("body")), "base")
    beside = settle(contexts(base.where("body is not null"), reach), "contexts")
    lines_of = beside.select("entity", "key", "line_start").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = beside.select("entity", "term", "key", "line_start").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    pairs = settle(pairs.join(lines_of, "entity"), "pairs")

    terms = pairs.select("term").distinct()
    flags = _flags(terms).scalar()
    every = rows.select(F.explode(F.split("body", "\n", -1)).alias("line"))
    place = F.xxhash64("w").bitwiseAND(F.lit((1 << FLAG_BITS) - 1))
    listed = every.select(F.explode(F.array_distinct(_words(F.col("line")))).alias("w")).where(F.call_function("getbit", F.get(flags, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    n_t = listed.groupBy(F.col("w").alias("term")).agg(F.count("*").alias("n_t"))
    total = rows.agg(F.greatest(F.sum(F.size(F.split("body", "\n", -1))), F.lit(2)).cast("double").alias("n")).scalar()
    rate = (F.col("n_et") + smooth * F.col("n_e") / total) / (F.col("n_t") + smooth)
    # An entity in every line tells nothing.
    share = F.when(total > F.col("n_e"), F.try_divide(F.log(total / F.col("n_e") * rate), F.log(total / F.col("n_e")))).otherwise(0.0)
    told = pairs.join(n_t, "term").withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("kind"))
    strongest = beside.join(told, ["entity", "term"]).groupBy("key", "start", "end").agg(F.max("kind").alias("kind"))
    own = F.struct("start", F.when(F.col("kind") == "remove", KINDS.index("remove")).otherwise(KINDS.index("generalise")).alias("ord"), "end", "kind", F.lit("").alias("value"))
    more = strongest.groupBy("key").agg(F.collect_list(own.cast(SPAN)).alias("more"))
    return base.join(more, "key", "left").select("key", "base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")).alias("more"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_rows(df, id_col, text_col).withColumn("key", F.struct("id", F.xxhash64("body").alias("mark")))


def scan_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 1, remove: float = 0.95, generalise: float = 0.8, smooth: float = 0.2, reach: int = 50) -> DataFrame:
    """A row for each input row: its id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (base ones and those of
    revealing terms, as kind:start:end in code points). A term counts if it stands beside the entity in ``support``
    lines or more; ``smooth`` is the weight of the prior. Null and empty texts hold nothing; repeated rows give repeated
    rows."""
    out = _scanned(_keyed(df, id_col, text_col), support, remove, generalise, smooth, reach)
    spans = F.concat("base", "more")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in KINDS[:4]]
    return out.select(F.col("key.id").alias(id_col), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 1, remove: float = 0.95, generalise: float = 0.8, smooth: float = 0.2, reach: int = 50) -> DataFrame:
    """The input with its texts sanitised: entities become their kind, terms to be removed go, those to be generalised
    become [number], if they hold a digit, or [word]. Null texts stay null."""
    scanned = _scanned(_keyed(df, id_col, text_col), support, remove, generalise, smooth, reach)
    spans = scanned.dropDuplicates(["key"]).select(F.col("key").alias("_key"), F.array_sort(F.concat("base", "more")).alias("_spans")).where(F.size("_spans") > 0)
    own = F.col(f"`{text_col}`").cast("string")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("mark"))
    joined = df.withColumn("_own", key).join(spans, F.col("_own").eqNullSafe(F.col("_key")), "left")

    def step(acc: Column, s: Column) -> Column:
        found = F.substr(own, s["start"] + 1, s["end"] - s["start"])
        general = F.when(found.rlike("[0-9]"), "[number]").otherwise("[word]")
        put = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", general).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        more = F.concat(acc["out"], F.array(F.substr(own, acc["at"] + 1, s["start"] - acc["at"]), put))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    finish = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(own, acc["at"] + 1))
    text = F.when(F.col("_spans").isNull(), own).otherwise(F.aggregate("_spans", begin, step, finish))
    return joined.withColumn(text_col, text).drop("_own", "_key", "_spans")
