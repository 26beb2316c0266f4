"""Column functions of the lineage model: names, kinds, places, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds that carry a value, and the names other vocabularies use for a kind.
VALUE_KINDS = ("DIRECT", "TRANSFORM", "AGGREGATE", "ANALYTIC", "VIA_CTE", "VIA_VARIABLE", "VIA_PIPELINE")
ALIASES = {"INDIRECT_FILTER": "FILTER", "DYNAMIC": "UNRESOLVED", "DYNAMIC_SQL": "UNRESOLVED", "EXECUTE_IMMEDIATE": "UNRESOLVED"}
OTHER_KINDS = ("FILTER", "CONSTANT", "SEVERED", "UNRESOLVED", "CALL")
VIEWER_TYPES = {"FILTER": "filters", "UNRESOLVED": "unresolved", "CALL": "calls"}


def mapped(column: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in mapping.items() for x in p])[column], column if default is None else default)


def kind(column: Column) -> Column:
    """The canonical kind: upper case, aliases undone."""
    return mapped(F.upper(F.trim(column)), ALIASES)


def coarse(column: Column) -> Column:
    """VALUE, FILTER or the kind itself."""
    return F.when(kind(column).isin(*VALUE_KINDS), "VALUE").otherwise(kind(column))


def viewer_type(column: Column) -> Column:
    return mapped(kind(column), VIEWER_TYPES, F.when(kind(column).isin(*VALUE_KINDS), "flows").otherwise("other"))


def parse_kinds(spec: str) -> set[str]:
    """'value', 'all', or a comma list of kinds and these words."""
    out: set[str] = set()
    for word in (w.strip().upper() for w in spec.split(",") if w.strip()):
        if word == "ALL":
            out |= {*VALUE_KINDS, *OTHER_KINDS}
        elif word == "VALUE":
            out |= set(VALUE_KINDS)
        elif ALIASES.get(word, word) in {*VALUE_KINDS, *OTHER_KINDS}:
            out.add(ALIASES.get(word, word))
        else:
            raise ValueError(f"unknown kind: {word}")
    return out


def kind_allowed(column: Column, kinds: set[str], at_seed: Column) -> Column:
    return kind(column).isin(*sorted(kinds)) | (at_seed & kind(column).isin("UNRESOLVED", "SEVERED"))


def fqn(table: Column, column: Column) -> Column:
    """TABLE.COLUMN, or TABLE.* for a whole table."""
    return F.concat(table, F.lit("."), F.coalesce(column, F.lit("*")))


def table_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def column_of(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def link_of(table: Column) -> Column:
    """The database link of NAME@LINK; null unless there is exactly one mark with both sides."""
    found = F.regexp_extract(table, r"^[^@]+@([^@]+)$", 1)
    return F.when(found != "", found)


def schema_of(table: Column) -> Column:
    return F.when(F.instr(table, ".") > 0, F.substring_index(table, ".", 1)).otherwise("")


def short_name(table: Column) -> Column:
    return F.when(F.instr(table, ".") > 0, F.expr(f"substring({table._jc.toString()}, instr({table._jc.toString()}, '.') + 1)")).otherwise(table)


def object_id(name: Column) -> Column:
    return F.lower(name)


def place(file: Column, line: Column, unit: Column, routine: Column) -> Column:
    """file:line UNIT.ROUTINE"""
    return F.concat_ws(" ", F.concat_ws(":", file, line.cast("string")), F.concat_ws(".", unit, routine))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_id(*parts: Column) -> Column:
    """md5 of the parts joined by bars; null counts as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def pipeline_key(path: Column) -> Column:
    """The names of a pipeline path such as /NAME;type;dim/NAME;type;dim."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.split(s, ";")[0]), "/")


def fnv1a(column: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-8 bytes, as eight hex digits."""
    hexed = F.hex(F.encode(column, "UTF-8"))
    steps = F.when(F.length(hexed) > 0, F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda k: F.conv(F.substr(hexed, 2 * k + 1, F.lit(2)), 16, 10).cast("long")
    got = F.aggregate(steps, F.lit(2166136261).cast("long"), lambda acc, k: (acc.bitwiseXOR(byte(k)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lower(F.lpad(F.hex(got), 8, "0"))


def oracle_literal(text: Column) -> Column:
    """What a plain or quote-operator string literal says."""
    plain = F.regexp_replace(F.regexp_extract(text, r"(?s)^[nN]?'(.*)'$", 1), "''", "'")
    quoted = F.regexp_extract(text, r"(?s)^[nN]?[qQ]'.(.*).'$", 1)
    return F.when(text.rlike(r"(?s)^[nN]?[qQ]'..*.'$"), quoted).otherwise(plain)


def digest(content: Column) -> Column:
    """A file's digest as it is written in records."""
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def utc_stamp(at: Column) -> Column:
    """A point in time as records write it, in the session's zone, which is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bare_clause(text: Column) -> Column:
    """A predicate without the label of its clause and without outer-join markers."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^(WHERE|GROUP BY|HAVING|JOIN|START WITH|CONNECT BY|MERGE ON|PREDICATE|WHEN)\s+", ""), r"\s*\(\+\)", ""))
