"""Answers given as text, read back into what a viewer should show: the name asked about, the names and edges in it.

Answers come from ``operators.text``: a heading ``NAME: upstream, ...``, then a line for each edge. Everything is read by
column functions, a row for each answer; answers that say what went wrong have no focus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How answers begin that hold no edges, whichever tool gave them.
ERRORS = ("Ambiguous:", "No match:", "No path:", "No engine JSON", "Engine JSON is corrupted", "Engine JSON not found", "No column matching", "No table matching", "No path from", "Use two different tables.", "expected engine JSON")
HEADING = r"(?m)^(\S[^\n]*?): (?:upstream|downstream), depth"
LINE = r"(?m)^  (\S+) -> (\S+) \[(\w+)\]$"


def focusable(text: Column) -> Column:
    """Is a text an answer with something to show?"""
    body = F.ltrim(F.coalesce(text, F.lit("")))
    wrong = F.lit(False)
    for e in ERRORS:
        wrong = wrong | F.startswith(body, F.lit(e))
    return (F.trim(body) != "") & ~wrong


def focus(answers: DataFrame, text: str = "text", most: int = 500) -> DataFrame:
    """``answers`` that are focusable, with seed, edges (source, target, kind; ``most`` at most), columns (every name
    once, regardless of case, the seed first) and truncated (the answer was cut, or had more edges)."""
    body = F.col(text)
    part = lambda k: F.regexp_extract_all(body, F.lit(LINE), k)
    edges = F.zip_with(F.arrays_zip(part(1).alias("source"), part(2).alias("target")), part(3), lambda e, kind: F.struct(e["source"].alias("source"), e["target"].alias("target"), kind.alias("kind")))
    shown = answers.where(focusable(body)).withColumn("_every", edges).withColumn("seed", F.nullif(F.regexp_extract(body, HEADING, 1), F.lit("")))
    shown = shown.withColumn("edges", F.slice("_every", 1, most))
    names = F.concat(F.array("seed"), F.flatten(F.transform("edges", lambda e: F.array(e["source"], e["target"]))))
    shown = shown.withColumn("_names", F.array_distinct(F.filter(names, lambda n: n.isNotNull())))
    # Spellings of a name stand together, the first one in front; sorting keeps this near linear in long answers.
    shown = shown.withColumn("_sorted", F.sort_array(F.transform("_names", lambda n, k: F.struct(F.upper(n).alias("folded"), k.alias("at"), n.alias("name")))))
    first = F.filter("_sorted", lambda s, k: (k == 0) | (F.get("_sorted", k - 1)["folded"] != s["folded"]))
    shown = shown.withColumn("_first", F.sort_array(F.transform(first, lambda s: F.struct(s["at"].alias("at"), s["name"].alias("name")))))
    shown = shown.withColumn("columns", F.transform("_first", lambda s: s["name"]))
    return shown.withColumn("truncated", (F.size("_every") > most) | body.rlike(r"(?m)^\.\.\. \d+ lines beyond")).drop("_every", "_names", "_sorted", "_first")


def capped(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows, each with ``truncated``: were there more?"""
    some = rows.orderBy(*order).limit(most + 1)
    numbered = some.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most)
    return numbered.where(F.col("_n") <= most).drop("_n")


class FocusHub:
    """The newest focus of a session: published, read, waited for, cleared; every event has the next number."""

    def __init__(self):
        import threading

        self._changed, self.number, self.event = threading.Condition(), 0, None

    def publish(self, event: dict) -> int:
        with self._changed:
            self.number, self.event = self.number + 1, dict(event)
            self._changed.notify_all()
            return self.number

    def snapshot(self) -> tuple[int, dict | None]:
        with self._changed:
            return self.number, self.event

    def wait_after(self, number: int, timeout: float) -> tuple[int, dict | None] | None:
        """The newest event if it comes after ``number`` within ``timeout`` seconds."""
        with self._changed:
            return (self.number, self.event) if self._changed.wait_for(lambda: self.number > number, timeout) else None

    def clear(self) -> None:
        with self._changed:
            self.number, self.event = self.number + 1, None
            self._changed.notify_all()
