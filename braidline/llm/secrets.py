"""Secret scans with multipart credential linking.

Base findings stand on their own: assignments of secrets, access identifiers, long hex strings. Weak candidates (other
identifiers, random-looking strings, endpoints) mean something only together: the scope of a finding is the text up to
``scope`` characters around it, and scopes are joined as intervals, in texts without base findings, too. Identifiers are
the access ones and the weak ones, secrets the other base findings and the weak ones. A weak secret is reported where an
identifier is in scope, a weak identifier where a secret is, an endpoint where both are, and then both. The join sorts
the intervals of one text and moves along them; no pairs are listed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sha_hex, small_batches, span_list, text_rows

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|key_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,128})""", re.IGNORECASE | re.ASCII)
#: Behind a single = or :, too, but not the // of a URL.
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?<!==)(?!(?<=:)//)[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
USER = re.compile(r"://([^\s:/@\"'<>]+):[^\s/@\"'<>]+@")
ENDPOINT = re.compile(r"""(?:https?|s3|jdbc:[a-z0-9]+|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,256}|\b(?:host|endpoint|server|region|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:_-]{3,128}""", re.IGNORECASE | re.ASCII)
ORDER = {k: n for n, k in enumerate(("assign", "access", "hex", "weak_id", "weak_secret", "endpoint"))}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping within a kind; matches that fail their test are dropped."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def random_looking(word: str) -> bool:
    """Several kinds of characters and at least 3.5 bits a character."""
    n = len(word)
    kinds = any(c.islower() for c in word) + any(c.isupper() for c in word) + any(c.isdigit() for c in word)
    return kinds >= 2 and -sum(c / n * math.log2(c / n) for c in Counter(word).values()) >= 3.5


class Scopes:
    """Where intervals of one sort lie: ``near`` tells whether one of them touches a scope."""

    def __init__(self, spans: list[tuple[str, int, int]], scope: int):
        spans = sorted((a, b) for _, a, b in spans)
        self.starts, self.ends, self.scope = [a for a, _ in spans], [], scope
        for _, b in spans:  # the furthest end so far: sorted, too
            self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def near(self, span: tuple[str, int, int]) -> bool:
        _, a, b = span
        return bisect_right(self.starts, b + self.scope) > bisect_left(self.ends, a - self.scope)

    def over(self, span: tuple[str, int, int]) -> bool:
        """Does one of them share a character with the span?"""
        _, a, b = span
        return bisect_right(self.starts, b - 1) > bisect_left(self.ends, a + 1)


def linked_spans(text: str, base: list[tuple[str, int, int]], scope: int) -> list[tuple[str, int, int]]:
    """Weak candidates with their complement in scope. Every link has an identifier and a secret, base or weak."""
    taken = Scopes(base, 0)
    strong = [s for s in base if s[0] != "access"]
    access = [s for s in base if s[0] == "access"]
    weak = [s for m in WEAK_SECRET.finditer(text) if random_looking(m[0]) and not taken.over(s := ("weak_secret", m.start(), m.end()))]
    if not strong and not weak:
        return []
    ids = [s for m in WEAK_ID.finditer(text) if not taken.over(s := ("weak_id", m.start(), m.end()))]
    users = [s for m in USER.finditer(text) if not taken.over(s := ("weak_id", m.start(1), m.end(1)))] if "://" in text else []
    if not access and not ids and not users:
        return []
    ends = [s for m in ENDPOINT.finditer(text) if not taken.over(s := ("endpoint", m.start(), m.end()))]
    # What an identifier or an endpoint is named by isn't a secret beside it; parts of a URL may be.
    named = Scopes(ids + [s for s in ends if "://" not in text[s[1] : s[2]]], 0)
    weak = [s for s in weak if not named.over(s)]
    known, secrets = Scopes(access + ids + users, scope), Scopes(strong + weak, scope)
    ends = [s for s in ends if known.near(s) and secrets.near(s)]
    met = Scopes(ends, scope)
    ids = [s for s in ids + users if secrets.near(s) or met.near(s)]
    weak = [s for s in weak if known.near(s) or met.near(s)]
    inside = Scopes(ends, 0)
    ids = [s for s in ids if text[s[1] - 3 : s[1]] != "://" or not inside.over(s)]
    inside = Scopes(ends + ids, 0)
    return ids + [s for s in weak if not inside.over(s)] + ends


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """A row for each input row: its id, n_assign, n_access, n_hex, base_sha256, spans (all, base and linked, as
    kind:start:end in code points) and findings (kind, start, end, the text found). Null and empty texts hold nothing;
    repeated rows give repeated rows. Nothing is shuffled, and a text is scanned whole."""
    small_batches(df.sparkSession)
    rows = text_rows(df, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    part = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())])

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {"assign": [], "access": [], "hex": []}
            digest, spans, findings = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                every = base + linked_spans(text, base, scope)
                for k, v in counts.items():
                    v.append(sum(s[0] == k for s in base))
                digest.append(sha_hex(span_list(base, ORDER)))
                spans.append(span_list(every, ORDER))
                findings.append([{"kind": k, "start": a, "end": b, "found": text[a:b]} for k, a, b in sorted(every, key=lambda s: s[1])])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(digest), pa.array(spans), pa.array(findings, pa.list_(part))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"])

    return rows.mapInArrow(run, f"id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<kind string, start long, end long, found string>>").withColumnRenamed("id", id_col)
