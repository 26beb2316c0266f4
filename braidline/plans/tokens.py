"""Tokens of Oracle SQL and PL/SQL text, and their nesting in parentheses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Quote-operator delimiters that close with another character than they open with (fixed by the language).
PAIRED = {"[": "]", "(": ")", "{": "}", "<": ">"}

LEXER = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<quoted>[nN]?[qQ]'(?P<open>.))|(?P<string>[nN]?'(?:[^']|'')*(?:'|\Z))
    |(?P<ident>"[^"]*")|(?P<number>\d+(?:\.(?!\.)\d*)?(?:[eE][+-]?\d+)?)|(?P<word>:?[^\W\d][\w$\#]*)|(?P<op>:=|=>|\|\||<=|>=|<>|!=|\.\.|\(\s*\+\s*\)|.)""",
    re.VERBOSE | re.DOTALL,
)


@dataclass
class Token:
    """kind: w word, i quoted identifier, s string, n number, o operator, g group."""

    kind: str
    text: str
    start: int
    end: int
    inner: list[Token] = field(default_factory=list)

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "w" else ""

    def is_op(self, text: str) -> bool:
        return self.kind == "o" and self.text == text


class Unbalanced(ValueError):
    """Parentheses or quotes that don't close."""


def tokens(sql: str) -> list[Token]:
    """Flat tokens; comments, hints and old outer-join marks are left out."""
    out, at = [], 0
    while at < len(sql):
        m = LEXER.match(sql, at)
        kind, end = m.lastgroup, m.end()
        if m.group("quoted"):
            close = PAIRED.get(m["open"], m["open"]) + "'"
            found = sql.find(close, end)
            if found < 0:
                raise Unbalanced(f"quote at {at} has no end")
            end = found + 2
            out.append(Token("s", sql[at:end], at, end))
        elif kind == "string":
            if not (sql[end - 1] == "'" and end - at >= 2):
                raise Unbalanced(f"quote at {at} has no end")
            out.append(Token("s", m[0], at, end))
        elif kind == "ident":
            out.append(Token("i", m[0][1:-1], at, end))
        elif kind in ("number", "word"):
            out.append(Token("n" if kind == "number" else "w", m[0], at, end))
        elif kind == "op" and not (m[0][0] == "(" and "+" in m[0]):
            out.append(Token("o", m[0], at, end))
        at = end
    return out


def nested(flat: list[Token]) -> list[Token]:
    """The same with every parenthesis as a group."""
    stack: list[list[Token]] = [[]]
    opened: list[Token] = []
    for t in flat:
        if t.is_op("("):
            stack.append([])
            opened.append(t)
        elif t.is_op(")"):
            if not opened:
                raise Unbalanced(f"parenthesis at {t.start} closes nothing")
            inner, start = stack.pop(), opened.pop()
            stack[-1].append(Token("g", "()", start.start, t.end, inner))
        else:
            stack[-1].append(t)
    if opened:
        raise Unbalanced(f"parenthesis at {opened[-1].start} stays open")
    return stack[0]


def split(items: list[Token], op: str = ",") -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for t in items:
        if t.is_op(op):
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def literal_text(token: Token) -> str:
    """What a string literal says: doubled quotes, national strings and the quote operator undone."""
    text = token.text.lstrip("nN") if token.text[:1] in "nN" else token.text
    if text[:1] in "qQ":
        return text[3:-2]
    return text[1:-1].replace("''", "'")
