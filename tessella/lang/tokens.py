"""Tokens of the query language.

Strings stand in single or double quotes and have no escapes; numbers may have a sign, a fraction and an exponent;
``--`` begins a comment unless ``>`` follows. Words of RESERVED can't name tables or fields, other keywords can.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessella.errors import QueryError

RESERVED = frozenset("SELECT FROM WHERE ORDER BY ASC DESC LIMIT AND CREATE SET RELATE DELETE UPDATE COUNT GRAPH ON IS NOT TRUE FALSE NONE NULL".split())

_TOKEN = re.compile(
    r"""(?P<space>\s+|--(?!>)[^\n]*)
      | (?P<out>->) | (?P<back><-)
      | (?P<op><=|>=|!=|=|<|>)
      | (?P<path>::)
      | (?P<mark>[*,:;.()\[\]])
      | (?P<string>'[^']*'|"[^"]*")
      | (?P<number>-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # out, back, op, path, mark, string, int, float, word
    text: str
    at: int

    @property
    def keyword(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            what = "unterminated string" if text[at] in "'\"" else f"unexpected character {text[at]!r}"
            raise QueryError(f"{what} at position {at}")
        kind, s = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token("string", s[1:-1], at))
        elif kind == "number":
            out.append(Token("float" if re.search(r"[.eE]", s) else "int", s, at))
        elif kind != "space":
            out.append(Token(kind, s, at))
        at = m.end()
    return out
