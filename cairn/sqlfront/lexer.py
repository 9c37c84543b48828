"""Text to typed tokens.  Anything outside the dialect is an error; nothing is skipped but white space and comments."""

from __future__ import annotations

import re
from dataclasses import dataclass

from cairn.errors import SqlSyntaxError

# The dialect's reserved words.
RESERVED = frozenset("SELECT FROM WHERE BETWEEN AND INSERT INTO VALUES CREATE TABLE DROP INDEX DELETE FILE IN POINT RADIUS JOIN INNER ON GROUP BY ORDER ASC DESC AS".split())
#: Words with a meaning in some places only; elsewhere they are names.
SOFT = frozenset("K INT FLOAT TEXT BPLUSTREE HASH SEQUENTIAL HEAP RTREE COUNT SUM AVG MIN MAX".split())

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
      | (?P<number>[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)(?![\w.])
      | (?P<text>'(?:[^']|'')*')
      | (?P<word>[^\W\d]\w*)
      | (?P<sign>[(),;=*.])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    """kind is number, text, word, sign or end; value is the number or text, the word as written, or the sign."""

    kind: str
    value: int | float | str
    at: int

    @property
    def word(self) -> str:
        """The word in upper case, else an empty string."""
        return str(self.value).upper() if self.kind == "word" else ""


def tokens(text: str) -> list[Token]:
    """All tokens of a script, with an end token."""
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise SqlSyntaxError(f"unexpected {text[at]!r} at {at}")
        kind, raw = str(found.lastgroup), found[0]
        if kind == "number":
            out.append(Token(kind, int(raw) if re.fullmatch(r"[+-]?\d+", raw) else float(raw), at))
        elif kind == "text":
            out.append(Token(kind, raw[1:-1].replace("''", "'"), at))
        elif kind != "space":
            out.append(Token(kind, raw, at))
        at = found.end()
    return [*out, Token("end", "", len(text))]
