"""ECMAScript patterns on Spark's Java regex engine.

Three classes differ between the dialects and change results on real text:
``\\b`` sees ASCII word characters only, ``\\s`` includes the Unicode spaces, and
``.`` stops at four line terminators. ``to_java`` spells those out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_ANY = r"[^\n\r\u2028\u2029]"
NOT_SPACE = f"[^{_SPACES}]"

# Next to a piece that can only be a word character, a boundary needs one look.
_NOT_WORD_BEHIND = r"(?<!\w)"
_NOT_WORD_AHEAD = r"(?!\w)"
_BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_WORD_START = re.compile(r"(?:\w|\\[dw])(?![?*]|\{0)")
_WORD_END = re.compile(r"(?:^|[^\\])\w\Z|\\[dw](?:\+|\{[1-9]\d*(?:,\d*)?\})?\Z")


def _scan(pattern: str) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Group spans (open -> close) and the (position, depth) of each ``|``."""
    groups, bars, stack, in_class, i = {}, [], [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            stack.append(i)
        elif c == ")":
            groups[stack.pop()] = i
        elif c == "|":
            bars.append((i, len(stack)))
        i += 1
    return groups, bars


def _alternatives(body: str) -> list[str]:
    cuts = [i for i, depth in _scan(body)[1] if depth == 0]
    return [body[a + 1:b] for a, b in zip([-1, *cuts], [*cuts, len(body)])]


def _word_follows(pattern: str, at: int) -> bool:
    close = _scan(pattern)[0].get(at)
    parts = [pattern[at:]] if close is None else _alternatives(pattern[at + 1:close])
    return all(_WORD_START.match(p) for p in parts)


def _word_precedes(pattern: str, at: int) -> bool:
    opens = {close: start for start, close in _scan(pattern)[0].items()}
    start = opens.get(at - 1)
    parts = [pattern[:at]] if start is None else _alternatives(pattern[start + 1:at - 1])
    return all(_WORD_END.search(p) for p in parts)


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Adapt an ECMAScript pattern (no flags but ``i``) to Java syntax."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        piece = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        after = i + len(piece)
        if piece == r"\s":
            out.append(_SPACES if in_class else f"[{_SPACES}]")
        elif piece == r"\S" and not in_class:
            out.append(f"[^{_SPACES}]")
        elif piece == r"\b" and not in_class:
            if _word_follows(pattern, after):
                out.append(_NOT_WORD_BEHIND)
            elif _word_precedes(pattern, i):
                out.append(_NOT_WORD_AHEAD)
            else:
                out.append(_BOUNDARY)
        elif in_class:
            in_class = piece != "]"
            # nested classes and intersections exist in Java only
            nested = piece == "[" or pattern[i:i + 2] == "&&"
            out.append("\\" + piece if nested else piece)
        elif piece == ".":
            out.append(_ANY)
        elif piece == "$":
            out.append(r"\z")
        else:
            in_class = piece == "["
            out.append(piece)
        i = after
    return ("(?i)" if ignore_case else "") + "".join(out)


def any_literal(column: Column, literals: tuple[str, ...]) -> Column:
    """True where the text holds at least one of the literals; for whole texts."""
    test = F.contains(column, F.lit(literals[0]))
    for text in literals[1:]:
        test = test | F.contains(column, F.lit(text))
    return test


def quoted(literals: tuple[str, ...]) -> str:
    """A Java pattern that matches any of the literals."""
    return "|".join(rf"\Q{text}\E" for text in literals)


def sql_text(text: str) -> str:
    """A SQL string literal. Rule expressions go to Spark as one SQL text each,
    because building them call by call makes plans slow to set up."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_array(values: list[str | None]) -> Column:
    """A foldable array of fixed texts from a single literal; empty reads as null."""
    return F.split(F.lit("\x1f".join(v or "" for v in values)), "\x1f", -1)
