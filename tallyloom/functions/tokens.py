"""Splitting lines into tokens, and the filters on tokens, as column expressions.

A line of ASCII only is split at space, tab, line feed, form feed, carriage return, comma and semicolon; any other line
at Unicode white space, comma and semicolon. So a vertical tab parts tokens only in lines that are not ASCII.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, as the inside of a character class.
WHITE_SPACE = r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same without what every line is split at: only these make lines differ from one another.
_ODD = [chr(c) for c in (0x0B, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ASCII_CUT = r"[ \t\n\f\r,;]+"
_UNICODE_CUT = f"[{WHITE_SPACE},;]+"
_EDGES = rf"\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z"


@dataclass(frozen=True)
class Filters:
    """What happens to a token, in this order: trimmed, dropped if empty, dropped if its length lies in the range.

    The range holds only if both of its ends are given; lengths count characters.
    """

    trim: bool = True
    drop_empty: bool = True
    drop_length_min: int | None = None
    drop_length_max: int | None = None

    @property
    def drops_lengths(self) -> bool:
        return self.drop_length_min is not None and self.drop_length_max is not None


def lines_of(text: Column) -> Column:
    """The lines of a text, cut at line feeds only; a last line that is empty doesn't count. Null gives null."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def has_odd_space(text: Column) -> Column:
    """Whether there is any white space at which only some lines are split. Searches for strings are much cheaper than a pattern."""
    return functools.reduce(lambda x, y: x | y, [text.contains(c) for c in _ODD])


def raw_tokens(line: Column) -> Column:
    """All tokens of a line in order, before any filter. None is empty. Null gives null."""
    ascii_only = F.length(line) == F.octet_length(line)
    parts = F.when(has_odd_space(line) & ~ascii_only, F.split(line, _UNICODE_CUT)).otherwise(F.split(line, _ASCII_CUT))
    return F.array_remove(parts, "")


def text_tokens(text: Column, of_line: Callable[[Column], Column]) -> Column:
    """The tokens of all lines of a text one after another; ``of_line`` says what those of a line are, which keeps plain tokens as they are.

    A text without odd white space is split in one go, as line ends part tokens too.
    """
    return F.when(has_odd_space(text), F.flatten(F.transform(lines_of(text), of_line))).otherwise(F.array_remove(F.split(text, _ASCII_CUT), ""))


def trimmed(token: Column) -> Column:
    return F.regexp_replace(token, _EDGES, "")


def cleaned(tokens: Column, filters: Filters) -> Column:
    """Tokens trimmed, and without empty ones, before lengths count.

    A token has white space at an edge only in the shape of a vertical tab, so others skip the regular expression.
    """
    if filters.trim:
        tokens = F.transform(tokens, lambda t: F.when(t.contains("\x0b"), trimmed(t)).otherwise(t))
        if filters.drop_empty:
            tokens = F.filter(tokens, lambda t: t != "")
    return tokens


def too_short_or_long(token: Column, filters: Filters) -> Column:
    """Whether the token's length lies in the range that is dropped."""
    if not filters.drops_lengths:
        return F.lit(False)
    return F.length(token).between(filters.drop_length_min, filters.drop_length_max)


def kept_tokens(line: Column, filters: Filters = Filters()) -> Column:
    """The tokens of a line that pass all filters, in order."""
    tokens = cleaned(raw_tokens(line), filters)
    return F.filter(tokens, lambda t: ~too_short_or_long(t, filters)) if filters.drops_lengths else tokens
