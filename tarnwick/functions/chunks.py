"""Splitting of long texts into bounded chunks, as expressions over arrays: no Python, no shuffle.

Paragraphs (parted by blank lines) up to the limit stay whole. A longer one is split at the coarsest
mark that it holds (heading, end of a fence, rule, line, space), a mark beginning its piece; neighbouring
pieces are packed while they fit the limit together, and a piece that is too long by itself is split at the next finer mark. What
has no mark left is cut at the limit. As pieces come in order and a packed chunk is never opened again, the recursion
is one fold over the pieces for each kind of mark.

Null and blank texts have no chunks. The unit separator U+001F counts as a space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1000
CUT = "\x1f"
# The marks of markdown from coarse to fine, as regular expressions; blank lines come before them, lines and spaces after.
MARKS = ("\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n")
FINE = ("\n", " ")
BLANK = " \t\n\x0b\f\r"


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK))


def _pieces(text: Column, mark: str) -> Column:
    """A text cut before each mark."""
    return F.filter(F.split(F.regexp_replace(text, f"({mark})", f"{CUT}$1"), CUT), lambda p: p != "")


def _packed(pieces: Column, limit: int) -> Column:
    """Neighbours joined while they fit together."""

    def add(done: Column, piece: Column) -> Column:
        fits = F.length(F.element_at(done, -1)) + F.length(piece) <= limit
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), piece)))
        return F.when(fits, joined).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, F.array(F.lit("")), add)


def _lines(text: Column, mark: str, limit: int) -> Column:
    """The packed pieces of a mark of one character, of which a text may hold thousands: the longest run that ends
    before a mark and fits, or else all up to the next mark."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{limit}}}(?={mark}|\\z)|.+?(?={mark}|\\z)"), F.lit(0))


def _cut(text: Column, limit: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / limit).cast("int")), lambda i: F.substring(text, i * limit + 1, F.lit(limit)))


def _finer(chunks: Column, limit: int, split: Callable[[Column], Column]) -> Column:
    """The chunks with those split that are too long."""
    return F.flatten(F.transform(chunks, lambda t: F.when(F.length(t) > limit, split(t)).otherwise(F.array(t))))


def chunk_recursive(text: str | Column, limit: int = LIMIT) -> Column:
    """The chunks of a text, of at most ``limit`` characters each, without white space around them."""
    whole = F.replace(F.col(text) if isinstance(text, str) else text, F.lit(CUT), F.lit(" "))
    chunks = F.filter(F.transform(F.split(whole, "\n\n"), _trimmed), lambda b: b != "")
    for mark in MARKS:
        begin = mark.replace("\\", "")[:2]
        # most texts hold no such mark, which a search of its first characters tells
        chunks = _finer(chunks, limit, lambda t, mark=mark, begin=begin: F.when(F.contains(t, F.lit(begin)), _packed(_pieces(t, mark), limit)).otherwise(F.array(t)))
    for mark in FINE:
        chunks = _finer(chunks, limit, lambda t, mark=mark: _lines(t, mark, limit))
    chunks = _finer(chunks, limit, lambda t: _cut(t, limit))
    return F.coalesce(F.filter(F.transform(chunks, _trimmed), lambda c: c != ""), F.array().cast("array<string>"))
