"""Spacing and counting of reference entries (``Column -> Column``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import S, let, lines, lit, unlines
from quire.operators.citations import split_after_heading

# What an entry begins with.
ENTRY = rf"^{S}*(?:<a[^>]*></a>)?(?:-{S}*)?\[(\d{{1,3}})\]"
_ANY_ENTRY = rf"(?m)^{S}*(?:<a[^>]*></a>)?\[([0-9]+)\]"


def space_entries(c: Column) -> Column:
    """A blank line before each entry that follows another without one.

    The text is cut at blank lines; in a run between them every entry after the
    first gets its blank line, so no state is carried from line to line."""

    def run(piece: Column) -> Column:
        def spaced(ls: Column) -> Column:
            first = F.array_position(F.transform(ls, lambda l: l.rlike(ENTRY)), F.lit(True))
            return unlines(F.flatten(F.transform(ls, lambda l, i: F.when((first > 0) & (i >= first) & l.rlike(ENTRY), F.array(lit(""), l)).otherwise(F.array(l)))))

        return let(lines(piece), spaced)

    blank = r"[\x09\x0B-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*"
    return unlines(F.transform(F.split(c, rf"\n(?={blank}(?:\n|\z))", -1), run))


def process_bibliography(c: Column) -> Column:
    """Entries after the references heading spaced."""
    return let(split_after_heading(c), lambda p: F.when(p["entries"].isNotNull(), F.concat(p["head"], space_entries(p["entries"]))).otherwise(p["head"]))


def reference_count(c: Column) -> Column:
    """Entries in the whole text."""
    return F.regexp_count(c, lit(_ANY_ENTRY)).cast("bigint")
