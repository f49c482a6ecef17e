"""Character and whitespace clean-up of a markdown document (``Column -> Column``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import S, WS, lines, lit, sub, unlines

# Joined letters and the dash that are spelled out.
SPELLED_OUT = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "–": "-"}


def spell_out_ligatures(c: Column) -> Column:
    """Ligatures as letters, the en dash as a hyphen."""
    for old, new in SPELLED_OUT.items():
        c = F.replace(c, lit(old), lit(new))
    return c


def limit_blank_lines(c: Column) -> Column:
    """At most one blank line in a row."""
    return sub(c, r"\n{3,}", "\n\n")


def strip_line_ends(c: Column) -> Column:
    """No whitespace at the end of a line."""
    return unlines(F.transform(lines(c), lambda l: F.rtrim(l, lit(WS))))


def cleanup_text(c: Column) -> Column:
    """Ligatures, blank lines and line ends, in this order; blank lines that hold whitespace are not counted as blank before the line ends are stripped."""
    return strip_line_ends(limit_blank_lines(spell_out_ligatures(c)))


def join_hyphenated(c: Column) -> Column:
    """Words hyphenated over a line break joined, the indent of the second line dropped."""
    return sub(c, rf"([\p{{L}}\p{{N}}_]+)-\n{S}*([a-z][\p{{L}}\p{{N}}_]*)", "$1$2")
