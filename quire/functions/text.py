"""Column helpers with the whitespace and digit rules of Unicode text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as whitespace in a Unicode string, for trim and for character classes.
WS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
S = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
D = r"\p{Nd}"


def lit(s: str) -> Column:
    """A literal; short for the many patterns."""
    return F.lit(s)


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode whitespace."""
    return F.trim(c, lit(WS))


def sub(c: Column, pattern: str, replacement: str) -> Column:
    """Every match replaced."""
    return F.regexp_replace(c, lit(pattern), lit(replacement))


def sub_first(c: Column, flags: str, pattern: str, replacement: str) -> Column:
    """First match replaced; the pattern's own groups begin at 2."""
    return F.regexp_replace(c, lit(rf"(?s{flags})\A(.*?){pattern}"), lit("$1" + replacement))


def group(c: Column, pattern: str, n: int) -> Column:
    """Group ``n`` of the first match, '' without one."""
    return F.regexp_extract(c, pattern, n)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, so that nested steps do not multiply the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(c: Column) -> Column:
    """Lines of a text; the empty text has one empty line."""
    return F.split(c, "\n")


def unlines(c: Column) -> Column:
    """Text of an array of lines."""
    return F.array_join(c, "\n")


def map_lines(c: Column, each: Callable[[Column, Column, Column], Column]) -> Column:
    """Replace each line by an array of lines: ``each(line, index, all lines)``."""
    return let(lines(c), lambda ls: unlines(F.flatten(F.transform(ls, lambda l, i: each(l, i, ls)))))
