"""Heading repair (``Column -> Column``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import D, S, group, let, lit, map_lines, strip, sub, sub_first

MAX_TITLE = 120
_NUMBERED = rf"({D}+(?:\.{D}+)+){S}+"
TITLE_LINE = rf"(?d)^{_NUMBERED}([A-Z][^.]+?)\.?{S}*$"
TITLE_AND_BODY = rf"(?d)^{_NUMBERED}([A-Z][^.]{{2,50}})\.{S}+(.+)$"
_BULLET_TITLE = rf"(?d)^-{S}*({D}+[).]){S}*(.+):{S}*$"
_BULLET_ITEM = rf"(?d)^-{S}*({D}+)\){S}*(.+)$"
_LIST_LINE = rf"(?d)^(?:[-*•]{S}|{D}+[).]{S})"


def header_level(numbering: Column) -> Column:
    """Heading level of a dotted number: one more than its parts, six at most."""
    return F.least(F.size(F.split(numbering, "[.]")) + 1, F.lit(6))


def is_section_title(title: Column) -> Column:
    """Short enough and not several sentences."""
    stops = (F.length(title) - F.length(F.replace(title, lit(". "), lit("")))) / 2
    return (F.length(title) <= MAX_TITLE) & (stops <= 1)


def abstract_heading(c: Column) -> Column:
    """First 'Abstract -' at the start of a line becomes a heading."""
    return sub_first(c, "mdiu", rf"^(?:#+{S}*)?Abstract{S}*[-–—]{S}*", "## Abstract\n\n")


def index_terms_heading(c: Column) -> Column:
    """First 'Index Terms -' at the start of a line becomes a heading."""
    return sub_first(c, "mdiu", rf"^(?:#+{S}*)?Index Terms{S}*[-–—]{S}*", "## Index Terms\n\n")


def _heading(line: Column, pattern: str) -> Column:
    number = group(line, pattern, 1)
    return F.concat(F.repeat(lit("#"), header_level(number)), lit(" "), number, lit(" "), strip(group(line, pattern, 2)))


def hierarchical_headings(c: Column) -> Column:
    """Lines such as '3.1 Title' become headings; what follows the title on the line becomes a paragraph."""

    def each(l: Column, i: Column, ls: Column) -> Column:
        s = strip(l)
        numbered = l.rlike(rf"^{S}*{D}")  # all other lines stay
        title = s.rlike(TITLE_LINE) & is_section_title(strip(group(s, TITLE_LINE, 2)))
        following = strip(F.coalesce(F.try_element_at(ls, (i + 2).cast("int")), lit(""))) != ""
        return (
            F.when(~numbered, F.array(l))
            .when(title, F.when(following, F.array(_heading(s, TITLE_LINE), lit(""))).otherwise(F.array(_heading(s, TITLE_LINE))))
            .when(s.rlike(TITLE_AND_BODY), F.array(_heading(s, TITLE_AND_BODY), lit(""), strip(group(s, TITLE_AND_BODY, 3))))
            .otherwise(F.array(l))
        )

    return map_lines(c, each)


def numbered_bullets(c: Column) -> Column:
    """'- 1) Title:' over text becomes a heading, other '- 2) text' a numbered item."""

    def each(l: Column, i: Column, ls: Column) -> Column:
        after = F.filter(F.slice(ls, (i + 2).cast("int"), F.greatest(F.size(ls) - i - 1, F.lit(0)).cast("int")), lambda x: strip(x) != "")
        next_line = strip(F.coalesce(F.try_element_at(after, F.lit(1)), lit("")))
        titled = F.when(l.rlike(_BULLET_TITLE), (next_line != "") & ~next_line.rlike(_LIST_LINE)).otherwise(F.lit(False))
        return (
            F.when(~l.startswith("-"), F.array(l))
            .when(titled, F.array(F.concat(lit("### "), group(l, _BULLET_TITLE, 1), lit(" "), group(l, _BULLET_TITLE, 2)), lit("")))
            .when(l.rlike(_BULLET_ITEM), F.array(sub(l, _BULLET_ITEM, "$1. $2")))
            .otherwise(F.array(l))
        )

    return map_lines(c, each)


def process_sections(c: Column) -> Column:
    """All heading repairs in order."""
    return let(abstract_heading(c), lambda a: let(index_terms_heading(a), lambda b: let(hierarchical_headings(b), numbered_bullets)))
