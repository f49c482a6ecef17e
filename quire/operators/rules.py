"""Rule-based versions of clean-up tasks that otherwise need a model; opt-in, never part of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import group, let, lines, lit, map_lines, strip, sub, unlines
from quire.operators.cleanup import limit_blank_lines

IMAGE_LINE = r"^!\[Figure ([0-9]+)\]\("
CAPTION_LINE = r"^(?:Fig|Figure|FIG|FIGURE)\.?[ \t]*([0-9]+)[.:]"
HEADING_LINE = r"^#{1,6} "
MENTION = r"(?i)(?:^|[^a-z0-9])Fig(?:ure)?\.?[ \t]*([0-9]+)"
_OPEN_END = r"[^.!?: \t][ \t]*$"
#: Lines that are no prose.
_NO_PROSE = r"^[ \t]*(?:#|\||!\[|<|>|```|[-*•] |[0-9]+[.)] |\[[0-9]+\]|(?:Fig|Figure|Table)\.?[ \t]*[0-9])"
_LETTERED = r"(?d)^([A-Z])\.\s+(\S+(?:\s+\S+){0,3}?)[.:]?\s*$"


def lettered_headings(c: Column) -> Column:
    """'A. Short title' lines become headings; lettered sentences stay."""
    return map_lines(c, lambda l, i, ls: F.when(l.rlike(_LETTERED), F.array(sub(l, _LETTERED, "##### $1. $2"))).otherwise(F.array(l)))


def merge_paragraphs(c: Column) -> Column:
    """A paragraph that breaks off before a lower-case continuation is joined with it.

    The line before the blank one ends without one of . ! ? : and, like the line
    after it, belongs to prose: no heading, list, table, image, comment, quotation
    or caption, and not inside a code fence."""

    def joined(ls: Column) -> Column:
        at = lambda i: F.coalesce(F.try_element_at(ls, (i + 1).cast("int")), lit(""))

        def continues(i: Column) -> Column:
            fences = lambda: F.size(F.filter(F.slice(ls, F.lit(1), i.cast("int")), lambda x: x.startswith("```")))
            near = (i >= 2) & at(i).rlike(r"^[a-z]") & (strip(at(i - 1)) == "") & at(i - 2).rlike(_OPEN_END) & ~at(i - 2).rlike(_NO_PROSE)
            return F.when(near, fences() % 2 == 0).otherwise(F.lit(False))

        def piece(l: Column, i: Column) -> Column:
            text = F.when(continues(i + 2), F.rtrim(l)).otherwise(l)
            return F.when(continues(i + 1), lit("")).when(continues(i), F.concat(lit(" "), text)).when(i == 0, text).otherwise(F.concat(lit("\n"), text))

        return F.array_join(F.transform(ls, piece), "")

    return let(lines(c), joined)


def drop_placeholders(c: Column) -> Column:
    """Image placeholder comments removed with their line."""
    return sub(c, r"(?md)^[ \t]*<!-- image -->[ \t]*\n?", "")


def relocate_figures(c: Column) -> Column:
    """Image and caption of a figure moved to the start of the first section that mentions it, the caption in italics.

    The first image line of a number and the first caption line of that number move
    together, wherever they stand; placeholders go, and what is left has at most one
    blank line in a row.  The section is that of the first line after a heading that
    names the figure and is neither image nor caption.  A figure that no such line
    mentions stays where it is; each figure is placed on its own."""

    def placed(ls: Column) -> Column:
        tags = F.transform(ls, lambda l: F.struct(l.alias("l"), group(l, IMAGE_LINE, 1).alias("image"), group(l, CAPTION_LINE, 1).alias("caption"), l.rlike(HEADING_LINE).alias("head")))
        return let(tags, with_tags)

    def with_tags(tags: Column) -> Column:
        first = lambda ok: F.array_position(F.transform(tags, ok), F.lit(True))
        images = F.filter(F.array_distinct(F.transform(tags, lambda t: t["image"])), lambda n: n != "")
        names = lambda t, n: F.array_contains(F.regexp_extract_all(t["l"], lit(MENTION), F.lit(1)), n) & (t["image"] == "") & (t["caption"] == "")

        def figure(n: Column) -> Column:
            heads = F.filter(F.transform(tags, lambda t, i: F.when(t["head"], i + 1)), lambda p: p.isNotNull())
            told = F.array_position(F.transform(tags, lambda t, i: F.coalesce(names(t, n) & (i + 1 >= F.try_element_at(heads, F.lit(1))), F.lit(False))), F.lit(True))
            home = F.array_max(F.filter(heads, lambda h: h <= told))
            return F.struct(first(lambda t: t["image"] == n).alias("image"), first(lambda t: t["caption"] == n).alias("caption"), F.coalesce(home, F.lit(0)).cast("bigint").alias("home"))

        return let(F.filter(F.transform(images, figure), lambda f: f["home"] > 0), lambda fs: emitted(tags, fs))

    def emitted(tags: Column, figs: Column) -> Column:
        line = lambda i: F.element_at(tags, i.cast("int"))["l"]
        moved = F.concat(F.transform(figs, lambda f: f["image"]), F.transform(figs, lambda f: f["caption"]))

        def block(f: Column) -> Column:
            return F.concat(F.array(lit(""), line(f["image"])), F.when(f["caption"] > 0, F.array(F.concat(lit("*"), strip(line(f["caption"])), lit("*")))).otherwise(F.array().cast("array<string>")))

        def each(t: Column, i: Column) -> Column:
            here = F.filter(figs, lambda f: f["home"] == i + 1)
            put = F.when(F.size(here) > 0, F.concat(F.array(t["l"]), F.flatten(F.transform(here, block)), F.array(lit("")))).otherwise(F.array(t["l"]))
            return F.when(F.array_contains(moved, i + 1), F.array().cast("array<string>")).otherwise(put)

        return limit_blank_lines(unlines(F.flatten(F.transform(tags, each))))

    return let(drop_placeholders(c), lambda t: F.when(t.rlike(r"(?m)" + IMAGE_LINE), let(lines(t), placed)).otherwise(t))


def drop_caption_noise(c: Column, words: int = 3) -> Column:
    """The run of lines of a few words directly above a caption removed, all of it.

    The lines are written as one letter each, so a run is found by one pattern."""

    def kept(ls: Column) -> Column:
        short = lambda l: l.rlike(rf"^[ \t]*[^ \t#|!<\-*`][^ \t]*(?:[ \t]+[^ \t]+){{0,{words - 1}}}[ \t]*$")
        kinds = F.array_join(F.transform(ls, lambda l: F.when(l.rlike(CAPTION_LINE), "C").when(short(l), "S").otherwise("N")), "")
        runs = F.split(kinds, r"(?<=S)(?=[CN])|(?<=[CN])(?=S)")
        noise = lambda rs: F.array_join(F.transform(rs, lambda r, i: F.when(r.startswith("S") & F.coalesce(F.try_element_at(rs, (i + 2).cast("int")), lit("")).startswith("C"), F.repeat(lit("D"), F.length(r))).otherwise(r)), "")
        return let(F.split(let(runs, noise), ""), lambda ks: unlines(F.filter(ls, lambda l, i: F.element_at(ks, (i + 1).cast("int")) != "D")))

    return F.when(c.rlike(r"(?m)" + CAPTION_LINE), let(lines(c), kept)).otherwise(c)
