"""Citation ranges, links and reference anchors (``Column -> Column``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import S, let, lit, sub

#: Longest range that is spelled out; longer ones stay as they are.
MAX_RANGE = 10_000
# A range of citations, and the headings of references by priority.
_RANGE = rf"\[([0-9]+)\]{S}*[-–—]{S}*\[([0-9]+)\]"
#: The first kind that occurs wins, wherever it stands.
HEADINGS = tuple(rf"^{h}{S}*$" for h in ("## References", "## REFERENCES", "# References", "References"))


def expand_ranges(c: Column) -> Column:
    """'[1]-[3]' spelled out as '[1], [2], [3]', the bounds in either order."""

    def spelled(a: Column, b: Column, whole: Column) -> Column:
        lo, hi = F.least(a.try_cast("bigint"), b.try_cast("bigint")), F.greatest(a.try_cast("bigint"), b.try_cast("bigint"))
        text = F.array_join(F.transform(F.sequence(lo, hi), lambda n: F.concat(lit("["), n.cast("string"), lit("]"))), ", ")
        return F.when(hi - lo <= MAX_RANGE, text).otherwise(whole)

    def joined(parts: Column) -> Column:
        found = F.arrays_zip(
            F.regexp_extract_all(c, lit(_RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(c, lit(_RANGE), F.lit(2)).alias("b"), F.regexp_extract_all(c, lit(_RANGE), F.lit(0)).alias("w")
        )
        middle = F.transform(found, lambda f, i: F.concat(spelled(f["a"], f["b"], f["w"]), F.element_at(parts, (i + 2).cast("int"))))
        return F.concat(F.element_at(parts, 1), F.array_join(middle, ""))

    return F.when(c.rlike(_RANGE), let(F.split(c, _RANGE, -1), joined)).otherwise(c)


def link_citations(c: Column) -> Column:
    """'[7]' becomes a link to its reference, unless it is one already or follows a bracket."""
    return sub(c, r"(?<!\])(?<!\]\()(?<!!\[)\[(\d{1,3})\](?!\()", "[[$1]](#ref-$1)")


def anchor_references(c: Column) -> Column:
    """An anchor before each '[7]' at the start of a line, unless the 50 characters before it hold that anchor."""
    plain = sub(c, rf"(?md)^-{S}*\[(\d{{1,3}})\]", "[$1]")

    def each(chunks: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            n = F.regexp_extract(x, r"^\[(\d{1,3})\]", 1)
            before = F.right(F.array_join(F.slice(chunks, F.greatest(i - 13, F.lit(1)).cast("int"), F.least(i, F.lit(14)).cast("int")), ""), F.lit(50))
            fresh = ~F.contains(before, F.concat(lit('id="ref-'), n, lit('"')))
            return F.when((n != "") & fresh, F.concat(lit('<a id="ref-'), n, lit('"></a>'), x)).otherwise(x)

        return F.array_join(F.transform(chunks, one), "")

    return let(F.split(plain, r"(?md)(?=^\[\d{1,3}\])"), each)


def _by_heading(c: Column, found, otherwise: Column) -> Column:
    out = otherwise
    for h in reversed(HEADINGS):
        out = F.when(c.rlike(f"(?md){h}"), found(h)).otherwise(out)
    return F.when(F.contains(c, lit("References")) | F.contains(c, lit("REFERENCES")), out).otherwise(otherwise)


def split_references(c: Column) -> Column:
    """Struct (body, refs): refs begins with the heading; without one it is empty."""
    return F.struct(
        _by_heading(c, lambda h: F.regexp_extract(c, rf"(?smd)\A(.*?){h}", 1), c).alias("body"),
        _by_heading(c, lambda h: F.regexp_extract(c, rf"(?smd)\A.*?({h}.*)\z", 1), lit("")).alias("refs"),
    )


def split_after_heading(c: Column) -> Column:
    """Struct (head, entries): head ends with the references heading; without one entries is null."""
    head = _by_heading(c, lambda h: F.regexp_extract(c, rf"(?smd)\A(.*?{h})", 1), F.lit(None).cast("string"))
    return let(head, lambda h: F.struct(F.coalesce(h, c).alias("head"), F.when(h.isNotNull(), F.substr(c, F.length(h) + 1)).alias("entries")))


def process_citations(c: Column) -> Column:
    """Ranges and links in the body, anchors in the references."""
    return let(split_references(c), lambda p: F.concat(let(expand_ranges(p["body"]), link_citations), F.when(p["refs"] != "", anchor_references(p["refs"])).otherwise(lit(""))))
