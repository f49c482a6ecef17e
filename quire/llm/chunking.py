"""Problem 3: cutting oversized items at natural boundaries, with overlap.

Structure-tree packing: the markdown of an oversized item is a tree of sections
(by heading level), blocks, list items by their depth, lines (rows of tables and
code), sentences, words and grapheme clusters.  A heading is never parted from what
follows it, as long as both fit.  A
node within the limit is never opened.  An oversized node is opened one level,
its children are packed the same way, and neighbouring pieces are merged while
they fit.  The limit for new text is ``max_chars - overlap_chars``; each piece
after the first starts with the ``overlap_chars`` characters before its new text
(all of the text before it, where there is less).

Defined results: null and empty texts give no piece; a text within the limit
gives one piece equal to itself; pieces without their overlaps concatenate to
the text; a piece without any boundary is cut between grapheme clusters (and,
should one cluster exceed the limit, inside it).  Repeated rows give repeated
pieces.  All sizes and positions count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^(?:```|~~~).*?(?:^(?:```|~~~)[ \t]*$|\Z)", re.M | re.S)
_HEADING = re.compile(r"^(#{1,6})[ \t]", re.M)
_BLOCK = re.compile(r"\n[ \t]*\n\s*")
_ITEM = re.compile(r"^([ \t]*)(?:[-*+•]|\d{1,3}[.)])[ \t]", re.M)
#: Least indents of the list levels: an item holds the deeper ones that follow it.
INDENTS = (2, 4, 8)
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?؟।]+[\"”»’')\]]*\s+|[。！？]+[」』”）]*")
_WORD = re.compile(r"\s+|(?<=[、，])")
_MARKS = "\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u200c\u200d\u20d0-\u20f0\ufe00-\ufe0f"
_CLUSTER = re.compile(f"[^{_MARKS}][{_MARKS}]*|[{_MARKS}]+", re.S)
SECTION_LEVELS = 6
BLOCK_LEVEL = SECTION_LEVELS + 1


class _Item:
    """Boundaries of one text by level, found when a level is opened."""

    def __init__(self, text: str):
        self.text = text
        self.fences = [m.span() for m in _FENCE.finditer(text)] if "```" in text or "~~~" in text else []
        self.fence_starts = [a for a, _ in self.fences]
        self.headings = [(m.start(), len(m.group(1))) for m in _HEADING.finditer(text) if not self._fenced(m.start())]
        self.heading_starts = [at for at, _ in self.headings]
        # from a heading's first character to what follows it: no cut between blocks, items, lines or sentences
        self.heading_ends = [re.compile(r"[^\n]*\n?\s*").match(text, at).end() for at in self.heading_starts]

    def _fenced(self, at: int) -> bool:
        k = bisect_right(self.fence_starts, at) - 1
        return k >= 0 and at < self.fences[k][1] and at != self.fences[k][0]

    def _held(self, at: int) -> bool:
        k = bisect_left(self.heading_starts, at) - 1
        return k >= 0 and at <= self.heading_ends[k]

    def cuts(self, level: int, start: int, end: int) -> Iterator[int]:
        """Positions inside (start, end) at which a node is opened on ``level``."""
        if level <= SECTION_LEVELS:
            for at, depth in self.headings[bisect_right(self.heading_starts, start) : bisect_left(self.heading_starts, end)]:
                if depth <= level and not self._held(at):
                    yield at
        elif level == BLOCK_LEVEL:
            for m in _BLOCK.finditer(self.text, start, end):
                if not self._fenced(m.end()) and not self._held(m.end()):
                    yield m.end()
        elif level <= BLOCK_LEVEL + len(INDENTS):
            for m in _ITEM.finditer(self.text, start, end):
                if len(m.group(1).expandtabs(4)) < INDENTS[level - BLOCK_LEVEL - 1] and not self._fenced(m.start()) and not self._held(m.start()):
                    yield m.start()
        else:
            kind = level - BLOCK_LEVEL - len(INDENTS) - 1
            for m in (_LINE, _SENTENCE, _WORD, _CLUSTER)[kind].finditer(self.text, start, end):
                if kind > 1 or not self._held(m.end()):
                    yield m.end()


LAST_LEVEL = BLOCK_LEVEL + len(INDENTS) + 4
NO_LIMIT = (1 << 31) - 1


def _pack(item: _Item, start: int, end: int, level: int, limit: int) -> list[tuple[int, int]]:
    if end - start <= limit:
        return [(start, end)]
    if level > LAST_LEVEL:
        return [(i, min(i + limit, end)) for i in range(start, end, limit)]
    children, at = [], start
    for cut in item.cuts(level, start, end):
        if start < cut < end and cut > at:
            children.append((at, cut))
            at = cut
    children.append((at, end))
    out: list[tuple[int, int]] = []
    for a, b in children:
        for piece in _pack(item, a, b, level + 1, limit):
            if out and piece[1] - out[-1][0] <= limit:
                out[-1] = (out[-1][0], piece[1])
            else:
                out.append(piece)
    return out


def pack(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start with overlap, start of the new text, end)."""
    if not text:
        return []
    if len(text) <= max_chars:
        return [(0, 0, len(text))]
    spans = _pack(_Item(text), 0, len(text), 1, max_chars - overlap_chars)
    return [(max(0, a - overlap_chars), a, b) for a, b in spans]


def split_oversized(df: DataFrame, record: str, text: str, max_chars: int, overlap_chars: int, with_text: bool = True) -> DataFrame:
    """Rows (record, piece_no, start_pos, new_pos, end_pos[, piece]).

    Only oversized texts leave the JVM; the others are one piece as they are.
    The stage is narrow, so copies and hot keys cost no shuffle.
    """
    if not 0 <= overlap_chars < max_chars:
        raise ValueError("overlap_chars has to be less than max_chars")
    kind = df.schema[record].dataType.simpleString()
    rows = df.select(F.col(record).alias("_id"), F.col(text).alias("_t")).where("_t is not null and _t <> ''")
    extra = ", piece string" if with_text else ""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):  # pieces of some texts at a time
                part = pdf.iloc[lo : lo + 256]
                out = [(i, n + 1, a, s, b, t[a:b]) if with_text else (i, n + 1, a, s, b) for i, t in zip(part["_id"], part["_t"], strict=True) for n, (a, s, b) in enumerate(pack(t, max_chars, overlap_chars))]
                yield pd.DataFrame(out, columns=["_id", "piece_no", "start_pos", "new_pos", "end_pos", *["piece"] * with_text])

    size = F.length("_t")
    cut_up = rows.where(size > max_chars).mapInPandas(cut, f"_id {kind}, piece_no int, start_pos int, new_pos int, end_pos int{extra}")
    whole = rows.where(size <= max_chars).select(
        "_id", F.lit(1).alias("piece_no"), F.lit(0).alias("start_pos"), F.lit(0).alias("new_pos"), size.cast("int").alias("end_pos"), *[F.col("_t").alias("piece")] * with_text
    )
    return cut_up.unionByName(whole).withColumnRenamed("_id", record)


def limit_of(limits: DataFrame, item_type: str) -> tuple[int, int]:
    """(max_chars, overlap_chars) of an item type: of several rows the one with the largest limit.  Without a row nothing is too large."""
    row = limits.where(F.col("item_type") == item_type).agg(F.max("max_chars").alias("size"), F.max_by("overlap_chars", F.struct("max_chars", "overlap_chars")).alias("overlap")).first()
    return (row["size"], row["overlap"]) if row["size"] is not None else (NO_LIMIT, 0)


def reassembled(pieces: DataFrame, record: str, max_chars: int, overlap_chars: int) -> DataFrame:
    """(record, text, fits, overlaps) of records with each piece once: the text that the pieces' new parts make up, whether every piece is within the limit and whether each repeats the end of the one before."""
    new = F.substring(F.col("piece"), F.col("new_pos") - F.col("start_pos") + 1, F.length("piece"))
    rows = pieces.select(record, "piece_no", F.struct("piece_no", new.alias("new"), F.col("new_pos").alias("at"), "piece").alias("_p"))
    one = rows.groupBy(record).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))  # a record's pieces, bounded by its text
    text = F.array_join(F.transform("_ps", lambda p: p["new"]), "")

    def follows(p: Column, i: Column) -> Column:
        before = F.array_join(F.transform(F.slice("_ps", 1, i), lambda q: q["new"]), "")
        return (i == 0) | p["piece"].startswith(F.right(before, F.least(F.lit(overlap_chars), p["at"])))

    return one.select(record, text.alias("text"), F.forall("_ps", lambda p: F.length(p["piece"]) <= max_chars).alias("fits"), F.forall(F.transform("_ps", follows), lambda x: x).alias("overlaps"))
