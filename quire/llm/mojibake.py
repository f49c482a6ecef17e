"""Problem 9: text that was decoded with the wrong character encoding.

Round-trip repair: a run of text is re-encoded under a candidate legacy encoding
and strictly decoded as the intended one, again and again for nested layers, and
the repair is accepted when a garbling cost drops.  The cost of a string is the
sum of -log2 P(a, b) over the adjacent characters of which one is not ASCII; the
probabilities come from the pairs of all documents (characters of scripts with
large repertoires are counted alone, so the table is bounded by the alphabets,
not by the corpus).

Two repairs are tried in every segment between line breaks and sentence ends:
runs of UTF-8 sequences that were read as one-byte or double-byte text, found
inside the re-encoded bytes; and segments of one legacy encoding read as another.

Defined results: null, empty and pure ASCII texts are never garbled; U+FFFD marks
a loss that cannot be restored, but garbled.  A sequence that is only shown, as
a token of its own in a sentence without other garbling, is no case.  Repeated
rows give repeated results; callers that want records call distinct.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings by which text is misread, and those it was written in.
MISREAD_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp1254", "iso8859-2", "iso8859-15", "gbk", "big5", "shift_jis", "cp949")
ONE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-2")
WRITTEN_IN = ("cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "cp437", "mac_roman", "iso8859-2", "gbk", "shift_jis", "euc_jp", "euc_kr", "big5")
TWO_BYTE = ("gbk", "big5", "shift_jis", "cp949", "euc_kr", "euc_jp")
#: Bits of cost from which a pair counts as unusual; only segments with unusual pairs are tried under other legacy encodings.
UNUSUAL = 10.5
#: Bits by which a repair has to lower the cost, for each character that it changes.
MIN_GAIN = 2.0
#: Least gain for text of another legacy encoding, which has no form of its own by which it is known.
MIN_LEGACY_GAIN = 12.0
_UTF8_RUN = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
#: (start, end, symbol): pairs inside a large script are not counted; its characters are counted alone.
_LARGE = ((0x900, 0x97F), (0xE00, 0xE7F), (0x620, 0x6FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x3FFFF), (0xE000, 0xF8FF))


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    cp = np.arange(0x110000, dtype=np.int64)
    out = cp.copy()
    for lo, hi in (*_LARGE, (0x61, 0x7A), (0x41, 0x5A), (0x30, 0x39)):
        out[(cp >= lo) & (cp <= hi)] = lo
    return out


def _symbols(cp: np.ndarray) -> np.ndarray:
    """Code points with large scripts, ASCII letters and digits folded to one symbol each."""
    return _symbol_table()[cp]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


#: Left member of the entries that count a character of a large script alone.
ALONE = 0x1FFFFF


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of adjacent symbol pairs with a member beyond ASCII and of large-script characters, added up within a batch."""
    for pdf in batches:
        cp = _codes("\n".join(t for t in pdf["_t"] if t))
        sym = _symbols(cp)
        if len(sym) > 1:
            a, b = sym[:-1], sym[1:]
            keep = ((a > 127) | (b > 127)) & ~((a == b) & (cp[1:] != b))
            large = cp != sym
            pairs, n = np.unique(np.concatenate([(a[keep] << 21) | b[keep], (ALONE << 21) | cp[large & (cp > 127)]]), return_counts=True)
            yield pd.DataFrame({"pair": pairs, "n": n.astype(np.int64)})


class Costs:
    """Garbling cost of a string: -log2 of the joint frequency of each pair, with additive smoothing.

    Joint rather than conditional, as the rare symbols of garbling are rare together.
    The table is two sorted arrays, so the pairs of many strings are looked up at once."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, counts = np.asarray(pairs, np.int64)[order], np.asarray(counts, np.float64)[order]
        self.total = float(counts.sum()) + 1.0
        self.bits = -np.log2((counts + 0.05) / self.total)
        self.unseen = -math.log2(0.05 / self.total)
        self.memo: dict[int, float] = {}
        self.chars, at = np.unique(self.pairs & 0x1FFFFF, return_inverse=True)
        self.char_bits = -np.log2((np.bincount(at, counts, len(self.chars)) + 0.05) / self.total) if len(counts) else np.empty(0)

    def _bits_of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(keys), self.unseen)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.bits[at], self.unseen)

    def rarities(self, cp: np.ndarray) -> np.ndarray:
        """-log2 of how often characters stand second in a pair or alone."""
        if not len(self.chars):
            return np.full(cp.shape, self.unseen)
        i = np.minimum(np.searchsorted(self.chars, cp), len(self.chars) - 1)
        return np.where(self.chars[i] == cp, self.char_bits[i], self.unseen)

    @staticmethod
    def _keys(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places): what is counted at each place where a pair has a member beyond ASCII."""
        sym = _symbols(cp)
        a, b, c = sym[:-1], sym[1:], cp[1:]
        alone = (b > 127) & (c != b)
        at = np.flatnonzero(alone | (a > 127) | (b > 127))
        return np.where(alone[at], (ALONE << 21) | c[at], (a[at] << 21) | b[at]), at

    def many(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits, places) of the pairs of an array of code points."""
        keys, at = self._keys(cp)
        return self._bits_of(keys), at

    def each(self, text: str) -> list[float]:
        return self.many(_codes(" " + text + " "))[0].tolist()

    def __call__(self, text: str) -> float:
        out, missing = 0.0, []
        keys, _ = self._keys(_codes(" " + text + " "))
        for k in keys.tolist():
            c = self.memo.get(k)
            if c is None:
                missing.append(k)
            else:
                out += c
        if missing:
            for k, c in zip(missing, self._bits_of(np.array(missing, np.int64)).tolist(), strict=True):
                if len(self.memo) < 500_000:
                    self.memo[k] = c
                out += c
        return out


@lru_cache(maxsize=32)
def _byte_of(codec: str) -> dict[str, bytes]:
    """Character to byte for a one-byte encoding; bytes it leaves undefined stand for the control character with their number, as browsers read them."""
    table: dict[str, bytes] = {}
    for i in range(256):
        raw = bytes([i])
        try:
            table[raw.decode(codec)] = raw
        except UnicodeDecodeError:
            table.setdefault(chr(i), raw)
    return table


@lru_cache(maxsize=32)
def _bytes_by_code_point(codec: str) -> np.ndarray:
    """The byte of each code point in a one-byte encoding, 0xff where it has none."""
    out = np.full(0x110000, 0xFF, np.uint8)
    for c, raw in _byte_of(codec).items():
        out[ord(c)] = raw[0]
    return out


def _encoded(text: str, codec: str) -> tuple[bytes, Sequence[int]]:
    """Bytes of ``text`` and, for each byte, the index of its character; b'\\xff' where the encoding has no such character."""
    if codec not in TWO_BYTE:
        return _bytes_by_code_point(codec)[_codes(text)].tobytes(), range(len(text))
    code = _code_table(codec)[np.minimum(_codes(text), 0x10000)]
    two = code > 0xFF
    starts = np.cumsum(1 + two) - (1 + two)
    out = np.empty(len(code) + int(two.sum()), np.uint8)
    out[starts] = np.where(two, code >> 8, code)
    out[starts[two] + 1] = code[two] & 0xFF
    return out.tobytes(), np.repeat(np.arange(len(code)), 1 + two)


@lru_cache(maxsize=8)
def _code_table(codec: str) -> np.ndarray:
    """The one or two bytes of each code point in a double-byte encoding, as a number; 0xff where there are none."""
    out = np.full(0x10001, 0xFF, np.int32)
    for cp in range(0x10000):
        try:
            raw = chr(cp).encode(codec)
        except UnicodeEncodeError:
            continue
        if len(raw) <= 2:
            out[cp] = int.from_bytes(raw, "big")
    return out


def _undo_utf8(text: str, codec: str) -> tuple[str, int, int] | None:
    """Decode the runs of UTF-8 sequences inside ``text`` as read by ``codec``: (repaired, characters consumed, runs) or None."""
    raw, at = _encoded(text, codec)
    out, last, eaten, runs = [], 0, 0, 0
    for m in _UTF8_RUN.finditer(raw):
        i, j = at[m.start()], at[m.end() - 1] + 1
        if (m.start() and at[m.start() - 1] == i) or (m.end() < len(at) and at[m.end()] == j - 1):
            continue  # begins or ends inside a double-byte character
        try:
            decoded = m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [text[last:i], decoded]
        last, eaten, runs = j, eaten + j - i, runs + 1
    if not runs:
        return None
    return "".join(out) + text[last:], eaten, runs


def _undo_legacy(text: str, read_as: str, written_in: str) -> tuple[str, int, int] | None:
    """Re-encode the runs of ``text`` that ``read_as`` can hold and strictly decode them as ``written_in``: (repaired, characters changed, runs) or None."""
    out, last, changed, runs = [], 0, 0, 0
    for i, j, raw in _held(text, read_as):
        piece = text[i:j]
        if piece.isascii():
            continue
        try:
            decoded = raw.decode(written_in)
        except UnicodeDecodeError:
            continue
        if decoded != piece:
            out += [text[last:i], decoded]
            last, changed, runs = j, changed + len(_NON_ASCII.findall(piece)), runs + 1
    if not runs:
        return None
    return "".join(out) + text[last:], changed, runs


_HELD = re.compile(rb"[^\xff]+")


@lru_cache(maxsize=32)
def _repertoire(codec: str) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, _byte_of(codec))) + "]+")


def _held(text: str, codec: str) -> Iterator[tuple[int, int, bytes]]:
    """Runs of characters that the encoding has: (start, end, bytes)."""
    if codec not in TWO_BYTE:
        raw, _ = _encoded(text, codec)
        for m in _repertoire(codec).finditer(text):
            yield m.start(), m.end(), raw[m.start() : m.end()]
        return
    raw, at = _encoded(text, codec)  # no two-byte encoding uses the byte 0xff
    for m in _HELD.finditer(raw):
        yield at[m.start()], at[m.end() - 1] + 1, m.group()


def _only_shown(text: str, restored: str) -> bool:
    """The repair is one short sequence that stands alone in its sentence, as an example does."""
    i = 0
    while i < min(len(text), len(restored)) and text[i] == restored[i]:
        i += 1
    j = 0
    while j < min(len(text), len(restored)) - i and text[-1 - j] == restored[-1 - j]:
        j += 1
    before, after = text[i - 1 : i] if i else "", text[len(text) - j :][:1]
    return len(restored) - i - j <= 2 and before != "" and not before.isalnum() and not after.isalnum()


@lru_cache(maxsize=1)
def _utf8_bytes() -> tuple[np.ndarray, np.ndarray]:
    """(lead, continuation): per code point, a bit for each one-byte encoding that shows such a byte of UTF-8 as this character."""
    lead, continuation = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
    for n, codec in enumerate(c for c in MISREAD_AS if c not in TWO_BYTE):
        for c, raw in _byte_of(codec).items():
            if 0xC2 <= raw[0] < 0xF5:
                lead[ord(c)] |= 1 << n
            elif 0x80 <= raw[0] < 0xC0:
                continuation[ord(c)] |= 1 << n
    return lead, continuation


def utf8_signs(cp: np.ndarray) -> np.ndarray:
    """For each place, a bit for every encoding that shows a lead and a continuation byte of UTF-8 there."""
    lead, continuation = _utf8_bytes()
    return lead[cp[:-1]] & continuation[cp[1:]]


_ONE_BYTE_READINGS = [c for c in MISREAD_AS if c not in TWO_BYTE]
_ONE_BYTE_TARGETS = [c for c in WRITTEN_IN if c not in TWO_BYTE]


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """(bytes, characters): the byte of a code point in each encoding of ONE_BYTE, -1 where there is none, and the code point of a byte in each of _ONE_BYTE_TARGETS."""
    byte_of = np.full((len(ONE_BYTE), 0x10000), -1, np.int16)
    for n, codec in enumerate(ONE_BYTE):
        for c, raw in _byte_of(codec).items():
            byte_of[n, ord(c)] = raw[0]
    shown = np.full((len(_ONE_BYTE_TARGETS), 256), -1, np.int64)
    for n, codec in enumerate(_ONE_BYTE_TARGETS):
        for c, raw in _byte_of(codec).items():
            shown[n, raw[0]] = ord(c)
    return byte_of, shown


_DENSE = re.compile(r"[\x80-\u04ff\u2010-\u26ff]{4}")
_TWO_BYTE_TEXT = re.compile(r"[\u3000-\u9fff\uac00-\ud7a3\uff00-\uffef]")
_ASCII_RUN = re.compile(r"[A-Za-z]+|[0-9]+")


class Repairer:
    """Best repair of a segment under a cost function.

    What was found for a segment is kept by its shape (ASCII letters and digits
    folded), as neither the cost nor a round trip depends on them."""

    def __init__(self, cost: Costs):
        self.cost = cost
        self.kept: dict[str, list[tuple[str, str]] | None] = {}

    @staticmethod
    def _undo(text: str, recipe: tuple[str, str]) -> tuple[str, int, int] | None:
        return _undo_utf8(text, recipe[0]) if recipe[1] == "utf-8" else _undo_legacy(text, *recipe)

    def _recipes(self, text: str, each: list[float]) -> Iterator[tuple[str, str]]:
        cp = _codes(text)
        signs = int(np.bitwise_or.reduce(utf8_signs(cp))) if len(cp) > 1 else 0
        yield from ((c, "utf-8") for n, c in enumerate(_ONE_BYTE_READINGS) if signs >> n & 1)
        wide = _TWO_BYTE_TEXT.search(text) is not None
        unusual = sum(c > UNUSUAL for c in each)
        if wide and max(each) > UNUSUAL:
            yield from ((c, "utf-8") for c in MISREAD_AS if c in TWO_BYTE)
        if unusual < 2 and unusual < len(each) / 2:
            return
        # a change of single characters is worth a try when they become more usual
        chars = np.unique(cp[cp > 127])
        byte_of, shown = _byte_tables()
        raw = np.where(chars < 0x10000, byte_of[:, np.minimum(chars, 0xFFFF)], -1)
        known = raw >= 0
        before = (self.cost.rarities(chars) * known).sum(axis=1)
        target = shown[:, np.maximum(raw, 0)]
        after = np.where(known & (target >= 0), self.cost.rarities(target), 0.0).sum(axis=2)
        possible = (after < before) & (~known | (target >= 0)).all(axis=2)
        dense = _DENSE.search(text) is not None
        for n, a in enumerate(ONE_BYTE):
            if 3 * int(known[n].sum()) < 2 * len(chars):
                continue
            for k, b in enumerate(_ONE_BYTE_TARGETS):
                if a != b and possible[k, n]:
                    yield a, b
            if dense:
                yield from ((a, b) for b in WRITTEN_IN if b in TWO_BYTE)
        if wide and sum(c > UNUSUAL + 3 for c in each) > 2:
            yield from ((a, b) for a in TWO_BYTE for b in TWO_BYTE if a != b)

    def layer(self, text: str) -> tuple[str, tuple[str, str]] | None:
        """One layer undone and how, or None when no candidate lowers the cost enough."""
        each = self.cost.each(text)
        if not each:
            return None
        now = sum(each)
        best, best_cost = None, now
        for recipe in self._recipes(text, each):
            got = self._undo(text, recipe)
            if got is None or "\x00" in got[0]:
                continue
            c = self.cost(got[0])
            if c < best_cost and now - c >= max(MIN_GAIN * got[1], MIN_LEGACY_GAIN if recipe[1] != "utf-8" else 0.0):
                best, best_cost = (got[0], recipe), c
        return best

    def segment(self, text: str) -> str | None:
        """The restored segment, or None when it is not garbled."""
        shape = _ASCII_RUN.sub(lambda m: m.group()[0] if m.group()[0].isdigit() else "a", text)
        if shape not in self.kept:
            now, recipes = text, []
            while (undone := self.layer(now)) is not None:  # ends, as the cost drops by MIN_GAIN at least
                now = undone[0]
                recipes.append(undone[1])
            if recipes and recipes[0][1] == "utf-8" and _only_shown(text, now):
                recipes = []
            if len(self.kept) >= 200_000:
                self.kept.clear()
            self.kept[shape] = recipes or None
        recipes = self.kept[shape]
        if recipes is None:
            return None
        for r in recipes:
            got = self._undo(text, r)
            text = got[0] if got else text
        return text

    def text(self, text: str) -> tuple[bool, str, bool]:
        """:meth:`texts` of one text."""
        return self.texts([text])[0]

    def texts(self, texts: list[str]) -> list[tuple[bool, str, bool]]:
        """(garbled, restored text, whether all of it could be restored) of each text.

        The segments of all texts are one array of code points: costs and signs of
        UTF-8 are found in it at once, and only segments that have an unusual pair or
        such a sign are tried."""
        cut = [_segments(t) for t in texts]
        foreign = [(i, k) for i, segments in enumerate(cut) for k, s in enumerate(segments) if not s.isascii()]
        joined = "".join(f" {cut[i][k]} " for i, k in foreign)
        out = [(False, t, True) for t in texts]
        if not foreign:
            return out
        cp = _codes(joined)
        ends = np.cumsum([len(cut[i][k]) + 2 for i, k in foreign])
        bits, at = self.cost.many(cp)
        odd = np.concatenate([at[bits > UNUSUAL], np.flatnonzero(utf8_signs(cp))])
        tried = np.unique(np.searchsorted(ends, odd, side="right"))
        found: dict[int, list[bool]] = {}
        for n in tried.tolist():
            i, k = foreign[n]
            fixed = self.segment(cut[i][k])
            if fixed is not None:
                cut[i][k] = fixed
                found.setdefault(i, [True])
        for i in {i for i, _ in foreign}:
            lost = "\ufffd" in texts[i] and any("\ufffd" in s and not _shows_replacement(s) for s in cut[i])
            if lost or i in found:
                out[i] = True, "".join(cut[i]), not lost
        return out


_BOUNDARY = re.compile(r"[.!?।؟]+[\"”»’')]*(?=\s)|[。！？]|\n")


def _segments(text: str) -> list[str]:
    """Pieces that end with a line or a sentence; together they are the text."""
    out, last = [], 0
    for m in _BOUNDARY.finditer(text):
        out.append(text[last : m.end()])
        last = m.end()
    return [*out, text[last:]] if last < len(text) else out


_LOST = re.compile("(\\w?)(\ufffd+)(\\w?)")


def _shows_replacement(segment: str) -> bool:
    """The replacement character stands alone and once, as an example does."""
    runs = _LOST.findall(segment)
    return len(runs) == 1 and not runs[0][0] and not runs[0][2] and len(runs[0][1]) <= 2


def pair_table(df: DataFrame, text: str) -> DataFrame:
    """(pair, n) over all rows of ``text``: a table bounded by the alphabets that occur."""
    return (
        df.select(F.col(text).alias("_t"))
        .where(r"_t rlike '[^\\x00-\\x7f]'")
        .mapInPandas(_pair_counts, "pair long, n long")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )


#: Texts that are repaired together.
TOGETHER = 400


def repair_encoding(df: DataFrame, record: str, text: str) -> DataFrame:
    """Rows (record, garbled, restored_text, fully_restored) of the texts that are not ASCII."""
    rows = pair_table(df, text).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((rows["pair"].to_numpy(), rows["n"].to_numpy()))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = Repairer(Costs(*shared.value))
        for pdf in batches:
            texts = pdf["_t"].tolist()
            got = [r for lo in range(0, len(texts), TOGETHER) for r in fix.texts(texts[lo : lo + TOGETHER])]
            yield pd.DataFrame({"_id": pdf["_id"], "garbled": [g for g, _, _ in got], "restored_text": [r for _, r, _ in got], "fully_restored": [w for _, _, w in got]})

    kind = df.schema[record].dataType.simpleString()
    return (
        df.select(F.col(record).alias("_id"), F.col(text).alias("_t"))
        .where(r"_t rlike '[^\\x00-\\x7f]'")
        .mapInPandas(repair, f"_id {kind}, garbled boolean, restored_text string, fully_restored boolean")
        .withColumnRenamed("_id", record)
    )
