"""Problem 6: noise in text from scanned pages.

Three passes.  (1) Words of all texts are counted; those that recur are the lexicon,
save those that known confusions turn into a far more frequent word: a misreading
may recur as often as a rare word, so its count alone does not clear it.
(2) Every text is read line by line: boosted line-pair classifiers decide which
lines are page furniture (running headers, footers, page numbers) and whether a
hyphen at a line's end cuts a word or belongs to a compound; the words that are
left and not in the lexicon are suspects.  (3) Suspects meet lexicon words in an
inverted join over character q-grams; a boosted ranking over the candidates picks
the replacement, and a suspect with a likely one is a misread.

The q-grams are those of a word's skeleton, in which characters that are read as one
another are written alike, so a word and its misreading have the same ones.  The join
is keyed by q-gram and skeleton length, and a suspect looks up its PROBES rarest
q-grams only: one further difference destroys at most Q of them, so one is left.
Candidates of a suspect therefore grow with the words like it, not with the lexicon.

The classifiers and the ranking are fitted on labelled rows made from a bounded
sample (TRAIN_TEXTS texts, TRAIN_WORDS words): furniture and cuts are put into
clean text, and words are misread by the fixed confusions below.

Defined results: null and empty texts have no noise; lines between code fences
are code and have none; repeated rows count once.
"""

from __future__ import annotations

import math
import random
import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.boosting import BoostedTrees
from quire.llm.confusables import normalise
from quire.llm.sampling import hash_sample
from quire.runtime import broadcast_if_small, cut_lineage

TRAIN_TEXTS = 1000
TRAIN_WORDS = 1500
#: Texts with a line longer than this were not wrapped at a page's width; only they serve for training.
UNWRAPPED = 120
#: Most lexicon words sent to the workers, by count.  Rarer ones that a text asks for are joined to it before it is read, so the number changes no result.
LEXICON_LIMIT = 300_000
#: A lexicon word occurs at least this often.
LEXICON_COUNT = 6
Q, PROBES = 5, 6
#: A frequent word is doubtful if one that it may be a misreading of occurs more than so many times as often.
DOUBTFUL_RATIO = 20
#: Most confusions within a word: as many as a likely reading may cost.
DOUBTFUL_SWAPS = 3
LINE_LIMIT, CUT_LIMIT, RANK_LIMIT = 0.5, 0.5, 0.5

# What characters are read as.
CONFUSIONS = (
    ("e", "c"), ("o", "0"), ("t", "f"), ("i", "l"), ("s", "5"), ("n", "ri"), ("l", "1"), ("h", "b"), ("i", "1"), ("d", "cl"), ("u", "ii"), ("m", "rn"), ("g", "q"), ("b", "6"), ("ti", "ü"), ("li", "h"), ("w", "vv"),
    ("c", "e"), ("f", "t"), ("l", "i"), ("ri", "n"), ("b", "h"), ("cl", "d"), ("rn", "m"), ("q", "g"), ("g", "9"), ("z", "2"), ("ll", "ii"), ("vv", "w"), ("a", "o"), ("y", "v"), ("fi", "h"),
    ("о", "0"), ("з", "3"), ("б", "6"), ("и", "н"), ("н", "и"), ("н", "п"), ("п", "н"), ("ш", "щ"), ("щ", "ш"), ("е", "с"), ("с", "е"), ("ο", "0"), ("ν", "v"), ("α", "o"), ("ι", "1"),
)
# How the skeleton of a word writes characters; both sides of every confusion are written alike.
SKELETON = {
    "e": "E", "c": "E", "o": "O", "0": "O", "a": "O", "t": "I", "f": "I", "i": "I", "l": "I", "1": "I", "s": "S", "5": "S", "r": "R", "n": "RI", "d": "EI", "u": "II", "h": "II", "b": "II", "6": "II", "ü": "II", "m": "RRI", "v": "Y", "y": "Y", "w": "YY", "g": "G", "q": "G", "9": "G", "z": "Z", "2": "Z",
    "о": "O", "з": "3", "3": "3", "б": "II", "и": "Н", "н": "Н", "п": "Н", "ш": "Ш", "щ": "Ш", "е": "Е", "с": "Е", "ο": "O", "ν": "Y", "α": "O", "ι": "I",
}
HYPHENS = "-¬­‐‑"
_PARAGRAPH_ENDS = ".,;:?!" + HYPHENS
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W_]+")
_COUNTED = re.compile(r"[^\W_]+(?:-[^\W\d_]+)?")
_CUT = re.compile(rf"([^\W\d_]+)([{HYPHENS}])\s*$")
_HEAD_WORD = re.compile(r"\s*([a-zà-ÿ][^\W\d_]*)")
_NUMBER = re.compile(r"^\W*(?:p\.|pp\.|page|seite)?\s*\d{1,5}(?:\s*(?:/|of)\s*\d{1,5})?\W*$", re.I)
_INITIALS = re.compile(r"^(?:[A-Z]\. ?)+[A-Z][\w-]+(?:(?:,| and) (?:[A-Z]\. ?)+[A-Z][\w-]+)*$|\bet al\.$", re.I)
_MARKUP = re.compile(r"^\s*(?:#|\||!\[|<|[-*•] |\[\d+\]|(?:Fig|Figure|Table|Abstract|Index Terms|References)\b)")
#: Invisible characters inside a word do not part it.
_UNSEEN = "\u200b\u200c\u200d\u2060\ufeff"
_WORDS_ONLY = re.compile(r"[^\W\d_]+")


def _seen(text: str) -> str:
    if not text.isascii():
        for c in _UNSEEN:
            if c in text:
                text = text.replace(c, "")
    return text


def _key(line: str) -> str:
    return _DIGITS.sub("0", line.strip().lower())


class Page:
    """The lines of one text and what the line-pair classifiers look at."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.clean = [l.strip() for l in self.lines]
        self.code = []
        inside = False
        for l in self.clean:
            fence = l.startswith("```")
            self.code.append(inside or fence)
            inside ^= fence
        lengths = sorted(len(l) for l, c in zip(self.clean, self.code, strict=True) if l and not c)
        self.width = max(20, lengths[int(len(lengths) * 0.8)] if lengths else 20)
        self.full = max(20, lengths[int(len(lengths) * 0.97)] if lengths else 20)  # where lines break
        self.repeats = Counter(_key(l) for l in self.clean if l and len(l) <= 120)
        self.heading = next((l.lstrip("# ") for l in self.clean if l.startswith("# ")), "")
        self.title = self.heading.lower()
        self.solid = [i for i, (l, c) in enumerate(zip(self.clean, self.code, strict=True)) if l and not c and not self._slight(l)]
        self.place = {i: n for n, i in enumerate(self.solid)}

    def _slight(self, line: str) -> bool:
        """Short and without the punctuation that ends a paragraph: may be furniture."""
        return len(line) < 0.85 * self.width and line[-1] not in _PARAGRAPH_ENDS or (len(line) < 30 and _NUMBER.match(line) is not None)

    def candidates(self) -> list[int]:
        """Lines that may be furniture: short ones, repeated ones, numbers, capitals, the title again."""
        out = []
        for i, (l, c) in enumerate(zip(self.clean, self.code, strict=True)):
            if not l or c or l[0] in "#|!<`" or len(l) > 120:
                continue
            if self._slight(l) or self.repeats[_key(l)] > 1 or l.isupper() or "   " in l or (self.title and l[:24].lower() in self.title):
                out.append(i)
        return out

    def features(self, i: int) -> list[float]:
        """Of a line and its neighbours."""
        l = self.clean[i]
        lo = int(np.searchsorted(self.solid, i))
        before = self.clean[self.solid[lo - 1]] if lo > 0 else ""
        hi = lo + (i in self.place)
        after = self.clean[self.solid[hi]] if hi < len(self.solid) else ""
        words = _WORDS_ONLY.findall(l)
        caps = sum(w[0].isupper() for w in words) / max(1, len(words))
        return [
            float(_NUMBER.match(l) is not None),
            min(6.0, self.repeats[_key(l)]),
            len(l) / self.width,
            float(bool(before) and before[-1] not in ".:?!”\""),
            float(after[:1].islower()),
            float(l[-1] in ".,;:?!"),
            caps,
            float(l.isupper() and len(l) > 3),
            float(bool(self.title) and (l.lower() in self.title or self.title in l.lower() or re.sub(r"^\W*\d+\W+|\W+\d+\W*$", "", l.lower()) in self.title) and len(l) > 8),
            float(_INITIALS.search(l) is not None),
            float(re.search(r"\d\s*$|^\d", l) is not None),
            float(_MARKUP.match(l) is not None),
            float(i == 0 or not self.clean[i - 1]),
            float(i + 1 == len(self.clean) or not self.clean[i + 1]),
            float(len(words)),
            float(re.match(r"^\d+(?:\.\d+)+ ", l) is not None),
            float(l[:1].islower()),
            float("   " in l),
            float(before[-1:] in HYPHENS and before != ""),
            self._room(l, self.clean[i + 1] if i + 1 < len(self.clean) else ""),
            self._room(self.clean[i - 1] if i else "", l),
            self._room(before, after),
        ]

    def _room(self, line: str, following: str) -> float:
        """Share of the line width that is left after the first word of the following line is moved up: below 0 where wrapping broke the line."""
        if not line or not following:
            return 1.0
        return max(-1.0, (self.full - len(line) - 1 - len(following.split(" ", 1)[0])) / self.full)


def cut_features(left: str, mark: str, right: str, lexicon: Mapping[str, int]) -> list[float]:
    """Of a hyphen between two lines: how usual the joined word, the compound and its parts are."""
    a, b = left.lower(), right.lower()
    f = lambda w: math.log1p(lexicon.get(w, 0))
    joined, compound, least = f(a + b), f(a + "-" + b), min(f(a), f(b))
    return [joined, compound, f(a), f(b), joined - compound, joined - least, compound - least, float(mark != "-"), float(len(a)), float(len(b)), float(left[:1].isupper())]


def _furniture(rng: random.Random, title: str) -> list[list[str]]:
    """Page furniture of one invented volume: the lines of each page, some pages."""
    name = lambda: rng.choice("ABCDEFGHKLMPRSTW") + ". " + "".join(rng.choice(("ta", "ro", "mi", "ke", "lun", "bor", "ves", "dal")) for _ in range(3)).title()
    first = rng.randint(1, 900)
    number = rng.choice(("{}", "p. {}", "Page {}", "- {} -", "— {} —", "[{}]", "{} / 400", "({})"))
    topic = " ".join(w.capitalize() for w in re.findall(r"[A-Za-z-]+", title)[1:3]) or "Systems"
    header = rng.choice(
        (name() + " and " + name(), name().split()[-1].upper() + " ET AL.", title.upper(), title, title[: rng.randint(24, 48)], title.upper()[: rng.randint(24, 48)], "Preprint", "Preprint, not yet reviewed", f"{rng.randint(1990, 2024)} Meeting on {topic} Systems", f"Notes on {topic} Research, Vol. {rng.randint(1, 40)}", f"Technical Report TR-{rng.randint(1, 99)}", "Author copy for internal study", f"Manuscript received {rng.randint(1, 28)} March {rng.randint(1990, 2024)}", f"Proc. {topic} Workshop, {rng.randint(1990, 2024)}", "Draft")
    )
    style = rng.random()
    out = []
    for k in range(rng.randint(1, 4)):
        n = number.format(first + k)
        both = [f"{first + k}   {header}"] if style < 0.25 else [f"{header}   {first + k}"] if style < 0.35 else [n, header] if style < 0.6 else [header, n] if style < 0.7 else [n] if style < 0.85 else [header]
        if rng.random() < 0.2:
            both = [number.format(first + k)] if rng.random() < 0.5 else [header]
        gap = rng.random()
        out.append(["", *both, ""] if gap < 0.4 else both if gap < 0.75 else [*both, ""])
    return out


class Readers:
    """The fitted models."""

    def __init__(self, line: BoostedTrees, cut: BoostedTrees, rank: BoostedTrees):
        self.line, self.cut, self.rank = line, cut, rank

    @classmethod
    def fit(cls, texts: list[str], lexicon: dict[str, int], seed: int = 6) -> Readers:
        """Fit on labelled rows made from sample texts and lexicon words."""
        rng = random.Random(seed)
        x, y = [], []
        cx, cy = [], []
        words = sorted((w for w in lexicon if w.isalpha() and len(w) > 4), key=lambda w: (-lexicon[w], w))[:TRAIN_WORDS]
        compounds = sorted((w for w in lexicon if "-" in w), key=lambda w: (-lexicon[w], w))[:TRAIN_WORDS]
        for text in texts:
            if max(map(len, text.split("\n"))) > UNWRAPPED:  # never from a page: wrapped here, so that the labels are right
                width = rng.randint(44, 84)
                base = "\n".join("\n".join(_wrap(l, width)) for l in text.split("\n"))
                page = Page(base)
                title = page.heading or "A study of systems"
                if rng.random() < 0.3:  # a piece of a text, without its title
                    page = Page(re.sub(r"(?m)^# .*\n?", "", base, count=1))
                lines, labels = list(page.lines), [0] * len(page.lines)
                spots = [i for i in range(1, len(lines)) if not page.code[i] and not page.code[i - 1] and lines[i].strip()]
                if spots and rng.random() < 0.75:
                    pages = _furniture(rng, title)
                    if rng.random() < 0.6:  # most page ends stand inside a paragraph
                        spots = [i for i in spots if lines[i - 1].strip() and lines[i - 1][-1] not in ".:"] or spots
                    for at, put in sorted(zip(rng.sample(spots, min(len(pages), len(spots))), pages, strict=False), reverse=True):
                        lines[at:at], labels[at:at] = put, [1 if l else 0 for l in put]
                page = Page("\n".join(lines))
                for i in page.candidates():
                    x.append(page.features(i))
                    y.append(labels[i])
        for w in words:
            # pieces of words that are often cut recur themselves, like parts of compounds
            known = [k for k in range(2, len(w) - 1) if w[:k] in lexicon or w[k:] in lexicon]
            for k in (rng.randint(2, len(w) - 2), *rng.sample(known, min(2, len(known)))):
                cx.append(cut_features(w[:k], rng.choice("---" + HYPHENS[1:4]), w[k:], lexicon))
                cy.append(1)
        for w in compounds:
            a, b = w.split("-", 1)
            for _ in range(3):
                cx.append(cut_features(a, "-", b, lexicon))
                cy.append(0)
        ranked = sorted((w for w in lexicon if w.isalpha() and len(w) > 2), key=lambda w: (-lexicon[w], w))[:TRAIN_WORDS]  # short words are misread too
        rank = BoostedTrees(trees=40).fit(*_ranking_rows(ranked, lexicon, rng))
        constant = BoostedTrees(trees=1)
        constant.base = -10.0
        return cls(
            BoostedTrees(trees=60).fit(np.array(x), np.array(y)) if len(set(y)) > 1 else constant,
            BoostedTrees(trees=30).fit(np.array(cx), np.array(cy)) if len(set(cy)) > 1 else constant,
            rank,
        )


def _wrap(line: str, width: int) -> list[str]:
    out, now = [], ""
    for w in line.split(" "):
        if now and len(now) + 1 + len(w) > width:
            out.append(now)
            now = w
        else:
            now = f"{now} {w}" if now else w
    return [*out, now]


_WRITTEN = str.maketrans(SKELETON)


def skeleton(word: str) -> str:
    """A word with confusable characters written alike."""
    return word.translate(_WRITTEN)


@lru_cache(maxsize=1)
def _confusion_tables() -> tuple[dict[int, int], dict[tuple[int, int], np.ndarray]]:
    """(number of each character that is confused, tables [true, seen] of the confusions by their lengths)."""
    number = {ord(c): n for n, c in enumerate(sorted({c for pair in CONFUSIONS for side in pair for c in side}), 1)}
    size = len(number) + 1
    tables = {(i, j): np.zeros((size**i, size**j), bool) for i in (1, 2) for j in (1, 2)}
    index = lambda w: sum(number[ord(c)] * size ** (len(w) - 1 - k) for k, c in enumerate(w))
    for true, seen in CONFUSIONS:
        tables[len(true), len(seen)][index(true), index(seen)] = True
    return number, tables


def edit_costs(seen: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cost with known confusions at 0.2, plain edit distance on the cheapest way) of reading each word as what is seen.

    One dynamic program over all pairs; lengths that differ by more than BAND + 1 cost 99."""
    number, tables = _confusion_tables()
    size, count = len(number) + 1, len(seen)
    n, m = max(map(len, seen), default=0), max(map(len, words), default=0)

    def codes(texts: list[str], width: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
        raw, ids = np.full((width + 1, count), fill, np.int32), np.zeros((width + 1, count), np.int32)
        for k, t in enumerate(texts):
            cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
            raw[: len(cp), k] = cp
            ids[: len(cp), k] = [number.get(c, 0) for c in cp.tolist()]
        return raw, ids

    (s, si), (w, wi) = codes(seen, n, -1), codes(words, m, -2)
    inf = 99.0
    cost, plain = np.full((n + 1, m + 1, count), inf), np.full((n + 1, m + 1, count), inf)
    cost[0, 0] = plain[0, 0] = 0.0

    def better(i: int, j: int, c: np.ndarray, p: np.ndarray) -> None:
        less = c < cost[i, j]
        cost[i, j] = np.where(less, c, cost[i, j])
        plain[i, j] = np.where(less, p, plain[i, j])

    for i in range(n + 1):
        for j in range(max(0, i - BAND), min(m, i + BAND) + 1):
            if i and j:
                same, known = s[i - 1] == w[j - 1], tables[1, 1][wi[j - 1], si[i - 1]]
                step = np.where(same, 0.0, np.where(known, 0.2, 1.0))
                better(i, j, cost[i - 1, j - 1] + step, plain[i - 1, j - 1] + np.where(same, 0.0, 1.0))
            if i:
                better(i, j, cost[i - 1, j] + 1.0, plain[i - 1, j] + 1.0)
            if j:
                better(i, j, cost[i, j - 1] + 1.0, plain[i, j - 1] + 1.0)
            for di, dj in ((1, 2), (2, 1), (2, 2)):
                if i >= di and j >= dj:
                    a = wi[j - 1] if dj == 1 else wi[j - 2] * size + wi[j - 1]
                    b = si[i - 1] if di == 1 else si[i - 2] * size + si[i - 1]
                    known = tables[dj, di][a, b]
                    if known.any():
                        better(i, j, np.where(known, cost[i - di, j - dj] + 0.2, inf), plain[i - di, j - dj] + 2.0)
    ends = np.array([len(t) for t in seen]), np.array([len(t) for t in words]), np.arange(count)
    return (cost[ends], plain[ends]) if count else (np.empty(0), np.empty(0))


#: Most by which places in the two words may differ.
BAND = 4
#: Pairs that are scored together.
SCORED = 4000


def rank_features(seen: list[str], words: list[str], seen_counts: list[int], word_counts: list[int]) -> np.ndarray:
    """Of suspects and their candidates, a row each."""
    rows = []
    for lo in range(0, len(seen), SCORED):
        a, b = seen[lo : lo + SCORED], words[lo : lo + SCORED]
        cost, plain = edit_costs(a, b)
        sizes = np.array([len(x) for x in a], float)
        n, k = np.log1p(np.array(seen_counts[lo : lo + SCORED], float)), np.log1p(np.array(word_counts[lo : lo + SCORED], float))
        rows.append(np.stack([cost, plain, cost / np.maximum([len(x) for x in b], 1), k, k - n, sizes, [float(x[0] == y[0]) for x, y in zip(a, b, strict=True)], [float(any(c.isdigit() for c in x)) for x in a], [float(not x.isascii()) for x in a]], axis=1))
    return np.concatenate(rows) if rows else np.empty((0, 9))


def _grams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + 2] for i in range(len(w) - 1)}


#: Words that the ranking is fitted on, and the letters that are put into them.
RANKED_WORDS, _LETTERS = 700, "abcdefghijklmnoprstuvwyz"


def _ranking_rows(words: list[str], lexicon: dict[str, int], rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """Misread words with their true word (1) and with others of like shape (0); words held out of the lexicon have no true one."""
    index: dict[str, list[str]] = {}
    for w in words:
        for g in sorted(_grams(w)):
            index.setdefault(g, []).append(w)

    def like(seen: str) -> list[str]:
        found = Counter(c for g in sorted(_grams(seen)) for c in index.get(g, ()) if abs(len(c) - len(seen)) <= 2)
        return [c for c, _ in found.most_common(4)]

    def seen_count(word: str) -> int:
        """Of a misreading of ``word``: a share of its count, so that the ratio is the same at every size."""
        return max(1, int(lexicon[word] / DOUBTFUL_RATIO ** rng.uniform(1, 3)))

    rows: list[tuple[str, str, int, int, int]] = []
    for w in words[:RANKED_WORDS]:
        options = [(t, s) for t, s in CONFUSIONS if t in w]
        if options:
            t, s = rng.choice(options)
            at = rng.choice([m.start() for m in re.finditer(re.escape(t), w)])
            seen = w[:at] + s + w[at + len(t) :]
            if seen not in lexicon:
                rows += [(seen, c, seen_count(w), lexicon[c], int(c == w)) for c in sorted({*like(seen), w})]
        rows += [(w, c, seen_count(w), lexicon[c], 0) for c in like(w) if c != w]  # a rare but right word
        a = w[: rng.randint(2, len(w) - 1)]  # a piece of a word
        rows += [(a, c, seen_count(w), lexicon[c], 0) for c in like(a)]
        k = rng.randrange(len(w))  # another right word that differs by a letter
        near = w[:k] + rng.choice(_LETTERS) + w[k + rng.randint(0, 1) :]
        if near not in lexicon and skeleton(near) != skeleton(w):
            rows.append((near, w, seen_count(w), lexicon[w], 0))
    if len({r[4] for r in rows}) < 2:
        return np.array([[9.0] * 9, [0.2] * 9]), np.array([0, 1])
    seen, cand, n, k, y = (list(c) for c in zip(*rows, strict=True))
    return rank_features(seen, cand, n, k), np.array(y)


def fitting_words(words: DataFrame, sent: dict[str, int]) -> dict[str, int]:
    """``sent`` and what else of the lexicon ``words`` (word, n) :meth:`Readers.fit` may look at, so that it fits the same as on the whole of it.

    The number of words depends on TRAIN_WORDS and RANKED_WORDS, not on the lexicon."""

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(size=[len(w) if w.isalpha() else 0 for w in pdf["word"]], compound=["-" in w for w in pdf["word"]])

    shaped = cut_lineage(words.select("word", "n").mapInPandas(shapes, "word string, n long, size int, compound boolean"))
    whole, ranked, compounds = ([(r["word"], r["n"]) for r in shaped.where(kind).orderBy(F.desc("n"), "word").limit(TRAIN_WORDS).collect()] for kind in ("size > 4", "size > 2", "compound"))
    asked = set()
    for w, _ in whole:
        for k in range(1, len(w)):
            asked |= {w[:k], w[k:], f"{w[:k]}-{w[k:]}"}
    for w, _ in compounds:
        a, b = w.split("-", 1)
        asked |= {a + b, a, b}
    for w, _ in ranked[:RANKED_WORDS]:
        asked |= {w[: m.start()] + s + w[m.start() + len(t) :] for t, s in CONFUSIONS for m in re.finditer(re.escape(t), w)}
        asked |= {w[:k] + c + w[k + n :] for k in range(len(w)) for c in _LETTERS for n in (0, 1)}
    shared = words.sparkSession.sparkContext.broadcast(asked - sent.keys())

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[w in shared.value for w in pdf["word"]]]

    more = words.select("word", "n").mapInPandas(pick, "word string, n long").collect()
    return {**sent, **dict(whole), **dict(ranked), **dict(compounds), **{r["word"]: r["n"] for r in more}}


_ALPHABETIC = re.compile(r"[a-z0-9\u00df-\u00f6\u00f8-\u024f\u0370-\u052f\u0561-\u0587]+")


def suspect_form(token: str) -> str | None:
    """Lower-case form of a token that may be a misread word of an alphabet with case, or None.

    Letters of another alphabet among Latin ones take their Latin shape."""
    w = token if token.isascii() or not any("a" <= c <= "z" for c in token.lower()) else normalise(token)
    w = w.lower()
    letters = sum(c.isalpha() for c in w)
    return w if len(w) > 2 and letters > 1 and 2 * letters >= len(w) and _ALPHABETIC.fullmatch(w) else None


def _with_skeleton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words that may be misread or be a reading, with their skeletons."""
    for pdf in batches:
        keep = [suspect_form(w) == w for w in pdf["word"]]
        pdf = pdf[np.array(keep, bool)]
        yield pdf.assign(skel=[skeleton(w) for w in pdf["word"]])


def skeletons(words: DataFrame) -> DataFrame:
    """(word, n, skel) of the words of an alphabet with case."""
    return words.select("word", "n").mapInPandas(_with_skeleton, "word string, n long, skel string")


def doubtful_words(words: DataFrame) -> DataFrame:
    """(word) of ``words`` (word, n, skel) that DOUBTFUL_SWAPS known confusions at most turn into one that is far more frequent.

    Only words of one skeleton are compared, and only with the more frequent ones of it; ratios of counts are the same at every size."""
    often = words.select("skel", F.col("word").alias("cand"), F.col("n").alias("cand_n"))
    most = words.groupBy("skel").agg(F.max("n").alias("most"))
    rare = words.join(most, "skel").where(f"n * {DOUBTFUL_RATIO} < most").drop("most")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen, cand = pdf["word"].tolist(), pdf["cand"].tolist()
            cost = np.concatenate([edit_costs(seen[lo : lo + SCORED], cand[lo : lo + SCORED])[0] for lo in range(0, len(seen), SCORED)]) if seen else np.empty(0)
            yield pdf.loc[cost < 0.2 * DOUBTFUL_SWAPS + 0.1, ["word"]]

    return rare.join(often, "skel").where(f"n * {DOUBTFUL_RATIO} < cand_n").select("word", "cand").mapInPandas(find, "word string").distinct()


def _contents(pages: list[Page], models: Readers) -> tuple[list[set[int]], list[list[int]]]:
    """(lines that are furniture, lines with content) of each page; the lines of all are scored at once."""
    spots = [(p, i) for p, page in enumerate(pages) if len(page.lines) > 1 for i in page.candidates()]
    furniture: list[set[int]] = [set() for _ in pages]
    if spots:
        score = models.line.predict(np.array([pages[p].features(i) for p, i in spots]))
        for (p, i), s in zip(spots, score, strict=True):
            if s > LINE_LIMIT:
                furniture[p].add(i)
    return furniture, [[i for i, (l, c) in enumerate(zip(page.clean, page.code, strict=True)) if l and not c and i not in furniture[p]] for p, page in enumerate(pages)]


def _joins(pages: list[Page], content: list[list[int]]) -> Iterator[tuple[int, int, int, str, str, str, int]]:
    """(page, line, next line, word before the hyphen, hyphen, word after it, its end) wherever a hyphen ends a line."""
    for p, page in enumerate(pages):
        for i, j in zip(content[p], content[p][1:], strict=False):
            if page.clean[i][-1] in HYPHENS:
                m = _CUT.search(page.clean[i])
                h = _HEAD_WORD.match(page.clean[j]) if m else None
                if h:
                    yield p, i, j, m.group(1), m.group(2), h.group(1), h.end()


def _unknown(text: str, lexicon: Mapping[str, int]) -> set[str]:
    """The tokens of a text that the lexicon lacks."""
    return {t for t in set(_TOKEN.findall(_seen(text))) if t not in lexicon and t.lower() not in lexicon}


def asked_words(texts: list[str], models: Readers, lexicon: dict[str, int]) -> list[set[str]]:
    """Per text: the words that :func:`read_pages` looks up and ``lexicon`` lacks."""
    pages = [Page(t) for t in texts]
    asked: list[set[str | None]] = [{w for t in _unknown(text, lexicon) for w in (t, t.lower(), suspect_form(t))} for text in texts]
    for p, _, _, a, _, b, _ in _joins(pages, _contents(pages, models)[1]):
        left, right = a.lower(), b.lower()
        asked[p] |= {left + right, f"{left}-{right}", left, right, suspect_form(a + b)}
    return [{w for w in words if w and w not in lexicon} for words in asked]


def read_pages(texts: list[str], models: Readers, lexicon: dict[str, int], more: list[dict[str, int]] | None = None) -> list[tuple[list[int], list[int], list[tuple[int, str]]]]:
    """Per text: page lines, lines that end in a cut word, and suspects with their lines; lines count from 0.

    The classifiers score the lines of all texts at once.  ``more`` has further lexicon words for each text."""
    pages = [Page(t) for t in texts]
    known: list[Mapping[str, int]] = [ChainMap(m, lexicon) if m else lexicon for m in more] if more else [lexicon] * len(texts)
    furniture, content = _contents(pages, models)
    joins = list(_joins(pages, content))
    rows = [cut_features(a, mark, b, known[p]) for p, _, _, a, mark, b, _ in joins]
    cut_at: list[dict[int, tuple[int, str, str]]] = [{} for _ in pages]
    heads: list[dict[int, int]] = [{} for _ in pages]
    if rows:
        for (p, i, j, a, _, b, end), s in zip(joins, models.cut.predict(np.array(rows)), strict=True):
            if s > CUT_LIMIT:
                cut_at[p][i] = (j, a, b)
                heads[p][j] = end
    out = []
    for p, (page, text) in enumerate(zip(pages, texts, strict=True)):
        suspects: list[tuple[int, str]] = []
        unknown = {t: w for t in _unknown(text, known[p]) if (w := suspect_form(t)) and w not in known[p]}
        for i, (j, a, b) in cut_at[p].items():
            w = suspect_form(a + b)
            if w and w not in known[p]:
                suspects.append((i, f"{w}|{len(a)}|{j}"))
        if unknown:
            for i in content[p]:
                lo, hi = heads[p].get(i, 0), len(page.clean[i]) - (len(cut_at[p][i][1]) + 1 if i in cut_at[p] else 0)
                suspects += [(i, unknown[t]) for t in _TOKEN.findall(_seen(page.clean[i][lo:hi])) if t in unknown]
        out.append((sorted(furniture[p]), sorted(cut_at[p]), suspects))
    return out


def read_page(text: str, models: Readers, lexicon: dict[str, int]) -> tuple[list[int], list[int], list[tuple[int, str]]]:
    """:func:`read_pages` of one text."""
    return read_pages([text], models, lexicon)[0]


#: Texts that are scored together.
TOGETHER = 400
#: Most texts of which the rarer words are sent; more are joined by a shuffle.
TEXTS_SENT = 50_000


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of lower-case words and compounds over all rows of column ``_t``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for lo in range(0, len(pdf), 300):
                n.update(_COUNTED.findall("\n".join(pdf["_t"].iloc[lo : lo + 300]).lower()))
            for w in [w for w in n if "-" in w]:  # a compound counts for its parts too
                for part in w.split("-"):
                    n[part] += n[w]
            yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    return texts.select("_t").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def page_noise(texts: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(noise, corrections): rows (keys..., line_no, noise) and rows (word, correction).

    ``noise`` is cut_word, page_line or misread; line_no counts from 1."""
    found, corrections = page_findings(texts, keys, text)
    return found.select(*keys, "line_no", "noise").distinct(), corrections


def page_findings(texts: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(findings, corrections): rows (keys..., line_no, noise, word, correction) and rows (word, correction); word and correction of misread lines."""
    spark = texts.sparkSession
    base = texts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_t")).where("_t is not null and _t <> ''")
    counts = cut_lineage(word_counts(base).where("n > 1"))
    frequent = counts.where(F.col("n") >= LEXICON_COUNT)
    shaped = cut_lineage(skeletons(frequent))
    doubtful = cut_lineage(doubtful_words(shaped))
    lexicon_df = cut_lineage(frequent.join(doubtful, "word", "left_anti"))
    top = lexicon_df.orderBy(F.desc("n"), "word").limit(LEXICON_LIMIT).toPandas()
    lexicon = dict(zip(top["word"].tolist(), top["n"].tolist(), strict=True))
    drawn = hash_sample(base, [f"_k{i}" for i in range(len(keys))], 3 * TRAIN_TEXTS)
    sample = [r["_t"] for r in drawn if max(map(len, r["_t"].split("\n"))) > UNWRAPPED][:TRAIN_TEXTS]
    cut = lexicon_df.count() > len(lexicon)
    models = Readers.fit(sample, fitting_words(lexicon_df, lexicon) if cut else lexicon)
    shared = spark.sparkContext.broadcast((models, lexicon))
    kinds = ", ".join(f"_k{i} {texts.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    names = [f"_k{i}" for i in range(len(keys))]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, lex = shared.value
        for pdf in batches:
            ids, texts = list(zip(*(pdf[n].tolist() for n in names), strict=True)), pdf["_t"].tolist()
            asked = (a for lo in range(0, len(texts), TOGETHER) for a in asked_words(texts[lo : lo + TOGETHER], m, lex))
            yield pd.DataFrame([(*key, w) for key, words in zip(ids, asked, strict=True) for w in sorted(words)], columns=[*names, "word"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, lex = shared.value
        for pdf in batches:
            ids, texts, out = list(zip(*(pdf[n].tolist() for n in names), strict=True)), pdf["_t"].tolist(), []
            more = [{x["word"]: x["n"] for x in r} if r is not None else {} for r in pdf["_more"]] if cut else None
            read_all = (r for lo in range(0, len(texts), TOGETHER) for r in read_pages(texts[lo : lo + TOGETHER], m, lex, more and more[lo : lo + TOGETHER]))
            for key, (furniture, cuts, suspects) in zip(ids, read_all, strict=True):
                out += [(*key, i + 1, "page_line", None) for i in furniture]
                out += [(*key, i + 1, "cut_word", None) for i in cuts]
                out += [(*key, i + 1, "suspect", w) for i, w in suspects]
            yield pd.DataFrame(out, columns=[*names, "line_no", "noise", "word"])

    if cut:  # each text meets the rarer words that it asks for
        own = base.mapInPandas(ask, f"{kinds}, word string").join(lexicon_df, "word").groupBy(*[F.col(n).alias(f"_own{n}") for n in names]).agg(F.collect_set(F.struct("word", "n")).alias("_more"))
        own = broadcast_if_small(cut_lineage(own), TEXTS_SENT)
        base = base.join(own, reduce(and_, (base[n].eqNullSafe(own[f"_own{n}"]) for n in names)), "left").select(*names, "_t", "_more")
    seen = cut_lineage(base.mapInPandas(read, f"{kinds}, line_no int, noise string, word string").distinct())
    suspects = seen.where("noise = 'suspect'").withColumn("word", F.split("word", r"\|"))
    suspects = suspects.select(*names, "line_no", F.col("word")[0].alias("word"), F.try_element_at("word", F.lit(2)).cast("int").alias("left"), F.try_element_at("word", F.lit(3)).cast("int").alias("other"))
    unknown = suspects.groupBy("word").agg(F.count("*").alias("seen"))
    readings = shaped.join(doubtful, "word", "left_anti").where(r"not word rlike '[0-9]'")
    corrections = cut_lineage(best_corrections(unknown, readings, models.rank))
    hit = suspects.join(corrections, "word")
    # a word cut over two lines is misread on the line on which it differs
    same_left = F.expr("left(word, left) = left(correction, left)")
    line = F.when(F.col("left").isNotNull() & same_left, F.col("other") + 1).otherwise(F.col("line_no"))
    misread = hit.select(*names, line.alias("line_no"), F.lit("misread").alias("noise"), "word", "correction")
    null = F.lit(None).cast("string")
    found = seen.where("noise <> 'suspect'").select(*names, "line_no", "noise", null.alias("word"), null.alias("correction")).unionByName(misread)
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "line_no", "noise", "word", "correction"), corrections


def _grams_of(skel: str) -> Column:
    """The distinct q-grams of a skeleton with its ends."""
    return F.array_distinct(F.expr(f"transform(sequence(1, greatest(length({skel}) + {3 - Q}, 1)), i -> substring(concat('^', {skel}, '$'), i, {Q}))"))


def correction_candidates(suspects: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, seen, cand, cand_n): the lexicon words that share one of a suspect's rarest q-grams and its skeleton's length, but for one.

    ``suspects`` has (word, seen), ``lexicon`` (word, n, skel)."""
    index = lexicon.select(F.col("word").alias("cand"), F.col("n").alias("cand_n"), F.length("skel").alias("size"), F.explode(_grams_of("skel")).alias("gram"))
    held = index.groupBy("gram", "size").agg(F.count("*").alias("df"))
    named = suspects.withColumnRenamed("seen", "n").transform(skeletons).withColumnRenamed("n", "seen")
    probes = named.select("word", "seen", F.length("skel").alias("own"), F.explode(_grams_of("skel")).alias("gram"))
    rarity = probes.join(held.groupBy("gram").agg(F.sum("df").alias("df")), "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = W.partitionBy("word").orderBy("df", "gram")
    rarest = rarity.withColumn("_r", F.row_number().over(rank)).where(f"_r <= {PROBES} and df > 0")
    keyed = rarest.select("word", "seen", "gram", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("size"))
    return keyed.join(index, ["gram", "size"]).select("word", "seen", "cand", "cand_n").distinct()


def best_corrections(suspects: DataFrame, lexicon: DataFrame, rank: BoostedTrees) -> DataFrame:
    """(word, correction) for the suspects with a likely reading; the ranking alone decides."""
    shared = suspects.sparkSession.sparkContext.broadcast(rank)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = shared.value.predict(rank_features(pdf["word"].tolist(), pdf["cand"].tolist(), pdf["seen"].tolist(), pdf["cand_n"].tolist()))
                keep = p > RANK_LIMIT
                yield pd.DataFrame({"word": pdf["word"][keep], "cand": pdf["cand"][keep], "score": p[keep], "cand_n": pdf["cand_n"][keep]})

    order = W.partitionBy("word").orderBy(F.desc("score"), F.desc("cand_n"), "cand")
    return (
        correction_candidates(suspects, lexicon)
        .mapInPandas(score, "word string, cand string, score double, cand_n long")
        .withColumn("_r", F.row_number().over(order))
        .where("_r = 1")
        .select("word", F.col("cand").alias("correction"))
    )


def repaired_text(text: str, page_lines: set[int], cut_lines: set[int], corrections: dict[str, str]) -> str:
    """Continuous paragraphs: furniture gone, cut words joined, misread words replaced, wrapped lines joined.  Lines count from 1."""
    page = Page(text)
    out: list[str] = []
    open_paragraph = cut = False
    blank = True
    for n, (raw, code) in enumerate(zip(page.lines, page.code, strict=True), 1):
        line = raw.strip()
        if code:
            out.append(raw)
            open_paragraph = cut = False
            blank = False
            continue
        if n in page_lines:
            continue
        if not line:
            blank = True
            continue
        fixed = _TOKEN.sub(lambda m: _as_cased(m.group(), corrections.get((suspect_form(m.group()) or ""), None)), line)
        stays = _MARKUP.match(line) is not None
        continues = open_paragraph and not stays and (cut or not blank or (line[:1].islower() and not out[-1].endswith((".", "!", "?", ":"))))
        if continues and cut:
            out[-1] = re.sub(rf"[{HYPHENS}]\s*$", "", out[-1]) + fixed
        elif continues:
            out[-1] = f"{out[-1]} {fixed}"
        else:
            if blank and out:
                out.append("")
            out.append(fixed)
        open_paragraph = not stays or line.startswith(("Abstract", "Index"))
        cut = n in cut_lines
        blank = False
    return "\n".join(out)


def _as_cased(token: str, correction: str | None) -> str:
    if correction is None:
        return token
    return correction.capitalize() if token[:1].isupper() else correction
