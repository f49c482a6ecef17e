"""Problem 5: texts that look the same but differ in their characters.

A mapping from grapheme clusters to one consistent form is built by rule
(width folding, canonical composition, spaces, invisible characters, joined
letters) and from the fixed homoglyph pairs below, checked for conflicts and
compiled into one longest-match pattern.  Each text is then rewritten in a
single pass; ASCII text without runs of spaces is its own normal form.

Defined results: null stays null; '' stays ''; a text of invisible characters
only becomes ''.  The mapping is idempotent, so repeated rows and already
normalised texts do not change.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.runtime import cut_lineage

# Letters of another alphabet with the shape of a Latin letter.
CYRILLIC = "асеорхуіјѕһԁԛԝѵүӏАВЕКМНОРСТХЅІЈԌԚԜУҮӀѴ"
CYRILLIC_AS = "aceopxyijshdqwvylABEKMHOPCTXSIJGQWYYIV"
GREEK = "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "ovABEZHIKMNOPTYX"
ARMENIAN = "օոսհց"
ARMENIAN_AS = "onuhg"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ"
CHEROKEE_AS = "ABCDEGHJKLMPRSTVWZ"
#: Marks with the shape of another mark.
MARKS = "\u2010\u2011\u00b5"
MARKS_AS = "--\u03bc"
#: Joiners stay where they change the shape of what they join: after a virama or between Arabic letters.
JOINERS = "\u200c\u200d"
VIRAMAS = "\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d\u0dca"


class MappingConflict(ValueError):
    """The rules map one cluster to two forms, or a form is itself rewritten."""


def _joined_letters() -> Iterator[tuple[str, str]]:
    for block in (range(0xFB00, 0xFB07), range(0xFB13, 0xFB18), (0x132, 0x133), range(0x1C4, 0x1CD), (0x1F1, 0x1F2, 0x1F3)):
        for cp in block:
            yield chr(cp), unicodedata.normalize("NFKC", chr(cp))


def _wide_forms() -> Iterator[tuple[str, str]]:
    for cp in (*range(0xFF01, 0xFFEF),):
        ch = chr(cp)
        if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            yield ch, unicodedata.normalize("NFKC", ch)


def _numerals_and_small_forms() -> Iterator[tuple[str, str]]:
    """Roman numerals of one character, and the small forms of punctuation."""
    for cp in (*range(0x2160, 0x2180), *range(0xFE50, 0xFE6C)):
        ch = chr(cp)
        if unicodedata.decomposition(ch).startswith(("<compat>", "<small>")):
            yield ch, unicodedata.normalize("NFKC", ch)


def _spaces() -> Iterator[tuple[str, str]]:
    for cp in range(0xA0, 0x3001):
        if unicodedata.category(chr(cp)) == "Zs":
            yield chr(cp), " "


def _invisible() -> Iterator[tuple[str, str]]:
    for cp in (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF):
        yield chr(cp), ""


def _compositions(shapes: dict[str, str]) -> Iterator[tuple[str, str]]:
    """Canonical singletons (such as the Kelvin sign) and base+marks sequences that have a composed letter; a base of another alphabet takes its Latin shape first."""
    for cp in (*range(0xA0, 0xAC00), *range(0xF900, 0x10000)):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and not 0xAC00 <= cp <= 0xD7A3 and unicodedata.category(ch) != "Zs":
            full = unicodedata.normalize("NFD", ch)
            composed = unicodedata.normalize("NFC", "".join(shapes.get(c, c) for c in full))
            for source in {ch, full} - {composed}:
                yield source, composed


def build_mapping() -> dict[str, str]:
    """All rules merged; raises MappingConflict when two rules disagree or a result would be rewritten again."""
    look_alike = list(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + MARKS, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + MARKS_AS, strict=True))
    mapping: dict[str, str] = {}
    for rule in (look_alike, _joined_letters(), _wide_forms(), _numerals_and_small_forms(), _spaces(), _invisible(), _compositions(dict(look_alike))):
        for source, target in rule:
            if mapping.setdefault(source, target) != target:
                raise MappingConflict(f"{source!r}: {mapping[source]!r} and {target!r}")
    for source, target in list(mapping.items()):  # close under itself: a composed letter may be a look-alike
        seen = {source}
        while (again := "".join(mapping.get(c, c) for c in target)) != target:
            if target in seen:
                raise MappingConflict(f"{source!r} is rewritten for ever")
            seen.add(target)
            target = again
        mapping[source] = target
    return mapping


def composition_tables(mapping: dict[str, str]) -> tuple[dict[str, str], dict[str, int], dict[tuple[str, str], str]]:
    """(full decompositions, classes of marks, compositions of two characters): what a cluster with several marks, which the mapping does not list, is put together from."""
    parts, order, pairs = {}, {}, {}
    for cp in (*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x1D165, 0x1D1AE)):
        ch = chr(cp)
        if unicodedata.combining(ch):
            order[ch] = unicodedata.combining(ch)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<":
            parts[ch] = unicodedata.normalize("NFD", ch)
            two = [chr(int(x, 16)) for x in d.split()]
            if len(two) == 2 and unicodedata.normalize("NFC", ch) == ch:
                pairs[two[0], two[1]] = ch
    return parts, order, pairs


def composed(cluster: str, tables: tuple[dict[str, str], dict[str, int], dict[tuple[str, str], str]]) -> str:
    """A cluster of a base and marks with its marks in canonical order, composed as far as there is a letter."""
    parts, order, pairs = tables
    full = "".join(parts.get(c, c) for c in cluster)
    base, marks = full[:1], sorted(full[1:], key=lambda c: order.get(c, 0)) if all(c in order for c in full[1:]) else list(full[1:])
    rest, last = [], 0
    for m in marks:
        one = pairs.get((base, m)) if order.get(m, 0) > last or not rest else None
        if one:
            base = one
        else:
            rest.append(m)
            last = order.get(m, 0)
    return base + "".join(rest)


@lru_cache(maxsize=1)
def _transducer():
    mapping = build_mapping()
    tables = composition_tables(mapping)
    marks = "".join(chr(c) for c in range(0x300, 0x370)) + "".join(chr(c) for c in (*range(0x1AB0, 0x1ACF), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x20F1), 0x3099, 0x309A, 0xFF9E, 0xFF9F))
    klass = lambda s: "".join(f"\\U{ord(c):08x}" for c in sorted(set(s)))
    single = klass(c for c in mapping if len(c) == 1 and c not in JOINERS)
    m, hidden = klass(marks), klass(JOINERS) + klass(chr(c) for c in (0xAD, 0x200B, 0x2060, 0xFEFF))
    spaces = "[ \\t" + klass(c for c, t in mapping.items() if t == " ") + "]{2,}"
    joiner = f"(?<![{klass(VIRAMAS)}\\u0600-\\u06ff])[{klass(JOINERS)}]"
    touched = re.compile(f"[{single}{m}{klass(JOINERS)}]|[ \\t]{{2,}}|\\t")
    marked = re.compile(f"[{m}]")
    plain = re.compile(f"{spaces}|[{single}\\t]|{joiner}")
    clusters = re.compile(f"[^{m}\\s][{hidden}]*[{m}]+|{spaces}|[{single}\\t]|{joiner}")  # marks, with invisible characters before them, belong to the base
    cache: dict[str, str] = {}

    def emit(match: re.Match) -> str:
        cluster = match.group()
        out = cache.get(cluster)
        if out is None:
            out = mapping.get(cluster)
            if cluster[0] in " \t" or mapping.get(cluster[0]) == " ":
                out = " "
            if out is None:
                bare = "".join(mapping.get(c, c) for c in cluster if mapping.get(c) != "")
                out = composed(bare, tables)
            if len(cache) < 100_000:
                cache[cluster] = out
        return out

    return touched, marked, plain, clusters, emit


def normalise(text: str | None) -> str | None:
    """The consistent form of a text: one pass of the transducer over its grapheme clusters."""
    if text is None or (text.isascii() and "  " not in text and "\t" not in text):
        return text
    touched, marked, plain, clusters, emit = _transducer()
    if not touched.search(text):
        return text
    return (clusters if marked.search(text) else plain).sub(emit, text)


@F.pandas_udf(T.StringType())
def _normalise_udf(s: pd.Series) -> pd.Series:
    return s.map(normalise, na_action="ignore")


def consistent_form(text: Column) -> Column:
    """Column form of :func:`normalise`."""
    return _normalise_udf(text)


KEYS = T.StructType([T.StructField("form_key", T.BinaryType()), T.StructField("text_key", T.BinaryType())])


@F.pandas_udf(KEYS)
def _keys_udf(s: pd.Series) -> pd.DataFrame:
    forms, texts = [], []
    for t in s:
        form = normalise(t)
        if not form:
            forms.append(None)
            texts.append(None)
            continue
        raw = t.encode("utf-8", "surrogatepass")
        texts.append(blake2b(raw, digest_size=16).digest())
        forms.append(texts[-1] if form == t else blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest())
    return pd.DataFrame({"form_key": forms, "text_key": texts})


def _spellings(df: DataFrame, keys: list[str], record: str, text: str) -> DataFrame:
    """(_k…, _id, _f, _x): records whose form has several spellings, with the digests of form and text; written once."""
    rows = (
        df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(record).alias("_id"), F.col(text).alias("_t"))
        .where("_t is not null and _t <> '' and _id is not null")
        .withColumn("_d", _keys_udf("_t"))
        .select(*[f"_k{i}" for i in range(len(keys))], "_id", F.col("_d.form_key").alias("_f"), F.col("_d.text_key").alias("_x"))
        .where("_f is not null")
    )
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = cut_lineage(rows.distinct())  # texts are read and rewritten once
    spellings = rows.groupBy(*ks, "_f").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_lo <> _hi")
    return rows.join(spellings.drop("_lo", "_hi"), [*ks, "_f"], "left_semi")

def look_alike_classes(df: DataFrame, keys: list[str], record: str, text: str) -> DataFrame:
    """(keys…, record, class_id, spelling): one row per record that reads like another without being the same text.

    Records of one class read the same, those of one spelling are the same characters;
    class_id is the smallest record of the class, spelling a digest."""
    rows = _spellings(df, keys, record, text)
    ks = [f"_k{i}" for i in range(len(keys))]
    first = rows.groupBy(*ks, "_f").agg(F.min("_id").alias("class_id"))
    named = rows.join(first, [*ks, "_f"])
    return named.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_id").alias(record), "class_id", F.lower(F.hex("_x")).alias("spelling"))


def look_alike_pairs(df: DataFrame, keys: list[str], record: str, text: str) -> DataFrame:
    """Pairs (id_a < id_b) of different records with one consistent form but different characters.

    Texts are compared by 128-bit digests, so only keys are shuffled.  Copies of a
    text form one class: classes of a form are paired first and their members
    joined to the class pairs afterwards, so a text that many records share costs
    nothing unless another spelling of it exists.  Null and empty texts have no
    partner; repeated rows count once.  ``keys`` are carried along (for instance
    the table name) and pairs never cross them.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = _spellings(df, keys, record, text)
    classes = rows.select(*ks, "_f", "_x").distinct()
    pairs = (
        classes.withColumnRenamed("_x", "_xa")
        .join(classes.withColumnRenamed("_x", "_xb"), [*ks, "_f"])
        .where("_xa < _xb")
    )
    a = rows.select(*ks, "_f", F.col("_x").alias("_xa"), F.col("_id").alias("_ida"))
    b = rows.select(*ks, "_f", F.col("_x").alias("_xb"), F.col("_id").alias("_idb"))
    return (
        pairs.join(a, [*ks, "_f", "_xa"])
        .join(b, [*ks, "_f", "_xb"])
        .where("_ida <> _idb")
        .select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.least("_ida", "_idb").alias("id_a"), F.greatest("_ida", "_idb").alias("id_b"))
        .distinct()
    )
