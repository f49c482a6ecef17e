"""Problem 2: spellings of one person, organisation or venue series.

A name is read into what the comparison needs: people into surname and given name
(or what is known of it), organisations and venues into sets of words without
edition, year and order.  Names with one reading are its members; readings are the
representatives that are compared.

Readings meet only through suffix blocks: every suffix of a word (and every prefix,
for slips near its end) above a minimum length is a key.  A key with many readings
is refined by other fields (the initials of the reading's other words, then the
letter at the word's other end) and discarded only if it is common even then; whole
words are never discarded, and a reading meets itself there too.  Pairs of a block are compared word by word with
the ratio of the longest common subsequence; words agree when they are equal, one
is a slip of the other, or one is cut or an initial.  A reading is then linked to
its best partner: a slip to the more frequent word, a cut name or an initial to the
full name if it is the only one that fits, an acronym to the name that carries it
or has its initials.

Defined results: null and blank names are left out; names count once however many
rows hold them; an initial that fits several given names of a surname is linked
to none of them; names that cannot be read (without a letter) are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.runtime import broadcast_if_small, cut_lineage

MIN_SUFFIX = 3
#: Readings of a block from which a suffix is refined, and from which a refined one is discarded.
COMMON, COMMON_REFINED = 8, 60
#: Least ratio; besides, all but one character of the longer word have to be common.
MIN_RATIO = 0.74
#: A word is taken for a slip of one that is so many times as frequent.
SLIP_FACTOR = 2

# Nicknames and short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sascha xander", "andre": "andy", "anthony": "tony", "christopher": "chris kit", "dmitri": "dima mitya dmitry", "edward": "ed ted eddie ned", "elizabeth": "liz beth eliza betty lisa", "francisco": "fran paco pancho", "giuseppe": "beppe peppe pino", "jonathan": "jon jonny", "jose": "pepe", "jurgen": "juergen",
    "katherine": "kate kathy kat katie", "lukasz": "lukas", "margaret": "maggie peggy meg", "michael": "mike mick", "nathaniel": "nate nat", "oluwaseun": "seun olu", "patricia": "pat trish patty", "robert": "rob bob bobby", "samantha": "sam", "thomas": "tom tommy", "ulrich": "uli ulli", "vladimir": "vova volodya", "william": "will wm bill billy", "yelena": "lena elena", "charles": "charlie chuck", "james": "jim jimmy", "joseph": "joe", "richard": "rick dick", "steven": "steve", "daniel": "dan danny", "benjamin": "ben", "david": "dave", "susan": "sue", "rebecca": "becky", "deborah": "debbie", "jennifer": "jen jenny", "peter": "pete", "gregory": "greg", "matthew": "matt", "nicholas": "nick", "john": "jack",
}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "sir"}
ORGANISATION = {"laboratory": "lab labs laboratory laboratories", "center": "center centre ctr", "department": "dept department", "institute": "inst institute", "university": "univ university", "group": "group", "consortium": "consortium", "school": "school", "college": "college"}
VENUE_WORDS = {"proceedings": "proceedings proc", "international": "international intl int", "conference": "conference conf", "workshop": "workshop wksp", "meeting": "meeting mtg", "journal": "journal j", "symposium": "symposium symp", "transactions": "transactions trans", "european": "european eur", "annual": "annual ann"}
STOP = {"for", "of", "on", "in", "the", "and", "f", "at", "to"}
_FULL = {s: k for k, v in NICKNAMES.items() for s in (k, *v.split())}
_ORG = {s: k for k, v in ORGANISATION.items() for s in v.split()}
_VENUE = {s: k for k, v in VENUE_WORDS.items() for s in v.split()}
_SPECIAL = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
_ACRONYM = re.compile(r"^([A-Z]{2,9})(Net|Sys|X)?$")



def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).translate(_SPECIAL)


def _codes(words: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(words), width), fill, np.int32)
    for n, w in enumerate(words):
        out[n, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair; one dynamic program over all pairs."""
    if not a:
        return np.empty(0, np.int32)
    n, m = max(map(len, a)), max(map(len, b))
    x, y = _codes(a, n, -1), _codes(b, m, -2)
    row = np.zeros((m + 1, len(a)), np.int32)
    for i in range(n):
        left = np.zeros(len(a), np.int32)
        for j in range(m):
            up = row[j + 1].copy()
            row[j + 1] = np.where(x[:, i] == y[:, j], left + 1, np.maximum(up, row[j]))
            left = up
    return row[m]


def alike_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 |longest common subsequence| / (|a| + |b|) of each pair whose words differ by one slip at most, else 0."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int32).reshape(-1, 2)
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    near = np.flatnonzero((out == 0) & (abs(sizes[:, 0] - sizes[:, 1]) <= 1) & (sizes.min(axis=1) > MIN_SUFFIX)) if len(a) else np.empty(0, int)
    if len(near):
        common = common_lengths([a[i] for i in near], [b[i] for i in near])
        ratio = 2 * common / sizes[near].sum(axis=1)
        out[near] = np.where((ratio >= MIN_RATIO) & (common >= sizes[near].max(axis=1) - 1), ratio, 0.0)
    return out


def lcs_ratio(a: str, b: str) -> float:
    """2 |longest common subsequence| / (|a| + |b|)."""
    return 2 * int(common_lengths([a], [b])[0]) / max(1, len(a) + len(b))


def alike(a: str, b: str) -> float:
    """:func:`alike_ratios` of one pair."""
    return float(alike_ratios([a], [b])[0])


def tokens_of(field: str, name: str) -> list[str]:
    """Folded tokens of a name, without titles, editions and years."""
    if field == "authors":
        return [t for t in re.findall(r"[^\W\d_]+", fold(name)) if t not in TITLES]
    name = re.sub(r"\([A-Z][\w-]*\)", " ", name)
    name = re.sub(r"[-' ’]*\b\d{2,4}\b|\b\d+(?:st|nd|rd|th)\b", " ", name)
    return [t for t in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", fold(name)) if t not in STOP]


def _roles(name: str, tokens: list[str]) -> list[int]:
    """For each token of a person 1 where it stands as a given name, -1 where as a surname, 0 where that is not told."""
    long = [i for i, t in enumerate(tokens) if len(t) > 1]
    if "," in name:
        last = len([t for t in re.findall(r"[^\W\d_]+", fold(name.split(",", 1)[0])) if t not in TITLES])
        return [0 if len(t) == 1 else -1 if i < last else 1 for i, t in enumerate(tokens)]
    out = [0] * len(tokens)
    if len(long) == 1 and len(tokens) > 1:
        out[long[0]] = -1
    elif len(long) == 2:
        out[long[0]], out[long[1]] = 1, -1
    return out


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for f, n in zip(pdf["field"], pdf["name"], strict=True):
            tokens = tokens_of(f, n)
            roles = _roles(n, tokens) if f == "authors" and not _is_organisation(tokens) else [0] * len(tokens)
            rows += [(f, n, i, t, r) for i, (t, r) in enumerate(zip(tokens, roles, strict=True))]
        yield pd.DataFrame(rows, columns=["field", "name", "pos", "token", "role"])


def _is_organisation(tokens: list[str]) -> bool:
    return any(t in _ORG for t in tokens)


def read_person(name: str, tokens: list[str], given: set[str], untold: set[str] = frozenset()) -> tuple[str, str] | None:
    """(surname, given): given is a full name, or '~' and what is known of it.

    ``given`` are those of the tokens that are given names; ``untold`` ones, of which
    nothing is known, belong to a given name that follows."""
    given = given | {t for t, after in zip(tokens, tokens[1:], strict=False) if t in untold and after in given}
    plain = re.sub(r"^(?:dr|prof)\.?\s+", "", fold(name))
    # letters typed together, such as JG before or after the surname
    typed = {fold(m) for m in re.findall(r"\b[^\W\d_]{2}\b", name) if m.isupper() and not name.isupper()}
    if "," in plain:
        n = len(re.findall(r"[^\W\d_]+", plain.split(",", 1)[0]))
        surname, rest = tokens[:n], tokens[n:]
        rest = [t if t not in typed else t[0] for t in rest]
    else:
        first = [t for t in tokens if t in given and len(t) > 1 and t not in typed]
        long = [t for t in tokens if len(t) > 1 and t not in given and t not in typed]
        initials = [t[0] for t in tokens if len(t) == 1 or t in typed]
        if not long and len(first) > 1:
            long, first = first[-1:], first[:-1]
        surname = long[-1:] if not first and len(long) > 1 else long
        rest = first or [*long[:-1], *initials]
    if not surname or not rest:
        return None
    surname, full = " ".join(surname), [t for t in rest if len(t) > 1]
    if not full:
        return surname, "~" + rest[0]
    pair = " ".join(full[:2])
    for known in (pair, full[0]):
        if known in _FULL:
            return surname, _FULL[known]
    if re.search(rf"\b{full[0]}\.", plain):  # cut, as in Kat.
        return surname, "~" + full[0]
    return surname, pair if len(full) > 1 and full[1] in given else full[0]


def _spelled_out(field: str, name: str, tokens: list[str]) -> tuple[list[str], list[str]]:
    """(words, cut words) of an organisation or venue: types of institutions and series written out, without 'proceedings'."""
    table = _ORG if field == "authors" else _VENUE
    dotted = {fold(x) for x in re.findall(r"([^\W\d_]+)\.", name)}
    words, cut = set(), set()
    for i, t in enumerate(tokens):
        if t in table and not (t == "proc" and i):
            words.add(table[t])
        elif t in dotted and t not in STOP:
            cut.add(t)
        else:
            words.add(t)
    return sorted(words - {"proceedings"} - STOP), sorted(cut)


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One reading per name: kind p (person), w (words) or a (acronym alone)."""
    for pdf in batches:
        rows = []
        for f, n, tokens, given, untold in zip(pdf["field"], pdf["name"], pdf["tokens"], pdf["given"], pdf["untold"], strict=True):
            tokens = list(tokens)
            if f == "authors" and not _is_organisation(tokens):
                got = read_person(n, tokens, set(given), set(untold))
                if got:
                    rows.append((f, n, "p", [got[0]], [], got[1], None, None))
                continue
            short = _ACRONYM.match(re.sub(r"[-' ’]*\d{2,4}$", "", n).strip()) if f == "venue" else None
            if short:
                rows.append((f, n, "a", [], [], short.group(0), short.group(1), None))
                continue
            words, cut = _spelled_out(f, n, tokens)
            if words or cut:
                carried = re.search(r"\(([A-Z][\w-]*)\)", n) if f == "venue" else None
                order = [_VENUE.get(t, t) for t in tokens]
                initials = "".join(p[0] for w in order if w != "proceedings" for p in w.split("-")).upper() if f == "venue" and "," not in n and not cut else None
                rows.append((f, n, "w", words, cut, "", initials, carried.group(1) if carried else None))
        yield pd.DataFrame(rows, columns=["field", "name", "kind", "words", "cut", "extra", "letters", "acronym"])


_READING = "field string, name string, kind string, words array<string>, cut array<string>, extra string, letters string, acronym string"
#: What makes two names one reading: for people surname and given name, for acronyms their letters, for others their words.
_REP = ["field", "kind", "words", "cut", "extra"]


def suffix_blocks(reps: DataFrame) -> DataFrame:
    """(key, rep): the blocks in which readings meet.

    ``reps`` has (rep, field, kind, words, others): others are the initials of the
    reading, by which common suffixes are refined."""
    word = reps.select("rep", "field", "kind", "others", F.explode("words").alias("word")).where("word <> ''")
    tag = F.concat_ws("|", "field", "kind")
    sizes = f"if(length(word) > {MIN_SUFFIX}, sequence({MIN_SUFFIX}, length(word) - 1), array())"
    parts = F.expr(
        f"concat(array(struct('w' as side, word as part, '' as far)), transform({sizes}, k -> struct('s' as side, right(word, k) as part, left(word, 1) as far)), transform({sizes}, k -> struct('p' as side, left(word, k) as part, right(word, 1) as far)))"
    )
    keyed = word.select("rep", "others", F.explode(parts).alias("k"), tag.alias("tag")).select("rep", "others", "k.side", "k.far", F.concat_ws("|", "tag", "k.side", "k.part").alias("key")).distinct()
    small, common = _by_size(cut_lineage(keyed), COMMON)
    by_others = common.select("rep", "side", "far", F.explode("others").alias("other"), "key").select("rep", "side", "far", F.concat_ws("|", "key", "other").alias("key")).distinct()
    refined, still = _by_size(cut_lineage(by_others), COMMON_REFINED)
    # the letter at the word's other end: a slip there leaves long, rare suffixes whole
    by_far, _ = _by_size(still.where("side <> 'w'").select("rep", "side", "far", F.concat_ws("|", "key", "far").alias("key")).distinct(), COMMON_REFINED)
    whole = still.where("side = 'w'")
    return reduce(DataFrame.unionByName, [x.select("key", "rep") for x in (small, refined, by_far, whole)])


def _by_size(keyed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of at most ``most`` readings, larger ones); blocks of one reading stay only for whole words, where it meets itself."""
    sized = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("_size")), "key").where("_size > 1 or side = 'w'")
    return sized.where(F.col("_size") <= most).drop("_size"), sized.where(F.col("_size") > most).drop("_size")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Distinct (rep_a, rep_b) of readings that share a block, each reading with itself too."""
    return blocks.alias("a").join(blocks.alias("b"), "key").select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b")).where("rep_a <= rep_b").distinct()


def _best_match(words: list[str], cut: list[str], other: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]], bool]:
    """(words to compare, cut words with what they stand for, whether all were placed): equal words first, then in order of likeness of their beginnings."""
    left, right = [w for w in words if w not in other], [w for w in other if w not in words]
    stand = []
    for c in cut:
        fits = [w for w in right if w.startswith(c)]
        if not fits:
            return [], [], False
        stand.append((c, fits[0]))
        right.remove(fits[0])
    if len(left) != len(right):
        return [], stand, False
    pairs = []
    for w in left:
        near = max(right, key=lambda r: (r[:2] == w[:2]) + (r[-2:] == w[-2:]) - abs(len(r) - len(w)))
        pairs.append((w, near))
        right.remove(near)
    return pairs, stand, True


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (rep, to, how, ratio, weight) of pairs of readings in one block, in the direction in which they hold.

    how: self, slip, part (a cut name or an initial fits a full one), near (the same
    with a slip in the surname)."""
    for pdf in batches:
        pairs: list[tuple] = []
        out: list[tuple] = []
        for r in pdf.itertuples(index=False):
            if r.rep_a == r.rep_b:
                out.append((r.rep_a, r.rep_b, "self", 1.0, r.n_a))
            elif r.kind == "p":
                pairs.append((r, r.words_a[0], r.words_b[0]))
            elif r.kind == "w":
                pairs.append((r, None, None))
        people = [(r, a, b) for r, a, b in pairs if a is not None]
        given = [(r.extra_a.lstrip("~"), r.extra_b.lstrip("~")) for r, _, _ in people]
        surnames, firsts = alike_ratios([a for _, a, _ in people], [b for _, _, b in people]), alike_ratios([a for a, _ in given], [b for _, b in given])
        for (r, a, b), (ga, gb), s, g in zip(people, given, surnames, firsts, strict=True):
            if not s:
                continue
            part_a, part_b = r.extra_a.startswith("~"), r.extra_b.startswith("~")
            for x, y, gx, gy, px, py, fx, fy, nx, ny in ((r.rep_a, r.rep_b, ga, gb, part_a, part_b, r.freq_a, r.freq_b, r.n_a, r.n_b), (r.rep_b, r.rep_a, gb, ga, part_b, part_a, r.freq_b, r.freq_a, r.n_b, r.n_a)):
                same = a == b
                slip = not same and fx[0] * SLIP_FACTOR <= fy[0]
                if px and not py and gy.startswith(gx) and (same or slip):
                    out.append((x, y, "part" if same else "near", float(s), ny))
                elif px and py and slip and gy[0] == gx[0]:
                    out.append((x, y, "slip", float(s), fy[0]))
                elif not px and not py and g and (same or slip) and (gx == gy or fx[1] * SLIP_FACTOR <= fy[1]):
                    out.append((x, y, "slip", float(s * g), ny))
                elif not px and not py and gx == gy and not same and min(len(a), len(b)) > 5 and len(gx) > 3 and fx[0] == fy[0] == 1 and x > y:
                    out.append((x, y, "slip", float(s), ny))  # two spellings that are both rare
        rows, ask = [], []
        for r, a, _ in pairs:
            if a is None:
                wa, wb = list(r.words_a), list(r.words_b)
                ca, cb = list(r.cut_a), list(r.cut_b)
                if ca and cb:
                    continue
                for x, y, wx, cx, wy, fx, fy, ny in ((r.rep_a, r.rep_b, wa, ca, wb, r.freq_a, r.freq_b, r.n_b), (r.rep_b, r.rep_a, wb, cb, wa, r.freq_b, r.freq_a, r.n_a)):
                    if (cx is cb and ca) or (cx is ca and cb):
                        continue
                    look, stand, ok = _best_match(wx, cx, wy)
                    if ok and len(look) <= 1 + len(wx) // 3:
                        n_of = dict(zip(wx, fx, strict=False)), dict(zip(wy, fy, strict=False))
                        if all(n_of[0].get(u, 1) * SLIP_FACTOR <= n_of[1].get(v, 1) for u, v in look):
                            rows.append((x, y, "part" if cx else "slip", ny, len(ask), len(look), len(wx)))
                            ask += look
        ratio = alike_ratios([a for a, _ in ask], [b for _, b in ask])
        for x, y, how, n, lo, k, size in rows:
            if (ratio[lo : lo + k] > 0).all():
                out.append((x, y, how, float((ratio[lo : lo + k].sum() + size - k + 1) / (size + 1)), n))
        yield pd.DataFrame(out, columns=["rep", "to", "how", "ratio", "weight"])


def link_names(names: DataFrame) -> DataFrame:
    """(field, name_a, name_b): all pairs of spellings of one entity, the smaller first.

    ``names`` has (field, name); field is 'authors' or 'venue'."""
    spark = names.sparkSession
    setting = "spark.sql.unionOutputPartitioning"  # adaptive execution may merge the partitions of a union's inputs to different numbers
    before = spark.conf.get(setting, "true")
    spark.conf.set(setting, "false")
    try:
        linked = entities(names)
    finally:
        spark.conf.set(setting, before)
    a, b = linked.withColumnRenamed("name", "name_a"), linked.withColumnRenamed("name", "name_b")
    return a.join(b, ["field", "entity"]).where("name_a < name_b").select("field", "name_a", "name_b").distinct()


def entities(names: DataFrame) -> DataFrame:
    """(field, name, entity): the membership of every spelling; two spellings of one entity have one value."""
    distinct = names.where("name is not null and trim(name) <> ''").select("field", "name").distinct()
    tokens = cut_lineage(distinct.mapInPandas(_tokens, "field string, name string, pos int, token string, role int"))
    counted = tokens.groupBy("field", "token").agg(F.countDistinct("name").alias("n"), F.sum("role").alias("role"))
    per_name = tokens.drop("role").join(counted, ["field", "token"]).groupBy("field", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"),
        F.collect_set(F.when((F.col("role") > 0) | F.col("token").isin(sorted(_FULL)), F.col("token"))).alias("given"),
        F.collect_set(F.when((F.col("role") == 0) & (F.col("n") == 1) & (F.length("token") > 2), F.col("token"))).alias("untold"),
    )  # a name's own tokens
    read = cut_lineage(per_name.mapInPandas(_readings, _READING).withColumn("rep", F.xxhash64(*_REP)))
    # a word's frequency is the number of names that are read with it
    word_n = read.select("field", "kind", "name", F.explode("words").alias("word")).groupBy("field", "kind", "word").agg(F.count("*").alias("word_n"))
    given_n = read.where("kind = 'p'").groupBy("field", F.col("extra").alias("given")).agg(F.count("*").alias("given_n"))
    reps = read.groupBy("rep", *_REP).agg(F.count("*").alias("n"), F.min("letters").alias("letters"), F.collect_set("acronym").alias("acronyms"))
    freq = reps.select("rep", "field", "kind", F.posexplode("words").alias("at", "word")).join(word_n, ["field", "kind", "word"]).groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word_n"))), lambda x: x["word_n"]).alias("freq"))
    initials = F.array_join(F.array_sort(F.transform(F.concat("words", "cut"), lambda w: F.left(w, F.lit(1)))), "")
    others = F.when(F.col("kind") == "p", F.left(F.ltrim("extra", F.lit("~")), F.lit(1))).otherwise(initials)
    reps = reps.join(freq, "rep", "left").join(given_n.withColumnRenamed("given", "extra").withColumn("kind", F.lit("p")), ["field", "kind", "extra"], "left")
    reps = cut_lineage(
        reps.select("rep", *_REP, "n", "letters", "acronyms", F.array(others).alias("others"), F.when(F.col("kind") == "p", F.array(F.col("freq")[0], F.col("given_n"))).otherwise(F.coalesce("freq", F.array().cast("array<bigint>"))).alias("freq"))
    )
    pairs = block_pairs(cut_lineage(suffix_blocks(reps.where("kind <> 'a'"))))
    side = lambda x: reps.select(F.col("rep").alias(f"rep_{x}"), *([F.col("kind")] if x == "a" else []), *[F.col(c).alias(f"{c}_{x}") for c in ("words", "cut", "extra", "n", "freq")])
    met = pairs.join(broadcast_if_small(side("a")), "rep_a").join(broadcast_if_small(side("b")), "rep_b")
    # what one slip rules out needs no comparison word by word
    given = [F.ltrim(c, F.lit("~")) for c in ("extra_a", "extra_b")]
    near_people = (F.levenshtein(F.col("words_a")[0], F.col("words_b")[0]) <= 2) & (given[0].startswith(given[1]) | given[1].startswith(given[0]) | (F.levenshtein(*given) <= 2))
    sizes = [F.size(f"words_{x}") + F.size(f"cut_{x}") for x in "ab"]
    near_words = (sizes[0] == sizes[1]) & (F.size(F.array_except("words_a", "words_b")) <= 1 + sizes[0] / 3 + F.size("cut_b"))
    likely = met.where(F.when(F.col("rep_a") == F.col("rep_b"), True).when(F.col("kind") == "p", near_people).otherwise(near_words))
    links = cut_lineage(likely.mapInPandas(compared, "rep long, to long, how string, ratio double, weight long"))
    return cut_lineage(read.join(_resolved(reps, links), "rep").select("field", "name", F.col("entity")).distinct())


def _resolved(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, entity) of all readings that met a partner or themselves in a block."""
    best = W.partitionBy("rep").orderBy(F.desc("ratio"), F.desc("weight"), "to")
    slip = links.where("how = 'slip'").withColumn("_r", F.row_number().over(best)).where("_r = 1").select("rep", "to")
    twice = slip.join(slip.select(F.col("rep").alias("to"), F.col("to").alias("further")), "to", "left").select("rep", F.coalesce("further", "to").alias("root"))
    met = links.where("how = 'self'").select("rep").join(reps.select("rep", "field", "kind", "words", "cut", "extra", "letters", "acronyms"), "rep")
    rooted = cut_lineage(met.join(twice, "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    # cut names and initials: the full readings that fit, by way of their roots
    fits = links.where("how in ('part', 'near')").join(rooted.select(F.col("rep").alias("to"), F.col("root").alias("whole"), "kind"), "to")
    people = fits.where("kind = 'p'").groupBy("rep").agg(F.max((F.col("how") == "part").cast("int")).alias("exact"), F.collect_set(F.when(F.col("how") == "part", F.col("whole"))).alias("parts"), F.collect_set(F.when(F.col("how") == "near", F.col("whole"))).alias("nears"))
    people = people.withColumn("wholes", F.when(F.col("exact") == 1, F.col("parts")).otherwise(F.col("nears")))
    only = people.where("size(wholes) = 1").select("rep", F.col("wholes")[0].alias("whole"))
    usual = W.partitionBy("rep").orderBy(F.desc("ratio"), F.desc("weight"), "to")
    cut = fits.where("kind = 'w'").withColumn("_r", F.row_number().over(usual)).where("_r = 1").select("rep", "whole")
    placed = only.unionByName(cut)
    alone = rooted.join(placed, "rep", "left_anti")
    # people of whom only an initial is known are one per surname and initial
    surname = rooted.select(F.col("rep").alias("root"), F.col("words").alias("root_words"))
    loose = alone.where("kind = 'p' and extra like '~%'").join(surname, "root").select("rep", F.concat(F.element_at("root_words", 1), F.lit("|~"), F.substring("extra", 2, 1)).alias("entity"))
    certain = alone.where("not (kind = 'p' and extra like '~%')").select("rep", F.col("root").cast("string").alias("entity"))
    out = cut_lineage(placed.select("rep", F.col("whole").cast("string").alias("entity")).unionByName(loose).unionByName(certain))
    # acronyms: the name that carries them, else the one with such initials
    series = rooted.where("kind = 'w' and field = 'venue'").join(out, "rep")
    carried = series.select("entity", F.explode("acronyms").alias("acronym")).groupBy("acronym").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("n")).where("n = 1").drop("n")
    lettered = series.where("letters is not null").groupBy("letters").agg(F.min("entity").alias("by_letters"), F.countDistinct("entity").alias("n")).where("n = 1").drop("n")
    short = reps.where("kind = 'a'").select("rep", F.col("extra").alias("acronym"), "letters").join(carried, "acronym", "left").join(lettered, "letters", "left")
    return out.unionByName(short.select("rep", F.coalesce("entity", "by_letters", F.concat(F.lit("~"), "acronym")).alias("entity")))
