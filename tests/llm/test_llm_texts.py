import unicodedata

import pytest

pytest.importorskip("quire.llm")
from pyspark.sql import functions as F

from quire.llm import chunking, confusables, mojibake, residue, scanfix
from quire.llm.sentences import sentence_units


# problem 5
@pytest.mark.parametrize(("a", "b"), [("Düren", "Düren"), ("Ｆｉｇ ３", "Fig 3"), ("a​b­", "ab"), ("ﬁle", "file"), ("Åm", "Åm"), ("rаnkѕ", "ranks"), ("a  b", "a b"), ("3‑2", "3-2"), ("ё", "ë")])
def test_reads_the_same(a, b):
    assert confusables.normalise(a) == confusables.normalise(b)


@pytest.mark.parametrize(("a", "b"), [("4⁸", "48"), ("é", "e"), ("A", "a"), ("2²", "22"), ("٣", "3"), ("क्‍ष", "क्ष")])
def test_reads_differently(a, b):
    assert confusables.normalise(a) != confusables.normalise(b)


def test_mapping_is_consistent():
    mapping = confusables.build_mapping()
    for source, target in mapping.items():
        assert confusables.normalise(target) == target, (source, target)
    for text in ("Плотность ё й", "ελληνικά", "한국어", "日本語。ｶﾞ", "", None, "plain"):
        once = confusables.normalise(text)
        assert confusables.normalise(once) == once
        assert text is None or unicodedata.normalize("NFC", once) == once


def test_composition_is_canonical():
    """Clusters that the mapping does not list are composed from tables as Unicode composes them."""
    import random

    rng, tables = random.Random(1), confusables.composition_tables(confusables.build_mapping())
    marks = [chr(c) for c in range(0x300, 0x345)] + ["\u0327", "\u0323", "\u3099"]
    for _ in range(3000):
        cluster = rng.choice("aeoucnsAEOUyзиかはệấǖ") + "".join(rng.choice(marks) for _ in range(rng.randint(1, 4)))
        assert confusables.composed(cluster, tables) == unicodedata.normalize("NFC", cluster)


def test_classes(spark):
    rows = [("a", 3, "wоrd"), ("a", 1, "word"), ("a", 2, "word"), ("a", 2, "word"), ("b", 4, "word"), ("a", 5, "other"), ("a", 6, "other"), ("a", 7, None), ("a", 8, "")]
    got = confusables.look_alike_classes(spark.createDataFrame(rows, "tbl string, id long, t string"), ["tbl"], "id", "t").collect()
    assert {(r["tbl"], r["id"], r["class_id"]) for r in got} == {("a", 1, 1), ("a", 2, 1), ("a", 3, 1)} and len({r["spelling"] for r in got}) == 2


def test_pairs(spark):
    rows = [("t", 1, "Fig 1"), ("t", 2, "Fig 1"), ("t", 3, "Fig 1"), ("u", 4, "Fig 1"), ("t", 1, "Fig 1"), ("t", 5, None), ("t", 6, ""), ("t", 7, "Fig 2")]
    df = spark.createDataFrame(rows, "tbl string, id bigint, text string").withColumn("_id", F.lit(0))
    got = {tuple(r) for r in confusables.look_alike_pairs(df, ["tbl"], "id", "text").collect()}
    assert got == {("t", 1, 2), ("t", 2, 3)}
    assert confusables.look_alike_pairs(df.limit(0), ["tbl"], "id", "text").count() == 0


# problem 4
def _units(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string").withColumn("unit", F.lit("x"))
    out = {i: [] for i in range(len(texts))}
    for r in sentence_units(df, "id", "t").orderBy("id", "end_pos").collect():
        assert texts[r["id"]][r["start_pos"] : r["end_pos"]] == r["unit"]
        out[r["id"]].append(r["unit"])
    return out


def test_sentences(spark):
    got = _units(
        spark,
        "# Title\n\nWe ran v2.5 (cf. Sec. 3; it works) at e.g. 3.5 GB. See Fig. 2 and etc. Next one! Dr. No. 7 left at 9 p.m. He came back.\n\n| a. b |\n\nFig. 1. One. Two.",
        '"It is stable. We shipped it," wrote Dr. X in 2020. “Stop!” is rare. He said "Go." Then left... and came back.',
        "结果很稳定。“没有。异常。”他说。好！",
        "รูปที่ 12 แสดงผล ดร. X อธิบายว่า ได้ร้อยละ 7.65 เราทดสอบ N บนเครื่อง 6 เครื่อง",
        "यह है। क्या यह है? हाँ!",
        "Auf 3 Knoten, z. B. bei Läufen, am 23. März 2020. Ende usw. Neu.",
        None, "", "   \n\n  ", "no mark", "a. B. C",
    )
    assert got[0] == ["We ran v2.5 (cf. Sec. 3; it works) at e.g. 3.5 GB.", "See Fig. 2 and etc.", "Next one!", "Dr. No. 7 left at 9 p.m.", "He came back.", "Fig. 1. One. Two."]
    assert got[1] == ['"It is stable. We shipped it," wrote Dr. X in 2020.', "“Stop!” is rare.", 'He said "Go."', "Then left... and came back."]
    assert got[2] == ["结果很稳定。", "“没有。异常。”他说。", "好！"]
    assert got[4] == ["यह है।", "क्या यह है?", "हाँ!"]
    assert got[5] == ["Auf 3 Knoten, z. B. bei Läufen, am 23. März 2020.", "Ende usw.", "Neu."]
    assert [got[i] for i in (6, 7, 8, 9)] == [[], [], [], ["no mark"]]
    assert got[10] == ["a.", "B.", "C"]


def test_sentences_of_copies(spark, tmp_path):
    from quire.llm.registry import queries

    rows = [(1, "One. Two."), (2, "Three.\n\n# T\n\nFour. Five"), (1, "One. Two."), (1, "One. Two."), (3, None)]
    df = spark.createDataFrame(rows, "paper_id bigint, md_content string")
    assert sorted(r["end_pos"] for r in sentence_units(df.where("paper_id = 1"), "paper_id", "md_content").collect()) == [4, 4, 4, 9, 9, 9]
    df.repartition(3).write.parquet(str(tmp_path / "paper_md.parquet"))
    got = queries()["p4_sentences"](spark, str(tmp_path))
    assert sorted((r["paper_id"], r["start_pos"], r["end_pos"], r["unit"]) for r in got.collect()) == [(1, 0, 4, "One."), (1, 5, 9, "Two."), (2, 0, 6, "Three."), (2, 13, 18, "Four."), (2, 19, 23, "Five")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # no unit and no text is shuffled


def test_short_forms(spark):
    got = _units(spark, "Gen. Smith met the U.S. Army in Sept. 2020. See Appx. B for it. They left the U.S. The end.", "Figs are sweet. Fighting is not.", "Figure 3 shows it. And that.")
    assert got[0] == ["Gen. Smith met the U.S. Army in Sept. 2020.", "See Appx. B for it.", "They left the U.S.", "The end."]
    assert got[1] == ["Figs are sweet.", "Fighting is not."] and got[2] == ["Figure 3 shows it. And that."]


def test_running_starts(spark):
    from quire.llm.sentences import running_starts

    rows = [[1] * n for n in (0, 1, 2, 255, 256, 257, 1000)] + [list(range(700))]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<int>").select("i", running_starts(F.col("a")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [[sum(r[:k]) for k in range(len(r))] for r in rows]


# problem 3
def test_pieces():
    text = "# A\n\n" + "word " * 300 + "\n\n## B\n\n" + "one two three. " * 60 + "\n\n```\n" + "x = 1\n" * 40 + "```\n\nx" * 3 + "é" * 900
    for size, overlap in ((400, 50), (120, 0), (60, 59), (7, 3)):
        pieces = chunking.pack(text, size, overlap)
        assert all(b - a <= size for a, _, b in pieces) and pieces[0][1] == 0 and pieces[-1][2] == len(text)
        assert all(q[1] == p[2] and q[0] == max(0, q[1] - overlap) for p, q in zip(pieces, pieces[1:]))
        assert "".join(text[s:b] for _, s, b in pieces) == text
    assert chunking.pack("", 10, 2) == [] and chunking.pack("short", 10, 2) == [(0, 0, 5)]
    cut = chunking.pack("# A\n\n" + "a" * 30 + "\n\n# B\n\n" + "b" * 30, 50, 5)
    assert [s for _, s, _ in cut] == [0, 37]


def test_headings_and_lists_stay_together():
    items = "\n".join(f"- item {i}\n  - part a of it\n  - part b of it" for i in range(12))
    text = "# T\n\n" + "One sentence here. " * 20 + "\n\n## A\n\n### B\n\n" + "Some more of it. " * 30 + f"\n\n{items}\n\n## 2. C\n\n| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 40
    for size in (150, 220, 400):
        pieces = [text[a:b] for _, a, b in chunking.pack(text, size, 10)]
        assert "".join(pieces) == text and all(len(p) <= size - 10 for p in pieces)
        assert not any(p.rstrip().split("\n")[-1].startswith("#") for p in pieces)
        assert not any(p.startswith("  - part") for p in pieces)  # an item and its parts fit, so they are not parted


def test_largest_limit_counts(spark):
    limits = spark.createDataFrame([("x", 100, 10), ("x", 200, 20), ("y", 5, 1)], "item_type string, max_chars int, overlap_chars int")
    assert chunking.limit_of(limits, "x") == (200, 20) and chunking.limit_of(limits, "z") == (chunking.NO_LIMIT, 0)


def test_split_oversized(spark):
    df = spark.createDataFrame([(1, "a b " * 50), (2, "short"), (3, None), (4, "")], "id bigint, t string").withColumn("piece_no", F.lit(9))
    rows = chunking.split_oversized(df, "id", "t", 40, 10).collect()
    assert {r["id"] for r in rows} == {1, 2} and all(len(r["piece"]) <= 40 for r in rows)
    with pytest.raises(ValueError):
        chunking.split_oversized(df, "id", "t", 10, 10)


# problem 9
CLEAN = ["Le coût d’accès a été réduit à 10 °C près.", "Größe und Maß für übervolle Puffer.", "Это важный результат для коротких запросов!", "结果很稳定，没有异常。", "El número de años también cambió.", "“Nobody reads the log!” is what “é” and “ü” stand for; see “a”, “b”."] * 40


def _repairer():
    import pandas as pd

    counts = next(mojibake._pair_counts(iter([pd.DataFrame({"_t": CLEAN})])))
    return mojibake.Repairer(mojibake.Costs(counts["pair"].to_numpy(), counts["n"].to_numpy()))


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1251", "latin-1")])
def test_round_trip(written, read):
    r = _repairer()
    for text in CLEAN[:5]:
        try:
            garbled = text.encode(written).decode(read)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if garbled != text and text != CLEAN[3]:
            assert r.text(garbled) == (True, text, True), garbled


def test_nested_and_clean():
    r = _repairer()
    text = CLEAN[4]
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert r.text(twice)[:2] == (True, text)
    deep = text
    for _ in range(5):
        deep = deep.encode().decode("latin-1")
    assert r.text(deep)[:2] == (True, text)
    assert all(not r.text(t)[0] for t in [*CLEAN[:5], "ascii only", "We saw the sequence â€™ in 22 files and fixed it.", "It shows “Ã©” instead of “é”, which we repair."])
    assert r.text("caf� au lait") == (True, "caf� au lait", False)


def test_repair_frame(spark):
    bad = CLEAN[0].encode().decode("cp1252")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CLEAN, bad, bad, "", None, "plain"])], "id bigint, t string")
    rows = mojibake.repair_encoding(df, "id", "t").where("garbled").collect()
    assert {r["id"] for r in rows} == {240, 241} and {r["restored_text"] for r in rows} == {CLEAN[0]}
    assert mojibake.repair_encoding(df.limit(0), "id", "t").count() == 0


# problem 1
PROSE = ["We deploy the cache on four nodes and replay the traces. Results are stable within one rack, as expected.", "The figure shows throughput for adaptive meshes, with one system ahead by ten percent.", "Compared with the baseline, the query planner needs less memory for sequential scans.", "The service of the second tier answered most of the requests in time, until the load grew.", "A field of the record is written to the log before the engine expands the queue.", "While the first node was drained, three percent of the traffic went over the other link."] * 20


def test_residue(spark):
    m = residue.Model.fit(PROSE)
    for bad in ("Error 404: Not Found", "Please enable JavaScript in your browser.", "{{paper.summary}}", "[Insert your abstract here]", "Lectus tempus magna viverra tortor cursus velit massa.", "TODO TODO TODO TODO TODO TODO TODO TODO"):
        assert m.units(bad), bad
        assert m.units(PROSE[0] + "\n\n" + bad + "\n\n" + PROSE[1]), bad
    for good in [*PROSE[:3], "While failing over, the service answered 3% of the requests with “503 Service Unavailable” until the queue drained.", "A template field like {{title}} is expanded by the engine before the record is written to the log.", "```\nurl: {{ host }}/v1\n```", "", "x"]:
        assert not m.units(good), good
    df = spark.createDataFrame([("t", 1, "Error 404: Not Found"), ("t", 2, PROSE[0]), ("t", 3, None), ("t", 4, ""), (None, 5, "{{title}} and {{abstract}}")], "tbl string, id bigint, text string")
    found = residue.residue_units(df, ["tbl", "id"], "text", m)
    assert {r["id"] for r in found.collect()} == {1, 5}
    assert {r["id"] for r in residue.without_residue(df, ["tbl", "id"], found).collect()} == {2, 3, 4, 5}


def test_residue_in_other_words(spark):
    """Notices that are not in the grammar as they are, unfilled fields of other kinds, and half of the grammar held out."""
    notices = ["%(title)s", "__SECTION_TITLE__", "[object Object]", "#{caption}", "Captcha expired, please try again.", "This document cannot be shown because scripts are turned off.", "Sorry, we could not find that page on our server.", "Type the name of the figure here", "Access to this document was denied.", "qux qux qux qux qux qux"]
    full = residue.Model.fit(PROSE)
    assert [n for n in notices if not full.units(n)] == []
    assert not full.units("The reader sees Index Terms, query planner, query planner, query planner and no more.")
    for side in (0, 1):
        half = residue.Model.fit(PROSE, leave_out=lambda n, side=side: n % 2 == side)
        out = residue.grammar(per_phrase=3, seed=9, leave_out=lambda n, side=side: n % 2 != side)[0]
        out = [t for t in out if len(t) > 20][:300]
        assert sum(bool(half.units(t)) for t in out) / len(out) > 0.7


# problem 6
def test_scanned_pages(spark):
    words = "the lightweight metadata service keeps approximately seven megabytes of state per node while producer-consumer workflows dominate over a congested fabric and latency grows with clients"
    clean = [(f"# Study {i}\n\n" + (words + ". ") * 4 + "\n\n" + (words + ". ") * 3) for i in range(60)]
    scan = "# A study of systems\n\nthe lightweight metadata service keeps appro-\nximately seven megabytes of state per node while\n\n— 84 —\n\nproducer-consumer workflows dominate over a con¬\ngested fabric and lafency grows with clients\nwhile producer-\nconsumer workflows dominate over a congested"
    df = spark.createDataFrame([*enumerate(clean), (99, scan), (98, None), (97, "")], "id bigint, t string")
    noise, corrections = scanfix.page_noise(df, ["id"], "t")
    got = {(r["line_no"], r["noise"]) for r in noise.where("id = 99").collect()}
    assert {(3, "cut_word"), (6, "page_line"), (8, "cut_word"), (9, "misread")} <= got and (10, "cut_word") not in got
    assert {(r["word"], r["correction"]) for r in corrections.collect()} >= {("lafency", "latency")}
    fixed = scanfix.repaired_text(scan, {6}, {3, 8}, {"lafency": "latency"})
    assert "approximately seven megabytes of state per node while producer-consumer workflows dominate over a congested fabric and latency grows" in fixed and "84" not in fixed


def test_recurring_misreadings(spark):
    words = "the lightweight metadata service keeps approximately seven megabytes of state per node while producer-consumer workflows dominate over a congested fabric and latency grows with clients"
    clean = [(f"# Study {i}\n\n" + (words + ". ") * 4 + "\n\n" + (words + ". ") * 3) for i in range(60)]
    scan = "# A study of systems\n\nthe lightweight metaclata service keeps seven\nmegabytes of state per node while workflows dominate\nover a congested fabric and lafency grows wifh clients"
    pages = [(100 + i, f"{scan}\nover a congested fabric {i}") for i in range(8)]  # more often than LEXICON_COUNT
    df = spark.createDataFrame([*enumerate(clean), *pages], "id bigint, t string")
    noise, corrections = scanfix.page_noise(df, ["id"], "t")
    assert {(r["word"], r["correction"]) for r in corrections.collect()} == {("lafency", "latency"), ("metaclata", "metadata"), ("wifh", "with")}
    assert {(r["id"], r["line_no"]) for r in noise.where("noise = 'misread'").collect()} == {(i, n) for i, _ in pages for n in (3, 5)}


def test_doubtful_words(spark):
    for size in (1, 1000):
        counts = {"node": 210 * size, "n0de": 10 * size, "hat": 100 * size, "bat": 100 * size, "the": 900 * size, "metadata": 400 * size, "metaclata": 12 * size}
        words = scanfix.skeletons(spark.createDataFrame(list(counts.items()), "word string, n long"))
        assert {r["word"] for r in scanfix.doubtful_words(words).collect()} == {"n0de", "metaclata"}


def test_skeletons_and_costs():
    assert all(scanfix.skeleton(t) == scanfix.skeleton(s) for t, s in scanfix.CONFUSIONS)
    seen, words = ["metaclata", "n0de", "wifh", "cat", "modem", "", "abc"], ["metadata", "node", "with", "cart", "modern", "a", "abc"]
    cost, plain = scanfix.edit_costs(seen, words)
    assert cost.round(6).tolist() == [0.2, 0.2, 0.2, 1.0, 0.2, 1.0, 0.0] and plain.tolist() == [2.0, 1.0, 1.0, 1.0, 2.0, 1.0, 0.0]
    assert scanfix.suspect_form("Вода3") == "вода3" and scanfix.suspect_form("nоde") == "node" and scanfix.suspect_form("結果") is None and scanfix.suspect_form("a1") is None


def test_candidates_grow_with_like_words_only(spark):
    """Every misreading by known confusions finds its word; a lexicon ten times as large adds few candidates to a suspect."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdefghiklmnoprstuvw") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(2, 3)))
    small = sorted({word() for _ in range(300)})
    large = sorted({*small, *(word() for _ in range(6000))})
    pairs = []
    for w in small:
        t, s = rng.choice([(t, s) for t, s in scanfix.CONFUSIONS if t in w])
        pairs.append((w.replace(t, s, 1), w))
    suspects = spark.createDataFrame(sorted({(s, 1) for s, _ in pairs}), "word string, seen long")
    sizes = []
    for lexicon in (small, large):
        words = scanfix.skeletons(spark.createDataFrame([(w, 50) for w in lexicon], "word string, n long"))
        got = scanfix.correction_candidates(suspects, words).collect()
        assert {(s, w) for s, w in pairs} <= {(r["word"], r["cand"]) for r in got}
        sizes.append(len(got) / suspects.count())
    assert sizes[1] / sizes[0] < len(large) / len(small) and sizes[1] < 0.05 * len(large)


def test_words_beyond_the_lexicon_limit(spark, monkeypatch):
    words = "the lightweight metadata service keeps approximately seven megabytes of state per node while producer-consumer workflows dominate over a congested fabric and latency grows with clients"
    clean = [(f"# Study {i}\n\n" + (words + ". ") * 4 + "\n\n" + (words + ". ") * 3) for i in range(60)]
    monkeypatch.setattr(scanfix, "LEXICON_LIMIT", 12)
    noise, corrections = scanfix.page_noise(spark.createDataFrame(list(enumerate(clean)), "id bigint, t string"), ["id"], "t")
    assert corrections.collect() == [] and noise.where("noise = 'misread'").count() == 0


def test_every_pair_is_counted(spark, monkeypatch):
    monkeypatch.setattr(mojibake, "PAIR_LIMIT", 3, raising=False)  # no such limit may matter
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    df = spark.createDataFrame(list(enumerate(CLEAN)), "id bigint, t string")
    mojibake.repair_encoding(df, "id", "t")
    pairs = {r["pair"]: r["n"] for r in mojibake.pair_table(df, "t").collect()}
    assert len(pairs) > 3 and [dict(zip(*v, strict=True)) for v in sent] == [pairs]


def test_long_quotations(spark):
    inner = "It ran well. " * 60
    texts = [f'They wrote {a}{inner.strip()}{b} and left. Then it ended.' for a, b in ('""', "“”", "«»", "()")]
    rows = sentence_units(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()
    assert sorted(r["id"] for r in rows) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_residue_is_fitted_on_every_row(spark):
    """A notice in a language that the grammar lacks is learnt wherever it stands; order and partitions do not matter."""
    notice = "Vinsamlegast kveiktu á JavaScript. Error 404: Not Found."
    texts = [f"{PROSE[i % len(PROSE)]}\n\nRun {i} is like the others." for i in range(4000)]
    texts[1234] = f"{notice}\n\n{PROSE[0]}"
    df = spark.createDataFrame([*((t,) for t in texts), (None,), ("",)], "_t string")
    want = residue.Model.fit(texts)
    for rows in (df, df.repartition(7)):
        got = residue.fit_model(rows)
        assert (got.tables == want.tables).all() and got.units(notice)
    counts = residue.gram_counts(df.where("_t <> ''"))
    assert counts[0].sum() == sum(len(t) + 2 for t in texts)


def test_residue_does_not_depend_on_neighbours():
    m = residue.Model.fit(PROSE)
    texts = ["410 Gone", PROSE[0], "404", "x", "{{title}}", *PROSE[1:3]]
    assert m.score(texts) == [m.units(t) for t in texts] and m.score(texts[::-1]) == [m.units(t) for t in texts[::-1]]


def test_lexicon_limit_changes_no_result(spark, monkeypatch):
    """Cut and misread words are read with the whole lexicon, however few of its words are sent."""
    words = "the lightweight metadata service keeps approximately seven megabytes of state per node while producer-consumer workflows dominate over a congested fabric and latency grows with clients"
    rare = ["zebrafinch", "quadrature", "paddleboat", "interlocking", "understudy"]
    clean = [(i, f"# Study {i}\n\n" + (words + ". ") * 4 + "\n\n" + (words + ". ") * 3 + f"Then {rare[i % 5]} and {rare[(i + 1) % 5]} came with long-term fairness.") for i in range(60)]
    scans = [(100, "# A study of systems\n\nthe lightweight service keeps the quad-\nrature of state per node while a zebrafincb\ndominates over a long-\nterm fabric and the under-\nstudy keeps seven megabytes of state per node\nwhile latency grows with clients over a fabric."), (None, "# B\n\nwhile the paddle-\nboat keeps an inter-\nlocking state per node over a congested fabrie")]
    df = spark.createDataFrame([*clean, *scans, (98, None), (97, "")], "id bigint, t string")
    got = []
    for limit, texts_sent in ((300_000, 50_000), (12, 50_000), (12, 0), (1, 50_000)):
        monkeypatch.setattr(scanfix, "LEXICON_LIMIT", limit)
        monkeypatch.setattr(scanfix, "TEXTS_SENT", texts_sent)
        noise, corrections = scanfix.page_noise(df, ["id"], "t")
        got.append((sorted(map(tuple, noise.collect()), key=str), sorted(map(tuple, corrections.collect()))))
    assert {(100, 3, "cut_word"), (100, 6, "cut_word"), (None, 3, "cut_word")} <= set(got[0][0])
    assert got[1:] == got[:1] * 3
