import random

import pytest

pytest.importorskip("quire.llm")
from pyspark.sql import functions as F

from quire.llm import leakage, mixing, names
from quire.llm.boosting import BoostedTrees


# problem 7
def _sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_leakage_against_brute_force(spark):
    rng = random.Random(7)
    stock = "Read the passage carefully and choose."
    items = [(i, f"{stock} {_sentence(rng, 70)}." if i % 2 else _sentence(rng, 60)) for i in range(12)]
    docs, truth = [], set()
    for d in range(80):
        words = _sentence(rng, 150).split()
        if d % 2 == 0:
            i = rng.randrange(12)
            body = items[i][1].removeprefix(stock).split()
            kind, at = d % 8, rng.randrange(len(body) - 30)
            part = body if kind == 0 else body[at : at + 24]
            if kind == 4:
                part = [w if k % 9 else "other" for k, w in enumerate(part)]
            if kind == 6:
                words[10:10], words[90:90] = part[:12], part[12:]
            else:
                words[40:40] = [w.upper() + "," if k % 5 == 0 else w for k, w in enumerate(part)]
            truth.add((d, i))
        docs.append((d, " ".join(words)))
    docs += [(200, stock + " " + _sentence(rng, 40)), (201, None), (202, ""), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame([*items, (50, None), (51, ""), (52, "two words")], "item_id bigint, passage string")
    assert {tuple(r) for r in leakage.leaked_items(df, "doc_id", "text", it, "item_id", "passage").collect()} == truth
    assert leakage.leaked_items(df, "doc_id", "text", it.limit(0), "item_id", "passage").count() == 0
    assert leakage.leaked_items(df.limit(0), "doc_id", "text", it, "item_id", "passage").count() == 0


# problem 8
def test_mix(spark):
    rows = [(i, "big" if i < 3000 else "small" if i < 3100 else "none", 10) for i in range(3200)]
    counts = spark.createDataFrame(rows, "key bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 4), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    out = mixing.mix(counts, targets, total_tokens=2000).collect()
    n = {s: sum(r["copies"] for r in out if r["source"] == s) for s in ("big", "small", "none")}
    assert abs(n["big"] - 120) <= 1 and abs(n["small"] - 60) <= 1 and n["none"] == 0
    capped = mixing.mix(counts, targets, total_tokens=1_000_000)
    assert {r["copies"] for r in capped.where("source = 'small'").collect()} == {4} and capped.where("source = 'big'").agg(F.max("copies")).first()[0] == 2
    assert sorted(map(tuple, mixing.mix(counts.repartition(7), targets, 2000).collect())) == sorted(map(tuple, out))
    report = {r["source"]: r for r in mixing.shares(counts, targets, capped).collect()}
    assert report["gone"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert report["gone"]["cap_binding"] is True and report["small"]["cap_binding"] is True and report["small"]["most_copies"] == 4
    one, many = (sorted(map(tuple, mixing.mix(counts, targets, 2000, bucket_rows=n).collect())) for n in (10_000, 7))
    assert one == many == sorted(map(tuple, out))  # buckets do not change the result
    assert mixing.mix(counts.limit(0), targets, 2000).count() == 0


def test_token_counts(spark, tmp_path):
    import base64

    path = tmp_path / "bytes.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    df = spark.createDataFrame([(1, "s", "abc"), (1, "s", "abc"), (2, "s", ""), (3, "s", None), (4, None, "x")], "id bigint, source string, text string")
    assert [tuple(r) for r in mixing.token_counts(df, "id", "source", "text", str(path)).collect()] == [(1, "s", 3)]


# problem 2
PEOPLE = ["Katherine Brekupax", "Brekupax, K.", "Brekupax, Kate", "KATHERINE BREKUPAX", "Dr. Katherine Brekupax", "Brekupax Katherine", "Patricia Brekupax", "Trish Brekupax", "Brekupax, P.", "Katherine Brekuupax", "José Narasax", "Jose Narasax", "Narasax, J."]
VENUES = ["Annual Meeting on Scientific Workflows", "Annual Meeting on Scientific Workflows (AMSW)", "AMSW 2021", "Ann. Mtg. Scientific Workflows", "Proceedings of the 7th Annual Meeting on Scientific Workflows", "annual meeting on scientific workfloos", "Symposium on Object Stores", "Object Stores, Symposium on", "SOS-13"]


def test_names(spark):
    rows = [("authors", n) for n in PEOPLE] + [("venue", v) for v in VENUES] + [("authors", None), ("venue", ""), ("authors", PEOPLE[0]), ("authors", "Center for Data Movement, Golveluk"), ("authors", "Golveluk Ctr. for Data Movement")]
    got = {(r["field"], r["name_a"], r["name_b"]) for r in names.link_names(spark.createDataFrame(rows, "field string, name string")).collect()}
    linked = lambda f, a, b: (f, *sorted((a, b))) in got
    for n in PEOPLE[1:6] + PEOPLE[9:10]:
        assert linked("authors", PEOPLE[0], n), n
    for a in PEOPLE[:6]:
        for b in PEOPLE[6:9]:
            assert not linked("authors", a, b), (a, b)
    assert linked("authors", "José Narasax", "Narasax, J.") and linked("authors", "Patricia Brekupax", "Brekupax, P.")
    assert linked("authors", "Center for Data Movement, Golveluk", "Golveluk Ctr. for Data Movement")
    for v in VENUES[1:6]:
        assert linked("venue", VENUES[0], v), v
    assert linked("venue", VENUES[6], VENUES[7]) and linked("venue", VENUES[6], VENUES[8]) and not linked("venue", VENUES[0], VENUES[6])


def test_links_come_from_blocks(spark, monkeypatch):
    """Without suffix blocks nothing is linked; discarding refined blocks loses nothing here."""
    rows = [("authors", n) for n in PEOPLE] + [("venue", v) for v in VENUES[:2] + VENUES[3:]]
    df = spark.createDataFrame(rows, "field string, name string")
    before = {tuple(r) for r in names.link_names(df).collect()}
    monkeypatch.setattr(names, "COMMON", 0)  # every key is refined
    assert {tuple(r) for r in names.link_names(df).collect()} == before
    monkeypatch.setattr(names, "suffix_blocks", lambda reps: reps.select(F.lit("x").alias("key"), "rep").where("false"))
    assert names.link_names(df).count() == 0 < len(before)


def test_lcs():
    assert names.lcs_ratio("abcd", "abcd") == 1 and names.lcs_ratio("", "a") == 0 and names.lcs_ratio("abcd", "abd") == 6 / 7
    assert names.alike("mining", "miinng") > 0 and names.alike("girkisax", "birisax") == 0
    assert names.alike_ratios(["abcde", "ab", "same"], ["abcd", "abc", "same"]).round(3).tolist() == [0.889, 0.0, 1.0] and len(names.alike_ratios([], [])) == 0


def test_boosted_trees():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
