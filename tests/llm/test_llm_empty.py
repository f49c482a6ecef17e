import pytest

pytest.importorskip("quire.llm")

from quire.llm import chunking, confusables, leakage, mixing, mojibake, names, repair, residue, scanfix, sentences
from quire.llm.registry import queries
from quire.llm.sampling import hash_sample


def test_operators_on_empty_tables(spark):
    texts = spark.createDataFrame([], "tbl string, id bigint, text string")
    assert scanfix.page_noise(texts, ["tbl", "id"], "text")[0].count() == 0
    assert residue.residue_units(texts, ["tbl", "id"], "text", residue.Model.fit([])).count() == 0
    assert names.link_names(spark.createDataFrame([], "field string, name string")).count() == 0
    assert chunking.split_oversized(texts, "id", "text", 10, 2).count() == 0
    assert chunking.limit_of(spark.createDataFrame([], "item_type string, max_chars int, overlap_chars int"), "paper_md") == (chunking.NO_LIMIT, 0)
    assert hash_sample(texts, ["id"], 5) == []


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a, b = hash_sample(df, ["k"], 100), hash_sample(df.repartition(7), ["k"], 100)
    assert a == b and 50 < len(a) <= 200


def test_names_of_queries():
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9)} <= set(queries())
    assert mixing.BUCKET_ROWS > 0


def test_clashing_columns_nulls_and_copies(spark):
    """Extra columns named like the operators' own, null keys and texts, repeated rows: nothing fails, nothing leaks into results."""
    long = " ".join(f"w{i}" for i in range(40))
    text = f"One sentence of the document. It has another one!\n\n# Head\n\n{long} " + "word " * 400
    rows = [(1, text, "a", 1, "x"), (1, text, "a", 1, "x"), (2, None, "a", None, None), (None, text, None, 3, "y"), (3, "", "b", 3, "y"), (4, "Größe und Maß​.", "b", 3, "y")]
    df = spark.createDataFrame(rows, "id long, t string, _t string, _id long, word string").selectExpr("*", "_id as _d", "_id as _n", "word as unit", "word as source", "_id as _key", "word as noise", "_id as piece_no", "word as tbl")
    items = spark.createDataFrame([(7, long, 1, "z")], "item long, p string, _n long, _p string")
    assert {r["id"] for r in sentences.sentence_units(df, "id", "t").collect()} == {1, 4, None}
    assert {r["id"] for r in leakage.leaked_items(df, "id", "t", items, "item", "p").collect()} == {1}
    assert {r["id"] for r in chunking.split_oversized(df, "id", "t", 500, 20).collect()} == {1, 4, None}
    assert mojibake.repair_encoding(df, "id", "t").columns == ["id", "garbled", "restored_text", "fully_restored"]
    assert confusables.look_alike_pairs(df, ["tbl"], "id", "t").count() == 0 and confusables.look_alike_classes(df, ["tbl"], "id", "t").count() == 0
    noise, _ = scanfix.page_noise(df, ["tbl", "id"], "t")
    assert noise.columns == ["tbl", "id", "line_no", "noise"]
    found = residue.residue_units(df, ["tbl", "id"], "t", residue.Model.fit([text]))
    assert found.columns == ["tbl", "id", "residue_units", "residue_share"] and residue.without_residue(df, ["tbl", "id"], found).count() <= df.count()
    assert repair.repair_pages(df, ["tbl", "id"], "t").columns == ["tbl", "id", "repaired_text"]
    pub = spark.createDataFrame([("authors", "A. Smithson", "x"), ("authors", "Smithson, A.", None), (None, "B", "x"), ("venue", "   ", "x"), ("authors", "…", "x")], "field string, name string, entity string")
    assert [tuple(r) for r in names.link_names(pub).collect()] == [("authors", "A. Smithson", "Smithson, A.")]
