import pytest

pytest.importorskip("quire.llm")

from quire.llm.registry import queries


def test_pieces_have_their_text(spark, tmp_path):
    text = "One sentence of a paper stands here. " * 40
    spark.createDataFrame([(1, text), (1, text), (2, "short"), (3, None)], "paper_id long, md_content string").write.parquet(f"{tmp_path}/paper_md.parquet")
    spark.createDataFrame([("paper_md", 300, 50)], "item_type string, max_chars int, overlap_chars int").write.parquet(f"{tmp_path}/chunk_limit.parquet")
    rows = queries()["p3_pieces"](spark, str(tmp_path)).orderBy("paper_id", "piece_no").collect()
    long = [r for r in rows if r["paper_id"] == 1]
    assert [r["piece"] for r in rows if r["paper_id"] == 2] == ["short"] and len(long) > 4
    assert "".join(r["piece"][r["new_pos"] - r["start_pos"] :] for r in long) == text
    for a, b in zip(long, long[1:], strict=False):
        assert len(b["piece"]) <= 300 and b["new_pos"] - b["start_pos"] == 50 and a["piece"][-50:] == b["piece"][:50]
    assert [r["paper_id"] for r in queries()["p3_found"](spark, str(tmp_path)).collect()] == [1]


PROSE = ["The scheduler places each task near the data that it reads, and the runtime grows with the number of nodes.", "Figure 3 shows the throughput of the metadata service under a growing number of clients."]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("records"))
    raw = [(1, PROSE[0]), (2, "Error 404: Not Found"), (3, None), (4, "ﬁle  ｆｏｕｒ"), (4, "ﬁle  ｆｏｕｒ"), (5, "")]
    spark.createDataFrame(raw, "paper_id long, md_content string").write.parquet(f"{d}/paper_raw.parquet")
    spark.createDataFrame([(1, PROSE[1])], "paper_id long, md_content string").write.parquet(f"{d}/paper_md.parquet")
    spark.createDataFrame([(1, "Fig 3", PROSE[1]), (2, "Ｆｉｇ ３", "{{title}} and {{abstract}}")], "fig_key long, caption string, description string").write.parquet(f"{d}/figure_info.parquet")
    return d


def test_consistent_texts(spark, records):
    got = {(r["tbl"], r["id"], r["text"]) for r in queries()["p5_consistent"](spark, records).collect()}
    raw = {(1, PROSE[0]), (2, "Error 404: Not Found"), (3, None), (4, "file four"), (5, "")}
    assert got == {("paper_raw", *r) for r in raw} | {("figure_info", 1, "Fig 3"), ("figure_info", 2, "Fig 3")}
    assert queries()["p5_consistent"](spark, records).count() == len(got)


def test_kept_records(spark, records):
    kept = queries()["p1_kept"](spark, records)
    found = {(r["tbl"], r["rec_id"]) for r in queries()["p1_found"](spark, records).collect()}
    assert ("paper_raw", 2) in found and kept.columns == ["tbl", "rec_id", "text"]
    every = {("paper_raw", 1, PROSE[0]), ("paper_raw", 2, "Error 404: Not Found"), ("paper_raw", 4, "ﬁle  ｆｏｕｒ"), ("figure_info", 1, PROSE[1]), ("figure_info", 2, "{{title}} and {{abstract}}")}
    assert {tuple(r) for r in kept.collect()} == {r for r in every if r[:2] not in found}
