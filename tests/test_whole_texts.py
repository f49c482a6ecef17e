import re

import pytest

from quire.oracle import oracle
from quire.queries import TEXT_OPERATORS, queries

LONG = "Plain words first. " * 20 + "the eﬃcient ﬂow " * 30 + "last words of the document\nsecond\nthird\nfourth line"
PAPER = "# A study\n\n" + "Some ﬁrst sentence of a long paper.   \n" * 200 + "\n\n\n\n3.1 Late heading\n\nSee [1]-[3] at the end.\n\n## References\n\n- [1] A. Author\n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(1, LONG, "en", "web", None), (2, None, None, None, "s")], "doc_id long, text string, lang string, source string, slug string").write.parquet(f"{d}/documents.parquet")
    for t in ("paper_raw", "paper_md"):
        spark.createDataFrame([(1, PAPER), (2, None), (1, PAPER), (3, "one"), (1, PAPER)], "paper_id long, md_content string").write.parquet(f"{d}/{t}.parquet")
    return d


def _md(spark, d, name):
    rows = queries()[name](spark, d).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)  # a paper that was delivered three times counts once
    return {r["doc_id"]: r["md"] for r in rows}


def test_every_character_is_read(spark, folder):
    spelled = lambda t: t.replace("ﬁ", "fi").replace("ﬂ", "fl").replace("ﬃ", "ffi")
    got = _md(spark, folder, "md_ligatures")
    assert set(got) == {f"{t}/{i}" for t in ("paper_raw", "paper_md") for i in (1, 2, 3)}
    assert got["paper_raw/1"] == got["paper_md/1"] == spelled(PAPER) and got["paper_raw/2"] == ""
    assert spelled(LONG) in _md(spark, folder, "ligatures")[1]
    assert _md(spark, folder, "md_rstrip_lines")["paper_md/1"] == "\n".join(l.rstrip() for l in PAPER.split("\n"))
    assert _md(spark, folder, "md_blank_lines")["paper_md/1"] == re.sub(r"\n{3,}", "\n\n", PAPER)


def test_whole_pipeline(spark, folder):
    got = _md(spark, folder, "md_process_markdown")
    assert "### 3.1 Late heading" in got["paper_raw/1"] and "[[2]](#ref-2)" in got["paper_raw/1"] and '<a id="ref-1"></a>' in got["paper_raw/1"]
    assert got["paper_raw/1"].count("Some first sentence of a long paper.") == 200
    plan = queries()["process_markdown"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "last words of the document" in _md(spark, folder, "process_markdown")[1]


def test_texts_are_not_shuffled(spark, folder):
    plan = queries()["md_process_markdown"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # the keys were counted before; here the repeated ones are sent along


def test_every_query_has_sql_and_runs(spark, folder):
    assert set(queries()) == set(oracle())
    for n in (*TEXT_OPERATORS, "embed_figures", "relocate_figures", "unembedded_figures", "code_blocks", "figure_info", "doc_metadata", "enrichment_json", "references_split", "reference_count", "section_title", "equations"):
        assert queries()[n](spark, folder).count() > 0, n
