import random

from pyspark.sql import functions as F

from quire.operators import bibliography, citations, cleanup, figures
from quire.plans.pipeline import process_markdown


def test_cleanup(apply):
    assert apply(cleanup.cleanup_text, "oﬃce ﬂow – a\n\n\n\nb  \nc ", None, "") == ["office flow - a\n\nb\nc", None, ""]
    assert apply(cleanup.strip_line_ends, "a \n \n\nb\t") == ["a\n\n\nb"]
    assert apply(cleanup.join_hyphenated, "docu-\n  ment", "Docu-\nMent") == ["document", "Docu-\nMent"]


def test_ranges(apply):
    got = apply(citations.expand_ranges, "[1]-[3]", "[5] – [3].", "[1]-[2]-[4]", "[7]", "[1]-[99999999]", "a [1]\n-\n[2] b [4]—[5]")
    assert got == ["[1], [2], [3]", "[3], [4], [5].", "[1], [2]-[4]", "[7]", "[1]-[99999999]", "a [1], [2] b [4], [5]"]


def test_links(apply):
    got = apply(citations.link_citations, "see [7] and [12].", "[7][8]", "[7](x)", "![[7]", "[1234]")
    assert got == ["see [[7]](#ref-7) and [[12]](#ref-12).", "[[7]](#ref-7)[8]", "[7](x)", "![[7]", "[1234]"]


def test_references(apply, spark):
    text = "Body [1]\n\n## References\n\n- [1] A\n[2] B\n"
    assert apply(citations.process_citations, text) == ['Body [[1]](#ref-1)\n\n## References\n\n<a id="ref-1"></a>[1] A\n<a id="ref-2"></a>[2] B\n']
    assert apply(citations.anchor_references, '<a id="ref-1"></a>\n[1] A') == ['<a id="ref-1"></a>\n[1] A']
    p = spark.createDataFrame([("a\nReferences\nb\n# References\nc",)], "t string").select(citations.split_references(F.col("t")).alias("p")).first()["p"]
    assert (p["body"], p["refs"]) == ("a\nReferences\nb\n", "# References\nc")


def test_bibliography(apply):
    assert apply(bibliography.process_bibliography, "x\n## References\n\n[1] A\n[2] B\nmore\n[3] C", "[1] a\n[2] b") == ["x\n## References\n\n[1] A\n\n[2] B\nmore\n\n[3] C", "[1] a\n[2] b"]
    assert apply(bibliography.reference_count, "[1] a\n [2] b\nc [3]", "") == [2, 0]


def test_spacing_like_a_fold(apply):
    """Random lines against a plain loop."""
    rng = random.Random(4)
    pool = ["[1] a", "- [2] b", '<a id="ref-3"></a>[3] c', "text", "", "  ", " [4] d"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(300)]

    def loop(t):
        out, seen = [], False
        for l in t.split("\n"):
            entry = l.strip().lstrip("- ").startswith(("[", "<a"))
            if entry and seen:
                out.append("")
            out.append(l)
            seen = entry or (seen and l.strip() != "")
        return "\n".join(out)

    assert apply(bibliography.space_entries, *texts) == [loop(t) for t in texts]


def _with_files(spark, text, files):
    df = spark.createDataFrame([(text, files)], "t string, f array<string>")
    return df.select(figures.process_figures(F.col("t"), F.col("f"))).first()[0]


def test_figures(spark):
    df = spark.createDataFrame([(["figure1.png", "logo.png", "Fig_2.png", "figure-1.jpg"],), ([],)], "f array<string>")
    assert [r[0] for r in df.select(figures.figure_map(F.col("f"))).collect()] == [{2: "Fig_2.png", 1: "figure-1.jpg"}, {}]
    text = "As Fig. 1 shows\nFigure 1. Caption\nFig. 3: x"
    assert _with_files(spark, text, ["fig1.png"]) == "![Figure 1](./img/fig1.png)\n\nAs Fig. 1 shows\nFigure 1. Caption\nFig. 3: x"
    assert _with_files(spark, text, []) == text and _with_files(spark, text, None) == text
    docs = spark.createDataFrame([(1, "![Figure 1](a)")], "d int, t string")
    files = spark.createDataFrame([(1, 1, "figure1.png"), (1, 2, "figure2.png")], "d int, num int, filename string")
    assert [r["num"] for r in figures.unembedded_figures(docs, "d", "t", files).collect()] == [2]


def test_pipeline_has_no_exchange(spark):
    df = spark.createDataFrame([("Abstract -x [1]-[2]\n\nFig. 1. c\n\nReferences\n\n- [1] A\n[2] B", ["fig1.png"]), (None, None)], "t string, f array<string>")
    out = df.select(process_markdown(F.col("t"), F.col("f")).alias("o"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = [r["o"] for r in out.collect()]
    assert rows[0] == '## Abstract\n\nx [[1]](#ref-1), [[2]](#ref-2)\n\n![Figure 1](./img/fig1.png)\n\nFig. 1. c\n\nReferences\n\n<a id="ref-1"></a>[1] A\n\n<a id="ref-2"></a>[2] B'
    assert rows[1] is None
