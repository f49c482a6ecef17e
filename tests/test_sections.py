import pytest
from pyspark.sql import functions as F

from quire.operators import rules, sections


@pytest.mark.parametrize(("number", "level"), [("3", 2), ("3.1", 3), ("3.1.1", 4), ("3.1.1.1", 5), ("1.2.3.4.5", 6), ("1.2.3.4.5.6", 6)])
def test_header_level(apply, number, level):
    assert apply(sections.header_level, number) == [level]


def test_section_title(apply):
    assert apply(sections.is_section_title, "Storage layers", "B" * 121, "It runs. It stops. It ends.") == [True, False, False]


def test_abstract_and_index_terms(apply):
    got = apply(sections.abstract_heading, "Abstract -Caches are small", "Abstract—Caches are small", "## Abstract -We cache", "No such thing", "x\nAbstract - a\nAbstract - b", None)
    assert got == ["## Abstract\n\nCaches are small", "## Abstract\n\nCaches are small", "## Abstract\n\nWe cache", "No such thing", "x\n## Abstract\n\na\nAbstract - b", None]
    assert apply(sections.index_terms_heading, "Index Terms -HPC, storage") == ["## Index Terms\n\nHPC, storage"]


def test_hierarchical(apply):
    got = apply(
        sections.hierarchical_headings, "3.1 Background\n\nText.", "3.1.1 Log layout. Built as layers.", "### 3.1 Already a header\n\nText.", "3.1.1.1 Fine details", "3.1 Tight\nText", "no heading", ""
    )
    assert got == ["### 3.1 Background\n\nText.", "#### 3.1.1 Log layout\n\nBuilt as layers.", "### 3.1 Already a header\n\nText.", "##### 3.1.1.1 Fine details", "### 3.1 Tight\n\nText", "no heading", ""]


def test_numbered_bullets(apply):
    got = apply(sections.numbered_bullets, "- 1) Scope:\n\nText", "- 1) Scope:\n- 2) more", "- 2) item", "- 3. item", "- 1) End:")
    assert got == ["### 1) Scope\n\n\nText", "1. Scope:\n2. more", "2. item", "- 3. item", "1. End:"]


def test_lettered_sections_are_left_alone(apply):
    text = "A. Background and motivation\n\nA. We conducted a long study of many systems."
    assert apply(sections.process_sections, text) == [text]
    assert apply(rules.lettered_headings, text) == ["##### A. Background and motivation\n\nA. We conducted a long study of many systems."]


def test_merge_paragraphs(apply):
    apart = ["one.\n\nTwo", "## Results\n\nwe show", "| a | b |\n\nand so on", "- item\n\nwith text", "```\nx\n\ny\n```", "![Figure 1](x)\n\nthe text", "Fig. 1. Caption\n\nthe text", "one\n\n\ntwo", "", "one\ntwo"]
    assert apply(rules.merge_paragraphs, *apart, None) == [*apart, None]
    assert apply(rules.merge_paragraphs, "a log \n\nentry is small\n\nand is read\n\nThe end") == ["a log entry is small and is read\n\nThe end"]


def test_rules(apply):
    assert apply(rules.drop_placeholders, "a\n<!-- image -->\nb", None) == ["a\nb", None]
    noise = "text of a line here\nlatency\n0 1\nFig. 1. Caption"
    assert apply(rules.drop_caption_noise, noise, "a\n\nFig. 1. Caption", "x y\nno caption", "# T\nFig. 1. C", "one\nFig. 2: c\ntwo", "", None) == [
        "text of a line here\nFig. 1. Caption", "a\n\nFig. 1. Caption", "x y\nno caption", "# T\nFig. 1. C", "Fig. 2: c\ntwo", "", None,
    ]
    many = "\n".join(["tick"] * 20_000)
    assert apply(rules.drop_caption_noise, many + "\nFig. 3. End") == ["Fig. 3. End"]


def test_whole_paper(apply):
    text = "Abstract -We study I/O.\n\nIndex Terms -HPC\n\n## I. INTRODUCTION\n\n3.1 Background\nText."
    assert apply(sections.process_sections, text) == ["## Abstract\n\nWe study I/O.\n\n## Index Terms\n\nHPC\n\n## I. INTRODUCTION\n\n### 3.1 Background\n\nText."]


def test_unicode_space(spark):
    df = spark.createDataFrame([("3.1 Design \n",)], "t string")
    assert df.select(sections.hierarchical_headings(F.col("t"))).first()[0].startswith("### 3.1 Design")


def test_relocate_figures(apply):
    text = "# T\n\n## A\n\nSee Fig. 1 here.\n\n## B\n\nText.\n\n![Figure 1](./img/f.png)\n\nMore.\n\nFig. 1. Caption\n\nEnd.\n<!-- image -->\n"
    moved = "# T\n\n## A\n\n![Figure 1](./img/f.png)\n*Fig. 1. Caption*\n\nSee Fig. 1 here.\n\n## B\n\nText.\n\nMore.\n\nEnd.\n"
    assert apply(rules.relocate_figures, text, "no figure", None) == [moved, "no figure", None]
    lost = "## A\n\nText.\n\n![Figure 1](./img/f.png)\n\nFig. 1. Caption\n"
    assert apply(rules.relocate_figures, lost) == [lost]


def test_relocate_each_figure_on_its_own(apply):
    text = "## A\n\nAs in Figure 2.\n\n![Figure 1](a)\n\nFig. 1. One\n\n## B\n\n![Figure 2](b)\n\nFig. 2. Two"
    assert apply(rules.relocate_figures, text) == ["## A\n\n![Figure 2](b)\n*Fig. 2. Two*\n\nAs in Figure 2.\n\n![Figure 1](a)\n\nFig. 1. One\n\n## B\n\n"]
