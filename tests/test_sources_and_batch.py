import json

import pytest
from pyspark.sql import functions as F

from quire.operators import batch, enrich
from quire.plans import convert
from quire.sinks import export
from quire.sources import files
from quire.streaming import refine


def test_markdown_and_images(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"x\r\ny\rz")
    (tmp_path / "b.png").write_bytes(b"1")
    (tmp_path / "a.jpg").write_bytes(b"1")
    row = files.markdown_files(spark, str(tmp_path)).first()
    assert (row["stem"], row["md"], row["valid"]) == ("a", "x\ny\nz", True)
    assert [r["filename"] for r in files.image_files(spark, str(tmp_path)).orderBy("ord").collect()] == ["b.png", "a.jpg"]


def test_conversion_adapter(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"ok")
    (tmp_path / "q.pdf").write_bytes(b"bad")

    def backend(content, options):
        if content == b"bad":
            raise ValueError("broken")
        return {"status": "SUCCESS", "md": "text", "source": "p.pdf"}

    pdfs = files.pdf_files(spark, str(tmp_path), with_content=True)
    got = {r["path"][-5:]: r for r in files.convert_documents(pdfs, backend).collect()}
    assert got["p.pdf"]["document"]["md"] == "text" and got["q.pdf"]["error"] == "broken"
    with pytest.raises(files.MissingBackend):
        files.convert_documents(pdfs, None)


def test_yaml_catalogue(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(yaml.safe_dump({"title": "T", "year": 2020, "authors": ["X, A."], "links": {"pdf": "u"}}))
    (tmp_path / "b.yaml").write_text("a: [")
    (tmp_path / "c.yaml").write_text("")
    rows = files.yaml_catalogue(spark, str(tmp_path)).collect()
    assert [(r["title"], r["year"], r["authors"], r["_source_file"]) for r in rows] == [("T", 2020, ["X, A."], "a.yaml")]


def test_enrichments(spark, tmp_path):
    doc = {
        "doc_id": 1, "source": "/in/p.pdf", "texts": [{"text": "cap", "code_language": ""}, {"text": "print", "code_language": "python", "prov": [{"page_no": 3}], "page": 9}], "formulas": [{"original": "x=1"}],
        "pictures": [{"image": b"1", "width": 10, "height": 10, "captions": [{"cref": "#/texts/0"}, {"cref": "#/texts/9"}]}, {"image": b"1", "width": 300, "height": 300, "caption_text": "C", "annotations": [{"kind": "description", "text": "D"}, {"predicted_classes": [{"class_name": "bar", "confidence": 0.86}]}]}],
    }
    df = spark.createDataFrame([doc], enrich.DOCUMENT)
    e = df.select(enrich.enrichments().alias("e")).first()["e"]
    assert [(b["language"], b["page"]) for b in e["code_blocks"]] == [("python", 3)]
    assert e["equations"][0]["latex"] == "x=1" and e["metadata"]["title"] == "p" and e["metadata"]["num_figures"] == 2
    a, b = e["figures"]
    assert a["caption"] == "cap" and a["image_path_filtered"] is None
    assert (b["caption"], b["classification"], b["description"], b["image_path"], b["image_path_filtered"]) == ("C", "bar (0.86)", "D", "./img/figure2.png", "./img/figure1.png")
    export.export_enrichments(df.select(F.lit("p").alias("stem"), enrich.enrichments().alias("enrichments")), str(tmp_path))
    assert json.loads((tmp_path / "p/enrichments.json").read_text())["metadata"]["num_code_blocks"] == 1
    assert (tmp_path / "p/equations.json").exists()


def test_batch(spark):
    r = spark.createDataFrame([("a", True, 60.0), ("b", False, 30.0)], "name string, success boolean, duration double")
    s = batch.batch_summary(r).first()
    assert (s["total"], s["successful"], s["failed"], s["minutes"], s["avg_seconds"]) == (2, 1, 1, 1.5, 45.0)
    assert batch.batch_summary(r.limit(0)).first()["avg_seconds"] is None
    assert r.select(batch.summary_line(F.col("success"), F.col("duration"), F.col("name")).alias("l")).first()["l"] == "[OK    ]    60.0s  a"
    assert [x["name"] for x in batch.batch_page(r, "name", 1, 5).collect()] == ["b"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Abstract -x", None)], refine.DOCUMENTS).write.parquet(str(tmp_path / "in"))
    refine.start(refine.documents_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["md"] == "## Abstract\n\nx"


def test_convert_plan(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"ok")
    (tmp_path / "q.pdf").write_bytes(b"half")
    (tmp_path / "r.pdf").write_bytes(b"bad")

    def backend(content, options):
        if content == b"bad":
            raise ValueError("broken")
        return {"status": "SUCCESS" if content == b"ok" else "FAILURE", "errors": ["page 1"], "md": "Abstract -x\n\nFig. 1. c", "source": "p.pdf", "pictures": [{"image": b"i", "width": 300, "height": 300}]}

    rows = convert.parsed(files.pdf_files(spark, str(tmp_path), with_content=True), backend)
    assert {r["stem"]: r["message"] for r in rows.collect()} == {"p": None, "q": "page 1", "r": "broken"}
    options = convert.Options(keep_raw=True, enrich=True, agent=True)
    out = convert.convert(rows, options, agent=lambda t: (t + "!", "done")).first()
    assert out["md"] == "## Abstract\n\nx\n\n![Figure 1](./img/figure1.png)\n\nFig. 1. c!" and out["md_raw"] == "Abstract -x\n\nFig. 1. c" and out["agent_summary"] == "done"
    assert out["enrichments"]["metadata"]["num_figures"] == 1
    assert convert.convert(rows, convert.Options(raw=True)).first()["md"] == "Abstract -x\n\nFig. 1. c"
    assert convert.convert(rows, convert.Options(min_image_width=301)).first()["images"] == []
    assert batch.batch_summary(convert.results(rows)).first()["failed"] == 2


def test_enrich_switches(spark):
    picture = {"image": b"i", "width": 300, "height": 300, "area_share": 0.5, "annotations": [{"predicted_classes": [{"class_name": "bar", "confidence": 0.5}]}]}
    small = picture | {"area_share": 0.01}
    doc = {"source": "p.pdf", "status": "SUCCESS", "md": "x", "texts": [{"text": "print", "code_language": "python"}], "formulas": [{"latex": "x", "text": None}], "pictures": [picture, small]}
    rows = spark.createDataFrame([doc], enrich.DOCUMENT).selectExpr("*", "'p' as stem", "true as ok")
    on = convert.enrich(rows, convert.Options(describe=True), client=lambda b: "seen").first()["enrichments"]
    assert [f["description"] for f in on["figures"]] == ["seen", None] and on["figures"][0]["classification"] == "bar (0.50)"
    assert (on["equations"][0]["text"], on["metadata"]["num_code_blocks"]) == ("x", 1)
    off = convert.enrich(rows, convert.Options(code=False, formulas=False, classify=False)).first()["enrichments"]
    assert (off["code_blocks"], off["equations"], off["metadata"]["num_equations"], off["figures"][0]["classification"], off["figures"][0]["description"]) == ([], [], 0, None, None)


def test_labels_and_references(spark):
    label = lambda n, c: {"predicted_classes": [{"class_name": n, "confidence": c}]}
    doc = {"pictures": [
        {"annotations": [label("bar", 0.86), label(None, None), label("photo", None)], "captions": [{"cref": "#/tables/0"}, {"cref": "#/pictures/1"}, {"cref": "#/nothing/0"}, {"cref": "#/texts/x"}]},
        {"markdown": "<pic>", "annotations": [label("bar", 0.0)], "captions": []},
    ], "tables": [{"markdown": "| a |"}]}
    f = spark.createDataFrame([doc], enrich.DOCUMENT).select(enrich.enrichments()["figures"].alias("f")).first()["f"]
    assert [(x["classification"], x["caption"]) for x in f] == [("photo (0.86)", "| a | <pic>"), ("bar", "")]


def test_batch_run(spark, tmp_path):
    import quire

    def backend(content, options):
        if content == b"bad":
            raise ValueError("broken")
        return {"status": "SUCCESS", "md": "Abstract -x\n\nFig. 1. c", "source": "p.pdf", "texts": [{"text": "print", "code_language": "python"}], "pictures": [{"image": b"i", "width": 300, "height": 300}]}

    (tmp_path / "in").mkdir()
    for name, content in (("a", b"ok"), ("b", b"bad"), ("c", b"ok"), ("d", b"ok")):
        (tmp_path / f"in/{name}.pdf").write_bytes(content)
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), backend)
    assert [r["name"] for r in quire.run_batch(*args, skip=1, limit=2, dry_run=True).collect()] == ["b.pdf", "c.pdf"] and not (tmp_path / "out").exists()
    got = {r["name"]: r for r in quire.run_batch(*args, skip=1, limit=2).collect()}
    assert {n: r["success"] for n, r in got.items()} == {"b.pdf": False, "c.pdf": True} and all(r["duration"] >= 0 for r in got.values())
    out = tmp_path / "out"
    assert (out / "c/c.md").read_text().startswith("## Abstract") and (out / "c/c_raw.md").read_text().startswith("Abstract -") and (out / "c/img/figure1.png").read_bytes() == b"i"
    assert json.loads((out / "c/code_blocks.json").read_text())[0]["language"] == "python" and not (out / "c/equations.json").exists()
    assert "# Status: FAILED" in (out / "logs/b.log").read_text() and "broken" in (out / "logs/b.log").read_text()
    log = (out / "batch_summary.log").read_text().split("\n")
    assert "Total PDFs: 2" in log and "Failed:     1" in log and any(l.startswith("[FAILED]") and l.endswith("s  b.pdf") for l in log) and log[-3:] == ["  - b.pdf", "    Log: logs/b.log", ""]


def test_postprocess(spark, tmp_path):
    import quire

    for d in ("a", "b"):
        (tmp_path / d / "img").mkdir(parents=True)
        (tmp_path / d / f"{d}.md").write_text("Abstract -x\n\nFig. 1. c")
    (tmp_path / "a/img/figure1.png").write_bytes(b"1")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    got = {r["stem"]: r for r in quire.postprocess(spark, str(tmp_path)).collect()}
    assert "![Figure 1]" in got["a"]["md"] and "![Figure 1]" not in got["b"]["md"] and got["b"]["md"].startswith("## Abstract") and not got["bad"]["valid"]
    done = quire.agent_pass(quire.postprocess(spark, str(tmp_path)).where("valid"), lambda t: (t.upper(), "up"))
    quire.write_back(done, str(tmp_path / "out"))
    assert (tmp_path / "out/a.md").read_text().startswith("## ABSTRACT")
    quire.write_back(quire.postprocess(spark, str(tmp_path), images=str(tmp_path / "a/img")).where("stem = 'b'"))
    assert "![Figure 1]" in (tmp_path / "b/b.md").read_text()


def test_publications_run(spark, tmp_path):
    import quire

    rows = [
        ("T" * 60, 2020, "V", "s1", "journal", ["Kat, A."], {"pdf": "http://x/p", "bibtex": "http://x/b"}), (None, None, None, "s2", None, ["kat"], {"pdf": "http://x/bad", "citation": "http://x/c"}), ("Poster", 2021, "V", "s3", "POSTER", ["Kat"], {}), ("Other", 2021, "V", "s4", None, None, None),
    ]
    cat = spark.createDataFrame(rows, "title string, year int, venue string, slug string, type string, authors array<string>, links map<string,string>")

    def client(url):
        if url.endswith("bad"):
            raise OSError("no")
        return url.encode()

    stats = {r["kind"]: (r["success"], r["failed"]) for r in quire.run_publications(cat, "Kat", str(tmp_path), client, "Own work").collect()}
    assert stats == {"pdf": (1, 1), "citation": (2, 0)}
    assert (tmp_path / "pdfs/s1.pdf").read_bytes() == b"http://x/p" and (tmp_path / "citations/s2.txt").exists() and (tmp_path / "citations/s1.bib").exists() and not (tmp_path / "pdfs/s2.pdf").exists()
    text = (tmp_path / "summary.md").read_text()
    assert text.startswith("# Own work\n\nTotal papers: 2\n\n---\n\n## TTT") and "## Untitled\n\n- **Year:** N/A\n- **Venue:** N/A\n- **Slug:** s2\n" in text
    assert {r["kind"]: r["failed"] for r in quire.run_publications(cat, "Kat", str(tmp_path), None).collect()} == {"pdf": 2, "citation": 2}


def test_pictures_are_described(spark):
    df = spark.createDataFrame([(b"a",), (None,), (b"z",)], "image binary")

    def client(b):
        if b == b"z":
            raise OSError("no")
        return "picture"

    assert [r["description"] for r in files.describe_pictures(df, client).collect()] == ["picture", None, None]
    assert files.describe_pictures(df, None).where("description is null").count() == 3
    with pytest.raises(files.MissingBackend):
        files.fetch(df, None)
