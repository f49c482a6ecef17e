"""Registry of the core queries and their SQL equivalents.

The text queries run over the view papers, and as ``md_…`` over the manuscripts:
the whole markdown of every raw and final paper."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import lines
from quire.operators import batch, bibliography, citations, cleanup, enrich, figures, rules, sections
from quire.oracle import oracle
from quire.plans.batch import summary_log
from quire.plans.pipeline import process_markdown
from quire.plans.publications import summary
from quire.runtime import ensure_importable
from quire.tables import table
from quire.views import images, manuscripts, papers, parsed_documents

Query = Callable[[SparkSession, str], DataFrame]

TEXT_OPERATORS: dict[str, Callable[[Column], Column]] = {
    "ligatures": cleanup.spell_out_ligatures, "blank_lines": cleanup.limit_blank_lines, "rstrip_lines": cleanup.strip_line_ends, "cleanup_text": cleanup.cleanup_text, "dehyphenate": cleanup.join_hyphenated,
    "abstract_header": sections.abstract_heading, "index_terms_header": sections.index_terms_heading, "hierarchical_sections": sections.hierarchical_headings, "numbered_bullets": sections.numbered_bullets, "process_sections": sections.process_sections,
    "citation_ranges": citations.expand_ranges, "link_citations": citations.link_citations, "reference_anchors": citations.anchor_references, "process_citations": citations.process_citations,
    "bibliography_spacing": bibliography.space_entries, "process_bibliography": bibliography.process_bibliography,
    "lettered_headings": rules.lettered_headings, "merge_paragraphs": rules.merge_paragraphs, "drop_placeholders": rules.drop_placeholders, "drop_caption_noise": rules.drop_caption_noise,
}


def _text(op: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.select("doc_id", op(F.col("md")).alias("md"))


def _paper_lines(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.posexplode(lines(F.col("md"))).alias("pos", "line"))


def t_header_level(rows):
    number = F.regexp_extract("line", sections.TITLE_LINE, 1)
    return _paper_lines(rows).select("doc_id", "pos", number.alias("numbering")).where("numbering <> ''").withColumn("level", sections.header_level(F.col("numbering")).cast("bigint"))


def t_section_title(rows):
    return _paper_lines(rows).select("doc_id", "pos", sections.is_section_title(F.col("line")).alias("is_title"))


def t_references_split(rows):
    return rows.select("doc_id", citations.split_references(F.col("md")).alias("p")).select("doc_id", "p.body", "p.refs")


def t_reference_count(rows):
    return rows.select("doc_id", bibliography.reference_count(F.col("md")).alias("n"))


def t_figure_map(rows):
    return figures.figure_files(images(rows), "doc_id", "ord", "filename")


def t_embed_figures(rows):
    return rows.select("doc_id", figures.process_figures(F.col("md"), F.col("files")).alias("md"))


def t_relocate_figures(rows):
    return t_embed_figures(rows).select("doc_id", rules.relocate_figures(F.col("md")).alias("md"))


def t_unembedded_figures(rows):
    marked = rows.select("doc_id", F.regexp_replace("md", r"Fig\. ([0-9])", "![Figure $1](x)").alias("md"), "files")
    missing = figures.unembedded(F.col("md"), F.col("files"))
    return marked.select("doc_id", F.posexplode(missing).alias("pos", "f")).select("doc_id", "pos", F.col("f.num").alias("num"), F.col("f.filename").alias("filename"))


def t_process_markdown(rows):
    return rows.select("doc_id", process_markdown(F.col("md"), F.col("files")).alias("md"))


def q_image_filter(spark, d):
    kept = F.explode(enrich.kept_pictures(F.col("pictures"))).alias("k")
    return parsed_documents(spark, d).select("doc_id", kept).select("doc_id", F.col("k.num").cast("bigint").alias("num"), "k.filename")


def q_code_blocks(spark, d):
    return parsed_documents(spark, d).select("doc_id", F.explode(enrich.code_blocks(F.col("texts"))).alias("b")).select("doc_id", "b.text", "b.language", "b.page", "b.context")


def q_equations(spark, d):
    return parsed_documents(spark, d).select("doc_id", F.explode(enrich.equations(F.col("equations"), F.col("formulas"))).alias("e")).select("doc_id", "e.latex", "e.text", "e.page")


def q_figure_info(spark, d):
    found = enrich.figures(F.col("pictures"), enrich.collections_of_document())
    return parsed_documents(spark, d).select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def q_doc_metadata(spark, d):
    return parsed_documents(spark, d).select("doc_id", enrich.enrichments()["metadata"].alias("m")).select("doc_id", "m.*")


def q_enrichment_json(spark, d):
    from quire.sinks.export import enrichment_json

    return parsed_documents(spark, d).select("doc_id", enrich.enrichments().alias("enrichments")).select("doc_id", enrichment_json().alias("json"))


def q_conversion_status(spark, d):
    raw = table(spark, d, "paper_raw").select("paper_id", "status", "errors", "source").dropDuplicates(["paper_id"])
    return raw.select("paper_id", enrich.converted().alias("ok"), F.when(~enrich.converted(), enrich.failure_message()).alias("message"), enrich.file_stem(F.col("source")).alias("stem"))


def _results(spark, d):
    return table(spark, d, "batch_result").distinct()


def q_batch_summary(spark, d):
    out = batch.batch_summary(_results(spark, d))
    return out.select("total", "successful", "failed", *[F.round(c, 4).alias(c) for c in ("seconds", "minutes", "avg_seconds")])


def q_batch_page(spark, d):
    names = table(spark, d, "batch_result").select("name").distinct()
    return batch.batch_page(names, "name", 5, 7)


def q_summary_log(spark, d):
    """Parts and lines of the whole log, without its date."""
    return summary_log(_results(spark, d), "/in", "/out").select("part", "line")


def _publications(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "publication").dropDuplicates(["pub_id"])


def q_publications(spark, d):
    return batch.papers_of(_publications(spark, d), "kat").select("pub_id", "title", "year")


def q_publication_summary(spark, d):
    return _publications(spark, d).select("pub_id", batch.summary_block().alias("block"))


def q_publications_file(spark, d):
    """The blocks of summary.md."""
    return summary(batch.papers_of(_publications(spark, d), "kat"), "Publications")


def q_download_plan(spark, d):
    return _publications(spark, d).select("pub_id", F.explode(batch.downloads()).alias("w")).select("pub_id", "w.kind", "w.url", "w.file", "w.label")


def q_download_stats(spark, d):
    wanted = _publications(spark, d).select(F.explode(batch.downloads()).alias("w"))
    return batch.download_stats(wanted.select("w.kind", F.col("w.url").isNotNull().alias("ok")))


def q_line_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("bigint").alias("n"))


def queries() -> dict[str, Query]:
    """Core queries by name."""
    of_rows = {n: _text(op) for n, op in TEXT_OPERATORS.items()} | {n[2:]: f for n, f in globals().items() if n.startswith("t_")}
    out: dict[str, Query] = {n[2:]: f for n, f in globals().items() if n.startswith("q_")}
    over = lambda view, f, spark, d: f(view(spark, d))
    out |= {n: partial(over, papers, f) for n, f in of_rows.items()} | {f"md_{n}": partial(over, manuscripts, f) for n, f in of_rows.items()}
    ready = lambda f: lambda spark, d: f(ensure_importable(spark), d)
    return {n: ready(f) for n, f in out.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the core queries by name."""
    return oracle()
