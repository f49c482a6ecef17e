"""A run over a publication catalogue: selection, summary file, downloads and their counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import lit
from quire.operators.batch import download_stats, downloads, papers_of, summary_block
from quire.runtime import cut_lineage
from quire.sinks.export import export_files, export_lines
from quire.sources.files import fetch


def summary(papers: DataFrame, title: str) -> DataFrame:
    """(part, year, title, block): a head with the number of papers, then a block per paper; in order of part, falling year and title it is the file."""
    head = papers.agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.lit(0).alias("year"), lit("").alias("title"), F.concat(lit(f"# {title}\n\nTotal papers: "), F.col("n").cast("string"), lit("\n\n---\n\n")).alias("block"))
    blocks = papers.select(F.lit(1).alias("part"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("title", lit("")).alias("title"), summary_block().alias("block"))
    return head.unionByName(blocks)


def run_publications(catalogue: DataFrame, author: str, out_dir: str, client: Callable[[str], bytes] | None, title: str = "Publications") -> DataFrame:
    """Write summary.md and, with a client, the files of an author's publications; returns (kind, success, failed).

    A publication without an address counts as failed; without a client nothing is
    fetched and every file counts so."""
    papers = cut_lineage(papers_of(catalogue, author))
    export_lines(summary(papers, title).orderBy("part", F.desc("year"), "title").select(F.col("block").alias("line")), f"{out_dir}/summary.md", end="")
    wanted = papers.select(F.explode(downloads()).alias("w")).select("w.*")
    if client is None:
        return download_stats(wanted.select("kind", F.lit(False).alias("ok")))
    got = cut_lineage(fetch(wanted, client))
    export_files(got.where("ok").select("file", "content"), out_dir)
    return download_stats(got.select("kind", "ok"))
