"""Batch runs and publication catalogues: the relational part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import lit


def batch_page(df: DataFrame, order: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ordered, some skipped, at most ``limit`` taken."""
    out = df.orderBy(order).offset(skip)
    return out if limit is None else out.limit(limit)


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: total, successful, failed, seconds, minutes and the average, null over no rows."""
    ok = F.count_if("success")
    return results.agg(
        F.count("*").alias("total"),
        ok.alias("successful"),
        (F.count("*") - ok).alias("failed"),
        F.sum("duration").alias("seconds"),
        (F.sum("duration") / 60).alias("minutes"),
        F.expr("try_divide(sum(duration), count(*))").alias("avg_seconds"),
    )


def summary_line(success: Column, duration: Column, name: Column) -> Column:
    """One line of the summary log."""
    return F.format_string("[%-6s] %7.1fs  %s", F.when(success, "OK").otherwise("FAILED"), duration, name)


def papers_of(catalogue: DataFrame, author: str, leave_out: str = "poster") -> DataFrame:
    """Publications of which an author's name contains ``author``, but for one type, newest first."""
    mine = F.exists("authors", lambda a: F.contains(F.lower(a), lit(author.lower())))
    return (
        catalogue.where(F.coalesce(mine, F.lit(False)) & (F.lower(F.coalesce("type", lit(""))) != leave_out))
        .orderBy(F.coalesce("year", F.lit(0)).desc(), F.coalesce("title", lit("")))
    )


def citation_source() -> Column:
    """Struct (url, extension) of a publication's citation: BibTeX, else plain text, else null."""
    bib, plain = F.nullif(F.col("links")["bibtex"], lit("")), F.nullif(F.col("links")["citation"], lit(""))
    return F.struct(F.coalesce(bib, plain).alias("url"), F.when(bib.isNotNull(), ".bib").when(plain.isNotNull(), ".txt").alias("extension"))


def summary_block() -> Column:
    """Markdown of one publication in the summary."""
    given = lambda name, default: F.coalesce(F.col(name).cast("string"), lit(default))
    pdf = F.coalesce(F.nullif(F.col("links")["pdf"], lit("")), lit("N/A"))
    facts = {"Year": given("year", "N/A"), "Venue": given("venue", "N/A"), "Slug": given("slug", "unknown"), "PDF": pdf, "Citation": F.coalesce(citation_source()["url"], lit("N/A"))}
    return F.concat(lit("## "), given("title", "Untitled"), lit("\n\n"), *[x for k, v in facts.items() for x in (lit(f"- **{k}:** "), v, lit("\n"))], lit("\n---\n\n"))


def downloads() -> Column:
    """The files wanted for one publication: (kind, url, file, label); a missing address is null and has no file.

    Files are named by slug; citations end in .bib or .txt; the label shows the first 50 characters of the title."""
    slug, title = F.coalesce("slug", lit("unknown")), F.left(F.coalesce("title", lit("Untitled")), F.lit(50))
    pdf, citation = F.nullif(F.col("links")["pdf"], lit("")), citation_source()

    def wanted(kind: str, url: Column, file: Column) -> Column:
        label = F.when(url.isNotNull(), F.concat(lit(f"Downloading {kind}: "), title, lit("..."))).otherwise(F.concat(lit(f"  No {kind} link for: "), title))
        return F.struct(lit(kind.lower()).alias("kind"), url.alias("url"), F.when(url.isNotNull(), file).alias("file"), label.alias("label"))

    return F.array(wanted("PDF", pdf, F.concat(lit("pdfs/"), slug, lit(".pdf"))), wanted("citation", citation["url"], F.concat(lit("citations/"), slug, citation["extension"])))


def download_stats(outcomes: DataFrame) -> DataFrame:
    """(kind, success, failed) of download outcomes with columns kind and ok; a missing address has ok = false."""
    return outcomes.groupBy("kind").agg(F.count_if("ok").alias("success"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))
