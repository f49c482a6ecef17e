"""A batch run over a folder of PDF files, and the summary log of its results."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import lit
from quire.operators.batch import batch_page, batch_summary, summary_line
from quire.operators.enrich import file_stem
from quire.plans.convert import Options, convert, parsed, results
from quire.runtime import cut_lineage
from quire.sinks.export import export_enrichments, export_images, export_lines, export_logs, export_markdown
from quire.sources.files import pdf_files

_RULE, _THIN = "=" * 60, "-" * 60


def summary_log(run: DataFrame, in_dir: str, out_dir: str, options: Options | None = None, seconds: float | None = None, generated: str | None = None) -> DataFrame:
    """(part, key, line): the summary log of (name, success, duration); in order of part and key it is the file.

    Totals and options come first, then a line per file, then those that failed.
    ``seconds`` is the time of the run, by default the sum of the durations; an
    empty run has an average of 0.  Null durations count as 0, results that are not
    known as failed.  The lines stay distributed."""
    options = options or Options(keep_raw=True, enrich=True, describe=True)
    run = run.select(F.coalesce("name", lit("")).alias("name"), F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("duration", F.lit(0.0)).alias("duration"))
    totals = batch_summary(run).withColumn("_total", F.lit(float(seconds)) if seconds is not None else F.coalesce("seconds", F.lit(0.0)))
    heads: list[Column] = [
        lit(_RULE), lit("BATCH CONVERSION SUMMARY"), *[lit(f"Generated: {generated}")] * (generated is not None), lit(_RULE), lit(""),
        lit(f"Input:      {in_dir}"), lit(f"Output:     {out_dir}"),
        F.format_string("Total PDFs: %d", "total"), F.format_string("Successful: %d", "successful"), F.format_string("Failed:     %d", "failed"),
        F.format_string("Duration:   %.1f minutes (%.1fs)", F.col("_total") / 60, "_total"), F.format_string("Average:    %.1fs per PDF", F.coalesce(F.try_divide("_total", F.col("total")), F.lit(0.0))), lit(""),
        lit("Options:"), lit(f"  - Keep raw:      {options.keep_raw}"), lit(f"  - Enrich:        {options.enrich}"), lit(f"  - VLM describe:  {options.describe}"), lit(f"  - Agent cleanup: {options.agent}"), lit(""),
        lit(_THIN), lit("RESULTS BY PDF"), lit(_THIN), lit(""),
    ]

    def block(df: DataFrame, part: int, lines: list[Column], key: Column) -> DataFrame:
        return df.select(key.alias("_of"), F.posexplode(F.array(*lines)).alias("_at", "line")).select(F.lit(part).alias("part"), F.concat("_of", F.format_string("%03d", "_at")).alias("key"), "line")

    title = [lit(x) for x in ("", _THIN, "FAILED PDFs (review individual logs)", _THIN, "")]
    missed = [F.concat(lit("  - "), F.col("name")), F.concat(lit("    Log: logs/"), file_stem(F.col("name")), lit(".log"))]
    parts = [
        block(totals, 0, heads, lit("")),
        block(run, 1, [summary_line(F.col("success"), F.col("duration"), F.col("name"))], F.col("name")),
        block(totals.where("failed > 0"), 2, title, lit("")),
        block(run.where("not success"), 3, missed, F.concat("name", lit("\t"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def run_batch(
    spark: SparkSession, in_dir: str, out_dir: str, backend: Callable | None, options: Options | None = None, *, skip: int = 0, limit: int | None = None, dry_run: bool = False,
    client: Callable[[bytes], str] | None = None, agent: Callable[[str], tuple[str, str]] | None = None,
) -> DataFrame:
    """Convert the PDF files of a folder and write documents, pictures, enrichments, a log per file and the summary log.

    Returns (name, success, duration, message), or with ``dry_run`` the (name) of the
    files that would be read.  Files are taken in path order after ``skip``, at most
    ``limit``; each is read once, its seconds are those of the extraction."""
    options = options or Options(keep_raw=True, enrich=True, describe=client is not None, agent=agent is not None)
    wanted = batch_page(pdf_files(spark, in_dir, with_content=not dry_run), "path", skip, limit)
    if dry_run:
        return wanted.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    began = time.time()
    rows = cut_lineage(parsed(wanted, backend, options))
    documents = cut_lineage(convert(rows, options, client=client, agent=agent))
    export_markdown(documents, out_dir, raw="md_raw" if options.raw or options.keep_raw else None)
    export_images(documents.select("stem", F.explode("images").alias("p")).select("stem", "p.filename", "p.image"), out_dir)
    if options.enrich:
        export_enrichments(documents, out_dir)
    run = results(rows)
    export_logs(rows, out_dir)
    log = summary_log(run, in_dir, out_dir, options, time.time() - began, datetime.now().isoformat())
    export_lines(log.orderBy("part", "key").select("line"), f"{out_dir}/batch_summary.log")
    return run
