"""Refinement of markdown files that exist already, with the images beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.pipeline import process_markdown
from quire.runtime import broadcast_if_small
from quire.sinks.export import export_files
from quire.sources.files import cleanup_agent, image_files, markdown_files


def postprocess(spark: SparkSession, path: str, images: str | None = None) -> DataFrame:
    """(path, stem, md, valid) of the markdown files under ``path``, refined.

    The images of a file are those of ``images``, or of the folder img beside it,
    PNG before JPG before JPEG.  Only names of images are grouped; the texts meet
    them by folder.  A file that is not UTF-8 is marked and left as it is read."""
    files = markdown_files(spark, path, recursive=True).withColumn("_folder", F.regexp_replace("path", "/[^/]*$", ""))
    listing = image_files(spark, images or path, recursive=images is None)
    if images is None:
        listing = listing.withColumn("_folder", F.regexp_replace("path", "/img/[^/]*$", "")).where("path like '%/img/%'")
        names = listing.groupBy("_folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "filename"))), lambda x: x["filename"]).alias("files"))
        rows = files.join(broadcast_if_small(names), "_folder", "left")
    else:  # one folder for all
        names = listing.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "filename"))), lambda x: x["filename"]).alias("files"))
        rows = files.withColumn("files", F.lit(names.first()["files"]).cast("array<string>"))
    md = F.when(F.col("valid"), process_markdown(F.col("md"), F.col("files"))).otherwise(F.col("md"))
    return rows.select("path", "stem", md.alias("md"), "valid")


def agent_pass(docs: DataFrame, agent: Callable[[str], tuple[str, str]] | None) -> DataFrame:
    """(path, stem, md, agent_summary): the agent's text and summary of each file; an error leaves the text."""
    return cleanup_agent(docs.select("path", "stem", "md"), "md", agent).withColumn("md", F.col("agent_md")).drop("agent_md")


def write_back(docs: DataFrame, output: str | None = None) -> None:
    """Write each (path, stem, md) over its file, or as ``{output}/{stem}.md``."""
    target = F.regexp_replace("path", "^file:/+", "/") if output is None else F.concat(F.lit(output.rstrip("/") + "/"), "stem", F.lit(".md"))
    export_files(docs.select(target.alias("file"), F.encode("md", "UTF-8").alias("content")), "")
