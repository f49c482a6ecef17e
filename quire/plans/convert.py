"""Conversion of PDF files as one plan: extract once, then refine, enrich and clean up as asked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.enrich import MIN_AREA, MIN_HEIGHT, MIN_WIDTH, converted, enrichments, failure_message, file_stem, kept_pictures
from quire.plans.pipeline import process_markdown
from quire.sources.files import cleanup_agent, convert_documents, picture_descriptions


@dataclass(frozen=True)
class Options:
    """What a conversion does; stages that are not asked for are not in the plan.

    ``raw`` leaves out refinement and agent; ``keep_raw`` keeps the raw text beside
    the refined one; ``code``, ``formulas`` and ``classify`` are the parts of the
    enrichments; ``describe`` asks the picture client about pictures that fill at
    least ``picture_area_threshold`` of their page."""

    raw: bool = False
    keep_raw: bool = False
    enrich: bool = False
    describe: bool = False
    agent: bool = False
    code: bool = True
    formulas: bool = True
    classify: bool = True
    images_scale: float = 2.0
    min_image_width: int = MIN_WIDTH
    min_image_height: int = MIN_HEIGHT
    min_image_area: int = MIN_AREA
    picture_area_threshold: float = 0.02

    @property
    def sizes(self) -> tuple[int, int, int]:
        """Least width, height and area of a picture that is kept."""
        return self.min_image_width, self.min_image_height, self.min_image_area


def parsed(pdfs: DataFrame, backend: Callable | None, options: Options | None = None) -> DataFrame:
    """One row per file: path, stem, seconds, ok, message and the parsed document's columns; the backend gets the options as a dict."""
    rows = convert_documents(pdfs, backend, **asdict(options or Options())).select("path", "error", "seconds", "document.*")
    ok = F.col("error").isNull() & F.coalesce(converted(), F.lit(False))
    return rows.select("*", file_stem(F.col("path")).alias("stem"), ok.alias("ok"), F.when(~ok, F.coalesce("error", failure_message())).alias("message"))


def convert(rows: DataFrame, options: Options | None = None, *, client: Callable[[bytes], str] | None = None, agent: Callable[[str], tuple[str, str]] | None = None) -> DataFrame:
    """Documents of the parsed rows that came through: stem, md, images and what the options add (md_raw, enrichments)."""
    options = options or Options()
    out = rows.where("ok").withColumn("images", kept_pictures(F.col("pictures"), *options.sizes))
    md = F.col("md") if options.raw else process_markdown(F.col("md"), F.transform("images", lambda p: p["filename"]))
    added = [F.col("md").alias("md_raw")] if options.raw or options.keep_raw else []
    if options.enrich:
        described = None
        if options.describe and client is not None:
            out = out.withColumn("_described", picture_descriptions(client)(F.transform("pictures", lambda p: F.when(F.coalesce(p["area_share"], F.lit(1.0)) >= options.picture_area_threshold, p["image"]))))
            described = F.col("_described")
        added.append(enrichments(*options.sizes, code=options.code, formulas=options.formulas, classify=options.classify, described=described).alias("enrichments"))
    out = out.select("stem", md.alias("md"), "images", *added)
    if options.agent and agent is not None and not options.raw:
        out = cleanup_agent(out, "md", agent).withColumn("md", F.col("agent_md")).drop("agent_md")
    return out


def enrich(rows: DataFrame, options: Options | None = None, *, client: Callable[[bytes], str] | None = None) -> DataFrame:
    """(stem, enrichments) of the parsed rows that came through, without refinement."""
    o = asdict(options or Options()) | {"enrich": True, "raw": True}
    return convert(rows, Options(**o), client=client).select("stem", "enrichments")


def results(rows: DataFrame) -> DataFrame:
    """(name, success, duration, message) of the parsed rows."""
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("ok").alias("success"), F.col("seconds").alias("duration"), "message")
