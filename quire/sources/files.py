"""File sources: markdown, PDF folders, image listings and YAML catalogues."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.enrich import DOCUMENT, file_stem

PUBLICATION = "title string, year int, venue string, slug string, type string, authors array<string>, links map<string,string>, _source_file string"
CONVERSION = f"path string, error string, seconds double, document struct<{DOCUMENT.replace('doc_id bigint', 'doc_id: bigint')}>"


class MissingBackend(RuntimeError):
    """A source needs a backend that was not given; raised when the plan is built."""


def markdown_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, stem, md, valid): whole files with line ends as \\n; valid is false where the bytes are no UTF-8."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", recursive).load(path)
    text = F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "\r\n?", "\n")
    return raw.select("path", file_stem(F.col("path")).alias("stem"), text.alias("md"), F.expr("is_valid_utf8(cast(content as string))").alias("valid"))


def pdf_files(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """PDF files of one folder in path order."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return (df if with_content else df.drop("content")).orderBy("path")


def image_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, filename, ord): PNG, then JPG, then JPEG files, each by name; an empty folder gives no row."""
    parts = []
    for rank, ext in enumerate(("png", "jpg", "jpeg")):
        df = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", recursive).load(path).drop("content")
        name = F.regexp_extract("path", "([^/]+)$", 1)
        parts.append(df.select("path", name.alias("filename"), F.struct(F.lit(rank).alias("kind"), name.alias("name")).alias("ord")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def convert_documents(pdfs: DataFrame, backend: Callable[[bytes, dict], dict] | None, **options) -> DataFrame:
    """Parsed documents of PDF rows (path, content).

    ``backend`` takes a file's bytes and the options and returns the attributes of
    a document; it runs once per file for both the markdown and the enrichments.
    An exception becomes the row's error; seconds are those of the call."""
    if backend is None:
        raise MissingBackend("convert_documents needs a backend that parses PDF files")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                began = time.perf_counter()
                try:
                    error, document = None, backend(content, options)
                except Exception as e:  # noqa: BLE001
                    error, document = str(e), None
                rows.append((path, error, time.perf_counter() - began, document))
            yield pd.DataFrame(rows, columns=["path", "error", "seconds", "document"])

    return pdfs.select("path", "content").mapInPandas(run, CONVERSION)


def picture_descriptions(client: Callable[[bytes], str]) -> Callable:
    """A column function: for an array of pictures, the client's texts; null pictures and errors give null."""

    def told(image: bytes | None) -> str | None:
        try:
            return client(image) if image is not None else None
        except Exception:  # noqa: BLE001
            return None

    @F.pandas_udf("array<string>")
    def describe(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda images: None if images is None else [told(b) for b in images])

    return describe


def describe_pictures(pictures: DataFrame, client: Callable[[bytes], str] | None) -> DataFrame:
    """``pictures`` (image) with a column description from ``client``; without one it is null."""
    if client is None:
        return pictures.withColumn("description", F.lit(None).cast("string"))
    return pictures.withColumn("description", picture_descriptions(client)(F.array("image"))[0])


def yaml_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Publications of YAML files with ``_source_file``; empty and broken files give no row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    data = yaml.safe_load(content)
                except yaml.YAMLError:
                    continue
                if isinstance(data, dict):
                    text = lambda k, d=data: None if d.get(k) is None else str(d[k])
                    year = data.get("year")
                    rows.append((text("title"), int(year) if str(year).isdigit() else None, text("venue"), text("slug"), text("type"), [str(a) for a in data.get("authors") or []], {str(k): str(v) for k, v in (data.get("links") or {}).items() if v is not None}, p.rsplit("/", 1)[-1]))
            yield pd.DataFrame(rows, columns=["title", "year", "venue", "slug", "type", "authors", "links", "_source_file"]).astype({"year": "Int32"})

    return raw.select("path", "content").mapInPandas(parse, PUBLICATION)


def fetch(urls: DataFrame, client: Callable[[str], bytes] | None) -> DataFrame:
    """(…, ok, content) of rows with a column url; a missing address or an error is not ok.  Nothing is sent without a client."""
    if client is None:
        raise MissingBackend("fetch needs a client")

    @F.pandas_udf("struct<ok: boolean, content: binary>")
    def get(s: pd.Series) -> pd.DataFrame:
        out = []
        for u in s:
            try:
                out.append((True, client(u)) if u else (False, None))
            except Exception:  # noqa: BLE001
                out.append((False, None))
        return pd.DataFrame(out, columns=["ok", "content"])

    return urls.withColumn("_r", get("url")).select("*", "_r.ok", "_r.content").drop("_r")


def cleanup_agent(docs: DataFrame, text: str, agent: Callable[[str], tuple[str, str]] | None) -> DataFrame:
    """``docs`` with the agent's text and summary; an error leaves the text and a null summary."""
    if agent is None:
        raise MissingBackend("cleanup_agent needs an agent")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                try:
                    out.append(agent(t))
                except Exception:  # noqa: BLE001
                    out.append((t, None))
            added = [pa.array([m for m, _ in out], pa.string()), pa.array([s for _, s in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "agent_md", "agent_summary"])

    schema = T.StructType([*docs.schema.fields, T.StructField("agent_md", T.StringType()), T.StructField("agent_summary", T.StringType())])
    return docs.mapInArrow(run, schema)  # all other columns pass through as they are
