"""File exports; the tables themselves are the system of record.

Files go through Arrow's file systems, so a folder may be a local path that all
executors share or an address such as hdfs:// or s3://."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enrichment_json() -> Column:
    """The enrichments column as JSON, nulls kept."""
    return F.to_json("enrichments", {"ignoreNullFields": "false"})


def write_file(path: str, content: bytes) -> None:
    """Write one file with its folders; the file is replaced."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    folder = at.rsplit("/", 1)[0]
    if folder:
        system.create_dir(folder, recursive=True)
    with system.open_output_stream(at) as f:
        f.write(content)


def export_files(rows: DataFrame, out: str) -> None:
    """Write rows (file, content) below ``out``; a row without content is left out, repeated rows write the same file."""
    base = f"{out.rstrip('/')}/" if out else ""

    def write(part: Iterator) -> None:
        for r in part:
            if r["file"] is not None and r["content"] is not None:
                write_file(base + r["file"], bytes(r["content"]))

    rows.select("file", "content").foreachPartition(write)


def export_markdown(docs: DataFrame, out: str, raw: str | None = None) -> None:
    """Write ``{out}/{stem}/{stem}.md`` for rows (stem, md) and ``{stem}_raw.md`` from the column ``raw``; a null text is an empty file."""
    name = lambda end: F.concat("stem", F.lit("/"), "stem", F.lit(end))
    text = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-8")
    files = [F.struct(name(".md").alias("file"), text("md").alias("content"))] + ([F.struct(name("_raw.md").alias("file"), text(raw).alias("content"))] if raw else [])
    export_files(docs.select(F.explode(F.array(*files)).alias("f")).select("f.*"), out)


def export_enrichments(docs: DataFrame, out: str) -> None:
    """Write ``{out}/{stem}/enrichments.json`` for rows (stem, enrichments), and a file for each list that is not empty."""
    base = out.rstrip("/")

    def write(rows: Iterator) -> None:
        for r in rows:
            data = json.loads(r["j"])
            write_file(f"{base}/{r['stem']}/enrichments.json", json.dumps(data, indent=2, ensure_ascii=False).encode())
            for part in ("code_blocks", "equations", "figures"):
                if data.get(part):
                    write_file(f"{base}/{r['stem']}/{part}.json", json.dumps(data[part], indent=2).encode())

    docs.select("stem", enrichment_json().alias("j")).foreachPartition(write)


def export_images(pictures: DataFrame, out: str) -> None:
    """Write ``{out}/{stem}/img/{filename}`` for rows (stem, filename, image)."""
    export_files(pictures.select(F.concat("stem", F.lit("/img/"), "filename").alias("file"), F.col("image").alias("content")), out)


def export_logs(rows: DataFrame, out: str) -> None:
    """Write ``{out}/logs/{stem}.log`` for parsed rows (path, stem, ok, seconds, message)."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    status = F.when(F.col("ok"), "SUCCESS").otherwise("FAILED")
    text = F.concat(
        F.lit("# PDF Conversion Log: "), name, F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), "message", F.lit("\n")), F.lit("")), F.lit("\n# Duration: "), F.format_string("%.1fs", F.coalesce("seconds", F.lit(0.0))), F.lit("\n# Status: "), status, F.lit("\n")
    )
    export_files(rows.select(F.concat(F.lit("logs/"), "stem", F.lit(".log")).alias("file"), F.encode(text, "UTF-8").alias("content")), out)


def export_lines(ordered: DataFrame, path: str, end: str = "\n") -> None:
    """Write the column line of an ordered frame as one file; the rows pass through the driver one partition at a time."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        for r in ordered.select("line").toLocalIterator():
            f.write((r["line"] + end).encode())
