"""The refinement over a stream of documents; every step is stateless, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.pipeline import process_markdown

DOCUMENTS = "doc_id bigint, md string, images array<string>"


def documents_stream(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    """Parquet files of documents as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def refined(docs: DataFrame) -> DataFrame:
    """``docs`` (md, images) with md refined."""
    return docs.withColumn("md", process_markdown(F.col("md"), F.col("images")))


def start(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the refined stream to parquet until what is there has been read."""
    return refined(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
