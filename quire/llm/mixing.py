"""Problem 8: combining sources by target weights.

Each source gets an expected number of copies per document: its share of the
wanted total divided by its tokens, at most its allowed repeats.  Systematic
sampling turns that into whole copies: the expected copies are summed up along
the documents of a source, one random offset is added, and a document is emitted
once per integer boundary that its stretch of the sum crosses.  So the copies of
a source differ from the expectation by less than one document, and no document
is used more than ceil(expected copies) times.

The running sum is taken in two steps, so that a source with most of the rows
needs no single task: documents stand in the order of a digest of their keys,
equal ranges of digests are buckets, the buckets' counts give each bucket its
start, and the sum runs within buckets.  The number of buckets follows from the
number of documents and does not change the result.

Defined results: null and empty texts have no tokens and are never emitted;
documents without a source or of a source without a target are left out; a
target without documents is reported with an actual share of 0; repeated rows of
a key count once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.runtime import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of the tokenizer's vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a bucket, on average; a bucket is numbered by one task.
BUCKET_ROWS = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source, tokens) with each key once; written once, so that no text is tokenised again however often the counts are read."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(tokenizer)
        for s in batches:
            yield s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    sized = (
        df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("_t"))
        .where("key is not null and source is not null and _t is not null and _t <> ''")
        .select("key", "source", count("_t").alias("tokens"))
        .groupBy("key", "source")
        .agg(F.max("tokens").alias("tokens"))
    )
    return cut_lineage(sized)


def rates(totals: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Expected copies per document of each target source.

    ``totals`` has (source, source_tokens), ``targets`` (source, target_share,
    max_repeats); both have a row per source.  ``total_tokens`` is the wanted size,
    by default the tokens of all sources that have a target.
    """
    joined = targets.dropDuplicates(["source"]).join(totals, "source", "left").fillna(0, ["source_tokens"])
    wanted = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("source_tokens").over(W.partitionBy(F.lit(1))).cast("double")  # a row per source
    rate = F.when(F.col("source_tokens") > 0, F.least(F.col("target_share") * wanted / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return joined.select("source", "target_share", "max_repeats", "source_tokens", rate.alias("rate"))


def _fraction(digest: Column) -> Column:
    """The first eight digits of a hexadecimal digest as a number below 2 ** 32."""
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint")


def mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, source, tokens, copies) of the emitted documents; copies is at least 1.

    ``counts`` is read several times and counted, so its lineage should be cut."""
    totals = counts.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    rate = F.broadcast(rates(totals, targets, total_tokens).where("rate > 0").select("source", "rate"))  # a row per source
    buckets = max(1, min(1 << 20, -(-counts.count() // bucket_rows)))
    docs = counts.join(rate, "source").withColumn("digest", F.md5(F.concat(F.col("key").cast("string"), F.lit(f"-{seed}"))))
    docs = docs.withColumn("bucket", F.expr(f"cast({buckets} * conv(left(digest, 8), 16, 10) div 4294967296 as int)"))
    # Rows, not rates, are summed: whole numbers add up alike in any order.
    sums = docs.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row per bucket and source
    order = W.partitionBy("source", "bucket").orderBy("digest", "key")
    offset = _fraction(F.md5(F.concat("source", F.lit(f"-{seed}")))) / F.lit(float(1 << 32))
    placed = docs.withColumn("k", F.row_number().over(order)).join(starts, ["source", "bucket"])
    last = F.floor(F.col("rate") * (F.col("start") + F.col("k")) + offset)
    first = F.floor(F.col("rate") * (F.col("start") + F.col("k") - 1) + offset)
    return placed.select("key", "source", "tokens", (last - first).cast("int").alias("copies")).where("copies > 0")


def shares(counts: DataFrame, targets: DataFrame, mixed: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: target_share, max_repeats, documents and tokens before and after, the share really reached and whether the cap was binding.

    ``actual_share`` is the part of what was emitted, ``share_of_wanted`` that of the
    wanted total: where a capped source delivers less, the others keep their tokens
    and so have more of what was emitted."""
    sizes = counts.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    used = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.sum("copies").alias("mixed_docs"), F.max("copies").alias("most_copies"))
    rated = rates(sizes.select("source", "source_tokens"), targets, total_tokens)
    out = rated.join(sizes.select("source", "source_docs"), "source", "left").join(used, "source", "left").fillna(0, ["source_docs", "mixed_tokens", "mixed_docs", "most_copies"])
    everything = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))  # a row per source
    wanted = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("source_tokens").over(W.partitionBy(F.lit(1))).cast("double")
    part = lambda whole: F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0)
    return out.select(
        "source", "target_share", "max_repeats", "source_docs", "source_tokens", "mixed_docs", "mixed_tokens", "most_copies",
        part(everything).alias("actual_share"), part(wanted).alias("share_of_wanted"),
        (F.col("target_share") * wanted > F.col("source_tokens") * F.col("max_repeats")).alias("cap_binding"),
    )
