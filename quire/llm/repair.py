"""Problem 6, second part: scanned texts as continuous paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scanfix import page_findings, repaired_text
from quire.runtime import broadcast_if_small, cut_lineage


def repair_pages(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (keys..., repaired_text) of the texts with page noise.

    What was found in a text is gathered into one row, bounded by its lines, and
    meets the text by its key: sent along where such rows are few, by a shuffle
    otherwise.  A misread word that is also cut over two lines keeps its reading.
    Texts without noise are left out; repeated rows of ``texts`` are repaired each."""
    found, _ = page_findings(texts, keys, text)
    lines = lambda noise: F.collect_set(F.when(F.col("noise") == noise, F.col("line_no")))
    words = F.collect_set(F.when(F.col("noise") == "misread", F.struct("word", "correction")))
    per_text = cut_lineage(found.groupBy(*keys).agg(lines("page_line").alias("_page"), lines("cut_word").alias("_cut"), words.alias("_words")))
    base = texts.select(*keys, F.col(text).alias("_t")).where("_t is not null and _t <> ''")
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fixed = [repaired_text(t, set(p), set(c), {x["word"]: x["correction"] for x in w}) for t, p, c, w in zip(pdf["_t"], pdf["_page"], pdf["_cut"], pdf["_words"], strict=True)]
            yield pdf[keys].assign(repaired_text=fixed)

    return base.join(broadcast_if_small(per_text, 50_000), keys).mapInPandas(repair, f"{kinds}, repaired_text string")
