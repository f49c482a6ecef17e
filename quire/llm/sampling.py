"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_RANGE = 1 << 31


def hash_sample(df: DataFrame, keys: list[str], rows: int, seed: int = 11) -> list[Row]:
    """About ``rows`` rows and never more than twice as many, chosen by a hash of their keys; all rows where there are fewer.

    The choice is a filter, so neither a sort nor a task's read grows with the
    table; the same rows give the same sample in the same order."""
    n = df.select(*keys).count()
    draw = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(_RANGE))
    if n > rows:
        df = df.where(draw < int(_RANGE * rows / n))
    got = df.withColumn("_draw", draw).limit(2 * rows).collect()
    return sorted(got, key=lambda r: (r["_draw"], *(str(r[k]) for k in keys)))
