"""Session helpers: Python workers that can import the package, lineage cuts that survive executors, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
#: Most rows that are sent to every executor as one side of a join; rows are keys and positions of at most some hundred bytes.
BROADCAST_ROWS = 200_000


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the Python workers' path (an installed package needs nothing)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder in ``spark.checkpoint.dir`` and read it from there.

    The folder named by the session's configuration is shared by all executors.
    Only where the setting is missing and the session runs locally, as in
    tests, a temporary folder is used, which is deleted at exit.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, to be joined by a shuffle.

    ``df`` is counted, so it should be cheap to compute again or have its lineage cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
