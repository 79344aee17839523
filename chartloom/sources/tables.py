"""Reading the project's tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> None:
    """See that the session has a checkpoint folder: the one named in ``spark.checkpoint.dir``.

    A folder of this machine serves only where Spark runs on this machine alone, as in tests; elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there.

    Spark removes the files when the result is no longer used if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, for small things such as models."""
    _shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, otherwise as it is.

    The rows are counted, up to one more than the limit, so the hint never rests on a guess.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
