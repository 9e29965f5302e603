"""Durable lineage cuts for iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_LOCAL: dict[str, str | None] = {}


def shared_folder(spark) -> str:
    """The shared folder for checkpoints and other intermediate files.

    A local session without the setting gets one temporary folder, which goes when Python ends.
    """
    folder = spark.conf.get(SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a shared folder")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, None)
        if folder is None:
            folder = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder the session names; survives the loss of executors.

    With `spark.cleaner.referenceTracking.cleanCheckpoints` on, as a long-running session
    should have it, Spark removes the files when the DataFrame is gone.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def dealt(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Rows with equal keys in one task, sorted by keys and `order`, for functions that read a task as a stream.

    Dealt by a hash of the keys, not the keys: Spark drops a repartition that repeats how a join
    below has dealt its rows, and may then turn that join into one that deals nothing.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
