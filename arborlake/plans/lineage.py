"""Where iterative plans cut their lineage."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    A folder of our own is set only where the session names none and all tasks run in this process, as in tests;
    on a cluster a missing name is an error, since each executor would write to its own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, by: str | None = None) -> tuple[DataFrame, str]:
    """A table written to the shared folder and read again, and its path, for ``forget``; in folders by a column's values, if asked.

    A written table has the size of its files, where ``DataFrame.checkpoint`` keeps the estimate of the plan
    before it: these multiply in loops of joins until the planner is busy with them alone.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}.parquet"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str | None) -> None:
    """Remove a stored table that nothing will read again."""
    if path is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """A stored table that is left for the cluster to clear."""
    return stored(df)[0]
