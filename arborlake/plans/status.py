"""The state of runs, as a table that others may read while a run goes on."""

from __future__ import annotations

import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHAPE = "run_id string, nth int, state string, progress double, message string, error string, at double"


class RunStatus:
    """Writes a row for each step of a run: ``queued``, ``running``, then ``done`` or ``error``.

    Jobs of a step carry its message, and all of the run its id as a tag, by which ``SparkSession.interruptTag`` ends them.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: str | None = None) -> None:
        self.spark, self.folder, self.run_id, self.nth = spark, folder, run_id or uuid4().hex, 0
        self._put("queued", 0.0, "queued")

    def _put(self, state: str, progress: float, message: str, error: str | None = None) -> None:
        row = (self.run_id, self.nth, state, min(progress, 1.0), message, error, time.time())
        self.nth += 1
        self.spark.createDataFrame([row], _SHAPE).coalesce(1).write.mode("append").parquet(self.folder)
        self.progress = progress

    def __enter__(self) -> RunStatus:
        self.spark.addTag(self.run_id)
        self._put("running", 0.0, "starting")
        return self

    def step(self, progress: float, message: str) -> None:
        self.spark.sparkContext.setJobDescription(message)
        self._put("running", progress, message)

    def done(self, message: str) -> None:
        self._put("done", 1.0, message)

    def __exit__(self, kind: type | None, error: BaseException | None, _: object) -> None:
        if error is not None:
            self._put("error", self.progress, "failed", f"{kind.__name__}: {error}")
        self.spark.removeTag(self.run_id)
        self.spark.sparkContext.setJobDescription(None)


def run_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each run: ``run_id, state, progress, message, error, at``."""
    rows = spark.read.schema(_SHAPE).parquet(folder)
    last = rows.groupBy("run_id").agg(F.max_by(F.struct("state", "progress", "message", "error", "at"), "nth").alias("last"))
    return last.select("run_id", "last.*")
