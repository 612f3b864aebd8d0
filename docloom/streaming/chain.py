"""Jobs in a chain: each type of job is a stream of messages, its result a table of a versioned store, by run.

A message names a run that is ready for a type of job. A job reads its runs' rows of the table before it, replaces theirs in its
own table, all in one commit, and then sends a message a run to the next type. Delivery is at least once: a job that dies after its
commit is run again by the stream's checkpoint and replaces the same rows; messages that come twice do the same work twice.
So replays leave the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import Conflict, Store

MESSAGE = "run_id string, job string"


@dataclass(frozen=True)
class Job:
    """name: of the type and of its table; work: rows of runs (run_id, ...) to rows of the same runs (run_id, ...)."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    attempts: int = 3


class Chain:
    def __init__(self, spark: SparkSession, path: str, source: DataFrame, jobs: list[Job]):
        """source (run_id, ...) is what the first type of job reads."""
        self.spark, self.path, self.source, self.jobs, self.store = spark, path, source, jobs, Store(spark, f"{path}/tables")

    def submit(self, runs: DataFrame, job: int = 0) -> None:
        """Messages for runs (run_id): they are ready for a type of job."""
        runs.select(F.col("run_id").cast("string").alias("run_id"), F.lit(self.jobs[job].name).alias("job")).write.mode("append").json(self._queue(job))

    def _queue(self, job: int) -> str:
        return f"{self.path}/queue/{job}"

    def _once(self, job: int, batch: DataFrame) -> None:
        runs = batch.select("run_id").distinct()
        own = self.jobs[job]
        for attempt in range(own.attempts):
            writer = self.store.begin()
            before = self.source if job == 0 else self.store.read(self.jobs[job - 1].name, writer.base)
            rows = own.work(before.where(F.col("run_id").cast("string").isin([r.run_id for r in runs.collect()])))  # runs of a batch of messages
            try:
                writer.replace_each(own.name, rows, "run_id").commit()
                break
            except Conflict:  # another worker has just done one of these runs
                if attempt + 1 == own.attempts:
                    raise
        if job + 1 < len(self.jobs):
            self.submit(runs, job + 1)

    def drain(self, job: int, checkpoint: str | None = None) -> None:
        """Does the messages of a type that are at hand; checkpoint: where the stream notes what it has done."""
        stream = self.spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1000).json(self._queue(job))
        at = checkpoint or f"{self.path}/done/{job}"
        stream.writeStream.foreachBatch(lambda batch, _: self._once(job, batch)).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()

    def run(self, replay: bool = False) -> DataFrame:
        """All types in order; replay: from the first message again. The last type's table."""
        for k in range(len(self.jobs)):
            self.drain(k, f"{self.path}/done/{uuid.uuid4().hex}" if replay else None)
        return self.store.read(self.jobs[-1].name)
