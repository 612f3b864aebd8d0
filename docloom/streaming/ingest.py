"""Ingest from a queue of files: each batch goes through the batch functions into idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.services import replace_run


def queue(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def ingest(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, run: str = "run_id", then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Each batch's rows, through work, replace those of the same runs at path; a batch that comes again leaves the same table.

    Within a batch a row that repeats is taken once. then() gets what was written, as the next stage's input. Files at hand are read, then the query ends."""

    def one(batch: DataFrame, _: int) -> None:
        done = work(batch.dropDuplicates())
        replace_run(done, path, run)
        if then:
            runs = batch.select(run).distinct()
            then(batch.sparkSession.read.schema(done.schema).parquet(path).join(runs, run, "left_semi"))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
