"""Arrow batches that are bounded in rows and bytes, for functions that hold a batch's rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A worker holds a few batches at once. A row over the bytes is a batch.
ROWS, BYTES = 1024, 8 << 20


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches. Spark reads both bounds when it plans, so they are set for the session, never above what it had."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        now = re.fullmatch(r"([0-9]+)b?", conf.get(f"spark.sql.execution.arrow.{key}"))
        if not now or not 0 < int(now[1]) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", most)
    return df.mapInArrow(f, schema)
