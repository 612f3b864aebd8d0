"""Admission of uploads: what a walk in order of arrival would accept, owner by owner, done as joins and ranks.

An upload is rejected for what is wrong with itself (services.upload_reasons), else if its owner has reached the quota, else if the owner
has the same content already, in the store or from an upload accepted before. Within an owner only the first sound upload of a content
can be accepted, and only while earlier ones leave room: a later copy is a duplicate if the first was accepted, and over quota if it
was not, for room never comes back. So an upload's fate follows from how many of its owner's first copies come before it.

These are counted over ranges of (owner, order): those before it in its range, plus the owner's in the ranges before, of which there is one sum a range
and owner. So the uploads of an owner with most of them are counted by many tasks and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .services import upload_reasons


def admitted(uploads: DataFrame, store: DataFrame, quota: int | Column | None, order: list[str]) -> DataFrame:
    """uploads (owner, hash, name, mime, size, ...) with accepted and reason (null if accepted), against the store's rows (owner, hash).

    order: columns that tell the uploads of an owner apart. quota: documents an owner may have, a number, a column of uploads or None for no limit; reason: what is wrong with the upload, ``quota`` or ``duplicate``."""
    own = F.array_join(upload_reasons(F.col("name"), F.col("mime"), F.col("size")), ", ")
    checked = uploads.withColumn("_wrong", F.nullif(own, F.lit("")))
    sound = checked.where(F.col("_wrong").isNull())
    have = store.groupBy("owner", "hash").agg(F.count(F.lit(1)).alias("_copies"))
    counts = have.groupBy(F.col("owner").alias("_owner")).agg(F.sum("_copies").alias("_has"))
    known = have.select(F.col("owner").alias("_o"), F.col("hash").alias("_h"), F.lit(True).alias("_stored"))
    place = F.struct(*order)
    firsts = sound.groupBy(F.col("owner").alias("_o"), F.col("hash").alias("_h")).agg(F.min(place).alias("_first"))
    same = F.col("owner").eqNullSafe(F.col("_o")) & F.col("hash").eqNullSafe(F.col("_h"))
    fresh = firsts.join(known.withColumnsRenamed({"_o": "_ko", "_h": "_kh"}), F.col("_o").eqNullSafe(F.col("_ko")) & F.col("_h").eqNullSafe(F.col("_kh")), "left_anti")
    lined = fresh.select("_o", "_h", "_first")
    j = checked.join(lined, same, "left").drop("_o", "_h").join(known, same, "left").drop("_o", "_h").join(counts, F.col("owner").eqNullSafe(F.col("_owner")), "left").drop("_owner")
    # accepted before this upload: the owner's first copies of a lower place that found room
    room = F.lit(None).cast("long") if quota is None else F.greatest((quota if isinstance(quota, Column) else F.lit(quota)).cast("long") - F.coalesce("_has", F.lit(0)), F.lit(0))
    earlier = _with_before(j, lined, order)
    reason = F.when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(room.isNotNull() & (F.col("_before") >= room), "quota").when(F.col("_stored").isNotNull() | (F.col("_first") != place), "duplicate")
    return earlier.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).select(*uploads.columns, "accepted", "reason")


def _with_before(rows: DataFrame, lined: DataFrame, order: list[str]) -> DataFrame:
    """rows with _before, how many first copies of their owner come before them: first copies and rows are put in one line and counted."""
    mark = lined.select(F.col("_o").alias("owner"), F.col("_first").alias("_place"), F.lit(1).alias("_is"))
    line = rows.withColumn("_place", F.struct(*order)).withColumn("_is", F.lit(0))
    both = line.unionByName(mark, allowMissingColumns=True)
    by = [F.col("owner").asc_nulls_first(), F.col("_place").asc(), F.col("_is").asc()]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(both.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    of_part = placed.groupBy(F.col("owner").alias("_key"), part.alias("_part")).agg(F.sum("_is").alias("_n"))
    far = of_part.select("_key", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_far"))
    own = F.coalesce(F.sum("_is").over(Window.partitionBy("_own", "owner").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # within one range
    j = placed.withColumn("_own", part).withColumn("_near", own).where("_is = 0").join(far, F.col("owner").eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_part")))
    return j.withColumn("_before", F.col("_far") + F.col("_near")).drop("_place", "_is", "_at", "_own", "_key", "_part", "_far", "_near")
