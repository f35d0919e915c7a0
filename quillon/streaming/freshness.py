"""Arriving catalogue rows: the newest version of each key, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sinks import snapshots


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def per_window(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows a window and key, with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def merge_latest(batch: DataFrame, key: str, version: str, target: str, number: int = 0, buckets: Column | int = 64) -> list:
    """Merge a batch's newest rows a key into the table at ``target``, which holds one row a key; returns the buckets that were rewritten.

    Only the buckets of the batch's keys are read and written: of hashed keys, as many as ``buckets``, or of a column of the caller's, such as a range of the keys, which
    keeps together what arrives together. Of equal versions the row that compares larger stays; a null version is the oldest, a null key is a key. A batch
    that was merged before changes nothing.
    """
    spark, before = batch.sparkSession, snapshots.current(batch.sparkSession, target)
    if before is not None and before.notes["batch"] >= number:
        return []
    place = F.pmod(F.xxhash64(key), F.lit(buckets)) if isinstance(buckets, int) else buckets
    newest = lambda df: df.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns]), F.struct(F.col(version), *[F.col(f"`{c}`") for c in batch.columns])).alias("__r")).select("__r.*")
    fresh = newest(batch)
    touched = [r[0] for r in fresh.select(place.cast("string").alias("b")).distinct().collect()]
    old = snapshots.rows(spark, target, before, touched)
    every = fresh if old is None else newest(old.unionByName(fresh))
    placed = every.withColumn(snapshots.BUCKET, place.cast("string"))
    snapshots.replace(placed.repartition(snapshots.BUCKET, F.pmod(F.xxhash64(key), F.lit(8))), target, touched, {"batch": number}, before)
    return touched


def latest(spark: SparkSession, target: str) -> DataFrame | None:
    """The merged table as it was last published."""
    return snapshots.rows(spark, target, snapshots.current(spark, target))


def keep_latest(stream: DataFrame, key: str, version: str, target: str, checkpoint: str, buckets: Column | int = 64) -> StreamingQuery:
    """``merge_latest`` of each batch of a stream. A batch that runs again after a failure gives the same table."""
    merge = lambda batch, number: merge_latest(batch, key, version, target, number, buckets) and None
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
