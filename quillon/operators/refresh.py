"""A catalogue of files on disk, brought up to date from listings: table, full-text postings and what is noted of the build.

A listing is compared with the last version by path, size and time. Files of a folder share a bucket, and only buckets with a difference are written anew; the
postings get a segment of what came or changed, and ids that went or changed are noted as dead for older segments. One published
file switches all of it at once. After some segments the postings are written as a whole again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import catalog, postings
from quillon.sinks import snapshots

#: Segments of postings after which they are written as a whole.
MOST_SEGMENTS = 8
COLUMNS = ("id", "category", "title", "filename", "file_ext", "file_size", "mtime", "rel_path")


def entries(listing: DataFrame, parse: Callable[[DataFrame], DataFrame] = catalog.by_folder) -> DataFrame:
    """Catalogue rows of a listing (rel_path, file_size, mtime). The id is a hash of the path, so it outlives rebuilds: at 10^9 files two paths share one with a chance of 3 %."""
    return parse(listing.select("rel_path", "file_size", "mtime")).withColumn("id", F.xxhash64("rel_path")).select(*COLUMNS)


def refresh(listing: DataFrame, folder: str, root: str, built_at: str, parse: Callable[[DataFrame], DataFrame] = catalog.by_folder, buckets: int = 64, most_segments: int = MOST_SEGMENTS) -> dict:
    """Bring the catalogue at ``folder`` up to date with a listing (rel_path, file_size, mtime) of ``root`` and return what is noted of it: built_at, root, total, and
    how many files were added, changed and removed.

    Paths are unique; of a path that is listed twice the row with the latest time counts, and a null path is left out. A listing without differences
    writes no rows and only notes the build. An empty listing removes all.
    """
    spark, before = listing.sparkSession, snapshots.current(listing.sparkSession, folder)
    if before is not None and before.notes["buckets"] != buckets:
        raise ValueError(f"the catalogue has {before.notes['buckets']} buckets")
    place = F.pmod(F.xxhash64(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)), F.lit(buckets)).cast("string")
    now = listing.filter(F.col("rel_path").isNotNull()).groupBy("rel_path").agg(F.max(F.struct("mtime", "file_size")).alias("f")).select("rel_path", "f.file_size", "f.mtime")
    old = snapshots.rows(spark, folder, before)
    if old is None:
        old = entries(now, parse).limit(0)
    was = old.select(F.col("rel_path").alias("__path"), F.col("file_size").alias("__size"), F.col("mtime").alias("__mtime"))
    both = now.join(was, F.col("rel_path") == F.col("__path"), "full")
    kind = (
        F.when(F.col("__path").isNull(), "added").when(F.col("rel_path").isNull(), "removed")
        .when(~(F.col("file_size").eqNullSafe(F.col("__size")) & F.col("mtime").eqNullSafe(F.col("__mtime"))), "changed")
    )
    number = before.number + 1 if before else 0
    work = f"{folder}/changes/{number}"
    both.select(F.coalesce("rel_path", "__path").alias("rel_path"), kind.alias("kind")).filter("kind is not null").withColumn("bucket", place).write.mode("overwrite").parquet(work)
    changes = spark.read.parquet(work)
    counts = {r["kind"]: r["n"] for r in changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]
    notes = before.notes if before else {"segments": [], "dead": [], "total": 0}
    notes = notes | {"built_at": built_at, "root": root, "buckets": buckets} | {k: counts.get(k, 0) for k in ("added", "changed", "removed")}
    notes["total"] += notes["added"] - notes["removed"]
    if before is not None and not touched:
        snapshots.publish(spark, folder, snapshots.Snapshot(number, before.buckets, before.columns, notes))
        return notes
    rows = entries(now.withColumn("bucket", place).filter(F.col("bucket").isin(touched)), parse).withColumn("bucket", place)
    notes["segments"], notes["dead"] = [*notes["segments"], number], [*notes["dead"], *([number] if number else [])]
    whole = len(notes["segments"]) > most_segments
    if whole:
        notes["segments"], notes["dead"] = [number], []
    if notes["dead"]:
        changes.filter("kind <> 'added'").select(F.xxhash64("rel_path").alias("id")).write.mode("overwrite").parquet(f"{folder}/dead/v={number}")
    out = snapshots.prepared(rows.repartition("bucket"), folder, touched if before else None, notes, before)
    # Postings are made of the rows that were written, so that both say the same of a listing that may change meanwhile.
    if whole:
        made = snapshots.rows(spark, folder, out)
    else:
        made = snapshots.rows(spark, folder, out, touched).join(changes.filter("kind <> 'removed'").select("rel_path"), "rel_path", "left_semi")
    postings.write(postings.of(made), f"{folder}/postings/v={number}")
    snapshots.publish(spark, folder, out)
    return notes


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue's rows as last published."""
    found = snapshots.rows(spark, folder, snapshots.current(spark, folder))
    if found is None:
        raise ValueError(f"no catalogue at {folder}")
    return found


def search(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Rows of the catalogue whose category, title or file name holds any word's phrase, by the postings; a blank text matches all."""
    rows, notes = files(spark, folder), snapshots.current(spark, folder).notes
    if not (text or "").strip():
        return rows
    placed = spark.read.option("basePath", f"{folder}/postings").parquet(*[f"{folder}/postings/v={n}" for n in notes["segments"]])
    ids = postings.matching(placed, text, "v")
    if notes["dead"]:
        dead = spark.read.option("basePath", f"{folder}/dead").parquet(*[f"{folder}/dead/v={n}" for n in notes["dead"]]).select(F.col("id").alias("__dead"), F.col("v").alias("__since"))
        ids = ids.join(dead, (ids["id"] == dead["__dead"]) & (ids["v"] < dead["__since"]), "left_anti")
    return rows.join(ids.select(F.col("id").alias("__id")).distinct(), rows["id"] == F.col("__id"), "left_semi")


def status(spark: SparkSession, folder: str, now: str | None = None) -> DataFrame:
    """One row: whether the catalogue is ready, and what is noted of its last build. With a time of ``now`` also its age in seconds."""
    found = snapshots.current(spark, folder)
    notes = found.notes if found else {}
    columns = {"ready": ("boolean", found is not None), "built_at": ("string", notes.get("built_at")), "root": ("string", notes.get("root"))}
    columns |= {k: ("long", notes.get(k, 0)) for k in ("total", "added", "changed", "removed")}
    row = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, (t, v) in columns.items()])
    age = F.lit(now).cast("timestamp").cast("long") - F.col("built_at").cast("timestamp").cast("long")
    return row.withColumn("age_seconds", age) if now else row
