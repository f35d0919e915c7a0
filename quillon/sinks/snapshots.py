"""Parquet tables in buckets of which a change rewrites only those that it touches.

A version writes the buckets it changes below ``v=<number>`` and then publishes one small JSON file that says, for every bucket, in which
version it lies. Readers take the newest published file, so they see all of a version or nothing of it; a write that broke off leaves a folder that
no file names, and the next one overwrites it. Two writers cannot publish the same number, since a rename onto an existing file fails.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BUCKET = "bucket"


@dataclass(frozen=True)
class Snapshot:
    """What a published file says: its number, the version of each bucket, the columns, and what the writer notes."""

    number: int
    buckets: dict[str, int]
    columns: dict
    notes: dict = field(default_factory=dict)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _hadoop(spark, path)
    return store.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    store, at = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def current(spark: SparkSession, folder: str) -> Snapshot | None:
    """The newest published version, none if there is none."""
    found = [n for n in names(spark, f"{folder}/published") if n.endswith(".json")]
    if not found:
        return None
    text = "\n".join(r["value"] for r in spark.read.text(f"{folder}/published/{found[-1]}").collect())
    return Snapshot(**json.loads(text))


def rows(spark: SparkSession, folder: str, snapshot: Snapshot | None, buckets: list | None = None) -> DataFrame | None:
    """The rows of a version, of some buckets or of all; none without a version. Only the folders of these buckets are read."""
    if snapshot is None:
        return None
    schema = StructType.fromJson(snapshot.columns)
    wanted = snapshot.buckets if buckets is None else {b: v for b in map(str, buckets) if (v := snapshot.buckets.get(b)) is not None}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/v={v}/{BUCKET}={b}" for b, v in wanted.items()])


def prepared(df: DataFrame, folder: str, touched: list | None, notes: dict, before: Snapshot | None) -> Snapshot:
    """A version, written but not published, in which ``df``, with a column ``bucket``, is all that the ``touched`` buckets hold (of all buckets, where none are
    given); the others stay as they were. A bucket's rows come from the tasks that have them: give ``df`` in the order and partitions wanted."""
    spark, number = df.sparkSession, before.number + 1 if before else 0
    df.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/v={number}")
    written = {n.split("=", 1)[1] for n in names(spark, f"{folder}/v={number}") if n.startswith(f"{BUCKET}=")}
    kept = {} if touched is None or before is None else {b: v for b, v in before.buckets.items() if b not in set(map(str, touched))}
    return Snapshot(number, kept | dict.fromkeys(sorted(written), number), json.loads(df.drop(BUCKET).schema.json()), notes)


def replace(df: DataFrame, folder: str, touched: list | None, notes: dict, before: Snapshot | None) -> Snapshot:
    """Write a version (``prepared``) and publish it."""
    out = prepared(df, folder, touched, notes, before)
    publish(df.sparkSession, folder, out)
    return out


def publish(spark: SparkSession, folder: str, snapshot: Snapshot) -> None:
    """Make a version the current one; an error if another writer was first."""
    try:
        put(spark, f"{folder}/published/{snapshot.number:09d}.json", json.dumps(asdict(snapshot)))
    except FileExistsError as e:
        raise RuntimeError(f"version {snapshot.number} of {folder} was published by another writer") from e


def as_json(notes: dict) -> str:
    return json.dumps(notes, ensure_ascii=False)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it, so that it is there as a whole or not at all. It must not be there yet."""
    folder, name = path.rsplit("/", 1)
    store, to = _hadoop(spark, path)
    _, beside = _hadoop(spark, f"{folder}/.{name}-{uuid4().hex}")
    out = store.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if store.exists(to) or not store.rename(beside, to):
        store.delete(beside, False)
        raise FileExistsError(path)
