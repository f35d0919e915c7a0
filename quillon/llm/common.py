"""Small shared helpers: column checks, stable ids, lineage cuts, white space and bucket counts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract here: the space and the characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Tell the Python workers of a session that was started elsewhere where this package lies."""
    environment = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parents[2])
    if home not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH", ""), home]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set, a session on one machine (tests) gets one under its warehouse; on a
    cluster, where that may be a disk of each machine, this is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def held(df: DataFrame, rows: int, keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, int]:
    """The table after ``keep``, and its number of rows, which Spark counts as it writes them. A later stage reads it in tasks of about ``rows`` rows, so that
    a small table costs few tasks and files, however many shuffle partitions the session has; no task gets all rows of a large one."""
    seen = Observation()
    out = keep(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get.get("n")
    n = out.count() if n is None else n
    return out.coalesce(max(1, -(-n // rows))), n


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, a long, and its name. They are kept in the shared folder, so that every later reading
    sees the same keys, whatever order the rows come in."""
    (row,) = fresh(df, "__row_key")
    return cut(df.withColumn(row, F.monotonically_increasing_id())), row


def row_order(id_col: str, row: str) -> Column:
    """Smallest first: the smallest id, null ids last; then the row's key. The field ``row`` holds the key."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))


def first_rows(keyed: DataFrame, row: str, grouped: DataFrame) -> DataFrame:
    """The rows of ``keyed`` without those that are not the first of their group; ``grouped`` has (key, a row_order; root) of all
    rows in groups of two or more."""
    first = grouped.groupBy("root").agg(F.min("key").alias("first"))
    dropped = cut(grouped.join(first, "root").filter("key.row <> first.row").select(F.col("key.row").alias(row)))
    return keyed.join(dropped, row, "left_anti").drop(row)


def slices(batch: pa.RecordBatch, column: int, rows: int, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``most`` bytes of a text column, so that memory follows neither
    the rows of a batch nor, but for one text, their lengths."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin >= rows or size + n > most):
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def sample_ids(df: DataFrame, id_col: str, n: int, by: str | None = None) -> DataFrame:
    """At most ``n`` ids, or ``n`` for each value of ``by``: those first in hash order.

    Counts come first, so that rows beyond about twice the sample leave in the scan by their hash; what is sorted, and what
    reaches the driver, does not grow with the table or its partitions.
    """
    span, oversample, spare = 1 << 40, 2, 200
    place = F.pmod(F.xxhash64(id_col), F.lit(span))
    narrow = df.select(F.col(id_col).alias("__id"), place.alias("__place"), *([F.col(by).alias("__by")] if by else []))
    bound = lambda total: min(span, span * (oversample * n + spare) // max(total, 1))
    if by is None:
        return narrow.filter(F.col("__place") < bound(df.count())).orderBy("__place", "__id").limit(n).select("__id")
    share = F.lit(oversample * n + spare).cast("double") / F.col("__total")
    sizes = narrow.groupBy("__by").agg(F.count(F.lit(1)).alias("__total")).select(F.col("__by").alias("__of"), F.least(F.lit(span), (share * span).cast("long")).alias("__bound"))
    kept = narrow.join(sizes, F.col("__by").eqNullSafe(F.col("__of"))).filter("__place < __bound")
    ranked = kept.withColumn("__n", F.row_number().over(Window.partitionBy("__by").orderBy("__place", "__id")))
    return ranked.filter(F.col("__n") <= n).select("__id")


def buckets(spark: SparkSession) -> int:
    """Number of hash buckets: the session's shuffle partitions, which operators of a cluster scale with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
