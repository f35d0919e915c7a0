"""Index tables of standards, their files and their regions, built in one call, and look-ups that read little of them.

Each table is ranged and sorted by the key that most look-ups use, and has Bloom filters on the other keys: ids beside normal and compact codes, base ids
beside lower-case file names and paths. A look-up is a plain filter on a stored column, so that statistics and filters reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import codes
from quillon.operators import geo
from quillon.sinks import export, snapshots

#: Bytes of a row group: small, since look-ups want one of many.
ROW_GROUP = 8 << 20


def build(base: DataFrame, files: DataFrame | None, folder: str, built_at: str, relations: DataFrame | None = None, units: DataFrame | None = None, areas: DataFrame | None = None, parts: int | None = None, row_group: int = ROW_GROUP) -> dict:
    """Write the index tables below the new ``folder`` and return what is noted: built_at, rows of each table, with_file (standards that have one) and, with
    relations, units and areas, with_unit and with_region. The note is written last: without it there is no index.

    ``base`` has id and std_id, ``files`` base_id, file_name and file_path. Standards come in the order of their normal codes; a null code has a null key.
    Without files there is a table of standards alone, which is all that look-ups of codes and ids read.
    """
    spark = base.sparkSession
    keyed = base.withColumns({"std_id_norm": codes.norm_key(F.col("std_id")), "std_id_compact": codes.stored_compact(F.col("std_id")), "compact": codes.compact_key(F.col("std_id"))})
    export.write_index(keyed, f"{folder}/standards", "std_id_norm", parts, ("id", "std_id", "compact"), row_group)
    std = spark.read.parquet(f"{folder}/standards")
    if files is None:
        notes = {"built_at": built_at, "standards": std.count()}
        snapshots.put(spark, f"{folder}/index.json", snapshots.as_json(notes))
        return notes
    lower = files.withColumns({"name_key": F.lower("file_name"), "path_key": F.lower("file_path")})
    export.write_index(lower, f"{folder}/files", "base_id", parts, ("name_key", "path_key"), row_group)
    found = spark.read.parquet(f"{folder}/files")
    notes = {"built_at": built_at, "standards": std.count(), "files": found.count(), "with_file": std.join(found, std["id"] == found["base_id"], "left_semi").count()}
    if relations is not None and units is not None and areas is not None:
        export.write_index(geo.materialize(relations, units, areas), f"{folder}/regions", "base_id", parts, ("unit_id",), row_group)
        placed = spark.read.parquet(f"{folder}/regions")
        per = placed.agg(F.count_distinct("base_id").alias("u"), F.count_distinct(F.when(F.col("province_name").isNotNull(), F.col("base_id"))).alias("r")).first()
        notes |= {"regions": placed.count(), "with_unit": per["u"], "with_region": per["r"]}
    snapshots.put(spark, f"{folder}/index.json", snapshots.as_json(notes))
    return notes


def ready(spark: SparkSession, folder: str) -> bool:
    """Whether the index was built as a whole."""
    return "index.json" in snapshots.names(spark, folder)


def noted(spark: SparkSession, folder: str) -> DataFrame:
    """What was noted of the build, as one row."""
    if not ready(spark, folder):
        raise ValueError(f"no index at {folder}")
    return spark.read.json(f"{folder}/index.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if not ready(spark, folder):
        raise ValueError(f"no index at {folder}")
    return spark.read.parquet(f"{folder}/{name}")


def by_id(spark: SparkSession, folder: str, *ids: int) -> DataFrame:
    return _table(spark, folder, "standards").filter(F.col("id").isin(*ids))


def by_code(spark: SparkSession, folder: str, code: str) -> DataFrame:
    """Standards whose code is ``code`` in any spelling."""
    from quillon.plans import intent

    key = intent.compact_key(code)
    return _table(spark, folder, "standards").filter(F.col("compact") == key) if key else _table(spark, folder, "standards").limit(0)


def by_file_name(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """Files of these names, without regard to case."""
    return _table(spark, folder, "files").filter(F.col("name_key").isin(*[n.lower() for n in names]))


def by_path(spark: SparkSession, folder: str, *paths: str) -> DataFrame:
    return _table(spark, folder, "files").filter(F.col("path_key").isin(*[p.lower() for p in paths]))
