"""Bundles of files as ZIP shards that tasks write, with one manifest that makes them a bundle.

Requests are dealt out in ranges of their rows; each task streams its files from the store into a shard of its own, which gets its name when it is whole. What tasks
report says which shards count, so one left by a lost or repeated task is in no manifest. The manifest's summary is written last and by renaming: without it there is no
bundle. No file passes the driver, and a task holds one piece of one file at a time.
"""

from __future__ import annotations

import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import kept, ship
from quillon.sinks import snapshots
from quillon.sinks.export import below

PER_SHARD, PIECE = 500, 1 << 20
# The folder of files within a bundle, and what is said of a request's outcome.
FOLDER = "PDF"
MESSAGES = {"empty": "空行", "error": "标准库未就绪", "not_found": "未找到匹配标准", "no_pdf": "已匹配标准但未找到 PDF", "gone": "PDF 文件不存在", "outside": "路径不在允许的目录内"}


def message(status: Column) -> Column:
    """What is said of a status; nothing of a good or an unknown one."""
    return F.coalesce(*[F.when(status == k, v) for k, v in MESSAGES.items()])


def planned(results: DataFrame) -> DataFrame:
    """Results (row, status, zip_name, ...) with ``zip_entry``, null where nothing is packed: the file's name led by its row, in one folder. Rows are
    numbers of requests; should one come twice with the same name, the later gets _2, _3 ... before its suffix. Results are kept in the shared folder, and only those
    of rows that come twice are dealt out to be numbered."""
    results = kept(results, "results")
    again = kept(results.groupBy(F.col("row").alias("__row")).count().filter("count > 1").select("__row"), "rows-again")
    met = lambda how: results.join(again, results["row"].eqNullSafe(again["__row"]), how)
    name = F.concat(F.lpad(F.col("row").cast("string"), F.greatest(F.lit(3), F.length(F.col("row").cast("string"))), F.lit("0")), F.lit("_"), F.col("zip_name"))
    others = [F.col(f"`{c}`") for c in results.columns if c not in ("row", "zip_name")]
    twice = F.row_number().over(Window.partitionBy("row", "zip_name").orderBy(*others))
    numbered = F.when(F.col("__n") == 1, name).otherwise(F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), F.lit("_"), F.col("__n"), F.regexp_extract(name, r".(\.[^.]+)$", 1)))
    counted = met("left_anti").withColumn("__n", F.lit(1)).union(met("left_semi").withColumn("__n", twice))
    return counted.withColumn("zip_entry", F.when(F.col("status") == "ok", F.concat(F.lit(f"{FOLDER}/"), numbered))).drop("__n")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _shards(folder: str, root: str, per_shard: int):
    """Pack a task's rows (row, path, zip_entry) and report (row, entry, outcome, shard, bytes) of each; a full shard is followed by another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = _store(folder)
        source, below_root = _store(root)
        name, out, pack, report, n = "", None, None, [], 0

        def close() -> None:
            pack.close()
            out.close()
            to.move(f"{base}/{name}.open", f"{base}/{name}")

        for batch in batches:
            for row, path, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = posixpath.normpath(posixpath.join(below_root, path.replace("\\", "/")))
                if not below(below_root, path):
                    report.append((row, entry, "outside", None, None))
                    continue
                info = source.get_file_info(full)
                if info.type != fs.FileType.File:
                    report.append((row, entry, "gone", None, None))
                    continue
                if pack is None:
                    name = f"{uuid4().hex}.zip"
                    out = to.open_output_stream(f"{base}/{name}.open", compression=None)
                    pack, n = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), 0
                size = 0
                with source.open_input_stream(full, compression=None) as read, pack.open(zipfile.ZipInfo(entry), "w", force_zip64=True) as write:
                    while piece := read.read(PIECE):
                        write.write(piece)
                        size += len(piece)
                report.append((row, entry, "ok", name, size))
                n += 1
                if n == per_shard:
                    close()
                    pack = None
        if pack is not None:
            close()
        columns = list(zip(*report, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["row", "entry", "outcome", "shard", "bytes"])

    return run


def write(results: DataFrame, folder: str, root: str, generated_at: str, per_shard: int = PER_SHARD) -> dict:
    """Write a bundle of the good ones among ``results`` (row, query, status, std_id, path, zip_name) to the new ``folder`` and return its summary: generated_at, total,
    success, failed, shards, bytes.

    Paths are below ``root``; one that leads out of it is refused (outside), one without a file is missed (gone). Beside the shards lie ``manifest`` (JSON lines, a row a
    request with its status, message, shard and entry), ``lines`` (the same to be read) and, last, ``manifest.json`` with the summary.
    """
    spark = results.sparkSession
    ship(spark)
    plan = planned(results)
    plan.write.mode("overwrite").parquet(f"{folder}/plan")
    plan = spark.read.schema(plan.schema).parquet(f"{folder}/plan")
    wanted = plan.filter("zip_entry is not null").select(F.col("row").cast("long").alias("row"), "path", "zip_entry")
    shards = max(1, -(-wanted.count() // per_shard))
    packed = wanted.repartitionByRange(shards, "row", "zip_entry").mapInArrow(_shards(folder, root, per_shard), "row long, entry string, outcome string, shard string, bytes long")
    packed.write.mode("overwrite").parquet(f"{folder}/packed")
    packed = spark.read.parquet(f"{folder}/packed").withColumnRenamed("row", "__row")
    done = plan.join(packed, (plan["row"] == packed["__row"]) & (plan["zip_entry"] == packed["entry"]), "left").drop("__row", "entry")
    status = F.when((F.col("status") == "ok") & (F.coalesce("outcome", F.lit("gone")) != "ok"), "no_pdf").otherwise(F.col("status"))
    told = done.withColumn("message", message(F.when(F.col("outcome") != "ok", F.col("outcome")).otherwise(F.col("status")))).withColumn("status", status)
    told = told.withColumn("zip_entry", F.when(F.col("status") == "ok", F.col("zip_entry"))).drop("outcome")
    told.write.mode("overwrite").json(f"{folder}/manifest", ignoreNullFields=False)
    mark = F.when(F.col("status") == "ok", "✓").otherwise("✗")
    line = F.concat(mark, F.lit(" 第"), F.col("row"), F.lit("行 | 查询："), F.coalesce("query", F.lit("")), F.lit(" | "), F.coalesce("std_id", F.lit("—")), F.lit(" | "), F.coalesce("message", "status"))
    told.orderBy("row").select(line).write.mode("overwrite").text(f"{folder}/lines")
    ok = F.count_if(F.col("status") == "ok")
    sums = told.agg(F.count(F.lit(1)).alias("total"), ok.alias("success"), (F.count(F.lit(1)) - ok).alias("failed"), F.count_distinct("shard").alias("shards"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    summary = {"generated_at": generated_at, **sums.asDict()}
    snapshots.put(spark, f"{folder}/manifest.json", json.dumps(summary, ensure_ascii=False))
    return summary
