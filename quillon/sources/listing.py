"""Listings of files, uploads and dictionaries."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """path, rel_path, file_size, mtime of the files below a root; contents are not read. Extensions match any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    return found.filter(ext.isin(*extensions)).select("path", F.regexp_replace(F.replace(plain, base, F.lit("")), "^/+", "").alias("rel_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"))


def newest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """Path of the latest file that matches, none if there is none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).orderBy(F.col("modificationTime").desc(), "path").select("path").first()
    return found["path"] if found else None


#: Bytes of the largest upload that is taken.
MOST_BYTES = 20 * 1024 * 1024


def upload(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """row (from 0) and cells of an uploaded CSV file, kept as text; a byte order mark goes. Quoted cells may hold line ends, commas and
    doubled quotes. A blank line has no row, but counts. A larger file than ``most_bytes`` is refused, so one task can read it."""
    raw = spark.read.format("binaryFile").load(path).select("content", "length")
    if raw.filter(F.col("length") > most_bytes).limit(1).count():
        raise ValueError(f"uploads hold at most {most_bytes} bytes")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                found = [(i, cells) for i, cells in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig", errors="replace"), newline=""))) if cells]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([c for _, c in found], pa.list_(pa.string()))], names=["row", "cells"])

    return raw.select("content").mapInArrow(rows, "row int, cells array<string>")


def parse_upload(spark: SparkSession, path: str) -> DataFrame:
    """row and cells of an upload by its extension; any other is refused."""
    kind = path.rsplit(".", 1)[-1].casefold()
    if kind == "csv":
        return upload(spark, path)
    if kind in ("xlsx", "xlsm"):
        return workbook(spark, path)
    raise ValueError("uploads are .xlsx, .xlsm or .csv files")


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """row (from 0, blank rows left out) and cells of a workbook's active sheet; needs openpyxl, which a driver may lack."""
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    sheet = load_workbook(path, read_only=True, data_only=True).active
    text = lambda v: "" if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v).strip()
    read = ([text(v) for v in r] for r in sheet.iter_rows(values_only=True))
    return spark.createDataFrame(list(enumerate(cells for cells in read if any(cells))), "row int, cells array<string>")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """id, name, keywords of product groups in a JSON file: a list, or an object that holds one."""
    raw = spark.read.option("multiLine", "true").json(path)
    return (raw.select(F.inline("clusters")) if "clusters" in raw.columns else raw).select("id", "name", "keywords")
