"""From an uploaded list to its preview and its bundle, in one chain of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import batch
from quillon.sinks import bundles, export, snapshots
from quillon.sources import listing as sources

# How the remarked upload is named, and what is said of an upload that cannot be taken.
ANNOTATED = "_下载结果"
UNKNOWN_KIND, NO_CODES = "仅支持 .xlsx、.xlsm 或 .csv 文件", "未识别到有效标准号，请确认含有「标准号/标准编号」列"


@dataclass(frozen=True)
class Upload:
    """An upload that was read: its requests (row, query, name_hint) and one row of what was found out about it; or what is wrong with it."""

    requests: DataFrame | None
    meta: DataFrame | None
    error: str | None = None


def meta(rows: DataFrame, source: str, most: int = batch.MOST_ROWS) -> DataFrame:
    """One row: source, header_row, std_col, name_col, remark_col, total_rows (requests taken), truncated (more rows followed) and max_rows."""
    at = batch.layout(rows).select(F.struct("start", "header_row", "std_col", "name_col", "remark_col")).scalar()
    taken = batch.requests(rows, most).agg(F.count(F.lit(1))).scalar()
    last = rows.agg(F.max("row") + 1).scalar()
    one = rows.sparkSession.range(1).select(at.alias("at"), taken.alias("n"), last.alias("rows"))
    truncated = F.coalesce((F.col("n") >= most) & (F.col("rows") - F.col("at.start") > F.col("n")), F.lit(False))
    return one.select(F.lit(source).alias("source"), "at.header_row", "at.std_col", "at.name_col", "at.remark_col", F.col("n").alias("total_rows"), truncated.alias("truncated"), F.lit(most).alias("max_rows"))


def parsed(spark: SparkSession, path: str, most: int = batch.MOST_ROWS) -> Upload:
    """The upload at ``path``, by its extension. One of another kind, and one without a code, has an error and no requests."""
    try:
        rows = sources.parse_upload(spark, path)
    except ValueError:
        return Upload(None, None, UNKNOWN_KIND) if path.rsplit(".", 1)[-1].casefold() not in ("csv", "xlsx", "xlsm") else _refused(path)
    about, requests = meta(rows, path.rsplit(".", 1)[-1].casefold(), most), batch.requests(rows, most)
    return Upload(None, about, NO_CODES) if requests.isEmpty() else Upload(requests, about)


def _refused(path: str) -> Upload:
    return Upload(None, None, f"{path.rsplit('/', 1)[-1]}: {sources.MOST_BYTES} bytes at most")


def preview(requests: DataFrame, base: DataFrame | None, files: DataFrame | None, on_disk: DataFrame | None, most: int = batch.MOST_ROWS) -> DataFrame:
    """What a bundle of the requests (row, query) would hold: row, query, status, source, base_id, std_id, path, file_name, zip_name, message.

    Blank requests have no row. Without a catalogue (``base`` none) each request is an error; without a listing of the disk, files of the catalogue are
    taken as they are listed there. The first ``most`` rows are shown: the limit is the feature.
    """
    asked = requests.filter(F.length(F.trim(F.coalesce("query", F.lit("")))) > 0).orderBy("row").limit(most).select("row", "query")
    if base is None or files is None:
        nothing = [F.lit(None).cast("long" if c == "base_id" else "string").alias(c) for c in ("source", "base_id", "std_id", "path", "file_name", "zip_name")]
        out = asked.select("row", "query", F.lit("error").alias("status"), *nothing)
    else:
        out = batch.served(asked, base, files, on_disk if on_disk is not None else files.select(F.col("file_path").alias("path")))
    return out.withColumn("message", bundles.message(F.col("status")))


def bundle(spark: SparkSession, path: str, base: DataFrame, files: DataFrame, on_disk: DataFrame, root: str, folder: str, generated_at: str) -> dict:
    """Read an upload, find its files and write their bundle, with the upload's own rows beside it, in which those that failed are remarked: the bundle's summary, or
    ``error`` alone."""
    read = parsed(spark, path)
    if read.error:
        return {"error": read.error}
    summary = bundles.write(preview(read.requests, base, files, on_disk), folder, root, generated_at)
    rows = sources.parse_upload(spark, path)
    told = batch.annotated(rows, spark.read.json(f"{folder}/manifest", schema="row long, status string"))
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    snapshots.put(spark, f"{folder}/{stem}{ANNOTATED}.csv", "\ufeff" + export.annotated_text(rows, told.select("row", "remark")))
    return summary
