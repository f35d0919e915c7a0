"""Index tables, manifests and bundles."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import display

MOST_BUNDLED = 5000


def write_index(df: DataFrame, path: str, key: str, files: int | None = None, look_up: tuple[str, ...] = (), row_group: int | None = None) -> None:
    """Parquet in ranges of the key, sorted, so that row-group statistics serve look-ups of keys and prefixes. Columns of ``look_up``, by which the rows are not
    sorted, get Bloom filters: a look-up of one value skips nearly all row groups (of ``row_group`` bytes)."""
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in look_up} | ({"parquet.block.size": str(row_group)} if row_group else {})
    ranged.sortWithinPartitions(key).write.mode("overwrite").options(**options).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table whose later joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def manifest(results: DataFrame, generated_at: str, most: int = MOST_BUNDLED) -> DataFrame:
    """One row for the JSON manifest of a bundle. Totals are of all results; of these the first ``most`` by row are listed, and
    ``left_out`` says how many are not."""
    columns = ["row", *[c for c in results.columns if c != "row"]]
    listed = results.orderBy(*columns).limit(most).select(F.lit(False).alias("counts"), F.lit(None).cast("string").alias("status"), F.struct(*columns).alias("r"))
    counted = results.select(F.lit(True).alias("counts"), F.col("status").cast("string"), F.lit(None).cast(listed.schema["r"].dataType).alias("r"))
    ok = F.count_if(F.col("counts") & (F.col("status") == "ok"))
    total, rows = F.count_if("counts"), F.array_sort(F.collect_list("r"))
    return counted.union(listed).agg(
        F.lit(generated_at).alias("generated_at"), total.alias("total"), ok.alias("success"), (total - ok).alias("failed"), (total - F.size(rows)).alias("left_out"), rows.alias("results")
    )


def bundle(results: DataFrame, target: str, read: Callable[[str], bytes], generated_at: str, path_col: str = "file_name", most: int = MOST_BUNDLED, root: str | None = None) -> int:
    """Pack the found files, and both manifests, into a ZIP on the driver; returns how many files it holds.

    At most ``most`` results, by row, are packed; the manifest counts the others as left out. Names in the ZIP are made unique in the order of rows.
    With a ``root``, a path that leads out of it is refused.
    """
    total = results.count()
    found, used, n = [r.asDict() for r in results.orderBy("row").limit(most).collect()], set(), 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for r in found:
            if r["status"] == "ok" and (root is None or below(root, r[path_col])):
                r["zip_name"] = display.claim(used, r["zip_name"])
                z.writestr(r["zip_name"], read(r[path_col]))
                n += 1
        z.writestr("manifest.json", json.dumps({"generated_at": generated_at, "total": len(found), "success": n, "failed": len(found) - n, "left_out": total - len(found), "results": found}, ensure_ascii=False, default=str))
        z.writestr("manifest.txt", "\n".join(f"{'✓' if r['status'] == 'ok' else '✗'} 第{r['row']}行 | 查询：{r['query']} | {r['std_id'] or '-'} | {r['status']}" for r in found))
    return n


def below(root: str, path: str) -> bool:
    """Whether a path, once its dots are followed, lies below the root."""
    base = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(base, path.replace("\\", "/")))
    return full.startswith(base.rstrip("/") + "/")


def annotated_text(sheet: DataFrame, remarks: DataFrame, remark_header: str = "备注") -> str:
    """The uploaded rows (row, cells) with each row's remark (row, remark) in the remark column, or in a new last one, as the text of a CSV file. An upload has a bounded
    number of bytes, so the driver may hold it."""
    named = {r["row"]: r["remark"] for r in remarks.collect()}
    rows = [(r["row"], list(r["cells"])) for r in sheet.orderBy("row").collect()]
    at = next((i for _, cells in rows[:25] for i, c in enumerate(cells) if remark_header in c), None)
    head = next((row for row, cells in rows[:25] if at is not None and len(cells) > at and remark_header in cells[at]), rows[0][0] if rows else None)
    place = at if at is not None else max((len(c) for _, c in rows), default=0)
    text = io.StringIO(newline="")
    out = csv.writer(text)
    for row, cells in rows:
        cells += [""] * (place + 1 - len(cells))
        cells[place] = remark_header if row == head and at is None else cells[place] if named.get(row) is None else named[row]
        out.writerow(cells)
    return text.getvalue()


def annotated_csv(sheet: DataFrame, remarks: DataFrame, target: str, remark_header: str = "备注") -> None:
    """``annotated_text`` as a file with a byte order mark."""
    with open(target, "w", encoding="utf-8-sig", newline="") as f:
        f.write(annotated_text(sheet, remarks, remark_header))
