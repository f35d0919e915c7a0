"""Rows of INSERT statements in a SQL dump, read statement by statement in parallel.

The text reader cuts a file where statements end, a semicolon at the end of a line, so a statement may lie on many lines and a file is read by as many tasks as it
has splits. Dumps write line ends within strings as escapes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import codes
from quillon.schemas import DUMP_FIELDS

#: A piece of a tuple list: a quoted string (with backslash escapes and doubled quotes), or one other character.
_PIECE = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([(),])|([^'(),]+)", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)|''", re.DOTALL)


def tuples(values: str) -> Iterator[list[str | None]]:
    """Fields of each tuple in a VALUES list. A field that reads NULL, quoted or not, is null; brackets in a tuple nest."""
    depth, field, row = 0, "", []
    for m in _PIECE.finditer(values):
        quoted, mark, plain = m[1], m[2], m[3]
        if quoted is not None:
            field += _ESCAPE.sub(lambda e: e[1] or "'", quoted)
        elif plain is not None:
            field += plain if depth else ""
        elif mark == "(" and depth == 0:
            depth, field, row = 1, "", []
        elif mark == ")" and depth == 1:
            row.append(field)
            yield [None if f.strip().upper() == "NULL" else f.strip() for f in row]
            depth = 0
        elif mark == "," and depth == 1:
            row.append(field)
            field = ""
        elif depth:
            depth += {"(": 1, ")": -1, ",": 0}[mark]
            field += mark


def statement_end(spark: SparkSession, path: str) -> str:
    """What ends a statement in the files at ``path``: a semicolon and a line end of the kind that their first lines have."""
    first = spark.read.option("lineSep", "\n").text(path).filter("value <> ''").limit(1).collect()
    return ";\r\n" if first and first[0]["value"].endswith("\r") else ";\n"


def rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(file, line, place, fields) of the table's INSERT statements, named and positional ones alike; ``line`` orders statements. A path with files of both kinds of line ends
    is to be read kind by kind."""
    start = re.compile(rf"INSERT INTO `{re.escape(table)}`\s*(?:\([^)]+\)\s*)?VALUES\s*", re.IGNORECASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, line, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if m := start.search(value):
                    out += [(name, line, i, fields) for i, fields in enumerate(tuples(value[m.end() :]))]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["file", "line", "place", "fields"])

    lines = spark.read.option("lineSep", statement_end(spark, path)).text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return lines.filter(F.col("value").contains(f"`{table}`")).mapInArrow(run, "file string, line long, place long, fields array<string>")


def table_of(parsed: DataFrame, table: str, types: dict[str, str] | None = None) -> DataFrame:
    """The model's columns by position; tuples with too few fields are left out."""
    least, places = DUMP_FIELDS[table]
    typed = {"id": "bigint", "base_id": "bigint", "unit_id": "bigint", "file_size": "bigint", "ex_state": "int", "role_type": "int", "rank_order": "int", "level": "int"} | (types or {})
    out = parsed.filter(F.size("fields") >= least)
    return out.select("file", "line", "place", *[F.get("fields", F.lit(i)).try_cast(typed.get(c, "string")).alias(c) for c, i in places.items()])


def upserted(rows_of: DataFrame, key: str) -> DataFrame:
    """The last row of each key, in the order of the dump."""
    last = Window.partitionBy(key).orderBy(F.col("file").desc(), F.col("line").desc(), F.col("place").desc())
    return rows_of.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "file", "line", "place")


def standards(spark: SparkSession, path: str) -> DataFrame:
    """The standards table with its keys; a repeated id or code is an error of the dump and raises."""
    out = table_of(rows(spark, path, "std_base"), "std_base").drop("file", "line", "place").withColumn("std_id", F.coalesce("std_id", F.lit("")))
    both = out.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("id", "std_id")])).alias("k")).groupBy("k").count()
    repeated = both.filter("count > 1").select("k.*").limit(1).collect()
    if repeated:
        raise ValueError(f"the dump repeats {repeated[0]['key']} {repeated[0]['value']}")
    return out.withColumns({"std_id_norm": codes.norm_key(F.col("std_id")), "std_id_compact": codes.stored_compact(F.col("std_id"))})
