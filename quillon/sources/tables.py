"""Tables of the model from whichever source is there: a database, index files, a dump."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database's table. Filters, columns, limits and sums go to the database; with a numeric ``key`` the rows are read in ``parts`` ranges of it, at once."""
    read = spark.read.format("jdbc").options(url=url, dbtable=table, pushDownAggregate="true", pushDownLimit="true", **options)
    if key is None:
        return read.load()
    bounds = read.load().selectExpr(f"min({key}) as low", f"max({key}) as high").first()
    if bounds["low"] is None or bounds["low"] == bounds["high"]:
        return read.load()
    return read.options(partitionColumn=key, lowerBound=str(bounds["low"]), upperBound=str(bounds["high"] + 1), numPartitions=str(parts)).load()


def first_ready(*sources: tuple[str, Callable[[], DataFrame]]) -> tuple[str, DataFrame]:
    """Name and table of the first source that can be read; sources are asked in their order for their columns alone. None ready: an error that says why, of each."""
    failed = []
    for name, source in sources:
        try:
            df = source()
            df.schema  # noqa: B018 - a plan is resolved where its columns are asked for
            return name, df
        except (PySparkException, OSError, ValueError) as e:
            failed.append(f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        except Exception as e:  # what a database driver raises comes as the JVM's own error
            if type(e).__module__.split(".")[0] not in ("py4j", "pyspark"):
                raise
            failed.append(f"{name}: {type(e).__name__}")
    raise ValueError("no source is ready: " + "; ".join(failed))
