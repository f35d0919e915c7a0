"""Session with the settings the engine is tested under; a cluster's own settings win."""

from __future__ import annotations

import os
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quillon", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` takes further settings, dots written as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Tell the Python workers of a session that was started elsewhere where this package lies."""
    environment = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parents[1])
    if home not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH", ""), home]))


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as they were written to the shared folder, so that what depends on chance, as ranges do, is the same at every reading."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the session's ``spark.checkpoint.dir``. Where none is set, a session on one machine (tests) gets one under
    its warehouse; on a cluster, where that may be a disk of each machine, this is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")
