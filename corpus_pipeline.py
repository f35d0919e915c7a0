"""Preparation of a training corpus in stages; each reads what the one before it kept.

Counted as part of the llm subpackage. A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, near_copies, packing, pii, quality
from quillon.llm.common import shared_folder, ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts, and short ones, fail the base rules; repeated rows share a verdict; very long texts are measured
    whole; an empty table stays empty."""
    ship(spark)
    return quality.keep_quality(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts stays, of wholly repeated rows one too. Null, empty and white texts are one class; null ids come last; an empty table
    stays empty."""
    ship(spark)
    return exact_dedup.exact_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (shingles of five words, Jaccard similarity 0.8 or more) stays, the one
    with the smallest id; null ids come last. Texts without words are one class; rows that repeat id and text stay once; an empty table stays empty."""
    ship(spark)
    return near_copies.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows. Null texts stay null, empty ones empty; all rows stay, repeated ones too; very long texts are searched
    whole, in windows; an empty table stays empty."""
    ship(spark)
    out = pii.redacted(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with the columns of op1_packing, and their ids. A null or empty text is its end token alone; a very long one is cut into pieces; an empty
    table has no pieces."""
    ship(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]

#: Tokenising, SimHash components and the trained tagger are not expressible in SQL; the tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder as Parquet and read again.

    Rows of any content pass through the stages that keep them: a null or repeated id loses no other row, null and empty texts fail the quality
    rules, wholly repeated rows are exact copies of each other, columns of any name pass up to the last stage. An empty table
    gives an empty result. With a ``folder`` of its own a run that was broken off starts again after the last stage that it finished.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or f"{shared_folder(spark)}/corpus_pipeline-{uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        if n == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        if not _finished(spark, f"{folder}/{n}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed, by the mark that it leaves."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
