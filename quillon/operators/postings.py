"""Full text from an inverted table on disk: one row for each place of a token.

The table is ranged and sorted by token, so that a token or a beginning of one reaches the scan as a pushed range and reads only the row groups and pages that
hold it. Ranges are cut by token and id, so a token in a third of all texts is spread over as many files as it needs. A phrase is found by one
scan and one aggregation: each place says where the phrase would begin, and where all parts agree it does.

Matching is that of ``catalog.full_text``: any word of the text, whose tokens follow each other in a field, the last one as a beginning.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import catalog

PLACE = ("token", "field", "id", "pos")
#: Bytes of text whose postings a file holds.
PER_FILE = 8_000_000


def of(files: DataFrame, id_col: str = "id", fields: tuple[str, ...] = catalog.FIELDS) -> DataFrame:
    """(token, field, id, pos) of every token of every field; a null or empty field has none, nor has a row with a null id."""
    known = files.filter(F.col(id_col).isNotNull())
    each = [F.struct(F.lit(f).alias("field"), catalog.tokens(F.coalesce(F.col(f), F.lit(""))).alias("tokens")) for f in fields]
    spread = known.select(F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("f"))
    return spread.select("id", F.col("f.field").alias("field"), F.posexplode("f.tokens").alias("pos", "token")).select(*PLACE)


def files_of(files: DataFrame, fields: tuple[str, ...] = catalog.FIELDS) -> int:
    """Into how many files to write the postings of these rows: it follows the bytes of their fields, so that what a task sorts does not grow with the table."""
    size = sum((F.coalesce(F.octet_length(f).cast("long"), F.lit(0)) for f in fields), F.lit(0))
    return max(1, -(-(files.agg(F.sum(size).alias("n")).first()["n"] or 0) // PER_FILE))


def write(postings: DataFrame, path: str, files: int | None = None) -> None:
    """In ranges of token and id, sorted."""
    by = ("token", "id")
    ranged = postings.repartitionByRange(files, *by) if files else postings.repartitionByRange(*by)
    ranged.sortWithinPartitions(*PLACE).write.mode("overwrite").parquet(path)


def _is(part: str, last: bool) -> Column:
    return F.col("token").startswith(part) if last else F.col("token") == part


def matching(postings: DataFrame, text: str, *extra: str) -> DataFrame:
    """Ids, once each with the ``extra`` columns of their postings, of which a field holds any word's phrase. A text without tokens matches none."""
    phrases = catalog.search_terms(text)
    if not phrases:
        return postings.select("id", *extra).limit(0)
    alone = sorted({p[0] for p in phrases if len(p) == 1})
    joined = [p for p in phrases if len(p) > 1]
    out = None
    if alone:
        out = postings.filter(reduce(or_, [_is(t, True) for t in alone])).select("id", *extra)
    if joined:
        parts = [(n, k, _is(t, k == len(p) - 1)) for n, p in enumerate(joined) for k, t in enumerate(p)]
        met = postings.filter(reduce(or_, [m for _, _, m in parts]))
        begins = F.array(*[F.when(m, F.struct(F.lit(n).alias("phrase"), (F.col("pos") - k).alias("begin"))) for n, k, m in parts])
        lengths = F.element_at(F.array(*[F.lit(len(p)) for p in joined]), F.col("at.phrase") + 1)
        places = met.select("id", "field", *extra, F.explode(F.filter(begins, lambda b: b.isNotNull())).alias("at"))
        whole = places.groupBy("id", "field", "at", *extra).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == lengths).select("id", *extra)
        out = whole if out is None else out.unionByName(whole)
    return out.distinct()


def search(files: DataFrame, postings: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """Rows of ``files`` whose fields hold any word's phrase; a blank text matches all."""
    if not (text or "").strip():
        return files
    ids = matching(postings, text).withColumnRenamed("id", "__id")
    return files.join(ids, files[id_col] == ids["__id"], "left_semi")
