"""Catalogues of files: token-prefix full-text search and what paths tell."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import codes, display
from quillon.plans.intent import Page

MOST_TOKENS, MOST_BUNDLED = 8, 100
FIELDS = ("category", "title", "filename")
# Names of the catalogue's places.
ROOT, NO_ORG, UNKNOWN_ORG = "根目录", "团标", "未知协会"


def tokens(x: Column) -> Column:
    """Runs of letters and digits, folded to lower case without marks; a run of CJK characters is one token."""
    plain = F.regexp_replace(F.lower(F.call_function("regexp_replace", x, F.lit(r"\p{Mn}+"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda t: t != "")


def with_tokens(files: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Token arrays beside the fields, to be written with the table."""
    return files.withColumns({f"{f}_tokens": tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields})


def _phrase(column: str, parts: list[str]) -> Column:
    """The parts follow each other in a field; the last one may be a beginning."""
    have, n = F.col(f"{column}_tokens"), len(parts)
    if n == 1:
        return F.exists(have, lambda t: t.startswith(parts[0]))

    def follows(ts: Column) -> Column:
        at = lambda i: reduce(lambda a, b: a & b, [F.get(ts, i + k) == p for k, p in enumerate(parts[:-1])]) & F.get(ts, i + n - 1).startswith(parts[-1])
        return F.when(F.size(ts) >= n, F.exists(F.sequence(F.lit(0), F.size(ts) - n), lambda i: F.coalesce(at(i), F.lit(False)))).otherwise(False)

    return codes.let(have, follows)


def search_terms(text: str) -> list[list[str]]:
    """Each of the first eight words as the tokens of a phrase; words of separators alone ask nothing."""
    import re

    out = [re.findall(r"[^\W_]+", w.lower()) for w in (text or "").split()[:MOST_TOKENS]]
    return [p for p in out if p]


def full_text(files: DataFrame, text: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows in which any word's phrase begins somewhere in a field; a blank text matches all."""
    if not (text or "").strip():
        return files
    terms = search_terms(text)
    if not terms:
        return files.limit(0)
    return files.filter(reduce(or_, [_phrase(f, p) for p in terms for f in fields]))


def page(files: DataFrame, text: str, at: Page = Page(), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return full_text(files, text, fields).orderBy("category", "title", "id").offset(at.offset).limit(at.limit)


def file_parts(path: Column) -> dict[str, Column]:
    """filename, stem, file_ext and parent of a relative path."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return {
        "filename": name,
        "stem": F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""),
        "file_ext": F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1)),
        "parent": F.regexp_extract(path, r"^(.*)/[^/]*$", 1),
    }


def by_folder(listing: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """Category is the folder, title the stem."""
    p = file_parts(F.col(path_col))
    return listing.withColumns({"filename": p["filename"], "category": F.coalesce(F.nullif(p["parent"], F.lit("")), F.lit(ROOT)), "title": F.coalesce(F.nullif(codes.strip(p["stem"]), F.lit("")), p["filename"]), "file_ext": p["file_ext"]})


def by_organisation(listing: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """Category is the organisation before the first underscore of the stem, title what follows."""
    p = file_parts(F.col(path_col))
    split = p["stem"].contains("_")
    org, title = codes.strip(F.substring_index(p["stem"], "_", 1)), codes.strip(F.regexp_extract(p["stem"], r"^[^_]*_(.*)$", 1))
    return listing.withColumns({
        "filename": p["filename"],
        "category": F.when(split, F.coalesce(F.nullif(org, F.lit("")), F.lit(UNKNOWN_ORG))).otherwise(NO_ORG),
        "title": F.when(split, F.coalesce(F.nullif(title, F.lit("")), p["stem"])).otherwise(p["stem"]),
        "file_ext": p["file_ext"],
    })


def with_label(files: DataFrame) -> DataFrame:
    return files.withColumn("label", display.file_badge(F.col("file_ext")))


def items(files: DataFrame, name: str) -> DataFrame:
    """Catalogue rows (id, category, title, filename, rel_path, file_size, file_ext) as search results show them, with their one file nested."""
    ext = F.lower(F.coalesce("file_ext", F.lit("")))
    bare = F.nullif(F.ltrim(F.upper(ext), F.lit(".")), F.lit(""))
    label = F.when(ext == ".pdf", "PDF").when(ext.isin(".doc", ".docx"), "DOC").otherwise(F.coalesce(bare, F.lit("文件")))
    file = F.struct("id", F.col("filename").alias("file_name"), F.col("rel_path").alias("file_path"), "file_size", ext.alias("file_ext"))
    return files.select(
        "id", F.coalesce(F.nullif("category", F.lit("")), F.lit("—")).alias("std_id"), F.coalesce(F.nullif("title", F.lit("")), "filename").alias("std_chinesename"),
        F.lit(name).alias("std_type"), label.alias("std_status"), (ext == ".pdf").alias("has_pdf"), F.lit(True).alias("has_file"), F.array(file).alias("files"),
    )


def bundle_entries(files: DataFrame, ids: list[int], most: int = MOST_BUNDLED) -> DataFrame:
    """One row for each id asked for: its place (from 1), ok or not_found, and its name in a bundle, in a folder by its extension.

    Ids that are repeated or not positive are left out; the limit is the feature.
    """
    wanted = list(dict.fromkeys(i for i in ids if i > 0))[:most]
    listed = F.array(*[F.lit(i).cast("long") for i in wanted]).cast("array<bigint>")
    asked = files.sparkSession.sql("SELECT 1").select(F.posexplode(listed).alias("pos", "id")).select((F.col("pos") + 1).alias("place"), "id")
    known = files.filter(F.col("id").isin(wanted)).select(F.col("id").alias("__id"), "filename", F.lower("file_ext").alias("__ext"))
    folder = F.when(F.col("__ext") == ".pdf", "PDF").otherwise("文件")
    found = F.col("__id").isNotNull()
    entry = F.when(found, F.concat(folder, F.lit("/"), F.lpad(F.col("place").cast("string"), F.greatest(F.lit(3), F.length(F.col("place").cast("string"))), F.lit("0")), F.lit("_"), F.col("filename")))
    return asked.join(known, asked["id"] == known["__id"], "left").select("place", "id", F.when(found, "ok").otherwise("not_found").alias("status"), entry.alias("zip_entry"))
