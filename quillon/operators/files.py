"""Inventories of files and their resolution against the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import codes
from quillon.operators.containment import HELD, contained, holders
from quillon.session import kept as written
from quillon.sinks import snapshots

#: Seconds for which a kept inventory is taken as it is.
TTL = 1800


def dedupe_key(path: Column, rel: Column, name: Column, file_id: Column) -> Column:
    """The first that is known of path, name below a root, and id."""
    lower = lambda tag, x: F.concat(F.lit(tag), F.lower(F.nullif(x, F.lit(""))))
    return F.coalesce(lower("path:", path), lower("rel:", rel), lower("name:", name), F.concat(F.lit("id:"), file_id.cast("string")))


def first_of(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the order. Each task keeps only its own first rows before the exchange (a group limit), so a hot key is no burden."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def inventory(*listings: DataFrame) -> DataFrame:
    """Listings of several roots as one; a path, without regard to case, once, from the earliest root."""
    tagged = [df.withColumn("root", F.lit(n)) for n, df in enumerate(listings)]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    return first_of(every, F.lower("path"), F.col("root"), F.col("path"))


def cached_inventory(spark: SparkSession, folder: str, listings: Callable[[], list[DataFrame]], now: int, ttl: int = TTL) -> DataFrame:
    """The inventory as it was kept at ``folder``, unless it is older than ``ttl`` seconds at the time ``now``: then, and where there is none, ``listings`` is asked,
    and what it gives is kept in its place. While it is fresh, nothing is listed."""
    kept = snapshots.current(spark, folder)
    if kept is None or now - kept.notes["listed_at"] > ttl:
        kept = snapshots.replace(inventory(*listings()).withColumn(snapshots.BUCKET, F.lit("all")), folder, None, {"listed_at": now}, kept)
    return snapshots.rows(spark, folder, kept)


def roots(spark: SparkSession, named: str | None, candidates: list[str], otherwise: str) -> str:
    """The root that is named; else the first candidate that is there; else the last resort."""
    if named and named.strip():
        return named.strip()
    return next((c for c in candidates if snapshots.exists(spark, c)), otherwise)


def _first_path(listing: DataFrame) -> Column:
    """Smallest: the path of the earliest root, where the listing tells roots apart, then the first by name."""
    return F.min(F.struct(F.col("root") if "root" in listing.columns else F.lit(0).alias("root"), F.col("path"))).getField("path")


def by_name(names: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows with a file name, and the first path of that name, without regard to case; a path of an earlier root goes before others."""
    first = listing.groupBy(F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).alias("__name")).agg(_first_path(listing).alias("path"))
    return names.join(first, F.lower(names["file_name"]) == F.col("__name"), "left").drop("__name")


def code_key(code: Column) -> Column:
    """What of a code is looked for in names; null for codes of under four characters, which find none."""
    key = codes.compact_key(code)
    return F.when(F.length(key) >= 4, key)


def held(keys: DataFrame, listing: DataFrame, most: int) -> DataFrame:
    """Each distinct key of the one column and the paths (path) whose name holds it, the first ``most`` by path."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    stem = F.regexp_replace(F.upper(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")), "_[FTZX]_", "_")
    met = holders(keys, listing.select("path", codes.compact_key(stem).alias("name_key")), "name_key").select(F.col(HELD).alias(keys.columns[0]), "path")
    return met.withColumn("__n", F.row_number().over(Window.partitionBy(keys.columns[0]).orderBy("path"))).filter(F.col("__n") <= most).drop("__n")


def holding_code(standards: DataFrame, listing: DataFrame, most: int = 10) -> DataFrame:
    """Standards and the paths whose name holds their code, the first ``most`` by path. Codes of under four characters find none."""
    asked = written(standards.select("id", code_key(F.col("std_id")).alias("code_key")).filter("code_key is not null"), "asked")
    met = asked.join(held(asked.select("code_key"), listing, most), "code_key").select("id", "path")
    return met.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("path"))).filter(F.col("n") <= most)


def fuzzy(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Best PDF of each query: equal keys, then one key holding the other, then the file's core holding the query's; first by ord.

    ``queries`` has row and query, ``names`` has ord and file_name. A core is what remains of letters A to Z, digits, slashes and hyphens; the
    query's must have four of them. Empty keys meet nothing, so neither a blank query nor a file named ".pdf" finds a partner. Equal keys, of which there may be
    very many, meet as one.
    """
    pdf = r"(?i)\.pdf$"
    core = lambda x: F.regexp_replace(x, "[^A-Z0-9/-]", "")
    keyed = queries.select("row", _file_key(F.col("query")).alias("q")).filter("q <> ''")
    first = lambda df, key: df.groupBy(key).agg(F.min("file").alias("file"))
    n = first(names.filter(F.col("file_name").rlike(pdf)).select(F.struct("ord", "file_name").alias("file"), _file_key(F.regexp_replace("file_name", pdf, "")).alias("k")).filter("k <> ''"), "k")
    q = keyed.select("q").distinct()
    core_q, core_n = q.select("q", core(F.col("q")).alias("c")).filter(F.length("c") >= 4), first(n.select(core(F.col("k")).alias("c2"), "file"), "c2")
    tier = lambda df, t: df.select("q", F.struct(F.lit(t).alias("tier"), "file.*").alias("best"))
    every = tier(q.join(n, q["q"] == n["k"]), 0).union(tier(contained(q, "q", n, "k"), 1)).union(tier(contained(n, "k", q, "q"), 1)).union(tier(contained(core_q, "c", core_n, "c2"), 2))
    best = every.groupBy("q").agg(F.min("best").alias("best"))
    return keyed.join(best, "q").select("row", "best.*")


def _file_key(x: Column) -> Column:
    """Upper case without white space; full-width slashes and long dashes as plain ones."""
    return F.upper(F.translate(F.regexp_replace(x, f"{codes.SPACE}+", ""), "／—", "/-"))


def resolved(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """Requests (file_path, file_name) with the first path that serves them: by path, else by name. Earlier roots go first."""
    return _served(requests.withColumn("__asked", F.col("file_path")), listing).withColumnRenamed("__asked", "file_path")


def _served(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """``resolved`` without the path that was asked for. What is served by path is kept in the shared folder, and so is what is not: only that is looked up by name, and only
    names that it asks for are dealt out, where it is small."""
    others = [F.col(f"`{c}`") for c in requests.columns if c != "file_path"]
    paths = listing.groupBy(F.lower("path").alias("__path")).agg(_first_path(listing).alias("path"))
    met = written(requests.join(paths, F.lower(requests["file_path"]) == F.col("__path"), "left").select(*others, "path"), "by-path")
    rest = written(met.filter("path is null").drop("path"), "by-name")
    names = rest.select(F.lower("file_name").alias("__asked_name")).distinct()
    few = listing.join(names, F.lower(F.regexp_extract("path", r"([^/]*)$", 1)) == F.col("__asked_name"), "left_semi")
    return met.filter("path is not null").unionByName(by_name(rest, few))


def collected(standards: DataFrame, files: DataFrame, listing: DataFrame, most: int = 10) -> DataFrame:
    """Files of each standard: those of its own rows that the listing serves; only where there are none, those whose name holds its code. The former are kept in the shared
    folder, since the latter are looked for while the query is built."""
    found = _served(files.select(F.col("base_id").alias("id"), "file_path", "file_name"), listing).filter(F.col("path").isNotNull()).select("id", "path")
    own = written(found.join(standards.select("id"), "id", "left_semi").dropDuplicates(["id", "path"]), "own")
    without = standards.join(own.select("id").distinct(), "id", "left_anti")
    other = holding_code(without, listing, most).select("id", "path").dropDuplicates(["id", "path"])
    return own.withColumn("source", F.lit(0)).union(other.withColumn("source", F.lit(1)))


def first_served(standards: DataFrame, files: DataFrame, listing: DataFrame) -> DataFrame:
    """id and path of each standard's first file, by name, that the listing has; standards without one have no row."""
    asked = files.join(standards.select(F.col("id").alias("base_id")), "base_id", "left_semi").select("base_id", "id", "file_path", "file_name")
    own = _served(asked, listing).filter(F.col("path").isNotNull())
    return own.groupBy(F.col("base_id").alias("id")).agg(F.min(F.struct("file_name", F.col("id").alias("file_id"), "path")).alias("p")).select("id", "p.path")


def picked(collected_files: DataFrame) -> DataFrame:
    """One file a standard: its own before a found one, then by path."""
    return collected_files.groupBy("id").agg(F.min(F.struct("source", "path")).alias("p")).select("id", "p.path", "p.source")


def shown_path(path: Column, root: str) -> Column:
    """The path below the root, else the bare name."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, F.lit(len(head) + 1), F.length(path))).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))
