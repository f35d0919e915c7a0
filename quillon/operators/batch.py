"""Uploaded lists: finding columns and rows, and reconciling the codes with the catalogue in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import codes, display
from quillon.operators import files as found
from quillon.session import kept

MOST_ROWS, HEADER_ROWS, CODE_ROWS = 400, 25, 40
# How uploads name their columns, and what a code in a cell looks like.
CODE_HEADERS = ("标准编号", "标准号", "编号", "std_id", "stdid", "标准代码", "标准代号", "标准文号")
NAME_HEADERS = ("标准名称", "名称", "标准名", "title", "中文名称", "标准中文名称", "名称关键词")
REMARK_HEADERS = ("备注", "说明", "remark", "note")
HEADER_PARTS = {"std": ("标准号", "编号", "std"), "name": ("名称", "title"), "remark": ("备注",)}
CODE_PREFIX = r"(?i)^(?:GB/?T?|GB/Z|GB|GJB/?T?|DL/?T?|DL|JB/?T?|JB|JJF|JJG|HG/?T?|NY/?T?|SH/?T?|SY/?T?|ISO|IEC|ASTM|EN|Q(?:/|[\s/]))"
TITLE_WORDS = ("明细表", "标准清单")


def looks_like_number(x: Column) -> Column:
    """A cell that holds a code, by prefix, by brackets, or by digits beside letters or separators."""
    s = codes.strip(F.coalesce(x, F.lit("")))
    dense = F.regexp_replace(s, f"{codes.SPACE}+", "")
    told = s.rlike(CODE_PREFIX) | s.startswith("国网") | s.startswith("Q/") | (s.rlike(r"[(（][^)）]+[)）]") & s.rlike("[0-9]"))
    return (F.length(s) >= 3) & (told | (dense.rlike("[0-9]{2,}") & dense.rlike(r"[A-Za-z/（）()—／-]")))


def skipped(x: Column) -> Column:
    """Rows of an upload that are no request: blank, short numbers, titles, or nothing like a code."""
    s = codes.strip(F.coalesce(x, F.lit("")))
    return (s == "") | s.rlike("^[0-9]{1,4}$") | s.contains(TITLE_WORDS[0]) | s.contains(TITLE_WORDS[1]) | ~looks_like_number(s)


def _role(cell: Column, headers: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    h = F.lower(F.regexp_replace(F.coalesce(cell, F.lit("")), f"{codes.SPACE}+", ""))
    out = h.isin(*[x.lower() for x in headers])
    for p in parts:
        out = out | h.contains(p)
    return (h != "") & out


def column_roles(rows: DataFrame) -> DataFrame:
    """Of each row (row, cells) the last cell's place that names codes, names or remarks, null if none."""
    cells = rows.select("row", F.posexplode("cells").alias("pos", "cell"))
    roles = {"std": CODE_HEADERS, "name": NAME_HEADERS, "remark": REMARK_HEADERS}
    return cells.groupBy("row").agg(*[F.max(F.when(_role(F.col("cell"), h, HEADER_PARTS[r]), F.col("pos"))).alias(f"{r}_col") for r, h in roles.items()])


def layout(rows: DataFrame) -> DataFrame:
    """Where the requests of an upload (row from 0, cells) lie: one row with start, header_row (from 1, null without one), std_col, name_col and
    remark_col, or no row where no cell looks like a code.

    The header is the first of 25 rows that names a code column; without one, the first code-like cell of 40 rows tells the
    column and its row is the first of the data.
    """
    named = column_roles(rows.filter(F.col("row") < HEADER_ROWS)).filter("std_col is not null")
    header = named.select(F.lit(0).alias("o"), (F.col("row") + 1).alias("start"), (F.col("row") + 1).alias("header_row"), "std_col", "name_col", "remark_col")
    cell = rows.filter(F.col("row") < CODE_ROWS).select("row", F.posexplode("cells").alias("pos", "cell")).filter(looks_like_number(F.col("cell")))
    none = F.lit(None).cast("int")
    guess = cell.select(F.lit(1).alias("o"), F.col("row").alias("start"), none.cast("long").alias("header_row"), F.col("pos").alias("std_col"), none.alias("name_col"), none.alias("remark_col"))
    return header.union(guess).orderBy("o", "start", "std_col").limit(1).drop("o")


def requests(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """row (from 1), query and name_hint of an upload given as row (from 0) and cells, where ``layout`` finds them; none without one.
    The limit is the feature: an upload may ask so many."""
    at = layout(rows).select(F.struct("start", "std_col", "name_col")).scalar()
    query = codes.strip(F.coalesce(F.get("cells", F.col("at.std_col")), F.lit("")))
    name = F.coalesce(F.get("cells", F.col("at.name_col")), F.lit(""))
    asked = rows.withColumn("at", at).filter(F.col("row") >= F.col("at.start")).select((F.col("row") + 1).alias("row"), query.alias("query"), name.alias("name_hint"))
    return asked.filter(~skipped(F.col("query"))).orderBy("row").limit(most)


def _blank() -> Column:
    return codes.strip(F.coalesce(F.col("query"), F.lit(""))) == ""


def standard_of(asked: DataFrame, base: DataFrame) -> DataFrame:
    """row, base_id and std_id of the standard that each request (row, query) names; requests that name none have no row."""
    return with_standard(asked, base).filter("std_id is not null").select("row", "base_id", "std_id")


def with_standard(asked: DataFrame, base: DataFrame) -> DataFrame:
    """Requests (row, query) with base_id and std_id of the standard that each names, or nulls. They are kept in the shared folder.

    All spellings of a code have one compact key, by which requests and standards meet in one equi join with a row a key. Where a key belongs to one standard, that
    is it. Only where it belongs to several are the spellings worked out: of these the one of the better tier (a spelling of the code, then its normal key,
    then its compact key), then of the smaller id, is taken.
    """
    known = base.select("id", "std_id", "std_id_norm", codes.compact_key(F.col("std_id")).alias("c")).filter("c is not null")
    one = known.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "std_id")).alias("first"))
    met = asked.select("row", "query", F.when(~_blank(), codes.compact_key(F.col("query"))).alias("c")).join(one, "c", "left")
    rival = F.col("n") > 1
    told = kept(met.select("row", "query", F.when(rival, F.col("c")).alias("c"), F.when(~rival, F.col("first.id")).alias("base_id"), F.when(~rival, F.col("first.std_id")).alias("std_id")), "requests")

    several = kept(told.filter("c is not null").select("row", "query", "c"), "rivals")
    asks = several.select("query", "c").distinct()
    rivals = known.join(asks.select("c").distinct(), "c", "left_semi").groupBy("c", "std_id", "std_id_norm").agg(F.min("id").alias("id"))
    spelt = lambda vs: F.array_contains(vs, F.col("std_id")) | F.coalesce(F.array_contains(F.transform(vs, codes.norm_key), F.col("std_id_norm")), F.lit(False))
    tier = F.when(codes.let(codes.lookup_variants(F.col("query")), spelt), 0).when(F.col("std_id_norm") == codes.norm_key(F.col("query")), 1).otherwise(2)
    best = asks.join(rivals, "c").groupBy("query").agg(F.min(F.struct(tier.alias("tier"), "id", "std_id")).alias("best"))
    picked = several.join(best, "query").select("row", "query", F.col("best.id").alias("base_id"), F.col("best.std_id").alias("std_id"))
    return told.filter("c is null").drop("c").unionByName(picked)


def reconciled(asked: DataFrame, base: DataFrame, files: DataFrame) -> DataFrame:
    """One row a request (row, query): the standard it names, its first file in the catalogue, and a status. What lies on disk is not asked."""
    told = with_standard(asked, base)
    first = files.join(told.select("base_id").distinct(), "base_id", "left_semi").groupBy("base_id").agg(F.min(F.struct("file_name", "id")).alias("f")).select("base_id", F.col("f.file_name").alias("file_name"))
    out = _where(told, "base_id", first)
    status = F.when(_blank(), "empty").when(F.col("base_id").isNull(), "not_found").when(F.col("file_name").isNull(), "no_pdf").otherwise("ok")
    named = out.withColumn("status", status)
    return named.select("row", "query", "status", "base_id", "std_id", "file_name", F.when(F.col("status") == "ok", display.safe_name(F.col("std_id"), F.col("file_name"))).alias("zip_name"))


def _where(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """A left join by a key that many rows lack: those stay where they are, so that they do not meet in one task."""
    return rows.filter(F.col(key).isNotNull()).join(found, key, "left").unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def served(asked: DataFrame, base: DataFrame, files: DataFrame, listing: DataFrame) -> DataFrame:
    """One row a request (row, query): the standard it names, the path that serves it, where that comes from, and a status.

    ``source`` is index for a file of the catalogue that the listing (path) has, by path or by name, the first by name; disk for a listed file
    whose name holds the standard's code, where the catalogue's files are missing; disk_only for one whose name holds the code asked for, where no
    standard is known. The names of the listing are taken apart once for both. Requests with their standards, and then with their files of the catalogue, are kept in
    the shared folder.
    """
    told = with_standard(asked, base)
    own = found.first_served(told.filter("base_id is not null").select(F.col("base_id").alias("id")).distinct(), files, listing).select(F.col("id").alias("base_id"), "path")
    key = F.when(F.col("path").isNull() & ~_blank(), found.code_key(F.coalesce("std_id", codes.strip(F.col("query")))))
    out = kept(_where(told, "base_id", own).withColumn("code_key", key), "served")
    other = found.held(out.filter("code_key is not null").select("code_key"), listing, 1).withColumnRenamed("path", "other")
    out = _where(out, "code_key", other)
    known, hit = F.col("base_id").isNotNull(), F.col("other").isNotNull()
    source = F.when(F.col("path").isNotNull(), "index").when(hit & known, "disk").when(hit, "disk_only")
    out = out.withColumns({"source": source, "path": F.coalesce("path", "other"), "std_id": F.coalesce("std_id", F.when(hit, codes.strip(F.col("query"))))})
    status = F.when(_blank(), "empty").when(F.col("path").isNotNull(), "ok").when(~known, "not_found").otherwise("no_pdf")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return out.select("row", "query", status.alias("status"), "source", "base_id", "std_id", "path", name.alias("file_name"), F.when(F.col("path").isNotNull(), display.safe_name(F.col("std_id"), name)).alias("zip_name"))


def summary(results: DataFrame) -> DataFrame:
    """One row: total, success, failed."""
    ok = F.count_if(F.col("status") == "ok")
    return results.agg(F.count(F.lit(1)).alias("total"), ok.alias("success"), (F.count(F.lit(1)) - ok).alias("failed"))


def misses(asked: DataFrame, results: DataFrame) -> DataFrame:
    """Requests without a standard."""
    return asked.join(results.filter("base_id is not null").select("row"), "row", "left_anti")


def annotated(rows: DataFrame, results: DataFrame) -> DataFrame:
    """All rows of an upload with a remark: empty where a file was found, 否 where a request failed, null for no request."""
    remark = F.when(F.col("status") == "ok", "").when(F.col("status").isNotNull(), "否")
    done = results.select(F.col("row").alias("__row"), "status")
    return rows.join(done, rows["row"] + 1 == done["__row"], "left").withColumn("remark", remark).drop("__row", "status")


def manifest_lines(results: DataFrame) -> DataFrame:
    """A line a request for the bundle's text manifest."""
    mark = F.when(F.col("status") == "ok", "✓").otherwise("✗")
    line = F.concat_ws(" | ", F.concat(mark, F.lit(" 第"), F.col("row").cast("string"), F.lit("行")), F.concat(F.lit("查询："), "query"), F.coalesce("std_id", F.lit("-")), F.col("status"))
    return results.select("row", line.alias("value"))
