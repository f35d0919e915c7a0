"""Search over the standards table: matching, filters, ranking, paging.

Conditions on other tables are semi joins (left semi, or an existence flag where the condition stands in a disjunction),
so rows stay unique by id and no distinct is needed. A page is a top-k: each task keeps its first rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import codes
from quillon.plans import intent as I
from quillon.plans.intent import Filters, Intent, Page

MOST_CODES, MOST_WORDS, MOST_KEYWORDS = 3, 4, 24


def with_keys(base: DataFrame) -> DataFrame:
    """Standards with both keys of their code, computed once where the table is written."""
    return base.withColumns({"std_id_norm": codes.norm_key(F.col("std_id")), "std_id_compact": codes.stored_compact(F.col("std_id"))})


def having_file(base: DataFrame, files: DataFrame, folder: str | None = None) -> DataFrame:
    """Standards with a file, in a folder if one is named."""
    if folder:
        files = files.filter(codes.like(F.col("file_path"), f"%{folder}%"))
    return base.join(files.select(F.col("base_id").alias("id")), "id", "left_semi")


def with_file_flag(base: DataFrame, files: DataFrame, name: str = "has_pdf") -> DataFrame:
    """Standards with a flag that tells whether they have a file."""
    ids = files.select(F.col("base_id").alias("__base")).distinct()
    return base.join(ids, base["id"] == ids["__base"], "left").withColumn(name, F.col("__base").isNotNull()).drop("__base")


def _asks_latin(word: str) -> bool:
    return any(c.isalnum() and not "一" <= c <= "鿿" for c in word)


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def matching(base: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """Standards that match a search text by code, name or a file's name. An empty text matches all."""
    ask = I.parse(text)
    if not (text or "").strip():
        return base
    conditions: list[Column] = []
    for code in (ask.codes or ((ask.cleaned,) if I.looks_like_code(ask.cleaned) else ()))[:MOST_CODES]:
        for key in dict.fromkeys((I.norm_key(code), I.compact_key(code))):
            conditions.append(codes.begins(F.col("std_id_norm"), key))
    words = ask.words or ((ask.cleaned,) if ask.cleaned and not I.looks_like_code(ask.cleaned) else ())
    words = words[:MOST_WORDS] if conditions or words else (ask.cleaned or text,)
    latin = [w for w in words if _asks_latin(w)]
    conditions += [codes.like(F.col("std_chinesename"), I.like_pattern(w)) for w in words]
    conditions += [codes.like(F.upper("std_id"), f"%{w.upper()}%") for w in latin]
    if not latin:
        return base.filter(_any(conditions))
    named = files.filter(_any([codes.like(F.upper("file_name"), f"%{w.upper()}%") for w in latin])).select(F.col("base_id").alias("__named")).distinct()
    found = base.join(named, base["id"] == named["__named"], "left")
    return found.filter(_any([*conditions, F.col("__named").isNotNull()])).drop("__named")


def relevance(ask: Intent) -> Column:
    """0 for an equal code to 9 for a match elsewhere."""
    primary = ask.primary
    norm, compact, pattern = I.norm_key(primary), I.compact_key(primary), I.like_pattern(primary)
    flexible = I.code_pattern(I.collapse(primary)) if I.looks_like_code(primary) else pattern
    key, dense, upper = F.col("std_id_norm"), codes.stored_compact(F.col("std_id")), F.upper("std_id")
    steps = [
        key == norm, codes.begins(key, norm), dense == compact, codes.begins(dense, compact),
        F.replace(upper, F.lit(" "), F.lit("")) == norm, upper == primary.upper(), codes.like(upper, pattern), codes.like(upper, flexible),
        codes.like(F.col("std_chinesename"), f"%{primary}%"),
    ]
    rank = F.lit(9)
    for n, step in reversed(list(enumerate(steps))):
        rank = F.when(step, n).otherwise(rank)
    return rank


def page_of(found: DataFrame, page: Page, *order: Column) -> DataFrame:
    return found.orderBy(*order).offset(page.offset).limit(page.limit)


def text_page(base: DataFrame, files: DataFrame, text: str, page: Page = Page(), with_file: bool = True, folder: str | None = None) -> DataFrame:
    """A page of a text search, best matches first; a blank text finds nothing."""
    if not (text or "").strip():
        return base.limit(0).withColumn("rank", F.lit(9))
    found = matching(having_file(base, files, folder) if with_file or folder else base, files, text)
    return page_of(found.withColumn("rank", relevance(I.parse(text))), page, F.col("rank"), F.col("std_id"), F.col("id"))


def browse_page(base: DataFrame, files: DataFrame, page: Page = Page(), with_file: bool = True, folder: str | None = None) -> DataFrame:
    """Newest first; undated rows last."""
    found = having_file(base, files, folder) if with_file or folder else base
    return page_of(found, page, F.col("release_date").desc_nulls_last(), F.col("id"))


def within_years(year_from: int | None, year_to: int | None) -> list[Column]:
    """Each bound holds by the release year or by the code's last four characters, read as a number."""
    released, coded = codes.leading_int(F.substring("release_date", 1, 4)), codes.leading_int(F.right("std_id", F.lit(4)))
    out = []
    if year_from is not None:
        out.append((released >= year_from) | (coded >= year_from))
    if year_to is not None:
        out.append((released <= year_to) | (coded <= year_to))
    return out


def filtered(base: DataFrame, files: DataFrame, filters: Filters, geo: DataFrame | None = None, relations: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """Standards that meet all filters. Area and rank filters need their tables."""
    from quillon.operators import geo as G

    out = base
    if filters.states:
        out = out.filter(F.col("ex_state").isin(*filters.states))
    if filters.type_like:
        out = out.filter(codes.like(F.col("std_type"), f"%{filters.type_like}%"))
    if filters.product_words:
        out = out.filter(_any([codes.like(F.col("std_chinesename"), f"%{w}%") for w in filters.product_words]))
    for bound in within_years(filters.year_from, filters.year_to):
        out = out.filter(bound)
    if filters.with_file:
        out = having_file(out, files)
    if filters.by_area:
        if geo is None:
            raise ValueError("area filters need the geo table")
        out = G.in_area(out, geo, filters.province, filters.city, filters.county, "" if filters.by_rank else filters.company)
    if filters.by_rank:
        if relations is None or units is None:
            raise ValueError("rank filters need the relation and unit tables")
        out = G.by_rank(out, relations, units, filters.company, filters.rank, filters.rank_over_three)
    return out


def advanced_page(base: DataFrame, files: DataFrame, text: str, filters: Filters, page: Page = Page(), geo: DataFrame | None = None, relations: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """A page of rows that meet the filters and the text, by code; neither given finds nothing."""
    if not (text or "").strip() and not filters.active:
        return base.limit(0)
    return page_of(matching(filtered(base, files, filters, geo, relations, units), files, text), page, F.col("std_id"), F.col("id"))


def cluster_scored(base: DataFrame, keywords: list[str], primary: str = "") -> DataFrame:
    """Rows whose name holds a keyword, with their score: 2 for the primary keyword, 1 for each other."""
    words = list(dict.fromkeys(w.strip() for w in keywords if w.strip()))[:MOST_KEYWORDS]
    if not words:
        return base.limit(0).withColumn("score", F.lit(0))
    hits = [(codes.like(F.col("std_chinesename"), f"%{w}%"), 2 if w == primary else 1) for w in words]
    score = reduce(lambda a, b: a + b, [F.when(h, n).otherwise(0) for h, n in hits])
    return base.filter(_any([h for h, _ in hits])).withColumn("score", score)


def cluster_page(base: DataFrame, files: DataFrame, keywords: list[str], primary: str = "", page: Page = Page(), with_file: bool = True) -> DataFrame:
    found = cluster_scored(having_file(base, files) if with_file else base, keywords, primary)
    return page_of(found, page, F.col("score").desc(), F.col("std_id"), F.col("id"))


def _met(base: DataFrame, q: str) -> tuple[Column, Column]:
    """Whether a row's code is a spelling of the text or one of its keys, and how well: 0 to 3.

    The spellings are worked out once, so the condition is two IN lists, which reach the scan of an index table.
    """
    asked = base.sparkSession.sql("SELECT * FROM VALUES (:q) AS t(q)", args={"q": q})
    spellings = asked.select(codes.lookup_variants(F.col("q")).alias("v")).first()["v"]
    norm, compact = I.norm_key(q), I.compact_key(q)
    code, key = F.col("std_id"), F.col("std_id_norm")
    spelt = code.isin(spellings) | key.isin(list(dict.fromkeys(map(I.norm_key, spellings))))
    met = code.isin([*spellings, q]) | key.isin(list(dict.fromkeys([*map(I.norm_key, spellings), norm, compact])))
    return met, F.when(spelt, 0).when(code == q, 1).when(key == norm, 2).otherwise(3)


def prioritised(base: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """First rows by how their code meets the text: a spelling of it, the text, its keys, or a part of the code.

    The parts of codes, which need a whole scan, are looked at only if the other tiers have fewer rows than asked for.
    """
    q = (text or "").strip()
    if not q:
        return base.limit(0).withColumn("priority", F.lit(0))
    met, tier = _met(base, q)
    best = base.filter(met).withColumn("priority", tier).orderBy("priority", "id").limit(limit)
    if len(best.select("id").take(limit)) == limit:
        return best
    part = codes.like(F.upper("std_id"), f"%{q.upper()}%")
    return base.filter(met | part).withColumn("priority", F.when(met, tier).otherwise(4)).orderBy("priority", "id").limit(limit)


def best_match(base: DataFrame, text: str) -> DataFrame:
    """At most one row: the code's best match; a part of a code counts only if the keys are equal after all, and if nothing else is found."""
    q = (text or "").strip()
    if not q:
        return base.limit(0)
    met, tier = _met(base, q)
    found = base.filter(met).withColumn("priority", F.when(tier == 0, 0).when(F.col("std_id_norm") == I.norm_key(q), 1).otherwise(2))
    if not found.select("id").take(1):
        code = F.col("std_id")
        same = (codes.norm_key(code) == I.norm_key(q)) | (codes.compact_key(code) == I.compact_key(q))
        found = base.filter(codes.like(F.upper("std_id"), f"%{q.upper()}%") & same).withColumn("priority", F.lit(3))
    return found.orderBy("priority", "id").limit(1)


def detail(base: DataFrame, files: DataFrame) -> DataFrame:
    """Standards with their files nested, by name; only the chosen rows' files are gathered."""
    nested = files.join(base.select(F.col("id").alias("base_id")), "base_id", "left_semi").groupBy("base_id").agg(
        F.array_sort(F.collect_list(F.struct("file_name", "id", "file_path"))).alias("files")
    )
    return base.join(nested, base["id"] == nested["base_id"], "left").drop("base_id")


def product_page(base: DataFrame, files: DataFrame, clusters: DataFrame, text: str, page: Page = Page(), with_file: bool = True) -> DataFrame:
    """A page of what a product text and its groups' keywords find, the text itself weighing twice. Only the first keywords that
    a search uses come to the driver."""
    from quillon.operators.facets import expanded

    words = [r["word"] for r in expanded(clusters, text).limit(MOST_KEYWORDS).collect()]
    return cluster_page(base, files, words, (text or "").strip(), page, with_file)


def by_id(base: DataFrame, ids: list[int], most: int = 100) -> DataFrame:
    """Standards of a list of ids in the order given; repeated, non-positive and further ids are left out."""
    wanted = list(dict.fromkeys(i for i in ids if i > 0))[:most]
    order = F.array_position(F.array(*(F.lit(i).cast("long") for i in wanted)), F.col("id").cast("long")) if wanted else F.lit(0)
    return base.filter(F.col("id").isin(wanted)).withColumn("place", order).orderBy("place")


def pager(total: int, page: Page, width: int = 7) -> list[int]:
    """Page numbers around the current one."""
    last = max(1, page.count(total))
    first = max(1, min(page.number - width // 2, last - width + 1))
    return list(range(first, min(last, first + width - 1) + 1))
