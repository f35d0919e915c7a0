"""Facets and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import codes

MOST_TYPES, MOST_COMPANIES, MOST_SHOWN = 80, 40, 48


def facet(df: DataFrame, column: str, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Distinct non-empty values, trimmed, in order."""
    out = df.filter(where) if where is not None else df
    value = codes.strip(F.col(column))
    out = out.select(value.alias(column)).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)
    return out.limit(limit) if limit else out


def suggest_companies(units: DataFrame, text: str, limit: int = MOST_COMPANIES) -> DataFrame:
    """Names that hold the text: those it begins first, then shorter ones; names equal up to trailing punctuation once."""
    q = (text or "").strip()
    if len(q) < 2:
        return units.select("unit_name").limit(0)
    name = F.col("unit_name")
    order = (F.when(codes.like(name, f"{q}%"), 0).otherwise(1).alias("o"), F.length(name).alias("n"), name.alias("name"))
    first = units.filter(codes.like(name, f"%{q}%")).select("unit_name").distinct().select("unit_name", F.struct(*order).alias("by")).orderBy("by").limit(2 * limit)
    once = first.groupBy(F.regexp_replace("unit_name", r"(?U)[。，,;；.·\s]+$", "").alias("key")).agg(F.min_by("unit_name", "by").alias("unit_name"), F.min("by").alias("by"))
    return once.orderBy("by").limit(limit).select("unit_name")


def ranked_companies(names: DataFrame, text: str, limit: int = MOST_SHOWN, locale: str = "zh") -> DataFrame:
    """Names (unit_name) that hold the text, without regard to case: those it begins first, then shorter ones, then in the order of the locale (Chinese by pinyin).
    Without a text the first names as they come. Blank names leave, and each name is shown once."""
    q, name = (text or "").strip().lower(), codes.strip(F.col("unit_name"))
    known = names.select(name.alias("unit_name")).filter(F.coalesce("unit_name", F.lit("")) != "")
    if not q:
        return known.limit(limit)
    low = F.lower("unit_name")
    return known.filter(low.contains(q)).distinct().orderBy(F.when(low.startswith(q), 0).otherwise(1), F.length("unit_name"), F.collate(low, locale), "unit_name").limit(limit)


def _meets(text: str, keyword: Column) -> Column:
    """Equal without white space, or, for texts of two characters or more, one holding the other."""
    q = "".join((text or "").split())
    k = F.regexp_replace(F.coalesce(keyword, F.lit("")), f"{codes.SPACE}+", "")
    if len(q) < 2:
        return (k == q) & F.lit(bool(q))
    return (k != "") & (k.contains(q) | F.lit(q).contains(k))


def _placed(clusters: DataFrame) -> DataFrame:
    """Groups with their place: their own column of that name, else the order of their rows."""
    return clusters if "place" in clusters.columns else clusters.withColumn("place", F.monotonically_increasing_id())


def expanded(clusters: DataFrame, text: str) -> DataFrame:
    """Keywords a text expands to, in order: the text, then those of every group that it meets."""
    q = (text or "").strip()
    hit = _placed(clusters).filter(_meets(q, F.col("name")) | F.exists("keywords", lambda k: _meets(q, k)))
    words = hit.select("place", F.posexplode("keywords").alias("pos", "word")).select(F.lit(1).alias("tier"), "place", "pos", F.trim("word").alias("word"))
    own = clusters.sparkSession.range(1).select(F.lit(0).alias("tier"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("pos"), F.lit(q).alias("word"))
    return _once(own.unionByName(words))


def expansion(clusters: DataFrame, text: str) -> DataFrame:
    """One row: the keywords a text expands to, in order, the names of the groups that it meets, and whether that is more than the text."""
    q = (text or "").strip()
    words = expanded(clusters, q).agg(F.transform(F.array_sort(F.collect_list(F.struct("tier", "place", "pos", "word"))), lambda w: w["word"]).alias("keywords"))
    hit = _placed(clusters).filter(F.lit(bool(q)) & (_meets(q, F.col("name")) | F.exists("keywords", lambda k: _meets(q, k))))
    named = F.coalesce(F.nullif(F.trim("name"), F.lit("")), "id")
    groups = hit.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", named.alias("name")))), lambda g: g["name"]).alias("groups"))
    both = words.withColumn("groups", groups.scalar())
    return both.withColumns({"keywords": F.array().cast("array<string>") if not q else F.col("keywords")}).select(F.lit(q).alias("query"), "keywords", "groups", ((F.size("keywords") > 1) | (F.size("groups") > 0)).alias("expanded"))


def _once(tiers: DataFrame) -> DataFrame:
    by = F.struct("tier", "place", "pos")
    return tiers.filter(F.col("word") != "").groupBy("word").agg(F.min(by).alias("by")).select("by.*", "word").orderBy("tier", "place", "pos", "word")


def suggest_phrases(clusters: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Names of groups the text meets, then what it expands to, then keywords that hold it."""
    q = (text or "").strip()
    placed = _placed(clusters)
    names = placed.filter(_meets(q, F.col("name")) | F.exists("keywords", lambda k: _meets(q, k))).select(F.lit(0).alias("tier"), "place", F.lit(0).alias("pos"), F.trim("name").alias("word"))
    words = expanded(clusters, q).select((F.col("tier") + 1).alias("tier"), "place", "pos", "word")
    holding = placed.select("place", F.posexplode("keywords").alias("pos", "word")).filter(F.col("word").contains(q)).select(F.lit(3).alias("tier"), "place", "pos", "word")
    return _once(names.unionByName(words).unionByName(holding)).limit(limit).select("word")


def briefs(clusters: DataFrame) -> DataFrame:
    """Groups with a sample of their first six keywords."""
    words = F.filter(F.transform("keywords", F.trim), lambda k: k != "")
    sample = F.concat(F.array_join(F.slice(words, 1, 6), "、"), F.when(F.size(words) > 6, "…").otherwise(""))
    return clusters.select("id", "name", F.size(words).cast("long").alias("n_keywords"), sample.alias("sample"))


def matched(queries: DataFrame, clusters: DataFrame) -> DataFrame:
    """Groups that each of many texts meets, by keyword, as equi joins of keys and their parts."""
    from quillon.operators.files import contained

    key = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), f"{codes.SPACE}+", "")
    q = queries.select("row", key(F.col("query")).alias("q")).filter(F.col("q") != "")
    words = clusters.select("id", F.explode(F.concat(F.array("name"), "keywords")).alias("w")).select("id", key(F.col("w")).alias("k")).filter(F.col("k") != "").distinct()
    long = q.filter(F.length("q") >= 2)
    pairs = q.join(words, q["q"] == words["k"]).select("row", "id")
    return pairs.union(contained(long, "q", words, "k").select("row", "id")).union(contained(words, "k", long, "q").select("row", "id")).distinct()


def recent(events: DataFrame, who: str, what: str, *newest: Column, most: int = 8) -> DataFrame:
    """Each one's last distinct values, newest first. The limit is the feature."""
    from pyspark.sql import Window

    order = [c.desc() for c in newest]
    last = events.withColumn("__n", F.row_number().over(Window.partitionBy(who, what).orderBy(*order))).filter("__n = 1")
    return last.withColumn("place", F.row_number().over(Window.partitionBy(who).orderBy(*order))).filter(F.col("place") <= most).drop("__n")


def state_options(base: DataFrame) -> DataFrame:
    """States with their labels and how many standards have them."""
    from quillon.functions import display

    return base.groupBy("ex_state").agg(F.count(F.lit(1)).alias("n")).select("ex_state", display.state_label(F.col("ex_state"), F.lit(None).cast("string")).alias("label"), "n")
