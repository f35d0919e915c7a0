"""Regions and drafting organisations: prefix join, semi joins, coverage and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import codes
from quillon.operators import search
from quillon.plans.intent import Filters

MOST_EXPORTED = 5000


def area_prefixes(areas: DataFrame) -> DataFrame:
    """For every prefix of an area code the longest area that begins with it, the smallest code among equals.

    This turns "the longest area code that extends the unit's code" into an equi join.
    """
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.length("area_code")), lambda n: F.substring(F.col("area_code"), F.lit(1), n)))
    known = areas.filter(F.length("area_code") > 0)
    row = F.struct("area_code", "province_name", "city_name", "county_name")
    order = F.struct((-F.length("area_code")).alias("n"), F.col("area_code").alias("c"))
    best = known.select(prefix.alias("prefix"), row.alias("area"), order.alias("o")).groupBy("prefix").agg(F.min_by("area", "o").alias("area"))
    return best.select("prefix", "area.*")


def materialize(relations: DataFrame, units: DataFrame, areas: DataFrame) -> DataFrame:
    """One row a standard and organisation whose area is known, with the area's names."""
    placed = units.join(area_prefixes(areas).withColumnRenamed("area_code", "full_code"), units["area_code"] == F.col("prefix"))
    placed = placed.filter(F.coalesce(F.col("province_name"), F.lit("")) != "").select("unit_id", "unit_name", "province_name", "city_name", "county_name", "area_code")
    return relations.select("base_id", "unit_id").distinct().join(placed, "unit_id").select("base_id", "unit_id", "unit_name", "province_name", "city_name", "county_name", "area_code")


def _area(province: str, city: str, county: str, company: str) -> Column:
    out = F.lit(True)
    for name, value in (("province_name", province), ("city_name", city), ("county_name", county)):
        if value:
            out = out & (F.col(name) == value)
    return out & codes.like(F.col("unit_name"), f"%{company}%") if company else out


def in_area(base: DataFrame, geo: DataFrame, province: str = "", city: str = "", county: str = "", company: str = "") -> DataFrame:
    """Standards of which one organisation meets all conditions at once."""
    return base.join(geo.filter(_area(province, city, county, company)).select(F.col("base_id").alias("id")), "id", "left_semi")


def by_rank(base: DataFrame, relations: DataFrame, units: DataFrame, company: str, rank: int | None, over_three: bool) -> DataFrame:
    """Standards that a company of this name drafted at a rank."""
    at = F.col("rank_order") > 3 if over_three else F.col("rank_order") == rank
    named = units.filter(codes.like(F.col("unit_name"), f"%{company}%")).select("unit_id")
    ids = relations.filter(at).join(named, "unit_id", "left_semi").select(F.col("base_id").alias("id"))
    return base.join(ids, "id", "left_semi")


def regional(base: DataFrame, files: DataFrame, geo: DataFrame, filters: Filters, text: str = "", relations: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """Standards of a region that also meet the other filters and a search text. A company that is not asked for by rank is to be in the region."""
    if not filters.province:
        raise ValueError("a regional search needs a province")
    here = in_area(base, geo, filters.province, filters.city, filters.county, "" if filters.by_rank else filters.company)
    return search.matching(search.filtered(here, files, filters.without_place(), geo, relations, units), files, text)


def first_ids(found: DataFrame, limit: int = MOST_EXPORTED) -> DataFrame:
    """Ids to export, by code. The limit is the feature: an export takes so many."""
    return found.orderBy("std_id", "id").limit(max(1, min(limit, MOST_EXPORTED))).select("id")


def totals(found: DataFrame) -> DataFrame:
    """One row: how many standards match, how many an export takes, whether that is fewer."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.least("total", F.lit(MOST_EXPORTED)).cast("long").alias("download_count"), (F.col("total") > MOST_EXPORTED).alias("capped"))


def export_ids(base: DataFrame, geo: DataFrame, province: str, city: str = "", county: str = "", company: str = "", limit: int = MOST_EXPORTED) -> DataFrame:
    """Ids of an area's standards to export."""
    if not province:
        raise ValueError("an export needs a province")
    return first_ids(in_area(base, geo, province, city, county, company), limit)


def preview(base: DataFrame, geo: DataFrame, province: str, city: str = "", county: str = "", company: str = "") -> DataFrame:
    """Counts of an area's export."""
    if not province:
        raise ValueError("a preview needs a province")
    return totals(in_area(base, geo, province, city, county, company))


def coverage(geo: DataFrame, province: str) -> DataFrame:
    """One row: rows, standards, and standards of one province."""
    here = F.when(F.col("province_name") == province, F.col("base_id"))
    return geo.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("base_id").alias("n_standards"), F.count_distinct(here).alias("n_in_province"))
