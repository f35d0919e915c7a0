"""The model's tables over the star-schema tables: one deterministic expression each, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.search import with_keys
from quillon.session import kept

GROUPS = [("fasteners", "bolt group", ["bolt", "ring", "gear"]), ("gadgets", "widget group", ["widget", "gizmo"]), ("flat", "plate", ["plate", "sheet"])]
WORDS = ["bolt", "ring", "gear", "widget", "gizmo", "plate"]


#: Beginnings of Chinese names, for rows that need some.
PLACES = ["上海", "北京", "重庆", "安徽", "广东", "浙江", "四川", "云南", "西藏", "吉林", "河北", "湖南", "青海", "台湾", "福建", "abc", "Zed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("Q/X "), "o_orderkey", F.lit("A"))).otherwise(F.concat(F.lit("GB/T "), "o_orderkey", F.lit("-"), F.year("o_orderdate")))
    state = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    word = F.get(F.array(*map(F.lit, WORDS)), (F.col("o_custkey") % len(WORDS)).cast("int"))
    return with_keys(o.select(
        F.col("o_orderkey").alias("id"), code.alias("std_id"), F.col("o_orderpriority").alias("std_type"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(word, F.lit(" rule"))).alias("std_chinesename"),
        state.alias("ex_state"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"),
    ))


def files(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Files of the standards. Rows are made one by the numbers that names and paths are made of, which are null wherever these are; with ``once`` they are kept in
    the shared folder, for queries that read files again and again."""
    known = F.expr("l_orderkey is not null and l_linenumber is not null and l_suppkey is not null")
    numbers = [F.when(known, F.col(c)).alias(c) for c in ("l_linenumber", "l_suppkey", "l_linestatus")]
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey", *numbers).distinct()
    name = F.concat(F.lit("GBT"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_suppkey", F.lit(".pdf"))
    return (kept(lines, "files") if once else lines).select(
        (F.col("l_orderkey") * 10_000_000 + F.col("l_suppkey") * 20 + F.col("l_linenumber") + F.when(F.col("l_linestatus") == "F", 10).otherwise(0)).alias("id"), F.col("l_orderkey").alias("base_id"),
        F.concat("l_linestatus", F.lit("/"), name).alias("file_path"), name.alias("file_name"),
    )


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return with_keys(p.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("-"), "p_partkey").alias("std_id"), F.col("p_type").alias("std_type"), F.col("p_name").alias("std_chinesename"), (F.col("p_size") % 3).alias("ex_state")))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' and l_linenumber = 1")
    return x.select(F.col("l_partkey").alias("base_id"), F.concat(F.lit("part bolt"), F.col("l_suppkey") % 9, F.lit(".pdf")).alias("file_name")).distinct()


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("base_id"), F.col("l_suppkey").alias("unit_id"), F.col("l_linenumber").alias("rank_order"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    region = F.col("n_regionkey").cast("string")
    code = F.when(F.col("s_suppkey") % 2 == 0, F.concat(region, F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))).otherwise(region)
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("unit_id"), F.col("s_name").alias("unit_name"), code.alias("area_code"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese names of the suppliers: a place, a number of one digit, and what they are; in some the last comes first."""
    k = F.col("s_suppkey")
    place = F.get(F.array(*map(F.lit, PLACES)), (k % len(PLACES)).cast("int"))
    return table(spark, sf_dir, "supplier").select(k.alias("unit_id"), F.when(k % 10 == 3, F.concat(F.lit("公司"), place)).otherwise(F.concat(place, k % 7, F.lit("公司"))).alias("unit_name"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat("r_regionkey", F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("area_code"), F.col("r_name").alias("province_name"), F.col("n_name").alias("city_name"), F.lit(None).cast("string").alias("county_name"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(GROUPS, "id string, name string, keywords array<string>").coalesce(1)


def brand_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product groups made from the parts: a group a brand, with the names of its parts as keywords."""
    names = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("keywords"))
    return names.select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("place"), F.col("p_brand").alias("id"), F.concat("p_brand", F.lit(" group")).alias("name"), "keywords")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded codes: every order, spelt in four ways, every fifth of them unknown."""
    o = table(spark, sf_dir, "orders")
    n = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey"))
    year, way = F.year("o_orderdate"), F.col("o_orderkey") % 4
    query = (
        F.when(way == 0, F.concat(F.lit("GB/T "), n, F.lit("-"), year)).when(way == 1, F.concat(F.lit("gbt"), n, F.lit("-"), year))
        .when(way == 2, F.concat(F.lit("GB／T "), n, F.lit("-"), year)).otherwise(F.concat(F.lit("  GB/T  "), n, F.lit(" - "), year))
    )
    return o.select(F.col("o_orderkey").alias("row"), query.alias("query"))


_CODE = "CASE WHEN o_orderkey % 11 = 0 THEN 'Q/X ' || o_orderkey || 'A' ELSE 'GB/T ' || o_orderkey || '-' || year(o_orderdate) END"
_KEYS = r"upper(regexp_replace(std_id, '[\s　]+', '', 'g')) AS std_id_norm, translate(upper(std_id), ' /-—－／', '') AS std_id_compact"
_NAME = "'GBT' || l_orderkey || '_' || l_linenumber || '_' || l_suppkey || '.pdf'"
_PAD = "lpad(n_nationkey::VARCHAR, 2, '0')"
_N = "(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END)"

#: The same tables as common table expressions.
SQL = {
    "std": f"std AS (SELECT *, {_KEYS} FROM (SELECT o_orderkey AS id, {_CODE} AS std_id, o_orderpriority AS std_type, CASE WHEN o_orderkey % 7 <> 0 THEN {WORDS}[o_custkey % {len(WORDS)} + 1] || ' rule' END AS std_chinesename, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS ex_state, strftime(o_orderdate, '%Y-%m-%d') AS release_date FROM orders))",
    "files": f"files AS (SELECT DISTINCT l_orderkey * 10000000 + l_suppkey * 20 + l_linenumber + CASE WHEN l_linestatus = 'F' THEN 10 ELSE 0 END AS id, l_orderkey AS base_id, l_linestatus || '/' || {_NAME} AS file_path, {_NAME} AS file_name FROM lineitem WHERE l_returnflag = 'A')",
    "named": f"named AS (SELECT *, {_KEYS} FROM (SELECT p_partkey AS id, p_brand || '-' || p_partkey AS std_id, p_type AS std_type, p_name AS std_chinesename, p_size % 3 AS ex_state FROM part))",
    "nfiles": "nfiles AS (SELECT DISTINCT l_partkey AS base_id, 'part bolt' || (l_suppkey % 9) || '.pdf' AS file_name FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)",
    "rel": "rel AS (SELECT l_orderkey AS base_id, l_suppkey AS unit_id, l_linenumber AS rank_order FROM lineitem)",
    "units": f"units AS (SELECT s_suppkey AS unit_id, s_name AS unit_name, CASE WHEN s_suppkey % 2 = 0 THEN n_regionkey || {_PAD} ELSE n_regionkey::VARCHAR END AS area_code FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "companies": f"companies AS (SELECT s_suppkey AS unit_id, CASE WHEN s_suppkey % 10 = 3 THEN '公司' || {PLACES}[s_suppkey % {len(PLACES)} + 1] ELSE {PLACES}[s_suppkey % {len(PLACES)} + 1] || s_suppkey % 7 || '公司' END AS unit_name FROM supplier)",
    "areas": f"areas AS (SELECT r_regionkey || {_PAD} AS area_code, r_name AS province_name, n_name AS city_name, NULL::VARCHAR AS county_name FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "placed": "placed AS (SELECT unit_id, unit_name, u.area_code, a.province_name, a.city_name, a.county_name FROM units u JOIN areas a ON starts_with(a.area_code, u.area_code) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY length(a.area_code) DESC, a.area_code) = 1)",
    "geo": "geo AS (SELECT DISTINCT base_id, unit_id, unit_name, province_name, city_name, county_name, area_code FROM rel JOIN placed USING (unit_id))",
    "asked": f"asked AS (SELECT o_orderkey AS row, CASE o_orderkey % 4 WHEN 0 THEN 'GB/T ' || {_N} || '-' || year(o_orderdate) WHEN 1 THEN 'gbt' || {_N} || '-' || year(o_orderdate) WHEN 2 THEN 'GB／T ' || {_N} || '-' || year(o_orderdate) ELSE '  GB/T  ' || {_N} || ' - ' || year(o_orderdate) END AS query FROM orders)",
    "brands": "brands AS (SELECT regexp_extract(p_brand, '[0-9]+')::BIGINT AS place, p_brand AS id, p_brand || ' group' AS name, list_sort(list_distinct(list(p_name))) AS keywords FROM part GROUP BY p_brand)",
    "groups": "groups AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', {c})" for i, (a, b, c) in enumerate(GROUPS)) + ") t(place, id, name, keywords))",
}
_NEEDS = {"geo": ["rel", "units", "areas", "placed"], "placed": ["units", "areas"]}


def with_tables(*names: str) -> str:
    """WITH clause of these tables and those that they are made from."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, []), n) if x not in order]
    return "WITH " + ", ".join(SQL[n] for n in order) + " "
