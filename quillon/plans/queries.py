"""All catalogue queries over the star-schema tables, by name, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import codes, display
from quillon.operators import batch, catalog, facets, geo, lookup, postings, refresh, search, upload
from quillon.operators import files as found
from quillon.plans import binding as B
from quillon.plans.binding import with_tables
from quillon.plans.intent import Filters, Page
from quillon.session import shared_folder
from quillon.sinks import bundles, export, snapshots
from quillon.streaming import freshness

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SHOWN = ("id", "std_id", "std_chinesename")
_BOLT = "(std_chinesename ILIKE '%bolt%' OR upper(std_id) LIKE '%BOLT%' OR EXISTS (SELECT 1 FROM nfiles f WHERE f.base_id = b.id AND upper(f.file_name) LIKE '%BOLT%'))"
_HAS = "EXISTS (SELECT 1 FROM {f} f WHERE f.base_id = b.id)"


@query(with_tables("named", "nfiles") + f"SELECT id, std_id, std_chinesename, CASE WHEN std_chinesename ILIKE '%bolt%' THEN 8 ELSE 9 END AS rank FROM named b WHERE {_HAS.format(f='nfiles')} AND {_BOLT} ORDER BY 4, std_id, id LIMIT 20 OFFSET 20")
def search_text_page(spark: SparkSession, d: str) -> DataFrame:
    return search.text_page(B.named(spark, d), B.named_files(spark, d), "bolt", Page(2, 20)).select(*_SHOWN, "rank")


@query(with_tables("std", "files") + "SELECT id, std_id, std_chinesename, CASE WHEN std_id_norm = 'GB/T100' THEN 0 WHEN std_id_norm LIKE 'GB/T100%' THEN 1 ELSE 9 END AS rank FROM std b WHERE (std_id_norm LIKE 'GB/T100%' OR std_id_norm LIKE 'GBT100%') ORDER BY 4, std_id, id LIMIT 50")
def search_code_page(spark: SparkSession, d: str) -> DataFrame:
    return search.text_page(B.standards(spark, d), B.files(spark, d), "gb/t 100", Page(1, 50), with_file=False).select(*_SHOWN, "rank")


@query(with_tables("named", "nfiles") + f"SELECT count(*) AS total FROM named b WHERE {_HAS.format(f='nfiles')} AND {_BOLT}")
def search_text_count(spark: SparkSession, d: str) -> DataFrame:
    files = B.named_files(spark, d)
    return search.matching(search.having_file(B.named(spark, d), files), files, "bolt").agg(F.count(F.lit(1)).alias("total"))


@query(with_tables("std", "files") + f"SELECT id, std_id, release_date FROM std b WHERE {_HAS.format(f='files')} ORDER BY release_date DESC NULLS LAST, id LIMIT 30 OFFSET 30")
def browse_page(spark: SparkSession, d: str) -> DataFrame:
    return search.browse_page(B.standards(spark, d), B.files(spark, d), Page(2, 30)).select("id", "std_id", "release_date")


_INT = r"coalesce(try_cast(nullif(regexp_extract({x}, '^\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0)"
_YEARS = " AND ".join(f"({_INT.format(x='left(release_date, 4)')} {op} {y} OR {_INT.format(x='right(std_id, 4)')} {op} {y})" for op, y in ((">=", 1995), ("<=", 1997)))


@query(with_tables("std", "files", "rel", "geo") + f"""SELECT id, std_id, ex_state, std_type FROM std b WHERE ex_state IN (1, 2) AND std_type ILIKE '%high%' AND {_YEARS} AND {_HAS.format(f='files')}
    AND id IN (SELECT base_id FROM geo WHERE province_name = 'ASIA') AND id IN (SELECT base_id FROM rel JOIN units USING (unit_id) WHERE rank_order > 3 AND unit_name ILIKE '%supplier%') ORDER BY std_id, id LIMIT 50""")
def search_advanced(spark: SparkSession, d: str) -> DataFrame:
    base, files, rel, units = B.standards(spark, d), B.files(spark, d), B.relations(spark, d), B.units(spark, d)
    asked = Filters(states=(1, 2), type_like="high", province="ASIA", company="supplier", rank_over_three=True, year_from=1995, year_to=1997, with_file=True)
    return search.advanced_page(base, files, "", asked, Page(1, 50), geo.materialize(rel, units, B.areas(spark, d)), rel, units).select("id", "std_id", "ex_state", "std_type")


@query(with_tables("std") + f"SELECT id, std_id, release_date FROM std WHERE {_YEARS}")
def year_filter(spark: SparkSession, d: str) -> DataFrame:
    first, last = search.within_years(1995, 1997)
    return B.standards(spark, d).filter(first & last).select("id", "std_id", "release_date")


_SCORE = "(CASE WHEN std_chinesename ILIKE '%ring%' THEN 2 ELSE 0 END + CASE WHEN std_chinesename ILIKE '%bolt%' THEN 1 ELSE 0 END + CASE WHEN std_chinesename ILIKE '%gear%' THEN 1 ELSE 0 END + CASE WHEN std_chinesename ILIKE '%red%' THEN 1 ELSE 0 END)"


@query(with_tables("named") + f"SELECT id, std_id, std_chinesename, {_SCORE} AS score FROM named WHERE {_SCORE} > 0 ORDER BY score DESC, std_id, id LIMIT 50")
def cluster_score(spark: SparkSession, d: str) -> DataFrame:
    files = B.named_files(spark, d)
    return search.cluster_page(B.named(spark, d), files, ["ring", "bolt", "gear", "red", "ring"], "ring", Page(1, 50), with_file=False).select(*_SHOWN, "score")


@query(with_tables("named") + "SELECT id, std_id FROM named WHERE std_chinesename ILIKE '%widget%' OR std_chinesename ILIKE '%gizmo%'")
def product_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered(B.named(spark, d), B.named_files(spark, d), Filters(product_words=("widget", "gizmo"))).select("id", "std_id")


@query(with_tables("std", "files") + f"SELECT id, std_id FROM std b WHERE {_HAS.format(f='files')}")
def semi_has_file(spark: SparkSession, d: str) -> DataFrame:
    return search.having_file(B.standards(spark, d), B.files(spark, d)).select("id", "std_id")


@query(with_tables("std", "files") + "SELECT id, std_id FROM std b WHERE EXISTS (SELECT 1 FROM files f WHERE f.base_id = b.id AND f.file_path ILIKE '%F/GBT%')")
def semi_folder(spark: SparkSession, d: str) -> DataFrame:
    return search.having_file(B.standards(spark, d), B.files(spark, d), "F/GBT").select("id", "std_id")


@query(with_tables("std", "files") + f"SELECT id, {_HAS.format(f='files')} AS has_pdf FROM std b")
def has_pdf_flag(spark: SparkSession, d: str) -> DataFrame:
    return search.with_file_flag(B.standards(spark, d).select("id"), B.files(spark, d))


@query(with_tables("named", "nfiles") + f"SELECT id, std_id FROM named b WHERE {_BOLT}")
def exists_or_name(spark: SparkSession, d: str) -> DataFrame:
    return search.matching(B.named(spark, d), B.named_files(spark, d), "bolt").select("id", "std_id")


def _geo(spark: SparkSession, d: str) -> DataFrame:
    return geo.materialize(B.relations(spark, d), B.units(spark, d), B.areas(spark, d))


@query(with_tables("geo") + "SELECT * FROM geo")
def geo_materialize(spark: SparkSession, d: str) -> DataFrame:
    return _geo(spark, d)


@query(with_tables("areas") + "SELECT prefix, area_code, province_name, city_name FROM (SELECT left(area_code, n::BIGINT) AS prefix, * FROM areas, range(1, 4) t(n)) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY length(area_code) DESC, area_code) = 1")
def area_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return geo.area_prefixes(B.areas(spark, d)).select("prefix", "area_code", "province_name", "city_name")


@query(with_tables("std", "geo") + "SELECT id, std_id FROM std WHERE id IN (SELECT base_id FROM geo WHERE province_name = 'EUROPE' AND unit_name ILIKE '%00000000%')")
def geo_semi(spark: SparkSession, d: str) -> DataFrame:
    return geo.in_area(B.standards(spark, d), _geo(spark, d), "EUROPE", company="00000000").select("id", "std_id")


_ASIA = "id IN (SELECT base_id FROM geo WHERE province_name = 'ASIA')"


@query(with_tables("std", "geo") + f"SELECT count(*) AS total, least(count(*), 5000) AS download_count, count(*) > 5000 AS capped FROM std WHERE {_ASIA}")
def geo_count(spark: SparkSession, d: str) -> DataFrame:
    return geo.preview(B.standards(spark, d), _geo(spark, d), "ASIA")


@query(with_tables("std", "geo") + f"SELECT id FROM std WHERE {_ASIA} ORDER BY std_id, id LIMIT 5000")
def geo_export_ids(spark: SparkSession, d: str) -> DataFrame:
    return geo.export_ids(B.standards(spark, d), _geo(spark, d), "ASIA")


_REGIONAL = with_tables("std", "files", "geo") + ", r AS (SELECT id, std_id FROM std WHERE EXISTS (SELECT 1 FROM geo g WHERE g.base_id = std.id AND province_name = 'ASIA' AND unit_name ILIKE '%0000%') AND ex_state IN (1, 2) AND coalesce(std_chinesename ILIKE '%bolt%', false) AND (left(release_date, 4)::INT >= 1995 OR coalesce(try_cast(regexp_extract(right(std_id, 4), '^[0-9]+') AS INT), 0) >= 1995) AND EXISTS (SELECT 1 FROM files f WHERE f.base_id = std.id)) "


def _regional(spark: SparkSession, d: str) -> DataFrame:
    asked = Filters(states=(1, 2), province="ASIA", company="0000", year_from=1995, with_file=True)
    return geo.regional(B.standards(spark, d), B.files(spark, d), _geo(spark, d), asked, "bolt")


@query(_REGIONAL + "SELECT id FROM r ORDER BY std_id, id LIMIT 5000")
def regional_export(spark: SparkSession, d: str) -> DataFrame:
    return geo.first_ids(_regional(spark, d))


@query(_REGIONAL + "SELECT count(*) AS total, least(count(*), 5000) AS download_count, count(*) > 5000 AS capped FROM r")
def regional_preview(spark: SparkSession, d: str) -> DataFrame:
    return geo.totals(_regional(spark, d))


_RANKED = "SELECT id, std_id FROM std WHERE id IN (SELECT base_id FROM rel JOIN units USING (unit_id) WHERE rank_order {c} AND unit_name ILIKE '%00000002%')"


@query(with_tables("std", "rel", "units") + _RANKED.format(c="= 1"))
def rank_eq(spark: SparkSession, d: str) -> DataFrame:
    return geo.by_rank(B.standards(spark, d), B.relations(spark, d), B.units(spark, d), "00000002", 1, False).select("id", "std_id")


@query(with_tables("std", "rel", "units") + _RANKED.format(c="> 3"))
def rank_gt3(spark: SparkSession, d: str) -> DataFrame:
    return geo.by_rank(B.standards(spark, d), B.relations(spark, d), B.units(spark, d), "00000002", None, True).select("id", "std_id")


@query(with_tables("geo") + "SELECT count(*) AS n_rows, count(DISTINCT base_id) AS n_standards, count(DISTINCT base_id) FILTER (province_name = 'AFRICA') AS n_in_province FROM geo")
def geo_coverage(spark: SparkSession, d: str) -> DataFrame:
    return geo.coverage(_geo(spark, d), "AFRICA")


@query(with_tables("std") + "SELECT DISTINCT trim(std_type) AS std_type FROM std WHERE std_type <> '' ORDER BY 1 LIMIT 80")
def facet_types(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet(B.standards(spark, d), "std_type", limit=facets.MOST_TYPES)


@query(with_tables("areas") + "SELECT DISTINCT province_name FROM areas")
def facet_provinces(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet(B.areas(spark, d), "province_name")


@query(with_tables("areas") + "SELECT DISTINCT city_name FROM areas WHERE province_name = 'AMERICA'")
def facet_cities(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet(B.areas(spark, d), "city_name", F.col("province_name") == "AMERICA")


@query(with_tables("units") + "SELECT unit_name FROM units WHERE unit_name ILIKE '%0001%' ORDER BY CASE WHEN unit_name ILIKE '0001%' THEN 0 ELSE 1 END, length(unit_name), unit_name LIMIT 40")
def suggest_units(spark: SparkSession, d: str) -> DataFrame:
    return facets.suggest_companies(B.units(spark, d), "0001")


@query(with_tables("companies") + """, n AS (SELECT DISTINCT unit_name FROM companies WHERE contains(lower(unit_name), '公司'))
    SELECT unit_name, row_number() OVER (ORDER BY NOT starts_with(lower(unit_name), '公司'), length(unit_name), lower(unit_name) COLLATE zh, unit_name) AS place FROM n QUALIFY place <= 48""")
def companies_by_pinyin(spark: SparkSession, d: str) -> DataFrame:
    named = facets.ranked_companies(B.companies(spark, d), "公司")
    # At most 48 rows: their places are told in the one task that has them.
    return named.coalesce(1).select("unit_name", (F.monotonically_increasing_id() + 1).alias("place"))


#: Groups of which a name or keyword holds the text, or is held by it, without spaces; and the words they stand for.
_HIT = """, every AS (SELECT *, replace({q}, ' ', '') AS q FROM brands), hit AS (SELECT * FROM every WHERE len(list_filter([name] || keywords, lambda x: contains(replace(x, ' ', ''), q) OR (replace(x, ' ', '') <> '' AND contains(q, replace(x, ' ', ''))))) > 0),
    w AS (SELECT 1 AS tier, 0 AS place, 0 AS pos, {q} AS word UNION ALL SELECT 2, place, unnest(range(len(keywords))), unnest(keywords) FROM hit)"""
_ONCE = "SELECT word, tier, place, pos FROM {w} QUALIFY row_number() OVER (PARTITION BY word ORDER BY tier, place, pos) = 1 ORDER BY tier, place, pos"


@query(
    with_tables("brands") + _HIT.format(q="'hot gear'") + f""", s AS (SELECT * FROM w UNION ALL SELECT 0, place, 0, name FROM hit
    UNION ALL SELECT 3, place, pos, word FROM (SELECT place, unnest(range(len(keywords))) AS pos, unnest(keywords) AS word FROM brands) WHERE contains(word, 'hot gear'))
    SELECT word FROM ({_ONCE.format(w='s')} LIMIT 8)"""
)
def suggest_phrases(spark: SparkSession, d: str) -> DataFrame:
    return facets.suggest_phrases(B.brand_groups(spark, d), "hot gear")


@query(with_tables("brands") + "SELECT id, name, len(keywords) AS n_keywords, array_to_string(keywords[1:6], '、') || CASE WHEN len(keywords) > 6 THEN '…' ELSE '' END AS sample FROM brands")
def cluster_briefs(spark: SparkSession, d: str) -> DataFrame:
    return facets.briefs(B.brand_groups(spark, d))


_TIERS = "CASE WHEN std_id IN ('GB/T 123', 'GB/T123', 'GBT123') OR std_id_norm IN ('GB/T123', 'GBT123') THEN 0 WHEN upper(std_id) LIKE '%GB/T 123%' THEN 4 END"


@query(with_tables("std") + f"SELECT id, std_id, priority FROM (SELECT *, {_TIERS} AS priority FROM std) WHERE priority IS NOT NULL ORDER BY priority, id LIMIT 20")
def priority_search(spark: SparkSession, d: str) -> DataFrame:
    return search.prioritised(B.standards(spark, d), "GB/T 123").select("id", "std_id", "priority")


@query(with_tables("std") + "SELECT id, std_id FROM std WHERE translate(upper(std_id), ' /-', '') = (SELECT 'GBT123' || year(o_orderdate) FROM orders WHERE o_orderkey = 123)")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    base = B.standards(spark, d)
    one = base.filter("id = 123").select("std_id").first()
    return search.best_match(base, one["std_id"].replace("/", "").replace(" ", "").lower() if one else "GBT123").select("id", "std_id")


_WS = r"[\s　]"


@query(with_tables("asked") + rf"SELECT row, upper(regexp_replace(query, '{_WS}+', '', 'g')) AS norm FROM asked")
def norm_keys(spark: SparkSession, d: str) -> DataFrame:
    return B.asked(spark, d).select("row", codes.norm_key(F.col("query")).alias("norm"))


@query(with_tables("asked") + rf"SELECT row, upper(regexp_replace(query, '[\s　/／－—-]+', '', 'g')) AS compact FROM asked")
def compact_keys(spark: SparkSession, d: str) -> DataFrame:
    return B.asked(spark, d).select("row", codes.compact_key(F.col("query")).alias("compact"))


@query(
    with_tables("asked")
    + r""", a AS (SELECT row, trim(query) AS raw, upper(trim(query)) AS u, regexp_replace(upper(query), '\s+', '', 'g') AS dense FROM asked), b AS (SELECT *, replace(dense, '/', '') AS bare FROM a),
    c AS (SELECT *, regexp_extract(CASE WHEN regexp_matches(replace(bare, '-', ' '), '^([A-Z]{1,6}(/[A-Z])?)\s*([0-9]+)\s*[-－—]?\s*([0-9]{2,4})?\s*$') THEN replace(bare, '-', ' ') ELSE dense END, '^([A-Z]{1,6}(?:/[A-Z])?)\s*([0-9]+)\s*[-－—]?\s*([0-9]{2,4})?\s*$', ['p', 'n', 'y']) AS m FROM b),
    v AS (SELECT row, unnest([raw, u, regexp_replace(u, '\s+', ' ', 'g'), dense, replace(dense, '-', '—'), replace(dense, '-', '－'), replace(dense, '-', ''), bare, replace(bare, '-', '—'), replace(bare, '-', '－'), replace(bare, '-', ''),
      CASE WHEN regexp_matches(m.p, '^[A-Z]{2,}[TZX]$') THEN m.p[:-2] || '/' || m.p[-1] || ' ' || m.n || CASE WHEN m.y <> '' THEN '-' || m.y ELSE '' END ELSE '' END,
      CASE WHEN regexp_matches(m.p, '^[A-Z]{2,}[TZX]$') THEN m.p[:-2] || '/' || m.p[-1] || m.n || CASE WHEN m.y <> '' THEN '-' || m.y ELSE '' END ELSE '' END]) AS variant FROM c)
    SELECT DISTINCT row, variant FROM v WHERE variant <> ''"""
)
def lookup_variants(spark: SparkSession, d: str) -> DataFrame:
    return B.asked(spark, d).select("row", F.explode(codes.lookup_variants(F.col("query"))).alias("variant"))


@query(with_tables("asked") + rf"""SELECT row, trim(regexp_replace(regexp_replace(regexp_replace(replace(trim(query), '／', '/'), '^([A-Za-z]{{1,6}}/[A-Za-z])([0-9])', '\1 \2'), '^([A-Za-z]{{2,5}}[TZXtzx])([0-9])', '\1 \2'), '{_WS}+', ' ', 'g')) AS clean FROM asked""")
def sanitize_code(spark: SparkSession, d: str) -> DataFrame:
    return B.asked(spark, d).select("row", codes.sanitize(F.col("query")).alias("clean"))


@query("SELECT doc_id, NOT regexp_matches(text, '[一-鿿]') AND regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[0-9]') AS is_code FROM documents")
def looks_like_code(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", codes.looks_like_code(F.col("text")).alias("is_code"))


@query(with_tables("asked") + rf"""SELECT row, trim(regexp_replace(regexp_replace(regexp_replace(replace(trim(query), '／', '/'), '^([A-Za-z]{{1,6}}/[A-Za-z])([0-9])', '\1 \2'), '^([A-Za-z]{{2,5}}[TZXtzx])([0-9])', '\1 \2'), '{_WS}+', ' ', 'g')) AS fragments FROM asked""")
def extract_fragments(spark: SparkSession, d: str) -> DataFrame:
    return B.asked(spark, d).select("row", F.array_join(codes.fragments(F.col("query")), "|").alias("fragments"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4), '|') AS words FROM part")
def text_keywords(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" GB/T 12-2020"))
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(codes.text_keywords(name), "|").alias("words"))


@query(with_tables("std") + "SELECT id, CASE ex_state WHEN 0 THEN '废止' WHEN 1 THEN '现行' WHEN 2 THEN '即将实施' END AS label FROM std WHERE id % 3 <> 0 UNION ALL SELECT id, coalesce(nullif(std_chinesename, ''), '未知') FROM std WHERE id % 3 = 0")
def label_decode(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("id") % 3 != 0, F.col("ex_state"))
    return B.standards(spark, d).select("id", display.state_label(state, F.col("std_chinesename")).alias("label"))


@query(with_tables("std", "files") + "SELECT id, std_id, coalesce((SELECT string_agg(file_name, '|' ORDER BY file_name) FROM files f WHERE f.base_id = std.id), '') AS names FROM std WHERE id % 50 = 0")
def detail_with_files(spark: SparkSession, d: str) -> DataFrame:
    chosen = B.standards(spark, d).filter("id % 50 = 0")
    names = F.coalesce(F.array_join(F.transform("files", lambda f: f["file_name"]), "|"), F.lit(""))
    return search.detail(chosen, B.files(spark, d)).select("id", "std_id", names.alias("names"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """The postings of the documents, written once an application and table."""
    path = f"{shared_folder(spark)}/postings-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    if "_SUCCESS" not in snapshots.names(spark, path):
        docs = B.table(spark, d, "documents")
        files = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("title"), F.col("text").alias("filename"))
        postings.write(postings.of(files), path, postings.files_of(files))
    return spark.read.parquet(path)


_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace(text, '\\p{Mn}+', '', 'g')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query(f"SELECT doc_id FROM (SELECT *, {_TOKENS} AS ts FROM documents) WHERE len(list_filter(ts, lambda t: starts_with(t, 'worthl') OR starts_with(t, 'thanon'))) > 0 OR starts_with(source, 'worthl') OR starts_with(source, 'thanon')")
def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return postings.matching(_postings(spark, d), "worthl thanon").select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id FROM (SELECT *, {_TOKENS} AS ts FROM documents) WHERE len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND starts_with(ts[i + 1], 'th'))) > 0")
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return postings.matching(_postings(spark, d), "of-th").select(F.col("id").alias("doc_id"))


def _index(spark: SparkSession, d: str, codes_alone: bool = False) -> str:
    """The folder of the index tables, or of the one that look-ups of codes read, built once an application and data."""
    folder = f"{shared_folder(spark)}/{'codes' if codes_alone else 'index'}-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    if not lookup.ready(spark, folder):
        base = B.standards(spark, d).drop("std_id_norm", "std_id_compact")
        if codes_alone:
            lookup.build(base, None, folder, "2024-01-01")
            return folder
        lookup.build(base, B.files(spark, d), folder, "2024-01-01", B.relations(spark, d), B.units(spark, d), B.areas(spark, d))
    return folder


@query(
    with_tables("std", "files", "geo") + """SELECT '2024-01-01' AS built_at, (SELECT count(*) FROM std) AS standards, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM std WHERE id IN (SELECT base_id FROM files)) AS with_file,
        count(*) AS regions, count(DISTINCT base_id) AS with_unit, count(DISTINCT base_id) FILTER (province_name IS NOT NULL) AS with_region FROM geo"""
)
def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    return lookup.noted(spark, _index(spark, d))


@query(with_tables("std") + "SELECT id, std_id FROM std WHERE std_id IN ('Q/X 77A', 'QX77A', 'Q/X77A')")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_code(spark, _index(spark, d, codes_alone=True), "qx 77a").select("id", "std_id")


_LISTED = rf"""SELECT prefix || p AS rel_path, max(size) AS file_size FROM (SELECT regexp_extract(url, '^[a-z]+://(.*)$', 1) AS p, strlen(html) AS size FROM pages WHERE url IS NOT NULL), (VALUES (''), ('copy/')) t(prefix) GROUP BY prefix, p"""
_CATALOG = rf"""WITH l AS ({_LISTED}), n AS (SELECT *, regexp_extract(rel_path, '([^/]*)$', 1) AS filename FROM l),
    c AS (SELECT rel_path, file_size, filename, coalesce(nullif(regexp_extract(rel_path, '^(.*)/[^/]*$', 1), ''), '根目录') AS category, coalesce(nullif(regexp_replace(filename, '^(.+)\.[^.]+$', '\1'), ''), filename) AS title FROM n) """


def _refreshed(spark: SparkSession, d: str) -> str:
    """A catalogue after three listings of the pages' paths: drafts and unfinished files; these finished and the drafts gone; a copy of each."""
    folder = f"{shared_folder(spark)}/catalog-{uuid4().hex}"
    done = B.table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://(.*)$", 1).alias("rel_path"), F.octet_length("html").cast("long").alias("file_size"), F.lit(2).alias("mtime"))
    under = lambda name: done.withColumn("rel_path", F.concat(F.lit(name), "rel_path"))
    unfinished = done.withColumns({"file_size": F.lit(-1).cast("long"), "mtime": F.lit(1)})
    for n, listing in enumerate((under("draft/").unionByName(unfinished), done, done.unionByName(under("copy/")))):
        refresh.refresh(listing, folder, "/pages", f"2024-01-0{n + 1} 00:00:00")
    return folder


@query(_CATALOG + "SELECT rel_path, file_size, filename, category, title FROM c")
def catalog_refreshed(spark: SparkSession, d: str) -> DataFrame:
    return refresh.files(spark, _refreshed(spark, d)).select("rel_path", "file_size", "filename", "category", "title")


@query(_CATALOG + r"""SELECT rel_path FROM c WHERE len(list_filter([category, title, filename], lambda x: regexp_matches(' ' || regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'), ' (copy|1)'))) > 0""")
def fts_refreshed(spark: SparkSession, d: str) -> DataFrame:
    return refresh.search(spark, _refreshed(spark, d), "copy draft 1").select("rel_path")


@query(f"WITH l AS ({_LISTED}) SELECT true AS ready, '2024-01-03 00:00:00' AS built_at, '/pages' AS root, count(*) AS total, count(*) // 2 AS added, 0::BIGINT AS changed, 0::BIGINT AS removed, 60::BIGINT AS age_seconds FROM l")
def catalog_status(spark: SparkSession, d: str) -> DataFrame:
    return refresh.status(spark, _refreshed(spark, d), "2024-01-03 00:01:00")


_PATH = r"regexp_extract(url, '^[a-z]+://(.*)$', 1)"


@query(rf"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename FROM p)
    SELECT page_id, filename, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '根目录') AS category, coalesce(nullif(regexp_replace(filename, '^(.+)\.[^.]+$', '\1'), ''), filename) AS title, lower(regexp_extract(filename, '^.+(\.[^.]+)$', 1)) AS file_ext FROM n""")
def catalog_parse(spark: SparkSession, d: str) -> DataFrame:
    listing = B.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://(.*)$", 1).alias("rel_path"))
    return catalog.by_folder(listing).select("page_id", "filename", "category", "title", "file_ext")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE '团标' END AS category, CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE p_name END AS title FROM part")
def catalog_organisation(spark: SparkSession, d: str) -> DataFrame:
    p = B.table(spark, d, "part")
    path = F.concat(F.lit("a/"), F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_name", " ", "_")).otherwise(F.col("p_name")), F.lit(".pdf"))
    return catalog.by_organisation(p.select(F.col("p_partkey").alias("id"), path.alias("rel_path"))).select("id", "category", "title")


@query("SELECT p_partkey AS id, p_brand AS category, p_name AS title FROM part WHERE starts_with(split_part(p_name, ' ', 1), 'bl') OR starts_with(split_part(p_name, ' ', 2), 'bl') ORDER BY category, title, id LIMIT 50")
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.col("p_name").alias("title"), F.lit("").alias("filename"))
    return catalog.page(catalog.with_tokens(p), "bl", Page(1, 50)).select("id", "category", "title")


_RESOLVED = (
    with_tables("std", "files", "asked")
    + r""", k AS (SELECT row, query, regexp_replace(upper(query), '[\s/／－—-]+', '', 'g') AS c FROM asked),
    m AS (SELECT k.row, k.query, s.id AS base_id, s.std_id FROM k LEFT JOIN std s ON regexp_replace(upper(s.std_id), '[\s/／－—-]+', '', 'g') = k.c),
    r AS (SELECT m.*, (SELECT min(file_name) FROM files f WHERE f.base_id = m.base_id) AS file_name FROM m),
    res AS (SELECT *, CASE WHEN base_id IS NULL THEN 'not_found' WHEN file_name IS NULL THEN 'no_pdf' ELSE 'ok' END AS status FROM r) """
)


def _results(spark: SparkSession, d: str) -> DataFrame:
    return batch.reconciled(B.asked(spark, d), B.standards(spark, d), B.files(spark, d))


@query(_RESOLVED + r"SELECT row, query, status, base_id, std_id, file_name, CASE WHEN status = 'ok' THEN replace(regexp_replace(std_id, '[<>:\x22/\\|?*]', '_', 'g'), ' ', '') || '_' || file_name END AS zip_name FROM res")
def batch_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


_SERVED = _RESOLVED + r""", lst AS (SELECT file_path AS path FROM files WHERE base_id % 3 <> 0 AND base_id % 8 <> 1
        UNION ALL SELECT 'scan/GBT' || (o_orderkey + 100000000) || '-' || year(o_orderdate) || '.pdf' FROM orders WHERE o_orderkey % 10 = 0
        UNION ALL SELECT 'scan/no ' || upper(replace(std_id, '/', '')) || ' copy.pdf' FROM std WHERE id % 24 = 1),
    own AS (SELECT m.row, min({'n': f.file_name, 'i': f.id, 'p': f.file_path}) AS f FROM m JOIN files f USING (base_id) WHERE base_id % 3 <> 0 AND base_id % 8 <> 1 GROUP BY m.row),
    nm AS (SELECT path, regexp_replace(regexp_replace(upper(regexp_extract(path, '([^/]*)[.]pdf$', 1)), '_[FTZX]_', '_', 'g'), '[\s/／－—-]+', '', 'g') AS nk FROM lst),
    hit AS (SELECT row, min(path) AS path FROM (SELECT row, CASE WHEN base_id IS NULL THEN c ELSE regexp_replace(upper(std_id), '[\s/／－—-]+', '', 'g') END AS code FROM m JOIN k USING (row) WHERE row NOT IN (SELECT row FROM own)) w JOIN nm ON contains(nk, code) GROUP BY row),
    got AS (SELECT m.row, m.query, m.base_id, CASE WHEN base_id IS NULL AND hit.row IS NOT NULL THEN trim(m.query) ELSE m.std_id END AS std_id,
        CASE WHEN own.row IS NOT NULL THEN 'index' WHEN hit.row IS NOT NULL THEN CASE WHEN base_id IS NULL THEN 'disk_only' ELSE 'disk' END END AS source, coalesce(own.f.p, hit.path) AS path FROM m LEFT JOIN own USING (row) LEFT JOIN hit USING (row)) """


@query(_SERVED + "SELECT row, query, CASE WHEN source IS NOT NULL THEN 'ok' WHEN base_id IS NULL THEN 'not_found' ELSE 'no_pdf' END AS status, source, base_id, std_id, path FROM got")
def batch_served(spark: SparkSession, d: str) -> DataFrame:
    files, std, listing = _on_disk(spark, d)
    return batch.served(B.asked(spark, d), std, files, listing).select("row", "query", "status", "source", "base_id", "std_id", "path")


_ENTRY = r"replace(regexp_replace(std_id, '[<>:\x22/\\|?*]', '_', 'g'), ' ', '') || '_' || regexp_extract(path, '([^/]*)$', 1)"
_STATED = _SERVED + rf""", st AS (SELECT *, CASE WHEN source IS NOT NULL THEN 'ok' WHEN base_id IS NULL THEN 'not_found' ELSE 'no_pdf' END AS status, {_ENTRY} AS zip_name FROM got),
    told AS (SELECT *, CASE status WHEN 'not_found' THEN '未找到匹配标准' WHEN 'no_pdf' THEN '已匹配标准但未找到 PDF' END AS message FROM st) """


@query(_STATED + "SELECT row, query, status, std_id, zip_name, message FROM told ORDER BY row LIMIT 400")
def upload_preview(spark: SparkSession, d: str) -> DataFrame:
    """A preview shows as many requests as an upload may have."""
    files, std, listing = _on_disk(spark, d)
    return upload.preview(B.asked(spark, d), std, files, listing).select("row", "query", "status", "std_id", "zip_name", "message")


@query(_STATED + "SELECT row, status, CASE WHEN status = 'ok' THEN 'PDF/' || CASE WHEN row < 1000 THEN lpad(row::VARCHAR, 3, '0') ELSE row::VARCHAR END || '_' || zip_name END AS zip_entry, message FROM told")
def bundle_plan(spark: SparkSession, d: str) -> DataFrame:
    files, std, listing = _on_disk(spark, d)
    plan = bundles.planned(batch.served(B.asked(spark, d), std, files, listing))
    return plan.select("row", "status", "zip_entry", bundles.message(F.col("status")).alias("message"))


@query("""WITH u AS (SELECT o_orderkey + 4 AS row, 'GB/T ' || o_orderkey || '-2020' AS q FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT 'csv' AS source, 3::BIGINT AS header_row, 1 AS std_col, 2 AS name_col, NULL::INTEGER AS remark_col, least(count(*), 400) AS total_rows, count(*) > 400 AS truncated, 400 AS max_rows FROM u""")
def upload_meta(spark: SparkSession, d: str) -> DataFrame:
    return upload.meta(_uploaded(spark, d), "csv")


def _on_disk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, standards and a listing that lacks the files of some standards, has copies under other names for a part of these, and holds files of unknown codes."""
    files, std, o = B.files(spark, d, once=True), B.standards(spark, d), B.table(spark, d, "orders")
    odd = o.filter("o_orderkey % 10 = 0").select(F.concat(F.lit("scan/GBT"), F.col("o_orderkey") + 100_000_000, F.lit("-"), F.year("o_orderdate"), F.lit(".pdf")).alias("path"))
    stray = std.filter("id % 24 = 1").select(F.concat(F.lit("scan/no "), F.upper(F.replace("std_id", F.lit("/"), F.lit(""))), F.lit(" copy.pdf")).alias("path"))
    return files, std, files.filter("base_id % 3 <> 0 and base_id % 8 <> 1").select(F.col("file_path").alias("path")).union(odd).union(stray)


@query(_RESOLVED + "SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS success, count(*) FILTER (status <> 'ok') AS failed FROM res")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return batch.summary(_results(spark, d))


@query(_RESOLVED + "SELECT row, query FROM res WHERE base_id IS NULL")
def batch_misses(spark: SparkSession, d: str) -> DataFrame:
    return batch.misses(B.asked(spark, d), _results(spark, d))


@query(_RESOLVED + "SELECT o_orderkey - 1 AS row, CASE WHEN status = 'ok' THEN '' WHEN status IS NOT NULL THEN '否' END AS remark FROM orders LEFT JOIN res ON res.row = o_orderkey")
def batch_annotate(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "orders").select((F.col("o_orderkey") - 1).alias("row"))
    return batch.annotated(rows, _results(spark, d))


@query(_RESOLVED + "SELECT row, CASE WHEN status = 'ok' THEN '✓' ELSE '✗' END || ' 第' || row || '行 | 查询：' || query || ' | ' || coalesce(std_id, '-') || ' | ' || status AS value FROM res")
def manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    return batch.manifest_lines(_results(spark, d))


@query("""WITH u AS (SELECT o_orderkey AS k, 'GB/T ' || o_orderkey || '-2020' AS code FROM orders)
    SELECT k + 4 AS row, code AS query, 'name ' || k AS name_hint FROM u WHERE k % 13 <> 0 ORDER BY row LIMIT 400""")
def upload_requests(spark: SparkSession, d: str) -> DataFrame:
    return batch.requests(_uploaded(spark, d))


def _uploaded(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an upload with every order: a title, a blank line, a header, and the codes, some of them too short."""
    k = F.col("o_orderkey")
    body = B.table(spark, d, "orders").select((k + 3).alias("row"), F.array(k.cast("string"), F.when(k % 13 == 0, "12").otherwise(F.concat(F.lit("GB/T "), k, F.lit("-2020"))), F.concat(F.lit("name "), k)).alias("cells"))
    head = spark.createDataFrame([(0, ["x", "标准清单", ""]), (1, []), (2, ["no", "标准号", "标准名称"])], "row long, cells array<string>")
    return head.union(body)


def spelt_files(spark: SparkSession, d: str) -> DataFrame:
    """File names for every order's code: alone, within other words, in other signs, as a part of a query, and no PDF."""
    o = B.table(spark, d, "orders")
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    n = F.when(k % 5 == 0, k + 100_000_000).otherwise(k)
    code, way = F.concat(F.lit("GB/T"), n, F.lit("-"), year), k % 6
    name = (
        F.when(way == 0, F.concat(code, F.lit(".pdf"))).when(way == 1, F.concat(F.lit("old "), code, F.lit(" final.PDF"))).when(way == 2, F.concat(F.lit("版GB／T版"), n, F.lit("_-"), year, F.lit(".pdf")))
        .when(way == 3, F.concat(n, F.lit("-"), year, F.lit(".pdf"))).when(way == 4, F.concat(code, F.lit(".doc"))).otherwise(F.concat(F.lit("x"), k, F.lit(".pdf")))
    )
    return o.select(k.alias("ord"), name.alias("file_name"))


#: Names that hold a key meet it by its first eight characters, or by the whole of a shorter one.
_HOLDS = "SELECT DISTINCT a.{s}, b.{b} FROM (SELECT DISTINCT {s} FROM {ts} WHERE {s} <> '') a JOIN (SELECT {b}, unnest(list_distinct(flatten(list_transform(range(1, 9), lambda w: list_transform(range(1, greatest(len({b}) - w, -1) + 2), lambda i: substr({b}, i, w)))))) AS part FROM (SELECT DISTINCT {b} FROM {tb})) b ON b.part = left(a.{s}, 8) AND contains(b.{b}, a.{s})"
_KEYED = "translate(upper(regexp_replace({x}, '[\\s　]+', '', 'g')), '／—', '/-')"


@query(
    with_tables("asked")
    + rf""", n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS n, year(o_orderdate) AS y FROM orders),
    f AS (SELECT k AS ord, CASE k % 6 WHEN 0 THEN 'GB/T' || n || '-' || y || '.pdf' WHEN 1 THEN 'old GB/T' || n || '-' || y || ' final.PDF' WHEN 2 THEN '版GB／T版' || n || '_-' || y || '.pdf' WHEN 3 THEN n || '-' || y || '.pdf'
        WHEN 4 THEN 'GB/T' || n || '-' || y || '.doc' ELSE 'x' || k || '.pdf' END AS file_name FROM n),
    nk AS (SELECT *, regexp_replace(k, '[^A-Z0-9/-]', '', 'g') AS c2 FROM (SELECT ord, file_name, {_KEYED.format(x="regexp_replace(file_name, '(?i)[.]pdf$', '')")} AS k FROM f WHERE regexp_matches(file_name, '(?i)[.]pdf$'))),
    qk AS (SELECT *, regexp_replace(q, '[^A-Z0-9/-]', '', 'g') AS c FROM (SELECT row, {_KEYED.format(x='query')} AS q FROM asked)),
    long AS (SELECT * FROM qk WHERE len(c) >= 4),
    one AS ({_HOLDS.format(s='q', ts='qk', b='k', tb='nk')}), two AS ({_HOLDS.format(s='k', ts='nk', b='q', tb='qk')}), three AS ({_HOLDS.format(s='c', ts='long', b='c2', tb='nk')}),
    every AS (SELECT row, 0 AS tier, ord, file_name FROM qk JOIN nk ON q = k UNION ALL SELECT row, 1, ord, file_name FROM qk JOIN one USING (q) JOIN nk USING (k)
        UNION ALL SELECT row, 1, ord, file_name FROM qk JOIN two USING (q) JOIN nk USING (k) UNION ALL SELECT row, 2, ord, file_name FROM long JOIN three USING (c) JOIN nk USING (c2))
    SELECT row, tier, file_name FROM every QUALIFY row_number() OVER (PARTITION BY row ORDER BY tier, ord, file_name) = 1"""
)
def fuzzy_file_match(spark: SparkSession, d: str) -> DataFrame:
    return found.fuzzy(B.asked(spark, d), spelt_files(spark, d)).select("row", "tier", "file_name")


@query(with_tables("files") + "SELECT base_id, file_name, min(file_path) AS path FROM files GROUP BY ALL")
def file_by_name(spark: SparkSession, d: str) -> DataFrame:
    files = B.files(spark, d)
    names = files.select("base_id", F.upper("file_name").alias("file_name")).distinct()
    out = found.by_name(names, files.select(F.col("file_path").alias("path")))
    return out.select("base_id", F.regexp_replace(F.replace("file_name", F.lit(".PDF"), F.lit(".pdf")), "x^", "").alias("file_name"), "path")


@query(with_tables("files") + ", c AS (SELECT DISTINCT base_id AS id, 'GBT' || base_id || '_' AS code FROM files) SELECT c.id, file_path AS path FROM c JOIN files ON contains(file_name, code) QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY file_path) <= 10")
def files_holding_code(spark: SparkSession, d: str) -> DataFrame:
    files = B.files(spark, d)
    standards = files.select(F.col("base_id").alias("id"), F.concat(F.lit("GB/T "), "base_id", F.lit("_")).alias("std_id")).distinct()
    return found.holding_code(standards, files.select(F.col("file_path").alias("path"))).select("id", "path")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return found.first_of(B.table(spark, d, "events"), F.col("user_id"), F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_merged(spark: SparkSession, d: str) -> DataFrame:
    """The events as three batches that arrive in no order of time, merged by bucket."""
    events = B.table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    target = f"{shared_folder(spark)}/merged-{uuid4().hex}"
    for n in range(3):
        freshness.merge_latest(events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n), "user_id", "at", target, n, buckets=16)
    return freshness.latest(spark, target).select("user_id", "event_id", "event_type", "value")


@query("SELECT p_partkey AS id, CASE WHEN n = 1 THEN p_name || '.pdf' ELSE p_name || '_' || n || '.pdf' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".pdf")).alias("name"))
    return display.unique_names(p, "name", "id")


@query("SELECT 3 * p_partkey + w AS id, p_partkey || CASE w WHEN 0 THEN '.pdf' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN '_2.pdf' ELSE '_2_2.pdf' END ELSE CASE WHEN p_partkey % 2 = 0 THEN '_3.pdf' ELSE '_2.pdf' END END AS name FROM part, range(3) t(w)")
def unique_names_collide(spark: SparkSession, d: str) -> DataFrame:
    """Of a.pdf, a.pdf and a_2.pdf the second one's number is taken, or, where it comes later, takes that of the third."""
    p = B.table(spark, d, "part").select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("w"))
    k, even = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    given = F.when((F.col("w") == 0) | (even & (F.col("w") == 2)) | (~even & (F.col("w") == 2)), F.concat(k, F.lit(".pdf"))).otherwise(F.concat(k, F.lit("_2.pdf")))
    order = F.when(~even & (F.col("w") == 1), 2).when(~even & (F.col("w") == 2), 1).otherwise(F.col("w"))
    named = p.select((3 * k + F.col("w")).alias("id"), (3 * k + order).alias("place"), given.alias("name"))
    return display.unique_names(named, "name", "place").select("id", "name")


@query(_RESOLVED + "SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS success, count(*) FILTER (status <> 'ok') AS failed, least(count(*), 5000) AS listed, greatest(count(*) - 5000, 0) AS left_out FROM res")
def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    return export.manifest(_results(spark, d), "now").select("total", "success", "failed", F.size("results").cast("long").alias("listed"), "left_out")


@query(with_tables("std") + r"SELECT id, left(replace(regexp_replace(std_id, '[<>:\x22/\\|?*]', '_', 'g'), ' ', ''), 80) || '_' || coalesce(regexp_replace(std_chinesename, '[<>:\x22/\\|?*]', '_', 'g'), 'none') || '.doc' AS name FROM std")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.coalesce("std_chinesename", F.lit("none")), F.lit(".doc"))
    return B.standards(spark, d).select("id", display.safe_name(F.col("std_id"), name).alias("name"))


@query(with_tables("files") + "SELECT key, min(id) AS id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'path:' || lower(file_path) WHEN id % 3 = 1 THEN 'name:' || lower(file_name) ELSE 'id:' || id END AS key FROM files) GROUP BY key")
def file_dedupe(spark: SparkSession, d: str) -> DataFrame:
    way = F.col("id") % 3
    key = found.dedupe_key(F.when(way == 0, F.col("file_path")), F.lit(None).cast("string"), F.when(way == 1, F.col("file_name")).otherwise(""), F.col("id"))
    keyed = B.files(spark, d).select("id", key.alias("key"))
    return found.first_of(keyed, F.col("key"), F.col("id")).select("key", "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN left('spring ' || year(o_orderdate), 10) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown FROM orders")
def date_display(spark: SparkSession, d: str) -> DataFrame:
    way, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    given = F.when(way == 0, F.date_format(day, "yyyy-MM-dd HH:mm")).when(way == 1, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.concat(F.lit("spring "), F.year(day)))
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), display.date_label(given).alias("shown"))


_SIZE = "(p_partkey * p_partkey * 977 + 1)"


@query(f"SELECT p_partkey AS id, CASE WHEN {_SIZE} < 1024 THEN {_SIZE} || ' B' WHEN {_SIZE} < 1048576 THEN printf('%.1f KB', {_SIZE} / 1024.0) WHEN {_SIZE} < 1073741824 THEN printf('%.1f MB', {_SIZE} / 1048576.0) ELSE printf('%.1f GB', {_SIZE} / 1073741824.0) END AS shown FROM part")
def size_display(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_partkey") * F.col("p_partkey") * 977 + 1
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), display.size_label(size).alias("shown"))


@query(with_tables("areas") + "SELECT area_code, province_name || '_' || city_name AS label FROM areas")
def region_label(spark: SparkSession, d: str) -> DataFrame:
    return B.areas(spark, d).select("area_code", display.region_label(F.col("province_name"), F.col("city_name"), F.col("county_name")).alias("label"))


@query(with_tables("named") + "SELECT id, std_id, std_chinesename, (CASE WHEN std_chinesename ILIKE '%gear%' THEN 2 ELSE 0 END + CASE WHEN std_chinesename ILIKE '%bolt%' THEN 1 ELSE 0 END + CASE WHEN std_chinesename ILIKE '%ring%' THEN 1 ELSE 0 END) AS score FROM named WHERE std_chinesename ILIKE '%gear%' OR std_chinesename ILIKE '%bolt%' OR std_chinesename ILIKE '%ring%' ORDER BY score DESC, std_id, id LIMIT 50")
def search_product_page(spark: SparkSession, d: str) -> DataFrame:
    return search.product_page(B.named(spark, d), B.named_files(spark, d), B.clusters(spark, d), "gear", Page(1, 50), with_file=False).select(*_SHOWN, "score")


@query(with_tables("brands") + _HIT.format(q="'red widget'") + f"SELECT word FROM ({_ONCE.format(w='w')})")
def expand_keywords(spark: SparkSession, d: str) -> DataFrame:
    return facets.expanded(B.brand_groups(spark, d), "red widget").select("word")


@query(with_tables("groups") + """, q AS (SELECT p_partkey AS row, replace(p_name, ' ', '') AS q FROM part), k AS (SELECT id, replace(unnest([name] || keywords), ' ', '') AS k FROM groups)
    SELECT DISTINCT row, id FROM q JOIN k ON contains(q.q, k.k) OR contains(k.k, q.q)""")
def cluster_match(spark: SparkSession, d: str) -> DataFrame:
    return facets.matched(B.table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_name").alias("query")), B.clusters(spark, d))


@query("""WITH l AS (SELECT user_id, event_type, max(struct_pack(ts, event_id)) AS newest FROM events GROUP BY ALL)
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC) AS place FROM l QUALIFY place <= 8""")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    return facets.recent(B.table(spark, d, "events"), "user_id", "event_type", F.col("ts"), F.col("event_id")).select("user_id", "event_type", "place")


@query(with_tables("std") + "SELECT ex_state, CASE ex_state WHEN 0 THEN '废止' WHEN 1 THEN '现行' ELSE '即将实施' END AS label, count(*) AS n FROM std GROUP BY ex_state")
def state_options(spark: SparkSession, d: str) -> DataFrame:
    return facets.state_options(B.standards(spark, d))


@query(with_tables("std") + "SELECT id, std_id, list_position([40, 7, 12, 3], id) AS place FROM std WHERE id IN (40, 7, 12, 3)")
def bulk_ids(spark: SparkSession, d: str) -> DataFrame:
    return search.by_id(B.standards(spark, d), [40, 7, 0, -3, 40, 12, 3]).select("id", "std_id", "place")


@query(with_tables("std") + "SELECT id, std_id FROM std WHERE id = 77")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return B.standards(spark, d).filter("id = 77").limit(1).select("id", "std_id")


@query("""SELECT page_id, CASE WHEN e = '.html' THEN '文件' ELSE 'PDF' END AS label FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.PDF' END AS e FROM pages)""")
def catalog_items(spark: SparkSession, d: str) -> DataFrame:
    ext = F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".PDF")
    return catalog.with_label(B.table(spark, d, "pages").select("page_id", ext.alias("file_ext"))).select("page_id", "label")


@query(with_tables("std") + "SELECT id, CASE ex_state WHEN 1 THEN 'live' WHEN 2 THEN 'soon' ELSE 'old' END AS css FROM std")
def status_classes(spark: SparkSession, d: str) -> DataFrame:
    return B.standards(spark, d).select("id", display.status_class(F.col("ex_state")).alias("css"))


@query("SELECT s_suppkey AS id, s_name AS company FROM supplier")
def company_names(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit(" "), "s_name", F.when(F.col("s_suppkey") % 2 == 0, "。; ").otherwise(" .·"))
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), codes.clean_company(dirty).alias("company"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity::BIGINT::VARCHAR AS cell FROM lineitem")
def cell_texts(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", codes.cell_text(F.col("l_quantity")).alias("cell"))


@query("SELECT DISTINCT p_partkey AS id, unnest([p_name || '.pdf', replace(p_name, ' ', '') || '.pdf', upper(replace(p_name, ' ', '')) || '.pdf', upper(replace(p_brand, '#', '#')) || '.pdf']) AS name FROM part")
def file_name_variants(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(codes.name_variants(F.concat(F.lit("a\\b/"), "p_name"), F.col("p_brand"))).alias("name"))


@query(with_tables("files") + "SELECT id, CASE WHEN id % 2 = 0 THEN file_path ELSE file_name END AS shown FROM files")
def display_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/root/docs/"), "file_path")).otherwise(F.concat(F.lit("/other/"), "file_path"))
    return B.files(spark, d).select("id", found.shown_path(path, "/root/docs").alias("shown"))


@query(with_tables("std", "files") + """, o AS (SELECT base_id AS id, file_path AS path FROM files WHERE base_id % 2 = 0), f AS (SELECT base_id AS id, file_path AS path, row_number() OVER (PARTITION BY base_id ORDER BY file_path) AS n FROM files WHERE base_id % 2 = 1)
    SELECT id, min(path) AS path, min(source) AS source FROM (SELECT id, path, 0 AS source FROM o UNION ALL SELECT id, path, 1 FROM f) GROUP BY id""")
def picked_files(spark: SparkSession, d: str) -> DataFrame:
    files = B.files(spark, d, once=True)
    standards = files.select(F.col("base_id").alias("id")).distinct().withColumn("std_id", F.concat(F.lit("GB/T "), "id", F.lit("_")))
    own = files.filter("base_id % 2 = 0").select("base_id", "file_path", F.upper("file_name").alias("file_name"))
    return found.picked(found.collected(standards, own, files.select(F.col("file_path").alias("path"))))


@query("SELECT o_orderkey AS row, 2 AS std_col, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS name_col, CASE WHEN o_orderkey % 3 = 0 THEN 3 END AS remark_col FROM orders")
def upload_columns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cells = F.array(F.lit("编 号"), F.when(k % 2 == 0, "Title").otherwise("x"), F.lit("标准号"), F.when(k % 3 == 0, "备注栏").otherwise(""))
    return batch.column_roles(B.table(spark, d, "orders").select(k.alias("row"), cells.alias("cells")))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN '可下载' WHEN 1 THEN '未找到' WHEN 2 THEN '无 PDF' WHEN 3 THEN '空行' WHEN 4 THEN '错误' WHEN 5 THEN 'disk_only' ELSE '—' END AS label,
    CASE o_orderkey % 7 WHEN 0 THEN 'batch-ok' WHEN 1 THEN 'batch-warn' WHEN 2 THEN 'batch-warn' ELSE 'batch-fail' END AS style FROM orders""")
def batch_status_labels(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ("ok", "not_found", "no_pdf", "empty", "error", "disk_only", None))), (F.col("o_orderkey") % 7).cast("int"))
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), display.outcome_label(status).alias("label"), display.outcome_style(status).alias("style"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.get(F.array(*map(F.lit, (".PDF", ".docx", ".xlsx", ""))), (k % 4).cast("int"))
    return B.table(spark, d, "part").select(
        k.alias("id"), F.when(k % 3 != 0, F.col("p_brand")).alias("category"), F.when(k % 5 != 0, F.col("p_type")).otherwise("").alias("title"),
        F.concat("p_name", ext).alias("filename"), F.concat(F.lit("a/"), "p_name", ext).alias("rel_path"), (k * 10).alias("file_size"), ext.alias("file_ext"),
    )


_KEPT = "WITH kept AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS category, CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE '' END AS title, p_name || ext AS filename, ext FROM (SELECT *, ['.PDF', '.docx', '.xlsx', ''][p_partkey % 4 + 1] AS ext FROM part)) "


@query(_KEPT + "SELECT id, coalesce(category, '—') AS std_id, coalesce(nullif(title, ''), filename) AS name, CASE lower(ext) WHEN '.pdf' THEN 'PDF' WHEN '.docx' THEN 'DOC' WHEN '' THEN '文件' ELSE upper(ext[2:]) END AS label, ext = '.PDF' AS has_pdf, filename AS file FROM kept")
def catalog_results(spark: SparkSession, d: str) -> DataFrame:
    return catalog.items(_kept(spark, d), "kept").select("id", "std_id", F.col("std_chinesename").alias("name"), F.col("std_status").alias("label"), "has_pdf", F.col("files")[0]["file_name"].alias("file"))


@query(_KEPT + "SELECT place, w.id, CASE WHEN k.id IS NULL THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN ext = '.PDF' THEN 'PDF/' ELSE '文件/' END || '00' || place || '_' || filename AS zip_entry FROM (VALUES (1, 8), (2, 5), (3, 999999999), (4, 12)) w(place, id) LEFT JOIN kept k ON k.id = w.id")
def catalog_bundle(spark: SparkSession, d: str) -> DataFrame:
    return catalog.bundle_entries(_kept(spark, d), [8, 5, 0, 8, -2, 999_999_999, 12])


@query(
    with_tables("brands") + _HIT.format(q="'red widget'") + f""", o AS ({_ONCE.format(w='w')})
    SELECT 'red widget' AS query, (SELECT string_agg(word, '|' ORDER BY tier, place, pos) FROM o) AS keywords, coalesce((SELECT string_agg(name, '|' ORDER BY place) FROM hit), '') AS groups,
        (SELECT count(*) FROM o) > 1 OR (SELECT count(*) FROM hit) > 0 AS expanded"""
)
def expansion_result(spark: SparkSession, d: str) -> DataFrame:
    return facets.expansion(B.brand_groups(spark, d), " red widget ").select("query", F.array_join("keywords", "|").alias("keywords"), F.array_join("groups", "|").alias("groups"), "expanded")
