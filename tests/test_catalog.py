"""Catalogue operators on small tables: full text against SQLite's FTS5, prefix join, dumps, uploads, export, streams."""

import random
import re
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import display
from quillon.operators import batch, catalog, facets, files, geo, search
from quillon.plans.intent import Filters, Page
from quillon.sinks import export
from quillon.sources import dump, listing
from quillon.streaming import freshness

TITLES = [(1, "餐饮服务规范", "a", "x"), (2, "服务 guide for Users", "b", "y-z"), (3, "GB/T 12-2020 Plug", "c", "été"), (4, "user's guide", "d", "")]


def test_full_text_equals_fts5(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, category, filename)")
    con.executemany("INSERT INTO f(rowid, title, category, filename) VALUES (?, ?, ?, ?)", TITLES)
    df = catalog.with_tokens(spark.createDataFrame(TITLES, "id int, title string, category string, filename string"))
    for text in ("服务", "餐饮", "gui", "user", "GB/T", "12-2020", "guide for", "y-z", "x y", "plug 服", "nothing"):
        match = " OR ".join('"' + w.replace('"', '""') + '"*' for w in text.split()[:8])
        want = {r[0] for r in con.execute("SELECT rowid FROM f WHERE f MATCH ?", (match,))}
        assert {r["id"] for r in catalog.full_text(df, text).collect()} == want, text
    assert catalog.full_text(df, " ").count() == 4 and catalog.full_text(df, "--").count() == 0


def test_prefix_join_takes_the_longest_area(spark):
    areas = spark.createDataFrame([("35", "福建", None, None), ("3501", "福建", "福州", None), ("350102", "福建", "福州", "鼓楼"), ("350103", "福建", "福州", "台江"), ("11", "", None, None)], "area_code string, province_name string, city_name string, county_name string")
    units = spark.createDataFrame([(1, "a", "35"), (2, "b", "350103"), (3, "c", None), (4, "d", ""), (5, "e", "99"), (6, "f", "11")], "unit_id long, unit_name string, area_code string")
    rel = spark.createDataFrame([(10, u) for u in (1, 2, 3, 4, 5, 6)] + [(10, 1)], "base_id long, unit_id long")
    got = {(r["unit_id"], r["county_name"]) for r in geo.materialize(rel, units, areas).collect()}
    assert got == {(1, "鼓楼"), (2, "台江")}


def test_empty_asks_find_nothing(spark, sf_dir):
    from quillon.plans import binding as B

    base, fs = B.named(spark, sf_dir), B.named_files(spark, sf_dir)
    assert search.text_page(base, fs, " ").count() == 0
    assert search.advanced_page(base, fs, "", Filters()).count() == 0
    assert search.best_match(base, "").count() == 0 and search.prioritised(base, "").count() == 0
    assert facets.suggest_companies(B.units(spark, sf_dir), "a").count() == 0
    with pytest.raises(ValueError, match="geo"):
        search.filtered(base, fs, Filters(city="x"))
    with pytest.raises(ValueError, match="province"):
        geo.export_ids(base, fs, "")


def test_dump(spark, tmp_path):
    assert list(dump.tuples(r"(1,'It''s','350100'),(2,'a\'b',NULL),(3,'x),(y','null');")) == [["1", "It's", "350100"], ["2", "a'b", None], ["3", "x),(y", None]]
    (tmp_path / "d.sql").write_text("-- c\nINSERT INTO `unit_dict` VALUES (1,'It''s','35'),(2,'b',NULL);\nINSERT INTO `unit_dict` (`unit_id`,`unit_name`,`area_code`) VALUES (1,'new','36');\nINSERT INTO `other` VALUES (9,'x','y');\n")
    parsed = dump.table_of(dump.rows(spark, str(tmp_path / "d.sql"), "unit_dict"), "unit_dict")
    got = {(r["unit_id"], r["unit_name"], r["area_code"]) for r in dump.upserted(parsed, "unit_id").collect()}
    assert got == {(1, "new", "36"), (2, "b", None)}


def test_dump_of_standards_rejects_repeats(spark, tmp_path):
    row = "({i},'GB/T {c}','t',0,0,'name',0,'2020-01-01','2020-02-01',0,'ok',1)"
    (tmp_path / "a.sql").write_text("INSERT INTO `std_base` VALUES " + row.format(i=1, c=1) + "," + row.format(i=2, c=2) + ",(3,'short');\n")
    assert [(r["id"], r["std_id_norm"]) for r in dump.standards(spark, str(tmp_path / "a.sql")).orderBy("id").collect()] == [(1, "GB/T1"), (2, "GB/T2")]
    (tmp_path / "b.sql").write_text("INSERT INTO `std_base` VALUES " + row.format(i=1, c=1) + "," + row.format(i=2, c=1) + ";\n")
    with pytest.raises(ValueError, match="std_id"):
        dump.standards(spark, str(tmp_path / "b.sql"))


def test_listing_and_resolution(spark, tmp_path):
    for p in ("a/One.PDF", "a/b/GBT12_F_x.pdf", "c.doc", "skip.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    found = listing.files(spark, str(tmp_path), (".pdf", ".doc"))
    assert sorted(r["rel_path"] for r in found.collect()) == ["a/One.PDF", "a/b/GBT12_F_x.pdf", "c.doc"]
    assert listing.newest(spark, str(tmp_path), "*.txt").endswith("skip.txt") and listing.newest(spark, str(tmp_path), "*.none") is None
    parsed = {r["rel_path"]: (r["category"], r["title"], r["file_ext"]) for r in catalog.by_folder(found).collect()}
    assert parsed["a/One.PDF"] == ("a", "One", ".pdf") and parsed["c.doc"] == ("根目录", "c", ".doc")
    both = files.inventory(found, found)
    assert both.count() == 3
    asked = spark.createDataFrame([("x/none.pdf", "one.pdf"), ("q", "r")], "file_path string, file_name string")
    assert sorted(str(r["path"])[-7:] for r in files.resolved(asked, both).collect()) == ["None", "One.PDF"]
    std = spark.createDataFrame([(1, "GB/T 12"), (2, "X 1")], "id long, std_id string")
    assert [(r["id"], r["path"][-13:]) for r in files.holding_code(std, both).collect()] == [(1, "GBT12_F_x.pdf")]


def test_upload_to_bundle(spark, tmp_path):
    (tmp_path / "u.csv").write_text('﻿标准清单\nno,标准号,标准名,备注\n1,"GB/T 1002-2024","单相,插头",\n2,GB 5749-2022,水,\n3,12,,\n4,GB 9-1999,无,\n', encoding="utf-8")
    rows = listing.upload(spark, str(tmp_path / "u.csv"))
    asked = batch.requests(rows)
    assert [(r["row"], r["query"], r["name_hint"]) for r in asked.orderBy("row").collect()] == [(3, "GB/T 1002-2024", "单相,插头"), (4, "GB 5749-2022", "水"), (6, "GB 9-1999", "无")]
    base = search.with_keys(spark.createDataFrame([(1, "GB/T 1002-2024"), (2, "GB 5749-2022")], "id long, std_id string"))
    fs = spark.createDataFrame([(1, 1, "b.pdf"), (2, 1, "a.pdf")], "id long, base_id long, file_name string")
    results = batch.reconciled(asked, base, fs)
    assert [(r["row"], r["status"], r["file_name"]) for r in results.orderBy("row").collect()] == [(3, "ok", "a.pdf"), (4, "no_pdf", None), (6, "not_found", None)]
    assert batch.summary(results).first().asDict() == {"total": 3, "success": 1, "failed": 2}
    assert [r["remark"] for r in batch.annotated(rows, results).orderBy("row").collect()] == [None, None, "", "否", None, "否"]
    target = tmp_path / "b.zip"
    assert export.bundle(results, str(target), lambda p: p.encode(), "now") == 1
    with zipfile.ZipFile(target) as z:
        assert sorted(z.namelist()) == ["GB_T1002-2024_a.pdf", "manifest.json", "manifest.txt"]
    assert export.manifest(results, "now").first()["failed"] == 2


def test_guess_of_the_code_column(spark):
    rows = spark.createDataFrame([(0, ["x", "y"]), (1, ["1", "GB/T 5-2020"]), (2, ["2", "DL/T 7"])], "row int, cells array<string>")
    assert [(r["row"], r["query"]) for r in batch.requests(rows).orderBy("row").collect()] == [(2, "GB/T 5-2020"), (3, "DL/T 7")]
    assert batch.requests(rows.filter("row = 0")).count() == 0


def test_index_is_sorted_and_bucketed_joins_do_not_shuffle(spark, tmp_path, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    export.write_index(df, str(tmp_path / "i"), "o_orderkey", 2)
    assert spark.read.parquet(str(tmp_path / "i")).count() == df.count()
    for t in ("left_t", "right_t"):
        export.write_bucketed(df.select("o_orderkey", F.lit(t).alias(t)), t, "o_orderkey", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in spark.table("left_t").join(spark.table("right_t"), "o_orderkey")._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE left_t")
        spark.sql("DROP TABLE right_t")


def test_clusters(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"clusters":[{"id":"a","name":"牙膏","keywords":["牙膏","牙刷 "]},{"id":"b","name":"牛奶","keywords":["奶"]}]}')
    c = listing.clusters(spark, str(tmp_path / "c.json"))
    assert [r["word"] for r in facets.expanded(c, "牙刷").collect()] == ["牙刷", "牙膏"]
    assert [r["word"] for r in facets.suggest_phrases(c, "牛奶").collect()][:2] == ["牛奶", "奶"]


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "k long, v long, x string"
    for n, rows in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (2, 0, "z"), (3, 1, "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = freshness.keep_latest(stream, "k", "v", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    last = sorted(tmp_path.glob("out/v*"))[-1]
    assert sorted((r["k"], r["x"]) for r in spark.read.parquet(str(last)).collect()) == [(1, "c"), (2, "b"), (3, "d")]


def test_page_ends(spark, sf_dir):
    from quillon.plans import binding as B

    assert search.browse_page(B.standards(spark, sf_dir), B.files(spark, sf_dir), Page(10_000, 50)).count() == 0


def plain_key(x):
    return re.sub(r"\s+", "", x).replace("／", "/").replace("—", "-").upper()


def plain_fuzzy(query, names):
    """A PDF for a query: an equal key, then one key within the other, then the query's core within the file's."""
    q = plain_key(query)
    pdfs = [(ord_, name, plain_key(name[:-4])) for ord_, name in sorted(names) if name.lower().endswith(".pdf") and plain_key(name[:-4])]
    core = lambda x: re.sub("[^A-Z0-9/-]", "", x)
    tests = [lambda k: k == q, lambda k: q in k or k in q, lambda k: len(core(q)) >= 4 and core(q) in core(k)]
    for tier, test in enumerate(tests):
        for _, name, k in pdfs:
            if q and test(k):
                return tier, name
    return None


def test_fuzzy_by_all_tiers(spark, sf_dir):
    from quillon.plans import binding, queries

    names = [tuple(r) for r in queries.spelt_files(spark, sf_dir).collect()]
    asked = binding.asked(spark, sf_dir).limit(250)
    want = {r["row"]: m for r in asked.collect() if (m := plain_fuzzy(r["query"], names))}
    got = {r["row"]: (r["tier"], r["file_name"]) for r in queries.QUERIES["fuzzy_file_match"](spark, sf_dir).collect() if r["row"] in {x["row"] for x in asked.collect()}}
    assert got == want and {t for t, _ in want.values()} == {0, 1, 2}
    by_hand = spark.createDataFrame([(0, "GB1-1999.pdf"), (1, "x GB／T1002-2024版.pdf"), (2, "GB1-1999.doc"), (3, "a.pdf")], "ord int, file_name string")
    asked = [(1, "GB1"), (2, "插头GB/T1002-2024"), (3, ""), (4, "zzz"), (5, "GB1-1999"), (6, "a b")]
    got = {r["row"]: (r["tier"], r["file_name"]) for r in files.fuzzy(spark.createDataFrame(asked, "row int, query string"), by_hand).collect()}
    assert got == {row: m for row, q in asked if (m := plain_fuzzy(q, [tuple(r) for r in by_hand.collect()]))}


def test_uploads_with_line_ends_in_cells(spark, tmp_path):
    text = 'a,"GB/T 1-2020","line one\nline two"\r\n\r\n"say ""x"", y",,\nlast'
    (tmp_path / "u.csv").write_bytes("\ufeff".encode() + text.encode())
    got = [(r["row"], list(r["cells"])) for r in listing.parse_upload(spark, str(tmp_path / "u.csv")).collect()]
    assert got == [(0, ["a", "GB/T 1-2020", "line one\nline two"]), (2, ['say "x", y', "", ""]), (3, ["last"])]
    with pytest.raises(ValueError):
        listing.upload(spark, str(tmp_path / "u.csv"), most_bytes=10)
    with pytest.raises(ValueError):
        listing.parse_upload(spark, "x.txt")


def plain_unique(names):
    used, out = set(), []
    for name in names:
        stem, dot, suffix = name.rpartition(".")
        n, now = 1, name
        while now in used:
            n += 1
            now = f"{stem}_{n}.{suffix}" if dot and stem else f"{name}_{n}"
        used.add(now)
        out.append(now)
    return out


def test_unique_names_by_definition(spark):
    rng = random.Random(4)
    names = [rng.choice(["a", "a_2", "a_2_2", "a_3", "b", ".c", "d_x"]) + rng.choice([".pdf", ".doc", ""]) for _ in range(200)]
    got = display.unique_names(spark.createDataFrame(list(enumerate(names)), "n int, name string"), "name", "n").orderBy("n").collect()
    assert [r["name"] for r in got] == plain_unique(names) and len(set(plain_unique(names))) == 200


def test_bundle_counts_all_and_keeps_below_its_root(spark, tmp_path):
    rows = [(i, f"q{i}", "s", "ok" if i % 2 else "no_pdf", "same.pdf", f"../x{i}.pdf" if i == 3 else f"d/{i}.pdf") for i in range(20)]
    results = spark.createDataFrame(rows, "row int, query string, std_id string, status string, zip_name string, file_name string")
    assert export.manifest(results, "now", most=6).select("total", "success", "failed", "left_out").first() == (20, 10, 10, 14)
    assert [r["row"] for r in export.manifest(results, "now", most=6).first()["results"]] == list(range(6))
    assert export.bundle(results, str(tmp_path / "b.zip"), lambda p: p.encode(), "now", root="/data", most=10) == 4
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        assert [n for n in z.namelist() if n.endswith(".pdf")] == ["same.pdf", "same_2.pdf", "same_3.pdf", "same_4.pdf"]
    assert export.below("/data", "a/../b.pdf") and not export.below("/data", "../data2/b.pdf") and not export.below("/data", "/etc/x")


def test_annotated_csv(spark, tmp_path):
    sheet = spark.createDataFrame([(0, ["no", "标准号"]), (1, ["1", "GB 1"]), (2, ["2", "GB 2"])], "row int, cells array<string>")
    export.annotated_csv(sheet, spark.createDataFrame([(1, ""), (2, "否")], "row int, remark string"), str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_bytes().startswith("\ufeff".encode())
    assert (tmp_path / "o.csv").read_text(encoding="utf-8-sig").splitlines() == ["no,标准号,备注", "1,GB 1,", "2,GB 2,否"]


def test_ids_beyond_32_bits(spark):
    base = spark.createDataFrame([(5_000_000_000, "a"), (3, "b")], "id long, std_id string")
    assert [r["id"] for r in search.by_id(base, [3, 5_000_000_000]).collect()] == [3, 5_000_000_000]


def test_filters_are_counted():
    assert Filters().count == 0 and not Filters().active
    f = Filters(states=(1,), company="x", rank=2, province="p", county="c")
    assert f.count == 5 and f.active and f.without_place() == Filters(states=(1,), company="x", rank=2)
    assert Filters(company="x", rank_over_three=True).count == 2


def test_served_requests_in_every_state(spark):
    from quillon.operators import batch, search

    base = search.with_keys(spark.createDataFrame([(1, "GB/T 1-2001"), (2, "GB/T 22-2002"), (3, "GB/T 333-2003")], "id long, std_id string"))
    fs = spark.createDataFrame([(9, 1, "b/z.pdf", "z.pdf"), (8, 1, "a/Y.pdf", "Y.pdf"), (7, 2, "gone.pdf", "gone.pdf")], "id long, base_id long, file_path string, file_name string")
    listing = spark.createDataFrame([("b/z.pdf",), ("other/y.PDF",), ("scan/GBT 22—2002 copy.pdf",), ("scan/QX9999A.pdf",)], "path string")
    asked = spark.createDataFrame([(1, "gbt1-2001"), (2, "GB/T 22-2002"), (3, "GB/T 333-2003"), (4, " Q/X 9999A "), (5, "Q/X 1"), (6, "  "), (7, None), (8, "gbt1-2001")], "row long, query string")
    got = {r["row"]: (r["status"], r["source"], r["base_id"], r["path"]) for r in batch.served(asked, base, fs, listing).collect()}
    first = ("ok", "index", 1, "other/y.PDF")
    assert got == {
        1: first, 2: ("ok", "disk", 2, "scan/GBT 22—2002 copy.pdf"), 3: ("no_pdf", None, 3, None), 4: ("ok", "disk_only", None, "scan/QX9999A.pdf"),
        5: ("not_found", None, None, None), 6: ("empty", None, None, None), 7: ("empty", None, None, None), 8: first,
    }
    assert batch.served(asked.limit(0), base, fs, listing).count() == 0
    assert batch.served(asked, base, fs, listing.limit(0)).filter("status = 'ok'").count() == 0


def test_regional_search_keeps_the_company_to_the_region(spark):
    from quillon.operators import geo
    from quillon.plans.intent import Filters

    with pytest.raises(ValueError):
        geo.regional(None, None, None, Filters(city="x"))
    ranked = Filters(province="p", company="c", rank=1)
    assert ranked.without_place().company == "c" and Filters(province="p", company="c").without_place() == Filters()


def test_expansion_of_a_blank_or_unknown_text(spark):
    from quillon.operators import facets

    groups = spark.createDataFrame([("a", "", ["bolt", "nut"])], "id string, name string, keywords array<string>")
    rows = [tuple(facets.expansion(groups, t).first()) for t in ("nut", "", "zzz")]
    assert rows == [("nut", ["nut", "bolt"], ["a"], True), ("", [], [], False), ("zzz", ["zzz"], [], False)]
