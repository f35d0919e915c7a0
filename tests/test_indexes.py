"""Snapshots in buckets, catalogue refresh, postings and merges of arriving rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog, postings, refresh
from quillon.sinks import snapshots
from quillon.streaming import freshness

WORDS = ["bolt", "Ring", "gear-box", "Été", "漢字服务", "of", "the", "a", "x1"]


def listing(spark, rows):
    return spark.createDataFrame([(*r,) for r in rows], "rel_path string, file_size long, mtime long")


def made(rng, n):
    return {f"{rng.choice(['', 'a/', 'b/c/', 'd/'])}{' '.join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4)))} {i}.pdf": (rng.randrange(100), rng.randrange(10)) for i in range(n)}


def table(df):
    return sorted(map(tuple, df.select(*refresh.COLUMNS).collect()))


TEXTS = ["bolt", "ri", "gear-box", "of-th", "the-a", "été x", "漢字", "字", "a-a", "--", "", "x1-b", "gear-gear-box-of"]


def test_refresh_equals_a_full_build(spark, tmp_path):
    rng = random.Random(5)
    state = made(rng, 60)
    folder = str(tmp_path / "catalog")
    seen = set()
    for step in range(5):
        rows = [(p, *v) for p, v in state.items()]
        before = snapshots.current(spark, folder)
        notes = refresh.refresh(listing(spark, rows), folder, "/data", f"2024-01-0{step + 1} 00:00:00", buckets=4, most_segments=3)
        full = refresh.entries(listing(spark, rows))
        assert table(refresh.files(spark, folder)) == table(full) and notes["total"] == len(rows)
        tokens = catalog.with_tokens(full)
        for text in TEXTS if step == 4 else TEXTS[step :: 4]:
            assert table(refresh.search(spark, folder, text)) == table(catalog.full_text(tokens, text)), text
        seen.add(len(notes["segments"]))
        if step:
            assert (notes["added"], notes["changed"], notes["removed"]) == expected
            after = snapshots.current(spark, folder)
            assert {b for b, v in after.buckets.items() if before.buckets.get(b) != v} <= touched
        gone, altered = rng.sample(sorted(state), 3), rng.sample(sorted(state), 6)
        state = {p: v for p, v in state.items() if p not in gone}
        changed = [p for p in altered if p in state][: 3 if step != 2 else 0]
        state |= {p: (state[p][0] + 1, state[p][1]) for p in changed}
        more = {f"new {step} bolt.pdf": (1, 1), f"d/new {step} of the.pdf": (1, 1)}
        state |= more
        expected = (len(more), len(changed), 3)
        place = F.pmod(F.xxhash64(F.regexp_extract("p", "^(.*)/[^/]*$", 1)), F.lit(4)).cast("string")
        touched = {r[0] for r in spark.createDataFrame([(p,) for p in [*gone, *changed, *more]], "p string").select(place).collect()}
    assert max(seen) == 3 and 1 in seen
    assert refresh.status(spark, folder, "2024-01-05 00:00:09").first().asDict() == {"ready": True, "built_at": "2024-01-05 00:00:00", "root": "/data", "total": len(rows), "added": 2, "changed": notes["changed"], "removed": 3, "age_seconds": 9}


def test_refresh_of_nothing_and_without_change(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert refresh.status(spark, folder).first()["ready"] is False
    with pytest.raises(ValueError):
        refresh.files(spark, folder)
    empty = listing(spark, [])
    assert refresh.refresh(empty, folder, "/", "t0")["total"] == 0 and refresh.files(spark, folder).count() == 0 and refresh.search(spark, folder, "a").count() == 0
    one = listing(spark, [("a/x.pdf", 1, 1), ("a/x.pdf", 2, 3), (None, 1, 1)])
    assert refresh.refresh(one, folder, "/", "t1")["added"] == 1
    assert refresh.refresh(one, folder, "/", "t2") | {"x": 0} == refresh.refresh(one, folder, "/", "t2") | {"x": 0}
    assert [tuple(r) for r in refresh.files(spark, folder).select("rel_path", "file_size").collect()] == [("a/x.pdf", 2)]
    assert refresh.refresh(empty, folder, "/", "t3")["removed"] == 1 and refresh.files(spark, folder).count() == 0 and refresh.search(spark, folder, "x").count() == 0


def test_a_broken_write_is_not_seen_and_two_writers_clash(spark, tmp_path):
    folder = str(tmp_path / "t")
    df = spark.range(10).withColumn("bucket", (F.col("id") % 3).cast("string"))
    first = snapshots.replace(df, folder, None, {}, None)
    df.filter("bucket = '1'").write.partitionBy("bucket").parquet(f"{folder}/v=1")  # broke off before it was published
    assert snapshots.rows(spark, folder, snapshots.current(spark, folder)).count() == 10
    snapshots.replace(df.filter("bucket = '2'").limit(1), folder, ["2"], {}, first)
    assert snapshots.rows(spark, folder, snapshots.current(spark, folder)).count() == 8
    with pytest.raises(RuntimeError):
        snapshots.replace(df, folder, ["0"], {}, first)


def test_postings_read_only_what_a_prefix_needs(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("filename"))
    path = str(tmp_path / "p")
    postings.write(postings.of(docs, fields=("filename",)), path, files=16)
    placed = spark.read.parquet(path)
    found = postings.matching(placed, "worthl")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,worthl)" in text
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        narrow = postings.matching(placed, "worthl")
        narrow.collect()
        plan = narrow._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        read = leaves.apply(0).metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert read < placed.count() / 10
    spread = catalog.with_tokens(docs, ("filename",))
    for words in ("worthl thanon", "of-th", "the"):
        want = {r["id"] for r in catalog.full_text(spread, words, ("filename",)).collect()}
        assert {r["id"] for r in postings.search(docs, placed, words).collect()} == want


def test_arriving_rows_rewrite_only_their_buckets(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = spark.range(10_000).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.lit("old").alias("x"))
    by = F.floor(F.col("k") / 100)
    assert len(freshness.merge_latest(rows, "k", "v", target, 0, by)) == 100
    batch = spark.range(4200, 4300).select(F.col("id").alias("k"), F.when(F.col("id") < 4250, 2).otherwise(0).alias("v"), F.lit("new").alias("x"))
    assert freshness.merge_latest(batch, "k", "v", target, 1, by) == ["42"]
    now = snapshots.current(spark, target)
    assert sum(v == 1 for v in now.buckets.values()) == 1
    assert {(r["x"], r["count"]) for r in freshness.latest(spark, target).groupBy("x").count().collect()} == {("old", 9950), ("new", 50)}
    assert freshness.merge_latest(batch.withColumn("v", F.lit(9)), "k", "v", target, 1, by) == []  # the same batch again
    odd = spark.createDataFrame([(None, 1, "n"), (None, 2, "m"), (1, None, "null version"), (2, 1, "tie"), (2, 1, "tie")], "k long, v int, x string")
    freshness.merge_latest(odd, "k", "v", target, 2, by)
    got = {r["k"]: r["x"] for r in freshness.latest(spark, target).filter("k is null or k < 3").collect()}
    assert got == {None: "m", 0: "old", 1: "old", 2: "tie"}


def by_all_spellings(asked, base):
    """The standard of each request by joins on every spelling and key."""
    from quillon.functions import codes

    q = F.col("query")
    key = lambda tier, tag, x: F.struct(F.lit(tier).alias("tier"), F.concat(F.lit(tag), x).alias("k"))
    spelt = codes.let(codes.lookup_variants(q), lambda vs: F.concat(F.transform(vs, lambda v: key(0, "=", v)), F.transform(vs, lambda v: key(0, "n", codes.norm_key(v)))))
    tiers = F.concat(spelt, F.array(key(1, "n", codes.norm_key(q)), key(2, "c", codes.compact_key(q))))
    keys = asked.filter("trim(query) <> ''").select("row", F.explode(F.array_distinct(tiers)).alias("t")).select("row", "t.tier", "t.k")
    known = base.select("id", "std_id", F.explode(F.array(F.concat(F.lit("="), F.col("std_id")), F.concat(F.lit("n"), F.col("std_id_norm")), F.concat(F.lit("c"), codes.compact_key(F.col("std_id"))))).alias("k"))
    return keys.join(known, "k").groupBy("row").agg(F.min(F.struct("tier", "id", "std_id")).alias("b")).select("row", F.col("b.id").alias("base_id"), F.col("b.std_id").alias("std_id"))


def test_requests_meet_by_one_key_as_by_all_spellings(spark):
    from quillon.operators import batch, search

    rng = random.Random(2)
    code = lambda: f"{rng.choice(['GB/T', 'GBT', 'gb/t', 'GB', 'Q/X', 'QX', 'DB31/T', 'T/CAS'])}{rng.choice(['', ' ', '  '])}{rng.randrange(1, 5)}{rng.choice(['', '.1'])}{rng.choice(['-', '—', '－', '', ' - '])}{rng.choice(['1999', '2001', ''])}{rng.choice(['', ' ', 'A'])}"
    base = search.with_keys(spark.createDataFrame([(i, code()) for i in range(300)] + [(300, None), (301, ""), (302, "-"), (303, "GB/T 1-1999"), (304, "GB/T 1-1999")], "id long, std_id string"))
    asked = spark.createDataFrame([(i, code()) for i in range(300)] + [(300, None), (301, " "), (302, "/"), (303, "GB／T1－1999"), (304, "漢字")], "row long, query string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(batch.standard_of(asked, base)) == rows(by_all_spellings(asked, base))


@pytest.mark.parametrize("seed", range(3))
def test_containment_equals_its_definition(spark, seed):
    from quillon.operators.containment import contained

    rng = random.Random(seed)
    text = lambda most: "".join(rng.choice("ab漢😀1") for _ in range(rng.randrange(most)))
    bigs = [text(30) for _ in range(120)] + [None, ""]
    smalls = [text(rng.choice([3, 6, 20])) for _ in range(60)] + [b[2:14] for b in bigs[:40]] + [None, "", "zz"]
    small = spark.createDataFrame(list(enumerate(smalls)), "i int, s string")
    big = spark.createDataFrame(list(enumerate(bigs)), "j int, b string")
    got = sorted((r["i"], r["j"]) for r in contained(small, "s", big, "b").collect())
    assert got == [(i, j) for i, s in enumerate(smalls) for j, b in enumerate(bigs) if s and b and s in b]
    text = contained(small, "s", big, "b")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_inventory_is_kept_until_it_is_old(spark, tmp_path):
    from quillon.operators import files

    asked = []

    def listings(*roots):
        def give():
            asked.append(roots)
            return [spark.createDataFrame([(p,) for p in r], "path string") for r in roots]

        return give

    folder = str(tmp_path / "inventory")
    paths = lambda df: sorted((r["path"], r["root"]) for r in df.collect())
    first = [("/a/X.pdf", 0), ("/b/y.pdf", 1)]
    assert paths(files.cached_inventory(spark, folder, listings(["/a/X.pdf"], ["/A/x.pdf", "/b/y.pdf"]), 1000)) == first
    assert paths(files.cached_inventory(spark, folder, listings(["/new"]), 2800)) == first and len(asked) == 1
    assert paths(files.cached_inventory(spark, folder, listings(["/new"]), 2801)) == [("/new", 0)] and len(asked) == 2


def test_earlier_roots_go_first(spark, tmp_path):
    from quillon.operators import files

    listing = files.inventory(spark.createDataFrame([("/z/one.pdf",)], "path string"), spark.createDataFrame([("/a/one.pdf",), ("/a/two.pdf",)], "path string"))
    asked = spark.createDataFrame([("q/one.pdf", "ONE.pdf"), ("/A/two.pdf", "x")], "file_path string, file_name string")
    assert {r["path"] for r in files.resolved(asked, listing).collect()} == {"/z/one.pdf", "/a/two.pdf"}
    assert {r["path"] for r in files.resolved(asked, listing.drop("root")).collect()} == {"/a/one.pdf", "/a/two.pdf"}
    there = str(tmp_path)
    assert files.roots(spark, " /named ", [there], "/x") == "/named" and files.roots(spark, None, ["/nowhere/at/all", there], "/x") == there and files.roots(spark, "", ["/nowhere/at/all"], "/x") == "/x"


def test_look_ups_skip_row_groups(spark, sf_dir, tmp_path):
    from quillon.operators import lookup
    from quillon.plans import binding as B

    folder = str(tmp_path / "index")
    base, files = B.standards(spark, sf_dir).drop("std_id_norm", "std_id_compact"), B.files(spark, sf_dir)
    with pytest.raises(ValueError):
        lookup.by_id(spark, folder, 1)
    notes = lookup.build(base, files, folder, "now", B.relations(spark, sf_dir), B.units(spark, sf_dir), B.areas(spark, sf_dir), parts=16, row_group=1 << 16)
    assert notes["standards"] == base.count() and notes["files"] == files.count() and notes["with_file"] == base.join(files, base["id"] == files["base_id"], "left_semi").count()
    assert notes["regions"] > 0 and notes["with_region"] <= notes["with_unit"] <= notes["standards"] and lookup.ready(spark, folder)
    one = files.orderBy("file_name").first()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = lookup.by_file_name(spark, folder, one["file_name"].upper())
        assert {r["id"] for r in found.collect()} == {r["id"] for r in files.filter(F.col("file_name") == one["file_name"]).collect()}
        read = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert read <= notes["files"] / 4
    code = base.filter("std_id like 'GB/T%'").orderBy("id").first()
    for spelt in (code["std_id"], code["std_id"].lower().replace("/", ""), code["std_id"].replace("-", " — ")):
        assert [r["id"] for r in lookup.by_code(spark, folder, spelt).collect()] == [code["id"]]
    assert lookup.by_code(spark, folder, " / ").count() == 0 and lookup.by_id(spark, folder, code["id"]).count() == 1
    assert lookup.by_path(spark, folder, one["file_path"].upper()).count() >= 1


def test_chinese_names_by_pinyin(spark):
    from quillon.operators import facets

    names = spark.createDataFrame([(x,) for x in ["重庆厂", "安徽厂", "厂", " 厂房北 ", "北京厂", "北京厂", "上海厂", "Zed厂1", "abc厂1", None, " "]], "unit_name string")
    assert [r["unit_name"] for r in facets.ranked_companies(names, "厂").collect()] == ["厂", "厂房北", "安徽厂", "北京厂", "重庆厂", "上海厂", "abc厂1", "Zed厂1"]
    assert facets.ranked_companies(names, "").count() == 9 and facets.ranked_companies(names, "ZED").count() == 1
