"""Scalar functions: examples, and columns against the plain Python of search texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import codes, display
from quillon.plans import intent as I


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_sanitize(spark):
    given_ = ["GB/T /1.1", "GB/T//1.1", "GB/T1.1", "  gb／t  5 ", "YDT1234", None, ""]
    assert column(spark, given_, codes.sanitize) == ["GB/T 1.1", "GB/T 1.1", "GB/T 1.1", "gb/t 5", "YDT 1234", "", ""]
    assert [I.sanitize(x) for x in given_] == ["GB/T 1.1", "GB/T 1.1", "GB/T 1.1", "gb/t 5", "YDT 1234", "", ""]


def test_keys(spark):
    given_ = ["gb/t 1002-2024", "YD/T 1234.1-2020", "a　b c"]
    assert column(spark, given_, codes.norm_key) == ["GB/T1002-2024", "YD/T1234.1-2020", "ABC"]
    assert column(spark, given_, codes.compact_key) == ["GBT10022024", "YDT1234.12020", "ABC"]


def test_lookup_variants_put_the_slash_back(spark):
    assert "YD/T 1234" in column(spark, ["YDT1234"], codes.lookup_variants)[0]
    assert "GB/T 1002-2024" in column(spark, ["gbt1002-2024"], codes.lookup_variants)[0]
    assert column(spark, ["  "], codes.lookup_variants) == [[]]


def test_cjk_core(spark):
    assert column(spark, ["食/品", "食 品", "食", None], codes.cjk_core) == ["食品", "食品", "", ""]


def test_leading_int(spark):
    given_ = ["T 12", "2020年", "-202", None, "", " +7x", "2-98"]
    assert column(spark, given_, codes.leading_int) == [0, 2020, -202, None, 0, 7, 2]


def test_like_keeps_wildcards_and_backslashes(spark):
    assert column(spark, ["GB/T 1", "a\\b", "x"], lambda x: codes.like(x, "%gb%1")) == [True, False, False]
    assert column(spark, ["GB/T 1", "a\\b", "x"], lambda x: codes.like(x, "%\\b%")) == [False, True, False]


def test_intent():
    ask = I.parse("GB/T 1002-2024 单相插头插座 plug")
    assert ask.codes == ("GB/T 1002-2024",) and ask.words[0] == "单相插头插座" and "plug" in ask.words and ask.primary == "GB/T 1002-2024"
    assert I.parse("").primary == "" and I.parse("食/品").words == ("食品",)


@pytest.mark.parametrize(("text", "want"), [("1", (1, False)), ("gt3", (None, True)), (">3", (None, True)), ("4+", (None, True)), ("7", (None, True)), ("0", (None, False)), ("x", (None, False)), (None, (None, False))])
def test_rank(text, want):
    assert I.parse_rank(text) == want


def test_filters_and_pages():
    with pytest.raises(ValueError, match="company"):
        I.Filters(rank=1)
    assert I.parse_list("1，2, x,3") == (1, 2, 3) and I.clean_company("某公司。；") == "某公司"
    assert not I.Filters().active and I.Filters(city="x").by_area and not I.Filters(company="x", rank=1).by_area
    assert (I.Page(0, 500).limit, I.Page(0, 500).offset, I.Page(3, 10).offset, I.Page(1, 10).count(21)) == (50, 0, 20, 3)


text = st.text(alphabet="GBTQ/／-— 12.3食品 abx%_\\", max_size=20)


@settings(max_examples=6, deadline=None)
@given(st.lists(text, min_size=30, max_size=30))
def test_columns_equal_python(spark, values):
    assert column(spark, values, codes.norm_key) == [I.norm_key(v) for v in values]
    assert column(spark, values, codes.compact_key) == [I.compact_key(v) for v in values]
    assert column(spark, values, codes.sanitize) == [I.sanitize(v) for v in values]
    assert column(spark, values, codes.fragments) == [list(I.parse(v).codes) for v in values]
    assert column(spark, values, lambda x: codes.looks_like_code(codes.collapse(x))) == [I.looks_like_code(I.collapse(v)) for v in values]


def test_display(spark):
    assert column(spark, ["2020-01-02T03", "Fri, 02 Jan 2026 00:00:00 GMT", "springtime again", None], display.date_label) == ["2020-01-02", "2026-01-02", "springtime", None]
    sizes = spark.createDataFrame([(1,), (2048,), (5 << 20,), (3 << 30,), (None,)], "x long")
    assert [r[0] for r in sizes.select(display.size_label(F.col("x"))).collect()] == ["1 B", "2.0 KB", "5.0 MB", "3.0 GB", None]
    states = spark.createDataFrame([(0, "x"), (1, None), (None, "old"), (None, ""), (9, None)], "s int, t string")
    assert [r[0] for r in states.select(display.state_label(F.col("s"), F.col("t"))).collect()] == ["废止", "现行", "old", "未知", "未知"]


def test_more_columns(spark):
    assert column(spark, ["某公司。； ", None, "a.b"], codes.clean_company) == ["某公司", "", "a.b"]
    variants = column(spark, ["a/GB T 1.PDF"], lambda x: codes.name_variants(x, F.lit("GB/T 1")))[0]
    assert variants == ["GB T 1.PDF", "GBT1.PDF", "GBT1.pdf"]
    assert I.year_range(2000, 1990) == (2000, 2000) and I.last_years(3, 2026) == (2024, 2026) and I.year_range(None, 5) == (None, 5)


def test_pager():
    from quillon.operators.search import pager

    assert pager(0, I.Page(1, 10)) == [1] and pager(1000, I.Page(50, 10)) == list(range(47, 54)) and pager(25, I.Page(3, 10)) == [1, 2, 3]
