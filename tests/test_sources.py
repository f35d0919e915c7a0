"""Dumps whose statements lie on many lines, and tables from the first source that is there."""

import pytest

from quillon.sources import dump, tables


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_statements_on_many_lines(spark, tmp_path, end):
    text = (
        "-- a comment; with a semicolon\n/*!40101 SET NAMES utf8 */;\nCREATE TABLE `std_unit_relation` (\n  `id` int\n);\n"
        "INSERT INTO `std_unit_relation` VALUES (1,10,100,1,1),\n(2,20,200,NULL,2),\n  (3,30,300,'it''s; (x)',3);\nINSERT INTO `other` VALUES (9,9,9,9,9);\n"
        "INSERT INTO `std_unit_relation` (`id`, `base_id`,\n `unit_id`, a, b)\nVALUES\n(4,40,400,'a\\'b;',4);\n" + "".join(f"INSERT INTO `std_unit_relation` VALUES ({i},1,\n2,3,4);\n" for i in range(5, 2000))
    )
    (tmp_path / "d.sql").write_bytes(text.replace("\n", end).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        parsed = dump.rows(spark, str(tmp_path / "d.sql"), "std_unit_relation")
        assert parsed.rdd.getNumPartitions() > 3
        rows = [r["fields"] for r in parsed.orderBy("line", "place").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows[:4] == [["1", "10", "100", "1", "1"], ["2", "20", "200", None, "2"], ["3", "30", "300", "it's; (x)", "3"], ["4", "40", "400", "a'b;", "4"]]
    assert [int(r[0]) for r in rows] == list(range(1, 2000))


def test_empty_dump_and_repeats(spark, tmp_path):
    (tmp_path / "e.sql").write_text("")
    assert dump.rows(spark, str(tmp_path / "e.sql"), "std_base").count() == 0
    row = "({},'{}',null,null,null,'n',null,null,null,null,null,1)"
    for rows, what in (([(1, "A"), (1, "B")], "id 1"), ([(1, "A"), (2, "A")], "std_id A")):
        (tmp_path / "r.sql").write_text("INSERT INTO `std_base` VALUES " + ",\n".join(row.format(*r) for r in rows) + ";\n")
        with pytest.raises(ValueError, match=what):
            dump.standards(spark, str(tmp_path / "r.sql"))


def test_database_tables_and_the_first_source_that_is_ready(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    base = spark.range(100).selectExpr("id as ID", "concat('GB/T ', id) as STD_ID")
    base.write.format("jdbc").options(url=url, dbtable="STD_BASE", createTableColumnTypes="STD_ID VARCHAR(100)", **driver).save()
    read = tables.jdbc(spark, url, "STD_BASE", "ID", 4, **driver)
    assert read.rdd.getNumPartitions() == 4 and sorted(r["ID"] for r in read.collect()) == list(range(100))
    one = read.filter("ID = 7").select("STD_ID")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [r["STD_ID"] for r in one.collect()] == ["GB/T 7"] and "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,7)]" in plan and "ReadSchema: struct<STD_ID:string>" in plan
    missing = ("files", lambda: spark.read.parquet(str(tmp_path / "nothing")))
    gone = ("database", lambda: tables.jdbc(spark, url, "NOT_THERE", **driver))
    name, df = tables.first_ready(gone, missing, ("other", lambda: read))
    assert name == "other" and df.count() == 100
    with pytest.raises(ValueError, match="files"):
        tables.first_ready(gone, missing)
    with pytest.raises(ZeroDivisionError):
        tables.first_ready(("broken", lambda: 1 / 0))
