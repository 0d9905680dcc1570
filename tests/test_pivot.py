import pytest

from cairnframe.operators.pivot import filled_cells, read_cells, wide_table

SPECS = [("leaf_count", "number", False), ("evergreen", "bool", False), ("seen_on", "date", False), ("month", "month", False), ("first_described", "year", False), ("use", "text", True), ("link", "url", False)]


@pytest.mark.parametrize(
    "name,value,cell",
    [
        ("Leaf count", "1,200", "1200"), ("LEAF-COUNT:", "ca. 3,50", "3.5"), ("leafCount", "1.085e3", "1085"), ("leaf_count", "1'041", "1041"), ("leaf_count", "1 015", "1015"), ("leaf_count", "-0.05", "-0.05"), ("leaf_count", "many", None),
        ("evergreen", "Ja", "true"), ("evergreen", "✗", "false"), ("evergreen", "perhaps", None),
        ("seen on", "13.01.2015", "2015-01-13"), ("seen_on", "1/13/2022", "2022-01-13"), ("seen_on", "2/3/2022", "2022-03-02"), ("seen_on", "20150107", "2015-01-07"), ("seen_on", "2015-01-02T05:15:00Z", "2015-01-02"), ("seen_on", "April 23rd, 2016", "2016-04-23"), ("seen_on", "10. März 2016", "2016-03-10"), ("seen_on", "30/02/2016", None), ("seen_on", "Oct 1, 2015", "2015-10-01"),
        ("month", "in June", "6"), ("month", "09", "9"), ("month", "Aug.", "8"), ("month", "13", None), ("month", "MÄRZ", "3"),
        ("first described", "c. 1642", "1642"), ("first_described", "1640 (first)", "1640"), ("first_described", "16421", None),
        ("use", "  rope   walk", "rope walk"), ("link", " https://a.test/x ", "https://a.test/x"),
    ],
)
def test_cells(spark, name, value, cell):
    rows = spark.createDataFrame([(1, name, value)], "page_id bigint, name string, value string")
    assert [r.cell for r in read_cells(rows, SPECS).collect()] == [cell]


def test_wide_table_and_back(spark):
    data = [(1, "use", "tea"), (1, "Use:", "rope"), (1, "use", "tea "), (1, "leaf_count", "3"), (1, "leaf_count", "4"), (1, "leaf_count", "4.0"), (2, "nothing", "x"), (3, "evergreen", "n/a"), (None, "use", "tea"), (4, None, "x"), (5, "use", None), (6, "use", "y" * 50000)]
    rows = spark.createDataFrame(data, "page_id bigint, name string, value string").selectExpr("*", "1 as n", "'z' as cell", "7 as block")
    wide = wide_table(rows, SPECS, block=2)
    got = {r.page_id: r.asDict() for r in wide.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[1]["use"] == ["rope", "tea"] and got[1]["leaf_count"] == 4 and got[3]["evergreen"] is None
    cells = {tuple(r) for r in filled_cells(wide, SPECS).collect()}
    assert {c for c in cells if c[0] == 1} == {(1, "use", "rope"), (1, "use", "tea"), (1, "leaf_count", "4")}
    assert len([c for c in cells if c[0] == 6]) == 1
    assert wide_table(rows.limit(0), SPECS).count() == 0


def test_blocks_join_without_shuffle(spark):
    rows = spark.createDataFrame([(1, "use", "tea")], "page_id bigint, name string, value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = wide_table(rows, SPECS, block=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
