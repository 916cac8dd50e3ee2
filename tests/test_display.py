import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SMALL
from fallline.functions import filters, text
from fallline.operators import areas as A
from fallline.operators import display as D
from fallline.operators import tables as B
from fallline.plans import registry


@pytest.fixture(scope="module")
def table(spark):
    return registry.stored_metrics(spark, SMALL)


def _kept(spark, predicate, values=(-25.0, -20.0, -0.5, 0.0, 4.0, 5.0, 10.0, 15.0, 20.0, None)):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return [r.v for r in df.filter(predicate(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "typed,want",
    [
        ("15", [15, 20]),
        (" 15 ", [15, 20]),
        ("-20", [-25, -20]),
        ("-", [-25, -20, -0.5, 0]),
        ("-0", [-25, -20, -0.5, 0]),
        ("0", [0, 4, 5, 10, 15, 20]),
        ("[10, 20]", [10, 15, 20]),
        ("(10, 20)", [15]),
        ("(10,20]", [15, 20]),
        ("(, 5]", [-25, -20, -0.5, 0, 4, 5]),
        ("[15,)", [15, 20]),
        ("[ -20 , 0 )", [-20, -0.5]),
        ("(,)", [-25, -20, -0.5, 0, 4, 5, 10, 15, 20]),
    ],
)
def test_numeric_filter(spark, typed, want):
    assert _kept(spark, lambda v: filters.numeric_filter(v, typed)) == want


@pytest.mark.parametrize("typed", ["", "abc", "1.5", "[1, 2", "10-20", "[1.5, 2]"])
def test_other_text_keeps_all_rows(spark, typed):
    assert len(_kept(spark, lambda v: filters.numeric_filter(v, typed))) == 10


def test_percent_filter(spark):
    kept = _kept(spark, lambda v: filters.percent_filter(v, "[10, 30]"), (0.05, 0.1, 0.25, 0.5))
    assert kept == [0.1, 0.25]


def test_latitude_filter(spark):
    values = (10.0, 0.0, -10.0, None)
    keep = lambda t: _kept(spark, lambda v: filters.latitude_filter(v, t), values)
    assert keep("NOR") == [10]
    assert keep("south") == [0, -10, None]
    assert keep("th") == [10, 0, -10, None]
    assert keep("5") == [10]


def test_country_filter(spark):
    df = spark.createDataFrame(
        [("France", "FR", "🇫🇷"), ("United States", "US", "🇺🇸"), (None, None, None)],
        "country string, code string, emoji string",
    )
    columns = (F.col("country"), F.col("code"), F.col("emoji"))
    keep = lambda t: [r.code for r in df.filter(filters.country_filter(*columns, t)).collect()]
    assert keep("fran") == ["FR"]
    assert keep("us") == ["US"]
    assert keep("🇫🇷") == ["FR"]
    assert keep("u") == ["US"]


def test_flags(spark):
    df = spark.createDataFrame([("US",), ("FR",), ("fr",), (None,)], "c string")
    assert [r[0] for r in df.select(text.flag_emoji(F.col("c"))).collect()] == ["🇺🇸", "🇫🇷", "🇫🇷", None]


@pytest.mark.parametrize("code", ["USA", "U", "1A"])
def test_bad_country_code_fails(spark, code):
    df = spark.createDataFrame([(code,)], "c string")
    with pytest.raises(PySparkException, match="not a two-letter country code"):
        df.select(text.flag_emoji(F.col("c"))).collect()


def test_labels(spark):
    one = spark.range(1)
    assert one.select(text.metric_label(F.lit("combined_vertical"))).first()[0] == "Combined Vertical"
    assert (
        one.select(text.status_label(F.lit("operating"), F.lit("north"))).first()[0]
        == "Operating in North Hem."
    )


def test_shares_from_the_row_equal_the_pivot(spark, table):
    pivot = {r.ski_area_id: r for r in D.cardinal_pivot(A.bearing_distribution(table)).collect()}
    names = [f"bin_proportion_{n}_{w}" for n, w in D.CARDINAL_BINS]
    shares = table.select(
        "ski_area_id",
        *[D.cardinal_share(n, w).alias(name) for (n, w), name in zip(D.CARDINAL_BINS, names, strict=True)],
    )
    for row in shares.collect():
        if row.ski_area_id in pivot:
            assert [row[n] for n in names] == [pivot[row.ski_area_id][n] for n in names]
        else:
            assert [row[n] for n in names] == [None] * 5


def test_frontend_table_is_sorted_and_rounded(spark, table):
    rows = D.frontend_table(table).collect()
    names = [r.ski_area_name for r in rows]
    assert names == sorted(names) and names
    assert all(r.run_count >= 3 and r.combined_vertical >= 50 for r in rows)
    assert all(round(r.latitude, 4) == r.latitude for r in rows)


def test_rose_axis_is_shared_on_demand(spark, table):
    own = D.rose_geometry(table, "ski_area_id", 8)
    shared = D.rose_geometry(table, "ski_area_id", 8, shared_scale=True)
    longest = own.agg(F.max("radius")).first()[0]
    assert own.select("axis_limit").distinct().count() > 1
    assert [r[0] for r in shared.select("axis_limit").distinct().collect()] == [longest]


def test_pending_keys(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    done = spark.createDataFrame([("a",)], "k string")
    assert [r.k for r in B.pending_keys(wanted, done, "k").collect()] == ["b"]
    assert B.pending_keys(wanted, done, "k", overwrite=True).count() == 2


def test_flatten_struct(spark):
    df = spark.range(1).selectExpr("named_struct('b', named_struct('c.d', 1), 'e', array(2)) AS a")
    assert B.flatten_struct(df).columns == ["a__b__c.d", "a__e"]


def test_first_of_each_is_cut_before_the_shuffle(spark):
    rows = [("hot" if i % 3 else f"c{i % 7}", i * 7919 % 1009, i) for i in range(900)] + [(None, 1, 900), (None, 1, 901)]
    df = spark.createDataFrame(rows, "g string, k int, id int").repartition(5)
    cut = B.first_of_each(df, ["g"], ["k", "id"], 4)
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    want = {}
    for g, k, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(g, []).append(i)
    got = {}
    for r in cut.collect():
        got.setdefault(r.g, []).append(r.id)
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(v[:4]) for g, v in want.items()}


def test_key_changes(spark):
    def digests(rows):
        return B.content_digests(spark.createDataFrame(rows, "k string, a int, b string"), "k")

    before = digests([("same", 1, None), ("moved", 2, None), ("gone", 3, "x"), (None, 4, "n")])
    now = digests([("same", 1, None), ("moved", None, "2"), ("fresh", 3, "x"), (None, 4, "n")])
    got = {r.k: r.change for r in B.key_changes(now, before, "k").collect()}
    assert got == {"moved": "changed", "gone": "removed", "fresh": "new"}
    assert B.key_changes(before, before.limit(0), "k").count() == 4
