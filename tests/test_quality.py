import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fallline.operators import areas as A
from fallline.operators import quality as Q
from fallline.plans import registry


@pytest.fixture(scope="module")
def table(spark):
    return registry.stored_metrics(spark, SMALL)


def _violations(df):
    return {r.rule: r.violations for r in Q.validate_areas(df).collect() if r.violations}


def test_a_good_table_passes(spark, table):
    assert _violations(table) == {}
    assert Q.require_valid(table) is table
    assert Q.duplicate_bins(A.bearing_distribution(table)).isEmpty()


def test_extra_columns_are_allowed(spark, table):
    Q.require_valid(table.withColumn("extra", F.lit(1)))


@pytest.mark.parametrize(
    "column,value,rule",
    [
        ("run_count", "-1L", "run_count is in range"),
        ("run_count", "cast(NULL AS bigint)", "run_count is required"),
        ("latitude", "90.5D", "latitude is in range"),
        ("bearing_mean", "360D", "bearing_mean is in range"),
        ("osm_status", "'closed'", "osm_status is an allowed value"),
        ("hemisphere", "'east'", "hemisphere is an allowed value"),
    ],
)
def test_each_rule_is_checked(spark, table, column, value, rule):
    broken = table.withColumn(column, F.expr(value))
    assert rule in _violations(broken)
    with pytest.raises(Q.InvalidTable, match=rule):
        Q.require_valid(broken)


def test_duplicate_ids_are_found(spark, table):
    one = table.limit(1)
    assert _violations(table.unionByName(one))["ski_area_id is unique"] == 2


def test_bins_are_checked(spark, table):
    broken = table.withColumn(
        "bearings", F.transform("bearings", lambda b: b.withField("bin_proportion", F.lit(1.5)))
    )
    assert "bearings are in range" in _violations(broken)


def test_schema_problems(spark, table):
    assert Q.schema_problems(table.drop("latitude").schema) == ["latitude is missing"]
    changed = table.withColumn("run_count", F.col("run_count").cast("string"))
    assert Q.schema_problems(changed.schema) == ["run_count is string, not bigint"]
    with pytest.raises(Q.InvalidTable, match="run_count is string"):
        Q.require_valid(changed)


def test_rules_are_counted_while_writing(spark, table, tmp_path):
    faulty = table.withColumn("latitude", F.lit(91.0)).unionByName(table.limit(1))
    counted, observation = Q.observed(faulty)
    counted.write.parquet(str(tmp_path / "areas"))
    areas = spark.read.parquet(str(tmp_path / "areas"))
    assert sorted(Q.observed_problems(areas, observation)) == sorted(Q.problems(areas))
    counted, observation = Q.observed(table)
    counted.write.parquet(str(tmp_path / "good"))
    assert Q.observed_problems(spark.read.parquet(str(tmp_path / "good")), observation) == []


def test_broken_rows_have_a_bit_per_rule(spark, table):
    assert Q.broken_rows(table).isEmpty()
    names = list(Q.row_rules(table.columns))
    broken = table.withColumns({"latitude": F.lit(91.0), "run_count": F.lit(-1)})
    wanted = {"latitude is in range", "run_count is in range"}
    for row in Q.broken_rows(broken).collect():
        assert set(row.broken) == wanted == {n for i, n in enumerate(names) if row.rules >> i & 1}
    assert Q.broken_rows(broken).count() == table.count()
