import numpy as np
import pytest
from pyspark.sql import functions as F

from fallline.operators import inequality as I
from fallline.operators.prefix import running_totals


@pytest.mark.parametrize(
    "values,want", [([5, 5, 5, 5], 0), ([100, 0, 0, 0], 0.75), ([1, 2, 3, 4], 0.25)]
)
def test_gini(spark, values, want):
    df = spark.createDataFrame([("m", float(v)) for v in values], "variable string, value double")
    assert I.gini(df).first().gini == pytest.approx(want, abs=1e-12)


def test_gini_of_many_equal_values(spark):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(3000) < 0.34, 7.0, rng.exponential(20, 3000).round(1))
    df = spark.createDataFrame([("m", float(v)) for v in values], "variable string, value double")
    got = I.gini(df.repartition(5)).first().gini
    cumulative = np.cumsum(np.sort(values))
    n = len(values)
    assert got == pytest.approx(1 - 2 * cumulative.sum() / (n * cumulative[-1]) + 1 / n, abs=1e-9)


def test_gini_without_any_value_is_unknown(spark):
    df = spark.createDataFrame([("m", 0.0), ("m", 0.0)], "variable string, value double")
    assert I.gini(df).first().gini is None


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_running_totals_against_brute_force(spark, slices):
    rng = np.random.default_rng(slices)
    rows = [
        ("hot" if rng.random() < 0.5 else f"g{rng.integers(4)}", int(rng.integers(5)), i, float(i % 7))
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "g string, k int, id int, v double").repartition(6)
    totals = running_totals(
        df, ["g"], ["k", "id"], {"rank": F.lit(1).cast("bigint"), "cum": F.col("v")}, slices
    )
    got = {r.id: (r["rank"], r.cum) for r in totals.collect()}
    assert len(got) == len(rows)
    count, running = {}, {}
    for g, _, i, v in sorted(rows):
        count[g] = count.get(g, 0) + 1
        running[g] = running.get(g, 0.0) + v
        assert got[i] == (count[g], pytest.approx(running[g]))


def test_ecdf_ranks_ties_by_id_and_skips_missing_values(spark):
    rows = [("a", "A", 5), ("b", None, 5), ("c", "C", None), ("d", "D", 10)]
    areas = spark.createDataFrame(rows, "ski_area_id string, ski_area_name string, run_count long")
    got = {r.ski_area_id: r for r in I.metric_ecdf(areas, metrics=["run_count"]).collect()}
    assert {k: r.value_rank for k, r in got.items()} == {"a": 1, "b": 2, "c": None, "d": 3}
    assert {k: r.value_cumsum for k, r in got.items()} == {"a": 5, "b": 10, "c": None, "d": 20}
    assert got["b"].value_cdf == 0.5
    assert got["d"].value_rank_pctl == 1


def test_running_totals_exchange_the_rows_once(spark):
    df = spark.range(0, 4000, 1, 6).selectExpr("id % 3 AS g", "id", "id * 1.5D AS v")
    totals = running_totals(df, ["g"], ["id"], {"cum": F.col("v")}, 5, totals={"cum": "all"})
    got = totals.collect()
    plan = totals._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the range exchange is behind the stage; what is left are the border rows and their broadcast
    below = plan[: plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in below and "Bucketed: true" in below
    assert spark.catalog.listTables() == []
    assert len(got) == 4000 and {(r.g, r["all"]) for r in got} == {
        (g, sum(i * 1.5 for i in range(g, 4000, 3))) for g in range(3)
    }


def test_running_totals_of_missing_and_many_groups(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 60}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id int").repartition(3)
    totals = running_totals(df, ["g"], ["id"], {"n": F.lit(1)}, 7, totals={"n": "all"})
    place, size = {}, {}
    for g, _ in rows:
        size[g] = size.get(g, 0) + 1
    got = {r.id: (r.n, r["all"]) for r in totals.collect()}
    for g, i in rows:
        place[g] = place.get(g, 0) + 1
        assert got[i] == (place[g], size[g])
    empty = running_totals(df.limit(0), ["g"], ["id"], {"n": F.lit(1)}, 7)
    assert empty.columns == ["g", "id", "n"] and empty.isEmpty()
