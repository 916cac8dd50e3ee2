import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fallline.operators import segments as S
from fallline.plans import registry
from fallline.schema import COORDINATE_FIELDS, SEGMENT_FIELDS

FIELDS = ["run_id", *COORDINATE_FIELDS, *SEGMENT_FIELDS]


def _rows(df):
    return sorted(
        [tuple(r) for r in df.select(*FIELDS).collect()], key=lambda r: tuple(map(str, r))
    )


@pytest.mark.parametrize("chunk", [1, 3, 7, 100_000])
def test_all_forms_agree(spark, chunk):
    runs = registry.runs(spark, SMALL).select("run_id", "run_coordinates_clean").cache()
    exploded = S.explode_segments(runs)
    enriched = S.explode_coordinates(S.enrich_runs(runs))
    assert _rows(exploded) == _rows(enriched)
    points = S.explode_coordinates(runs).filter(F.col("index").isNotNull())
    flat = S.segments_from_points(points, "run_id", chunk_points=chunk)
    assert _rows(flat) == _rows(exploded.filter(F.col("index").isNotNull()))


def test_one_path_with_a_third_of_all_points_and_gaps_in_the_order(spark):
    rng = random.Random(5)
    rows = []
    for order in rng.sample(range(-5000, 20_000), 3000):
        path = "hot" if rng.random() < 0.34 else f"p{rng.randrange(400)}"
        rows.append((path, order, rng.uniform(-60, 60), rng.uniform(-90, 90), rng.uniform(0, 3000)))
    points = spark.createDataFrame(
        rows, "path string, index long, latitude double, longitude double, elevation double"
    )
    got = {
        (r.path, r["index"]): r.distance_vertical
        for r in S.segments_from_points(points, "path", chunk_points=50).collect()
    }
    assert len(got) == len(rows)
    last = {}
    for path, order, _, _, elevation in sorted(rows):
        want = last[path] - elevation if path in last else None
        assert got[path, order] == want
        last[path] = elevation


def test_edge_runs(spark, make_runs, run_row):
    runs = make_runs(
        [
            run_row("empty", []),
            run_row("single", [(1.0, 1.0, 9.0)]),
            run_row("still", [(1.0, 1.0, 9.0), (1.0, 1.0, 9.0)]),
        ]
    )
    rows = {(r.run_id, r["index"]): r for r in S.explode_segments(runs).collect()}
    assert rows["empty", None].segment_hash is None
    assert rows["single", 0].distance_3d is None
    still = rows["still", 1]
    assert still.distance_horizontal == 0
    assert still.bearing == 0
    assert still.gradient is None and still.slope is None
    assert still.segment_hash is not None
    assert _rows(S.explode_segments(runs)) == _rows(S.explode_coordinates(S.enrich_runs(runs)))


def test_regrouping_restores_the_lists(spark):
    runs = registry.runs(spark, SMALL).select("run_id", "run_coordinates_clean")
    runs = runs.filter(F.size("run_coordinates_clean") > 0)
    back = S.regroup_coordinates(S.explode_coordinates(runs).repartition(7))
    assert back.exceptAll(runs).isEmpty()
    assert runs.exceptAll(back).isEmpty()


def test_regrouped_runs_have_all_their_segments(spark):
    points = spark.range(250_000).selectExpr(
        "'r' AS run_id", "cast(id AS int) AS index", "id * 1e-5D AS latitude", "2D AS longitude",
        "cast(-id AS double) AS elevation",
    )
    runs = S.regroup_coordinates(points)
    assert runs.count() == 1
    assert S.explode_segments(runs).filter("segment_hash IS NOT NULL").count() == 249_999


def test_runs_without_points_take_no_number(make_runs, run_row):
    runs = make_runs([run_row("a", []), run_row("b", [(0.0, 0.0, 9.0), (0.0, 1.0, 5.0)])])
    assert [r["index"] for r in S.lead_segments(S.enrich_runs(runs)).collect()] == [1]


def test_lead_segments_are_numbered_over_all_runs(spark, make_runs, run_row):
    runs = make_runs(
        [
            run_row("b", [(0.0, 0.0, 9.0), (0.0, 1.0, 5.0)]),
            run_row("a", [(0.0, 0.0, 9.0), (1.0, 0.0, 5.0), (1.0, -1.0, 3.0)]),
        ]
    )
    steps = {
        (r.path, r.index0): r for r in S.lead_segments(S.enrich_runs(runs), 32).collect()
    }
    assert {k: r["index"] for k, r in steps.items()} == {("a", 0): 1, ("b", 0): 2, ("a", 1): 3}
    assert steps["a", 0].tg == 90 and steps["a", 0].group == 9
    assert steps["b", 0].tg == 0 and steps["b", 0].group == 1
    assert steps["a", 0].scaled_dx == pytest.approx(1.0)
