import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fallline.operators import areas as A
from fallline.operators import network as N
from fallline.operators import rollups as R
from fallline.operators import segments as S
from fallline.plans import registry
from fallline.schema import AREA_METRICS, BEARING_STATS
from fallline.session import materialize


@pytest.fixture(scope="module")
def table(spark):
    return registry.stored_metrics(spark, SMALL)


@pytest.fixture
def dimension(spark):
    def make(ids):
        columns = [
            F.lit(None).cast(f.dataType).alias(f.name)
            for f in AREA_METRICS.fields[1:12]
        ]
        base = spark.createDataFrame([(i,) for i in ids], "ski_area_id string")
        return base.select("ski_area_id", *columns, F.lit(None).cast("bigint").alias("lift_count"))

    return make


def test_counts_of_shared_empty_and_unused_runs(spark, make_runs, run_row, dimension):
    runs = make_runs(
        [
            run_row("r1", [(0.0, 1.0, 90.0), (0.0, 1.001, 50.0)], areas=["a1", "a2"]),
            run_row("r2", [], areas=["a1"]),
            run_row("r3", [(0.0, 1.0, 90.0), (0.0, 1.1, 5.0)], areas=["a1"], uses=["nordic"]),
            run_row("r4", [(0.0, 1.0, 90.0), (0.0, 1.1, 5.0)], areas=[]),
        ]
    )
    rows = {r.ski_area_id: r for r in A.area_metrics(dimension(["a1", "a2", "a3"]), runs).collect()}
    assert (rows["a1"].run_count, rows["a1"].coordinate_count, rows["a1"].segment_count) == (2, 3, 1)
    assert (rows["a2"].run_count, rows["a2"].coordinate_count) == (1, 2)
    assert rows["a1"].combined_vertical == 40
    assert rows["a1"].vertical_drop == 40
    assert rows["a1"].hemisphere == "north"
    # an area without runs keeps its row, zeros in the defaulted columns and NULL elsewhere
    empty = rows["a3"]
    assert (empty.run_count, empty.lift_count, empty.combined_vertical, empty.vertical_drop) == (0, 0, 0, 0)
    assert empty.latitude is None and empty.hemisphere is None
    assert empty.bearing_mean is None and empty.bearings is None


def test_runs_without_points_give_an_area_of_zeros(spark, make_runs, run_row):
    row = A.area_run_metrics(make_runs([run_row("r", [])])).first()
    assert (row.run_count, row.coordinate_count, row.segment_count) == (1, 1, 0)
    assert row.combined_vertical == 0 and row.vertical_drop is None
    assert row.bearing_alignment == 0 and row.poleward_affinity is None
    assert {b.bin_count for b in row.bearings} == {0}
    assert len(row.bearings) == 62


def test_exported_runs_give_the_same_metrics(spark, make_runs, run_row):
    runs = materialize(registry.runs(spark, SMALL))
    plain = A.area_run_metrics(runs).drop("bearings")
    exported = A.area_run_metrics(materialize(S.enrich_runs(runs))).drop("bearings")
    pairs = zip(
        plain.orderBy("ski_area_id").collect(),
        exported.orderBy("ski_area_id").collect(),
        strict=True,
    )
    for a, b in pairs:
        assert (a.ski_area_id, a.hemisphere) == (b.ski_area_id, b.hemisphere)
        names = [n for n in a.asDict() if n not in ("ski_area_id", "hemisphere")]
        assert [n for n in names if a[n] is None] == [n for n in names if b[n] is None]
        numbers = [n for n in names if a[n] is not None]
        assert [a[n] for n in numbers] == pytest.approx([b[n] for n in numbers], rel=1e-9, abs=1e-9)


def test_single_pass_equals_double_pass(spark):
    runs = registry.runs(spark, SMALL)
    points = materialize(A.area_points(runs))
    single = A.bearing_stats(
        points, [], "distance_vertical_drop", "distance_vertical_drop", "latitude"
    ).first()
    per_area = A.bearing_stats(
        points, ["ski_area_id"], "distance_vertical_drop", "distance_vertical_drop", "latitude"
    )
    double = A.bearing_stats(
        per_area, [], "bearing_magnitude_net", "bearing_magnitude_cum", bearing="bearing_mean"
    ).first()
    for name in BEARING_STATS:
        if name != "poleward_affinity":
            assert double[name] == pytest.approx(single[name], rel=1e-6, abs=1e-5)


def test_histograms_hold_all_vertical(spark, table):
    for row in table.filter("bearings IS NOT NULL").collect():
        for n in (2, 4, 8, 16, 32):
            bins = [b for b in row.bearings if b.num_bins == n]
            assert [b.bin_index for b in bins] == list(range(1, n + 1))
            assert sum(b.bin_count for b in bins) == pytest.approx(row.combined_vertical)


def test_one_area_with_a_third_of_all_runs(spark, make_runs, run_row):
    rows = []
    for i in range(90):
        area = "hot" if i % 3 == 0 else f"a{i}"
        rows.append(run_row(f"r{i}", [(0.0, 1.0, 100.0), (0.001 * i, 1.001, 60.0)], areas=[area]))
    got = {r.ski_area_id: r for r in A.area_run_metrics(make_runs(rows).repartition(6)).collect()}
    assert got["hot"].run_count == 30 and got["hot"].segment_count == 30
    assert got["hot"].combined_vertical == pytest.approx(1200)
    assert len(got) == 61


def test_country_count_counts_the_missing_country_once(spark, table):
    doubled = table.withColumn("all", F.lit(1)).withColumn(
        "country", F.when(F.col("country") > "NATION_15", F.col("country"))
    )
    want = doubled.select("country").distinct().count()
    assert R.rollup(doubled, ["all"]).first().country_count == want


def test_groups_without_key_or_histogram_vanish(spark, table):
    rolled = R.rollup(table, ["country"]).collect()
    assert None not in [r.country for r in rolled]
    with_runs = table.filter("bearings IS NOT NULL AND country IS NOT NULL")
    assert len(rolled) == with_runs.select("country").distinct().count()


def test_rollup_of_single_areas_changes_nothing(spark, table):
    areas = {r.ski_area_id: r for r in table.filter("bearings IS NOT NULL").collect()}
    for row in R.rollup(table, ["ski_area_id"]).collect():
        area = areas[row.ski_area_id]
        assert row.combined_vertical == pytest.approx(area.combined_vertical)
        if area.hemisphere is not None:
            assert row.bearing_mean == pytest.approx(area.bearing_mean, abs=1e-5)
        assert [b.bin_count for b in row.bearings] == pytest.approx(
            [b.bin_count for b in area.bearings]
        )


def test_at_least(spark, table):
    groups = R.rollup(table, ["region"])
    floor = groups.agg(F.max("combined_vertical")).first()[0]
    assert R.at_least(groups, floor).count() == 1


def test_graph_places_count_once_and_still_steps_do_not(spark, make_runs, run_row):
    runs = make_runs(
        [
            run_row("r1", [(0.0, 1.0, 100.0), (0.0, 2.0, 60.0), (0.0, 2.0, 50.0)]),
            run_row("r2", [(0.0, 1.0, 100.0), (0.0, 4.0, 70.0)]),
        ]
    )
    row = N.graph_summary(runs).first()
    assert row.run_count == 2
    assert row.latitude == pytest.approx(7 / 3)
    assert row.combined_vertical == 70
    assert row.bearing_mean == 0 and row.bearing_alignment == 1


def test_graph_of_still_steps_has_edges_without_direction(spark, make_runs, run_row):
    still = run_row("s", [(1.0, 2.0, 9.0), (1.0, 2.0, 9.0)], areas=("still",))
    single = run_row("p", [(1.0, 2.0, 9.0)], areas=("single",))
    nothing = run_row("n", [], areas=("nothing",))
    rows = {r.ski_area_id: r for r in N.graph_summary(make_runs([still, single, nothing])).collect()}
    assert [rows["still"][n] for n in ("combined_vertical", "bearing_mean", "bearing_alignment")] == [0, 0, 0]
    assert rows["still"].bearing_magnitude_cum == 0 and rows["still"].latitude == 2
    assert rows["single"].combined_vertical is None and rows["single"].bearing_mean is None
    assert rows["nothing"].run_count == 1 and rows["nothing"].latitude is None


def test_network_reads_the_runs_once_and_does_not_sort(spark):
    runs = materialize(registry.runs(spark, SMALL))
    plan = N.graph_summary(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan
    nodes = N.path_nodes(S.explode_segments(runs.select("run_id", "run_coordinates_clean")))
    assert "SortAggregate" not in nodes._jdf.queryExecution().executedPlan().toString()


def test_graph_on_the_equator_is_southern(spark, make_runs, run_row):
    row = N.graph_summary(make_runs([run_row("r", [(0.0, 0.0, 9.0), (1.0, 0.0, 5.0)])])).first()
    assert row.hemisphere == "south"
    assert row.eastward_affinity == 1


def test_hemisphere_of_a_mixed_area_is_that_of_the_first_run_by_hash(spark, make_runs, run_row):
    north = [(0.0, 5.0, 9.0), (0.0, 6.0, 5.0)]
    south = [(0.0, -5.0, 9.0), (0.0, -6.0, 5.0)]
    paths = {f"r{i}": north if i % 2 else south for i in range(9)}
    rows = A.area_run_metrics(make_runs([run_row(k, v) for k, v in paths.items()])).collect()
    first = min(paths, key=lambda k: hashlib.md5(k.encode()).hexdigest())
    assert rows[0].hemisphere == ("north" if paths[first] is north else "south")
    assert rows[0].poleward_affinity is None


def test_a_repeated_run_id_counts_once(spark, make_runs, run_row):
    points = [(0.0, 5.0, 9.0), (0.0, 6.0, 5.0)]
    row = A.area_run_metrics(make_runs([run_row("r", points), run_row("r", points)])).first()
    assert (row.run_count, row.coordinate_count) == (1, 4)


def test_lift_count_is_distinct_and_operating(spark):
    lifts = spark.createDataFrame(
        [
            ("l1", "operating", ["a", "b"]),
            ("l1", "operating", ["a"]),
            ("l2", "abandoned", ["a"]),
            ("l3", "operating", [None]),
            ("l4", "operating", []),
        ],
        "lift_id string, lift_status string, ski_area_ids array<string>",
    )
    assert {r.ski_area_id: r.lift_count for r in A.lift_count(lifts).collect()} == {"a": 1, "b": 1}


def test_presets_come_from_one_scan(spark, tmp_path):
    registry.stored_metrics(spark, SMALL).write.parquet(str(tmp_path / "areas"))
    areas = spark.read.parquet(str(tmp_path / "areas"))
    groups = R.rollup_presets(areas, registry.COUNTRY)
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    for name, single in R.PRESETS.items():
        one = single(areas, registry.COUNTRY) if name == "region" else single(areas)
        found = R.of_preset(groups, name)
        assert set(found.columns) == set(one.columns)
        count = lambda df: df.select(*[c for c in one.columns if dict(one.dtypes)[c] in ("string", "bigint")])
        assert sorted(map(tuple, count(found).collect()), key=str) == sorted(map(tuple, count(one).collect()), key=str)
        for a, b in zip(found.collect(), one.collect()):
            assert a.bearing_mean == pytest.approx(b.bearing_mean, abs=1e-6)
            assert [tuple(x) for x in a.bearings] == [tuple(pytest.approx(v) if isinstance(v, float) else v for v in x) for x in b.bearings]
