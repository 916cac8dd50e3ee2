import pytest
from pyspark.sql import functions as F

from fallline.operators import grids as H
from fallline.operators.grids import Grid, bin_number, bin_upper, clip_values


@pytest.mark.parametrize(
    "value,number,upper",
    [
        (0.0, 0, 3.0),
        (2.999, 0, 3.0),
        (3.0, 1, 6.0),
        (89.999, 29, 90.0),
        (90.0, 30, float("inf")),
        (None, None, None),
    ],
)
def test_bins_are_closed_on_the_left(spark, value, number, upper):
    df = spark.createDataFrame([(value,)], "v double")
    row = df.select(
        bin_number(F.col("v"), 90.0, 30).alias("n"),
        bin_upper(bin_number(F.col("v"), 90.0, 30), 90.0, 30).alias("u"),
    ).first()
    assert (row.n, row.u) == (number, upper)


def test_histogram_has_all_bands_and_counts_a_shared_run_once(spark, make_runs, run_row):
    runs = make_runs(
        [
            run_row("n", [(0.0, 4.0, 100.0), (0.0, 4.1, 60.0)], areas=["a", "b"]),
            run_row("s", [(0.0, -4.0, 100.0), (0.0, -4.1, 70.0)], areas=[]),
            run_row("x", [(0.0, 4.0, 100.0), (0.0, 4.1, 60.0)], uses=["nordic"]),
        ]
    )
    rows = H.latitude_histogram(Grid(), runs).collect()
    assert len(rows) == 60
    found = {(r.hemisphere, r.latitude_abs_bin_lower): r for r in rows if r.segment_count}
    assert set(found) == {("north", 3.0), ("south", 3.0)}
    assert found["north", 3.0].combined_vertical == 40
    assert found["north", 3.0].poleward_affinity == 1
    assert found["south", 3.0].poleward_affinity == 1
    assert all(r.bearing_mean is None for r in rows if not r.segment_count)


def test_grid_shares_and_prior(spark, make_runs, run_row):
    grid = Grid(latitude_bins=2, bearing_bins=4, prior_vertical=100)
    cells = H.latitude_bearing_histogram(
        grid,
        make_runs([run_row("n", [(0.0, 4.0, 100.0), (0.0, 4.1, 60.0)])])
    )
    rows = {(r.latitude_abs_bin_lower, r.bearing_bin_lower): r for r in cells.collect()}
    assert len(rows) == 8
    hit, miss, empty = rows[0.0, 0.0], rows[0.0, 90.0], rows[45.0, 0.0]
    assert (hit.combined_vertical_prop, hit.combined_vertical_enrichment) == (1, 4)
    assert hit.combined_vertical_prop_regularized == pytest.approx(65 / 140)
    assert miss.combined_vertical_prop_regularized == pytest.approx(25 / 140)
    assert empty.combined_vertical_prop is None
    assert empty.combined_vertical_enrichment_regularized == pytest.approx(1)
    mesh = H.mesh(grid, cells, min_vertical=10).collect()
    assert [r.latitude_abs_bin_lower for r in mesh] == [0, 45]
    assert mesh[0].bearing_0 == pytest.approx(4 * 65 / 140) and mesh[1].bearing_0 is None


def test_clip_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 9.0), (3, None)], "k int, v double")
    assert [r.v for r in clip_values(df, ("k",), 0.0, 2.5).collect()] == [0.0, 2.5, None]
