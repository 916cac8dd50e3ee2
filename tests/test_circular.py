import numpy as np
import pytest
from pyspark.sql import functions as F

from fallline.functions.circular import compass_label
from fallline.operators.areas import bearing_histogram, bearing_stats

CASES = [
    # bearings, net, cum, hemisphere, mean, alignment, poleward, eastward
    ([0], [2], [2], "north", 0, 1, 1, 0),
    ([0, 90], [1, 1], None, "south", 45, 0.7071068, -0.5, 0.5),
    ([0, 90], [0.5, 0.5], [0.5, 0.5], "north", 45, 0.7071068, 0.5, 0.5),
    ([0, 90], None, [2, 2], "north", 45, 0.3535534, 0.25, 0.25),
    ([0, 360], [1, 1], None, "north", 0, 1, 1, 0),
    ([0, 90], [0, 1], [0.5, 1.5], "north", 90, 0.5, 0, 0.5),
    ([90, 270], None, None, "north", 0, 0, 0, 0),
    ([90], [0], None, "north", 0, 0, 0, 0),
    ([0, 90], [2, 4], [10, 10], "north", 63.4349488, 0.2236068, 0.1, 0.2),
]


def _stats(spark, bearings, net, cum, latitudes):
    ones = [1.0] * len(bearings)
    rows = [
        (float(b), float(n), float(c), lat)
        for b, n, c, lat in zip(bearings, net or ones, cum or ones, latitudes, strict=True)
    ]
    df = spark.createDataFrame(rows, "bearing double, net double, cum double, latitude double")
    return bearing_stats(
        df, [], "net" if net else None, "cum" if cum else None, "latitude"
    ).first()


@pytest.mark.parametrize("bearings,net,cum,hemisphere,mean,alignment,poleward,eastward", CASES)
def test_bearing_stats(spark, bearings, net, cum, hemisphere, mean, alignment, poleward, eastward):
    latitude = 10.0 if hemisphere == "north" else -10.0
    row = _stats(spark, bearings, net, cum, [latitude] * len(bearings))
    assert row.bearing_mean == pytest.approx(mean, abs=1e-7)
    assert row.bearing_alignment == pytest.approx(alignment, abs=1e-7)
    assert row.poleward_affinity == pytest.approx(poleward, abs=1e-7)
    assert row.eastward_affinity == pytest.approx(eastward, abs=1e-7)


def test_no_shared_hemisphere_means_no_poleward_affinity(spark):
    row = _stats(spark, [0, 90], None, None, [10.0, -10.0])
    assert row.poleward_affinity is None
    assert row.eastward_affinity == pytest.approx(0.5)


def test_rows_on_the_equator_do_not_count(spark):
    row = _stats(spark, [0, 90], None, None, [10.0, 0.0])
    assert row.bearing_mean == 0
    assert row.bearing_magnitude_cum == 1
    assert row.poleward_affinity == 1


def test_no_rows_gives_zeros(spark):
    row = _stats(spark, [0], None, None, [None])
    assert (row.bearing_mean, row.bearing_alignment, row.bearing_magnitude_cum) == (0, 0, 0)
    assert row.poleward_affinity is None


def _brute_histogram(bearings, weights, n):
    counts, edges = np.histogram(bearings, bins=np.linspace(0, 360, 2 * n + 1), weights=weights)
    counts = np.roll(counts, 1).reshape(n, 2).sum(axis=1)
    return counts, edges[:-1:2]


@pytest.mark.parametrize("n", [2, 4, 8, 12, 16, 32])
def test_histogram_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    edges = np.arange(0, 361, 5.625)
    bearings = np.concatenate([rng.uniform(0, 360, 500), edges])
    weights = np.concatenate([rng.exponential(10, 500), np.ones(len(edges))])
    rows = [(float(b), float(w)) for b, w in zip(bearings, weights, strict=True)]
    rows += [(None, 5.0)]
    df = spark.createDataFrame(rows, "bearing double, weight double")
    got = bearing_histogram(df, [], n).orderBy("bin_index").toPandas()
    counts, centers = _brute_histogram(bearings, weights, n)
    assert list(got.bin_index) == list(range(1, n + 1))
    np.testing.assert_allclose(got.bin_center, centers)
    np.testing.assert_allclose(got.bin_count, counts, rtol=1e-9)
    np.testing.assert_allclose(got.bin_proportion, counts / counts.sum(), rtol=1e-9)
    assert got.bin_label[0] == "N"


def test_histogram_without_weight_has_zero_proportions(spark):
    df = spark.createDataFrame([(90.0, 0.0), (None, None)], "bearing double, weight double")
    got = bearing_histogram(df, [], 4).collect()
    assert [r.bin_count for r in got] == [0, 0, 0, 0]
    assert [r.bin_proportion for r in got] == [0, 0, 0, 0]


def test_compass_label(spark):
    values = [0.0, 11.25, 90.0, 348.75, 30.0, 360.0, None]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    labels = [r[0] for r in df.select(compass_label(F.col("c"))).collect()]
    assert labels == ["N", "NbE", "E", "NbW", None, None, None]
