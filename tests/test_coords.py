import pytest
from pyspark.errors import PySparkException

from fallline.functions import coords


def _clean(spark, triples):
    df = spark.createDataFrame([(triples,)], "c array<array<double>>")
    rows = df.select(coords.clean_coords("c")).first()[0]
    return [(r["index"], r.longitude, r.latitude, r.elevation) for r in rows]


def test_noise_is_rounded_away(spark):
    assert _clean(spark, [[7.00000001, 46.12345674, 100.004]]) == [(0, 7.0, 46.1234567, 100.0)]


def test_impossible_elevations_are_dropped_and_the_rest_renumbered(spark):
    got = _clean(spark, [[1.0, 1.0, 300.0], [2.0, 2.0, -9999.0], [3.0, 3.0, -100.0]])
    assert got == [(0, 1.0, 1.0, 300.0), (1, 3.0, 3.0, -100.0)]


def test_uphill_runs_are_turned_round(spark):
    got = _clean(spark, [[1.0, 1.0, 100.0], [2.0, 2.0, 500.0], [3.0, 3.0, 300.0]])
    assert [c[1] for c in got] == [3.0, 2.0, 1.0]
    assert [c[0] for c in got] == [0, 1, 2]


def test_level_and_single_point_runs_stay(spark):
    assert [c[1] for c in _clean(spark, [[1.0, 1.0, 5.0], [2.0, 2.0, 5.0]])] == [1.0, 2.0]
    assert len(_clean(spark, [[1.0, 1.0, 5.0]])) == 1


def test_nothing_left(spark):
    assert _clean(spark, [[1.0, 1.0, -500.0]]) == []
    assert _clean(spark, []) == []


def test_source_urls(spark):
    df = spark.createDataFrame(
        [([("openstreetmap", "way/1"), ("skimap.org", "17")],)],
        "s array<struct<type:string,id:string>>",
    )
    assert df.select(coords.sources_to_urls("s")).first()[0] == [
        "https://www.openstreetmap.org/way/1",
        "https://skimap.org/skiareas/view/17",
    ]
    assert df.select(coords.source_keys("s")).first()[0] == [
        "openstreetmap:way/1",
        "skimap.org:17",
    ]


def test_unknown_source_fails(spark):
    df = spark.createDataFrame([(("elsewhere", "1"),)], "s struct<type:string,id:string>")
    with pytest.raises(PySparkException, match="unknown source type elsewhere"):
        df.select(coords.source_url("s")).collect()


def test_points_without_elevation_stay(spark):
    assert _clean(spark, [[1.0, 2.0], [3.0, 4.0]]) == [(0, 1.0, 2.0, None), (1, 3.0, 4.0, None)]
