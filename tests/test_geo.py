import math

import pytest
from pyspark.sql import functions as F

from fallline.functions import geo

FLIPS = [
    (10, 0, 0),
    (10, 180, 180),
    (10, 45, 45),
    (-10, 0, 180),
    (-10, 5, 175),
    (-10, 45, 135),
    (-10, 90, 90),
    (-10, 95, 85),
    (-10, 180, 0),
    (-10, 265, 275),
    (-10, 270, 270),
    (-10, 360, 180),
    (0, 0, 180),
    (None, 45, 135),
]


def test_flip_bearing(spark):
    rows = [(None if a is None else float(a), float(b), float(c)) for a, b, c in FLIPS]
    df = spark.createDataFrame(rows, "lat double, b double, want double")
    for row in df.withColumn("got", geo.flip_bearing(F.col("lat"), F.col("b"))).collect():
        assert row.got == row.want


def test_hemisphere_of_the_equator_is_unknown(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,)], "lat double")
    got = [r[0] for r in df.select(geo.hemisphere("lat")).collect()]
    assert got == ["north", "south", None, None]


def test_drop_keeps_unknown_unknown(spark):
    df = spark.createDataFrame([(2.0,), (-2.0,), (None,)], "v double")
    assert [r[0] for r in df.selectExpr(geo.drop_sql("v")).collect()] == [2.0, 0.0, None]


def _doubles(values):
    return [f"cast({v} AS double)" for v in values]


def _haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    dl = math.radians(lon2 - lon1)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * 6371009 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize(
    "ends", [(0, 0, 0, 1), (45, 7, 45.01, 7.02), (-33, 170, -33, -170), (10, 20, 10, 20), (0, 0, 0, 180)]
)
def test_great_circle(spark, ends):
    got = spark.range(1).selectExpr(geo.great_circle_sql(*_doubles(ends))).first()[0]
    assert got == pytest.approx(_haversine(*ends), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize(
    "ends,want",
    [
        ((0, 0, 1, 0), 0),
        ((0, 0, 0, 1), 90),
        ((1, 0, 0, 0), 180),
        ((0, 1, 0, 0), 270),
        ((5, 5, 5, 5), 0),
    ],
)
def test_initial_bearing(spark, ends, want):
    got = spark.range(1).selectExpr(geo.initial_bearing_sql(*_doubles(ends))).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_spokes_are_centred_on_north(spark):
    df = spark.createDataFrame([(0.0,), (5.624,), (5.625,), (354.375,), (180.0,)], "b double")
    assert [r[0] for r in df.select(geo.spoke(F.col("b"))).collect()] == [1, 1, 2, 1, 17]


def test_above_line(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "lon double, lat double")
    above = geo.above_line(F.col("lon"), F.col("lat"), (-1, -1), (1, 1))
    assert [r[0] for r in df.select(above).collect()] == [True, False]
