"""Runs as a network: points are nodes, steps are edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallline.functions import circular
from fallline.operators.areas import area_points
from fallline.schema import BEARING_STATS


def path_edges(points: DataFrame, keys: list[str]) -> DataFrame:
    """Steps between consecutive points. Parallel edges stay; single points give none."""
    return points.filter(F.col("segment_hash").isNotNull()).select(
        *keys,
        "index",
        "longitude",
        "latitude",
        F.col("distance_vertical_drop").alias("vertical"),
        "bearing",
        F.col("distance_horizontal").alias("length"),
    )


def path_nodes(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct places, per key if given, with the elevation that one of the runs there recorded.

    Which one is decided by a fixed hash of run and point: a number, so that the aggregate hashes,
    where the id itself would make Spark sort all points.
    """
    order = F.expr("cast(conv(left(md5(concat(run_id, ':', index)), 15), 16, 10) AS bigint)")
    return (
        points.filter(F.col("latitude").isNotNull())
        .groupBy(*(keys or []), "longitude", "latitude")
        .agg(F.max_by("elevation", order).alias("elevation"))
    )


def graph_summary(runs: DataFrame, coordinates: str = "run_coordinates_clean") -> DataFrame:
    """One row per area: runs, mean position over distinct places, vertical, bearing statistics.

    A place passed by many runs counts once, which sets this apart from the area metrics. Steps
    that stay in place are edges, but have no direction and add nothing. Without any edge vertical
    and statistics are NULL; with still steps alone they are 0.

    One pass: everything is additive, first per area and place, then per area.
    """
    moves = "distance_horizontal > 0"
    vertical = f"if({moves}, distance_vertical_drop, NULL)"
    places = (
        area_points(runs, coordinates)
        .groupBy("ski_area_id", "longitude", "latitude")
        .agg(
            F.expr("count_if(coalesce(index, 0) = 0) AS _heads"),
            F.expr("count(segment_hash) AS _edges"),
            F.expr(f"sum({vertical}) AS combined_vertical"),
            *circular.direction_sums("bearing", vertical, vertical),
        )
    )
    summed = places.groupBy("ski_area_id").agg(
        F.expr("sum(_heads) AS run_count"),
        F.expr("sum(_edges) AS _edges"),
        F.expr("if(sum(_edges) > 0, coalesce(sum(combined_vertical), 0D), NULL) AS combined_vertical"),
        F.expr("avg(if(latitude IS NOT NULL, latitude, NULL)) AS latitude"),
        F.expr("avg(if(latitude IS NOT NULL, longitude, NULL)) AS longitude"),
        *circular.merged_direction_sums(),
    )
    north = F.when(F.col("latitude") > 0, 1).when(F.col("latitude").isNotNull(), -1)
    only_with_edges = {n: F.when(F.col("_edges") > 0, F.col(n)) for n in BEARING_STATS}
    return (
        summed.withColumn("hemisphere", F.when(north > 0, "north").when(north < 0, "south"))
        .withColumns({"_sign_min": north, "_sign_max": north})
        .transform(circular.with_direction_stats)
        .withColumns(only_with_edges)
        .select(
            "ski_area_id",
            "run_count",
            "latitude",
            "longitude",
            "hemisphere",
            "combined_vertical",
            *BEARING_STATS,
        )
    )
