"""Ski areas: which runs belong to them, and what those runs add up to."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallline.functions import circular
from fallline.functions.coords import path_triples, sources_to_urls
from fallline.functions.geo import hemisphere_sign_sql
from fallline.operators.segments import explode_coordinates, explode_segments
from fallline.schema import (
    AREA_DEFAULTS,
    AREA_METRICS,
    COMPASS_RESOLUTIONS,
    SEGMENT_FIELDS,
)


def is_downhill(uses: str = "run_uses") -> Column:
    return F.array_contains(uses, "downhill")


def run_area_bridge(runs: DataFrame, ids: str = "ski_area_ids") -> DataFrame:
    """One row per run and ski area; runs without an area drop out."""
    others = [c for c in runs.columns if c != ids]
    return runs.select(F.explode_outer(ids).alias("ski_area_id"), *others).filter(
        F.col("ski_area_id").isNotNull()
    )


def lift_count(lifts: DataFrame) -> DataFrame:
    """Number of distinct operating lifts per area."""
    return (
        lifts.filter(F.col("lift_status") == "operating")
        .transform(run_area_bridge)
        .groupBy("ski_area_id")
        .agg(F.count_distinct("lift_id").alias("lift_count"))
    )


def area_dimension(areas: DataFrame, lifts: DataFrame) -> DataFrame:
    """Descriptive columns of the downhill areas with their lift counts.

    ``areas`` has the flattened properties made by ``load_ski_areas``.
    """
    return (
        areas.filter((F.col("type") == "skiArea") & F.array_contains("activities", "downhill"))
        .select(
            "ski_area_id",
            "ski_area_name",
            F.col("generated").alias("osm_is_generated"),
            F.col("runConvention").alias("osm_run_convention"),
            F.col("status").alias("osm_status"),
            F.col("location__localized__en__country").alias("country"),
            F.col("location__localized__en__region").alias("region"),
            F.col("location__localized__en__locality").alias("locality"),
            F.col("location__iso3166_1Alpha2").alias("country_code"),
            F.col("location__iso3166_2").alias("country_subdiv_code"),
            F.col("websites").alias("ski_area_websites"),
            sources_to_urls("sources").alias("ski_area_sources"),
        )
        .join(lift_count(lifts), "ski_area_id", "left")
    )


def area_points(runs: DataFrame, coordinates: str = "run_coordinates_clean") -> DataFrame:
    """Coordinates with their segment metrics, one row per area, run and point.

    Takes cleaned runs as well as exported ones, whose lists already carry the metrics.
    """
    linked = run_area_bridge(
        runs.filter(is_downhill()).select("run_id", "ski_area_ids", coordinates)
    )
    element = runs.schema[coordinates].dataType.elementType
    if set(SEGMENT_FIELDS) <= set(element.fieldNames()):
        return explode_coordinates(linked, coordinates)
    return explode_segments(linked, coordinates)


def fine_cell_sums(
    points: DataFrame,
    group: list[str],
    resolutions: tuple[int, ...] = COMPASS_RESOLUTIONS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Everything additive about points, per group and fine compass cell.

    The one wide shuffle of the area metrics: map-side aggregation leaves at most one row per group
    and cell (64 cells and one for points without direction) in each task, and cells of a large
    group spread over tasks. All buffers are numbers, so hashing is used throughout.
    """
    cell = circular.fine_cell("bearing", circular.fine_cells(resolutions)).alias("_cell")
    vertical = "distance_vertical_drop"
    return points.groupBy(*group, cell).agg(
        F.expr("count(1) AS coordinate_count"),
        F.expr("count(segment_hash) AS segment_count"),
        F.expr(f"sum({vertical}) AS combined_vertical"),
        F.expr("sum(distance_3d) AS combined_distance"),
        F.expr("sum(latitude) AS _latitude_sum"),
        F.expr("count(latitude) AS _latitude_count"),
        F.expr("sum(longitude) AS _longitude_sum"),
        F.expr("count(longitude) AS _longitude_count"),
        F.expr("min(elevation) AS min_elevation"),
        F.expr("max(elevation) AS max_elevation"),
        *circular.direction_sums("bearing", vertical, vertical, hemisphere_sign_sql()),
        *extra,
    )


def _cell_entries(weight: str) -> Column:
    """The weights of a group's fine cells as one short list."""
    return F.expr(
        f"collect_list(struct(_cell, coalesce({weight}, 0D))) FILTER (WHERE _cell IS NOT NULL) "
        "AS _entries"
    )


#: How the columns of :func:`fine_cell_sums` are combined.
_COMBINE = {
    "coordinate_count": "sum",
    "segment_count": "sum",
    "combined_vertical": "sum",
    "combined_distance": "sum",
    "_latitude_sum": "sum",
    "_latitude_count": "sum",
    "_longitude_sum": "sum",
    "_longitude_count": "sum",
    "min_elevation": "min",
    "max_elevation": "max",
}


def _combined() -> list[Column]:
    own = [F.expr(f"{function}({name}) AS {name}") for name, function in _COMBINE.items()]
    return own + circular.merged_direction_sums()


def merge_cells(
    cells: DataFrame,
    group: list[str],
    resolutions: tuple[int, ...] = COMPASS_RESOLUTIONS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Group metrics, bearing statistics and histograms from :func:`fine_cell_sums`."""
    averages = ("_latitude_sum", "_latitude_count", "_longitude_sum", "_longitude_count")
    return (
        cells.groupBy(*group)
        .agg(*_combined(), _cell_entries("combined_vertical"), *extra)
        .withColumns(
            {
                "combined_vertical": F.expr("coalesce(combined_vertical, 0D)"),
                "combined_distance": F.expr("coalesce(combined_distance, 0D)"),
                "latitude": F.expr("try_divide(_latitude_sum, _latitude_count)"),
                "longitude": F.expr("try_divide(_longitude_sum, _longitude_count)"),
                "vertical_drop": F.expr("max_elevation - min_elevation"),
            }
        )
        .drop(*averages)
        .transform(circular.with_direction_stats)
        .transform(circular.with_histograms, "_entries", resolutions)
    )


def area_run_metrics(runs: DataFrame, coordinates: str = "run_coordinates_clean") -> DataFrame:
    """Metrics of each area's downhill runs; a run in two areas counts in both.

    One pass over the points. The first point of a run never has a direction, so it is grouped by
    run instead of by compass cell. That leaves one row per area and run, which gives the number
    of distinct runs and the hemisphere of the first run without a distinct aggregate. Which run
    is first is decided by a fixed hash of its id: a number, so that all aggregates over many rows
    hash, where the id itself would make Spark sort.
    """
    points = area_points(runs, coordinates).withColumn(
        "_head", F.expr("if(coalesce(index, 0) = 0, run_id, NULL)")
    )
    by_head = fine_cell_sums(
        points,
        ["ski_area_id", "_head"],
        extra=[F.expr(f"min({hemisphere_sign_sql()}) AS _first_sign")],
    ).withColumn("_order", F.expr("cast(conv(left(md5(_head), 15), 16, 10) AS bigint)"))
    by_cell = by_head.groupBy("ski_area_id", "_cell").agg(
        *_combined(),
        F.expr("count(_head) AS run_count"),
        F.expr("min_by(_first_sign, _order) AS _first_sign"),
        F.expr("min(_order) AS _order"),
    )
    return (
        merge_cells(
            by_cell,
            ["ski_area_id"],
            extra=[
                F.expr("sum(run_count) AS run_count"),
                F.expr("min_by(_first_sign, _order) AS _first_sign"),
            ],
        )
        .withColumn("hemisphere", F.expr("CASE _first_sign WHEN 1 THEN 'north' WHEN -1 THEN 'south' END"))
        .drop("_first_sign")
    )


def area_metrics(
    dimension: DataFrame, runs: DataFrame, coordinates: str = "run_coordinates_clean"
) -> DataFrame:
    """The area table: description, lifts, run metrics, bearing statistics and histograms.

    Areas without runs stay, with zero counts and sums and otherwise NULL metrics.
    """
    joined = dimension.join(area_run_metrics(runs, coordinates), "ski_area_id", "left")
    return joined.fillna(AREA_DEFAULTS).select(AREA_METRICS.fieldNames())


def bearing_distribution(areas: DataFrame) -> DataFrame:
    """Long histogram table, one row per area, resolution and bin."""
    return explode_bins(areas, ["ski_area_id"])


def explode_bins(areas: DataFrame, keys: list[str], bins: str = "bearings") -> DataFrame:
    """One row per bin with its fields; rows without histogram drop out.

    For the inner form Spark would add a filter on the list's size and push it down to where the
    list is computed, so the list would be computed twice. The outer form avoids that.
    """
    return areas.select(*keys, F.inline_outer(bins)).filter(F.col("num_bins").isNotNull())


def bearing_histogram(points: DataFrame, group: list[str], num_bins: int) -> DataFrame:
    """One histogram per group, at any resolution, from rows with a bearing and a weight."""
    cells = circular.fine_cells((num_bins,))
    sums = points.groupBy(*group, circular.fine_cell("bearing", cells).alias("_cell")).agg(
        F.sum("weight").alias("_weight")
    )
    return (
        sums.groupBy(*group)
        .agg(_cell_entries("_weight"))
        .transform(circular.with_histograms, "_entries", (num_bins,))
        .transform(explode_bins, group)
    )


def bearing_stats(
    rows: DataFrame,
    group: list[str],
    net: str | None = None,
    cum: str | None = None,
    latitude: str | None = None,
    bearing: str = "bearing",
) -> DataFrame:
    """The six bearing statistics per group of weighted bearings."""
    sign = hemisphere_sign_sql(latitude) if latitude else None
    return (
        rows.groupBy(*group)
        .agg(*circular.direction_sums(bearing, net, cum, sign))
        .transform(circular.with_direction_stats)
    )


def runs_of_area(
    runs: DataFrame, ski_area_id: str, coordinates: str = "run_coordinates_clean"
) -> DataFrame:
    """Points of one area's runs with their segment metrics, for export."""
    return run_points(runs.filter(F.array_contains("ski_area_ids", ski_area_id)), coordinates)


def run_points(
    runs: DataFrame, coordinates: str = "run_coordinates_clean", keys: Sequence[str] = ()
) -> DataFrame:
    """Points of the runs with their segment metrics, for export; ``keys`` names further columns."""
    points = runs.select(*keys, "run_id", "run_name", "run_difficulty", coordinates)
    element = runs.schema[coordinates].dataType.elementType
    enriched = set(SEGMENT_FIELDS) <= set(element.fieldNames())
    exploded = (explode_coordinates if enriched else explode_segments)(points, coordinates)
    return exploded.drop("segment_hash")


def area_run_paths(runs: DataFrame, coordinates: str = "run_coordinates_clean") -> DataFrame:
    """The runs of each area as lists of ``[longitude, latitude, elevation]``.

    One row per area and run. A popular area is many rows, never one long list.
    """
    return run_area_bridge(
        runs.filter(is_downhill()).select(
            "run_id",
            "ski_area_ids",
            path_triples(coordinates).alias("run_coordinates"),
        )
    )
