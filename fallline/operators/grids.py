"""Downhill vertical by latitude, and by latitude and direction."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fallline.functions import circular
from fallline.functions.geo import flip_bearing, hemisphere, hemisphere_sign_sql
from fallline.operators.areas import is_downhill
from fallline.operators.segments import explode_coordinates, explode_segments
from fallline.schema import SEGMENT_FIELDS


def bin_number(value: Column, top: float, bins: int) -> Column:
    """0-based number of the left-closed bin of equal width on [0, top); ``bins`` from top on."""
    number = F.floor(value * bins / top)
    return F.when(value >= top, F.lit(bins)).otherwise(number).cast("int")


def bin_upper(number: Column, top: float, bins: int) -> Column:
    """Upper edge of a bin; infinity beyond the last edge."""
    return F.when(number >= bins, F.lit(float("inf"))).otherwise(number_edge(number + 1, top, bins))


def number_edge(number: Column, top: float, bins: int) -> Column:
    return number * F.lit(top) / F.lit(float(bins))


@dataclass(frozen=True)
class Grid:
    """A grid of bands of absolute latitude and sectors of poleward bearing.

    The number of cells is fixed by these parameters and does not grow with the data, which is why
    the cell table and the sums per cell may be broadcast.
    """

    latitude_bins: int = 30
    bearing_bins: int = 90
    prior_vertical: float = 20_000


def latitude_bands(grid: Grid, spark: SparkSession, by_hemisphere: bool = False) -> DataFrame:
    """All latitude bands, for both hemispheres if asked."""
    n = grid.latitude_bins
    number = F.col("id").cast("int")
    bands = spark.range(n, numPartitions=1).select(
        number.alias("_band"),
        number_edge(number, 90.0, n).alias("latitude_abs_bin_lower"),
        number_edge(number + 1, 90.0, n).alias("latitude_abs_bin_upper"),
    )
    bands = bands.withColumn(
        "latitude_abs_bin_center",
        (F.col("latitude_abs_bin_lower") + F.col("latitude_abs_bin_upper")) / 2,
    )
    if not by_hemisphere:
        return bands
    return bands.withColumn("hemisphere", F.lit("north")).unionByName(
        bands.withColumn("hemisphere", F.lit("south"))
    )


def cells(grid: Grid, spark: SparkSession) -> DataFrame:
    """All cells of the grid: every band with every sector."""
    n = grid.bearing_bins
    sector = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = F.col("_sector")
    return latitude_bands(grid, spark).select("*", sector.alias("_sector")).withColumns(
        {
            "bearing_bin_lower": number_edge(number, 360.0, n),
            "bearing_bin_upper": number_edge(number + 1, 360.0, n),
            "bearing_bin_center": (
                number_edge(number, 360.0, n) + number_edge(number + 1, 360.0, n)
            )
            / 2,
        }
    )


def binned_segments(
    grid: Grid, runs: DataFrame, coordinates: str = "run_coordinates_clean"
) -> DataFrame:
    """Segments of downhill runs with their band, sector and hemisphere.

    A run counts once here, however many areas it belongs to.
    """
    downhill = runs.filter(is_downhill()).select("run_id", coordinates)
    element = runs.schema[coordinates].dataType.elementType
    enriched = set(SEGMENT_FIELDS) <= set(element.fieldNames())
    segments = (explode_coordinates if enriched else explode_segments)(downhill, coordinates)
    latitude_abs = F.abs("latitude")
    poleward = flip_bearing(F.col("latitude"), F.col("bearing"))
    return segments.filter(F.col("segment_hash").isNotNull()).select(
        "run_id",
        "latitude",
        "bearing",
        "segment_hash",
        "distance_vertical_drop",
        F.expr(hemisphere_sign_sql()).alias("_sign"),
        hemisphere().alias("hemisphere"),
        latitude_abs.alias("latitude_abs"),
        poleward.alias("bearing_poleward"),
        bin_number(latitude_abs, 90.0, grid.latitude_bins).alias("_band"),
        bin_number(poleward, 360.0, grid.bearing_bins).alias("_sector"),
    )


def with_bin_edges(grid: Grid, binned: DataFrame) -> DataFrame:
    """Band and sector as the upper edges of their bins."""
    return binned.withColumns(
        {
            "latitude_abs_bin_upper": bin_upper(F.col("_band"), 90.0, grid.latitude_bins),
            "bearing_bin_upper": bin_upper(F.col("_sector"), 360.0, grid.bearing_bins),
        }
    )


def _sums() -> list[Column]:
    return [
        F.count("segment_hash").alias("segment_count"),
        F.coalesce(F.sum("distance_vertical_drop"), F.lit(0.0)).alias("combined_vertical"),
    ]


def latitude_histogram(
    grid: Grid, runs: DataFrame, coordinates: str = "run_coordinates_clean"
) -> DataFrame:
    """Segments, vertical and bearing statistics of every band in each hemisphere."""
    vertical = "distance_vertical_drop"
    sums = circular.direction_sums("bearing", vertical, vertical, "_sign")
    found = (
        binned_segments(grid, runs, coordinates)
        .groupBy("hemisphere", "_band")
        .agg(*_sums(), *sums)
        .transform(circular.with_direction_stats)
    )
    bands = latitude_bands(grid, runs.sparkSession, by_hemisphere=True)
    return (
        bands.join(F.broadcast(found), ["hemisphere", "_band"], "left")
        .drop("_band")
        .withColumns(_filled())
        .orderBy("hemisphere", "latitude_abs_bin_lower")
    )


def latitude_bearing_histogram(
    grid: Grid, runs: DataFrame, coordinates: str = "run_coordinates_clean"
) -> DataFrame:
    """Vertical of every cell, its share of the band, and how enriched the direction is.

    The regularised columns add a prior spread evenly over the sectors, so bands with little
    vertical stay close to even. Shares in an empty band are NULL.
    """
    found = binned_segments(grid, runs, coordinates).groupBy("_band", "_sector").agg(*_sums())
    n = grid.bearing_bins
    band = Window.partitionBy("_band")  # bearing_bins rows each
    vertical, total = F.col("combined_vertical"), F.col("total_combined_vertical")
    share, regular = (
        F.col("combined_vertical_prop"),
        F.col("combined_vertical_prop_regularized"),
    )
    return (
        cells(grid, runs.sparkSession)
        .join(F.broadcast(found), ["_band", "_sector"], "left")
        .withColumns(_filled())
        .withColumn("total_combined_vertical", F.sum("combined_vertical").over(band))
        .withColumns(
            {
                "combined_vertical_prop": F.try_divide(vertical, total),
                "bearing_bin_center_radians": F.radians("bearing_bin_center"),
                "combined_vertical_prop_regularized": (vertical + grid.prior_vertical / n)
                / (total + grid.prior_vertical),
            }
        )
        .withColumns(
            {
                "combined_vertical_enrichment": share * n,
                "combined_vertical_enrichment_regularized": regular * n,
            }
        )
        .drop("_band", "_sector")
        .orderBy("latitude_abs_bin_upper", "bearing_bin_upper")
    )


def mesh(grid: Grid, cells: DataFrame, min_vertical: float = 10_000) -> DataFrame:
    """Matrix of regularised enrichment, a row per band and a column per sector.

    Bands with too little vertical are NULL. Columns are ``bearing_`` and the lower edge of the
    sector in degrees. The column list comes from the parameters, so no job looks for it.
    """
    shown = F.when(
        F.col("total_combined_vertical") >= min_vertical,
        F.col("combined_vertical_enrichment_regularized"),
    )
    n = grid.bearing_bins
    lower_edges = [i * 360.0 / n for i in range(n)]
    matrix = (
        cells.select("latitude_abs_bin_lower", "bearing_bin_lower", shown.alias("_value"))
        .groupBy("latitude_abs_bin_lower")
        .pivot("bearing_bin_lower", lower_edges)
        .agg(F.max("_value"))
    )
    return matrix.toDF(
        "latitude_abs_bin_lower", *[f"bearing_{edge:g}" for edge in lower_edges]
    ).orderBy("latitude_abs_bin_lower")


def clip_values(df: DataFrame, keep: tuple[str, ...], low: float, high: float) -> DataFrame:
    """Limit all columns but those in ``keep`` to [low, high]; NULL stays NULL."""
    return df.selectExpr(
        *[
            f"`{c}`"
            if c in keep
            else f"if(`{c}` IS NULL, NULL, least(greatest(`{c}`, {low}D), {high}D)) AS `{c}`"
            for c in df.columns
        ]
    )


def _filled() -> dict[str, Column]:
    return {
        "segment_count": F.coalesce("segment_count", F.lit(0)),
        "combined_vertical": F.round(F.coalesce("combined_vertical", F.lit(0.0)), 5),
    }
