"""The table readers see, its footers, and the geometry of its roses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallline.functions.filters import display_filters
from fallline.functions.text import bin_key, flag_emoji, prefix_columns, round_doubles
from fallline.operators.areas import explode_bins
from fallline.operators.rollups import filtered
from fallline.operators.tables import first_of_each

#: Shown histogram bins, as resolution and wind.
CARDINAL_BINS = ((4, "N"), (4, "E"), (4, "S"), (4, "W"), (2, "N"))

FRONTEND_COLUMNS = (
    "country",
    "country_code",
    "region",
    "locality",
    "latitude",
    "run_count",
    "lift_count",
    "combined_vertical",
    "min_elevation",
    "max_elevation",
    "vertical_drop",
    "bearing_mean",
    "bearing_alignment",
    "poleward_affinity",
    "eastward_affinity",
)


def cardinal_pivot(distribution: DataFrame) -> DataFrame:
    """Long histogram table to one row per area with the shares of the main directions."""
    keys = [f"{n}_{wind}" for n in (2, 4) for wind in ("N", "E", "S", "W")[:: 4 // n]]
    wide = (
        distribution.filter(F.col("num_bins").isin(2, 4))
        .withColumn("_key", bin_key(F.col("num_bins"), F.col("bin_label")))
        .groupBy("ski_area_id")
        .pivot("_key", keys)
        .agg(F.round(F.max("bin_proportion"), 5))
    )
    shown = [f"{n}_{wind}" for n, wind in CARDINAL_BINS]
    return prefix_columns(
        wide.select("ski_area_id", *shown), "bin_proportion_", ("ski_area_id",)
    )


def cardinal_share(num_bins: int, wind: str) -> Column:
    """The same share straight from the histogram list of an area row."""
    matching = F.filter(
        "bearings", lambda b: (b["num_bins"] == num_bins) & (b["bin_label"] == wind)
    )
    return F.round(F.try_element_at(matching, F.lit(1))["bin_proportion"], 5)


def frontend_table(areas: DataFrame) -> DataFrame:
    """Areas worth showing, with flag and direction shares, rounded and sorted by name.

    The shares are read from the row's own histogram, which gives what a pivot of the long table
    and a join back would, without either shuffle.
    """
    table = filtered(areas, display_filters()).select(
        "ski_area_id",
        "ski_area_name",
        "osm_status",
        flag_emoji(F.col("country_code")).alias("country_emoji"),
        *FRONTEND_COLUMNS,
        *[cardinal_share(n, w).alias(f"bin_proportion_{n}_{w}") for n, w in CARDINAL_BINS],
        F.col("ski_area_id").alias("rose"),
    )
    return round_doubles(table, 4).orderBy("ski_area_name")


def weighted_mean(value: str, weight: str = "combined_vertical") -> Column:
    """Mean weighted by vertical; rows without a value count as 0, as in the table's footer."""
    return F.try_divide(
        F.sum(F.col(weight) * F.coalesce(value, F.lit(0.0))), F.sum(F.col(weight))
    )


def footer_summary(table: DataFrame) -> DataFrame:
    """The footers of the shown table in one row."""
    return table.agg(
        F.count_distinct("country").alias("country_distinct"),
        F.count_distinct("region").alias("region_distinct"),
        F.count_distinct("locality").alias("locality_distinct"),
        *[
            F.sum(c).alias(f"{c}_sum")
            for c in ("run_count", "lift_count", "combined_vertical", "vertical_drop")
        ],
        F.min("min_elevation").alias("min_elevation_min"),
        F.max("max_elevation").alias("max_elevation_max"),
        *[
            weighted_mean(f"bin_proportion_{n}_{w}").alias(f"bin_proportion_{n}_{w}_mean")
            for n, w in CARDINAL_BINS
        ],
    )


def rose_geometry(
    groups: DataFrame,
    key: str,
    num_bins: int,
    area: bool = True,
    shared_scale: bool = False,
) -> DataFrame:
    """Angle, width and length of each petal of each group's rose.

    With ``area`` a petal's surface is proportional to its count, else its length. The axis ends at
    the longest petal of the group, or of all groups with ``shared_scale``.
    """

    def length(count: Column) -> Column:
        return F.sqrt(count) if area else count

    bins = F.filter("bearings", lambda b: b["num_bins"] == num_bins)
    rows = groups.select(key, bins.alias("_bins")).withColumn(
        "_limit", F.array_max(F.transform("_bins", lambda b: length(b["bin_count"])))
    )
    limit = rows.agg(F.max("_limit")).scalar() if shared_scale else F.col("_limit")
    return rows.withColumn("axis_limit", limit).transform(
        explode_bins, [key, "axis_limit"], "_bins"
    ).select(
        key,
        "bin_index",
        F.radians("bin_center").alias("angle"),
        F.radians(F.lit(360.0 / num_bins)).alias("width"),
        length(F.col("bin_count")).alias("radius"),
        "axis_limit",
    )


def _showable(max_name: int) -> list[Column]:
    return [
        F.col("run_count") >= 3,
        F.col("combined_vertical") >= 50,
        F.col("ski_area_name") != "",
        F.length("ski_area_name") < max_name,
    ]


def showcase_countries(
    areas: DataFrame, order: Column, sample: int = 48, max_name: int = 20, num_bins: int = 32
) -> DataFrame:
    """Histograms of a reproducible sample of the areas of every country at once.

    Areas without a country are left out.
    """
    shown = filtered(areas, [*_showable(max_name), F.col("country").isNotNull()])
    keys = ["country", "ski_area_id", "ski_area_name"]
    return (
        first_of_each(shown.select(*keys, "bearings"), ["country"], [order, "ski_area_id"], sample)
        .transform(explode_bins, keys)
        .filter(F.col("num_bins") == num_bins)
    )


def showcase_areas(
    areas: DataFrame,
    country: str,
    order: Column,
    always: str,
    sample: int = 48,
    max_name: int = 20,
    num_bins: int = 32,
) -> DataFrame:
    """Histograms of a reproducible sample of a country's areas and of one chosen area.

    The sample is the first rows by ``order``, a hash of the id, so it does not depend on how the
    table is partitioned; Spark keeps only the best rows of each task.
    """
    predicates = [*_showable(max_name), F.col("country") == country]
    sampled = filtered(areas, predicates).orderBy(order, "ski_area_id").limit(sample)
    chosen = areas.filter(F.col("ski_area_name") == always)
    columns = ["ski_area_id", "ski_area_name", "bearings"]
    return (
        sampled.select(*columns)
        .unionByName(chosen.select(*columns))
        .transform(explode_bins, ["ski_area_id", "ski_area_name"])
        .filter(F.col("num_bins") == num_bins)
        .orderBy("ski_area_name", "ski_area_id", "bin_index")
    )
