"""Roll-ups of the area table. Histograms and statistics are combined, not computed again."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallline.functions import circular
from fallline.functions.text import status_label
from fallline.operators.areas import explode_bins
from fallline.schema import COMPASS_RESOLUTIONS

_COUNTS = ("run_count", "coordinate_count", "segment_count", "lift_count")
_LENGTHS = ("combined_vertical", "combined_distance")


def filtered(areas: DataFrame, predicates: Sequence[Column] | None = None) -> DataFrame:
    """Areas that meet all predicates; all areas when there are none."""
    return areas.filter(reduce(lambda a, b: a & b, predicates)) if predicates else areas


def rollup_histogram(
    areas: DataFrame, group: list[str], predicates: Sequence[Column] | None = None
) -> DataFrame:
    """Histogram per group: bin counts added up, proportions within group and resolution, sorted."""
    return _summed_bins(areas, group, predicates).orderBy(*group, "num_bins", "bin_index")


def _summed_bins(
    areas: DataFrame, group: list[str], predicates: Sequence[Column] | None
) -> DataFrame:
    bins = (
        filtered(areas, predicates)
        .transform(explode_bins, group)
        .groupBy(*group, "num_bins", "bin_index")
        .agg(
            F.max("bin_center").alias("bin_center"),
            F.coalesce(F.sum("bin_count"), F.lit(0.0)).alias("bin_count"),
        )
    )
    # at most num_bins rows in each window partition
    total = F.sum("bin_count").over(Window.partitionBy(*group, "num_bins"))
    return bins.withColumn("_total", total).select(
        *group,
        "num_bins",
        "bin_index",
        "bin_center",
        "bin_count",
        circular.compass_label(F.col("bin_center")).alias("bin_label"),
        F.when(F.col("_total") > 0, F.col("bin_count") / F.col("_total"))
        .otherwise(0.0)
        .alias("bin_proportion"),
    )


def _by_country(areas: DataFrame, group: list[str], *more: Column) -> DataFrame:
    """Mergeable sums per group and country."""
    sign = "(CASE hemisphere WHEN 'north' THEN 1 WHEN 'south' THEN -1 END)"
    return areas.groupBy(*group, F.col("country").alias("_country")).agg(
        F.expr("count(DISTINCT ski_area_id) AS ski_areas_count"),
        *[F.expr(f"sum({c}) AS {c}") for c in _COUNTS + _LENGTHS],
        F.expr("min(min_elevation) AS min_elevation"),
        F.expr("max(max_elevation) AS max_elevation"),
        F.expr("sum(latitude) AS _latitude_sum"),
        F.expr("count(latitude) AS _latitude_count"),
        F.expr("sum(longitude) AS _longitude_sum"),
        F.expr("count(longitude) AS _longitude_count"),
        *circular.direction_sums(
            "bearing_mean", "bearing_magnitude_net", "bearing_magnitude_cum", sign
        ),
        *more,
    )


def _merged(by_country: DataFrame, group: list[str], *more: Column) -> DataFrame:
    """Metrics and statistics per group; each country, and the missing one, is one row to count."""
    return (
        by_country.groupBy(*group)
        .agg(
            F.expr("sum(ski_areas_count) AS ski_areas_count"),
            F.expr("count(1) AS country_count"),
            *[F.expr(f"coalesce(sum({c}), 0L) AS {c}") for c in _COUNTS],
            *[F.expr(f"coalesce(sum({c}), 0D) AS {c}") for c in _LENGTHS],
            F.expr("min(min_elevation) AS min_elevation"),
            F.expr("max(max_elevation) AS max_elevation"),
            F.expr("try_divide(sum(_latitude_sum), sum(_latitude_count)) AS latitude"),
            F.expr("try_divide(sum(_longitude_sum), sum(_longitude_count)) AS longitude"),
            *circular.merged_direction_sums(),
            *more,
        )
        .withColumn("vertical_drop", F.col("max_elevation") - F.col("min_elevation"))
        .transform(circular.with_direction_stats)
    )


def rollup(
    areas: DataFrame, group: list[str], predicates: Sequence[Column] | None = None
) -> DataFrame:
    """Metrics, bearing statistics and histograms per group, sorted by group.

    Groups that are NULL or hold no histogram have no row. ``areas`` is read twice, for scalars and
    for bins, so it should be a stored table.
    """
    scalars = _merged(_by_country(filtered(areas, predicates), group), group)
    bin_struct = F.struct(
        "num_bins", "bin_index", "bin_center", "bin_count", "bin_proportion", "bin_label"
    )
    histograms = (
        _summed_bins(areas, group, predicates)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(bin_struct)).alias("bearings"))
    )
    return scalars.join(histograms, group).orderBy(*group)


def at_least(groups: DataFrame, min_combined_vertical: float = 10_000) -> DataFrame:
    """Groups large enough to be shown."""
    return groups.filter(F.col("combined_vertical") >= min_combined_vertical)


def _operating_and_named(group: str) -> list[Column]:
    return [
        F.col(group).isNotNull(),
        F.col("osm_status") == "operating",
        F.col("ski_area_name").isNotNull(),
    ]


STATE_COUNTRY = "United States"


def preset(name: str, country: str = STATE_COUNTRY) -> tuple[list[str], list[Column]]:
    """The group columns and predicates of a preset; ``region`` has the regions of one country."""
    if name == "hemisphere_status":
        which = [F.col("hemisphere") == "north", F.col("osm_status").isin("abandoned", "operating")]
        return ["hemisphere", "osm_status"], which
    within = [F.col("country") == country] if name == "region" else []
    return [name], [*within, *_operating_and_named(name)]


def rollup_by_state(areas: DataFrame, country: str = STATE_COUNTRY) -> DataFrame:
    """Regions of one country."""
    return rollup(areas, *preset("region", country))


def rollup_by_hemisphere(areas: DataFrame) -> DataFrame:
    return rollup(areas, *preset("hemisphere"))


def rollup_by_country(areas: DataFrame) -> DataFrame:
    return rollup(areas, *preset("country"))


def rollup_by_status(areas: DataFrame) -> DataFrame:
    """Operating against abandoned areas of the northern hemisphere, with a readable label."""
    return rollup(areas, *preset("hemisphere_status")).withColumn("hemisphere_status", status_label(F.col("osm_status"), F.col("hemisphere")))


PRESETS = {
    "hemisphere": rollup_by_hemisphere,
    "hemisphere_status": rollup_by_status,
    "country": rollup_by_country,
    "region": rollup_by_state,
}

#: Columns that tell the groups of all presets apart; those that a preset does not group by are NULL.
PRESET_KEYS = ["preset", "hemisphere", "osm_status", "country", "region"]


def rollup_presets(areas: DataFrame, country: str = STATE_COUNTRY) -> DataFrame:
    """The groups of all presets, told apart by ``preset``, from one scan of ``areas``.

    An area is expanded to a row for each preset that takes it. Scalars and histograms are mergeable sums
    with numeric buffers in one grouped aggregation, so a scan and two exchanges of sums give
    everything. The histograms of ``areas`` must be those of the area metrics: every resolution of
    ``COMPASS_RESOLUTIONS``, bins in order.
    """
    taken = []
    for name in PRESETS:
        keys, predicates = preset(name, country)
        values = [F.col(k) if k in keys else F.lit(None).cast("string") for k in PRESET_KEYS[1:]]
        named = [v.alias(f"_of_{k}") for v, k in zip(values, PRESET_KEYS[1:])]
        taken.append(F.when(reduce(lambda a, b: a & b, predicates), F.struct(F.lit(name).alias("_of_preset"), *named)))
    expanded = areas.withColumn("_group", F.explode(F.array_compact(F.array(*taken))))
    group = [f"_of_{k}" for k in PRESET_KEYS]
    expanded = expanded.select("*", *[F.col(f"_group._of_{k}").alias(f"_of_{k}") for k in PRESET_KEYS])

    starts, n = [], 0
    for resolution in COMPASS_RESOLUTIONS:
        starts.append((resolution, n))
        n += resolution
    bins = [F.sum(F.get("bearings", F.lit(k))["bin_count"]).alias(f"_bin{k}") for k in range(n)]
    held = F.sum(F.when(F.size("bearings") > 0, 1)).alias("_held")
    by_country = _by_country(expanded, group, *bins, held)
    merged = _merged(by_country, group, *[F.sum(f"_bin{k}").alias(f"_bin{k}") for k in range(n)], F.sum("_held").alias("_held"))

    counts = F.array(*[F.coalesce(f"_bin{k}", F.lit(0.0)) for k in range(n)])
    parts = ", ".join(f"named_struct('n', {r}, 'start', {s})" for r, s in starts)
    listed = f"""flatten(transform(array({parts}), r -> transform(sequence(0, r.n - 1), i -> named_struct(
        'num_bins', r.n, 'bin_index', i + 1, 'bin_center', i * 360D / r.n, 'bin_count', _counts[r.start + i],
        'total', aggregate(slice(_counts, r.start + 1, r.n), 0D, (a, x) -> a + x)))))"""
    labelled = F.transform(
        "_bins",
        lambda b: F.struct(
            b["num_bins"].alias("num_bins"), b["bin_index"].alias("bin_index"), b["bin_center"].alias("bin_center"),
            b["bin_count"].alias("bin_count"),
            F.when(b["total"] > 0, b["bin_count"] / b["total"]).otherwise(0.0).alias("bin_proportion"),
            circular.compass_label(b["bin_center"]).alias("bin_label"),
        ),
    )
    metrics = [c for c in merged.columns if c not in group and not c.startswith(("_bin", "_held"))]
    label = F.when(F.col("_of_preset") == "hemisphere_status", status_label(F.col("_of_osm_status"), F.col("_of_hemisphere")))
    return (
        merged.filter("_held > 0")
        .withColumn("_counts", counts)
        .withColumn("_bins", F.expr(listed))
        .select(
            *[F.col(f"_of_{k}").alias(k) for k in PRESET_KEYS], label.alias("hemisphere_status"), *metrics, labelled.alias("bearings")
        )
    )


def of_preset(groups: DataFrame, name: str) -> DataFrame:
    """One preset out of :func:`rollup_presets`, with the columns that its own roll-up has, sorted."""
    keys, _ = preset(name)
    dropped = [k for k in PRESET_KEYS if k not in keys]
    extra = [] if name == "hemisphere_status" else ["hemisphere_status"]
    return groups.filter(F.col("preset") == name).drop(*dropped, *extra).orderBy(*keys)
