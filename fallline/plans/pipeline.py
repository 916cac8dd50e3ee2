"""The jobs from source files to published tables."""

import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fallline.operators.areas import area_dimension, area_metrics
from fallline.operators.display import frontend_table
from fallline.operators.quality import broken_rows, observed, observed_problems, require_valid, schema_problems
from fallline.operators.rollups import PRESETS, of_preset, rollup_presets
from fallline.operators.tables import content_digests, key_changes
from fallline.sources.features import (
    load_lifts,
    load_runs,
    load_ski_areas,
    read_feature_collection,
    read_feature_lines,
)
from fallline.sources.tables import export_runs, export_table, filtered_scan, scan_runs

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Layout:
    """Where the jobs keep their tables."""

    root: str

    @property
    def runs(self) -> str:
        return f"{self.root}/runs.parquet"

    @property
    def areas(self) -> str:
        return f"{self.root}/ski_area_metrics.parquet"

    @property
    def broken(self) -> str:
        return f"{self.root}/broken_areas.parquet"

    @property
    def digests(self) -> str:
        return f"{self.root}/area_digests.parquet"

    @property
    def rollups(self) -> str:
        return f"{self.root}/rollups.parquet"

    @property
    def frontend(self) -> str:
        return f"{self.root}/frontend.parquet"


def read_features(spark: SparkSession, path: str, kind: str, one_per_line: bool) -> DataFrame:
    reader = read_feature_lines if one_per_line else read_feature_collection
    return reader(spark, path, kind)


def analyze(
    spark: SparkSession,
    sources: dict[str, str],
    layout: Layout,
    one_per_line: bool = True,
    skip_runs: bool = False,
) -> DataFrame:
    """Source files to the stored run and area tables. Returns the stored area table.

    With ``skip_runs`` the run table of an earlier call is used again. The row rules of the area table are counted
    by the pass that writes it. Broken ones are logged as warnings, and their rows written to a side table;
    :func:`validate` raises for them.
    """
    if not skip_runs:
        export_runs(load_runs(read_features(spark, sources["runs"], "runs", one_per_line)), layout.runs)
    dimension = area_dimension(
        load_ski_areas(read_features(spark, sources["ski_areas"], "ski_areas", one_per_line)),
        load_lifts(read_features(spark, sources["lifts"], "lifts", one_per_line)),
    )
    counted, observation = observed(area_metrics(dimension, scan_runs(spark, layout.runs)))
    export_table(counted, layout.areas)
    areas = filtered_scan(spark, layout.areas)
    found = observed_problems(areas, observation)
    for problem in found:
        logger.warning("%s: %s", layout.areas, problem)
    # a table without faults is not read again for an empty side table
    export_table(broken_rows(areas) if found else broken_rows(areas).limit(0), layout.broken)
    return areas


def changed_areas(spark: SparkSession, layout: Layout) -> DataFrame:
    """Areas that are new, changed or removed since :func:`remember_areas`, so their outputs are stale.

    Before the first call of that, all are new.
    """
    now = content_digests(filtered_scan(spark, layout.areas), "ski_area_id")
    try:
        kept = spark.read.schema(now.schema).parquet(layout.digests)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], now.schema)
    return key_changes(now, kept, "ski_area_id")


def remember_areas(spark: SparkSession, layout: Layout) -> None:
    """Keep the digests of the areas; to be called when all outputs made of them are written."""
    export_table(content_digests(filtered_scan(spark, layout.areas), "ski_area_id"), layout.digests)


def validate(spark: SparkSession, layout: Layout) -> DataFrame:
    """Raise unless the stored area table keeps its rules."""
    return require_valid(filtered_scan(spark, layout.areas))


def export_rollups(spark: SparkSession, layout: Layout, **options: str) -> dict[str, DataFrame]:
    """Write all preset groupings as one table, partitioned by preset, from one scan of the areas.

    ``country`` chooses the country for the regions. Returns the groups of each preset.
    """
    areas = filtered_scan(spark, layout.areas)
    assert not schema_problems(areas.schema)
    rollup_presets(areas, **options).write.mode("overwrite").partitionBy("preset").parquet(layout.rollups)
    groups = spark.read.parquet(layout.rollups)
    return {name: of_preset(groups, name) for name in PRESETS}


def export_frontend(spark: SparkSession, layout: Layout) -> DataFrame:
    export_table(frontend_table(filtered_scan(spark, layout.areas)), layout.frontend)
    return spark.read.parquet(layout.frontend)
