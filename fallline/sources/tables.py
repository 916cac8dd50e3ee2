"""Stored tables: reading with push-down, and writing."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallline.operators.areas import run_area_bridge
from fallline.operators.rollups import filtered
from fallline.operators.segments import enrich_runs
from fallline.session import materialize


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def filtered_scan(
    spark: SparkSession, path: str, predicates: Sequence[Column] | None = None
) -> DataFrame:
    """Area table with all predicates applied, which Spark pushes into the Parquet scan."""
    return filtered(spark.read.parquet(path), predicates)


def export_runs(runs: DataFrame, path: str) -> None:
    """Write runs with segment metrics in their coordinate lists."""
    enrich_runs(runs).write.mode("overwrite").parquet(path)


def export_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_area_runs(runs: DataFrame, path: str, digits: int = 2) -> None:
    """Write the runs once per area, so that the runs of one area are read from a few files.

    The folder of an area is named by the first ``digits`` hex digits of the MD5 of its id, and within it rows
    are sorted by area and run, so Parquet's statistics leave out other areas. The range partitioning splits
    an area of any size between tasks.
    """
    order = ["area_part", "ski_area_id", "run_id"]
    bridge = run_area_bridge(runs).withColumn("area_part", _area_part(F.col("ski_area_id"), F.lit(digits)))
    bridge.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
        "area_part"
    ).parquet(path)


def scan_area_runs(spark: SparkSession, path: str, ski_area_ids: Sequence[str]) -> DataFrame:
    """The runs of a few areas, one row per area and run, from the folders of those areas only."""
    digits = F.length("area_part") - 1
    parts = F.lit(False)
    for area in ski_area_ids:
        parts |= F.col("area_part") == _area_part(F.lit(area), digits)
    chosen = F.col("ski_area_id").isin(*ski_area_ids)
    return spark.read.parquet(path).filter(parts & chosen).drop("area_part")


def _area_part(area: Column, digits: Column) -> Column:
    # the letter keeps a folder's name from being read as a number
    return F.concat(F.lit("h"), F.substring(F.md5(area), F.lit(1), digits))


def subset_by_ids(features: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """Areas whose id is in ``ids`` (column ``ski_area_id``), or runs and lifts of such areas.

    A feature of several chosen areas is kept once.
    """
    if kind == "ski_areas":
        return features.join(
            ids.select("ski_area_id"), F.col("properties.id") == F.col("ski_area_id"), "left_semi"
        )
    numbered = features.withColumn("_row", F.monotonically_increasing_id())
    others = [F.first(c).alias(c) for c in features.columns]
    chosen = (
        numbered.withColumn("_area", F.explode("properties.skiAreas.properties.id"))
        .join(ids.select("ski_area_id"), F.col("_area") == F.col("ski_area_id"), "left_semi")
        .drop("_area")
    )
    # the number is made and used in one pass over the features; only chosen ones are shuffled
    return chosen.groupBy("_row").agg(*others).drop("_row")


def subset_by_id_list(features: DataFrame, ids: Sequence[str], kind: str) -> DataFrame:
    """The same for a short list of ids, as a filter without any join."""
    if kind == "ski_areas":
        return features.filter(F.col("properties.id").isin(*ids))
    wanted = F.array(*[F.lit(i) for i in ids])
    return features.filter(
        F.coalesce(F.arrays_overlap("properties.skiAreas.properties.id", wanted), F.lit(False))
    )


def feature_json(features: DataFrame) -> DataFrame:
    """Features as JSON text, with raw coordinates put back as JSON."""
    if not isinstance(
        features.schema["geometry"].dataType["coordinates"].dataType, T.StringType
    ):
        return features.select(
            F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", "geometry")).alias(
                "value"
            )
        )
    marker = "@coordinates@"
    others = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            "properties",
            F.struct(
                F.col("geometry.type").alias("type"), F.lit(marker).alias("coordinates")
            ).alias("geometry"),
        )
    )
    # the geometry is last, so the marker at the end of the text is ours
    stem = F.regexp_replace(others, f'"{marker}"\\}}\\}}$', "")
    return features.select(
        F.concat(stem, F.coalesce("geometry.coordinates", F.lit("null")), F.lit("}}")).alias("value")
    )


def write_feature_texts(features: DataFrame, path: str) -> None:
    """Write features read by ``read_feature_texts`` as they stood in their file, one per line.

    Nothing is parsed and written anew, so properties that no schema names, NULL ones and the types of
    all values are kept.
    """
    features.select("line").write.mode("overwrite").text(path)


def write_feature_lines(features: DataFrame, path: str) -> None:
    """Write one feature per line, in parallel; ``read_feature_lines`` reads it back."""
    feature_json(features).write.mode("overwrite").text(path)


def write_feature_collection(features: DataFrame, path: str) -> None:
    """Write features as the numbered parts of one GeoJSON document, in parallel.

    The parts joined in the order of their numbers are one valid feature collection. The first holds its
    head, the last its end and the feature that no comma follows. ``features`` has the text of each
    on one line (``line``), or the columns of :func:`feature_json`. ``read_feature_lines`` reads the parts one by one,
    ``read_feature_collection`` with ``parts=True`` as one document. No features give an empty list.
    """
    texts = features.select("line") if "line" in features.columns else feature_json(features).toDF("line")
    # numbered once, in the stage, since no later pass has to cut the rows in the same way
    stage = materialize(texts.withColumn("number", F.monotonically_increasing_id()))
    last = stage.agg(F.max("number")).first()[0]
    spark = features.sparkSession
    head = spark.range(0, 1, 1, 1).select(F.lit('{"type":"FeatureCollection","features":[').alias("value"))
    parts, end = head, spark.range(0, 1, 1, 1).select(F.lit("]}").alias("value"))
    if last is not None:
        before = stage.filter(F.col("number") < last).select(F.concat("line", F.lit(",")))
        final = stage.filter(F.col("number") == last).select(F.concat("line", F.lit("\n]}"))).coalesce(1)
        parts, end = head.union(before), final
    parts.union(end).write.mode("overwrite").text(path)
