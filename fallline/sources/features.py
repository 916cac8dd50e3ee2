"""GeoJSON features: reading, and turning them into run, lift and area tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallline.functions.coords import (
    clean_coords,
    parse_line,
    sorted_ids,
    source_keys,
    sources_to_urls,
    structure_coords,
)
from fallline.operators.tables import flatten_struct, value_counts
from fallline.schema import FEATURES
from fallline.sources.documents import cut_features

_CORRUPT = "_corrupt_record"


def read_feature_lines(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Features from files with one feature per line: the form for large data.

    Files are split between tasks at line ends. Both newline-delimited features and feature
    collections written one feature per line are read; of the latter, the opening and closing lines
    are skipped and commas at line ends ignored. Any other line that is not a feature fails the job,
    also where only rows are counted.
    """
    return read_feature_texts(spark, path, kind).drop("line")


#: The first line of a collection, its last lines, and lines of white space alone.
_FRAME = (
    r'^\{\s*"type"\s*:\s*"FeatureCollection".*"features"\s*:\s*\[$|^\]\s*\}?$|^\}$|^$'
)


def read_feature_texts(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """The same with the text of each feature as it stands in the file, as ``line``."""
    lines = spark.read.text(path).select(
        F.regexp_replace(F.trim("value"), r"\s*,?\s*$", "").alias("line")
    )
    return _parsed(lines, kind, F.col("line").rlike(_FRAME))


def _parsed(lines: DataFrame, kind: str, skipped: Column) -> DataFrame:
    """``line`` and its fields. The field list is built once per line, by a generator, whatever reads it."""
    schema = T.StructType([*FEATURES[kind].fields, T.StructField(_CORRUPT, T.StringType())])
    read = lines.select(
        "line", F.from_json("line", schema, {"columnNameOfCorruptRecord": _CORRUPT}).alias("f")
    )
    good = F.col(f"f.{_CORRUPT}").isNull() & (F.col("f.type") == "Feature")
    message = F.concat(F.lit("not a feature: "), F.substring("line", 1, 80))
    one, none = F.array("f"), F.expr("slice(array(f), 1, 0)")
    # a frame line gives no row and never the error
    features = F.when(skipped, none).when(good, one).otherwise(F.raise_error(message))
    return read.select("line", F.inline(features)).drop(_CORRUPT)


def read_feature_collection(
    spark: SparkSession, path: str | list[str], kind: str, parts: bool = False
) -> DataFrame:
    """Features of whole-document feature collections, of any size.

    A document is cut into features by as many tasks as it has splits, see :func:`cut_features`. A
    document of another type, and one that is cut off, fails the job. With ``parts`` a folder of numbered
    parts, as ``write_feature_collection`` makes it, is one document.
    """
    return _parsed(cut_features(spark, path, parts), kind, F.lit(False)).drop("line")


def feature_variants(texts: DataFrame) -> DataFrame:
    """Feature texts (``line``) parsed once to VARIANT values (``feature``), to be stored as Parquet.

    Properties that no schema names stay, with the types of all values, and later reads take fields from
    the binary form without parsing text again. Numbers keep their value, not their spelling: 900.0 is 900.
    """
    return texts.select(F.parse_json("line").alias("feature"))


def typed_features(variants: DataFrame, kind: str) -> DataFrame:
    """The declared fields of stored features, as the readers of text give them; other columns stay."""
    fields = FEATURES[kind]
    properties = fields["properties"].dataType.simpleString()
    taken = {
        "type": F.variant_get("feature", "$.type", "string"),
        "properties": F.variant_get("feature", "$.properties", properties),
        "geometry": F.struct(
            F.variant_get("feature", "$.geometry.type", "string").alias("type"),
            F.to_json(F.variant_get("feature", "$.geometry.coordinates", "variant")).alias("coordinates"),
        ),
    }
    return variants.select(*[taken[n].alias(n) for n in fields.fieldNames()], *[c for c in variants.columns if c not in taken])


def geometry_profile(features: DataFrame) -> DataFrame:
    """Number of features of each geometry type."""
    return value_counts(features.select(F.col("geometry.type").alias("geometry_type")), "geometry_type")


def load_runs(features: DataFrame) -> DataFrame:
    """Runs that are lines, with sorted ids and sources and with raw and clean coordinates.

    The coordinates may be raw JSON text, as the readers give them, or lists of numbers.
    """
    p = "properties"
    line = F.col("geometry.coordinates")
    if isinstance(features.schema["geometry"].dataType["coordinates"].dataType, T.StringType):
        line = parse_line("geometry.coordinates")
    lines = features.filter(F.col("geometry.type") == "LineString").withColumn("_line", line)
    return lines.select(
        F.col(f"{p}.id").alias("run_id"),
        F.col(f"{p}.name").alias("run_name"),
        F.col(f"{p}.uses").alias("run_uses"),
        F.col(f"{p}.status").alias("run_status"),
        F.col(f"{p}.difficulty").alias("run_difficulty"),
        F.col(f"{p}.convention").alias("run_convention"),
        sorted_ids(f"{p}.skiAreas").alias("ski_area_ids"),
        F.sort_array(sources_to_urls(f"{p}.sources")).alias("run_sources"),
        structure_coords("_line").alias("run_coordinates_raw"),
        clean_coords("_line").alias("run_coordinates_clean"),
    )


def load_lifts(features: DataFrame) -> DataFrame:
    p = "properties"
    return features.select(
        F.col(f"{p}.id").alias("lift_id"),
        F.col(f"{p}.name").alias("lift_name"),
        F.col(f"{p}.liftType").alias("lift_type"),
        F.col(f"{p}.status").alias("lift_status"),
        sorted_ids(f"{p}.skiAreas").alias("ski_area_ids"),
        source_keys(f"{p}.sources").alias("lift_sources"),
        F.col("geometry.type").alias("lift_geometry_type"),
    )


def load_ski_areas(features: DataFrame) -> DataFrame:
    """Area properties flattened to columns such as ``location__localized__en__country``."""
    return flatten_struct(features.select("properties.*")).withColumnsRenamed(
        {"id": "ski_area_id", "name": "ski_area_name"}
    )
