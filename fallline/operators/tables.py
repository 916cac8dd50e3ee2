"""Small operators on any table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_struct(df: DataFrame, separator: str = "__") -> DataFrame:
    """Nested structs to top-level columns, with the path as the name."""

    def leaves(struct: T.StructType, path: tuple[str, ...]) -> list[Column]:
        columns = []
        for field in struct.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                columns += leaves(field.dataType, here)
            else:
                dotted = ".".join(f"`{part}`" for part in here)
                columns.append(F.col(dotted).alias(separator.join(here)))
        return columns

    return df.select(*leaves(df.schema, ()))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)
    )


def pending_keys(
    wanted: DataFrame, existing: DataFrame, key: str, overwrite: bool = False
) -> DataFrame:
    """Rows whose key has no output yet; all rows when output is to be written anew."""
    return wanted if overwrite else wanted.join(existing.select(key), key, "left_anti")


def content_digests(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SHA-256 of each row's content: ``key`` and ``digest``, to be kept beside the output made of the row.

    The content is the JSON of ``columns`` (all by default) by name, with NULL fields, so neither the
    order of columns nor a moved value goes unseen.
    """
    content = F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"})
    return df.select(key, F.sha2(content, 256).alias("digest"))


def key_changes(current: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Keys that are new, changed or removed against the digests kept from an earlier time.

    Both tables have ``key``, distinct, and ``digest``. Only those two columns are shuffled. Keys with
    the same digest are left out; a NULL key equals a NULL key.
    """
    now = current.select(F.col(key).alias("_now"), F.col("digest").alias("_digest"), F.lit(True).alias("_is"))
    was = kept.select(F.col(key).alias("_then"), F.col("digest").alias("_old"), F.lit(True).alias("_was"))
    change = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), "removed")
        .when(~F.col("_digest").eqNullSafe(F.col("_old")), "changed")
    )
    return (
        now.join(was, F.col("_now").eqNullSafe(F.col("_then")), "full")
        .select(F.coalesce("_now", "_then").alias(key), change.alias("change"))
        .filter("change IS NOT NULL")
    )


def first_of_each(df: DataFrame, group: list[str], order: list[Column | str], count: int) -> DataFrame:
    """The first ``count`` rows of each group by ``order``.

    Spark cuts each task's rows to ``count`` per group before the shuffle, so a group that holds most of the
    table sends no more rows than ``count`` per task. The rows of NULL are a group of their own.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= count).drop("_place")


def resource_counts(areas: DataFrame, country: str = "United States") -> DataFrame:
    """Headline totals of the area table in one row."""
    operating_here = (F.col("osm_status") == "operating") & (F.col("country") == country)
    return areas.agg(
        F.count(F.lit(1)).alias("ski_areas"),
        F.count_if(F.col("lift_count") >= 1).alias("ski_areas_with_lift"),
        F.count_if(F.col("lift_count") >= 5).alias("ski_areas_with_5_lifts"),
        F.count_if(operating_here).alias("operating_in_country"),
        F.sum("run_count").alias("runs"),
        F.sum("segment_count").alias("segments"),
    )
