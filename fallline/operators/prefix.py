"""Running totals over a whole table without putting a group into one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallline.session import materialize_bucketed


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    measures: dict[str, Column],
    slices: int | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` per ``group`` in the given order.

    A plain window would send each group to one task. Here the rows are range-partitioned on group
    and order, which splits a group of any size, and written once as a stage in buckets by slice. That is
    the only exchange of the rows: the sums within a slice need none, and of the slices before only the
    first group of a slice needs to know, of the slices after only the last. So at most two rows per slice
    are sent to all tasks, however many groups there are.

    ``group`` + ``order`` should identify a row; NULL is a group like others. By default there are twice as
    many slices as shuffle partitions, since a bucket may hold several. ``totals`` names columns for the
    totals of the whole group, by measure.
    """
    spark = df.sparkSession
    totals = totals or {}
    slices = slices or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    inputs = {f"_in_{n}": c for n, c in measures.items()}
    cut = materialize_bucketed(
        df.withColumns(inputs)
        .repartitionByRange(slices, *group, *order)
        .withColumn("_slice", F.spark_partition_id()),
        "_slice",
        slices,
    )

    part = Window.partitionBy(*group, "_slice")
    within = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select(
        *df.columns,
        "_slice",
        *[F.sum(f"_in_{n}").over(within).alias(f"_sum_{n}") for n in measures],
        *[F.sum(f"_in_{n}").over(part).alias(f"_part_{n}") for n in totals],
    )

    offsets = _offsets(cut, group, list(measures), list(totals))
    same = F.col("_slice") == F.col("_at")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    return local.join(F.broadcast(offsets), same, "left").select(
        *df.columns,
        *[
            F.when(
                F.col(f"_sum_{n}").isNotNull() | F.col(f"_before_{n}").isNotNull(),
                F.coalesce(F.col(f"_sum_{n}"), F.lit(0))
                + F.coalesce(F.col(f"_before_{n}"), F.lit(0)),
            ).alias(n)
            for n in measures
        ],
        *[F.coalesce(f"_whole_{n}", f"_part_{n}").alias(name) for n, name in totals.items()],
    )


def _offsets(cut: DataFrame, group: list[str], measures: list[str], totals: list[str]) -> DataFrame:
    """Sums of the slices before, and of all slices, for the first and the last group of each slice."""
    keys = [F.col(g).alias(f"_group_{g}") for g in group]
    names = [f"_group_{g}" for g in group]
    sums = cut.groupBy(*keys, F.col("_slice").alias("_at")).agg(
        *[F.sum(f"_in_{n}").alias(f"_total_{n}") for n in measures]
    )
    if group:
        row = F.struct(*names, *[f"_total_{n}" for n in measures])
        edges = F.array_distinct(F.array(F.min(row), F.max(row)))
        sums = sums.groupBy("_at").agg(edges.alias("_edges")).select("_at", F.inline("_edges"))
    whole = Window.partitionBy(*names)
    earlier = whole.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *names,
        "_at",
        *[F.sum(f"_total_{n}").over(earlier).alias(f"_before_{n}") for n in measures],
        *[F.sum(f"_total_{n}").over(whole).alias(f"_whole_{n}") for n in totals],
    )
