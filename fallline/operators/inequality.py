"""How unevenly area measures are spread: ECDF, Lorenz curve and Gini coefficient."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallline.functions.text import metric_label
from fallline.operators.prefix import running_totals
from fallline.operators.rollups import filtered
from fallline.schema import INEQUALITY_METRICS


def metric_unpivot(
    areas: DataFrame, metrics: Sequence[str] = INEQUALITY_METRICS
) -> DataFrame:
    """One row per area and metric."""
    ids = ["ski_area_id", "ski_area_name"]
    return areas.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ids, list(metrics), "variable", "value"
    )


def metric_ecdf(
    areas: DataFrame,
    predicates: Sequence[Column] | None = None,
    metrics: Sequence[str] = INEQUALITY_METRICS,
) -> DataFrame:
    """Rank, running sum, share of the total and percentile of each value within its metric.

    Each metric is one group with a row for every area, so ranks and sums come from
    ``running_totals`` and not from a window over the metric. Missing values get no rank.
    """
    long = metric_unpivot(filtered(areas, predicates), metrics)
    ranked = running_totals(
        long,
        ["variable"],
        ["value", "ski_area_id"],
        {
            "value_rank": F.when(F.col("value").isNotNull(), F.lit(1).cast("bigint")),
            "value_cumsum": F.col("value"),
        },
        totals={"value_rank": "_count", "value_cumsum": "_total"},
    )
    known = F.col("value").isNotNull()
    return (
        ranked
        .withColumns(
            {
                "value_rank": F.when(known, F.col("value_rank")),
                "value_cumsum": F.when(known, F.col("value_cumsum")),
            }
        )
        .withColumns(
            {
                "value_cdf": F.try_divide("value_cumsum", "_total"),
                "value_rank_pctl": F.try_divide("value_rank", "_count"),
            }
        )
        .drop("_total", "_count")
    )


def gini(values: DataFrame, group: str = "variable", value: str = "value") -> DataFrame:
    """Gini coefficient of the values of each group.

    Equal values are counted first. A block of f equal values v after n smaller ones adds
    v * (f * n + f * (f + 1) / 2) to the sum of rank times value, so only distinct values are
    sorted, and a value shared by most rows is a single row.
    """
    counted = (
        values.filter(F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("_freq"))
    )
    upto = running_totals(counted, [group], [value], {"_upto": F.col("_freq")})
    freq = F.col("_freq").cast("double")
    before = F.col("_upto").cast("double") - freq
    sums = upto.groupBy(group).agg(
        F.sum(F.col(value) * (freq * before + freq * (freq + 1) / 2)).alias("_ranked"),
        F.sum(F.col(value) * freq).alias("_total"),
        F.sum(freq).alias("_n"),
    )
    n = F.col("_n")
    return sums.select(
        group,
        (F.try_divide(2 * F.col("_ranked"), n * F.col("_total")) - (n + 1) / n).alias("gini"),
    )


def metric_gini(
    areas: DataFrame,
    predicates: Sequence[Column] | None = None,
    metrics: Sequence[str] = INEQUALITY_METRICS,
) -> DataFrame:
    """Gini coefficient and label per metric, the most even metric first."""
    return (
        gini(metric_unpivot(filtered(areas, predicates), metrics))
        .withColumn("variable_label", metric_label(F.col("variable")))
        .orderBy("gini")
    )
