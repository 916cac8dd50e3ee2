"""Labels and display values."""

from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode regional indicator letters, A to Z; two of them make a flag.
REGIONAL_INDICATORS = "".join(chr(0x1F1E6 + i) for i in range(26))


def flag_emoji(country_code: Column) -> Column:
    """Flag of a two-letter country code; a code of another length fails the job."""
    flag = F.translate(F.upper(country_code), ascii_uppercase, REGIONAL_INDICATORS)
    return F.when(country_code.isNull() | country_code.rlike("^[A-Za-z]{2}$"), flag).otherwise(
        F.raise_error(F.concat(F.lit("not a two-letter country code: "), country_code)).cast(
            "string"
        )
    )


def status_label(status: Column, hemisphere: Column) -> Column:
    """Such as ``Operating in North Hem.``"""
    return F.concat(F.initcap(status), F.lit(" in "), F.initcap(hemisphere), F.lit(" Hem."))


def metric_label(name: Column) -> Column:
    """``combined_vertical`` to ``Combined Vertical``; only the first underscore is replaced."""
    return F.initcap(F.regexp_replace(name, "^([^_]*)_", "$1 "))


def bin_key(num_bins: Column, label: Column) -> Column:
    """Such as ``4_N``."""
    return F.concat(num_bins.cast("string"), F.lit("_"), label)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column, halves away from zero."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def prefix_columns(df: DataFrame, prefix: str, keep: tuple[str, ...]) -> DataFrame:
    """Put a prefix before every column name except those in ``keep``."""
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]
