"""Checks of the area table against the rules its readers rely on."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallline.operators.tables import duplicate_keys
from fallline.schema import AREA_METRICS, AREA_STATUSES, HEMISPHERES, RUN_CONVENTIONS


class InvalidTable(ValueError):
    """A table breaks its rules."""


#: column -> (lowest, highest, whether the highest value itself is allowed)
RANGES = {
    "run_count": (0, None, True),
    "lift_count": (0, None, True),
    "coordinate_count": (0, None, True),
    "segment_count": (0, None, True),
    "combined_vertical": (0, None, True),
    "combined_distance": (0, None, True),
    "vertical_drop": (0, None, True),
    "latitude": (-90, 90, True),
    "longitude": (-180, 180, True),
    "bearing_mean": (0, 360, False),
    "bearing_alignment": (0, 1, True),
    "poleward_affinity": (-1, 1, True),
    "eastward_affinity": (-1, 1, True),
}

ALLOWED = {
    "osm_run_convention": RUN_CONVENTIONS,
    "osm_status": AREA_STATUSES,
    "hemisphere": HEMISPHERES,
}

REQUIRED = (
    "ski_area_id",
    "osm_is_generated",
    "osm_run_convention",
    "run_count",
    "lift_count",
    "coordinate_count",
    "segment_count",
)

BIN_RANGES = {
    "num_bins": (0, None, True),
    "bin_index": (1, None, True),
    "bin_center": (0, 360, False),
    "bin_count": (0, None, True),
    "bin_proportion": (0, 1, True),
}


def _outside(value: Column, low, high, closed: bool) -> Column:
    bad = value < low
    if high is not None:
        bad = bad | (value > high if closed else value >= high)
    return bad


def row_rules(columns: list[str]) -> dict[str, Column]:
    """Rule name to a predicate that is true for a row that breaks it."""
    rules = {f"{c} is required": F.col(c).isNull() for c in REQUIRED if c in columns}
    for c, (low, high, closed) in RANGES.items():
        if c in columns:
            rules[f"{c} is in range"] = _outside(F.col(c), low, high, closed)
    for c, values in ALLOWED.items():
        if c in columns:
            rules[f"{c} is an allowed value"] = ~F.col(c).isin(*values)
    if "bearings" in columns:
        checks = [
            _outside_bins(c, low, high, closed) for c, (low, high, closed) in BIN_RANGES.items()
        ]
        rules["bearings are in range"] = reduce(lambda a, b: a | b, checks)
    return rules


def _outside_bins(field: str, low, high, closed: bool) -> Column:
    return F.exists(
        "bearings",
        lambda b: b[field].isNull() | F.coalesce(_outside(b[field], low, high, closed), F.lit(False)),
    )


def schema_problems(schema: T.StructType, expected: T.StructType = AREA_METRICS) -> list[str]:
    """Missing columns and columns of another kind. Additional columns are allowed."""
    problems = []
    for field in expected.fields:
        if field.name not in schema.fieldNames():
            problems.append(f"{field.name} is missing")
        elif not _same_kind(schema[field.name].dataType, field.dataType):
            problems.append(
                f"{field.name} is {schema[field.name].dataType.simpleString()}, "
                f"not {field.dataType.simpleString()}"
            )
    return problems


def _same_kind(found: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(wanted, T.ArrayType):
        return isinstance(found, T.ArrayType) and _same_kind(
            found.elementType, wanted.elementType
        )
    if isinstance(wanted, T.StructType):
        return isinstance(found, T.StructType) and all(
            f.name in found.fieldNames() and _same_kind(found[f.name].dataType, f.dataType)
            for f in wanted.fields
        )
    if isinstance(wanted, T.IntegralType):
        return isinstance(found, T.IntegralType)
    return found == wanted


def validate_areas(areas: DataFrame) -> DataFrame:
    """Violations per rule: one pass for all row rules, one count of keys for uniqueness."""
    rules = row_rules(areas.columns)
    counted = areas.agg(*[F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())])
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
            for i, name in enumerate(rules)
        ]
    )
    report = counted.select(F.inline(entries))
    return report.unionByName(_uniqueness(areas))


def observed(areas: DataFrame) -> tuple[DataFrame, Observation]:
    """The table with a count of the rows that break each row rule, taken by whatever pass writes it.

    Read the counts with :func:`observed_problems` after one action on the returned table.
    """
    observation = Observation()
    counts = [F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(row_rules(areas.columns).values())]
    return areas.observe(observation, *counts), observation


def observed_problems(areas: DataFrame, observation: Observation) -> list[str]:
    """:func:`problems` of a table written under :func:`observed`: only the keys are read again."""
    if found := schema_problems(areas.schema):
        return found
    counts = observation.get
    found = [
        f"{rule}: {counts[f'r{i}']} rows" for i, rule in enumerate(row_rules(areas.columns)) if counts[f"r{i}"]
    ]
    return found + [f"{r.rule}: {r.violations} rows" for r in _uniqueness(areas).collect() if r.violations]


def broken_rows(areas: DataFrame, key: str = "ski_area_id") -> DataFrame:
    """The side table of rows that break a row rule: ``key``, ``rules`` with a bit per rule, and their names.

    Bit i stands for the i-th of :func:`row_rules`. Rows that keep all rules are left out, by a scan of the columns
    that rules name. Rows with the same key stay apart.
    """
    rules = row_rules(areas.columns)
    if len(rules) > 63:
        raise ValueError("a bit per rule leaves room for 63 rules")
    mask = F.lit(0).cast("bigint")
    for i, bad in enumerate(rules.values()):
        mask = mask.bitwiseOR(F.when(bad, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    names = F.array(*[F.when(F.getbit("rules", F.lit(i)) == 1, F.lit(n)) for i, n in enumerate(rules)])
    marked = areas.select(key, mask.alias("rules")).filter(F.col("rules") != 0)
    return marked.withColumn("broken", F.array_compact(names))


def _uniqueness(areas: DataFrame) -> DataFrame:
    return (
        duplicate_keys(areas, ["ski_area_id"])
        .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))
        .select(F.lit("ski_area_id is unique").alias("rule"), "violations")
    )


def duplicate_bins(distribution: DataFrame) -> DataFrame:
    """Bins that occur twice in an area's histogram."""
    return duplicate_keys(distribution, ["ski_area_id", "num_bins", "bin_index"])


def problems(areas: DataFrame) -> list[str]:
    """The broken rules of a table with their rows, or what is wrong with its schema."""
    found = schema_problems(areas.schema)
    if not found:
        broken = validate_areas(areas).filter(F.col("violations") > 0).collect()
        found = [f"{r['rule']}: {r['violations']} rows" for r in broken]
    return found


def require_valid(areas: DataFrame) -> DataFrame:
    """Raise :class:`InvalidTable` unless the table keeps all rules; returns the table."""
    if found := problems(areas):
        raise InvalidTable("; ".join(found))
    return areas
