"""Weighted circular statistics and compass histograms in additive form.

Everything here is split into sums, which Spark can aggregate partially on the map side, and
expressions over the finished sums. The sums of groups add up to the sums of their union, so
statistics of areas can be combined without going back to segments.
"""

from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallline.schema import COMPASS_RESOLUTIONS, COMPASS_WINDS, MAGNITUDE_EPSILON


def direction_sums(
    bearing: str,
    net: str | None = None,
    cum: str | None = None,
    sign: str | None = None,
) -> list[Column]:
    """Additive parts of the bearing statistics, as aggregates over columns or SQL text.

    ``net`` scales each unit vector, ``cum`` is the magnitude it stands for; both default to 1.
    ``sign`` is the hemisphere; its minimum and maximum tell later whether all rows share one.
    A row in which any of the given columns is NULL does not count.
    """
    complete = " AND ".join(f"({c}) IS NOT NULL" for c in (bearing, net, cum, sign) if c)
    angle = f"radians({bearing})"
    return [
        F.expr(f"sum({net or '1D'} * cos({angle})) FILTER (WHERE {complete}) AS _x"),
        F.expr(f"sum({net or '1D'} * sin({angle})) FILTER (WHERE {complete}) AS _y"),
        F.expr(f"sum({cum or '1D'}) FILTER (WHERE {complete}) AS _cum"),
        F.expr(f"min({sign or 'cast(NULL AS int)'}) FILTER (WHERE {complete}) AS _sign_min"),
        F.expr(f"max({sign or 'cast(NULL AS int)'}) FILTER (WHERE {complete}) AS _sign_max"),
    ]


def merged_direction_sums() -> list[Column]:
    """Aggregates that combine the sums of :func:`direction_sums` over groups."""
    return [
        F.expr(f"{function}({name}) AS {name}")
        for function, name in zip(("sum", "sum", "sum", "min", "max"), DIRECTION_SUMS, strict=True)
    ]


DIRECTION_SUMS = ("_x", "_y", "_cum", "_sign_min", "_sign_max")


def with_direction_stats(df: DataFrame, digits: int = 7) -> DataFrame:
    """The six bearing statistics in place of the columns made by :func:`direction_sums`."""
    others = [c for c in df.columns if c not in DIRECTION_SUMS]
    return (
        df.withColumns(
            {
                "_x": F.expr("coalesce(_x, 0D)"),
                "_y": F.expr("coalesce(_y, 0D)"),
                "_cum": F.expr("coalesce(_cum, 0D)"),
                "_sign": F.expr("if(_sign_min = _sign_max, _sign_min, NULL)"),
            }
        )
        .withColumn("_net", F.expr("sqrt(_x * _x + _y * _y)"))
        .withColumns(
            {
                "_alignment": F.expr(f"if(_cum > {MAGNITUDE_EPSILON}D, _net / _cum, 0D)"),
                "_angle": F.expr(f"if(_net > {MAGNITUDE_EPSILON}D, atan2(_y, _x), 0D)"),
            }
        )
        # adding 0 turns a negative zero into zero
        .selectExpr(
            *[f"`{c}`" for c in others],
            f"bround(pmod(degrees(bround(_angle, 10)), 360D), {digits}) AS bearing_mean",
            f"bround(_alignment, {digits}) AS bearing_alignment",
            f"bround(_net, {digits}) AS bearing_magnitude_net",
            f"bround(_cum, {digits}) AS bearing_magnitude_cum",
            f"bround(_sign * _alignment * cos(_angle) + 0D, {digits}) AS poleward_affinity",
            f"bround(_alignment * sin(_angle) + 0D, {digits}) AS eastward_affinity",
        )
    )


_WINDS = "array(" + ", ".join(f"'{wind}'" for wind in COMPASS_WINDS) + ")"


def compass_label(center: Column) -> Column:
    """Wind name of a bin centre; NULL when it is none of the 32 winds."""
    step = 360.0 / len(COMPASS_WINDS)
    position = F.floor(center / step)
    is_wind = (center == position * step) & (center >= 0) & (center < 360)
    return F.when(is_wind, F.try_element_at(F.expr(_WINDS), (position + 1).cast("int")))


def fine_cells(resolutions: tuple[int, ...] = COMPASS_RESOLUTIONS) -> int:
    """Number of equal cells from which all resolutions can be put together.

    Bins are centred on their wind, so a resolution of n cuts the circle at every 1/(2n).
    """
    return 2 * lcm(*resolutions)


def fine_cell(bearing: str, cells: int = fine_cells()) -> Column:
    """0-based fine cell of a bearing; 360 belongs to the last one, and others to none."""
    return F.expr(
        f"if({bearing} >= 0 AND {bearing} <= 360, "
        f"cast(least(floor({bearing} * {cells} / 360D), {cells - 1}) AS int), NULL)"
    )


def with_histograms(
    df: DataFrame,
    entries: str,
    resolutions: tuple[int, ...] = COMPASS_RESOLUTIONS,
    output: str = "bearings",
) -> DataFrame:
    """Turn a list of ``struct(cell, weight)`` into north-centred histograms, all in one list.

    A bin of resolution n is a run of ``cells / n`` fine cells that starts half a bin before its
    wind. The weights are laid out twice in a row, so the bin around north needs no special case.
    """
    cells = fine_cells(resolutions)
    winds = len(COMPASS_WINDS)
    total = "aggregate(slice(_twice, 1, {0}), 0D, (a, w) -> a + w)".format(cells)
    count = (
        f"aggregate(slice(_twice, cast({cells} + (2 * i - 1) * {cells} / (2 * n) + 1 AS int), "
        f"cast({cells} / n AS int)), 0D, (a, w) -> a + w)"
    )
    bins = f"""flatten(transform(array({", ".join(map(str, resolutions))}), n ->
        transform(sequence(0, n - 1), i -> named_struct(
            'num_bins', n, 'bin_index', i + 1, 'bin_center', i * 360D / n,
            'bin_count', {count}))))"""
    labelled = f"""transform(_bins, b -> named_struct(
        'num_bins', b.num_bins, 'bin_index', b.bin_index, 'bin_center', b.bin_center,
        'bin_count', b.bin_count,
        'bin_proportion', if(_total > 0, b.bin_count / _total, 0D),
        'bin_label', if((b.bin_index - 1) * {winds} % b.num_bins = 0, element_at({_WINDS},
            cast((b.bin_index - 1) * {winds} / b.num_bins + 1 AS int)), NULL)))"""
    others = [f"`{c}`" for c in df.columns if c not in (entries, output)]
    return (
        df.withColumn("_lookup", F.map_from_entries(entries))
        .withColumn(
            "_once",
            F.expr(
                f"transform(sequence(0, {cells - 1}), "
                "cell -> coalesce(try_element_at(_lookup, cell), 0D))"
            ),
        )
        .withColumn("_twice", F.expr("concat(_once, _once)"))
        .withColumns({"_bins": F.expr(bins), "_total": F.expr(total)})
        .selectExpr(*others, f"{labelled} AS `{output}`")
    )
