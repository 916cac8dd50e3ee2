"""Segments of paths: distance, drop, direction and steepness between consecutive points.

Three forms give the same numbers. ``explode_segments`` and ``enrich_runs`` work on one row per run
with a coordinate list and need no shuffle at all. ``segments_from_points`` works on a flat table
of points and shuffles once, by path and chunk.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallline.functions.geo import planar_bearing, segment_sql, spoke, steepness_sql
from fallline.operators.prefix import running_totals
from fallline.schema import COORDINATE_FIELDS, SEGMENT_FIELDS

#: Index range of one chunk of a path in the flat form.
CHUNK_POINTS = 100_000


def _struct_type(fields: tuple[str, ...]) -> str:
    types = {"index": "int", "segment_hash": "bigint"}
    return "struct<" + ",".join(f"{f}:{types.get(f, 'double')}" for f in fields) + ">"


def shifted_sql(coordinates: str, fields: tuple[str, ...], by: int) -> str:
    """The list moved by one place (-1 previous, 1 next), filled with NULL, length unchanged."""
    blank = f"array(cast(NULL AS {_struct_type(fields)}))"
    kept = f"greatest(size({coordinates}) - 1, 0)"
    if by < 0:
        moved = f"concat({blank}, slice({coordinates}, 1, {kept}))"
    else:
        moved = f"concat(slice({coordinates}, 2, {kept}), {blank})"
    return f"slice({moved}, 1, size({coordinates}))"


def _zipped(**lists: str) -> Column:
    return F.arrays_zip(*[F.expr(sql).alias(name) for name, sql in lists.items()])


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS `{name}`" for name, sql in columns.items()]


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _with_steepness(measured: DataFrame, others: list[str]) -> DataFrame:
    columns = {f: f"`{f}`" for f in SEGMENT_FIELDS} | steepness_sql()
    return measured.selectExpr(*_quoted(others), *_named({f: columns[f] for f in SEGMENT_FIELDS}))


def explode_coordinates(runs: DataFrame, coordinates: str = "run_coordinates_clean") -> DataFrame:
    """One row per coordinate with its fields; a run without any gives one row of NULLs."""
    others = [c for c in runs.columns if c != coordinates]
    return runs.select(*others, F.explode_outer(coordinates).alias("_c")).select(*others, "_c.*")


def explode_segments(
    runs: DataFrame, coordinates: str = "run_coordinates_clean"
) -> DataFrame:
    """One row per coordinate with the metrics of the step that leads to it.

    Every point is paired with the one before it inside the row, so the trigonometry runs in
    generated code on exploded rows and no window is needed.
    """
    others = [c for c in runs.columns if c != coordinates]
    previous = shifted_sql(coordinates, COORDINATE_FIELDS, -1)
    pairs = _zipped(cur=coordinates, prev=previous)
    measured = runs.select(*others, F.explode_outer(pairs).alias("_p")).selectExpr(
        *_quoted(others),
        *_named({f: f"_p.cur.{f}" for f in COORDINATE_FIELDS}),
        *_named(segment_sql("_p.prev.", "_p.cur.")),
    )
    return _with_steepness(measured, [*others, *COORDINATE_FIELDS])


def enrich_runs(runs: DataFrame, coordinates: str = "run_coordinates_clean") -> DataFrame:
    """The same metrics written back into the coordinate list of each run.

    A run without points gets a list with one empty coordinate, like an outer explode.
    """

    def struct(columns: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{n}', {sql}" for n, sql in columns.items()) + ")"

    basics = {f: f"p.cur.{f}" for f in COORDINATE_FIELDS} | segment_sql("p.prev.", "p.cur.")
    columns = {f: f"s.{f}" for f in COORDINATE_FIELDS + SEGMENT_FIELDS} | steepness_sql("s.")
    blank = f"array(cast(NULL AS {_struct_type(COORDINATE_FIELDS)}))"
    pairs = _zipped(cur="_points", prev=shifted_sql("_points", COORDINATE_FIELDS, -1))
    return (
        runs.withColumn(
            "_points", F.expr(f"if(size({coordinates}) > 0, {coordinates}, {blank})")
        )
        .withColumn("_pairs", pairs)
        .withColumn(
            coordinates,
            F.expr(f"transform(transform(_pairs, p -> {struct(basics)}), s -> {struct(columns)})"),
        )
        .drop("_points", "_pairs")
    )


def segments_from_points(
    points: DataFrame,
    path: str | list[str],
    order: str = "index",
    chunk_points: int = CHUNK_POINTS,
) -> DataFrame:
    """Segment metrics for a flat table of points.

    Each path is cut into chunks of ``chunk_points`` consecutive values of the integer ``order``
    column, and the window runs per chunk, so that one path can hold any share of the table without
    becoming one task. The first point of a chunk takes its predecessor from a small table with the
    last point of every chunk; paths that fit in one chunk do not appear in it. Window and join use
    the same partitioning, so the points are shuffled once. Path columns must not be NULL.
    """
    path = [path] if isinstance(path, str) else list(path)
    fields = ["latitude", "longitude", "elevation"]
    chunked = points.withColumn("_chunk", F.floor(F.col(order) / chunk_points))

    in_chunk = Window.partitionBy(*path, "_chunk").orderBy(order)
    lagged = chunked.select(
        "*",
        F.row_number().over(in_chunk).alias("_row"),
        *[F.lag(f).over(in_chunk).alias(f"_lag_{f}") for f in fields],
    )

    ends = chunked.groupBy(*path, "_chunk").agg(
        *[F.max_by(f, order).alias(f) for f in fields]
    )
    across = Window.partitionBy(*path).orderBy("_chunk")
    carried = (
        ends.select(
            *path,
            "_chunk",
            F.row_number().over(across).alias("_rank"),
            *[F.lag(f).over(across).alias(f"_carry_{f}") for f in fields],
        )
        .filter(F.col("_rank") > 1)
        .drop("_rank")
    )
    before = {f"_prev_{f}": f"if(_row = 1, _carry_{f}, _lag_{f})" for f in fields}
    measured = (
        lagged.join(carried, [*path, "_chunk"], "left")
        .selectExpr(*_quoted(points.columns), *_named(before))
        .selectExpr(*_quoted(points.columns), *_named(segment_sql("_prev_", "")))
    )
    return _with_steepness(measured, points.columns)


def regroup_coordinates(
    points: DataFrame,
    key: str = "run_id",
    fields: tuple[str, ...] = COORDINATE_FIELDS,
) -> DataFrame:
    """Flat points back to one ordered coordinate list per run.

    A run was one row before, so its list is no larger than a row that was already read. Paths that
    never were a row belong to :func:`segments_from_points`, which makes no lists.
    """
    return points.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("run_coordinates_clean")
    )


def lead_segments(
    runs: DataFrame,
    spokes: int = 32,
    coordinates: str = "run_coordinates_clean",
) -> DataFrame:
    """Steps on the flat map from each point to the next, with a number over all points.

    Expects enriched coordinates. ``index`` is numbered from 1 over all points ordered by their
    place in the run and the run, before the last points, which have no next one, are dropped. A
    run without points has no place in the numbering.
    """
    following = shifted_sql(coordinates, COORDINATE_FIELDS + SEGMENT_FIELDS, 1)
    pairs = _zipped(cur=coordinates, next=following)
    points = runs.select(F.col("run_id").alias("path"), F.explode_outer(pairs).alias("_p")).selectExpr(
        "path",
        "_p.cur.index AS index0",
        "_p.cur.longitude AS x",
        "_p.cur.latitude AS y",
        "_p.next.longitude AS xend",
        "_p.next.latitude AS yend",
        "_p.next.distance_vertical AS _next_vertical",
    )
    points = points.filter("index0 IS NOT NULL")
    numbered = running_totals(points, [], ["index0", "path"], {"index": F.lit(1).cast("bigint")})
    return (
        numbered.filter(F.col("xend").isNotNull())
        .withColumns({"dx": F.expr("xend - x"), "dy": F.expr("yend - y")})
        .withColumn("tg", planar_bearing(F.col("dx"), F.col("dy")))
        .select(
            "path",
            "index",
            "index0",
            "x",
            "y",
            "xend",
            "yend",
            "dx",
            "dy",
            F.expr("_next_vertical * dx / 4 AS scaled_dx"),
            F.expr("_next_vertical * dy / 4 AS scaled_dy"),
            "tg",
            spoke(F.col("tg"), spokes).alias("group"),
        )
    )
