"""Points, segments and directions on the globe.

Functions ending in ``_sql`` take and return SQL text. They serve the operators with many measures,
where one parsed expression is much quicker to build than a tree of Python calls.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fallline.schema import EARTH_RADIUS_M


def hemisphere_sign_sql(latitude: str = "latitude") -> str:
    """1 north, -1 south, NULL on the equator.

    Aggregates work on this number rather than on the name: a numeric buffer keeps Spark on hash
    aggregation, while min and max of a string would make it sort the input.
    """
    return f"(CASE WHEN {latitude} > 0 THEN 1 WHEN {latitude} < 0 THEN -1 END)"


def hemisphere(latitude: str = "latitude") -> Column:
    """``north``, ``south``, or NULL when the latitude is 0 or missing."""
    return F.expr(f"CASE WHEN {latitude} > 0 THEN 'north' WHEN {latitude} < 0 THEN 'south' END")


def flip_bearing(latitude: Column, bearing: Column) -> Column:
    """Mirror a bearing on the east-west axis outside the north, so that 0 means poleward.

    The equator and missing latitudes are mirrored too.
    """
    return F.when(latitude > 0, bearing).otherwise(F.pmod(F.lit(180.0) - bearing, F.lit(360.0)))


def great_circle_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Haversine distance in metres."""
    h = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    # least() skips NULLs, so the outer test keeps an unknown distance unknown
    known = " AND ".join(f"{c} IS NOT NULL" for c in (lat1, lon1, lat2, lon2))
    return f"if({known}, {2 * EARTH_RADIUS_M}D * asin(sqrt(least({h}, 1D))), NULL)"


def initial_bearing_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Compass direction in degrees in which the great circle leaves the first point."""
    east = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    north = (
        f"cos(radians({lat1})) * sin(radians({lat2})) "
        f"- sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))"
    )
    return f"pmod(degrees(atan2({east}, {north})), 360D)"


def planar_bearing(dx: Column, dy: Column) -> Column:
    """Compass direction of a step on the flat map."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def spoke(bearing: Column, spokes: int = 32) -> Column:
    """1-based spoke number of a bearing; the first spoke is centred on north."""
    width = 360.0 / spokes
    return (F.pmod(F.floor((bearing + width / 2) / width), F.lit(spokes)) + 1).cast("int")


def above_line(
    longitude: Column,
    latitude: Column,
    start: tuple[float, float],
    end: tuple[float, float],
) -> Column:
    """Whether a point lies north of the line through two (longitude, latitude) points."""
    gradient = (end[1] - start[1]) / (end[0] - start[0])
    offset = start[1] - gradient * start[0]
    return F.lit(gradient) * longitude + F.lit(offset) < latitude


def segment_sql(prev: str, cur: str) -> dict[str, str]:
    """Measures that need only the two end points.

    ``prev`` and ``cur`` are prefixes that make column names of latitude, longitude and elevation.
    """
    ends = (f"{prev}latitude", f"{prev}longitude", f"{cur}latitude", f"{cur}longitude")
    rise = f"({prev}elevation - {cur}elevation)"
    return {
        "distance_vertical": rise,
        "segment_hash": f"if({ends[0]} IS NOT NULL, xxhash64({', '.join(ends)}), NULL)",
        "distance_vertical_drop": drop_sql(rise),
        "distance_horizontal": great_circle_sql(*ends),
        "bearing": initial_bearing_sql(*ends),
    }


def drop_sql(distance_vertical: str) -> str:
    """The downhill part of a height difference; unknown stays unknown."""
    return f"if({distance_vertical} IS NOT NULL, greatest({distance_vertical}, 0D), NULL)"


def steepness_sql(of: str = "") -> dict[str, str]:
    """Length, gradient and slope in degrees of a step; a step that goes nowhere has no gradient."""
    horizontal, vertical = f"{of}distance_horizontal", f"{of}distance_vertical"
    gradient = f"if({horizontal} > 0, {vertical} / {horizontal}, NULL)"
    return {
        "distance_3d": f"sqrt({horizontal} * {horizontal} + {vertical} * {vertical})",
        "gradient": gradient,
        "slope": f"degrees(atan({gradient}))",
    }
