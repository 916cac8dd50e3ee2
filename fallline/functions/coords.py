"""Coordinate lists and source references, all inside the row.

Lists are given as SQL text, usually a column name.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fallline.schema import LINE_COORDINATES, MIN_ELEVATION_M


def parse_line(coordinates_json: str) -> Column:
    """Raw JSON text of a line to a list of ``[longitude, latitude, elevation]``."""
    return F.from_json(coordinates_json, LINE_COORDINATES)


def _structured(triples: str) -> str:
    return (
        f"transform({triples}, (p, i) -> named_struct('index', i, 'latitude', get(p, 1), "
        "'longitude', get(p, 0), 'elevation', get(p, 2)))"
    )


def _cleaned(triples: str, min_elevation: float, ensure_downhill: bool) -> str:
    rounded = (
        f"transform(filter({triples}, p -> coalesce(get(p, 2) >= {min_elevation}D, true)), "
        "p -> array(bround(get(p, 0), 7), bround(get(p, 1), 7), bround(get(p, 2), 2)))"
    )
    if not ensure_downhill:
        return rounded
    # the list of one list gives the cleaned line a name, so it is computed once
    return (
        f"get(transform(array({rounded}), line -> if(get(try_element_at(line, 1), 2) "
        "< get(try_element_at(line, -1), 2), reverse(line), line)), 0)"
    )


def structure_coords(triples: str) -> Column:
    """``[longitude, latitude, elevation]`` triples to indexed coordinate structs."""
    return F.expr(_structured(triples))


def clean_coords(
    triples: str,
    min_elevation: float = MIN_ELEVATION_M,
    ensure_downhill: bool = True,
) -> Column:
    """Coordinate structs of the cleaned line, numbered again from 0.

    Points with impossible elevations are dropped, float noise is rounded away, and a line that
    ends higher than it starts is turned round. A point without elevation stays, with a NULL one; a
    line that starts or ends with such a point is not turned.
    """
    return F.expr(_structured(_cleaned(triples, min_elevation, ensure_downhill)))


def path_triples(coordinates: str) -> Column:
    """Coordinate structs back to ``[longitude, latitude, elevation]`` triples."""
    return F.expr(f"transform({coordinates}, c -> array(c.longitude, c.latitude, c.elevation))")


def _url(source: str) -> str:
    return f"""CASE {source}.type
        WHEN 'openstreetmap' THEN concat('https://www.openstreetmap.org/', {source}.id)
        WHEN 'skimap.org' THEN concat('https://skimap.org/skiareas/view/', {source}.id)
        ELSE cast(raise_error(concat('unknown source type ', coalesce({source}.type, 'NULL'),
                                     ' for id ', coalesce({source}.id, 'NULL'))) AS string) END"""


def source_url(source: str) -> Column:
    """Web address of a source struct; an unknown type fails the job."""
    return F.expr(_url(source))


def sources_to_urls(sources: str) -> Column:
    """Web addresses of a list of sources, in the order of the list."""
    return F.expr(f"transform({sources}, s -> {_url('s')})")


def source_keys(sources: str) -> Column:
    """``type:id`` of every source, sorted."""
    return F.expr(f"sort_array(transform({sources}, s -> concat_ws(':', s.type, s.id)))")


def sorted_ids(areas: str) -> Column:
    """Sorted ids of nested area references."""
    return F.expr(f"sort_array({areas}.properties.id)")
