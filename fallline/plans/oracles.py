"""SQL for every query that SQL can express, written independently of the operators.

The text runs on the test tables in another engine. Steps shared by many queries are common table
expressions, and each query names the ones it needs.
"""

from fallline.plans.registry import AREAS, COUNTRY, LINE, OFF_TIES
from fallline.schema import BEARING_STATS, COMPASS_WINDS, INEQUALITY_METRICS

# ---------------------------------------------------------------------------
# Common steps
# ---------------------------------------------------------------------------

_PART = """CASE WHEN event_id % 24 >= 8 THEN 3 WHEN event_id % 24 >= 3 THEN 2
             WHEN event_id % 24 >= 1 THEN 1 ELSE 0 END"""

STEPS = {
    "ev": (
        (),
        f"""SELECT (event_id // 24) * 4 + {_PART} AS run_no,
                   CAST(event_id % 24 - CASE WHEN event_id % 24 >= 8 THEN 8
                        WHEN event_id % 24 >= 3 THEN 3 WHEN event_id % 24 >= 1 THEN 1
                        ELSE 0 END AS INTEGER) AS idx,
                   event_id, user_id, value
            FROM events""",
    ),
    "home": (
        ("ev",),
        """SELECT run_no, arg_min(user_id, idx) AS home, count(*) AS points,
                  'r' || run_no AS run_id,
                  CASE WHEN run_no % 29 = 7 THEN 'Polygon' ELSE 'LineString' END AS geometry_type
           FROM ev GROUP BY run_no""",
    ),
    "bridge": (
        ("home",),
        """SELECT run_no, run_id, 'a' || home AS ski_area_id FROM home WHERE home % 10 <> 9
           UNION ALL
           SELECT run_no, run_id, 'a' || (home + 10) FROM home
           WHERE home % 10 <> 9 AND run_no % 7 = 0""",
    ),
    "line": (("home",), "SELECT * FROM home WHERE run_no % 29 <> 7"),
    "raw": (
        ("ev", "line"),
        """SELECT run_no, run_id, idx,
                  (home*53) % 340 - 170 + ((event_id*6151) % 20011) / 1e6
                      + (event_id % 7) * 1e-9 AS longitude,
                  (home*37) % 121 - 60 + ((event_id*7919) % 20011) / 1e6
                      + (event_id % 7) * 1e-9 AS latitude,
                  CASE WHEN event_id % 97 = 11 OR run_no % 61 = 5 THEN -9999e0
                       ELSE (CASE WHEN run_no % 9 = 4 THEN 900 + idx*60 ELSE 1800 - idx*60 END)
                            + value*2 + (event_id % 4) * 1e-3 END AS elevation
           FROM ev JOIN line USING (run_no)""",
    ),
    "kept": (
        ("raw",),
        """SELECT run_no, run_id, round(longitude, 7) AS longitude,
                  round(latitude, 7) AS latitude, round(elevation, 2) AS elevation,
                  row_number() OVER (PARTITION BY run_no ORDER BY idx) - 1 AS k,
                  count(*) OVER (PARTITION BY run_no) AS n,
                  round(first_value(elevation) OVER (PARTITION BY run_no ORDER BY idx), 2) AS top,
                  round(first_value(elevation) OVER (PARTITION BY run_no ORDER BY idx DESC), 2)
                      AS foot
           FROM raw WHERE elevation >= -100""",
    ),
    "clean": (
        ("kept",),
        """SELECT run_no, run_id,
                  CAST(CASE WHEN top < foot THEN n - 1 - k ELSE k END AS INTEGER) AS "index",
                  latitude, longitude, elevation
           FROM kept""",
    ),
    "pt": (
        ("line", "clean"),
        """SELECT line.run_no, line.run_id, c."index", c.latitude, c.longitude, c.elevation
           FROM line LEFT JOIN clean c USING (run_no)""",
    ),
    "lagged": (
        ("pt",),
        """SELECT *, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo,
                  lag(elevation) OVER w AS el
           FROM pt WINDOW w AS (PARTITION BY run_no ORDER BY "index")""",
    ),
    "meas": (
        ("lagged",),
        """SELECT *, el - elevation AS distance_vertical,
                  CASE WHEN el - elevation > 0 THEN el - elevation
                       WHEN el - elevation <= 0 THEN 0e0 END AS distance_vertical_drop,
                  2 * 6371009 * asin(sqrt(least(1e0,
                      pow(sin(radians(latitude - la)/2), 2) + cos(radians(la))
                      * cos(radians(latitude)) * pow(sin(radians(longitude - lo)/2), 2))))
                      AS distance_horizontal_,
                  (degrees(atan2(sin(radians(longitude - lo)) * cos(radians(latitude)),
                      cos(radians(la)) * sin(radians(latitude)) - sin(radians(la))
                      * cos(radians(latitude)) * cos(radians(longitude - lo)))) + 360) % 360
                      AS bearing
           FROM lagged""",
    ),
    "seg": (
        ("meas",),
        """SELECT * EXCLUDE (distance_horizontal_),
                  CASE WHEN la IS NOT NULL THEN distance_horizontal_ END AS distance_horizontal,
                  CASE WHEN la IS NOT NULL THEN
                       sqrt(distance_horizontal_*distance_horizontal_
                            + distance_vertical*distance_vertical) END AS distance_3d,
                  CASE WHEN la IS NOT NULL AND distance_horizontal_ > 0
                       THEN distance_vertical / distance_horizontal_ END AS gradient,
                  CASE WHEN latitude > 0 THEN 1 WHEN latitude < 0 THEN -1 END AS sign,
                  run_no % 5 <> 0 AS downhill
           FROM meas""",
    ),
    "aseg": (
        ("bridge", "seg"),
        """SELECT b.ski_area_id, seg.* FROM seg JOIN bridge b USING (run_no) WHERE downhill""",
    ),
    "lift": (
        (),
        """SELECT 'l' || c_custkey AS lift_id, c_custkey AS k, c_name, c_mktsegment,
                  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'abandoned' ELSE 'operating' END
                      AS lift_status,
                  CASE WHEN c_custkey % 4 = 0 THEN c_custkey // 60 ELSE c_custkey // 15 END AS near,
                  CASE WHEN c_custkey % 8 = 3 THEN 'Polygon' ELSE 'LineString' END AS shape
           FROM customer""",
    ),
    "lift_link": (
        ("lift",),
        """SELECT lift_id, lift_status, 'a' || near AS ski_area_id FROM lift WHERE k % 11 <> 0
           UNION ALL
           SELECT lift_id, lift_status, 'a' || (near + 1) FROM lift
           WHERE k % 11 <> 0 AND k % 6 = 1""",
    ),
    "lifted": (
        ("lift_link",),
        """SELECT ski_area_id, count(DISTINCT lift_id) AS lift_count FROM lift_link
           WHERE lift_status = 'operating' GROUP BY ski_area_id""",
    ),
    "place": (
        (),
        """SELECT s_suppkey AS k, 'a' || s_suppkey AS ski_area_id,
                  CASE WHEN s_suppkey % 13 <> 0 THEN s_name END AS ski_area_name,
                  CASE WHEN s_suppkey % 37 = 36 THEN 'spot' ELSE 'skiArea' END AS kind,
                  CASE WHEN s_suppkey % 5 < 3 THEN 'operating'
                       WHEN s_suppkey % 5 = 3 THEN 'abandoned' END AS osm_status,
                  s_suppkey % 6 = 0 AS osm_is_generated,
                  CASE s_suppkey % 3 WHEN 0 THEN 'japan' WHEN 1 THEN 'europe'
                       ELSE 'north_america' END AS osm_run_convention,
                  CASE WHEN s_suppkey % 19 <> 18 THEN n_name END AS country,
                  CASE WHEN s_suppkey % 19 <> 18 THEN r_name END AS region,
                  CASE WHEN s_suppkey % 3 = 0 THEN 'Town ' || (s_suppkey % 50) END AS locality,
                  CASE WHEN s_suppkey % 19 <> 18 THEN
                       chr(65 + n_nationkey % 26) || chr(65 + (n_nationkey*7) % 26) END
                      AS country_code,
                  CASE WHEN s_suppkey % 19 <> 18 THEN
                       chr(65 + n_nationkey % 26) || chr(65 + (n_nationkey*7) % 26)
                       || '-' || r_regionkey END AS country_subdiv_code,
                  'https://www.openstreetmap.org/relation/' || s_suppkey
                      || ',https://skimap.org/skiareas/view/' || s_suppkey AS urls
           FROM supplier JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey""",
    ),
    "dim": (
        ("place", "lifted"),
        """SELECT place.*, lift_count FROM place LEFT JOIN lifted USING (ski_area_id)
           WHERE kind = 'skiArea' AND k % 17 <> 16""",
    ),
    "full": (
        ("aseg",),
        """SELECT *, bearing IS NOT NULL AND distance_vertical_drop IS NOT NULL
                  AND sign IS NOT NULL AS complete
           FROM aseg""",
    ),
    "scal": (
        ("full",),
        """SELECT ski_area_id, count(DISTINCT run_id) AS run_count, count(*) AS coordinate_count,
                  count(la) AS segment_count,
                  coalesce(sum(distance_vertical_drop), 0) AS combined_vertical,
                  coalesce(sum(distance_3d), 0) AS combined_distance,
                  avg(latitude) AS latitude, avg(longitude) AS longitude,
                  min(elevation) AS min_elevation, max(elevation) AS max_elevation,
                  sum(CASE WHEN complete THEN distance_vertical_drop * cos(radians(bearing)) END)
                      AS x,
                  sum(CASE WHEN complete THEN distance_vertical_drop * sin(radians(bearing)) END)
                      AS y,
                  sum(CASE WHEN complete THEN distance_vertical_drop END) AS c,
                  CASE WHEN min(CASE WHEN complete THEN sign END)
                            = max(CASE WHEN complete THEN sign END)
                       THEN min(CASE WHEN complete THEN sign END) END AS s
           FROM full_ GROUP BY ski_area_id""",
    ),
    "head": (
        ("aseg",),
        """SELECT ski_area_id, CASE sign WHEN 1 THEN 'north' WHEN -1 THEN 'south' END
                      AS hemisphere
           FROM (SELECT *, row_number() OVER (PARTITION BY ski_area_id
                        ORDER BY md5(run_id), "index") AS rn FROM aseg)
           WHERE rn = 1""",
    ),
    "bins": (
        (),
        """SELECT n AS num_bins, i AS bin_index, (i - 1) * 360e0 / n AS bin_center
           FROM (SELECT unnest([2, 4, 8, 16, 32]) AS n)
                JOIN (SELECT unnest(range(1, 33)) AS i) ON i <= n""",
    ),
    "binned": (
        ("aseg", "bins"),
        """SELECT ski_area_id, n AS num_bins,
                  CAST(least(floor(bearing / (180e0/n)), 2*n - 1) + 1 AS BIGINT) % (2*n) // 2 + 1
                      AS bin_index,
                  sum(distance_vertical_drop) AS w
           FROM aseg, (SELECT DISTINCT num_bins AS n FROM bins)
           WHERE bearing IS NOT NULL GROUP BY ALL""",
    ),
    "hist": (
        ("scal", "bins", "binned", "dim"),
        """SELECT ski_area_id, num_bins, bin_index, bin_center, coalesce(w, 0) AS bin_count,
                  CASE WHEN sum(coalesce(w, 0)) OVER p > 0
                       THEN coalesce(w, 0) / sum(coalesce(w, 0)) OVER p ELSE 0 END
                      AS bin_proportion
           FROM (SELECT ski_area_id FROM scal JOIN dim USING (ski_area_id)) CROSS JOIN bins
                LEFT JOIN binned USING (ski_area_id, num_bins, bin_index)
           WINDOW p AS (PARTITION BY ski_area_id, num_bins)""",
    ),
    "labelled": (
        ("hist",),
        "SELECT *, ("
        + str(COMPASS_WINDS)
        + ")[CAST(bin_center / 11.25 AS INTEGER) + 1] AS bin_label FROM hist",
    ),
}


def stats_sql(x: str, y: str, c: str, s: str, digits: bool = True) -> str:
    """The six statistics from sums of components and magnitudes and the hemisphere's sign."""
    x, y, c = f"coalesce({x}, 0)", f"coalesce({y}, 0)", f"coalesce({c}, 0)"
    net = f"sqrt({x}*{x} + {y}*{y})"
    angle = f"(CASE WHEN {net} > 1e-10 THEN atan2({y}, {x}) ELSE 0e0 END)"
    align = f"(CASE WHEN {c} > 1e-10 THEN {net} / {c} ELSE 0e0 END)"
    return f"""round((degrees(round({angle}, 10)) + 360) % 360, 7) AS bearing_mean,
        round({align}, 7) AS bearing_alignment,
        round({net}, 7) AS bearing_magnitude_net,
        round({c}, 7) AS bearing_magnitude_cum,
        round({s} * {align} * cos({angle}), 7) + 0e0 AS poleward_affinity,
        round({align} * sin({angle}), 7) + 0e0 AS eastward_affinity"""


STEPS["stat"] = (
    ("scal",),
    f"SELECT * EXCLUDE (x, y, c, s), {stats_sql('x', 'y', 'c', 's')} FROM scal",
)
STEPS["area"] = (
    ("dim", "stat", "head"),
    """SELECT ski_area_id, ski_area_name, osm_is_generated, osm_run_convention, osm_status,
              country, region, locality, country_code, country_subdiv_code,
              coalesce(run_count, 0) AS run_count, coalesce(lift_count, 0) AS lift_count,
              coalesce(coordinate_count, 0) AS coordinate_count,
              coalesce(segment_count, 0) AS segment_count,
              coalesce(combined_vertical, 0) AS combined_vertical,
              coalesce(combined_distance, 0) AS combined_distance,
              coalesce(CASE WHEN run_count IS NULL THEN 0 ELSE max_elevation - min_elevation END, 0)
                  AS vertical_drop,
              latitude, longitude, hemisphere, min_elevation, max_elevation,
              bearing_mean, bearing_alignment, bearing_magnitude_net, bearing_magnitude_cum,
              poleward_affinity, eastward_affinity
       FROM dim LEFT JOIN stat USING (ski_area_id) LEFT JOIN head USING (ski_area_id)""",
)
_SHOWN = "run_count >= 3 AND combined_vertical >= 50 AND ski_area_name IS NOT NULL"

_EDGES = "lat * 3e0 AS latitude_abs_bin_lower, (lat + 1) * 3e0 AS latitude_abs_bin_upper"
STEPS["band"] = (
    (),
    f"SELECT lat, {_EDGES}, (lat + 0.5) * 3e0 AS latitude_abs_bin_center "
    "FROM (SELECT unnest(range(30)) AS lat)",
)
STEPS["poled"] = (
    ("seg",),
    """SELECT *, abs(latitude) AS latitude_abs,
              CASE WHEN latitude > 0 THEN bearing ELSE ((180 - bearing) % 360 + 360) % 360 END
                  AS pole
       FROM seg WHERE downhill AND la IS NOT NULL""",
)
STEPS["cell"] = (
    ("poled", "band"),
    """SELECT band.*, sec * 4e0 AS bearing_bin_lower, (sec + 1) * 4e0 AS bearing_bin_upper,
              (sec + 0.5) * 4e0 AS bearing_bin_center, coalesce(n, 0) AS segment_count,
              round(coalesce(v, 0), 5) AS combined_vertical
       FROM band CROSS JOIN (SELECT unnest(range(90)) AS sec)
            LEFT JOIN (SELECT CAST(floor(latitude_abs / 3) AS BIGINT) AS lat,
                              CAST(floor(pole / 4) AS BIGINT) AS sec,
                              count(*) AS n, sum(distance_vertical_drop) AS v
                       FROM poled GROUP BY ALL) USING (lat, sec)""",
)
STEPS["enriched"] = (
    ("cell",),
    """SELECT *, combined_vertical / nullif(t, 0) AS prop,
              (combined_vertical + 20000e0/90) / (t + 20000) AS reg
       FROM (SELECT *, sum(combined_vertical) OVER (PARTITION BY lat) AS t FROM cell)""",
)
STEPS["long"] = (
    ("area",),
    " UNION ALL ".join(
        f"SELECT ski_area_id, ski_area_name, '{m}' AS variable, "
        f"round(CAST({m} AS DOUBLE), {4 if m == 'combined_vertical' else 3 if m == 'combined_distance' else 6}) AS value FROM area"
        for m in INEQUALITY_METRICS
    ),
)
STEPS["front"] = (
    ("area", "labelled"),
    f"""SELECT * FROM area LEFT JOIN (
            SELECT ski_area_id,
                   max(bin_proportion) FILTER (num_bins = 4 AND bin_label = 'N') AS p4n,
                   max(bin_proportion) FILTER (num_bins = 4 AND bin_label = 'E') AS p4e,
                   max(bin_proportion) FILTER (num_bins = 4 AND bin_label = 'S') AS p4s,
                   max(bin_proportion) FILTER (num_bins = 4 AND bin_label = 'W') AS p4w,
                   max(bin_proportion) FILTER (num_bins = 2 AND bin_label = 'N') AS p2n
            FROM labelled GROUP BY ski_area_id) USING (ski_area_id)
        WHERE {_SHOWN}""",
)
STEPS["flat"] = (
    (),
    """SELECT user_id AS path_id, event_id AS "index",
              (user_id*37) % 121 - 60 + ((event_id*7919) % 20011) / 1e6 AS latitude,
              (user_id*53) % 340 - 170 + ((event_id*6151) % 20011) / 1e6 AS longitude,
              500 + value*3 AS elevation
       FROM events""",
)

#: A step may not be called like a keyword.
_NAMES = {"full": "full_"}


def sql(needs: str, body: str) -> str:
    """A query over the named steps, with the steps they need in turn."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in STEPS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    steps = ", ".join(f"{_NAMES.get(n, n)} AS ({STEPS[n][1]})" for n in order)
    return f"WITH {steps} {body}" if order else body


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

_STAT_COLUMNS = f"""bearing_mean, bearing_alignment,
    round(bearing_magnitude_net + {OFF_TIES}, 5) AS bearing_magnitude_net,
    round(bearing_magnitude_cum + {OFF_TIES}, 5) AS bearing_magnitude_cum,
    poleward_affinity, eastward_affinity"""

_PLACE_COLUMNS = f"""round(latitude + {OFF_TIES}, 6) AS latitude,
    round(longitude + {OFF_TIES}, 6) AS longitude,
    round(min_elevation, 6) AS min_elevation, round(max_elevation, 6) AS max_elevation,
    round(vertical_drop, 6) AS vertical_drop"""

_AREA_COLUMNS = f"""ski_area_id, ski_area_name, osm_is_generated, osm_run_convention, osm_status,
    country, region, locality, country_code, country_subdiv_code, run_count, lift_count,
    coordinate_count, segment_count, round(combined_vertical, 4) AS combined_vertical,
    round(combined_distance, 3) AS combined_distance, hemisphere, {_PLACE_COLUMNS},
    {_STAT_COLUMNS}"""

_POINT = """round(latitude, 7) AS latitude, round(longitude, 7) AS longitude,
    round(elevation, 6) AS elevation"""


def _rollup(group: str, where: str = "TRUE", extra: str = "") -> str:
    keys = group.split(",")
    matched = " AND ".join(f"g.{k.strip()} = h.{k.strip()}" for k in keys)
    complete = "(bearing_mean IS NOT NULL AND hemisphere IS NOT NULL)"
    sign = f"CASE WHEN {complete} THEN CASE hemisphere WHEN 'north' THEN 1 ELSE -1 END END"
    stats = stats_sql("x", "y", "c", "s")
    return sql(
        "area labelled",
        f"""SELECT {group}, ski_areas_count, country_count, run_count, coordinate_count,
                   segment_count, lift_count, round(combined_vertical, 4) AS combined_vertical,
                   round(combined_distance, 3) AS combined_distance, {_PLACE_COLUMNS},
                   {_STAT_COLUMNS} {extra}
            FROM (SELECT *, {stats} FROM (
                SELECT {group}, count(DISTINCT ski_area_id) AS ski_areas_count,
                   count(DISTINCT country) + CAST(bool_or(country IS NULL) AS BIGINT)
                       AS country_count,
                   CAST(sum(run_count) AS BIGINT) AS run_count,
                   CAST(sum(coordinate_count) AS BIGINT) AS coordinate_count,
                   CAST(sum(segment_count) AS BIGINT) AS segment_count,
                   CAST(sum(lift_count) AS BIGINT) AS lift_count,
                   sum(combined_vertical) AS combined_vertical,
                   sum(combined_distance) AS combined_distance,
                   min(min_elevation) AS min_elevation, max(max_elevation) AS max_elevation,
                   max(max_elevation) - min(min_elevation) AS vertical_drop,
                   avg(latitude) AS latitude, avg(longitude) AS longitude,
                   sum(bearing_magnitude_net * cos(radians(bearing_mean))) FILTER {complete} AS x,
                   sum(bearing_magnitude_net * sin(radians(bearing_mean))) FILTER {complete} AS y,
                   sum(bearing_magnitude_cum) FILTER {complete} AS c,
                   CASE WHEN min({sign}) = max({sign}) THEN min({sign}) END AS s
                FROM area WHERE {where} GROUP BY {group})) g
            WHERE EXISTS (SELECT 1 FROM (
                SELECT area.* FROM area SEMI JOIN labelled USING (ski_area_id)
                WHERE {where}) h WHERE {matched})""",
    )


def _named(group: str) -> str:
    return f"{group} IS NOT NULL AND osm_status = 'operating' AND ski_area_name IS NOT NULL"


_LABEL = """upper(substr(osm_status, 1, 1)) || substr(osm_status, 2) || ' in '
    || upper(substr(hemisphere, 1, 1)) || substr(hemisphere, 2) || ' Hem.'"""

#: The presets: what they group by, and which areas they take.
_PRESETS = {
    "hemisphere": ("hemisphere", _named("hemisphere")),
    "hemisphere_status": ("hemisphere, osm_status", "hemisphere = 'north' AND osm_status IN ('abandoned', 'operating')"),
    "country": ("country", _named("country")),
    "region": ("region", f"country = '{COUNTRY}' AND {_named('region')}"),
}
_EXTRA = {"hemisphere, osm_status": f", {_LABEL} AS hemisphere_status"}


def _of_presets(query) -> str:
    """One query for each preset, in one table; columns that a preset lacks are NULL."""
    return " UNION ALL BY NAME ".join(
        f"SELECT '{name}' AS preset, * FROM ({query(group, where)})" for name, (group, where) in _PRESETS.items()
    )


_FLAG = "chr(127397 + ascii(country_code)) || chr(127397 + ascii(substr(country_code, 2)))"


def _kept(needs: str, table: str, conditions: dict[str, str]) -> str:
    return sql(
        needs,
        " UNION ALL ".join(
            f"SELECT '{name}' AS filter, count(*) FILTER ({c}) AS kept FROM {table}"
            for name, c in conditions.items()
        ),
    )


_SHARES = {
    "p4n": '"bin_proportion_4_N"',
    "p4e": '"bin_proportion_4_E"',
    "p4s": '"bin_proportion_4_S"',
    "p4w": '"bin_proportion_4_W"',
    "p2n": '"bin_proportion_2_N"',
}


def _round_again(columns: str, first: int, names: dict[str, str] | None = None) -> str:
    """Round to ``first`` digits and then to 4, the second time on exact decimals."""
    return ", ".join(
        f"CAST(round(CAST(round({c}, {first}) AS DECIMAL(18, {first})), 4) AS DOUBLE) "
        f"AS {(names or {}).get(c, c)}"
        for c in columns.split()
    )


def _only_with_edges() -> str:
    return ", ".join(f"CASE WHEN e > 0 THEN {n} END AS {n}" for n in BEARING_STATS)


def _round_all(columns: str, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def _rolled_bins(group: str, which: str) -> str:
    return f"""SELECT {group}, CAST(num_bins AS INTEGER) AS num_bins,
                      CAST(bin_index AS INTEGER) AS bin_index, bin_center,
                      round(n, 4) AS bin_count, bin_label,
                      round(CASE WHEN t > 0 THEN n / t ELSE 0 END, 6) AS bin_proportion
               FROM (SELECT *, sum(n) OVER (PARTITION BY {group}, num_bins) AS t FROM (
                     SELECT {group}, num_bins, bin_index, max(bin_center) AS bin_center,
                            max(bin_label) AS bin_label, sum(bin_count) AS n
                     FROM area JOIN labelled USING (ski_area_id) WHERE {which} GROUP BY ALL))"""


_MANIFEST = """
    SELECT 'https://example.org/' || p AS url, p AS relative_path,
           '2024-11-24T00:00:00+00:00' AS last_modified, '2024-11-24T00:00:00+00:00' AS downloaded,
           round(n / 1048576, 9) AS content_size_mb, round(n / 1048576, 9) AS compressed_size_mb,
           sha256(text) AS checksum_sha256
    FROM (SELECT text, source || '/' || doc_id || '.txt' AS p, strlen(text) AS n FROM documents)"""


def oracle_sql() -> dict[str, str]:
    queries = {
        "geojson_scan": sql(
            "home",
            """SELECT run_id, CASE WHEN run_no % 11 <> 0 THEN 'Run ' || run_no END AS run_name,
                      CAST(CASE WHEN run_no % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS sources,
                      geometry_type, CAST(points AS INTEGER) AS points
               FROM home""",
        ),
        "feature_store": sql(
            "home",
            """SELECT run_id, CASE WHEN run_no % 11 <> 0 THEN 'Run ' || run_no END AS run_name,
                      CAST(CASE WHEN run_no % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS sources,
                      geometry_type, CAST(points AS INTEGER) AS points, true AS noted
               FROM home""",
        ),
        "geometry_profile": sql(
            "home", 'SELECT geometry_type, count(*) AS "count" FROM home GROUP BY geometry_type'
        ),
        "load_runs": sql(
            "line clean",
            """SELECT run_id, CASE WHEN run_no % 11 <> 0 THEN 'Run ' || run_no END AS run_name,
                      CASE run_no % 5 WHEN 0 THEN 'nordic' WHEN 1 THEN 'skitour,downhill'
                           ELSE 'downhill' END AS run_uses,
                      ['operating', 'abandoned', 'proposed', 'disused'][run_no % 4 + 1]
                          AS run_status,
                      ['novice', 'easy', 'intermediate', 'advanced', 'expert', 'extreme',
                       'freeride', 'other'][run_no % 8 + 1] AS run_difficulty,
                      ['japan', 'europe', 'north_america'][home % 3 + 1] AS run_convention,
                      CASE WHEN home % 10 = 9 THEN ''
                           WHEN run_no % 7 = 0 THEN least('a' || home, 'a' || (home + 10)) || ','
                                || greatest('a' || home, 'a' || (home + 10))
                           ELSE 'a' || home END AS ski_area_ids,
                      CASE WHEN run_no % 3 = 0
                           THEN 'https://skimap.org/skiareas/view/' || run_no || ',' ELSE '' END
                          || 'https://www.openstreetmap.org/way/' || run_no AS run_sources,
                      CAST(points AS INTEGER) AS raw_points,
                      CAST(coalesce(n, 0) AS INTEGER) AS clean_points
               FROM line LEFT JOIN (SELECT run_no, count(*) AS n FROM clean GROUP BY run_no)
                    USING (run_no)""",
        ),
        "load_lifts": sql(
            "lift",
            """SELECT lift_id, c_name AS lift_name, lower(c_mktsegment) AS lift_type, lift_status,
                      CASE WHEN k % 11 = 0 THEN ''
                           WHEN k % 6 = 1 THEN least('a' || near, 'a' || (near + 1)) || ','
                                || greatest('a' || near, 'a' || (near + 1))
                           ELSE 'a' || near END AS ski_area_ids,
                      'openstreetmap:way/' || k AS lift_sources, shape AS lift_geometry_type
               FROM lift""",
        ),
        "flatten_struct": sql(
            "place",
            """SELECT ski_area_id, ski_area_name, kind AS type, osm_status AS status,
                      osm_is_generated AS generated, osm_run_convention AS "runConvention",
                      country_code AS "location__iso3166_1Alpha2",
                      country_subdiv_code AS location__iso3166_2,
                      country AS location__localized__en__country,
                      region AS location__localized__en__region,
                      locality AS location__localized__en__locality
               FROM place""",
        ),
        "area_dimension": sql(
            "dim",
            """SELECT ski_area_id, ski_area_name, osm_is_generated, osm_run_convention, osm_status,
                      country, region, locality, country_code, country_subdiv_code,
                      'https://example.org/' || k AS ski_area_websites, urls AS ski_area_sources,
                      lift_count
               FROM dim""",
        ),
        "lift_count": sql("lifted", "SELECT ski_area_id, lift_count FROM lifted"),
        "scan_runs": sql(
            "line clean",
            """SELECT run_id, ['operating', 'abandoned', 'proposed', 'disused'][run_no % 4 + 1]
                          AS run_status, CAST(coalesce(n, 0) AS INTEGER) AS points
               FROM line LEFT JOIN (SELECT run_no, count(*) AS n FROM clean GROUP BY run_no)
                    USING (run_no)""",
        ),
        "filtered_scan": sql(
            "area",
            """SELECT ski_area_id, osm_status, run_count, lift_count FROM area
               WHERE osm_status = 'operating' AND run_count >= 3""",
        ),
        "export_runs": sql(
            "seg",
            """SELECT run_id, "index", round(latitude, 6) AS latitude,
                      round(longitude, 6) AS longitude, round(elevation, 6) AS elevation,
                      round(distance_vertical, 6) AS distance_vertical,
                      round(distance_vertical_drop, 6) AS distance_vertical_drop,
                      round(distance_horizontal, 5) AS distance_horizontal,
                      round(distance_3d, 5) AS distance_3d, round(bearing, 4) AS bearing,
                      round(gradient, 5) AS gradient, round(degrees(atan(gradient)), 4) AS slope
               FROM seg""",
        ),
        "export_metrics": sql(
            "area",
            """SELECT ski_area_id, run_count, round(combined_vertical, 4) AS combined_vertical
               FROM area""",
        ),
        "subset_by_keys": sql(
            "home bridge dim",
            """SELECT run_id, CASE WHEN run_no % 11 <> 0 THEN 'Run ' || run_no END AS run_name,
                      true AS profile, true AS has_null
               FROM home SEMI JOIN (
                   SELECT run_no FROM bridge JOIN dim USING (ski_area_id)
                   WHERE osm_status = 'abandoned') USING (run_no)""",
        ),
        "subset_collection": sql(
            "home bridge dim",
            """SELECT form, run_id FROM home SEMI JOIN (
                   SELECT run_no FROM bridge JOIN dim USING (ski_area_id)
                   WHERE osm_status = 'abandoned') USING (run_no),
                   (VALUES ('lines'), ('document')) AS forms(form)""",
        ),
        "stored_area_runs": sql(
            "seg bridge",
            f"""SELECT ski_area_id, run_id, "index", round(elevation, 6) AS elevation,
                       round(distance_vertical, 6) AS distance_vertical
                FROM seg JOIN bridge USING (run_no, run_id) WHERE ski_area_id IN {AREAS}""",
        ),
        "manifest_read": _MANIFEST,
        "file_manifest": _MANIFEST,
        "validate_faults": sql(
            "area",
            """, a AS (SELECT *, CAST(substr(ski_area_id, 2) AS BIGINT) AS k FROM area)
               SELECT 'run_count is in range' AS rule, count(*) FILTER (k % 7 = 1) AS violations FROM a
               UNION ALL SELECT 'latitude is in range', count(*) FILTER (k % 5 = 2) FROM a
               UNION ALL SELECT 'bearing_mean is in range', count(*) FILTER (k % 9 = 3) FROM a
               UNION ALL SELECT 'osm_status is an allowed value', count(*) FILTER (k % 11 = 4) FROM a
               UNION ALL SELECT 'ski_area_id is unique',
                                CASE WHEN count(*) FILTER (k % 13 = 5) > 1
                                     THEN count(*) FILTER (k % 13 = 5) ELSE 0 END FROM a""",
        ),
        "broken_rows": sql(
            "area",
            """, a AS (SELECT *, CAST(substr(ski_area_id, 2) AS BIGINT) AS k FROM area),
               b AS (SELECT k, CASE WHEN k % 13 = 5 THEN 'a5' ELSE ski_area_id END AS ski_area_id FROM a)
               SELECT ski_area_id, 'run_count is in range' AS rule FROM b WHERE k % 7 = 1
               UNION ALL SELECT ski_area_id, 'latitude is in range' FROM b WHERE k % 5 = 2
               UNION ALL SELECT ski_area_id, 'bearing_mean is in range' FROM b WHERE k % 9 = 3
               UNION ALL SELECT ski_area_id, 'osm_status is an allowed value' FROM b WHERE k % 11 = 4""",
        ),
        "bin_faults": sql(
            "labelled",
            """SELECT ski_area_id, CAST(num_bins AS INTEGER) AS num_bins,
                      CAST(bin_index AS INTEGER) AS bin_index, CAST(2 AS BIGINT) AS "count"
               FROM labelled WHERE CAST(substr(ski_area_id, 2) AS BIGINT) % 3 = 0""",
        ),
        "geojson_document": sql("place", "SELECT ski_area_id, osm_status AS status FROM place"),
        "structure_coords": sql(
            "raw",
            """SELECT run_id, idx AS "index", round(latitude, 6) AS latitude,
                      round(longitude, 6) AS longitude, round(elevation, 6) AS elevation
               FROM raw""",
        ),
        "clean_coords": sql("clean", f'SELECT run_id, "index", {_POINT} FROM clean'),
        "source_url": sql(
            "home",
            """SELECT run_id, 'https://www.openstreetmap.org/way/' || run_no AS url FROM home
               UNION ALL
               SELECT run_id, 'https://skimap.org/skiareas/view/' || run_no FROM home
               WHERE run_no % 3 = 0""",
        ),
        "sources_to_urls": sql("place", "SELECT ski_area_id, urls FROM place"),
        "sorted_ids": sql(
            "home bridge",
            """SELECT run_id, coalesce(string_agg(ski_area_id, ',' ORDER BY ski_area_id), '')
                          AS ski_area_ids
               FROM home LEFT JOIN bridge USING (run_no, run_id) GROUP BY run_id""",
        ),
        "explode_unnest": sql("pt", f'SELECT run_id, "index", {_POINT} FROM pt'),
        "regroup_coords": sql(
            "pt",
            """SELECT run_id, CAST(count(*) AS INTEGER) AS points,
                      arg_min(elevation, "index") AS first_elevation,
                      arg_max(elevation, "index") AS last_elevation
               FROM pt GROUP BY run_id""",
        ),
        "run_area_bridge": sql(
            "bridge line", "SELECT ski_area_id, run_id FROM bridge SEMI JOIN line USING (run_no)"
        ),
        "downhill_filter": sql("line", "SELECT run_id FROM line WHERE run_no % 5 <> 0"),
        "area_run_paths": sql(
            "clean bridge",
            f"""SELECT ski_area_id, clean.run_id, "index" AS pos, {_POINT}
                FROM clean JOIN bridge USING (run_no) WHERE run_no % 5 <> 0""",
        ),
        "runs_of_area": sql(
            "seg bridge",
            """SELECT run_id, CASE WHEN run_no % 11 <> 0 THEN 'Run ' || run_no END AS run_name,
                      ['novice', 'easy', 'intermediate', 'advanced', 'expert', 'extreme',
                       'freeride', 'other'][run_no % 8 + 1] AS run_difficulty,
                      "index", round(elevation, 6) AS elevation,
                      round(distance_vertical, 6) AS distance_vertical
               FROM seg SEMI JOIN (SELECT run_no FROM bridge WHERE ski_area_id = 'a1')
                    USING (run_no)""",
        ),
        "union_all": sql(
            "home lift",
            """SELECT 'run' AS kind, geometry_type AS shape, count(*) AS features
               FROM home GROUP BY ALL
               UNION ALL SELECT 'lift', shape, count(*) FROM lift GROUP BY ALL""",
        ),
        "hemisphere": sql(
            "seg",
            """SELECT run_id, "index", CASE sign WHEN 1 THEN 'north' WHEN -1 THEN 'south' END
                          AS hemisphere FROM seg""",
        ),
        "flip_bearing": sql(
            "seg",
            """SELECT run_id, "index", round(CASE WHEN latitude > 0 THEN bearing
                          ELSE ((180 - bearing) % 360 + 360) % 360 END, 4) AS bearing_poleward
               FROM seg""",
        ),
        "segment_distance": sql(
            "seg",
            f"""SELECT run_id, "index", {_round_all("distance_horizontal distance_3d", 5)}
                FROM seg""",
        ),
        "segment_bearing": sql("seg", f'SELECT run_id, "index", {_round_all("bearing", 4)} FROM seg'),
        "segment_drop": sql(
            "seg",
            f"""SELECT run_id, "index", {_round_all("distance_vertical distance_vertical_drop", 6)}
                FROM seg""",
        ),
        "segment_slope": sql(
            "seg",
            """SELECT run_id, "index", round(gradient, 5) AS gradient,
                      round(degrees(atan(gradient)), 4) AS slope FROM seg""",
        ),
        "segment_hash": sql(
            "seg",
            """SELECT run_id, count(la) AS hashed,
                      count(DISTINCT CASE WHEN la IS NOT NULL
                            THEN {'a': la, 'b': lo, 'c': latitude, 'd': longitude} END)
                          AS distinct_steps
               FROM seg GROUP BY run_id""",
        ),
        "segments": sql(
            "seg",
            f"""SELECT run_id, "index", {_POINT},
                       {_round_all("distance_vertical distance_vertical_drop", 6)},
                       {_round_all("distance_horizontal distance_3d", 5)},
                       round(bearing, 4) AS bearing, round(gradient, 5) AS gradient,
                       round(degrees(atan(gradient)), 4) AS slope
                FROM seg""",
        ),
        "segments_flat": sql(
            "flat",
            """SELECT path_id, "index",
                      round(CASE WHEN el - elevation > 0 THEN el - elevation
                                 WHEN el - elevation <= 0 THEN 0e0 END, 6)
                          AS distance_vertical_drop,
                      CASE WHEN la IS NOT NULL THEN round(2 * 6371009 * asin(sqrt(least(1e0,
                          pow(sin(radians(latitude - la)/2), 2) + cos(radians(la))
                          * cos(radians(latitude)) * pow(sin(radians(longitude - lo)/2), 2)))), 4)
                      END AS distance_horizontal,
                      round((degrees(atan2(sin(radians(longitude - lo)) * cos(radians(latitude)),
                          cos(radians(la)) * sin(radians(latitude)) - sin(radians(la))
                          * cos(radians(latitude)) * cos(radians(longitude - lo)))) + 360) % 360, 4)
                          AS bearing
               FROM (SELECT *, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo,
                            lag(elevation) OVER w AS el
                     FROM flat WINDOW w AS (PARTITION BY path_id ORDER BY "index"))""",
        ),
        "lead_segments": sql(
            "seg",
            """SELECT path, "index", index0, round(x, 7) AS x, round(y, 7) AS y,
                      round(xend, 7) AS xend, round(yend, 7) AS yend,
                      round(xend - x, 6) AS dx, round(yend - y, 6) AS dy,
                      round(v * (xend - x) / 4, 6) AS scaled_dx,
                      round(v * (yend - y) / 4, 6) AS scaled_dy, round(tg, 4) AS tg,
                      CAST(floor((tg + 5.625) / 11.25) AS INTEGER) % 32 + 1 AS "group"
               FROM (SELECT *, (degrees(atan2(xend - x, yend - y)) + 360) % 360 AS tg
                     FROM (SELECT run_id AS path, "index" AS index0, longitude AS x,
                                  latitude AS y, lead(longitude) OVER w AS xend,
                                  lead(latitude) OVER w AS yend,
                                  lead(distance_vertical) OVER w AS v,
                                  row_number() OVER (ORDER BY "index" NULLS LAST, run_id)
                                      AS "index"
                           FROM seg WINDOW w AS (PARTITION BY run_no ORDER BY seg."index")))
               WHERE xend IS NOT NULL""",
        ),
        "spoke_group": sql(
            "seg",
            """SELECT CAST(floor((bearing + 5.625) / 11.25) AS INTEGER) % 32 + 1 AS "group",
                      count(*) AS segments
               FROM seg WHERE bearing IS NOT NULL GROUP BY ALL""",
        ),
        "side_of_line": sql(
            "seg",
            f"""SELECT run_id, "index",
                       {LINE[0][1]}e0 + (longitude - {LINE[0][0]}e0)
                       * ({LINE[1][1]}e0 - {LINE[0][1]}e0) / ({LINE[1][0]}e0 - {LINE[0][0]}e0)
                       < latitude AS above
                FROM seg""",
        ),
        "area_metrics": sql("area", f"SELECT {_AREA_COLUMNS} FROM area"),
        "bearing_distribution": sql(
            "labelled",
            """SELECT ski_area_id, CAST(num_bins AS INTEGER) AS num_bins,
                      CAST(bin_index AS INTEGER) AS bin_index, bin_center,
                      round(bin_count, 4) AS bin_count, round(bin_proportion, 6) AS bin_proportion,
                      bin_label
               FROM labelled""",
        ),
        "bearing_histogram": sql(
            "seg",
            f"""SELECT hemisphere, CAST(12 AS INTEGER) AS num_bins,
                      CAST(i AS INTEGER) AS bin_index, (i - 1) * 30e0 AS bin_center,
                      round(coalesce(w, 0), 4) AS bin_count,
                      round(coalesce(coalesce(w, 0) / sum(w) OVER (PARTITION BY hemisphere), 0), 6)
                          AS bin_proportion,
                      CASE WHEN (i - 1) % 3 = 0 THEN
                           {COMPASS_WINDS}[CAST((i - 1) * 30 / 11.25 AS INTEGER) + 1] END
                          AS bin_label
               FROM (SELECT DISTINCT CASE sign WHEN 1 THEN 'north' WHEN -1 THEN 'south' END
                            AS hemisphere FROM seg)
                    CROSS JOIN (SELECT unnest(range(1, 13)) AS i)
                    LEFT JOIN (SELECT CASE sign WHEN 1 THEN 'north' WHEN -1 THEN 'south' END
                                      AS hemisphere,
                                      floor((bearing + 15) / 30) % 12 + 1 AS i,
                                      sum(distance_vertical_drop) AS w
                               FROM seg WHERE bearing IS NOT NULL GROUP BY ALL)
                    USING (hemisphere, i)""",
        ),
        "compass_label": sql(
            "seg",
            f"""SELECT {COMPASS_WINDS}[CAST(floor((bearing + 5.625) / 11.25) AS INTEGER) % 32 + 1]
                           AS wind, count(*) AS segments
                FROM seg WHERE bearing IS NOT NULL GROUP BY ALL""",
        ),
        "bearing_stats": sql(
            "seg",
            f"""SELECT run_difficulty, {_STAT_COLUMNS} FROM (
                SELECT run_difficulty, {stats_sql("x", "y", "c", "s")} FROM (
                SELECT ['novice', 'easy', 'intermediate', 'advanced', 'expert', 'extreme',
                        'freeride', 'other'][run_no % 8 + 1] AS run_difficulty,
                       sum(CASE WHEN ok THEN cos(radians(bearing)) END) AS x,
                       sum(CASE WHEN ok THEN sin(radians(bearing)) END) AS y,
                       sum(CASE WHEN ok THEN 1e0 END) AS c,
                       CASE WHEN min(CASE WHEN ok THEN sign END) = max(CASE WHEN ok THEN sign END)
                            THEN min(CASE WHEN ok THEN sign END) END AS s
                FROM (SELECT *, bearing IS NOT NULL AND sign IS NOT NULL AS ok FROM seg)
                GROUP BY ALL))""",
        ),
        "bearing_stats_weights": sql(
            "full",
            f"""SELECT ski_area_id, {_STAT_COLUMNS} FROM (
                SELECT ski_area_id, {stats_sql("x", "y", "c", "s")} FROM (
                SELECT ski_area_id,
                       sum(CASE WHEN complete THEN distance_vertical_drop * cos(radians(bearing))
                           END) AS x,
                       sum(CASE WHEN complete THEN distance_vertical_drop * sin(radians(bearing))
                           END) AS y,
                       sum(CASE WHEN complete THEN distance_3d END) AS c,
                       CASE WHEN min(CASE WHEN complete THEN sign END)
                                 = max(CASE WHEN complete THEN sign END)
                            THEN min(CASE WHEN complete THEN sign END) END AS s
                FROM full_ GROUP BY ALL))""",
        ),
        "display_filter": sql("area", f"SELECT ski_area_id FROM area WHERE {_SHOWN}"),
        "predicate_chain": sql(
            "dim",
            """SELECT ski_area_id, country, region FROM dim
               WHERE osm_status = 'operating' AND ski_area_name IS NOT NULL
                     AND region IN ('ASIA', 'EUROPE')""",
        ),
        "rollup_region": _rollup("region"),
        "rollup_state": _rollup("region", f"country = '{COUNTRY}' AND {_named('region')}"),
        "rollup_hemisphere": _rollup("hemisphere", _named("hemisphere")),
        "rollup_country": _rollup("country", _named("country")),
        "rollup_status": _rollup(
            "hemisphere, osm_status",
            "hemisphere = 'north' AND osm_status IN ('abandoned', 'operating')",
            f", {_LABEL} AS hemisphere_status",
        ),
        "rollup_presets": _of_presets(lambda g, w: _rollup(g, w, _EXTRA.get(g, ""))),
        "rollup_bins_presets": _of_presets(lambda g, w: sql("area labelled", _rolled_bins(g, w))),
        "rollup_having": sql(
            "area",
            f"""SELECT country, round(sum(combined_vertical), 4) AS combined_vertical FROM area
                WHERE {_named("country")} GROUP BY country
                HAVING sum(combined_vertical) >= 10000""",
        ),
        "export_rollup": sql(
            "area",
            f"""SELECT country, count(*) AS ski_areas_count,
                       round(sum(combined_vertical), 4) AS combined_vertical FROM area
                WHERE {_named("country")} GROUP BY country
                HAVING bool_or(run_count > 0)""",
        ),
        "rollup_histogram": sql("area labelled", _rolled_bins("region", "true")),
        "rollup_bins_country": sql(
            "area labelled", _rolled_bins("country", _named("country"))
        ),
        "rollup_bins_status": sql(
            "area labelled",
            _rolled_bins(
                "hemisphere, osm_status",
                "hemisphere = 'north' AND osm_status IN ('abandoned', 'operating')",
            ),
        ),
        "status_label": sql("area", f"SELECT ski_area_id, {_LABEL} AS label FROM area"),
        "lat_bin": sql(
            "poled",
            """SELECT (floor(latitude_abs / 3) + 1) * 3e0 AS latitude_abs_bin_upper,
                      count(*) AS segments FROM poled GROUP BY ALL""",
        ),
        "grid_bins": sql(
            "cell",
            """SELECT latitude_abs_bin_lower, latitude_abs_bin_upper, latitude_abs_bin_center,
                      bearing_bin_lower, bearing_bin_upper, bearing_bin_center, segment_count
               FROM cell""",
        ),
        "lat_histogram": sql(
            "band poled",
            f"""SELECT hemisphere, latitude_abs_bin_lower, latitude_abs_bin_upper,
                       latitude_abs_bin_center, coalesce(n, 0) AS segment_count,
                       round(coalesce(v, 0), 4) AS combined_vertical, {_STAT_COLUMNS}
                FROM band CROSS JOIN (SELECT unnest(['north', 'south']) AS hemisphere)
                LEFT JOIN (SELECT hemisphere, lat, n, v, {stats_sql("x", "y", "c", "s")} FROM (
                    SELECT CASE sign WHEN 1 THEN 'north' WHEN -1 THEN 'south' END AS hemisphere,
                           CAST(floor(latitude_abs / 3) AS BIGINT) AS lat, count(*) AS n,
                           sum(distance_vertical_drop) AS v,
                           sum(distance_vertical_drop * cos(radians(bearing))) AS x,
                           sum(distance_vertical_drop * sin(radians(bearing))) AS y,
                           sum(distance_vertical_drop) AS c, max(sign) AS s
                    FROM poled GROUP BY ALL)) USING (hemisphere, lat)""",
        ),
        "lat_bearing_grid": sql(
            "enriched",
            """SELECT latitude_abs_bin_lower, latitude_abs_bin_upper, latitude_abs_bin_center,
                      bearing_bin_lower, bearing_bin_upper, bearing_bin_center, segment_count,
                      round(combined_vertical, 4) AS combined_vertical,
                      round(t, 4) AS total_combined_vertical,
                      round(prop, 6) AS combined_vertical_prop,
                      round(prop * 90, 6) AS combined_vertical_enrichment,
                      round(radians(bearing_bin_center), 6) AS bearing_bin_center_radians,
                      round(reg, 6) AS combined_vertical_prop_regularized,
                      round(reg * 90, 6) AS combined_vertical_enrichment_regularized
               FROM enriched""",
        ),
        "mesh_grid": sql(
            "enriched",
            "SELECT latitude_abs_bin_lower, "
            + ", ".join(
                f"round(max(CASE WHEN t >= 10000 THEN least(greatest(reg * 90, 0e0), 2.5e0) END) "
                f"FILTER (bearing_bin_lower = {4 * i}), 6) AS bearing_{4 * i}"
                for i in range(90)
            )
            + " FROM enriched GROUP BY latitude_abs_bin_lower",
        ),
        "metric_unpivot": sql(
            "area",
            " UNION ALL ".join(
                f"SELECT ski_area_id, ski_area_name, '{m}' AS variable, "
                f"round(CAST({m} AS DOUBLE), 3) AS value FROM area"
                for m in INEQUALITY_METRICS
            ),
        ),
        "metric_ecdf": sql(
            "long",
            """SELECT ski_area_id, ski_area_name, variable, round(value, 3) AS value,
                      row_number() OVER w AS value_rank,
                      round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 3) AS value_cumsum,
                      round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING)
                            / sum(value) OVER v, 6) AS value_cdf,
                      round(row_number() OVER w / count(value) OVER v, 6) AS value_rank_pctl
               FROM long WINDOW w AS (PARTITION BY variable ORDER BY value, ski_area_id),
                                v AS (PARTITION BY variable)""",
        ),
        "gini": sql(
            "long",
            """SELECT variable, round(1 - 2 * sum(cum) / (count(*) * max(cum)) + 1e0 / count(*), 6)
                          AS gini,
                      upper(substr(variable, 1, 1))
                          || substr(split_part(variable, '_', 1), 2) || ' '
                          || upper(substr(split_part(variable, '_', 2), 1, 1))
                          || substr(split_part(variable, '_', 2), 2) AS variable_label
               FROM (SELECT variable, sum(value) OVER (PARTITION BY variable
                            ORDER BY value, ski_area_id ROWS UNBOUNDED PRECEDING) AS cum FROM long)
               GROUP BY variable""",
        ),
        "metric_label": sql(
            "long",
            """SELECT variable, count(*) AS "count",
                      upper(substr(variable, 1, 1))
                          || substr(split_part(variable, '_', 1), 2) || ' '
                          || upper(substr(split_part(variable, '_', 2), 1, 1))
                          || substr(split_part(variable, '_', 2), 2) AS label
               FROM long GROUP BY variable""",
        ),
        "cardinal_pivot": sql(
            "labelled",
            "SELECT ski_area_id, "
            + ", ".join(
                f"round(max(bin_proportion) FILTER (num_bins = {n} AND bin_label = '{w}'), 5) "
                f"AS bin_proportion_{n}_{w}"
                for n, w in ((4, "N"), (4, "E"), (4, "S"), (4, "W"), (2, "N"))
            )
            + " FROM labelled GROUP BY ski_area_id",
        ),
        "frontend_table": sql(
            "front",
            f"""SELECT ski_area_id, ski_area_name, osm_status, {_FLAG} AS country_emoji, country,
                       country_code, region, locality, round(latitude, 4) AS latitude,
                       run_count, lift_count,
                       {_round_all("combined_vertical min_elevation max_elevation", 4)},
                       {_round_all("vertical_drop", 4)},
                       {_round_again("bearing_mean bearing_alignment", 7)},
                       {_round_again("poleward_affinity eastward_affinity", 7)},
                       {_round_again("p4n p4e p4s p4w p2n", 5, _SHARES)}, ski_area_id AS rose
                FROM front""",
        ),
        "flag_emoji": sql("dim", f"SELECT ski_area_id, {_FLAG} AS flag FROM dim"),
        "round_doubles": sql(
            "area",
            f"""SELECT ski_area_id, run_count, {_round_all("combined_vertical latitude", 3)}
                FROM area""",
        ),
        "rose_geometry": sql(
            "labelled",
            """SELECT ski_area_id, CAST(bin_index AS INTEGER) AS bin_index,
                      round(radians(bin_center), 6) AS angle, round(radians(45e0), 6) AS width,
                      round(sqrt(bin_count), 4) AS radius,
                      round(max(sqrt(bin_count)) OVER (PARTITION BY ski_area_id), 4) AS axis_limit
               FROM labelled WHERE num_bins = 8""",
        ),
        "rose_geometry_shared": sql(
            "labelled",
            """SELECT ski_area_id, CAST(bin_index AS INTEGER) AS bin_index,
                      round(radians(bin_center), 6) AS angle, round(radians(90e0), 6) AS width,
                      round(bin_count, 4) AS radius,
                      (SELECT round(max(bin_count), 4) FROM labelled WHERE num_bins = 4)
                          AS axis_limit
               FROM labelled WHERE num_bins = 4""",
        ),
        "numeric_filter": _kept(
            "area",
            "area",
            {
                "15": "latitude >= 15",
                "-20": "latitude <= -20",
                "-": "latitude <= 0",
                "-0": "latitude <= 0",
                "[10, 20]": "latitude BETWEEN 10 AND 20",
                "(10, 20)": "latitude > 10 AND latitude < 20",
                "(, 5]": "latitude <= 5",
                "[3,": "TRUE",
                "about 7": "TRUE",
            },
        ),
        "percent_filter": _kept(
            "area",
            "area",
            {
                "15": "bearing_alignment * 100 >= 15",
                "[10, 30)": "bearing_alignment * 100 >= 10 AND bearing_alignment * 100 < 30",
                "-": "bearing_alignment <= 0",
            },
        ),
        "latitude_filter": _kept(
            "area",
            "area",
            {
                "north": "latitude > 0",
                "SOU": "latitude <= 0 OR latitude IS NULL",
                "th": "TRUE",
                "east": "FALSE",
                "20": "latitude >= 20",
                "(-30, 0]": "latitude > -30 AND latitude <= 0",
            },
        ),
        "country_filter": _kept(
            "area",
            "area",
            {
                "nation_1": "country LIKE 'NATION_1%'",
                "dv": "country_code = 'DV'",
                "\U0001f1e9\U0001f1fb": "country_code = 'DV'",
                "nowhere": "FALSE",
            },
        ),
        "footer_summary": sql(
            "front",
            """SELECT count(DISTINCT country) AS country_distinct,
                      count(DISTINCT region) AS region_distinct,
                      count(DISTINCT locality) AS locality_distinct,
                      CAST(sum(run_count) AS BIGINT) AS run_count_sum,
                      CAST(sum(lift_count) AS BIGINT) AS lift_count_sum,
                      round(sum(round(combined_vertical, 4)), 3) AS combined_vertical_sum,
                      round(sum(round(vertical_drop, 4)), 3) AS vertical_drop_sum,
                      round(min(min_elevation), 4) AS min_elevation_min,
                      round(max(max_elevation), 4) AS max_elevation_max, """
            + ", ".join(
                "round(sum(combined_vertical * CAST(round(CAST(round("
                f"{p}, 5) AS DECIMAL(18, 5)), 4) AS DOUBLE)) / sum(combined_vertical), 6) "
                f'AS "bin_proportion_{k}_mean"'
                for p, k in (
                    ("p4n", "4_N"),
                    ("p4e", "4_E"),
                    ("p4s", "4_S"),
                    ("p4w", "4_W"),
                    ("p2n", "2_N"),
                )
            )
            + " FROM front",
        ),
        "showcase_areas": sql(
            "area labelled",
            f"""SELECT ski_area_id, ski_area_name, CAST(num_bins AS INTEGER) AS num_bins,
                       CAST(bin_index AS INTEGER) AS bin_index, bin_center,
                       round(bin_count, 4) AS bin_count,
                       round(bin_proportion, 6) AS bin_proportion, bin_label
                FROM (SELECT * FROM (SELECT ski_area_id, ski_area_name FROM area
                          WHERE run_count >= 3 AND combined_vertical >= 50
                                AND ski_area_name <> '' AND country = '{COUNTRY}'
                                AND length(ski_area_name) < 20
                          ORDER BY (CAST(substr(ski_area_id, 2) AS BIGINT) * 7919) % 10007,
                                   ski_area_id LIMIT 3)
                      UNION ALL SELECT ski_area_id, ski_area_name FROM area
                      WHERE ski_area_name = 'Supplier#000000001')
                     JOIN labelled USING (ski_area_id) WHERE num_bins = 32""",
        ),
        "showcase_countries": sql(
            "area labelled",
            """SELECT country, ski_area_id, ski_area_name, CAST(num_bins AS INTEGER) AS num_bins,
                      CAST(bin_index AS INTEGER) AS bin_index, bin_center,
                      round(bin_count, 4) AS bin_count,
                      round(bin_proportion, 6) AS bin_proportion, bin_label
               FROM (SELECT country, ski_area_id, ski_area_name FROM area
                     WHERE run_count >= 3 AND combined_vertical >= 50 AND ski_area_name <> ''
                           AND country IS NOT NULL AND length(ski_area_name) < 20
                     QUALIFY row_number() OVER (PARTITION BY country
                         ORDER BY (CAST(substr(ski_area_id, 2) AS BIGINT) * 7919) % 10007, ski_area_id) <= 2)
                    JOIN labelled USING (ski_area_id) WHERE num_bins = 32""",
        ),
        "resource_counts": sql(
            "area",
            f"""SELECT count(*) AS ski_areas,
                       count(*) FILTER (lift_count >= 1) AS ski_areas_with_lift,
                       count(*) FILTER (lift_count >= 5) AS ski_areas_with_5_lifts,
                       count(*) FILTER (osm_status = 'operating' AND country = '{COUNTRY}')
                           AS operating_in_country,
                       CAST(sum(run_count) AS BIGINT) AS runs,
                       CAST(sum(segment_count) AS BIGINT) AS segments
                FROM area""",
        ),
        "value_counts": sql(
            "area", 'SELECT osm_status, count(*) AS "count" FROM area GROUP BY osm_status'
        ),
        "pending_keys": sql(
            "area", f"SELECT ski_area_id FROM area WHERE {_SHOWN} AND NOT lift_count >= 10"
        ),
        "key_changes": sql(
            "area",
            """SELECT ski_area_id, CASE WHEN k % 5 = 2 THEN 'removed' WHEN k % 9 = 3 THEN 'new'
                                   ELSE 'changed' END AS change
               FROM (SELECT ski_area_id, CAST(substr(ski_area_id, 2) AS BIGINT) AS k FROM area)
               WHERE (k % 5 = 2 AND k % 9 <> 3) OR (k % 5 <> 2 AND (k % 9 = 3 OR k % 7 = 1))""",
        ),
        "path_edges": sql(
            "seg",
            """SELECT run_id, "index", round(longitude, 7) AS longitude,
                      round(latitude, 7) AS latitude, round(distance_vertical_drop, 6) AS vertical,
                      round(bearing, 4) AS bearing, round(distance_horizontal, 4) AS length
               FROM seg WHERE la IS NOT NULL""",
        ),
        "path_nodes": sql(
            "clean",
            """SELECT longitude, latitude, round(arg_max(elevation, left(md5(run_id || ':' || "index"), 15)), 6)
                          AS elevation
               FROM clean GROUP BY longitude, latitude""",
        ),
        "graph_summary": sql(
            "aseg",
            f"""SELECT ski_area_id, run_count, round(latitude + {OFF_TIES}, 6) AS latitude,
                       round(longitude + {OFF_TIES}, 6) AS longitude, hemisphere,
                       round(combined_vertical, 4) AS combined_vertical,
                       {_STAT_COLUMNS}
                FROM (SELECT * REPLACE ({_only_with_edges()}) FROM (
                    SELECT *, CASE WHEN e > 0 THEN coalesce(c, 0) END AS combined_vertical,
                           {stats_sql("x", "y", "c", "s")} FROM (
                    SELECT *, CASE WHEN latitude > 0 THEN 1 WHEN latitude IS NOT NULL THEN -1 END
                                  AS s,
                           CASE WHEN latitude > 0 THEN 'north' WHEN latitude IS NOT NULL
                                THEN 'south' END AS hemisphere
                    FROM (SELECT ski_area_id, count(DISTINCT run_id) AS run_count FROM aseg
                          GROUP BY ALL)
                    LEFT JOIN (SELECT ski_area_id, avg(latitude) AS latitude,
                                      avg(longitude) AS longitude
                               FROM (SELECT DISTINCT ski_area_id, latitude, longitude FROM aseg
                                     WHERE latitude IS NOT NULL) GROUP BY ALL) USING (ski_area_id)
                    LEFT JOIN (SELECT ski_area_id, sum(distance_vertical_drop) AS c,
                                      sum(distance_vertical_drop * cos(radians(bearing))) AS x,
                                      sum(distance_vertical_drop * sin(radians(bearing))) AS y
                               FROM aseg WHERE distance_horizontal > 0 GROUP BY ALL)
                         USING (ski_area_id)
                    LEFT JOIN (SELECT ski_area_id, count(la) AS e FROM aseg GROUP BY ALL)
                         USING (ski_area_id))))""",
        ),
        "validate_bins": sql(
            "labelled",
            """SELECT ski_area_id, CAST(num_bins AS INTEGER) AS num_bins,
                      CAST(bin_index AS INTEGER) AS bin_index, count(*) AS "count"
               FROM labelled GROUP BY ALL HAVING count(*) > 1""",
        ),
        "duplicate_keys": sql(
            "bridge line",
            """SELECT ski_area_id, count(*) AS "count" FROM bridge SEMI JOIN line USING (run_no)
               GROUP BY ski_area_id HAVING count(*) > 1""",
        ),
        "validate_metrics": _validation(),
    }
    return queries


def _validation() -> str:
    outside = {
        f"{c} is in range": f"{c} < 0"
        for c in (
            "run_count",
            "lift_count",
            "coordinate_count",
            "segment_count",
            "combined_vertical",
            "combined_distance",
            "vertical_drop",
        )
    }
    outside |= {
        "latitude is in range": "abs(latitude) > 90",
        "longitude is in range": "abs(longitude) > 180",
        "bearing_mean is in range": "bearing_mean < 0 OR bearing_mean >= 360",
        "bearing_alignment is in range": "bearing_alignment < 0 OR bearing_alignment > 1",
        "poleward_affinity is in range": "abs(poleward_affinity) > 1",
        "eastward_affinity is in range": "abs(eastward_affinity) > 1",
    }
    required = {
        f"{c} is required": f"{c} IS NULL"
        for c in (
            "ski_area_id",
            "osm_is_generated",
            "osm_run_convention",
            "run_count",
            "lift_count",
            "coordinate_count",
            "segment_count",
        )
    }
    allowed = {
        "osm_run_convention is an allowed value": "osm_run_convention NOT IN "
        "('japan', 'europe', 'north_america')",
        "osm_status is an allowed value": "osm_status NOT IN "
        "('operating', 'abandoned', 'proposed', 'disused')",
        "hemisphere is an allowed value": "hemisphere NOT IN ('north', 'south')",
    }
    rows = [
        f"SELECT '{rule}' AS rule, count(*) FILTER ({bad}) AS violations FROM area"
        for rule, bad in (required | outside | allowed).items()
    ]
    rows.append(
        "SELECT 'bearings are in range', count(DISTINCT ski_area_id) FILTER (bin_index < 1 "
        "OR bin_center < 0 OR bin_center >= 360 OR bin_count < 0 OR bin_proportion < 0 "
        "OR bin_proportion > 1) FROM labelled"
    )
    rows.append(
        "SELECT 'ski_area_id is unique', CAST(coalesce(sum(n), 0) AS BIGINT) FROM "
        "(SELECT count(*) AS n FROM area GROUP BY ski_area_id HAVING count(*) > 1)"
    )
    return sql("area labelled", " UNION ALL ".join(rows))
