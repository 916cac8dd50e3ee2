"""Runs, lifts and ski areas derived from the star-schema test tables.

The tables have no paths, so a rule turns every event into a point. 24 consecutive events make four
runs of 1, 2, 5 and 16 points, which bounds the points per run without any window. The first
event's user is the run's home area, so a user with a third of the events becomes an area with a
third of the runs. Some runs lead uphill, some have impossible elevations, some are polygons, and
some have no area or two, so that the loaders have something to do.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The columns in use; with a given schema no job has to look into the files first.
COLUMNS = {
    "events": "event_id bigint, user_id bigint, value double",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


_AREA_REFS = "array<struct<properties:struct<id:string>>>"


def _area_ref(number: str) -> str:
    return f"named_struct('properties', named_struct('id', concat('a', {number})))"


def run_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run features, in the shape of the source files."""
    points = table(spark, sf_dir, "events").selectExpr(
        "event_id div 24 * 4 + CASE WHEN event_id % 24 >= 8 THEN 3 WHEN event_id % 24 >= 3 THEN 2 "
        "WHEN event_id % 24 >= 1 THEN 1 ELSE 0 END AS no",
        "cast(event_id % 24 - CASE WHEN event_id % 24 >= 8 THEN 8 WHEN event_id % 24 >= 3 THEN 3 "
        "WHEN event_id % 24 >= 1 THEN 1 ELSE 0 END AS int) AS idx",
        "event_id",
        "user_id",
        "value",
    )
    # 16 points at most per list
    runs = (
        points.groupBy("no")
        .agg(F.collect_list(F.struct("idx", "event_id", "user_id", "value")).alias("pts"))
        .withColumn("pts", F.sort_array("pts"))
        .withColumn("home", F.expr("pts[0].user_id"))
    )
    noise = "(p.event_id % 7) * 1e-9D"
    longitude = f"(home * 53) % 340 - 170 + (p.event_id * 6151) % 20011 / 1e6D + {noise}"
    latitude = f"(home * 37) % 121 - 60 + (p.event_id * 7919) % 20011 / 1e6D + {noise}"
    elevation = """if(p.event_id % 97 = 11 OR no % 61 = 5, -9999D,
        if(no % 9 = 4, 900 + p.idx * 60, 1800 - p.idx * 60)
        + p.value * 2 + (p.event_id % 4) * 1e-3D)"""
    return runs.selectExpr(
        "'Feature' AS type",
        f"""named_struct(
            'id', concat('r', no),
            'name', if(no % 11 <> 0, concat('Run ', no), NULL),
            'uses', CASE no % 5 WHEN 0 THEN array('nordic') WHEN 1 THEN array('skitour', 'downhill')
                    ELSE array('downhill') END,
            'status', element_at(array('operating', 'abandoned', 'proposed', 'disused'),
                                 cast(no % 4 + 1 AS int)),
            'difficulty', element_at(array('novice', 'easy', 'intermediate', 'advanced', 'expert',
                                           'extreme', 'freeride', 'other'), cast(no % 8 + 1 AS int)),
            'convention', element_at(array('japan', 'europe', 'north_america'),
                                     cast(home % 3 + 1 AS int)),
            'skiAreas', CASE WHEN home % 10 = 9 THEN cast(array() AS {_AREA_REFS})
                        WHEN no % 7 = 0 THEN array({_area_ref("home + 10")}, {_area_ref("home")})
                        ELSE array({_area_ref("home")}) END,
            'sources', array_compact(array(
                if(no % 3 = 0, named_struct('type', 'skimap.org', 'id', cast(no AS string)), NULL),
                named_struct('type', 'openstreetmap', 'id', concat('way/', no))))
        ) AS properties""",
        f"""named_struct(
            'type', if(no % 29 = 7, 'Polygon', 'LineString'),
            'coordinates', transform(pts, p -> array({longitude}, {latitude}, {elevation}))
        ) AS geometry""",
    )


def lift_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lifts: fifteen to an area, and every fourth one somewhere else."""
    near = "if(c_custkey % 4 = 0, c_custkey div 60, c_custkey div 15)"
    return table(spark, sf_dir, "customer").selectExpr(
        "'Feature' AS type",
        f"""named_struct(
            'id', concat('l', c_custkey),
            'name', c_name,
            'liftType', lower(c_mktsegment),
            'status', if(c_mktsegment = 'MACHINERY', 'abandoned', 'operating'),
            'skiAreas', CASE WHEN c_custkey % 11 = 0 THEN cast(array() AS {_AREA_REFS})
                        WHEN c_custkey % 6 = 1
                        THEN array({_area_ref(near)}, {_area_ref(near + " + 1")})
                        ELSE array({_area_ref(near)}) END,
            'sources', array(named_struct('type', 'openstreetmap', 'id', concat('way/', c_custkey)))
        ) AS properties""",
        """named_struct('type', if(c_custkey % 8 = 3, 'Polygon', 'LineString'),
                        'coordinates', '[]') AS geometry""",
    )


def area_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as ski areas in their nation and region."""
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    code = "concat(char(65 + n_nationkey % 26), char(65 + (n_nationkey * 7) % 26))"
    return places.selectExpr(
        "'Feature' AS type",
        f"""named_struct(
            'id', concat('a', s_suppkey),
            'name', if(s_suppkey % 13 <> 0, s_name, NULL),
            'type', if(s_suppkey % 37 = 36, 'spot', 'skiArea'),
            'status', CASE WHEN s_suppkey % 5 < 3 THEN 'operating'
                      WHEN s_suppkey % 5 = 3 THEN 'abandoned' END,
            'generated', s_suppkey % 6 = 0,
            'runConvention', element_at(array('japan', 'europe', 'north_america'),
                                        cast(s_suppkey % 3 + 1 AS int)),
            'activities', if(s_suppkey % 17 = 16, array('nordic'), array('downhill', 'nordic')),
            'websites', array(concat('https://example.org/', s_suppkey)),
            'sources', array(
                named_struct('type', 'openstreetmap', 'id', concat('relation/', s_suppkey)),
                named_struct('type', 'skimap.org', 'id', cast(s_suppkey AS string))),
            'location', named_struct(
                'iso3166_1Alpha2', if(s_suppkey % 19 <> 18, {code}, NULL),
                'iso3166_2', if(s_suppkey % 19 <> 18, concat({code}, '-', r_regionkey), NULL),
                'localized', named_struct('en', named_struct(
                    'country', if(s_suppkey % 19 <> 18, n_name, NULL),
                    'region', if(s_suppkey % 19 <> 18, r_name, NULL),
                    'locality', if(s_suppkey % 3 = 0, concat('Town ', s_suppkey % 50), NULL))))
        ) AS properties""",
        "named_struct('type', 'Point', 'coordinates', '[0,0]') AS geometry",
    )


def flat_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one long path of points, ordered by event number.

    Users are as uneven as the events are, and the numbers have gaps; this is the input for the
    flat form of the segments.
    """
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS path_id",
        "event_id AS index",
        "(user_id * 37) % 121 - 60 + (event_id * 7919) % 20011 / 1e6D AS latitude",
        "(user_id * 53) % 340 - 170 + (event_id * 6151) % 20011 / 1e6D AS longitude",
        "500 + value * 3 AS elevation",
    )
