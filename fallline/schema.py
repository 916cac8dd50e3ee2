"""Schemas, fixed values and defaults shared by the whole library."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They decide results, so they are stated here and nowhere else.
# ---------------------------------------------------------------------------

#: Mean Earth radius in metres used by the great-circle distance.
EARTH_RADIUS_M = 6_371_009

#: Points lower than this are treated as recording errors.
MIN_ELEVATION_M = -100.0

#: The 32 winds, clockwise from north, 11.25 degrees apart.
COMPASS_WINDS = [
    "N", "NbE", "NNE", "NEbN", "NE", "NEbE", "ENE", "EbN",
    "E", "EbS", "ESE", "SEbE", "SE", "SEbS", "SSE", "SbE",
    "S", "SbW", "SSW", "SWbS", "SW", "SWbW", "WSW", "WbS",
    "W", "WbN", "WNW", "NWbW", "NW", "NWbN", "NNW", "NbW",
]

#: Compass resolutions stored for every area and group.
COMPASS_RESOLUTIONS = (2, 4, 8, 16, 32)

#: Below this, a summed magnitude counts as zero.
MAGNITUDE_EPSILON = 1e-10

RUN_CONVENTIONS = ("japan", "europe", "north_america")
AREA_STATUSES = ("operating", "abandoned", "proposed", "disused")
HEMISPHERES = ("north", "south")

#: Area columns that are filled when an area has no lifts or runs. Everything else stays NULL.
AREA_DEFAULTS = {
    "run_count": 0,
    "lift_count": 0,
    "coordinate_count": 0,
    "segment_count": 0,
    "combined_vertical": 0.0,
    "combined_distance": 0.0,
    "vertical_drop": 0.0,
}

#: Area measures whose inequality is studied.
INEQUALITY_METRICS = (
    "lift_count",
    "run_count",
    "coordinate_count",
    "segment_count",
    "combined_vertical",
    "combined_distance",
    "vertical_drop",
)

BEARING_STATS = (
    "bearing_mean",
    "bearing_alignment",
    "bearing_magnitude_net",
    "bearing_magnitude_cum",
    "poleward_affinity",
    "eastward_affinity",
)

# ---------------------------------------------------------------------------
# Source schemas
# ---------------------------------------------------------------------------

#: Source ids are numbers or strings in the files; the JSON reader turns both into strings.
SOURCE = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("id", T.StringType())]
)

AREA_REF = T.StructType(
    [
        T.StructField(
            "properties", T.StructType([T.StructField("id", T.StringType())])
        )
    ]
)

#: Coordinates stay raw JSON text, so every geometry type survives the read; the run loader parses
#: the lines it keeps.
GEOMETRY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ]
)

LINE_COORDINATES = T.ArrayType(T.ArrayType(T.DoubleType()))


def _feature(properties: list[T.StructField]) -> T.StructType:
    return T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("properties", T.StructType(properties)),
            T.StructField("geometry", GEOMETRY),
        ]
    )


RUN_FEATURE = _feature(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("uses", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("convention", T.StringType()),
        T.StructField("skiAreas", T.ArrayType(AREA_REF)),
        T.StructField("sources", T.ArrayType(SOURCE)),
    ]
)

LIFT_FEATURE = _feature(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("liftType", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("skiAreas", T.ArrayType(AREA_REF)),
        T.StructField("sources", T.ArrayType(SOURCE)),
    ]
)

AREA_FEATURE = _feature(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("generated", T.BooleanType()),
        T.StructField("runConvention", T.StringType()),
        T.StructField("activities", T.ArrayType(T.StringType())),
        T.StructField("websites", T.ArrayType(T.StringType())),
        T.StructField("sources", T.ArrayType(SOURCE)),
        T.StructField(
            "location",
            T.StructType(
                [
                    T.StructField("iso3166_1Alpha2", T.StringType()),
                    T.StructField("iso3166_2", T.StringType()),
                    T.StructField(
                        "localized",
                        T.StructType(
                            [
                                T.StructField(
                                    "en",
                                    T.StructType(
                                        [
                                            T.StructField("country", T.StringType()),
                                            T.StructField("region", T.StringType()),
                                            T.StructField("locality", T.StringType()),
                                        ]
                                    ),
                                )
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)

FEATURES = {"runs": RUN_FEATURE, "lifts": LIFT_FEATURE, "ski_areas": AREA_FEATURE}

MANIFEST = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("last_modified", T.StringType()),
        T.StructField("downloaded", T.StringType()),
        T.StructField("content_size_mb", T.DoubleType()),
        T.StructField("compressed_size_mb", T.DoubleType()),
        T.StructField("checksum_sha256", T.StringType()),
    ]
)

# ---------------------------------------------------------------------------
# Stored tables
# ---------------------------------------------------------------------------

COORDINATE = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("elevation", T.DoubleType()),
    ]
)

COORDINATE_FIELDS = tuple(COORDINATE.fieldNames())

SEGMENT_FIELDS = (
    "distance_vertical",
    "segment_hash",
    "distance_vertical_drop",
    "distance_horizontal",
    "distance_3d",
    "bearing",
    "gradient",
    "slope",
)

BEARING_BIN = T.StructType(
    [
        T.StructField("num_bins", T.IntegerType()),
        T.StructField("bin_index", T.IntegerType()),
        T.StructField("bin_center", T.DoubleType()),
        T.StructField("bin_count", T.DoubleType()),
        T.StructField("bin_proportion", T.DoubleType()),
        T.StructField("bin_label", T.StringType()),
    ]
)

_S, _I, _L, _D, _B = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
)

#: The area metrics table, one row per ``ski_area_id``.
AREA_METRICS = T.StructType(
    [T.StructField(n, _S) for n in ("ski_area_id", "ski_area_name")]
    + [T.StructField("osm_is_generated", _B)]
    + [
        T.StructField(n, _S)
        for n in (
            "osm_run_convention",
            "osm_status",
            "country",
            "region",
            "locality",
            "country_code",
            "country_subdiv_code",
        )
    ]
    + [
        T.StructField(n, T.ArrayType(_S))
        for n in ("ski_area_websites", "ski_area_sources")
    ]
    + [
        T.StructField(n, _L)
        for n in ("run_count", "lift_count", "coordinate_count", "segment_count")
    ]
    + [
        T.StructField(n, _D)
        for n in (
            "combined_vertical",
            "combined_distance",
            "vertical_drop",
            "latitude",
            "longitude",
        )
    ]
    + [T.StructField("hemisphere", _S)]
    + [T.StructField(n, _D) for n in ("min_elevation", "max_elevation", *BEARING_STATS)]
    + [T.StructField("bearings", T.ArrayType(BEARING_BIN))]
)
