import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fallline.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("fallline-tests", cores="4")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def run_row():
    """A cleaned run from ``(longitude, latitude, elevation)`` points."""

    def make(run_id, points, areas=("a1",), uses=("downhill",)):
        coordinates = [
            {"index": i, "latitude": lat, "longitude": lon, "elevation": ele}
            for i, (lon, lat, ele) in enumerate(points)
        ]
        return (run_id, list(uses), list(areas), coordinates)

    return make


RUN_SCHEMA = (
    "run_id string, run_uses array<string>, ski_area_ids array<string>, run_coordinates_clean "
    "array<struct<index:int,latitude:double,longitude:double,elevation:double>>"
)


@pytest.fixture
def make_runs(spark):
    return lambda rows: spark.createDataFrame(rows, RUN_SCHEMA)
