from types import SimpleNamespace

import pytest

from conftest import SMALL
from fallline.operators import rollups as R
from fallline.plans import registry
from fallline.session import materialize, shared_folder


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_branches_of_a_stage_read_their_own_columns(spark):
    areas = materialize(registry.metrics(spark, SMALL))
    scalar = areas.groupBy("country").agg({"combined_vertical": "sum"})
    plan = scalar._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<country:string,combined_vertical:double>" in plan
    assert R.rollup_by_country(areas).count() > 0
