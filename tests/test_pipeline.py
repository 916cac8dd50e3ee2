from conftest import SMALL
from fallline.plans import pipeline, registry, tracks
from fallline.sources.tables import write_feature_lines

SOURCES = {
    "runs": tracks.run_features,
    "lifts": tracks.lift_features,
    "ski_areas": tracks.area_features,
}


def test_files_to_published_tables(spark, tmp_path):
    sources = {}
    for kind, make in SOURCES.items():
        sources[kind] = str(tmp_path / f"{kind}.geojson")
        write_feature_lines(make(spark, SMALL), sources[kind])
    layout = pipeline.Layout(str(tmp_path / "out"))
    areas = pipeline.analyze(spark, sources, layout)
    want = registry.metrics(spark, SMALL)
    columns = ["ski_area_id", "run_count", "lift_count", "segment_count", "country", "hemisphere"]
    assert areas.select(columns).exceptAll(want.select(columns)).isEmpty()
    assert areas.count() == want.count() > 5
    assert pipeline.validate(spark, layout).count() == areas.count()

    again = pipeline.analyze(spark, sources, layout, skip_runs=True)
    assert again.count() == want.count()

    rollups = pipeline.export_rollups(spark, layout, country="NATION_12")
    assert set(rollups) == {"hemisphere", "hemisphere_status", "country", "region"}
    assert rollups["country"].count() > 1
    assert rollups["hemisphere_status"].filter("hemisphere_status LIKE '% in North Hem.'").count() > 0
    assert pipeline.export_frontend(spark, layout).count() > 0

    assert spark.read.parquet(layout.broken).isEmpty()
    changes = pipeline.changed_areas(spark, layout)
    assert changes.filter("change = 'new'").count() == changes.count() == want.count()
    pipeline.remember_areas(spark, layout)
    assert pipeline.changed_areas(spark, layout).isEmpty()
