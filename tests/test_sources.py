import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SMALL
from fallline.plans import registry, tracks
from fallline.sources import features as G
from fallline.sources import manifest as M
from fallline.sources import tables as P
from fallline.sources.documents import cut_features


def run_feature(run_id, coordinates, areas=("a1",), kind="LineString", source=("skimap.org", 17)):
    return {
        "type": "Feature",
        "properties": {
            "id": run_id,
            "name": None,
            "uses": ["downhill"],
            "status": "operating",
            "difficulty": "easy",
            "convention": "europe",
            "skiAreas": [{"type": "Feature", "properties": {"id": a}} for a in areas],
            "sources": [{"type": source[0], "id": source[1]}, {"type": "openstreetmap", "id": "way/3"}],
        },
        "geometry": {"type": kind, "coordinates": coordinates},
    }


FEATURES = [
    run_feature("r1", [[7.1, 46.5, 900.0], [7.2, 46.6, 1500.25]], areas=("b", "a")),
    run_feature("r2", [[[7.1, 46.5, 900], [7.2, 46.6, 1500]]], kind="Polygon"),
    run_feature("r3", [[7.1, 46.5, -5000]], areas=(), source=("skimap.org", "x9")),
]


@pytest.fixture
def layouts(tmp_path):
    collection = {"type": "FeatureCollection", "features": FEATURES}
    (tmp_path / "doc.geojson").write_text(json.dumps(collection, indent=2))
    lines = [json.dumps(f) for f in FEATURES]
    (tmp_path / "lines.ndjson").write_text("\n".join(lines) + "\n")
    header = '{"type": "FeatureCollection", "features": ['
    (tmp_path / "per_line.geojson").write_text("\n".join([header, ",\n".join(lines), "]}"]) + "\n")
    with gzip.open(tmp_path / "lines.ndjson.gz", "wt") as f:
        f.write("\n".join(lines))
    return tmp_path


def test_all_layouts_read_alike(spark, layouts):
    def load(df):
        return [r.asDict(True) for r in G.load_runs(df).orderBy("run_id").collect()]

    want = load(G.read_feature_collection(spark, str(layouts / "doc.geojson"), "runs"))
    for name in ("lines.ndjson", "per_line.geojson", "lines.ndjson.gz"):
        assert load(G.read_feature_lines(spark, str(layouts / name), "runs")) == want
    first, third = want
    assert first["ski_area_ids"] == ["a", "b"]
    assert first["run_sources"] == [
        "https://skimap.org/skiareas/view/17",
        "https://www.openstreetmap.org/way/3",
    ]
    assert [c["elevation"] for c in first["run_coordinates_raw"]] == [900.0, 1500.25]
    assert [c["elevation"] for c in first["run_coordinates_clean"]] == [1500.25, 900.0]
    assert third["run_coordinates_clean"] == []


def test_geometry_profile(spark, layouts):
    features = G.read_feature_lines(spark, str(layouts / "lines.ndjson"), "runs")
    assert {tuple(r) for r in G.geometry_profile(features).collect()} == {("LineString", 2), ("Polygon", 1)}


@pytest.mark.parametrize("line", ['{"type": "Feature", "prop', '{"type": "Point"}', "rubbish"])
def test_broken_lines_fail(spark, tmp_path, line):
    (tmp_path / "x.ndjson").write_text(json.dumps(FEATURES[0]) + "\n" + line + "\n")
    with pytest.raises(PySparkException, match="not a feature"):
        G.read_feature_lines(spark, str(tmp_path / "x.ndjson"), "runs").collect()


@pytest.mark.parametrize("line", ["{}", '{"type": "Feature", "prop', "[]"])
def test_no_line_is_skipped_or_counted_unread(spark, tmp_path, line):
    (tmp_path / "x.ndjson").write_text(json.dumps(FEATURES[0]) + "\n" + line + "\n")
    features = G.read_feature_lines(spark, str(tmp_path / "x.ndjson"), "runs")
    for read in (features.count, features.collect):
        with pytest.raises(PySparkException, match="not a feature"):
            read()


@pytest.mark.parametrize("name", ["lines.ndjson", "per_line.geojson", "doc.geojson"])
def test_joins_and_explodes_over_all_layouts(spark, layouts, name):
    read = G.read_feature_collection if name == "doc.geojson" else G.read_feature_lines
    features = read(spark, str(layouts / name), "runs")
    ids = spark.createDataFrame([("a",), ("zz",)], "ski_area_id string")
    assert [r.id for r in P.subset_by_ids(features, ids, "runs").select("properties.id").collect()] == ["r1"]
    areas = features.select(F.explode("properties.skiAreas.properties.id").alias("i")).filter("i IS NOT NULL")
    assert sorted(r.i for r in areas.collect()) == ["a", "a1", "b"]
    assert features.filter("properties.id IS NOT NULL").count() == 3


def test_other_documents_fail(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"type": "Topology", "features": []}))
    with pytest.raises(PySparkException, match="not a FeatureCollection"):
        G.read_feature_collection(spark, str(tmp_path / "x.json"), "runs").collect()


def test_written_features_read_back(spark, tmp_path):
    for kind, make in (("runs", tracks.run_features), ("ski_areas", tracks.area_features)):
        features = make(spark, SMALL)
        P.write_feature_lines(features, str(tmp_path / kind))
        back = G.read_feature_lines(spark, str(tmp_path / kind), kind)
        assert back.select("properties").exceptAll(features.select("properties")).isEmpty()
        again = str(tmp_path / f"{kind}2")
        P.write_feature_lines(back, again)
        assert G.read_feature_lines(spark, again, kind).exceptAll(back).isEmpty()
        assert back.count() == features.count()


def test_subsets_keep_a_feature_once(spark):
    features = registry.run_features(spark, SMALL).withColumn("geometry", F.col("geometry"))
    ids = ["a1", "a11", "a2"]
    by_list = P.subset_by_id_list(features, ids, "runs").select("properties.id")
    frame = spark.createDataFrame([(i,) for i in ids], "ski_area_id string")
    by_frame = P.subset_by_ids(features, frame, "runs").select("properties.id")
    got = sorted(r.id for r in by_list.collect())
    assert got == sorted(r.id for r in by_frame.collect())
    assert len(got) == len(set(got)) > 0
    areas = tracks.area_features(spark, SMALL)
    assert P.subset_by_ids(areas, frame, "ski_areas").count() == 2
    assert P.subset_by_id_list(areas, ids, "ski_areas").count() == 2


def test_manifest_of_plain_and_compressed_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    content = ("é,1\n" * 5000).encode()
    (folder / "plain.csv").write_bytes(content)
    (folder / "packed.csv.gz").write_bytes(gzip.compress(content))
    rows = {r.relative_path.rsplit("/", 1)[1]: r for r in M.file_manifest(spark, str(folder), root=str(tmp_path), url_root="https://example.org/d", downloaded="2024").collect()}
    for name in ("plain.csv", "packed.csv.gz"):
        raw = (folder / name).read_bytes()
        assert rows[name].checksum_sha256 == hashlib.sha256(raw).hexdigest()
        assert rows[name].compressed_size_mb == len(raw) / 1024**2
        assert rows[name].content_size_mb == len(content) / 1024**2
        assert rows[name].relative_path == f"files/{name}"
        assert rows[name].url == f"https://example.org/d/files/{name}" and rows[name].downloaded == "2024"


def test_manifest_layouts(spark, tmp_path):
    record = {
        "url": "https://example.org/runs.geojson",
        "relative_path": "runs.geojson",
        "last_modified": "2024-11-24T00:00:00+00:00",
        "downloaded": "2024-11-24T01:00:00+00:00",
        "content_size_mb": 2.5,
        "compressed_size_mb": 1,
        "checksum_sha256": "00",
    }
    (tmp_path / "info.json").write_text(json.dumps([record, record], indent=2))
    (tmp_path / "info.ndjson").write_text(json.dumps(record) + "\n" + json.dumps(record))
    document = M.read_manifest(spark, str(tmp_path / "info.json")).collect()
    lines = M.read_manifest(spark, str(tmp_path / "info.ndjson"), one_per_line=True).collect()
    assert document == lines and len(lines) == 2
    assert lines[0].compressed_size_mb == 1.0


def test_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "areas")
    P.export_table(registry.metrics(spark, SMALL), path)
    scan = P.filtered_scan(
        spark, path, [F.col("osm_status") == "operating", F.col("run_count") >= 3]
    ).select("ski_area_id")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(osm_status,operating)" in plan
    assert "GreaterThanOrEqual(run_count,3)" in plan
    assert "ReadSchema: struct<ski_area_id:string,osm_status:string,run_count:bigint>" in plan
    assert P.filtered_scan(spark, path).count() == registry.metrics(spark, SMALL).count()


def awkward_document(n, indent, ascii_only):
    """A collection with structural characters within strings and objects beside its features."""
    names = ['{"', "}]", "\\", '\\"{', "é\n,", ""]
    features = [
        {
            "type": "Feature",
            "properties": {"id": f"{n}-{k}", "name": names[k % 6] * (k % 5), "more": [{"a": [k, {}]}]},
            "geometry": {"type": "Point", "coordinates": [k, 1.5]},
        }
        for k in range(n)
    ]
    around = {"crs": {"type": "name", "of": [{"q": "}"}]}, "bbox": [1, 2]}
    document = {"type": "FeatureCollection", **around, "features": features, "end": {"z": [{}]}}
    return features, json.dumps(document, indent=indent, ensure_ascii=ascii_only)


@pytest.mark.parametrize("size", ["400", "5000", "128m"])
def test_documents_are_cut_anywhere(spark, tmp_path, size):
    want = []
    for n, indent, ascii_only in ((0, None, True), (1, 2, False), (11, None, False), (13, 1, True)):
        features, text = awkward_document(n, indent, ascii_only)
        (tmp_path / f"{n}.json").write_text(text)
        want += features
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = cut_features(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = [json.loads(r.line) for r in lines]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_half_a_document_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text(awkward_document(5, None, True)[1][:-20])
    with pytest.raises(ValueError, match="whole"):
        G.read_feature_collection(spark, str(tmp_path / "x.json"), "runs")


def test_a_line_is_parsed_once(spark, layouts):
    read = G.load_runs(G.read_feature_lines(spark, str(layouts / "lines.ndjson"), "runs"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(type") == 1 and plan.count("RLIKE") <= 1


def test_stored_features_keep_everything(spark, layouts):
    texts = G.read_feature_texts(spark, str(layouts / "lines.ndjson"), "runs")
    G.feature_variants(texts).write.parquet(str(layouts / "stored"))
    stored = G.typed_features(spark.read.parquet(str(layouts / "stored")), "runs")
    want = [r.asDict(True) for r in G.load_runs(texts).orderBy("run_id").collect()]
    assert [r.asDict(True) for r in G.load_runs(stored).orderBy("run_id").collect()] == want
    whole = [json.loads(r.t) for r in stored.selectExpr("to_json(feature) AS t").collect()]
    # by value: 900.0 is stored as the number 900
    assert sorted(whole, key=lambda f: f["properties"]["id"]) == FEATURES


def one_document(folder):
    parts = sorted(folder.glob("part-*"), key=lambda p: int(p.name.split("-")[1]))
    return json.loads("".join(p.read_text() for p in parts)), len(parts)


def test_parts_are_one_document(spark, tmp_path):
    features = registry.run_features(spark, SMALL).repartition(5)
    P.write_feature_collection(features, str(tmp_path / "runs"))
    document, parts = one_document(tmp_path / "runs")
    ids = sorted(f["properties"]["id"] for f in document["features"])
    assert document["type"] == "FeatureCollection" and parts > 3 and len(ids) == features.count()
    for back in (
        G.read_feature_lines(spark, str(tmp_path / "runs"), "runs"),
        G.read_feature_collection(spark, str(tmp_path / "runs"), "runs", parts=True),
    ):
        assert sorted(r.id for r in back.select("properties.id").collect()) == ids


@pytest.mark.parametrize("size", ["97", "1000", "128m"])
def test_parts_are_cut_anywhere(spark, tmp_path, size):
    lines = [json.dumps(f, ensure_ascii=False) for f in awkward_document(17, None, False)[0]]
    texts = spark.createDataFrame([(x,) for x in lines], "line string").repartition(3)
    P.write_feature_collection(texts, str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        back = cut_features(spark, str(tmp_path / "d"), parts=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.line for r in back) == sorted(lines)


@pytest.mark.parametrize("count", [0, 1])
def test_small_collections(spark, tmp_path, count):
    features = spark.createDataFrame([(json.dumps(f),) for f in FEATURES], "line string").limit(count)
    P.write_feature_collection(features, str(tmp_path / "few"))
    assert one_document(tmp_path / "few")[0]["features"] == FEATURES[:count]
    assert G.read_feature_lines(spark, str(tmp_path / "few"), "runs").count() == count
    assert G.read_feature_collection(spark, str(tmp_path / "few"), "runs", parts=True).count() == count


def test_one_area_reads_its_own_files(spark, tmp_path):
    runs = registry.runs(spark, SMALL)
    path = str(tmp_path / "area-runs")
    P.export_area_runs(runs, path)
    every = len(spark.read.parquet(path).inputFiles())
    chosen = P.scan_area_runs(spark, path, ["a1"])
    want = runs.filter(F.array_contains("ski_area_ids", "a1")).select("run_id")
    assert sorted(chosen.select("run_id").collect()) == sorted(want.collect()) != []
    scan = [n for n in _nodes(chosen._jdf.queryExecution().sparkPlan()) if n.nodeName().startswith("Scan parquet")]
    chosen.collect()
    read = len(set(r[0] for r in chosen.select("_metadata.file_path").collect()))
    selected = scan[0].selectedPartitions().totalNumberOfFiles()
    assert read <= selected < every / 4
    assert P.scan_area_runs(spark, path, ["none"]).isEmpty() and P.scan_area_runs(spark, path, []).isEmpty()


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))
