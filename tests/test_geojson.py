"""GeoJSON by byte ranges of any size beside a parse of the whole."""

import json
import random

import pytest

from furrow.sources import files, geojson

TRICKY = ['plain', 'quote " in', "back\\slash", "\\\\", '\\"', "{[}]", '"features": [{', "é 日本 😀", "tab\tnew\nline", "", "\\" * 9, '{"type": "Feature"}']


def collection(n, seed=1, **more):
    draw = random.Random(seed)
    features = []
    for k in range(n):
        properties = {f"p{j}": draw.choice(TRICKY) for j in range(draw.randint(0, 4))} | {"n": k} | ({"nested": {"list": [{"type": "Feature"}, [1, {"a": []}]]}} if k % 5 == 0 else {})
        geometry = draw.choice([{"type": "Point", "coordinates": [k, 1.5]}, {"type": "LineString", "coordinates": [[k, 1], [2, 3]]}, None])
        features.append({"type": "Feature", "properties": properties, "geometry": geometry})
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x", "deep": {"y": [{"type": "Feature"}]}}}, **more, "features": features, "after": {"z": 1}}


def texts(spark, path, size):
    return sorted(json.dumps(json.loads(r.feature), sort_keys=True) for r in geojson.feature_texts(spark, str(path), size).collect())


@pytest.mark.parametrize(("size", "indent"), [(1, None), (7, None), (64, 2), (1000, None), (1 << 20, 2)])
def test_features_at_any_range(spark, tmp_path, size, indent):
    data = collection(12 if size < 10 else 40)
    raw = json.dumps(data, indent=indent, ensure_ascii=indent is None)
    if size < 10:  # ranges begin within every run of backslashes and every character
        raw = raw[: raw.index('"features"')] + json.dumps({"features": data["features"][:3]}, ensure_ascii=False)[1:]
    (tmp_path / "c.geojson").write_text(raw, encoding="utf-8")
    expected = sorted(json.dumps(f, sort_keys=True) for f in json.loads(raw)["features"])
    assert texts(spark, tmp_path / "c.geojson", size) == expected


def test_roots(spark, tmp_path):
    one = {"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": '{"type": "Feature"'}, "type": "Feature"}
    for name, root, n in (("one", one, 1), ("list", [one, one], 2), ("geometry", one["geometry"], 0), ("none", {"type": "FeatureCollection", "features": []}, 0), ("number", 5, 0), ("empty", {}, 0)):
        (tmp_path / f"{name}.json").write_text(" \n" + json.dumps(root))
        assert files.read_geojson(spark, str(tmp_path / f"{name}.json")).count() == n, name
    (tmp_path / "void.json").write_text("")
    assert files.read_geojson(spark, str(tmp_path / "void.json")).count() == 0
    assert files.read_geojson(spark, str(tmp_path / "*.json"), 16).count() == 3


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.geojson"
    feature = json.dumps({"type": "Feature", "properties": {"t": 'x"\\' * 300}, "geometry": {"type": "Point", "coordinates": [1, 2]}})
    with path.open("w") as f:
        f.write('{"type": "FeatureCollection", "features": [')
        for k in range(200):
            f.write(",\n".join([feature] * 100) + (",\n" if k < 199 else "]}"))
    found = files.read_geojson(spark, str(path), 2 << 20)
    assert found.count() == 20_000 and found.rdd.getNumPartitions() == -(-path.stat().st_size // (2 << 20)) > 9
    assert found.select("props.t").distinct().count() == 1


def test_small_ranges_share_tasks(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"{k}.json").write_text(json.dumps(collection(20, k)))
    found = geojson.feature_texts(spark, str(tmp_path), 256)
    ranges = sum(-(-p.stat().st_size // 256) for p in tmp_path.iterdir())
    assert ranges > 300 and found.rdd.getNumPartitions() == 64
    assert found.count() == 600
