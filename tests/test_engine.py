"""Transforms, graph, pixels, resampling, shapes, files and alignment against values worked out by hand or by numpy."""

import io
import json
import math
import zipfile

import numpy as np
import pytest

from tessera.operators import pixels as px
from tessera.operators import register, resample, shapes
from tessera.plans import graph as g
from tessera.plans import transforms as tf
from tessera.sources import images, text


def frame(spark, a, image="i"):
    rows = [(image, c, y, x, float(a[c, y, x])) for c in range(a.shape[0]) for y in range(a.shape[1]) for x in range(a.shape[2])]
    return spark.createDataFrame(rows, "image_id string, channel int, y long, x long, v double")


def array(df, h, w, channel=0):
    out = np.zeros((h, w))
    for r in df.filter(f"channel = {channel}").collect() if "channel" in df.columns else df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def test_rotation_of_a_known_image():
    t = tf.rotation((26656, 24320), 0.5, -90)
    assert t.params == pytest.approx((-math.pi / 2, 584.0, -584.0)) and t.center == pytest.approx((6079.75, 6663.75)) and t.size == (24320, 26656)


def test_groups_and_order():
    e, a = tf.Transform("euler", (0.1, 1, 2), (5, 5), (9, 9)), tf.Transform("affine", (1, 0.2, 0, 1, 3, 4), (1, 1), (7, 7))
    s = tf.Sequence().add([e, a]).append(tf.Sequence().add([e, a, e, a], [0, 0, 1, 1]))
    assert s.groups == (0, 1, 2, 2, 3, 3) and s.order() == [0, 1, 3, 2, 5, 4]
    assert tf.Sequence().add([e]).append(tf.Sequence().add([a, e, a, e], [0, 0, 1, 2])).groups == (0, 1, 1, 2, 3)
    p = np.array([[3.0, 8.0]])
    m = s.composite()
    assert shapes.map_points(s, p) == pytest.approx(p @ m[:2, :2].T + m[:2, 2])
    assert shapes.inverse_points(s, shapes.map_points(s, p)) == pytest.approx(p)


def test_size_follows_spacing():
    s = tf.Sequence().add([tf.identity((512, 512), 4.0)])
    assert s.with_spacing((1.0, 1.0)).size == (2048, 2048) and s.with_spacing((4.0, 4.0)).size == (512, 512)
    assert tf.OutputRule((2048, 2048), 0.65, 0.325).grid() == ((4096, 4096), 0.325)


def test_matrix_forms():
    t = tf.Transform("similarity", (2.0, 0.5, 3.0, 4.0), (10.0, 20.0), spacing=(0.5, 0.5))
    m = t.matrix()
    assert (m @ [10, 20, 1])[:2] == pytest.approx([13, 24])
    assert t.matrix(pixels=True)[:2, 2] == pytest.approx(m[:2, 2] / 0.5)
    assert t.matrix(yx=True)[0, 2] == m[1, 2] and t.inverse() @ m == pytest.approx(np.eye(3))
    with pytest.raises(ValueError):
        tf.Transform("bspline", ()).matrix()


def test_crop_and_back():
    c = tf.crop((10, 20, 30, 40), 0.5)
    assert c.params == (5.0, 10.0) and tf.uncrop(c, (100, 100)).params == (-5.0, -10.0)
    assert tf.flip((10, 10), 2.0, "h").matrix() @ [0, 0, 1] == pytest.approx([18, 0, 1])


def test_read_sequence():
    entry = {"Transform": ["EulerTransform"], "TransformParameters": ["0.1", "2", "3"], "CenterOfRotationPoint": ["1", "1"], "Size": ["5", "6"], "Spacing": ["2", "2"]}
    s = tf.read_sequence(json.dumps({"initial": [entry, entry], "000-to-b": [entry, entry]}))
    assert s.groups == (0, 1, 2, 2) and s.size == (5, 6) and s.spacing == (2.0, 2.0)


def network():
    n = g.Graph()
    for name in "abcdef":
        n.add_image(name)
    n.add_path("a", "f", "b")
    n.add_path("b", "f", "c")
    n.add_path("c", "f")
    n.add_path("d", "f", "c")
    n.attach_image("a", "extra")
    n.attach_shapes("b", "regions")
    n.add_merge("all", ["a", "d", "f"])
    return n


def test_graph_paths(spark):
    n = network()
    assert n.find_path("a", "f") == ["a", "b", "c", "f"]
    assert [(e.source, e.target) for e in n.transform_paths()["d"]] == [("d", "c"), ("c", "f")]
    assert n.targets() == ["e", "f"] and n.outputs() == ["b", "c", "extra", "all", "e"]
    hops = {(r["modality"], r["hop"]): r["target"] for r in n.tables(spark)["hop"].collect()}
    assert hops["a", 2] == "f"
    found = {(r["start"], r["hop"]): r["target"] for r in g.resolve(n.tables(spark)["edge"].select("source", "target")).collect()}
    assert found["a", 2] == "f" and len([k for k in found if k[0] == "a"]) == 3


def test_graph_changes():
    n = network()
    for wrong in (lambda: n.add_image("a"), lambda: n.add_path("a", "zz"), lambda: n.attach_shapes("zz", "s"), lambda: n.add_merge("m", ["zz"])):
        with pytest.raises(ValueError):
            wrong()
    n.remove("b")
    assert sorted(n.paths) == ["c", "d"] and [e.source for e in n.edges] == ["c", "d"] and n.shapes == {}
    n.remove("f")
    assert n.paths == {} and n.edges == [] and n.merges == {}


def test_cycles_end():
    n = g.Graph()
    for name in "abc":
        n.add_image(name)
    n.add_path("a", "c", "b")
    n.add_path("b", "c", "a")
    assert n.find_path("a", "c") == ["a", "b", "c"] and n.find_path("c", "a") is None


def test_intensity(spark):
    a = np.random.default_rng(0).integers(0, 256, (3, 6, 8))
    df = frame(spark, a)
    grey = np.floor(0.2125 * a[0]) + np.floor(0.7154 * a[1]) + np.floor(0.0721 * a[2])
    assert (array(px.grayscale_image(df), 6, 8) == grey).all()
    assert (array(px.max_projection(df), 6, 8) == a.max(0)).all()
    scaled = np.floor((a[1] - a[1].min()) * 255.0 / (a[1].max() - a[1].min()))
    assert (array(px.rescale(df), 6, 8, 1) == scaled).all()
    assert array(px.rescale(frame(spark, np.full((1, 2, 2), 7))), 2, 2).max() == 0
    assert (array(px.select_channels(df, [2, 0]), 6, 8) == a[2]).all()
    assert (array(px.single_channel(df, 5), 6, 8) == a[0]).all()


def test_spatial(spark):
    a = np.random.default_rng(1).integers(0, 256, (1, 7, 9))
    df = frame(spark, a)
    assert (array(px.rotate90(df, 9), 9, 7) == np.rot90(a[0])).all()
    assert (array(px.flip(df, "h", 9, 7), 7, 9) == a[0][:, ::-1]).all()
    assert (array(px.flip(df, "v", 9, 7), 7, 9) == a[0][::-1]).all()
    assert (array(px.crop(df, 2, 1, 4, 5), 5, 4) == a[0][1:6, 2:6]).all()
    assert (array(px.shrink(df, 2), 3, 4) == a[0][::2, ::2][:3, :4]).all() and px.shrink(df, 2).count() == 12
    want = np.floor(a[0][:6, :8].reshape(3, 2, 4, 2).mean((1, 3)))
    assert (array(px.pyramid_level(df, 1, 9, 7), 3, 4) == want).all()
    assert px.pyramid_sizes(3397, 3993, 512) == [(3397, 3993), (1698, 1996), (849, 998)] and px.pyramid_sizes(2048, 2048, 512) == [(2048, 2048), (1024, 1024)]


def test_mask_box(spark):
    m = np.zeros((1, 40, 40))
    m[0, 10:20, 12:30] = 255
    r = px.mask_box(frame(spark, m), 5).first()
    assert (r["x"], r["y"], r["w"], r["h"]) == (7, 5, 28, 20)
    r = px.mask_box(frame(spark, m), 100).first()
    assert (r["x"], r["y"], r["w"], r["h"]) == (0, 0, 40, 40)
    assert px.mask_box(frame(spark, np.zeros((1, 3, 3)))).count() == 0


def test_tiles_equal_plane(spark):
    a = np.random.default_rng(2).integers(0, 256, (2, 50, 40)).astype(float)
    seq = tf.Sequence().add([tf.rotation((40, 50), 1.0, 20)])
    tiles = resample.to_tiles(frame(spark, a), 16)
    assert sorted((r["channel"], r["y"], r["x"], r["v"]) for r in resample.to_pixels(tiles).collect()) == sorted((c, y, x, a[c, y, x]) for c in range(2) for y in range(50) for x in range(40))
    for kind in ("nearest", "linear"):
        out = resample.to_pixels(resample.resample_tiles(tiles, (40, 50), seq, 1.0, 16, kind))
        for c in range(2):
            want = resample.resample_plane(a[c], seq, 1.0, kind)
            assert array(out, *want.shape, c) == pytest.approx(want)
    near = resample.nearest(frame(spark, a[:1]).select("y", "x", "v"), seq.size, seq.composite())
    assert array(near, *seq.size[::-1]) == pytest.approx(resample.resample_plane(a[0], seq, 1.0))


def features():
    return [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[7, 20], [140, 64], [35, 190], [7, 20]], [[30, 60], [40, 70], [35, 90], [30, 60]]]}, "properties": {"classification": {"name": "one"}}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [9, 0], [9, 9], [0, 0]]], [[[20, 20], [29, 20], [29, 29], [20, 20]]]]}, "properties": {}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [3, 4]}, "properties": None},
        {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[3, 4], [5, 6]]}},
        {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[3, 4], [5, 6]], [[7, 8], [9, 10]]]}},
    ]


def test_geojson_round_trip(spark, tmp_path):
    (tmp_path / "set.geojson").write_text(json.dumps(features()))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x.geojson", json.dumps({"type": "FeatureCollection", "features": features()[:1]}))
    (tmp_path / "packed.zip").write_bytes(raw.getvalue())
    v = text.read_geojson(spark, str(tmp_path))
    assert v.filter("set_name = 'packed'").count() == 8
    back = {r["feature_id"]: json.loads(r["feature"]) for r in shapes.to_geojson(v.filter("set_name = 'set'")).collect()}
    for k, f in enumerate(features()):
        assert back[k]["geometry"] == {"type": f["geometry"]["type"], "coordinates": json.loads(json.dumps(f["geometry"]["coordinates"]), parse_int=float)}
    assert back[0]["properties"]["classification"]["name"] == "one" and back[1]["properties"]["classification"]["name"] == "unnamed"


def test_shapes_follow_transforms(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(features()[:1]))
    v = text.read_geojson(spark, str(tmp_path))
    rng = np.random.default_rng(5)
    spline = tf.Transform("bspline", tuple(rng.uniform(-2, 2, 2 * 64)), size=(300, 300), grid_size=(8, 8), grid_spacing=(60.0, 60.0), grid_origin=(-90.0, -90.0))
    euler = tf.Transform("euler", (0.4, 5.0, -3.0), (100.0, 100.0), (300, 300), (2.0, 2.0))
    p = np.array([[r["x"], r["y"]] for r in v.orderBy("ring", "vertex").collect()])
    for seq in (tf.Sequence().add([euler]), tf.Sequence().add([spline, euler])):
        got = np.array([[r["x"], r["y"]] for r in shapes.transform(v, seq, source_res=0.5).orderBy("ring", "vertex").collect()])
        assert shapes.map_points(seq, got * 2.0) == pytest.approx(p * 0.5, abs=1e-4)
    assert shapes.scale(v, 2).agg({"x": "max"}).first()[0] == 280


def test_bspline_outside_is_identity():
    t = tf.Transform("bspline", (1.0,) * 32, grid_size=(4, 4), grid_spacing=(1.0, 1.0))
    assert shapes.displacement(t, np.array([[1.5, 1.5], [99.0, 99.0]])) == pytest.approx(np.array([[1.0, 1.0], [0.0, 0.0]]))


def test_raster(spark, tmp_path):
    triangles = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[x * k for x in p] for p in ([7, 20], [140, 64], [35, 190])]]}} for k in (1, 2)]
    (tmp_path / "t.json").write_text(json.dumps(triangles))
    v = text.read_geojson(spark, str(tmp_path))
    raster = shapes.rasterise(v, (512, 512))
    assert {r["v"] for r in raster.select("v").distinct().collect()} == {1, 2}
    boxes = {r["label"]: r for r in shapes.label_boxes(raster).collect()}
    assert (boxes[2]["x"], boxes[2]["y"], boxes[2]["w"], boxes[2]["h"]) == (14, 40, 267, 341)
    area = abs((280 - 14) * (380 - 40) - (70 - 14) * (128 - 40)) / 2
    assert boxes[2]["area"] == pytest.approx(area, rel=0.02)
    assert {r["v"] for r in shapes.rasterise(v, (512, 512), labels=False).select("v").distinct().collect()} == {255}


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32"])
def test_tiff_round_trip(spark, tmp_path, dtype):
    a = np.random.default_rng(3).integers(0, 250, (2, 70, 90)).astype(dtype)
    levels = [a, np.ascontiguousarray(a[:, ::2, ::2])]
    (tmp_path / "im.tif").write_bytes(images.tiff_bytes(levels, 32, images.image_xml(70, 90, ["a", "b"], dtype)))
    tiles = images.read_tiff(spark, str(tmp_path / "im.tif"))
    for k, level in enumerate(levels):
        assert (images.planes(tiles, "im", k) == level).all()
    images.write_tiles(tiles, str(tmp_path / "tiles"))
    assert (images.planes(images.read_tiles(spark, str(tmp_path / "tiles")), "im") == a).all()
    images.write_chunks(tiles.filter("level = 0"), str(tmp_path / "im.zarr"), (90, 70), 2, dtype, 32, ("a", "b"), colors=("#ff0000", "00ff00"))
    assert json.loads((tmp_path / "im.zarr/0/.zarray").read_text())["shape"] == [2, 70, 90] and (tmp_path / "im.zarr/1/1.0.1").exists()
    assert [c["color"] for c in json.loads((tmp_path / "im.zarr/.zattrs").read_text())["omero"]["channels"]] == ["ff0000", "00ff00"]


def test_rgb_tiff(spark, tmp_path):
    a = np.random.default_rng(4).integers(0, 250, (40, 50, 3)).astype("uint8")
    (tmp_path / "rgb.tif").write_bytes(images.tiff_bytes([a], 16, rgb=True))
    assert (images.planes(images.read_tiff(spark, str(tmp_path / "rgb.tif")), "rgb") == a.transpose(2, 0, 1)).all()


def test_parameter_files(spark, tmp_path):
    (tmp_path / "TransformParameters.0.txt").write_text('// comment\n(Transform "EulerTransform")\n\n(Size 10 20)\n(Spacing 0.5 0.5)\n')
    r = text.read_parameters(spark, str(tmp_path)).first()
    assert r["params"] == {"Transform": ["EulerTransform"], "Size": ["10", "20"], "Spacing": ["0.5", "0.5"]}
    assert tf.from_map(r["params"]).size == (10, 20)


def test_iteration_logs(spark, tmp_path):
    (tmp_path / "IterationInfo.1.R2.txt").write_text("1:ItNr\t2:Metric\t3a\t3b\t4\tt\n0\t-0.5\t1\t2\t3\t4\n1\t-0.6\t1\t2\t3\t4\n")
    rows = text.read_iterations(spark, str(tmp_path)).orderBy("iteration").collect()
    assert [(r["model"], r["resolution"], r["metric"]) for r in rows] == [(1, 2, -0.5), (1, 2, -0.6)]


def blobs(h, w, seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return sum(rng.uniform(0.3, 1) * np.exp(-((y - rng.uniform(20, h - 20)) ** 2 + (x - rng.uniform(20, w - 20)) ** 2) / rng.uniform(40, 200)) for _ in range(25)) * 200


@pytest.mark.parametrize("metric", register.METRICS)
def test_alignment_recovers_a_turn(metric):
    moving = blobs(128, 128, 7)
    true = tf.Transform("euler", (0.08, 5.0, -4.0), (63.5, 63.5), (128, 128))
    fixed = resample.resample_plane(moving, tf.Sequence().add([true]), 1.0, "linear")
    found, _ = register.align(fixed, moving, register.Model("euler", metric))
    assert found.params == pytest.approx(true.params, abs=0.6) and abs(found.params[0] - 0.08) < 0.02
    mask = (moving > 60).astype(float)
    a = resample.resample_plane(mask, tf.Sequence().add([true]), 1.0) > 0
    b = resample.resample_plane(mask, tf.Sequence().add([found]), 1.0) > 0
    assert 2 * (a & b).sum() / (a.sum() + b.sum()) > 0.85


def test_histogram_match():
    a, b = np.random.default_rng(0).integers(0, 50, (20, 20)), np.random.default_rng(1).integers(100, 200, (20, 20))
    got = register.histogram_match(a, b)
    assert 100 <= got.min() and got.max() <= 200 and abs(got.mean() - b.mean()) < 3


def test_contours(spark):
    from tessera.operators import contours

    mask = np.zeros((30, 40), bool)
    mask[5:20, 8:30] = True
    mask[10:12, 12:15] = False
    rings = contours.outlines(mask)
    assert sorted(contours.area(r) for r in rings) == [6.0, 330.0]
    assert sorted(map(tuple, contours.largest(mask, 0.0).tolist())) == [(8.0, 5.0), (8.0, 20.0), (30.0, 5.0), (30.0, 20.0)]
    assert len(contours.outlines(np.eye(3, dtype=bool))) == 3
    line = np.array([[0, 0], [1, 0.05], [2, -0.04], [3, 5], [4, 6.0]])
    assert contours.simplify(line, 0.1).tolist() == [[0, 0], [2, -0.04], [3, 5], [4, 6]]
    labels = np.zeros((1, 30, 40))
    labels[0, 2:9, 3:12], labels[0, 15:25, 20:31] = 1, 2
    raster = frame(spark, labels, "set").withColumnRenamed("image_id", "set_name")
    v = contours.label_polygons(raster)
    boxes = {r["feature_id"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in shapes.bounding_boxes(v).collect()}
    assert boxes == {0: (3, 2, 12, 9), 1: (20, 15, 31, 25)}


def test_cache(spark, tmp_path):
    from tessera.sources import cache

    df = spark.range(5)
    assert cache.cached(df, str(tmp_path), "a", {"k": 1}).count() == 5
    assert cache.cached(spark.range(9), str(tmp_path), "a", {"k": 1}).count() == 5
    assert cache.cached(spark.range(9), str(tmp_path), "a", {"k": 2}).count() == 9


def test_names(spark):
    from tessera.functions import names

    df = spark.createDataFrame([("IterationInfo.1.R10.txt",), ("IterationInfo.1.R2.txt",), ("iterationinfo.0.R3.txt",)], "name string")
    assert [r["name"][-7:] for r in df.orderBy(names.natural_key(df["name"])).collect()] == [".R3.txt", ".R2.txt", "R10.txt"]


def test_stream_of_logs(spark, tmp_path):
    from tessera.streaming import iterations

    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "IterationInfo.0.R0.txt").write_text("1\t2\t3a\t3b\t4\tt\n0\t-0.5\t1\t2\t3\t4\n1\t-0.6\t1\t2\t3\t4\n")
    q = iterations.watch(spark, str(folder)).writeStream.format("memory").queryName("logs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("logs").count() == 2
