"""Configurations, the command line, and a small project from pixels to mapped images and shapes."""

import json

import numpy as np
import pytest

from tessera import cli, config
from tessera.operators import register, resample, shapes
from tessera.plans import transforms as tf
from tessera.plans.graph import Graph
from tessera.sources import formats, images
from tessera.project import Encoder, Prepro, Project, intensity, spatial
from tests.test_engine import array, blobs, frame, network


def test_config_round_trip():
    n = network()
    data = json.loads(json.dumps(config.dump(n, "p", "out")))
    back = config.load(data)
    assert back.nodes == n.nodes and back.paths == n.paths and back.shapes == n.shapes and back.merges == n.merges and config.dump(back, "p", "out") == data
    with pytest.raises(ValueError):
        config.check({"project_name": "x"})
    assert config.check({"project_name": "x", "output_dir": "", "modalities": {}, "reg_paths": {"a": {"reg_params": "affine"}}})["reg_paths"]["a"]["reg_params"] == ["affine"]


def test_transforms_round_trip():
    e = tf.Transform("euler", (0.25, 1.5, -2.0), (5.0, 6.0), (7, 8), (0.5, 0.5))
    b = tf.Transform("bspline", tuple(float(x) for x in range(32)), size=(7, 8), grid_size=(4, 4), grid_spacing=(2.0, 2.0), grid_origin=(-1.0, -1.0))
    s = config.load_transforms(config.save_transforms([e, e], [("b", [e, b])]))
    assert s.transforms == (e, e, e, b) and s.groups == (0, 1, 2, 2)


def test_command_line(tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps(config.dump(network(), "p", "out")))
    assert cli.main(["plan", str(tmp_path / "c.json")]) == 0
    told = capsys.readouterr().out
    assert "a -> b (rigid) -> c (rigid) -> f (rigid)" in told and "writes: b, c, extra, all, e" in told


def test_preprocessing(spark):
    a = np.random.default_rng(0).integers(0, 256, (3, 12, 16)).astype(float)
    grey = array(intensity(frame(spark, a), Prepro("BF"), rgb=True), 12, 16)
    assert (grey == 255 - (np.floor(0.2125 * a[0]) + np.floor(0.7154 * a[1]) + np.floor(0.0721 * a[2]))).all()
    assert array(intensity(frame(spark, a), Prepro(custom=(lambda df: df.withColumn("v", df["v"] * 0),))), 12, 16).max() == 0
    one = frame(spark, a[:1])
    out, steps, size, res = spatial(one, Prepro(downsampling=2, rotate=90, flip="h", box=(1, 2, 3, 4)), (16, 12), 0.5)
    assert size == (3, 4) and res == 1.0 and [t.kind for t in steps] == ["euler", "affine", "translation"]
    assert (array(out, 4, 3) == resample.resample_plane(a[0], tf.Sequence().add(steps), 0.5)).all()


def test_project(spark):
    c = blobs(96, 96, 5)
    # each image is the one that its edge's transform turns into its target
    b = resample.resample_plane(c, tf.Sequence().add([tf.Transform("euler", (-0.05, -3.0, 2.0), (47.5, 47.5), (96, 96))]), 1.0, "linear")
    a = resample.resample_plane(b, tf.Sequence().add([tf.Transform("euler", (-0.04, -2.0, 2.5), (47.5, 47.5), (96, 96))]), 1.0, "linear")
    g = Graph()
    for name in "abc":
        g.add_image(name)
    g.add_path("a", "c", "b")
    g.add_path("b", "c")
    g.attach_shapes("a", "marks")
    p = Project(g, {n: frame(spark, v[None], n) for n, v in (("a", a), ("b", b), ("c", c))}, dict.fromkeys("abc", (96, 96)))
    p.register(spark, {"rigid": register.Model(metric="mean_squares")})
    assert all(e.registered for e in g.edges)
    got = array(resample.to_pixels(p.transformed("a", 32, "linear")), 96, 96)
    inner = (slice(16, 80), slice(16, 80))
    assert np.corrcoef(got[inner].ravel(), c[inner].ravel())[0, 1] > 0.97 > np.corrcoef(a[inner].ravel(), c[inner].ravel())[0, 1]
    v = spark.createDataFrame([("marks", 0, 0, 0, 0, 40.0, 50.0, "Point", "m")], shapes.VERTICES)
    r = p.shapes(v, "marks").first()
    assert shapes.map_points(p.sequence("a"), np.array([[r["x"], r["y"]]])) == pytest.approx(np.array([[40.0, 50.0]]))


def test_stages_of_a_path_follow_each_other(spark):
    m = blobs(96, 96, 5)
    turn, shift = tf.Transform("euler", (0.5, 0.0, 0.0), (47.5, 47.5), (96, 96)), tf.Transform("translation", (6.0, -4.0), size=(96, 96))
    both = tf.Sequence().add([turn, shift], [0, 0])
    c = resample.resample_plane(m, both, 1.0, "linear")
    # what a stage finds comes after what it starts from
    t, _ = register.align(c, m, register.Model("translation", "mean_squares"), start=tf.Sequence().add([turn]))
    assert t.params == pytest.approx(shift.params, abs=0.5)
    g = Graph()
    for name in "ac":
        g.add_image(name)
    g.add_path("a", "c", params=("first", "second"))
    a = resample.resample_plane(c, tf.Sequence().add([tf.Transform("affine", (1.04, 0.03, -0.04, 0.97, 3.0, -2.0), (47.5, 47.5), (96, 96))]), 1.0, "linear")
    p = Project(g, {n: frame(spark, v[None], n) for n, v in (("a", a), ("c", c))}, dict.fromkeys("ac", (96, 96)))
    p.register(spark, {"first": register.Model(metric="mean_squares"), "second": register.Model("affine", "mean_squares")})
    stages = g.edges[0].transforms
    assert [t.kind for t in stages] == ["euler", "affine"] and stages == p.found["a"]
    # the second stage is found anew from the first one alone, but for the planes' rounding to 8 bits
    want, _ = register.align(c, a, register.Model("affine", "mean_squares"), start=tf.Sequence().add(stages[:1]))
    assert stages[1].params == pytest.approx(want.params, abs=0.02)
    got = array(resample.to_pixels(p.transformed("a", 32, "linear")), 96, 96)[20:76, 20:76]
    assert np.corrcoef(got.ravel(), c[20:76, 20:76].ravel())[0, 1] > 0.98


def test_models_are_the_references(spark):
    budget = lambda name: (lambda m: (m.kind, m.resolutions, m.iterations, m.samples, m.bins))(register.MODELS[name])
    assert budget("rigid") == ("euler", 10, 200, 10000, 16) and budget("affine") == ("affine", 10, 200, 10000, 32) and budget("similarity") == ("similarity", 10, 200, 10000, 32)
    assert budget("rigid-expanded") == budget("rigid_expanded") == ("euler", 10, 500, 30000, 16) and budget("fi_correction") == ("euler", 4, 75, 10000, 16) and budget("affine_test") == ("affine", 10, 10, 10000, 32)
    g = Graph()
    for name in "ac":
        g.add_image(name)
    assert budget("nl") == ("bspline", 10, 200, 50000, 32) and budget("nl_reduced") == ("bspline", 5, 150, 50000, 32) and budget("nl2")[3] == 15000 and budget("nl3")[2] == 1000 and budget("nl_test")[2] == 10
    assert register.MODELS["nl-mid"].grid == 150 and register.MODELS["nl-mid"].schedule == (512, 128, 64, 32, 2) and register.MODELS["nl-reduced"].steps == (50, 40, 30, 20)
    g.add_path("a", "c", params=("rigid", "nl9"))
    with pytest.raises(ValueError, match="nl9 is not known"):
        Project(g, {}, {}).register(spark)


def test_preprocessing_of_a_configuration():
    block = {"image_type": "BF", "contrast_enhance": True, "invert_intensity": True, "as_uint8": True, "mask_to_bbox": False, "rot_cc": 90, "flip": "h", "mask_bbox": [1, 2, 3, 4], "downsampling": 2, "ch_indices": 0, "max_int_proj": False}
    data = {"project_name": "p", "output_dir": "o", "modalities": {"a": {"image_filepath": "a.tif", "image_res": 0.5, "preprocessing": block}, "b": {"mask": None}}}
    want = {"a": Prepro("BF", (0,), False, True, True, downsampling=2, rotate=90, flip="h", box=(1, 2, 3, 4)), "b": Prepro()}
    assert config.prepros(data) == want
    assert config.prepros(json.loads(json.dumps(config.dump(config.load(data), "p", "o", want)))) == want
    for bad in ({"preprocessing": {"custom_processing": ["none"]}}, {"preprocessing": {"flip": "x"}}, {"preprocessing": {"rotate": 3}}, {"image_res": 0}):
        with pytest.raises(ValueError):
            config.load(data | {"modalities": {"a": bad}})
    more = {"a": {"mask": "m.tif", "output_res": 2, "channel_colors": ["red"], "preprocessing": {"crop_to_mask_bbox": True, "as_uint8": False, "use_mask": False, "custom_processing": ["double"]}}, "b": {}}
    paths = {"p": {"src_modality_name": "a", "tgt_modality_name": "b", "reg_params": "affine", "override_prepro": {"source": {"rot_cc": 90}, "target": None}}}

    def double(image):
        return image.withColumn("v", image["v"] * 2)

    given = data | {"modalities": more, "reg_paths": paths}
    own, g = config.prepros(given, {"double": double}), config.load(given, {"double": double})
    assert own["a"] == Prepro(as_uint8=False, use_mask=False, crop_to_mask=True, custom=(double,)) and g.nodes["a"].mask == "m.tif" and g.nodes["a"].output_res == 2 and g.edges[0].source_prepro == Prepro(rotate=90) and g.edges[0].target_prepro is None
    again = json.loads(config.text_of(config.dump(g, "p", "o", own)))
    assert config.load(again, {"double": double}) == g and config.prepros(again, {"double": double}) == own
    assert own["a"].told(given_only=True) == {"as_uint8": False, "use_mask": False, "crop_to_mask": True, "custom": ["double"]}
    assert json.loads(json.dumps({"x": np.float32(2), "y": np.arange(2), "p": Prepro()}, cls=Encoder))["y"] == [0, 1]


@pytest.mark.parametrize("kind", ["tiles", "tiff", "zarr"])
def test_run_of_a_configuration(spark, tmp_path, capsys, kind):
    c = np.round(blobs(96, 96, 5) * 255 / blobs(96, 96, 5).max()).astype("uint8")
    # a is c moved, then turned by the quarter that its preprocessing takes back
    moved = resample.resample_plane(c.astype(float), tf.Sequence().add([tf.Transform("euler", (-0.05, -3.0, 2.0), (47.5, 47.5), (96, 96))]), 1.0, "linear")
    quarter = np.rot90(moved, -1).astype("uint8")
    for name, a in (("a", np.stack([quarter, 255 - quarter])), ("c", c[None])):
        (tmp_path / f"{name}.tif").write_bytes(images.tiff_bytes([a], 32))
    (tmp_path / "marks.json").write_text(json.dumps([{"type": "Feature", "geometry": {"type": "Point", "coordinates": [40.0, 50.0]}, "properties": {}}]))
    data = {
        "project_name": "p", "output_dir": str(tmp_path / "unused"), "modalities": {"a": {"image_filepath": str(tmp_path / "a.tif"), "preprocessing": {"ch_indices": [0], "rot_cc": 90}}, "c": {"image_filepath": str(tmp_path / "c.tif")}},
        "reg_paths": {"r": {"src_modality_name": "a", "tgt_modality_name": "c", "reg_params": ["rigid_ams"]}}, "attachment_shapes": {"marks": {"attachment_modality": "a", "shape_files": [str(tmp_path / "marks.json")]}}, "merge_modalities": {"both": ["c", "a"]},
    }
    (tmp_path / "p.json").write_text(json.dumps(data))
    assert cli.main(["run", str(tmp_path / "p.json"), "--output", str(tmp_path / "out"), "--tile", "64", "--kind", kind]) == 0
    told = [x.rsplit("/", 1)[-1] for x in capsys.readouterr().out.split()]
    assert told == [f"both.{kind}", "a_transformations.json", "a_iterations_0.svg", "marks_0.geojson", "p_configuration.json"]
    path = str(tmp_path / "out" / told[0])
    got = images.planes(formats.read(spark, path), "both")
    assert formats.info(spark, path).channels == 3 and (kind != "tiff" or formats.info(spark, path).names == ("c - C0", "a - C0", "a - C1"))
    assert config.load(json.loads((tmp_path / "out" / "p_configuration.json").read_text())).merges == {"both": ("c", "a")}
    assert got.shape == (3, 96, 96) and got.dtype == np.uint8 and (got[0] == c).all()
    inner = (slice(16, 80), slice(16, 80))
    assert np.corrcoef(got[1][inner].ravel(), c[inner].ravel())[0, 1] > 0.95
    inside = got[1][inner] + got[2][inner].astype(int)
    assert (inside == 255).mean() > 0.99
    s = config.load_transforms((tmp_path / "out" / "a_transformations.json").read_text())
    assert len(s.transforms) == 2 and spark.read.text(str(tmp_path / "out" / "marks_0.geojson")).count() == 1
