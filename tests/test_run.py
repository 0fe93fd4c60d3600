"""Runs by configuration files, from TIFF to TIFF."""

import json

import numpy as np
import pytest

from voxmill import engine
from voxmill.__main__ import main
from voxmill.operators import kernels
from voxmill.plans import psf as models
from voxmill.plans import tiles
from voxmill.sources import config, tiff


@pytest.fixture()
def folder(spark, tmp_path):
    g = (np.random.default_rng(1).random((4, 12, 16)) + 1).astype(np.float32)
    (tmp_path / "image.tif").write_bytes(tiff.encode(g))
    labels = np.zeros_like(g)
    labels[:, :, 8:] = 100
    (tmp_path / "labels.tif").write_bytes(tiff.encode(labels))
    (tmp_path / "a.json").write_text(json.dumps({"model_name": "Gaussian", "id": "psf_a", "size_x": 5, "size_y": 5, "size_z": 3, "sigma_x": 1, "sigma_y": 1, "sigma_z": 0.5}))
    (tmp_path / "b.tif").write_bytes(tiff.encode(np.ones((1, 1, 1), np.float32)))
    return tmp_path, g


def configure(folder, **more):
    own = {k: more.pop(k) for k in list(more) if k in ("algorithm_name", "iterations", "padding_strategy", "padding_fill")}
    values = {"image_path": f"{folder}/image.tif", "output": f"file://{folder}/out", "output_compression": "deflate", **more, "deconvolution_config": own}
    (folder / "run.json").write_text(json.dumps(values))
    return f"{folder}/run.json"


def written(folder):
    path = folder / "out" / "image.tiff"
    return tiff.read_volume(path.read_bytes())


def test_standard(spark, folder):
    where, g = folder
    path = configure(where, multiple_psf_config_paths=[f"{where}/a.json"], iterations=3, padding_strategy="none")
    result = engine.run(spark, path)
    assert result.success, result.message
    # a configured PSF is made at the extent of the tile
    psf = engine.make_psf(spark, json.loads((where / "a.json").read_text()), g.shape[::-1])
    want = kernels.richardson_lucy(g.astype(float), kernels.otf(psf.cube, g.shape), 3)
    assert np.allclose(written(where), want, rtol=1e-4)


@pytest.mark.parametrize("parallel", [1, 4])
def test_tiles_with_halo(spark, folder, parallel):
    where, g = folder
    path = configure(where, multiple_psf_config_paths=[f"{where}/a.json"], algorithm_name="Convolution", padding_strategy="full_psf", padding_fill="mirror")
    result = engine.run(spark, path, parallel=parallel)
    assert result.success, result.message
    values = json.loads((where / "a.json").read_text())
    _, own = config.read_json(path)
    tile, (before, after) = engine.plan(g.shape[::-1], [(5, 5, 3)], [(5, 5, 3)], own, 1 << 30, parallel)
    full = tuple(t + a + b for t, a, b in zip(tile, before, after))
    otf = kernels.otf(engine.make_psf(spark, values, full).cube, full[::-1])
    wide = np.pad(g.astype(float), list(zip(before, after))[::-1], mode="symmetric")
    want = np.zeros_like(wide)
    starts = [tiles.axis_starts(n, t) for n, t in zip(g.shape[::-1], tile)]
    assert np.prod([len(s) for s in starts]) >= parallel
    for z in starts[2]:
        for y in starts[1]:
            for x in starts[0]:
                out = kernels.apply(wide[z : z + full[2], y : y + full[1], x : x + full[0]], otf)
                inner = tuple(slice(b, b + t) for b, t in zip(before[::-1], tile[::-1]))
                want[z : z + tile[2], y : y + tile[1], x : x + tile[0]] = out[inner]
    assert np.allclose(written(where), want[: g.shape[0], : g.shape[1], : g.shape[2]], rtol=1e-4)


def test_command_line(spark, folder):
    where, _ = folder
    assert main(["deconvolution", "-c", configure(where, psf_file_paths=[f"{where}/b.tif"], algorithm_name="Convolution", padding_strategy="none")]) == 0


def test_labelled(spark, folder):
    where, g = folder
    path = configure(where, multiple_psf_config_paths=[f"{where}/a.json"], psf_file_paths=[f"{where}/b.tif"], labeled_image=f"{where}/labels.tif", label_psf_map="0:2[b],50:200[psf_a]", algorithm_name="Convolution", padding_strategy="none")
    result = engine.run(spark, path)
    assert result.success, result.message
    out = written(where)
    assert np.isfinite(out).all()
    psf = engine.make_psf(spark, json.loads((where / "a.json").read_text()), g.shape[::-1])
    blurred = kernels.apply(g.astype(float), kernels.otf(psf.cube, g.shape))
    low, high = np.minimum(g, blurred) - 1e-4, np.maximum(g, blurred) + 1e-4
    assert ((out >= low) & (out <= high)).all()


def test_psfs_are_saved_and_files_compressed(spark, folder):
    where, g = folder
    path = configure(where, multiple_psf_config_paths=[f"{where}/a.json"], psf_file_paths=[f"{where}/b.tif"], algorithm_name="Convolution", padding_strategy="none", save_psf=True, output_compression_level=9)
    result = engine.run(spark, path)
    assert result.success, result.message
    assert {p.name for p in (where / "out").glob("*.tiff")} == {"image.tiff", "psf_a.tiff", "b.tiff"}
    saved = tiff.read_volume((where / "out" / "psf_a.tiff").read_bytes())
    assert saved.shape == g.shape and np.isclose(saved.sum(), 1, atol=1e-5)
    assert np.allclose(written(where), g)  # the last PSF counts, an impulse
    assert tiff.pages((where / "out" / "image.tiff").read_bytes())[0].one(tiff.COMPRESSION) == tiff.DEFLATE


def test_label_image_must_fit(spark, folder):
    where, _ = folder
    (where / "small.tif").write_bytes(tiff.encode(np.zeros((4, 12, 15), np.float32)))
    how = {"psf_file_paths": [f"{where}/b.tif"], "label_psf_map": "0:2[b]", "algorithm_name": "Convolution", "padding_strategy": "none"}
    assert "another shape" in engine.run(spark, configure(where, labeled_image=f"{where}/small.tif", **how)).message
    with pytest.warns(UserWarning, match="'nobody'"):
        assert engine.run(spark, configure(where, labeled_image=f"{where}/labels.tif", **how | {"label_psf_map": "0:2[b,nobody],50:200[b]"})).success


def test_configurations_from_a_folder(spark, folder):
    where, _ = folder
    (where / "psfs").mkdir()
    (where / "psfs" / "good.json").write_text((where / "a.json").read_text())
    (where / "psfs" / "bad.json").write_text("{")
    with pytest.warns(UserWarning, match="bad.json"):
        (values,) = config.read_psfs([str(where / "psfs")])
    assert models.configured_shape(values) == (5, 5, 3)
    models.register("Point", models.Model(lambda spark, v, shape: models.MODELS["Gaussian"].make(spark, v | {f"sigma_{c}": 1e-3 for c in "xyz"}, shape), lambda *_: (0, 0, 0)))
    try:
        cube = engine.make_psf(spark, {"model_name": "Point", "size_x": 3, "size_y": 3, "size_z": 1}).cube
        assert cube.shape == (1, 3, 3) and cube[0, 1, 1] == 1
    finally:
        del models.MODELS["Point"]


def test_failures_are_returned(spark, folder):
    where, _ = folder
    assert not engine.run(spark, f"{where}/none.json").success
    assert "point-spread" in engine.run(spark, configure(where)).message
    assert "algorithm_name" in engine.run(spark, configure(where, psf_file_paths=[f"{where}/b.tif"], algorithm_name="Nope")).message
    with pytest.raises(ValueError):
        engine.make_psf(spark, {"model_name": "Other"})


def test_psf_generator(spark, folder):
    where, _ = folder
    assert main(["psfgenerator", "-c", f"{where}/a.json", "-o", str(where)]) == 0
    out = tiff.read_volume((where / "psf_a.tiff").read_bytes())
    assert out.shape == (3, 5, 5) and np.isclose(out.sum(), 1, atol=1e-5)


def test_progress(spark, folder):
    where, _ = folder
    seen = []
    path = configure(where, multiple_psf_config_paths=[f"{where}/a.json"], iterations=3, padding_strategy="none", max_mem_host_gb=0)
    assert engine.run(spark, path, 8, seen.append).success
    assert seen[0] == 0 and seen[-1] == 1 and all(a < b for a, b in zip(seen, seen[1:]))


def test_only_groups_of_a_tile_are_deconvolved(spark):
    """As many kernels run as there are pairs of a tile and a group with weights in it."""
    from pyspark.sql import functions as F

    from voxmill import chunks as ch
    from voxmill.operators import deconvolution as dec
    from voxmill.volume import Volume, grid

    whole = grid(spark.range(2).toDF("image_id"), (16, 4, 2))
    volume = Volume(whole.withColumn("v", F.lit(1.0)), (16, 4, 2))
    masks = Volume(whole.select(F.when(F.col("x") < 6, "a").otherwise("b").alias("group"), "image_id", "x", "y", "z", F.lit(1.0).alias("weight")), volume.shape)
    weights = dec.blurred_weights(ch.from_voxels(masks, "weight", (4, 4, 2), ("image_id", "group")), np.ones((1, 1, 3)))
    pairs = {(r["group"], r["cx"]) for r in weights.rows.where("image_id = 1").collect()}
    assert pairs == {("a", 0), ("a", 1), ("b", 1), ("b", 2), ("b", 3)}
    done = spark.sparkContext.accumulator(0)
    layout = ch.Layout(volume.shape, (4, 4, 2), (1, 0, 0), (1, 0, 0), "mirror")
    parts = ch.pieces(ch.from_voxels(volume, "v", (8, 4, 2)), layout)
    out = dec.labelled_chunks(parts, layout, weights, {"a": np.full((1, 1, 1), 2.0), "b": np.full((1, 1, 1), 4.0)}, "Convolution", done=done)
    rows = ch.to_voxels(out, "v").voxels.toPandas()
    assert done.value == 2 * len(pairs) and len(rows) == 2 * 16 * 4 * 2
    want = np.where(np.arange(16) < 5, 2.0, np.where(np.arange(16) > 6, 4.0, np.where(np.arange(16) == 5, (2 * 2 + 4) / 3, (2 + 4 * 2) / 3)))
    assert np.allclose(rows["v"], want[rows["x"]])
