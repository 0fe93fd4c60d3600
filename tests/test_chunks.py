"""Chunks with halos, transforms and distances along lines, against whole arrays."""

import numpy as np
import pandas as pd
import pytest

from voxmill import chunks as ch
from voxmill.operators import geometry as geo
from voxmill.volume import Volume


def cube(shape, seed=42):
    return np.random.default_rng(seed).random(shape) + 0.1


def to_volume(spark, *arrays):
    z, y, x = (a.ravel() for a in np.indices(arrays[0].shape))
    rows = pd.concat([pd.DataFrame({"image_id": i, "x": x, "y": y, "z": z, "v": a.real.ravel(), "w": a.imag.ravel()}) for i, a in enumerate(arrays)])
    return Volume(spark.createDataFrame(rows, "image_id long, x int, y int, z int, v double, w double"), arrays[0].shape[::-1])


def to_arrays(volume, n=1):
    out = np.zeros((n, *volume.shape[::-1]), complex)
    rows = volume.voxels.toPandas()
    value = rows["v"] + (1j * rows["w"] if "w" in rows else 0)
    out[rows["image_id"], rows["z"], rows["y"], rows["x"]] = value
    assert len(rows) == out.size
    return out


@pytest.mark.parametrize("size", [(4, 3, 2), (7, 5, 3), (99, 99, 99), (1, 5, 2)])
def test_round_trip(spark, size):
    a, b = cube((3, 5, 7)), cube((3, 5, 7), 1) + 1j * cube((3, 5, 7), 2)
    v = to_volume(spark, a, b)
    assert np.array_equal(to_arrays(ch.to_voxels(ch.from_voxels(v, ("v", "w"), size), "v", "w"), 2), np.stack([a, b]))
    again = ch.rechunk(ch.from_voxels(v, "v", size), (3, 4, 2))
    assert np.array_equal(to_arrays(ch.to_voxels(again, "v"), 2).real, np.stack([a, b.real]))


@pytest.mark.parametrize("fill", geo.FILLS)
@pytest.mark.parametrize("before, after", [((2, 1, 3), (1, 4, 2)), ((0, 0, 5), (9, 0, 0))])
def test_halos_are_those_of_the_padded_image(spark, fill, before, after):
    """Also halos wider than chunks and than the image."""
    a = cube((4, 6, 5))
    v = to_volume(spark, a).map(v=_col("v"))
    wide = to_arrays(geo.pad(v, before, after, fill))[0].real
    layout = ch.Layout(v.shape, (2, 4, 3), before, after, fill)
    seen = ch.gather(ch.pieces(ch.from_voxels(v, "v", layout.size), layout), layout, _check(wide, layout))
    assert np.array_equal(to_arrays(ch.to_voxels(seen, "v"))[0].real, np.ones_like(a))


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def _check(wide, layout):
    def work(block, place):
        start = layout.start(place)
        want = wide[tuple(slice(s, s + f) for s, f in zip(start[::-1], layout.full[::-1]))]
        return np.full(block.shape, float(np.allclose(block, want, atol=1e-12)))

    return work


def test_only_faces_travel(spark):
    """Of a neighbour a chunk gets its halo, not all of it."""
    v = to_volume(spark, cube((8, 8, 8)))
    layout = ch.Layout(v.shape, (4, 4, 4), (1, 1, 1), (1, 1, 1))
    sent = ch.pieces(ch.from_voxels(v, "v", layout.size), layout).toPandas()
    own = sent[(sent["sx"] == sent["cx"] * 4) & (sent["sy"] == sent["cy"] * 4) & (sent["sz"] == sent["cz"] * 4)]
    assert len(sent) == 64 and len(own) == 8
    assert sent["data"].str.len().sum() == 8 * 5**3 * 8


@pytest.mark.parametrize("shape", [(4, 8, 6), (3, 5, 7), (1, 1, 6), (2, 1, 1)])
@pytest.mark.parametrize("size", [(4, 3, 2), (99, 99, 99)])
def test_transforms(spark, shape, size):
    a, b = cube(shape), cube(shape, 1) + 1j * cube(shape, 2)
    v = to_volume(spark, a, b)
    chunks = ch.from_voxels(v, ("v", "w"), size)
    spectra = ch.transform(chunks)
    assert np.allclose(to_arrays(ch.to_voxels(spectra, "v", "w"), 2), np.fft.fftn([a, b], axes=(1, 2, 3)))
    assert np.allclose(to_arrays(ch.to_voxels(ch.inverse(spectra), "v", "w"), 2), [a, b])
    half = ch.transform(ch.from_voxels(to_volume(spark, a), "v", size), half=True)
    assert np.allclose(to_arrays(ch.to_voxels(half, "v", "w")), np.fft.rfftn(a))
    assert np.allclose(to_arrays(ch.to_voxels(ch.inverse(half, shape[2]), "v"))[0], a)


def test_lines_that_do_not_fit_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ch, "LINE", 16 * 8 * 3)
    a = cube((4, 8, 8))
    out = ch.along(ch.from_voxels(to_volume(spark, a), "v", (4, 4, 4)), 0, np.cumsum)
    assert np.prod(out.size[1:]) * 8 * 8 <= ch.LINE
    assert np.allclose(to_arrays(ch.to_voxels(out, "v"))[0].real, np.cumsum(a, 2))


def test_product_of_spectra(spark):
    a, b = cube((4, 6, 5)), cube((4, 6, 5), 1)
    x, y = (ch.transform(ch.from_voxels(to_volume(spark, c), "v", (2, 3, 2))) for c in (a, b))
    out = ch.inverse(ch.combine(x, y, np.multiply))
    assert np.allclose(to_arrays(ch.to_voxels(out, "v"))[0], np.fft.ifftn(np.fft.fftn(a) * np.fft.fftn(b)))


@pytest.mark.parametrize("count", [1, 4, 60])
def test_distances(spark, count):
    rng = np.random.default_rng(count)
    mask = np.zeros((5, 9, 11))
    mask.ravel()[rng.choice(mask.size, count, False)] = 1
    rows = to_volume(spark, mask)
    found = ch.squared_distances(ch.from_voxels(rows.with_(rows.voxels.where("v > 0")), "v", (4, 3, 2)))
    at = np.argwhere(mask > 0)
    want = ((np.argwhere(mask >= 0)[:, None] - at[None]) ** 2).sum(2).min(1).reshape(mask.shape)
    assert np.array_equal(to_arrays(ch.to_voxels(found, "v"))[0].real, want)


def test_empty(spark):
    v = to_volume(spark, cube((2, 3, 4)))
    none = ch.from_voxels(v.with_(v.voxels.limit(0)), "v", (2, 2, 2))
    assert ch.to_voxels(ch.transform(none), "v", "w").voxels.count() == 0
    assert ch.to_voxels(ch.map_chunks(none, lambda c, _: c, (1, 1, 1), (1, 1, 1)), "v").voxels.count() == 0
