"""Kernels, tiles, PSFs, TIFF files, configurations and streams."""

import json
import struct
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxmill.functions import text
from voxmill.operators import deconvolution as dec
from voxmill.operators import geometry as geo
from voxmill.operators import kernels, regions, stencils
from voxmill.plans import psf, tiles
from voxmill.sources import config, tiff, tiff_sink, tiff_source
from voxmill.streaming.watch import watch
from voxmill.volume import Volume

ALL = sorted(set(kernels.ALGORITHMS) - {"TestAlgorithm", "RichardsonLucywithAdaptiveDamping"})


def cube(shape=(4, 8, 8), seed=42):
    return np.random.default_rng(seed).random(shape) + 0.1


def to_volume(spark, array, image=0):
    z, y, x = (a.ravel() for a in np.indices(array.shape))
    rows = pd.DataFrame({"image_id": image, "x": x, "y": y, "z": z, "v": array.ravel()})
    return Volume(spark.createDataFrame(rows, "image_id long, x int, y int, z int, v double"), array.shape[::-1])


def to_array(volume, value="v"):
    out = np.full(volume.shape[::-1], np.nan)
    rows = volume.voxels.toPandas()
    out[rows["z"], rows["y"], rows["x"]] = rows[value]
    return out


@pytest.mark.parametrize("name", ALL)
def test_impulse_psf_is_identity(name):
    g = cube()
    out = kernels.ALGORITHMS[name][0](g, kernels.otf(np.ones((1, 1, 1)), g.shape), iterations=5, weight=1e-4)
    assert np.isfinite(out).all() and np.abs(out - g).max() < 0.1


@pytest.mark.parametrize("name", ["RichardsonLucy", "RichardsonLucyTotalVariation", "RichardsonLucywithAdaptiveDamping"])
def test_no_iterations_is_input(name):
    g = cube()
    assert (kernels.ALGORITHMS[name][0](g, kernels.otf(np.ones((3, 3, 3)), g.shape), iterations=0) == g).all()


@pytest.mark.parametrize("shape", [(4, 8, 8), (3, 5, 7), (1, 1, 6), (2, 1, 1)])
def test_spectrum(shape):
    g = cube(shape)
    assert np.allclose(kernels.spectrum(g), np.fft.fftn(g))


def test_sums():
    g, h = cube(), kernels.otf(np.ones((3, 3, 3)) / 27, (4, 8, 8))
    assert np.isclose(kernels.richardson_lucy(g, h, 5).sum(), g.sum())
    assert np.isclose(kernels.richardson_lucy_damped(g, h, 5).sum(), 0.9 * np.exp(-0.04) * g.sum())
    assert np.allclose(kernels.convolution(np.full((4, 8, 8), 3.5), h), 3.5)
    with pytest.raises(ValueError):
        kernels.otf(np.ones((5, 3, 3)), (4, 8, 8))


def test_registered_kernel(spark):
    kernels.register("Twice", lambda g, h, **_: 2 * g)
    g = cube()
    assert np.allclose(to_array(dec.deconvolve(to_volume(spark, g), "v", np.ones((1, 1, 1)), "Twice", tile=(5, 3, 2))), 2 * g)


@pytest.mark.parametrize("fill,mode", [("mirror", "symmetric"), ("zero", "constant")])
def test_pad(spark, fill, mode):
    g = cube((3, 4, 5))
    out = geo.pad(to_volume(spark, g), (7, 1, 0), (12, 9, 4), fill)
    assert np.allclose(to_array(out), np.pad(g, ((0, 4), (1, 9), (7, 12)), mode=mode))


def test_shift_is_roll(spark):
    g = cube((3, 4, 5))
    shifted = geo.octant_shift(to_volume(spark, g))
    assert (to_array(shifted) == np.roll(g, (1, 2, 2), axis=(0, 1, 2))).all()
    assert (to_array(geo.inverse_quadrant_shift(shifted)) == g).all()


@pytest.mark.parametrize("image,halo,most,least,small,strategy,expect", [
    ((100, 100, 50), 0, 10**6, 1, (1, 1, 1), "none", 1), ((100, 100, 50), (20, 20, 10), 10**6, 1, (21, 21, 11), "full_psf", 1),
    ((512, 512, 100), (64, 64, 32), 10**6, 4, (65, 65, 33), "full_psf", 4), ((32, 32, 10), (8, 8, 4), 10**6, 1, (9, 9, 5), "none", 1),
    ((200, 200, 80), (40, 40, 20), 5 * 10**5, 2, (41, 41, 21), "none", 2), ((256, 256, 64), (32, 32, 16), 10**6, 8, (33, 33, 17), "full_psf", 8),
    ((200, 200, 50), (20, 20, 10), 500, 1, (21, 21, 11), "full_psf", None), ((10, 10, 10), (4, 4, 4), 10**6, 1, (5, 5, 5), "none", 1),
])
def test_tile_shape(image, halo, most, least, small, strategy, expect):
    halo = (0, 0, 0) if halo == 0 else halo
    split = (tuple(h // 2 for h in halo), tuple(h - h // 2 for h in halo))
    if expect is None:
        with pytest.raises(ValueError):
            tiles.tile_shape(image, split, most, least, small, strategy)
        return
    shape = tiles.tile_shape(image, split, most, least, small, strategy)
    inner = [s - h for s, h in zip(shape, halo)]
    assert np.prod(shape) < most and all(i > 0 for i in inner) and all(s >= m for s, m in zip(shape, small)) and all(map(tiles.is_smooth, shape))
    starts = [tiles.axis_starts(n, i) for n, i in zip(image, inner)]
    assert np.prod([len(s) for s in starts]) >= expect
    for s, n, i in zip(starts, image, inner):
        assert s[0] == 0 and s[-1] + min(i, n) == n and all(b - a <= i for a, b in zip(s, s[1:]))


def test_plan_numbers():
    assert [tiles.next_smooth(n) for n in (0, 1, 7, 11, 121)] == [0, 1, 8, 12, 125]
    assert [tiles.previous_smooth(n) for n in (0, 1, 7, 13, 128)] == [0, 1, 6, 12, 125]
    assert tiles.memory_per_tile(8 << 30, 1, 1, 1, fft_copies=0) == (8 << 30) // 4 and tiles.memory_per_tile(0, 1, 1, 1) == 0
    assert tiles.halo_extent("parent", [(3, 5, 2), (4, 1, 1)], []) == ((2, 2, 1), (2, 3, 1))
    assert tiles.halo_extent("manual", [], [], (-1, 7, 2)) == ((0, 3, 1), (0, 4, 1))
    assert tiles.axis_starts(10, 6) == [0, 4]


def test_gaussian(spark):
    ids = spark.createDataFrame([(1, 2.0, 2.0, 1.0)], "image_id long, sigma_x double, sigma_y double, sigma_z double")
    out = to_array(psf.gaussian(ids, (9, 9, 5)))
    assert np.isclose(out.sum(), 1) and np.unravel_index(out.argmax(), out.shape) == (2, 4, 4) and np.allclose(out, out[::-1, ::-1, ::-1])
    assert psf.gaussian_halo("parent", (9, 9, 5), (2.0, 2.1, 1.0)) == (8, 8, 4)


def test_gibson_lanni(spark):
    assert np.allclose(psf.j0(np.array([0, 1, 5, 20.0])), [1, 0.76519769, -0.17759677, 0.16702466])
    ids = spark.createDataFrame([(1, 1.2, 0.0)], "image_id long, na double, particle double")
    out = to_array(psf.gibson_lanni(ids, (13, 13, 5)))
    assert np.unravel_index(out.argmax(), out.shape) == (2, 6, 6) and np.allclose(out, out[:, ::-1, :]) and np.allclose(out, out.transpose(0, 2, 1)) and np.allclose(out[0], out[4])


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("big", [False, True])
def test_tiff(how, tile, big):
    g = cube((3, 19, 37)).astype(np.float32).round(1)
    data = tiff.encode(g, how, tile=tile, big=big)
    about = tiff.metadata(data)
    assert (about["width"], about["height"], about["depth"], about["tiled"]) == (37, 19, 3, bool(tile))
    assert (tiff.read_volume(data) == g).all() and (tiff.read_volume(data, z=(1, 3)) == g[1:]).all()
    assert (tiff.read_page(data, tiff.pages(data)[1], rows=(5, 18)) == g[1, 5:18]).all()


def test_lzw():
    for data in (b"", b"a", b"ab" * 9000, bytes(200_000), bytes(range(256)) * 99, b"abcabcab" * 5000 + bytes(7), np.random.default_rng(1).integers(0, 256, 30000).astype("u1").tobytes()):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    with pytest.raises(ValueError):
        tiff.pages(b"no such file")


def test_lzw_of_a_table_that_is_never_cleared():
    """Codes of single bytes, beyond 4,096 of them."""
    data = np.random.default_rng(2).integers(0, 256, 6000)
    widths = [min(12, max(9, (258 + k).bit_length())) for k in range(6001)]
    bits = "".join(format(c, f"0{w}b") for c, w in zip([*data.tolist(), 257], widths))
    coded = format(256, "09b") + bits
    raw = int(coded.ljust(-(-len(coded) // 8) * 8, "0"), 2).to_bytes(-(-len(coded) // 8), "big")
    assert tiff.lzw_decode(raw) == data.astype("u1").tobytes()
    with pytest.raises(ValueError, match="broken"):
        tiff.lzw_decode(int((format(256, "09b") + format(300, "09b")).ljust(24, "0"), 2).to_bytes(3, "big"))


@pytest.mark.parametrize("n_taps", [1, 40])
def test_both_forms_of_a_convolution(spark, n_taps):
    """Few taps are scattered, many go by spectra; both give the same."""
    rng = np.random.default_rng(n_taps)
    taps = [(*map(int, rng.integers(-1, 2, 3)), float(w)) for w in rng.random(n_taps)]
    v = to_volume(spark, cube((3, 4, 5)))
    assert dec.best_form(v.shape, n_taps) == ("scatter" if n_taps == 1 else "spectra")
    own, a, b = (to_array(dec.convolved(v, "v", taps, form)) for form in (None, "scatter", "spectra"))
    assert np.allclose(a, b) and np.allclose(own, a)


def test_flat_and_unequal_boxes_are_compared_with_few_others(spark):
    """Long flat boxes, and two sizes of boxes far apart, make a number of comparisons near
    that of the pairs, and of rows near that of the boxes."""
    rng = np.random.default_rng(5)

    def frame(name, box, extents):
        rows = [(i, *map(int, rng.integers(0, (400, 300, 50))), *map(int, rng.integers(1, np.array(extents[i % len(extents)]) + 1))) for i in range(4000)]
        return rows, spark.createDataFrame(rows, f"{name} int, x int, y int, z int, w int, h int, d int").select(name, regions.box(*map(F.col, "xyzwhd")).alias(box))

    for one, other in (([(50, 3, 7)], [(60, 4, 30)]), ([(2, 2, 2), (500, 2, 2)], [(2, 2, 2), (2, 2, 300)])):
        (rows, a), (others, b) = frame("i", "box", one), frame("j", "other", other)
        p, q = (np.array(r)[:, 1:] for r in (rows, others))
        pairs = int(sum(np.all((x[:3] < q[:, :3] + q[:, 3:]) & (q[:, :3] < x[:3] + x[3:]), 1).sum() for x in p))
        placed = regions.place_boxes(a, b)
        cell = ["_pair", "_x", "_y", "_z"]
        m, n = (t.groupBy(*cell).agg(F.count("*").alias(c)) for t, c in zip(placed, "mn"))
        compared = m.join(n, cell).agg(F.sum(F.col("m") * F.col("n"))).first()[0]
        assert regions.join_boxes(a.withColumn("k", F.lit(0)), b.withColumn("k", F.lit(0)), ["k"]).count() == pairs
        assert compared < 12 * pairs and sum(t.count() for t in placed) < 25 * 8000


def test_boxes_within_others_stand_in_one_cell(spark):
    """A left box is placed by its first corner alone, once for each class that may hold it;
    boxes without extent, and tables without boxes, meet nothing."""
    rng = np.random.default_rng(6)
    rows = [(i, 0, *map(int, rng.integers(-60, 60, 3)), *map(int, rng.integers(0, (9, 3, 5)))) for i in range(2000)]
    others = [(i, 0, *map(int, rng.integers(-60, 60, 3)), *map(int, rng.integers(0, (40, 9, 30)))) for i in range(1000)]
    frame = lambda rows, name, box: spark.createDataFrame(rows, f"{name} int, k int, x int, y int, z int, w int, h int, d int").select(name, "k", regions.box(*map(F.col, "xyzwhd")).alias(box))
    a, b = frame(rows, "i", "box"), frame(others, "j", "other")
    some = [r for r in rows if min(r[5:]) > 0]
    placed, _ = regions.place_boxes(a, b, within=True)
    assert placed.count() == placed.select("i", "_pair").distinct().count() and placed.select("i").distinct().count() == len(some)
    p, q = (np.array(t)[:, 2:] for t in (some, [r for r in others if min(r[5:]) > 0]))
    want = int(sum(np.all((x[:3] >= q[:, :3]) & (x[:3] + x[3:] <= q[:, :3] + q[:, 3:]), 1).sum() for x in p))
    assert regions.join_boxes(a, b, ["k"], within=True).count() == want > 0
    assert regions.join_boxes(a.limit(0), b, ["k"]).count() == regions.join_boxes(a, b.limit(0), ["k"], within=True).count() == 0


def test_boxes_meet_without_a_nested_loop(spark):
    rng = np.random.default_rng(4)
    boxes = lambda n, most: [(i, i % 2, *map(int, rng.integers(-40, 40, 3)), *map(int, rng.integers(0, most))) for i in range(n)]
    frame = lambda rows, name, box: spark.createDataFrame(rows, f"{name} int, image_id int, x int, y int, z int, w int, h int, d int").select(name, "image_id", regions.box(*map(F.col, "xyzwhd")).alias(box))
    a, b = boxes(150, [20, 9, 5]), boxes(130, [60, 40, 70])
    for within in (False, True):
        met = regions.join_boxes(frame(a, "i", "box"), frame(b, "j", "other"), ["image_id"], within=within)
        want = []
        for p in a:
            for q in b:
                share = p[1] == q[1] and all(max(p[k], q[k]) < min(p[k] + p[k + 3], q[k] + q[k + 3]) for k in (2, 3, 4))
                inside = all(p[k] >= q[k] and p[k] + p[k + 3] <= q[k] + q[k + 3] for k in (2, 3, 4))
                if share and (inside or not within):
                    want.append((p[0], q[0]))
        assert sorted((r["i"], r["j"]) for r in met.collect()) == sorted(want) and want
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tiff_files(spark, tmp_path):
    g = cube((3, 5, 7)).astype(np.float32)
    v = to_volume(spark, g)
    assert tiff_sink.write_tiff(tiff_sink.encode_slices(v.voxels, "v", v.shape), f"file://{tmp_path}/t").count() == 1
    assert (tmp_path / "t" / "0.tiff").read_bytes() == tiff.encode(g)
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["0.tiff"]
    rows = tiff_source.read_tiff(spark, f"{tmp_path}/t", z=(1, 3)).toPandas()
    assert sorted(rows["z"].unique()) == [1, 2] and np.allclose(rows["v"], g[rows["z"], rows["y"], rows["x"]])
    assert len(rows) == 2 * 5 * 7
    rows = tiff_source.read_tiff(spark, f"{tmp_path}/t", z=(0, 9), y=(-3, 2), x=(5, 99)).toPandas()
    assert len(rows) == 3 * 2 * 2 and np.allclose(rows["v"], g[rows["z"], rows["y"], rows["x"]])
    ids = {r["image_id"] for r in tiff_source.list_files(spark, f"{tmp_path}/t").collect()}
    assert set(rows["image_id"]) == ids == {tiff_source.image_id(f"file:{tmp_path}/t/0.tiff")}


@pytest.mark.parametrize("kind", ["u1", "u2"])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_predictor(kind, tile):
    g = np.random.default_rng(5).integers(0, 256 if kind == "u1" else 65536, (2, 9, 21)).astype(np.float32)
    data = tiff.encode(g, tiff.DEFLATE, tile=tile, kind=kind)
    assert tiff.pages(data)[0].one(tiff.PREDICTOR) == tiff.HORIZONTAL
    assert (tiff.read_volume(data) == g).all() and (tiff.read_volume(data, 0, (1, 2), (3, 8), (4, 20)) == g[1:2, 3:8, 4:20]).all()


def made_tiff(tags, blocks):
    """A page of given blocks and tags."""
    fixed = {tiff.COMPRESSION: [1], **tags, tiff.STRIP_BYTES: [len(b) for b in blocks], tiff.STRIPS: [8 + sum(map(len, blocks[:i])) for i in range(len(blocks))]}
    body, at = b"".join(blocks), 8 + sum(map(len, blocks))
    lists, fields = b"", []
    for tag, values in sorted(fixed.items()):
        fields.append(struct.pack("<HHII", tag, 4, len(values), at + len(lists) if len(values) > 1 else values[0]))
        lists += struct.pack(f"<{len(values)}I", *values) if len(values) > 1 else b""
    return struct.pack("<2sHI", b"II", 42, at + len(lists)) + body + lists + struct.pack("<H", len(fields)) + b"".join(fields) + bytes(4)


@pytest.mark.parametrize("form, bits, kind", [(1, 8, "u1"), (2, 8, "i1"), (2, 16, "i2"), (1, 32, "u4"), (2, 32, "i4"), (3, 64, "f8")])
def test_sample_formats(form, bits, kind):
    g = (np.arange(12).reshape(3, 4) - (5 if form > 1 else 0)).astype(kind)
    tags = {tiff.WIDTH: [4], tiff.LENGTH: [3], tiff.BITS: [bits], tiff.SAMPLES: [1], tiff.ROWS: [2], tiff.FORMAT: [form]}
    data = made_tiff(tags, [g[:2].tobytes(), g[2:].tobytes()])
    assert (tiff.read_volume(data)[0] == g).all()


def test_separate_planes_and_what_is_refused():
    a, b = np.arange(12, dtype="u1").reshape(3, 4), np.arange(12, dtype="u1").reshape(3, 4) * 3
    tags = {tiff.WIDTH: [4], tiff.LENGTH: [3], tiff.BITS: [8], tiff.SAMPLES: [2], tiff.ROWS: [2], tiff.PLANAR: [2]}
    apart = made_tiff(tags, [a[:2].tobytes(), a[2:].tobytes(), b[:2].tobytes(), b[2:].tobytes()])
    assert (tiff.read_volume(apart, 1)[0] == a).all() and (tiff.read_volume(apart, 2)[0] == b).all()
    mixed = np.stack([a, b], 2)
    together = made_tiff(tags | {tiff.PLANAR: [1]}, [mixed[:2].tobytes(), mixed[2:].tobytes()])
    assert (tiff.read_volume(together, 2)[0] == b).all()
    with pytest.raises(ValueError, match="channel 3"):
        tiff.read_volume(together, 3)
    with pytest.raises(ValueError, match="predictor"):
        tiff.read_volume(made_tiff(tags | {tiff.SAMPLES: [1], tiff.PLANAR: [1], tiff.PREDICTOR: [3]}, [a[:2].tobytes(), a[2:].tobytes()]))
    with pytest.raises(ValueError, match="12 bits"):
        tiff.read_volume(made_tiff(tags | {tiff.SAMPLES: [1], tiff.PLANAR: [1], tiff.BITS: [12]}, [a[:2].tobytes(), a[2:].tobytes()]))


def test_halos_without_padding(spark):
    """The case of an image in tiles without padding: none before, none at the far edge."""
    images = spark.createDataFrame([(1, 128, 128, 32)], tiles_schema())
    rows = tiles.plan_tiles(images, ((8, 8, 4), (8, 8, 4)), 500_000, 1, (17, 17, 9), "none").collect()
    assert rows and all((r.before_x, r.before_y, r.before_z) == (0, 0, 0) for r in rows)
    assert all(r.after_x == 0 for r in rows if r.w == 128)
    covered = np.zeros((32, 128, 128), bool)
    for r in rows:
        covered[r.z : r.z + r.d, r.y : r.y + r.h, r.x : r.x + r.w] = True
    assert covered.all()


def tiles_schema():
    return "image_id long, width int, height int, depth int"


def test_zero_halo_of_odd_values(spark):
    g = cube((2, 3, 4))
    g[0, 0, 0], g[1, 2, 3] = np.nan, np.inf
    wide = to_array(geo.pad(to_volume(spark, g), (1, 2, 1), (2, 1, 1), "zero"))
    assert np.array_equal(wide, np.pad(g, ((1, 1), (2, 1), (1, 2))), equal_nan=True)


@pytest.mark.parametrize("text_", ["0:5[a", "0:5[a], 7:9[b", "["])
def test_open_brackets_are_errors(spark, text_):
    with pytest.raises(Exception, match="not closed"):
        spark.range(1).select(text.parse_ranges(F.lit(text_))).collect()


def test_range_grammar(spark):
    parse = lambda t: [(r["lo"], r["hi"], r["values"]) for r in spark.range(1).select(text.parse_ranges(F.lit(t))).first()[0]]
    assert parse("0:5[a, b], 7[c] ,:2[d],9:[e]") == [(0, 5, ["a", "b"]), (7, 7, ["c"]), (0, 2, ["d"]), (9, None, ["e"])]
    assert parse("no brackets") == [] and parse("0:5[a, 7:9[b]") == [(0, 5, ["a", "7:9[b"])]


def test_many_ranges(spark):
    """Beyond the bound of a broadcast, the same labels meet the same ranges."""
    rng = np.random.default_rng(3)
    ranges = [(i, int(lo), None if i % 40 == 0 else int(lo + w), [f"v{i}"]) for i, (lo, w) in enumerate(zip(rng.integers(0, 3000, 200), rng.integers(0, 60, 200)))]
    frame = spark.createDataFrame(ranges, "ordinal int, lo long, hi long, values array<string>")
    labels = spark.createDataFrame([(int(n),) for n in [-1, *rng.integers(0, 3100, 400)]], "label long")
    few, many = ({(r["label"], tuple(r["values"] or ())) for r in regions.look_up(labels, frame, bound).collect()} for bound in (1000, 10))
    assert few == many and any(v for _, v in few)


def test_stencils_shuffle_once(spark):
    v = to_volume(spark, cube((3, 4, 5)))
    g = to_array(v)
    for axis, c in enumerate("zyx"):
        want = np.zeros_like(g)
        want[tuple(slice(0, -1) if i == axis else slice(None) for i in range(3))] = -np.diff(g, axis=axis)
        assert np.allclose(to_array(stencils.gradient(v, "v"), f"g{c}"), want)
    plan = stencils.gradient(v, "v").voxels._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1


def test_config(tmp_path):
    values = {"image_path": "a.tif", "output": "b.tif", "deconvolution_config": {"iterations": 5, "padding_fill": "mirror", "lambda": 1}}
    (tmp_path / "c.json").write_text(json.dumps(values))
    setup, own = config.read_json(f"{tmp_path}/c.json")
    assert (setup["backend"], own["iterations"], own["lambda"], own["padding_fill"]) == ("cpu", 5, 1.0, "mirror")
    config.write_json(f"{tmp_path}/d.json", setup, own)
    assert config.read_json(f"{tmp_path}/d.json") == (setup, own)
    with pytest.raises(TypeError):
        config.load({"iterations": "5"}, config.DECONVOLUTION)
    with pytest.raises(ValueError):
        config.load({"iterations": -1}, config.DECONVOLUTION)
    with pytest.raises(ValueError):
        config.load({}, config.SETUP)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert config.load({"padding_fill": "x", "q": 1}, config.DECONVOLUTION)["padding_fill"] == "zero"
    assert len(said) == 2
    assert config.parser().parse_args(["--image_path", "a", "--output", "b", "--iterations", "3"]).iterations == 3


def test_watch(spark, tmp_path):
    v = to_volume(spark, cube((2, 3, 4)))
    v.voxels.write.parquet(f"{tmp_path}/in/a")
    twice = lambda w: w.map(v=F.col("v") * 2)
    for _ in range(2):  # a second run finds nothing new
        watch(spark, f"{tmp_path}/in/*", v.voxels.schema, v.shape, twice, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert np.allclose(to_array(Volume(spark.read.parquet(f"{tmp_path}/out").drop("batch"), v.shape)), 2 * to_array(v))
