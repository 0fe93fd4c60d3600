"""From a configuration to restored volumes: the plan and the jobs behind a run."""

from __future__ import annotations

import threading
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill import chunks
from voxmill.functions import text
from voxmill.operators import deconvolution, geometry, kernels, regions
from voxmill.plans import psf as models
from voxmill.plans import tiles
from voxmill.sources import config, tiff, tiff_sink, tiff_source
from voxmill.volume import KEYS, Shape, Volume

SETTINGS = {"iterations": "iterations", "lambda": "weight", "epsilon": "epsilon"}


@dataclass(frozen=True)
class Psf:
    """cube (z, y, x); halo: the extent that the parent strategy asks for."""

    name: str
    cube: np.ndarray
    halo: Shape

    @property
    def shape(self) -> Shape:
        return self.cube.shape[::-1]


@dataclass(frozen=True)
class Result:
    success: bool
    message: str
    seconds: float


def to_cube(own: chunks.Chunks) -> np.ndarray:
    """A PSF on the driver, which sends it to all tasks; the extent of a tile bounds it."""
    layout, out = chunks.Layout(own.shape, own.size), np.zeros(own.shape[::-1])
    for row in own.rows.select(*chunks.PLACE, "data").collect():
        place = tuple(row[c] for c in chunks.PLACE)
        at = tuple(slice(a, a + n) for a, n in zip(layout.start(place)[::-1], layout.extent(place)[::-1]))
        out[at] = np.frombuffer(row["data"], own.kind).reshape(layout.extent(place)[::-1])
    return out


def psf_name(values: dict[str, Any]) -> str:
    return str(values.get("id", values["model_name"]))


def make_psf(spark: SparkSession, values: dict[str, Any], shape: Shape | None = None, strategy: str = "parent") -> Psf:
    """A PSF from its configuration, at its configured shape or another; its halo is
    that of the configured one."""
    model, v, own = models.model(values), models.DEFAULTS | values, models.configured_shape(values)
    made = model.make(spark, v, shape or own)
    planes = chunks.from_voxels(made, "v", (*made.shape[:2], 1))
    return Psf(psf_name(values), to_cube(planes), model.halo(strategy, v, own) or (0, 0, 0))


def read_box(spark: SparkSession, path: str, shape: Shape, start: Shape, extent: Shape, before: Shape, after: Shape, fill: str = "zero", channel: int = 0) -> Volume:
    """The box at start of images of a shape, with a halo: from the image where it has
    it, else by the fill. Only blocks of the file that the box touches are read."""
    lo = [max(0, s - b) for s, b in zip(start, before)]
    hi = [min(n, s + e + a) for n, s, e, a in zip(shape, start, extent, after)]
    x, y, z = zip(lo, hi)
    rows = tiff_source.read_tiff(spark, path, channel, z=z, y=y, x=x).select("image_id", *((F.col(c) - a).alias(c) for c, a in zip("xyz", lo)), F.col("v").cast("double").alias("v"))
    missing = [max(0, b - s) for s, b in zip(start, before)], [max(0, s + e + a - n) for n, s, e, a in zip(shape, start, extent, after)]
    return geometry.pad(Volume(rows, tuple(b - a for a, b in zip(lo, hi))), *map(tuple, missing), fill)


def read_psf(spark: SparkSession, path: str, relative_max: float) -> Psf:
    """A PSF from a file, named by its stem; its halo is the bounding box of values
    above a share of its maximum."""
    shape = _shape(tiff_source.list_slices(spark, path), "a point-spread function")
    layout = chunks.Layout(shape, (*shape[:2], 1))
    cube = to_cube(chunks.gather(tiff_source.read_pieces(spark, path, layout), layout, lambda c, _: c, kind=tiff_source.KIND))
    above = np.nonzero(cube > relative_max * float(cube.max()))
    return Psf(PurePosixPath(path).stem, cube, tuple(int(np.ptp(i)) + 1 if len(i) else 0 for i in above[::-1]))


def weights(masks: Volume, kernel: np.ndarray, tile: Shape | None = None, halo: deconvolution.Halo = deconvolution.NO_HALO, fill: str = "zero") -> DataFrame:
    """Masks (image_id, x, y, z, group, weight), blurred by the kernel and normalized to sum 1
    at each voxel, in tiles with a halo and its fill; rows of the chunks that a group
    reaches."""
    own = chunks.from_voxels(Volume(masks.voxels.select("group", *KEYS, "weight"), masks.shape), "weight", tile or masks.shape, ("image_id", "group"))
    found = chunks.to_voxels(deconvolution.blurred_weights(own, kernel, fill, halo), "weight").voxels
    return found.select(*KEYS, "group", "weight")


def feathering(shape: Shape, extent: int = 20, sigma: float = 5.0) -> np.ndarray:
    """The blur's Gaussian kernel, no larger than the image along each axis."""
    axes = [np.exp(-0.5 * ((np.arange(min(extent, n)) - min(extent, n) // 2) / sigma) ** 2) for n in shape[::-1]]
    cube = axes[0][:, None, None] * axes[1][None, :, None] * axes[2][None, None, :]
    return cube / cube.sum()


def plan(shape: Shape, halos: list[Shape], shapes: list[Shape], own: dict[str, Any], memory: int, parallel: int) -> tuple[Shape, tuple[Shape, Shape]]:
    """Tile and halo for images of a shape, from the halos and configured shapes of the
    PSFs."""
    halo = tiles.halo_extent(own["padding_strategy"], halos, shapes, tuple(own["cube_padding"]))
    least = tuple(max(s[a] for s in shapes) + halo[0][a] + halo[1][a] for a in range(3))
    budget = tiles.memory_per_tile(memory, 1, 1, kernels.ALGORITHMS[own["algorithm_name"]][1])
    full = tiles.tile_shape(shape, halo, budget // 8, parallel, least, own["padding_strategy"])
    return tuple(min(n, f - a - b) for n, f, a, b in zip(shape, full, *halo)), halo


def image_names(paths: DataFrame) -> DataFrame:
    """(image_id, name) of (image_id, path): the files' stems, with the id where several
    files have one stem."""
    stem = paths.select("image_id", text.stem(F.col("path")).alias("stem"))
    several = F.count("*").over(Window.partitionBy("stem")) > 1
    return stem.select("image_id", F.when(several, F.concat_ws("-", "stem", "image_id")).otherwise(F.col("stem")).alias("name"))


def _shape(slices: DataFrame, what: str) -> Shape:
    shapes = slices.select("width", "height", "depth").distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError(f"{what} must have one shape")
    return tuple(shapes[0])


class Progress:
    """Calls back with the share of tiles done, as tasks end, while a block runs; 1 at its end.
    Tiles of repeated tasks don't count beyond 1."""

    def __init__(self, spark: SparkSession, call: Callable[[float], None], every: float = 0.2):
        self.done, self.total, self.call, self.every = spark.sparkContext.accumulator(0), 0, call, every
        self.ended, self.last = threading.Event(), -1.0

    def _tell(self, share: float) -> None:
        if share > self.last:
            self.last = share
            self.call(share)

    def _watch(self) -> None:
        while not self.ended.wait(self.every):
            self._tell(min(0.999, self.done.value / self.total) if self.total else 0.0)

    def __enter__(self) -> Progress:
        self._tell(0.0)
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, failed, *_) -> None:
        self.ended.set()
        self.thread.join()
        if failed is None:
            self._tell(1.0)


def restore(spark: SparkSession, setup: dict[str, Any], own: dict[str, Any], memory: int = 1 << 30, parallel: int = 1, progress: Progress | None = None) -> tuple[chunks.Chunks, list[Psf]]:
    """Reads the images, plans and deconvolves, chunk by chunk; also the PSFs. Those from
    configurations are made at the padded shape of tiles; their configured shape counts for
    the halo and the least tile. Of several PSFs the last one counts; with a label image each
    range of labels has its own."""
    shape = _shape(tiff_source.list_slices(spark, setup["image_path"]), "images of one run")
    made = config.read_psfs(setup["multiple_psf_config_paths"])
    read = [read_psf(spark, path, own["padding_relative_max"]) for path in setup["psf_file_paths"]]
    if not made and not read:
        raise ValueError("no point-spread function is given")
    if own["algorithm_name"] not in kernels.ALGORITHMS:
        raise ValueError(f"algorithm_name must be one of {sorted(kernels.ALGORITHMS)}")
    halos = [models.model(v).halo(own["padding_strategy"], models.DEFAULTS | v, models.configured_shape(v)) or (0, 0, 0) for v in made]
    tile, halo = plan(shape, [*halos, *(p.halo for p in read)], [*map(models.configured_shape, made), *(p.shape for p in read)], own, memory, parallel)
    layout = chunks.Layout(shape, tile, *halo, own["padding_fill"])
    psfs = [*(make_psf(spark, v, layout.full, own["padding_strategy"]) for v in made), *read]
    settings = {v: own[k] for k, v in SETTINGS.items() if k != "epsilon" or own["algorithm_name"] == "InverseFilter"}
    parts = tiff_source.read_pieces(spark, setup["image_path"], layout)
    if progress is not None:
        progress.total = tiff_source.list_files(spark, setup["image_path"]).count() * int(np.prod([len(chunks.edges(n, t)) - 1 for n, t in zip(shape, tile)]))
        settings["done"] = progress.done
    if not setup["labeled_image"]:
        return deconvolution.deconvolve_pieces(parts, layout, psfs[-1].cube, own["algorithm_name"], kind=tiff_source.KIND, **settings), psfs
    found = label_weights(spark, setup, shape, tile)
    named = {p.name: p.cube for p in psfs}
    groups = sorted(r[0] for r in _ranges(spark, setup).select(F.array_join("values", ",")).distinct().collect())  # a configuration's label groups
    for missing in sorted({n for g in groups for n in g.split(",")} - named.keys()):
        warnings.warn(f"no point-spread function is named {missing!r}", stacklevel=2)
    last = {g: [named[n] for n in g.split(",") if n in named][-1:] for g in groups}
    # one label image serves all images of the run
    places = [F.explode(F.sequence(F.lit(0), F.lit(len(chunks.edges(n, t)) - 2))).alias(c) for n, t, c in zip(shape, tile, chunks.PLACE)]
    tiles_of = tiff_source.list_files(spark, setup["image_path"]).select("image_id", places[0]).select("*", places[1]).select("*", places[2])
    rows = tiles_of.join(found.rows.drop("image_id"), chunks.PLACE).select("image_id", "group", *chunks.PLACE, "data")
    shared = chunks.Chunks(rows, shape, found.size, found.kind, found.keys)
    return deconvolution.labelled_chunks(parts, layout, shared, {g: c[0] for g, c in last.items() if c}, own["algorithm_name"], kind=tiff_source.KIND, **settings), psfs


def _ranges(spark: SparkSession, setup: dict[str, Any]) -> DataFrame:
    parsed = spark.range(1).select(F.posexplode(text.parse_ranges(F.lit(setup["label_psf_map"]))).alias("ordinal", "r"))
    return regions.add_ranges(parsed.select("ordinal", "r.lo", "r.hi", F.explode("r.values").alias("value")))


def label_weights(spark: SparkSession, setup: dict[str, Any], shape: Shape, tile: Shape) -> chunks.Chunks:
    """Feathered weights of the label image's groups, in the tiles that each group reaches."""
    slices = tiff_source.list_slices(spark, setup["labeled_image"])
    if _shape(slices, "label images") != shape:
        raise ValueError("the label image has another shape than the images")
    if slices.select("path").distinct().limit(2).count() > 1:
        raise ValueError("one label image serves a run")
    layout = chunks.Layout(shape, tile)
    labels = chunks.gather(tiff_source.read_pieces(spark, setup["labeled_image"], layout), layout, lambda c, _: c, kind=tiff_source.KIND)
    # masks go on beyond the edges as labels do, mirrored
    return deconvolution.blurred_weights(regions.mask_chunks(labels, _ranges(spark, setup)), feathering(shape), "mirror")


COMPRESSIONS = {"none": tiff.NONE, "lzw": tiff.LZW, "deflate": tiff.DEFLATE, "zip": tiff.DEFLATE, "1": tiff.NONE, "5": tiff.LZW, "8": tiff.DEFLATE}


def save_psf(spark: SparkSession, psf: Psf, folder: str) -> str:
    """Writes a PSF, whose shape bounds it, as folder/<name>.tiff."""
    planes = [(0, 0, 0, z, plane.astype(chunks.REAL).tobytes()) for z, plane in enumerate(psf.cube)]
    rows = spark.createDataFrame(planes, "image_id long, cx int, cy int, cz int, data binary")
    own = chunks.Chunks(rows, psf.shape, (*psf.shape[:2], 1))
    names = spark.createDataFrame([(0, psf.name)], "image_id long, name string")
    return tiff_sink.write_tiff(tiff_sink.encode_chunks(own), folder, names).first()["path"]


def run(spark: SparkSession, path: str, parallel: int = 1, call: Callable[[float], None] | None = None) -> Result:
    """A run by its configuration file; failures are returned, not raised. call: gets the share
    of tiles done, again and again."""
    if call is None:
        return _run(spark, path, parallel, None)
    with Progress(spark, call) as progress:
        return _run(spark, path, parallel, progress)


def _run(spark: SparkSession, path: str, parallel: int, progress: Progress | None) -> Result:
    began = time.perf_counter()
    try:
        setup, own = config.read_json(path)
        out, psfs = restore(spark, setup, own, int(setup["max_mem_host_gb"] * (1 << 30)) or 1 << 30, parallel, progress)
        how = COMPRESSIONS.get(setup["output_compression"].lower())
        if how is None:
            warnings.warn(f"unknown compression {setup['output_compression']!r}: none is used", stacklevel=2)
            how = tiff.NONE
        tile = (setup["tile_width"], setup["tile_length"]) if setup["tile_width"] and setup["tile_length"] else None
        slices = tiff_sink.encode_chunks(out, how, setup["output_compression_level"], tile)
        paths = tiff_source.list_files(spark, setup["image_path"]).select("image_id", "path")
        n = tiff_sink.write_tiff(slices, setup["output"], image_names(paths)).count()
        if setup["save_psf"]:
            for psf in psfs:
                save_psf(spark, psf, setup["output"])
        return Result(True, f"{n} images written to {setup['output']}", time.perf_counter() - began)
    except Exception as error:  # noqa: BLE001
        return Result(False, f"{type(error).__name__}: {error}", time.perf_counter() - began)
