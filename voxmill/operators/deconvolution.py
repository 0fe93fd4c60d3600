"""Convolution and deconvolution of volumes.

convolve() is the definition as a scatter and one aggregation; it suits PSFs of a few
taps. deconvolve_chunks() runs an FFT kernel on every chunk with its halo; deconvolve()
does so between voxel rows. A PSF is sent to tasks once, and each worker keeps its
transfer functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill import chunks as ch
from voxmill.operators import kernels
from voxmill.volume import KEYS, Shape, Volume

Taps = list[tuple[int, int, int, float]]
Halo = tuple[Shape, Shape]
NO_HALO: Halo = ((0, 0, 0), (0, 0, 0))
#: Chunks of transforms where none are asked for.
CHUNK: Shape = (64, 64, 64)


def convolve(volume: Volume, value: str, taps: Taps, adjoint: bool = False) -> Volume:
    """Circular convolution with (dx, dy, dz, weight) taps, or its adjoint."""
    sign = -1 if adjoint else 1
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), F.lit(w).alias("w")) for i, j, k, w in taps)))
    rows = volume.voxels.select(*KEYS, value, each.alias("t"))
    moved = [F.pmod(F.col(c) + sign * F.col(f"t.{o}"), F.lit(n)).alias(c) for c, o, n in zip("xyz", "ijk", volume.shape)]
    out = rows.select("image_id", *moved, (F.col(value) * F.col("t.w")).alias(value)).groupBy(*KEYS).agg(F.sum(value).alias(value))
    return volume.with_(out)


#: Measured work, in nanoseconds of a core: of a voxel row through an aggregation, of a voxel
#: in and out of chunks, and of a number of a transform for each doubling of its extent.
ROW, PACKED, TRANSFORMED = 400.0, 900.0, 4.0


def best_form(shape: Shape, n_taps: int) -> str:
    """Which form of a circular convolution costs less: "scatter" sends each voxel to the places
    of all taps; "spectra" goes by transforms of whole images, whatever the taps."""
    doublings = sum(np.log2(max(2, n)) for n in shape)
    return "scatter" if n_taps * ROW <= PACKED + 2 * TRANSFORMED * doublings + 6 * ROW / 8 else "spectra"


def convolved(volume: Volume, value: str, taps: Taps, form: str | None = None) -> Volume:
    """Circular convolution with taps, in the form that costs less or in a given one."""
    if (form or best_form(volume.shape, len(taps))) == "scatter":
        return convolve(volume.with_(volume.voxels.select(*KEYS, value)), value, taps)
    found = filter_spectra(ch.from_voxels(volume, value, CHUNK), tap_psf(taps))
    return volume.with_(ch.to_voxels(found, value).voxels)


def tap_psf(taps: Taps) -> np.ndarray:
    """A PSF cube (z, y, x), odd along each axis, with the taps around its centre."""
    reach = [max(abs(t[a]) for t in taps) for a in range(3)]
    cube = np.zeros([2 * r + 1 for r in reversed(reach)])
    for i, j, k, w in taps:
        cube[reach[2] + k, reach[1] + j, reach[0] + i] += w
    return cube


def _filter(spark: SparkSession, psfs: dict[str, np.ndarray], algorithm: str, settings: dict) -> Callable[[np.ndarray, str], np.ndarray]:
    """A registered kernel with PSFs by name, which are sent to tasks once."""
    kernel, _ = kernels.ALGORITHMS[algorithm]
    cubes = {k: np.ascontiguousarray(v, np.float64) for k, v in psfs.items()}
    keys = {k: hashlib.sha256(str(v.shape).encode() + v.tobytes()).hexdigest() for k, v in cubes.items()}
    sent = spark.sparkContext.broadcast(cubes)

    def work(cube: np.ndarray, name: str) -> np.ndarray:
        return kernel(cube, kernels.cached_otf(keys[name], lambda: sent.value[name], cube.shape), **settings)

    return work


def deconvolve_pieces(parts: DataFrame, layout: ch.Layout, psf: np.ndarray, algorithm: str = "RichardsonLucy", done: Accumulator | None = None, kind: str = ch.REAL, **settings) -> ch.Chunks:
    """Runs a registered kernel on every chunk that the pieces, numbers of a kind, make; done
    counts them. Kernels work in double precision whatever the kind."""
    work = _counted(_filter(parts.sparkSession, {"": psf}, algorithm, settings), done)
    return ch.gather(parts, layout, lambda cube, _: work(cube.astype(np.float64), ""), kind=kind)


def _counted(work: Callable[[np.ndarray, str], np.ndarray], done: Accumulator | None) -> Callable[[np.ndarray, str], np.ndarray]:
    def run(cube: np.ndarray, name: str) -> np.ndarray:
        out = work(cube, name)
        if done is not None:
            done.add(1)
        return out

    return run


def deconvolve_chunks(chunks: ch.Chunks, psf: np.ndarray, algorithm: str = "RichardsonLucy", halo: Halo = NO_HALO, fill: str = "zero", **settings) -> ch.Chunks:
    """Runs a registered kernel on every chunk with its halo."""
    work = _filter(chunks.rows.sparkSession, {"": psf}, algorithm, settings)
    return ch.map_chunks(chunks, lambda cube, _: work(cube, ""), *halo, fill)


def deconvolve(volume: Volume, value: str, psf: np.ndarray, algorithm: str = "RichardsonLucy", tile: Shape | None = None, halo: Halo = NO_HALO, fill: str = "zero", **settings) -> Volume:
    """deconvolve_chunks() of voxel rows, in tiles; without tiles an image is one."""
    chunks, layout = _blocks(volume, value, tile, halo, fill)
    if layout.full == chunks.size:
        return volume.with_(ch.to_voxels(deconvolve_chunks(chunks, psf, algorithm, **settings), value).voxels)
    return volume.with_(ch.to_voxels(deconvolve_pieces(ch.pieces(chunks, layout), layout, psf, algorithm, **settings), value).voxels)


def _blocks(volume: Volume, value: str, tile: Shape | None, halo: Halo, fill: str) -> tuple[ch.Chunks, ch.Layout]:
    """Voxel rows in blocks, whole images where no halo is asked for, and the layout of tiles
    that read them."""
    own = tuple(min(t, n) for t, n in zip(tile or volume.shape, volume.shape))
    block = tuple(max(t, c) for t, c in zip(own, CHUNK))
    return ch.from_voxels(volume, value, block), ch.Layout(volume.shape, own, *halo, fill)


def spectrum(volume: Volume, values: str | tuple[str, str], size: Shape = CHUNK, half: bool = False) -> Volume:
    """The discrete Fourier transform of each image, real or complex (two values), as (re, im)
    at frequencies x, y, z; half: those of the lower half along x, of real images."""
    found = ch.to_voxels(ch.transform(ch.from_voxels(volume, values, size), half), "re", "im")
    return found


def inverse_spectrum(volume: Volume, value: str | tuple[str, str] = "v", size: Shape = CHUNK, width: int | None = None) -> Volume:
    """The image whose transform is (re, im): its real part, or both where two values are
    named; width: its extent along x, of half a spectrum."""
    names = (value,) if isinstance(value, str) else value
    return ch.to_voxels(ch.inverse(ch.from_voxels(volume, ("re", "im"), size), width), *names)


#: What spectra are multiplied with, from the transfer function and the Laplacian's symbol.
SPECTRAL: dict[str, Callable[..., np.ndarray]] = {
    "Convolution": lambda h, symbol, **_: h,
    "InverseFilter": lambda h, symbol, epsilon=1e-6, **_: np.where(np.abs(h) ** 2 < epsilon, 0, np.conj(h) / np.where(np.abs(h) ** 2 < epsilon, 1, np.abs(h) ** 2)),
    "RegularizedInverseFilter": lambda h, symbol, weight=0.001, epsilon=1e-9, **_: np.conj(h) / np.maximum(epsilon, np.abs(h) ** 2 + weight * symbol**2),
}


def transfer_block(psf: np.ndarray, shape: Shape, start: Shape, extent: Shape) -> np.ndarray:
    """A block of the transfer function of a PSF in images of a shape, by one matrix for each
    axis: frequencies of the block by places of the PSF. No array has the image's extent."""
    out = psf.astype(complex)
    for axis, (n, p, a, e) in enumerate(zip(shape[::-1], psf.shape, start[::-1], extent[::-1])):
        if p > n:
            raise ValueError(f"the PSF {psf.shape} does not fit the image {shape[::-1]}")
        turn = np.exp(-2j * np.pi * np.multiply.outer(np.arange(a, a + e), np.arange(p) - p // 2) / n)
        out = np.moveaxis(np.tensordot(turn, out, (1, axis)), 0, axis)
    return out


def filter_spectra(chunks: ch.Chunks, psf: np.ndarray, algorithm: str = "Convolution", **settings) -> ch.Chunks:
    """A filter of SPECTRAL on whole images without tiles: transforms by lines of chunks, and
    the block of the filter that each chunk of a half spectrum needs, made where it is."""
    factor, sent, shape = SPECTRAL[algorithm], chunks.rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(psf, np.float64)), chunks.shape
    half = ch.transform(chunks, half=True)
    layout = ch.Layout(half.shape, half.size)

    def work(cube: np.ndarray, place: Shape) -> np.ndarray:
        start, extent = layout.start(place), layout.extent(place)
        cos = [np.cos(2 * np.pi * np.arange(a, a + e) / n) for n, a, e in zip(shape, start, extent)]
        symbol = -2 * (cos[0] + cos[1][:, None] + cos[2][:, None, None] - 3)
        own = ch.core(cube, place, layout)
        own *= factor(transfer_block(sent.value, shape, start, extent), symbol, **settings)
        return cube

    return ch.inverse(ch.map_chunks(half, work), shape[0])


def blurred_weights(masks: ch.Chunks, kernel: np.ndarray, fill: str = "mirror", halo: Halo | None = None) -> ch.Chunks:
    """Masks by (image_id, group), blurred by the kernel and divided by their sum at each
    voxel. A group has rows where its masks are and as far as the blur reaches."""
    reach = tuple(n // 2 for n in kernel.shape[::-1])
    before, after = halo or (reach, reach)
    blur = _filter(masks.rows.sparkSession, {"": kernel}, "Convolution", {})
    layout = ch.Layout(masks.shape, masks.size, before, after, fill)
    work = lambda cube, _: np.maximum(np.round(blur(cube, ""), 12), 0)
    found = ch.gather(ch.pieces(masks, layout), layout, work, masks.keys, masks.kind)
    others = [k for k in masks.keys if k != "group"]

    def normalize(table: pa.Table) -> pa.Table:
        own = np.stack([np.frombuffer(x.as_buffer()) for x in table["data"]])
        total = own.sum(axis=0)
        shares = np.where(total > 0, own / np.where(total > 0, total, 1), 0)
        some = shares.any(axis=1)
        return table.drop(["data"]).filter(pa.array(some)).append_column("data", pa.array([x.tobytes() for x in shares[some]], pa.binary()))

    rows = found.rows.groupBy(*others, *ch.PLACE).applyInArrow(normalize, found.schema())
    return ch.Chunks(rows, masks.shape, masks.size, masks.kind, masks.keys)


def labelled_chunks(parts: DataFrame, layout: ch.Layout, weights: ch.Chunks, psfs: dict[str, np.ndarray], algorithm: str = "RichardsonLucy", done: Accumulator | None = None, kind: str = ch.REAL, **settings) -> ch.Chunks:
    """Deconvolves every chunk with the PSFs of the groups that it holds, and of no others,
    and sums by their weights, keyed by (image_id, group); 0 where no group reaches. psfs: by
    group, a configuration; done counts the pairs of a chunk and a group."""
    run = _counted(_filter(parts.sparkSession, psfs, algorithm, settings), done)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"image_id": pa.array([], pa.int64()), **{c: pa.array([], pa.int32()) for c in ch.PLACE}, "data": pa.array([], pa.binary())})
        place, cube = ch.assembled(left, layout, kind)
        cube = cube.astype(np.float64)
        total = np.zeros(layout.extent(place)[::-1])
        for group, data in zip(right["group"].to_pylist(), right["data"]):
            total += ch.core(run(cube, group), place, layout) * np.frombuffer(data.as_buffer()).reshape(total.shape)
        return left.slice(0, 1).select(["image_id", *ch.PLACE]).append_column("data", pa.array([total.astype(kind).tobytes()], pa.binary()))

    known = weights.rows.where(F.col("group").isin(list(psfs)))
    keys = ["image_id", *ch.PLACE]
    rows = parts.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(work, "image_id long, cx int, cy int, cz int, data binary")
    return ch.Chunks(rows, layout.shape, layout.size, kind)


def labelled(volume: Volume, value: str, weights: DataFrame, psfs: dict[str, np.ndarray], algorithm: str = "RichardsonLucy", tile: Shape | None = None, halo: Halo = NO_HALO, fill: str = "zero", **settings) -> DataFrame:
    """labelled_chunks() of voxel rows and of weights (image_id, x, y, z, group, weight)."""
    chunks, layout = _blocks(volume, value, tile, halo, fill)
    own = ch.from_voxels(Volume(weights, volume.shape), "weight", layout.size, ("image_id", "group"))
    return ch.to_voxels(labelled_chunks(ch.pieces(chunks, layout), layout, own, psfs, algorithm, **settings), value).voxels.select(*KEYS, value)
