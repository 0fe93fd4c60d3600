"""Tile planning: sizes that FFTs like, halos, and memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

Shape = tuple[int, int, int]
STRATEGIES = ("none", "parent", "full_psf", "manual")


def is_smooth(n: int) -> bool:
    """Whether n has no prime factors but 2, 3 and 5."""
    for p in (2, 3, 5):
        while n > 1 and n % p == 0:
            n //= p
    return n == 1


def next_smooth(n: int) -> int:
    while n > 1 and not is_smooth(n):
        n += 1
    return n


def previous_smooth(n: int) -> int:
    """The greatest smooth number below n; n itself up to 1."""
    if n <= 1:
        return n
    n -= 1
    while not is_smooth(n):
        n -= 1
    return n


def axis_starts(extent: int, size: int) -> list[int]:
    """Starts of tiles of `size` that cover an axis; the last is moved back."""
    size = min(size, extent)
    return [min(a, extent - size) for a in range(0, extent, size)]


def memory_per_tile(total: int, io_threads: int, workers: int, scratch: int, fft_copies: int = 2) -> int:
    """Bytes that one tile may have when reads, kernels and FFT copies share total."""
    shares = fft_copies + 3 * io_threads + workers * scratch
    return total // shares if shares else total


def halo_extent(strategy: str, psf_halos: list[Shape], psf_shapes: list[Shape], manual: Shape = (-1, -1, -1)) -> tuple[Shape, Shape]:
    """Halo before and after: half of the total, the smaller half first."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "manual":
        whole = [max(0, n) for n in manual]
    else:
        of = {"none": [], "parent": psf_halos, "full_psf": psf_shapes}[strategy]
        whole = [max((s[a] for s in of), default=0) for a in range(3)]
    return tuple(n // 2 for n in whole), tuple(n - n // 2 for n in whole)


def _count(image: Shape, size: list[int], total: list[int]) -> int:
    n = 1
    for extent, s, t in zip(image, size, total):
        n *= len(axis_starts(extent, max(1, s - t)))
    return n


def tile_shape(image: Shape, halo: tuple[Shape, Shape], most_voxels: int, least_tiles: int, least_shape: Shape, strategy: str = "full_psf") -> Shape:
    """The padded shape of tiles: smooth extents, as large as fit below most_voxels,
    least_tiles of them at least, then smaller along each axis while their number does
    not grow. Fails if the least shape is too large or too few tiles come of it."""
    total = [a + b for a, b in zip(*halo)]
    size = [next_smooth(max(m, n + (0 if strategy == "none" else t))) for n, t, m in zip(image, total, least_shape)]
    while size[0] * size[1] * size[2] >= most_voxels or _count(image, size, total) < least_tiles:
        for axis in sorted(range(3), key=lambda a: -size[a]):
            smaller = previous_smooth(size[axis])
            if smaller >= least_shape[axis] and smaller > total[axis]:
                size[axis] = smaller
                break
        else:
            raise ValueError("not enough memory for the smallest possible tile, or too few tiles")
    number = _count(image, size, total)
    for axis in range(3):
        while (smaller := previous_smooth(size[axis])) >= least_shape[axis] and smaller > total[axis] and smaller < size[axis]:
            tried = [*size[:axis], smaller, *size[axis + 1 :]]
            if _count(image, tried, total) > number:
                break
            size = tried
    return tuple(size)


PLAN = "image_id long, chunk_id int, x int, y int, z int, w int, h int, d int, before_x int, before_y int, before_z int, after_x int, after_y int, after_z int"


def axis_split(extent: int, full: int, before: int, after: int, strategy: str) -> tuple[int, int, int]:
    """Size of tiles along an axis and their halos, of a padded extent. Without padding
    the halo before belongs to the tiles, and so does the one after where it would
    reach the far edge. What is left over is halo after."""
    if strategy != "none":
        size = min(extent, full - before - after)
        return size, before, full - size - before
    size = full - after if full < extent else full
    size = min(size, extent)
    return size, 0, full - size


def plan_tiles(images: DataFrame, halo: tuple[Shape, Shape], most_voxels: int, least_tiles: int = 1, least_shape: Shape = (1, 1, 1), strategy: str = "full_psf") -> DataFrame:
    """(image_id, width, height, depth) rows to a row for every tile of every image."""

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for image, *shape in part[["image_id", "width", "height", "depth"]].itertuples(index=False):
                full = tile_shape(tuple(shape), halo, most_voxels, least_tiles, least_shape, strategy)
                size, before, after = zip(*(axis_split(n, f, a, b, strategy) for n, f, a, b in zip(shape, full, *halo)))
                xs, ys, zs = (axis_starts(n, s) for n, s in zip(shape, size))
                places = [(x, y, z) for z in zs for y in ys for x in xs]
                rows += [(image, i, *p, *size, *before, *after) for i, p in enumerate(places)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])

    return images.mapInPandas(plan, PLAN)
