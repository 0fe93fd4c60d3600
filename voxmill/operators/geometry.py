"""Crops, halos and shifts. All move voxels by projections of their places; halos
copy a voxel to the places that read it, so none of them joins or shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.volume import KEYS, Shape, Volume

FILLS = ("zero", "mirror", "linear", "quadratic", "sinusoid", "gaussian")


def crop(volume: Volume, start: Shape, shape: Shape) -> Volume:
    """The box at start; voxels outside the volume are left out."""
    inside = F.lit(True)
    for c, a, n in zip("xyz", start, shape):
        inside = inside & F.col(c).between(a, a + n - 1)
    moved = [(F.col(c) - a).alias(c) for c, a in zip("xyz", start)]
    return volume.with_(volume.voxels.where(inside).select("image_id", *moved, *volume.values), shape)


def remove_padding(volume: Volume, before: Shape, after: Shape) -> Volume:
    return crop(volume, before, tuple(n - a - b for n, a, b in zip(volume.shape, before, after)))


def crop_to_original(volume: Volume, shape: Shape) -> Volume:
    """The middle, from the floor of half the difference."""
    return crop(volume, tuple((n - m) // 2 for n, m in zip(volume.shape, shape)), shape)


def _mirrored(c: str, n: int, before: int, after: int) -> Column:
    """Places in the padded axis that mirror place c: symmetric, edges repeated."""
    x, last = F.col(c), n + after - 1

    def copies(first: Column) -> Column:
        lowest = first + 2 * n * F.ceil((F.lit(-before) - first) / (2 * n)).cast("int")
        return F.when(lowest <= last, F.sequence(lowest, F.greatest(lowest, F.lit(last)), F.lit(2 * n))).otherwise(F.array().cast("array<int>"))

    return F.transform(F.concat(copies(x), copies(2 * n - 1 - x)), lambda i: i + before)


def _clamped(c: str, n: int, before: int, after: int) -> Column:
    x = F.col(c)
    lo = F.when(x == 0, 0).otherwise(x + before)
    hi = F.when(x == n - 1, n - 1 + before + after).otherwise(x + before)
    return F.sequence(lo, hi)


def _distance(c: str, n: int, before: int, after: int) -> Column:
    """How far into the halo a padded place lies: 0 at the image, 1 at the rim."""
    o = F.col(c)
    out = F.lit(0.0)
    if after:
        out = F.when(o >= before + n, (o - (before + n - 1)) / after).otherwise(out)
    if before:
        out = F.when(o < before, (before - o) / before).otherwise(out)
    return out


def pad(volume: Volume, before: Shape, after: Shape, fill: str = "zero", scale: float = 1.0) -> Volume:
    """A halo. mirror reflects; other fills weigh the nearest image voxel by the
    largest of the three distances: zero 0, linear 1-t, quadratic (1-t/scale)^2,
    sinusoid cos^2(pi t/2), gaussian exp(-(t/scale)^2)."""
    if fill not in FILLS:
        raise ValueError(f"fill must be one of {FILLS}")
    to = _mirrored if fill == "mirror" else _clamped
    rows = volume.voxels
    for c, n, a, b in zip("xyz", volume.shape, before, after):
        rows = rows.withColumn(c, F.explode(to(c, n, a, b)))
    shape = tuple(n + a + b for n, a, b in zip(volume.shape, before, after))
    if fill != "mirror":
        t = F.greatest(*(_distance(c, n, a, b) for c, n, a, b in zip("xyz", volume.shape, before, after)))
        if fill == "zero":  # whatever the edge holds
            rows = rows.select(*KEYS, *(F.when(t > 0, 0.0).otherwise(F.col(v)).alias(v) for v in volume.values))
        else:
            weight = {
                "linear": lambda: 1 - t, "quadratic": lambda: (1 - t / scale) * (1 - t / scale),
                "sinusoid": lambda: F.cos(F.pi() / 2 * t) * F.cos(F.pi() / 2 * t), "gaussian": lambda: F.exp(-(t / scale) * (t / scale)),
            }[fill]()
            rows = rows.withColumn("_w", weight).select(*KEYS, *((F.col(v) * F.col("_w")).alias(v) for v in volume.values))
    return volume.with_(rows.select(*KEYS, *volume.values), shape)


def pad_to_shape(volume: Volume, shape: Shape, fill: str = "zero") -> Volume:
    """Centred in shape, the smaller half before; never crops."""
    if not all(volume.shape):
        raise ValueError("an empty volume cannot be padded")
    more = [max(0, m - n) for n, m in zip(volume.shape, shape)]
    return pad(volume, tuple(m // 2 for m in more), tuple(m - m // 2 for m in more), fill)


def expand_to_min_size(volume: Volume, shape: Shape) -> Volume:
    """Mirrored at the ends only."""
    return pad(volume, (0, 0, 0), tuple(max(0, m - n) for n, m in zip(volume.shape, shape)), "mirror")


def roll(volume: Volume, by: Shape) -> Volume:
    return volume.with_(volume.voxels.select("image_id", *(F.pmod(F.col(c) + k, F.lit(n)).alias(c) for c, k, n in zip("xyz", by, volume.shape)), *volume.values))


def octant_shift(volume: Volume) -> Volume:
    """A cyclic roll by half of every axis, for odd ones by the floor."""
    return roll(volume, tuple(n // 2 for n in volume.shape))


def inverse_quadrant_shift(volume: Volume) -> Volume:
    return roll(volume, tuple(-(n // 2) for n in volume.shape))


def flip(volume: Volume, axis: str) -> Volume:
    n = volume.shape["xyz".index(axis)]
    return volume.with_(volume.voxels.withColumn(axis, n - 1 - F.col(axis)))


def at(volume: Volume, x: int, y: int, z: int):
    """The voxel's row in every image; pruned to it at the source."""
    return volume.voxels.where((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z))


def put(volume: Volume, edits, value: str) -> Volume:
    """Values of edits (image_id, x, y, z, value) in place of the volume's."""
    new = edits.select(*KEYS, F.col(value).alias("_new"))
    joined = volume.voxels.join(new, KEYS, "left")
    return volume.with_(joined.select(*KEYS, *(F.coalesce("_new", v).alias(v) if v == value else F.col(v) for v in volume.values)))


def linear_index(volume: Volume) -> Column:
    w, h, _ = volume.shape
    return (F.col("z").cast("long") * h + F.col("y")) * w + F.col("x")


def neighbour(volume: Volume, value: str, dx: int, dy: int, dz: int) -> Volume:
    """Adds `near`: the value at the offset place, 0 outside, by moving voxels to
    the places that read them and one aggregation."""
    own = volume.voxels.select(*KEYS, F.col(value).alias("own"), F.lit(0.0).alias("near"))
    inside = F.lit(True)
    for c, n in zip("xyz", volume.shape):
        inside = inside & F.col(c).between(0, n - 1)
    moved = volume.voxels.select("image_id", *((F.col(c) - k).alias(c) for c, k in zip("xyz", (dx, dy, dz))), F.lit(0.0).alias("own"), F.col(value).alias("near")).where(inside)
    both = own.unionByName(moved).groupBy(*KEYS).agg(F.sum("own").alias(value), F.sum("near").alias("near"))
    return volume.with_(both)
