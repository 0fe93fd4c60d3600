"""Finite differences along the axes, and total variation."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from voxmill.volume import KEYS, Volume


#: Endings of the names of complex values.
PARTS = ("_re", "_im")


def _line(axis: str):
    """Windows hold one line of voxels along the axis, never an image."""
    return Window.partitionBy("image_id", *(c for c in "xyz" if c != axis)).orderBy(axis)


def ahead(axis: str, value: str) -> Column:
    """v[i] - v[i+1], 0 at the last place."""
    return F.coalesce(F.col(value) - F.lead(value).over(_line(axis)), F.lit(0.0))


def behind(axis: str, value: str) -> Column:
    """v[i] - v[i-1], with 0 before the first place."""
    return F.col(value) - F.coalesce(F.lag(value).over(_line(axis)), F.lit(0.0))


def _step(axis: str) -> dict[str, int]:
    return {c: int(c == axis) for c in "xyz"}


def _scattered(volume: Volume, parts: list[tuple[dict[str, int], dict[str, Column]]], names: list[str]) -> Volume:
    """Sums, at every place, of what voxels send there: parts are offsets and values by
    name. One aggregation on the places, whatever the number of axes."""
    sent = F.explode(F.array(*(F.struct(*((F.col(c) + by[c]).alias(c) for c in "xyz"), *(values.get(n, F.lit(0.0)).cast("double").alias(n) for n in names)) for by, values in parts)))
    rows = volume.voxels.select("image_id", sent.alias("s")).select("image_id", "s.*")
    for c, n in zip("xyz", volume.shape):
        rows = rows.where(F.col(c).between(0, n - 1))
    return volume.with_(rows.groupBy(*KEYS).agg(*(F.sum(n).alias(n) for n in names)))


def gradient(volume: Volume, value: str | tuple[str, str]) -> Volume:
    """gx, gy, gz by ahead() along every axis, in one shuffle; of complex volumes (two values)
    gx_re, gx_im and so on."""
    parts = {"": value} if isinstance(value, str) else dict(zip(PARTS, value))
    own = {f"g{c}{p}": F.when(F.col(c) < n - 1, F.col(v)).otherwise(0.0) for c, n in zip("xyz", volume.shape) for p, v in parts.items()}
    back = [({c: -k for c, k in _step(axis).items()}, {f"g{axis}{p}": -F.col(v) for p, v in parts.items()}) for axis in "xyz"]
    return _scattered(volume, [({c: 0 for c in "xyz"}, own), *back], list(own))


def complex_divergence(volume: Volume) -> Volume:
    """div_re and div_im of a complex gradient, in one shuffle."""
    g = {(axis, p): F.col(f"g{axis}{p}") for axis in "xyz" for p in PARTS}
    own = {f"div{p}": g["x", p] + g["y", p] + g["z", p] for p in PARTS}
    return _scattered(volume, [({c: 0 for c in "xyz"}, own), *((_step(axis), {f"div{p}": -g[axis, p] for p in PARTS}) for axis in "xyz")], list(own))


def complex_normalize_tv(volume: Volume, beta: float) -> Volume:
    """A complex gradient over the root of its squared magnitude plus beta."""
    names = [f"g{axis}{p}" for axis in "xyz" for p in PARTS]
    squares = F.lit(beta)
    for n in names:
        squares = squares + F.col(n) * F.col(n)
    return volume.map(**{n: F.col(n) / F.sqrt(squares) for n in names})


def divergence(volume: Volume, values: tuple[str, str, str] = ("gx", "gy", "gz"), name: str = "div") -> Volume:
    """The sum of behind() along the axes, in one shuffle."""
    g = [F.col(v) for v in values]
    return _scattered(volume, [({c: 0 for c in "xyz"}, {name: g[0] + g[1] + g[2]}), *((_step(axis), {name: -own}) for axis, own in zip("xyz", g))], [name])


def normalize_tv(volume: Volume, beta: float) -> Volume:
    """The gradient over the root of its squared length plus beta."""
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz") + beta)
    return volume.map(**{f"g{c}": F.col(f"g{c}") / length for c in "xyz"})


def tv_factor(div: Column, weight: float) -> Column:
    return 1 / F.greatest(1 - weight * div, F.lit(1e-8))


def total_variation(volume: Volume, value: str, weight: float) -> Volume:
    """div of the normalized gradient, with beta a tenth of the weight."""
    return divergence(normalize_tv(gradient(volume, value), 0.1 * weight))
