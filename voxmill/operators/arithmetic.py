"""Elementwise real and complex arithmetic, as column expressions. A complex value is
a pair of columns (real part, imaginary part)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.volume import KEYS, Volume

Complex = tuple[Column, Column]


def combine(a: Volume, b: Volume) -> Volume:
    """Both volumes' values side by side: a 1:1 join on places."""
    if a.shape != b.shape:
        raise ValueError(f"shapes differ: {a.shape} and {b.shape}")
    return a.with_(a.voxels.join(b.voxels, KEYS))


def divide(a: Column, b: Column, least: float) -> Column:
    """a / b, with b raised to least."""
    return a / F.when(b < least, least).otherwise(b)


def add(a: Complex, b: Complex) -> Complex:
    return a[0] + b[0], a[1] + b[1]


def scale(a: Complex, s: float) -> Complex:
    return a[0] * s, a[1] * s


def multiply(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conjugate(a: Complex) -> Complex:
    return a[0], -a[1]


def multiply_conjugate(a: Complex, b: Complex) -> Complex:
    return multiply(a, conjugate(b))


def norm(a: Complex) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def divide_complex(a: Complex, b: Complex, least: float) -> Complex:
    """a / b, and 0 where |b|^2 is below least."""
    top, n = multiply_conjugate(a, b), norm(b)
    return tuple(F.when(n < least, 0.0).otherwise(t / F.when(n < least, 1.0).otherwise(n)) for t in top)


def divide_stabilized(a: Complex, b: Complex, least: float) -> Complex:
    """a conj(b) / max(least, |b|^2)."""
    top, n = multiply_conjugate(a, b), F.greatest(F.lit(least), norm(b))
    return top[0] / n, top[1] / n


def magnitude(a: Complex) -> Column:
    return F.sqrt(norm(a))


def laplacian_symbol(volume: Volume) -> Column:
    """The Laplacian's factor at a frequency: -2 (cos wx + cos wy + cos wz - 3)."""
    waves = [F.cos(2 * F.pi() * F.col(c) / n) for c, n in zip("xyz", volume.shape)]
    return -2 * (waves[0] + waves[1] + waves[2] - 3)


def in_range(v: Column, lo: float, hi: float) -> Column:
    """1 in the closed range, else 0."""
    return F.when(v.between(lo, hi), 1.0).otherwise(0.0)
