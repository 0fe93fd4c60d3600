"""Numpy kernels on one cube (z, y, x): the part of deconvolution that needs FFTs.
All are pure; convolution is circular on the cube."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAST = 1e-9


def otf(psf: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Transfer function: the PSF centred in a cube of zeros, its own centre (half its
    extent, by the floor) rolled to place 0."""
    if any(p > n for p, n in zip(psf.shape, shape)):
        raise ValueError(f"the PSF {psf.shape} does not fit the cube {shape}")
    cube = np.zeros(shape)
    start = [(n - p) // 2 for n, p in zip(shape, psf.shape)]
    cube[tuple(slice(s, s + p) for s, p in zip(start, psf.shape))] = psf
    return np.fft.rfftn(np.roll(cube, [-(s + p // 2) for s, p in zip(start, psf.shape)], axis=(0, 1, 2)))


_OTFS: dict[tuple, np.ndarray] = {}


def cached_otf(key: str, psf: Callable[[], np.ndarray], shape: tuple[int, int, int]) -> np.ndarray:
    """otf() of a PSF known by a key, kept by the worker for its next chunks; at most four
    are kept."""
    if (key, shape) not in _OTFS:
        while len(_OTFS) >= 4:
            del _OTFS[next(iter(_OTFS))]
        _OTFS[key, shape] = otf(psf(), shape)
    return _OTFS[key, shape]


def apply(f: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.fft.irfftn(np.fft.rfftn(f) * h, s=f.shape, axes=(0, 1, 2))


def spectrum(f: np.ndarray) -> np.ndarray:
    """The whole transform of a real cube: half of it is computed, the rest mirrored."""
    half, w = np.fft.rfftn(f), f.shape[2]
    out = np.empty(f.shape, half.dtype)
    out[:, :, : half.shape[2]] = half
    rest = half[::-1, ::-1, 1 : (w + 1) // 2][:, :, ::-1]
    out[:, :, half.shape[2] :] = np.conj(np.roll(rest, 1, axis=(0, 1)))
    return out


def _difference(v: np.ndarray, axis: int) -> np.ndarray:
    out = np.zeros_like(v)
    head = [slice(None)] * 3
    head[axis] = slice(0, -1)
    out[tuple(head)] = -np.diff(v, axis=axis)
    return out


def total_variation(f: np.ndarray, weight: float) -> np.ndarray:
    g = [_difference(f, axis) for axis in range(3)]
    length = np.sqrt(sum(x * x for x in g) + 0.1 * weight)
    return sum(np.diff(x / length, axis=axis, prepend=0) for axis, x in enumerate(g))


def convolution(g, h, **_):
    return apply(g, h)


def richardson_lucy(g, h, iterations=10, step: Callable = lambda f, n: f, **_):
    f = g.copy()
    for n in range(iterations):
        ratio = g / np.maximum(apply(f, h), LEAST)
        f = step(f * apply(ratio, np.conj(h)), n)
    return f


def richardson_lucy_tv(g, h, iterations=10, weight=0.001, **_):
    return richardson_lucy(g, h, iterations, lambda f, n: f / np.maximum(1 - weight * total_variation(f, weight), 1e-8))


def richardson_lucy_damped(g, h, iterations=10, **_):
    # each step's correction times 0.9 exp(-0.01 n); corrections do not build up in g
    f = g.copy()
    for n in range(iterations):
        ratio = g / np.maximum(apply(f, h), LEAST)
        f = f * apply(ratio, np.conj(h)) * (0.9 * np.exp(-0.01 * n))
    return f


def inverse_filter(g, h, epsilon=1e-6, **_):
    power = np.abs(h) ** 2
    q = np.where(power < epsilon, 0, np.fft.rfftn(g) * np.conj(h) / np.where(power < epsilon, 1, power))
    return np.fft.irfftn(q, s=g.shape, axes=(0, 1, 2))


def regularized_inverse(g, h, weight=0.001, epsilon=1e-9, **_):
    d, hh, w = g.shape
    cos = [np.cos(2 * np.pi * np.arange(n) / n) for n in (d, hh, w)]
    symbol = -2 * (cos[0][:, None, None] + cos[1][None, :, None] + cos[2][None, None, : w // 2 + 1] - 3)
    return np.fft.irfftn(np.fft.rfftn(g) * np.conj(h) / np.maximum(epsilon, np.abs(h) ** 2 + weight * symbol**2), s=g.shape, axes=(0, 1, 2))


def test_algorithm(g, h, weight=0.001, **_):
    return total_variation(g, weight)


#: Registered algorithms: kernel, and cubes of scratch it needs besides its input.
ALGORITHMS: dict[str, tuple[Callable, int]] = {
    "RichardsonLucy": (richardson_lucy, 2),
    "RichardsonLucyTotalVariation": (richardson_lucy_tv, 6),
    "RichardsonLucywithAdaptiveDamping": (richardson_lucy_damped, 1),
    "InverseFilter": (inverse_filter, 0),
    "RegularizedInverseFilter": (regularized_inverse, 5),
    "Convolution": (convolution, 0),
    "TestAlgorithm": (test_algorithm, 6),
}


def register(name: str, kernel: Callable, scratch: int = 2) -> None:
    ALGORITHMS[name] = (kernel, scratch)
