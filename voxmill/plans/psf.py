"""Point-spread functions as table functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.volume import Shape, Volume, grid


def gaussian(images: DataFrame, shape: Shape) -> Volume:
    """images: (image_id, sigma_x, sigma_y, sigma_z). Gaussians around the middle,
    (n - 1) / 2, cut at 5 sigma and normalized to sum 1."""
    places = grid(images, shape).join(images, "image_id")
    u = [(F.col(c) - (n - 1) / 2) / F.col(f"sigma_{c}") for c, n in zip("xyz", shape)]
    near = F.lit(True)
    for c, n in zip("xyz", shape):
        middle, reach = (n - 1) / 2, 5 * F.col(f"sigma_{c}")
        near = near & F.col(c).between(F.floor(middle - reach), F.ceil(middle + reach))
    raw = places.select("image_id", "x", "y", "z", F.when(near, F.exp(-0.5 * (u[0] * u[0] + u[1] * u[1] + u[2] * u[2]))).otherwise(0.0).alias("v"))
    sums = raw.groupBy("image_id").agg(F.sum("v").alias("_sum"))
    return Volume(raw.join(sums, "image_id").select("image_id", "x", "y", "z", (F.col("v") / F.col("_sum")).alias("v")), shape)


def gaussian_halo(strategy: str, shape: Shape, sigma: tuple[float, float, float]) -> Shape | None:
    """The extent that a strategy asks for; None where the settings give it (manual)."""
    return {"none": (0, 0, 0), "parent": tuple(int(4 * s) for s in sigma), "full_psf": shape}.get(strategy)


def gibson_lanni_halo(strategy: str, shape: Shape) -> Shape | None:
    return {"none": (0, 0, 0), "parent": tuple(n // 2 for n in shape), "full_psf": shape}.get(strategy)


def j0(x: np.ndarray) -> np.ndarray:
    """Bessel's J0 by its integral over half a turn; the trapezoid rule is exact but for
    terms that vanish faster than any power once its steps outnumber x."""
    steps = int(np.max(np.abs(x), initial=0)) + 32
    angle = (np.arange(steps) + 0.5) * np.pi / steps
    return np.cos(np.multiply.outer(x, np.sin(angle))).mean(axis=-1)


#: Agreeing refinements in a row for accuracies; 3 for all others.
AGREEMENTS = {0: 4, 1: 5, 2: 6}


#: Simpson's rule halves its steps up to so many.
MOST_STEPS = 1 << 14


def gibson_lanni_profiles(radii: np.ndarray, particles: np.ndarray, defocus: np.ndarray, wavelength: float, na: float, ns: float, ni: float, tolerance: float = 1e-3, accuracy: int = 3) -> np.ndarray:
    """The squared diffraction integral of planes (particle depth, defocus) at radii (all lengths
    in one unit), nine times, as the rule's sums are not divided by 3. Steps are halved until,
    so many times in a row as the accuracy asks for, a value changes by no more than its
    share `tolerance`; each plane's radius ends on its own. Nodes and their Bessel values
    serve all planes, and those of larger steps stay in the sums."""
    k, top = 2 * np.pi / wavelength, min(1.0, ns / na, ni / na)

    def at(rho: np.ndarray) -> np.ndarray:
        path = ns * np.multiply.outer(particles, np.sqrt(np.maximum(0, 1 - (na * rho / ns) ** 2))) + ni * np.multiply.outer(defocus, np.sqrt(np.maximum(0, 1 - (na * rho / ni) ** 2)))
        return (np.exp(1j * k * path) * rho) @ j0(np.multiply.outer(k * na * radii, rho)).T

    n, step = 2, top / 2
    ends, even, odd = at(np.array([0.0, top])), 0, at(np.array([step]))
    value = np.abs(ends + 4 * odd) ** 2 * step**2
    agreed, wanted = np.zeros(value.shape, int), AGREEMENTS.get(accuracy, 3)
    while (going := agreed < wanted).any() and n < MOST_STEPS:
        n, step = 2 * n, step / 2
        even, odd = even + odd, at(np.arange(1, n, 2) * step)
        new = np.abs(ends + 2 * even + 4 * odd) ** 2 * step**2
        near = np.abs(value - new) <= tolerance * np.where(value == 0, 1e-5, new)
        agreed = np.where(going, np.where(near, agreed + 1, 0), agreed)
        value = np.where(going, new, value)
    return value


def gibson_lanni(images: DataFrame, shape: Shape, pixel: float = 100.0, slice_: float = 100.0, wavelength: float = 450.0, ns: float = 1.33, ni: float = 1.515, oversampling: int = 2, tolerance: float = 1e-3, accuracy: int = 3) -> Volume:
    """images: (image_id, na, particle). Each distinct (na, particle) is worked out once, for all
    planes; its radial profiles are joined to the images that have it, interpolated to their
    pixels and cut at ten Airy radii."""
    w, h, d = shape
    steps = np.arange(int(np.ceil(np.hypot((w - 1) / 2, (h - 1) / 2) * oversampling)) + 2)

    def profiles(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        defocus = slice_ * (np.arange(d) - (d - 1) / 2)
        found = gibson_lanni_profiles(steps / oversampling * pixel, np.full(d, key[1]), defocus, wavelength, key[0], ns, ni, tolerance, accuracy)
        return pd.DataFrame({"na": key[0], "particle": key[1], "z": np.arange(d, dtype="int32"), "profile": list(found)})

    # a number of partitions of its own keeps Spark from putting all this work in one task
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = images.select("na", "particle").distinct().repartition(parts, "na", "particle")
    known = distinct.groupBy("na", "particle").applyInPandas(profiles, "na double, particle double, z int, profile array<double>")
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = images.join(known, ["na", "particle"]).select("*", axis(w).alias("x")).select("*", axis(h).alias("y"))
    r = F.sqrt((F.col("x") - (w - 1) / 2) * (F.col("x") - (w - 1) / 2) + (F.col("y") - (h - 1) / 2) * (F.col("y") - (h - 1) / 2))
    rows = rows.select("image_id", "x", "y", "z", "na", "profile", (r * oversampling).alias("t")).withColumn("i", F.floor("t").cast("int"))
    low, high = F.get("profile", F.col("i")), F.get("profile", F.col("i") + 1)
    near = F.col("t") / oversampling <= 10 * 0.61 * wavelength / (F.col("na") * pixel)
    return Volume(rows.select("image_id", "x", "y", "z", F.when(near, low + (F.col("t") - F.col("i")) * (high - low)).otherwise(0.0).alias("v")), shape)


#: Defaults of configurations.
DEFAULTS = {"size_x": 20, "size_y": 20, "size_z": 10, "sigma_x": 10.0, "sigma_y": 10.0, "sigma_z": 10.0, "NA": 1.4, "lambda_nm": 450.0, "sample_ri": 1.33, "immersion_ri": 1.515, "particle_axial_position_nm": 0.0, "pixel_size_lateral_nm": 100.0, "pixel_size_axial_nm": 100.0, "accuracy": 3}


@dataclass(frozen=True)
class Model:
    """make: the volume of a configuration at a shape; halo: the extent that a padding
    strategy asks for, from the configured shape."""

    make: Callable[[SparkSession, dict, Shape], Volume]
    halo: Callable[[str, dict, Shape], Shape | None]


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("image_id"), *(F.lit(float(v)).alias(k) for k, v in values.items()))


def _gaussian(spark: SparkSession, v: dict, shape: Shape) -> Volume:
    return gaussian(_one(spark, **{f"sigma_{c}": v[f"sigma_{c}"] for c in "xyz"}), shape)


def _gibson_lanni(spark: SparkSession, v: dict, shape: Shape) -> Volume:
    images = _one(spark, na=v["NA"], particle=v["particle_axial_position_nm"])
    return gibson_lanni(images, shape, v["pixel_size_lateral_nm"], v["pixel_size_axial_nm"], v["lambda_nm"], v["sample_ri"], v["immersion_ri"], accuracy=v["accuracy"])


#: Models by name, as configurations write them.
MODELS: dict[str, Model] = {
    "Gaussian": Model(_gaussian, lambda strategy, v, shape: gaussian_halo(strategy, shape, tuple(v[f"sigma_{c}"] for c in "xyz"))),
    "GibsonLanni": Model(_gibson_lanni, lambda strategy, v, shape: gibson_lanni_halo(strategy, shape)),
}


def register(name: str, model: Model) -> None:
    MODELS[name] = model


def model(values: dict) -> Model:
    if values.get("model_name") not in MODELS:
        raise ValueError(f"model_name must be one of {sorted(MODELS)}")
    return MODELS[values["model_name"]]


def configured_shape(values: dict) -> Shape:
    v = DEFAULTS | values
    return tuple(int(v[f"size_{c}"]) for c in "xyz")
