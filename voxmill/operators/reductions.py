"""Reductions of volumes, each one aggregation with partial sums on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.arithmetic import Complex
from voxmill.volume import KEYS, Volume


def total(volume: Volume, **values: Column) -> DataFrame:
    return volume.voxels.groupBy("image_id").agg(*(F.sum(v).alias(k) for k, v in values.items()))


def mean_square_error(volume: Volume, a: Complex, b: Complex) -> DataFrame:
    dr, di = a[0] - b[0], a[1] - b[1]
    return volume.voxels.groupBy("image_id").agg(F.avg(dr * dr + di * di).alias("mse"))


def add_all(volumes: list[Volume]) -> Volume:
    """The voxelwise sum of volumes with the same values."""
    rows = volumes[0].voxels
    for v in volumes[1:]:
        rows = rows.unionByName(v.voxels)
    return volumes[0].with_(rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in volumes[0].values)))


def sum_to_one(masks: DataFrame, weight: str = "weight") -> DataFrame:
    """Each voxel's weights over their sum, 0 where that is 0."""
    whole = F.sum(weight).over(Window.partitionBy(*KEYS))
    return masks.withColumn(weight, F.when(whole == 0, 0.0).otherwise(F.col(weight) / F.when(whole == 0, 1.0).otherwise(whole)))


def maximum(volume: Volume, value: str) -> DataFrame:
    """The greatest value, 0 at least."""
    return volume.voxels.groupBy("image_id").agg(F.greatest(F.max(value), F.lit(0.0)).alias("max"))


def region_above(volume: Volume, value: str, threshold: float) -> DataFrame:
    """Extent of the bounding box of greater values; 0 without any."""
    above = F.col(value) > threshold
    extent = lambda c: F.coalesce(F.max(F.when(above, F.col(c))) - F.min(F.when(above, F.col(c))) + 1, F.lit(0))
    return volume.voxels.groupBy("image_id").agg(extent("x").alias("width"), extent("y").alias("height"), extent("z").alias("depth"))


def normalize_channel(volume: Volume, value: str) -> Volume:
    """Negatives to 0, then min-max to [0, 1], below 1e-6 to 0; a constant image is
    0. Extremes come from a small aggregate joined back, not a window that would
    hold an image in a task."""
    clean = volume.voxels.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    ends = clean.groupBy("image_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return volume.with_(clean.join(ends, "image_id").select(*KEYS, F.when(F.coalesce(v, F.lit(0.0)) < 1e-6, 0.0).otherwise(v).alias(value)))


def equal(a: Volume, b: Volume, value: str, tolerance: float) -> DataFrame:
    """By image: same places, NaN in the same ones, no difference over tolerance."""
    x, y = F.col("a.v"), F.col("b.v")
    left = a.voxels.select(*KEYS, F.col(value).alias("v")).alias("a")
    right = b.voxels.select(*KEYS, F.col(value).alias("v")).alias("b")
    same = x.isNotNull() & y.isNotNull() & F.when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y)).otherwise(F.abs(x - y) <= tolerance)
    return left.join(right, KEYS, "full").groupBy("image_id").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("equal"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_different"))


def finite_statistics(volume: Volume, value: str) -> DataFrame:
    """Counts of NaN and infinities, and extremes of the finite values."""
    v = F.col(value)
    infinite = v.isin(float("inf"), float("-inf"))
    finite = F.when(~F.isnan(v) & ~infinite, v)
    return volume.voxels.groupBy("image_id").agg(F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(infinite).alias("n_inf"), F.min(finite).alias("least"), F.max(finite).alias("greatest"))


def largest_shape(shapes: DataFrame) -> DataFrame:
    """The greatest extent along each axis of (width, height, depth) rows, 0 of none."""
    return shapes.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("width", "height", "depth")))


def subcubes(shapes: DataFrame, cube: tuple[int, int, int]) -> DataFrame:
    """Cubes that cover each shape, and its volume."""
    parts = [F.ceil(F.col(c) / n) for c, n in zip(("width", "height", "depth"), cube)]
    return shapes.withColumn("n_cubes", (parts[0] * parts[1] * parts[2]).cast("long")).withColumn("volume", F.col("width").cast("long") * F.col("height") * F.col("depth"))
