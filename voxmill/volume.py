"""Volumes as voxel rows, and how rows of a table become one."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["image_id", "x", "y", "z"]
Shape = tuple[int, int, int]


@dataclass(frozen=True)
class Volume:
    """voxels: (image_id, x, y, z, value columns...), a row for every voxel of every
    image; shape: width, height and depth of each image."""

    voxels: DataFrame
    shape: Shape

    @property
    def values(self) -> list[str]:
        return [c for c in self.voxels.columns if c not in KEYS]

    def with_(self, voxels: DataFrame, shape: Shape | None = None) -> Volume:
        return replace(self, voxels=voxels, shape=shape or self.shape)

    def map(self, **values: Column) -> Volume:
        """New value columns in place of the old ones."""
        return self.with_(self.voxels.select(*KEYS, *(v.alias(k) for k, v in values.items())))

    def then(self, *operations) -> Volume:
        """Voxel operations, each from a dict of columns to one, in a single pass."""
        columns = {c: F.col(c) for c in self.values}
        for operation in operations:
            columns = operation(columns)
        return self.map(**columns)


def grid(images: DataFrame, shape: Shape) -> DataFrame:
    """All voxel places of the images."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    w, h, d = shape
    return images.select("image_id", axis(w).alias("x")).select("image_id", "x", axis(h).alias("y")).select("*", axis(d).alias("z"))


def voxelize(rows: DataFrame, image: Column, place: tuple[Column, Column, Column], shape: Shape, **sums: Column) -> Volume:
    """Sums of row values by voxel, 0 where no row falls. Zero rows of the grid join
    the same aggregation, so one shuffle makes the volume complete."""
    keyed = rows.select(image.cast("long").alias("image_id"), *(p.cast("int").alias(c) for p, c in zip(place, "xyz")), *(v.cast("double").alias(k) for k, v in sums.items()))
    zeros = grid(keyed.select("image_id").distinct(), shape).select("*", *(F.lit(0.0).alias(k) for k in sums))
    return Volume(keyed.unionByName(zeros).groupBy(*KEYS).agg(*(F.sum(k).alias(k) for k in sums)), shape)
