"""Reads of TIFF files: spark.read.format("tiff"), voxel rows, and pieces of chunks.

A file is read in shares of its slices, as many as its size asks for; a task reads the
directories and the blocks that it needs by ranges, so files may be larger than a task's
memory. Bounds of x, y and z, pushed down from filters or given as a box, prune slices, and
strips and tiles before they are read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from voxmill import chunks as ch
from voxmill.sources import tiff

#: Bytes of a file that a task reads.
TASK_BYTES = 32 << 20
NAMES = "*.{tif,tiff,ometif}"
VOXELS = "image_id long, x int, y int, z int, v float"
BLOCKS = "image_id long, path string, x int, y int, z int, w int, h int, data binary, bytes long"
Bounds = dict[str, tuple[int, int]]
KIND = "<f4"
EVERYWHERE = (0, 1 << 40)


def opened(path: str):
    """A file of any store that Arrow reaches, for reads by ranges."""
    store, name = store_of(path)
    return store.open_input_file(name)


def store_of(path: str):
    from pyarrow import fs

    path = re.sub("^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class Ranges:
    def __init__(self, path: str):
        self.file = opened(path)

    def read_at(self, n: int, at: int) -> bytes:
        return self.file.read_at(n, at)


def image_id(path: str) -> int:
    """Spark's xxhash64 of the path, which names an image."""
    import xxhash

    found = xxhash.xxh64_intdigest(path.encode(), 42)
    return found - (1 << 64) if found >= 1 << 63 else found


@dataclass
class Slice:
    """A slice of a file, with what it takes to read blocks of it."""

    file: Ranges
    page: tiff.Page
    sample: int
    z: int
    rows: tuple[int, int]
    columns: tuple[int, int]

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, int]]:
        return tiff.page_blocks(self.file, self.page, self.rows, self.columns, self.sample)

    def plane(self) -> np.ndarray:
        return tiff.read_page(self.file, self.page, self.rows, self.columns, self.sample)


def slices(path: str, channel: int, bounds: Bounds, share: int = 0, shares: int = 1) -> Iterator[Slice]:
    """The slices of one share of a file that lie inside the bounds."""
    file = Ranges(path)
    found = tiff.pages(file)
    about = tiff.about(found)
    depth = about["depth"]
    cut = lambda axis, n: tuple(min(max(0, b), n) for b in bounds.get(axis, EVERYWHERE))
    lo, hi = cut("z", depth)
    rows, columns = cut("y", about["height"]), cut("x", about["width"])
    for z in range(max(lo, -(-share * depth // shares)), min(hi, -(-(share + 1) * depth // shares))):
        if rows[0] < rows[1] and columns[0] < columns[1]:
            yield Slice(file, *tiff.slice_page(found, about, channel, z), z, rows, columns)


def voxel_batches(path: str, channel: int, bounds: Bounds, share: int = 0, shares: int = 1) -> Iterator[pa.RecordBatch]:
    image = image_id(path)
    for own in slices(path, channel, bounds, share, shares):
        plane = own.plane()
        y, x = (i.ravel() for i in np.indices(plane.shape, np.int32))
        yield pa.RecordBatch.from_pydict({"image_id": pa.array(np.full(len(x), image)), "x": pa.array(x + np.int32(own.columns[0])), "y": pa.array(y + np.int32(own.rows[0])), "z": pa.array(np.full(len(x), own.z, np.int32)), "v": pa.array(plane.ravel())})


def block_batches(path: str, channel: int, bounds: Bounds, share: int = 0, shares: int = 1) -> Iterator[pa.RecordBatch]:
    """A row for each block of the file that begins inside the bounds: its values as float32,
    and the bytes that were read for it."""
    image = image_id(path)
    for own in slices(path, channel, bounds, share, shares):
        for y, x, block, size in own.blocks():
            if own.rows[0] <= y and own.columns[0] <= x:
                one = {"image_id": image, "path": path, "x": x, "y": y, "z": own.z, "w": block.shape[1], "h": block.shape[0], "data": block.astype("<f4").tobytes(), "bytes": size}
                yield pa.RecordBatch.from_pylist([one], pa.schema([("image_id", pa.int64()), ("path", pa.string()), *((c, pa.int32()) for c in "xyzwh"), ("data", pa.binary()), ("bytes", pa.int64())]))


@dataclass
class Share(InputPartition):
    path: str
    share: int
    shares: int


class TiffReader(DataSourceReader):
    """Filters on x, y and z by comparison with numbers, and on image_id by equality, are
    met here; others are left to Spark."""

    def __init__(self, options: dict[str, str]):
        self.path, self.channel = options["path"], int(options.get("channel", 0))
        self.batches = {"voxels": voxel_batches, "blocks": block_batches}[options.get("rows", "voxels")]
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.bounds: Bounds = {}
        self.images: set[int] | None = None

    def _narrow(self, axis: str, lo: int, hi: int) -> None:
        a, b = self.bounds.get(axis, EVERYWHERE)
        self.bounds[axis] = max(a, lo), min(b, hi)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        end = EVERYWHERE[1]
        ranges = {EqualTo: lambda v: (v, v + 1), GreaterThan: lambda v: (v + 1, end), GreaterThanOrEqual: lambda v: (v, end), LessThan: lambda v: (0, v), LessThanOrEqual: lambda v: (0, v + 1)}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in ("x", "y", "z") and type(f) in ranges and isinstance(f.value, int):
                self._narrow(name, *ranges[type(f)](f.value))
            elif name == "image_id" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.images = wanted if self.images is None else self.images & wanted
            elif not isinstance(f, IsNotNull):  # no column is ever null
                if name in ("x", "y", "z") and isinstance(f, In) and f.value:
                    self._narrow(name, min(f.value), max(f.value) + 1)  # no more than that; Spark drops the rest
                yield f

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        store, root = store_of(self.path)
        about = store.get_file_info(root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if about.type == fs.FileType.Directory else [about]
        # paths as Spark writes them
        scheme = "file:" if isinstance(store, fs.LocalFileSystem) else self.path.rstrip("/").removesuffix(root.rstrip("/"))
        hidden = lambda path: any(p[:1] in "_." for p in path[len(root) :].split("/") if p)
        out = []
        for file in sorted(found, key=lambda f: f.path):
            if file.type == fs.FileType.File and (file.path == root or re.search(r"\.(tif|tiff|ometif)$", file.path) and not hidden(file.path)):
                path = scheme + file.path
                if self.images is None or image_id(path) in self.images:
                    n = max(1, -(-file.size // self.task_bytes))
                    out += [Share(path, i, n) for i in range(n)]
        return out or [Share("", 0, 1)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from self.batches(partition.path, self.channel, self.bounds, partition.share, partition.shares)


class TiffSource(DataSource):
    """spark.read.format("tiff").load(path): voxel rows of all TIFF files under a path. Options:
    channel; rows: "voxels" or "blocks", the file's own blocks as binary rows; taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return BLOCKS if self.options.get("rows") == "blocks" else VOXELS

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("tiff") known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, length) of every TIFF file under a path or pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", NAMES).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "length")


def list_slices(spark: SparkSession, path: str) -> DataFrame:
    """(path, z, depth, width, height, channels, samples): the slices of every TIFF file under
    path, from its directories alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                about = tiff.metadata(Ranges(name))
                n = about["depth"]
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * n), "z": pa.array(range(n), pa.int32()), **{k: pa.array([about[k]] * n, pa.int32()) for k in ("depth", "width", "height", "channels", "samples")}})

    return list_files(spark, path).select("path").mapInArrow(read, "path string, z int, depth int, width int, height int, channels int, samples int")


def _shares(spark: SparkSession, path: str) -> DataFrame:
    """(path, share, shares), each in a task of its own as far as there are tasks."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / TASK_BYTES)).cast("int")
    rows = list_files(spark, path).select("path", n.alias("shares")).select("path", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "shares")
    return rows.repartition("path", "share")


def _each(spark: SparkSession, path: str, schema: str, batches) -> DataFrame:
    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                yield from batches(row["path"], row["share"], row["shares"])

    return _shares(spark, path).mapInArrow(read, schema)


def read_tiff(spark: SparkSession, path: str, channel: int = 0, **box: tuple[int, int] | None) -> DataFrame:
    """(image_id, x, y, z, v): the voxels of every TIFF file under path inside the box of bounds
    x, y, z [a, b). A box that reaches beyond an image is cut to it."""
    bounds = {k: v for k, v in box.items() if v}
    return _each(spark, path, VOXELS, lambda name, share, shares: voxel_batches(name, channel, bounds, share, shares))


def read_pieces(spark: SparkSession, path: str, layout: ch.Layout, channel: int = 0) -> DataFrame:
    """What every chunk of a layout reads of the images, in numbers of KIND: slices are cut where
    they are read, and no voxel has a row of its own."""

    def batches(name: str, share: int, shares: int) -> Iterator[pa.RecordBatch]:
        image = image_id(name)
        for own in slices(name, channel, {}, share, shares):
            cube = own.plane()[None]
            parts = list(ch.split(cube, (0, 0, own.z), layout))
            if parts:
                yield ch.piece_batch({"image_id": pa.array(np.full(len(parts), image))}, (0, 0, own.z), (cube.shape[2], cube.shape[1], 1), parts)

    return _each(spark, path, ch.piece_schema("image_id long"), batches)
