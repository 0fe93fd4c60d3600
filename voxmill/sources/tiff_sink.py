"""Writes of TIFF files, in two phases.

Slices are compressed in rows of their own, which are written to the shared folder; a
windowed sum of their sizes finds the place of each in its file. Tasks write slices,
several tasks for one image, at their places in a file of a temporary folder; when all are
written the files are moved to their names. Until then no file of the result is to be seen, and a repeated task writes the same
bytes to the same places. In a store without writes at places, a task streams the slices
of an image in their order instead."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill import chunks as ch
from voxmill.sources import tiff
from voxmill.sources.shared import new_folder
from voxmill.sources.tiff_source import store_of
from voxmill.volume import Shape

PACKED = "image_id long, z int, sizes array<int>, data binary"
RESULT = "image_id long, path string, bytes long, tasks long"
#: Bytes of slices, before they are compressed, that one task writes.
SLAB = 64 << 20


def _row(image: int, z: int, blocks: list[bytes]) -> dict:
    return {"image_id": image, "z": z, "sizes": [len(b) for b in blocks], "data": b"".join(blocks)}


def _placed(packed: DataFrame, shape: Shape, compression: int, tile: tuple[int, int] | None, kind: str) -> DataFrame:
    """(image_id, z, at, piece): the pieces of each image's file and where they begin."""
    w, h, d = shape
    big = w * h * d * 4 >= tiff.BIG
    n_blocks = -(-w // tile[0]) * -(-h // tile[1]) if tile else 1
    lists, own, first = tiff.lists_size(n_blocks, big), tiff.directory_size(bool(tile), big), len(tiff.header(0, big))

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pieces = []
            for r in part.itertuples(index=False):
                head = tiff.header(int(r.at) + len(r.data) + lists, big) if r.z == 0 else b""
                pieces.append(head + r.data + tiff.directory(w, h, [int(n) for n in r.sizes], int(r.at), int(r.following), compression, tile, big, kind))
            yield pd.DataFrame({"image_id": part["image_id"], "z": part["z"], "at": part["at"].where(part["z"] > 0, 0), "piece": pieces})

    # written once, so that sizes and data come of one computation and data are not shuffled again
    path = new_folder(packed.sparkSession, "packed")
    packed.withColumn("length", F.octet_length("data").cast("long")).write.parquet(path)
    packed = packed.sparkSession.read.schema(f"{PACKED}, length long").parquet(path)
    order = Window.partitionBy("image_id").orderBy("z")
    before = F.coalesce(F.sum(F.col("length") + lists + own).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = packed.select("image_id", "z", "length", (before + first).alias("at"))
    # the next slice's blocks begin behind this one's directory
    following = F.col("at") + F.col("length") + lists + own + F.lead("length").over(order) + lists
    places = places.select("image_id", "z", "at", F.coalesce(following, F.lit(0)).cast("long").alias("following"))
    return packed.drop("length").join(places, ["image_id", "z"]).mapInPandas(finish, "image_id long, z int, at long, piece binary")


def encode_slices(voxels: DataFrame, value: str, shape: Shape, compression: int = tiff.NONE, level: int = -1, tile: tuple[int, int] | None = None, kind: str = "f4") -> DataFrame:
    """(image_id, z, at, piece) of voxel rows."""
    w, h, _ = shape

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((h, w), np.float32)
        plane[part["y"].to_numpy(), part["x"].to_numpy()] = part[value].to_numpy()
        return pd.DataFrame([_row(key[0], key[1], tiff.slice_blocks(plane, compression, level, tile, kind))])

    packed = voxels.select("image_id", "x", "y", "z", value).groupBy("image_id", "z").applyInPandas(pack, PACKED)
    return _placed(packed, shape, compression, tile, kind)


def slab_depth(shape: Shape) -> int:
    return max(1, min(shape[2], SLAB // (shape[0] * shape[1] * 8)))


def encode_chunks(chunks: ch.Chunks, compression: int = tiff.NONE, level: int = -1, tile: tuple[int, int] | None = None, kind: str = "f4") -> DataFrame:
    """(image_id, z, at, piece) of chunks, which are gathered to slabs of whole slices."""
    w, h, _ = chunks.shape
    slabs = ch.rechunk(chunks, (w, h, slab_depth(chunks.shape)))
    layout, numbers = ch.Layout(slabs.shape, slabs.size), np.dtype(slabs.kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("image_id", pa.int64()), ("z", pa.int32()), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                place = tuple(row[c] for c in ch.PLACE)
                cube = np.frombuffer(row["data"], numbers).reshape(layout.extent(place)[::-1])
                for z, plane in enumerate(cube, layout.start(place)[2]):
                    yield pa.RecordBatch.from_pylist([_row(row["image_id"], z, tiff.slice_blocks(plane, compression, level, tile, kind))], schema)

    return _placed(slabs.rows.select("image_id", *ch.PLACE, "data").mapInArrow(pack, PACKED), chunks.shape, compression, tile, kind)


def _write_at(path: str, at: int, data: bytes) -> None:
    file = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        done = 0
        while done < len(data):
            done += os.pwrite(file, memoryview(data)[done:], at + done)
    finally:
        os.close(file)


def _delete(folder: str) -> None:
    from pyarrow import fs

    store, root = store_of(folder)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)


def write_tiff(pieces: DataFrame, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Writes the pieces of encode_slices() or encode_chunks() to folder/<name>.tiff in any store
    that Arrow reaches, and returns (image_id, path, bytes, tasks), tasks being how many wrote
    the file. names: (image_id, name); else images are named by their ids. If it fails no
    file is left."""
    spark: SparkSession = pieces.sparkSession
    at_places = ":" not in folder or folder.startswith("file:")
    temporary = f"{folder}/_temporary-{uuid.uuid4().hex}"

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(temporary)
        store.create_dir(root, recursive=True)
        image, out, task = None, None, TaskContext.get().partitionId()
        for part in parts:
            for r in part.itertuples(index=False):
                path = f"{root}/{r.name}.tiff"
                if at_places:
                    _write_at(path, int(r.at), r.piece)
                else:
                    if r.image_id != image:
                        if out is not None:
                            out.close()
                        image, out = r.image_id, store.open_output_stream(path)
                    out.write(r.piece)
            yield pd.DataFrame({"image_id": part["image_id"], "name": part["name"], "at": part["at"], "bytes": part["piece"].map(len), "task": task})
        if out is not None:
            out.close()

    def move(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(temporary)
        final = store_of(folder)[1]
        for part in parts:
            for r in part.itertuples(index=False):
                there = store.get_file_info([f"{root}/{r.name}.tiff", f"{final}/{r.name}.tiff"])
                # a repeated task finds its file moved
                if there[0].size is not None:
                    if r.bytes != r.end or there[0].size != r.bytes:
                        raise ValueError(f"{r.name}: {there[0].size} bytes written, {r.bytes} in pieces that end at {r.end}")
                    store.move(f"{root}/{r.name}.tiff", f"{final}/{r.name}.tiff")
                elif there[1].size != r.bytes:
                    raise FileNotFoundError(f"{root}/{r.name}.tiff")
            yield pd.DataFrame({"image_id": part["image_id"], "path": [f"{final}/{n}.tiff" for n in part["name"]], "bytes": part["bytes"], "tasks": part["tasks"]})

    named = pieces.join(names, "image_id") if names is not None else pieces.withColumn("name", F.col("image_id").cast("string"))
    dealt = named.select("image_id", "name", "z", "at", "piece")
    if not at_places:
        dealt = dealt.repartition("image_id").sortWithinPartitions("image_id", "z")
    written, moved = new_folder(spark, "written"), new_folder(spark, "moved")
    try:
        dealt.mapInPandas(write, "image_id long, name string, at long, bytes long, task int").write.parquet(written)
        sums = F.sum("bytes").alias("bytes"), F.max(F.col("at") + F.col("bytes")).alias("end"), F.count_distinct("task").alias("tasks")
        files = spark.read.parquet(written).groupBy("image_id", "name").agg(*sums)
        files.mapInPandas(move, RESULT).write.parquet(moved)
    finally:
        _delete(temporary)
    return spark.read.schema(RESULT).parquet(moved)
