"""Token ids as directly addressable codes (DAC).

Each id is cut into 8-bit chunks. Level 0 holds the low chunk of every id, and
a bitmap says which ids go on; level 1 holds the next chunk of those, and so on.
The rank directory of each bitmap counts the set bits before every block of 512,
so any id of a segment is found with one lookup per level and no block is ever
decoded.

File format: Parquet rows, one for each segment, so that Spark's committer makes
writes atomic and any store that Spark knows will do. Segments hold whole
documents in ascending doc_id order: `part` is the range partition and `seg` the
segment in it.

Rows: null text is empty text and yields the end id alone; a null doc_id sorts
first; rows with the same doc_id are documents of their own, in the order of
their texts; other columns are ignored; no rows give no segments."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.llm.common import partitions, shared_dir, text_slices
from voxmill.llm.encoder import Encoder, tokenizer_path

END_ID, SEGMENT_TOKENS, BLOCK = 1, 1 << 20, 512
#: Places of one segment that are looked up together.
ASKED = 1 << 16
SEGMENT = "part int, seg int, n_tokens long, doc_ids binary, doc_sizes binary, chunks array<binary>, more array<binary>, ranks array<binary>"


def dac_encode(ids: np.ndarray) -> dict[str, list[bytes]]:
    """Chunk levels, continuation bitmaps and rank directories of unsigned ids."""
    out: dict[str, list[bytes]] = {"chunks": [], "more": [], "ranks": []}
    rest = ids.astype(np.uint32)
    while True:
        out["chunks"].append((rest & 0xFF).astype(np.uint8).tobytes())
        on = rest > 0xFF
        counts = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        out["more"].append(np.packbits(on, bitorder="little").tobytes())
        out["ranks"].append((np.cumsum(counts) - counts).astype("<u4").tobytes())
        if not on.any():
            return out
        rest = rest[on] >> 8


def dac_decode(chunks: list[bytes], more: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.zeros(len(chunks[0]), np.uint32)
    at = np.arange(len(ids))
    for level, (own, bits) in enumerate(zip(chunks, more)):
        ids[at] |= np.frombuffer(own, np.uint8).astype(np.uint32) << np.uint32(8 * level)
        at = at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at), bitorder="little").astype(bool)]
    return ids


def dac_access(chunks: list[bytes], more: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place i, by one rank query for each further level."""
    out = 0
    for level, (own, bits, directory) in enumerate(zip(chunks, more, ranks)):
        out |= own[i] << (8 * level)
        if not bits[i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK
        before = int.from_bytes(bits[block * BLOCK // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * BLOCK)) - 1)
        i = int.from_bytes(directory[4 * block : 4 * block + 4], "little") + before.bit_count()
    return out


def _segments(path: str, segment_tokens: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seg = Encoder(path), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = {"part": part, "seg": seg, "n_tokens": len(ids), "doc_ids": np.concatenate(docs).tobytes(), "doc_sizes": np.concatenate(sizes).astype("<u4").tobytes(), **dac_encode(ids)}
            held.clear(), docs.clear(), sizes.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_sizes", pa.binary()), *((x, pa.list_(pa.binary())) for x in ("chunks", "more", "ranks"))])
        for batch in batches:
            for piece in text_slices(batch, 8 << 20):
                found = encoder.encode(piece.column("text"))
                ids = np.insert(found["ids"], found["bounds"][1:], END_ID)
                size = np.diff(found["bounds"]) + 1
                own = piece.column("doc_id")
                # null ids travel as the smallest long, which sorts where nulls do
                names = np.asarray(own.fill_null(np.iinfo(np.int64).min)).astype("<i8")
                upto = np.concatenate([[0], np.cumsum(size)])
                first = 0
                while first < len(size):
                    room = max(0, segment_tokens - sum(map(len, held)))
                    last = min(len(size), max(first + (not held), int(np.searchsorted(upto, upto[first] + room, "right")) - 1))
                    if last > first:
                        held.append(ids[upto[first] : upto[last]])
                        docs.append(names[first:last])
                        sizes.append(size[first:last])
                    if last < len(size):
                        yield flush()
                        seg += 1
                    first = last
        if held:
            yield flush()

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, segment_tokens: int = SEGMENT_TOKENS, n_parts: int | None = None) -> None:
    """Encodes whole texts of (doc_id, text), appends END_ID to each, and writes
    segments in ascending doc_id order under path."""
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n_parts or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer or tokenizer_path(), segment_tokens), SEGMENT).write.parquet(path)


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = dac_decode(row["chunks"], row["more"]).astype("<u4")
            names = np.frombuffer(row["doc_ids"], "<i8")
            sizes = np.frombuffer(row["doc_sizes"], "<u4").astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1], upto[1:])]
            n = len(names)
            yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * n, pa.int32()), "seg": pa.array([row["seg"]] * n, pa.int32()), "doc_id": pa.array(names, mask=names == np.iinfo(np.int64).min), "at": pa.array(upto[:-1]), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())})


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seg, first): ids before each segment. The window over parts has a
    row for each range partition; segments are summed inside their part."""
    sizes = spark.read.schema(SEGMENT).parquet(path).select("part", "seg", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    inside = sizes.select("part", "seg", before(Window.partitionBy("part").orderBy("seg")).alias("inner"))
    return inside.join(parts, "part").select("part", "seg", (F.col("base") + F.col("inner")).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: (doc_id, start, n_tokens, ids_crc32) of each document."""
    found = spark.read.schema(SEGMENT).parquet(path).mapInArrow(_per_document, "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    placed = found.join(segment_starts(spark, path), ["part", "seg"])
    return placed.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place long) to (place, token): the ids at distinct places of the whole stream,
    each found in its segment by rank queries. Places meet segments by equal stretches
    of the stream; a segment is read once for each ASKED places wanted of it."""
    starts = segment_starts(spark, path).join(spark.read.schema(SEGMENT).parquet(path).select("part", "seg", "n_tokens"), ["part", "seg"])
    end = F.col("first") + F.col("n_tokens")
    stretch = F.explode(F.sequence(F.expr(f"first div {SEGMENT_TOKENS}"), F.expr(f"(first + n_tokens - 1) div {SEGMENT_TOKENS}")))
    spread = starts.withColumn("stretch", stretch)
    asked = places.select(F.col("place").cast("long").alias("place")).where("place >= 0").distinct().withColumn("stretch", F.expr(f"place div {SEGMENT_TOKENS}"))
    met = asked.join(spread, "stretch").where((F.col("place") >= F.col("first")) & (F.col("place") < end))
    lists = met.groupBy("part", "seg", "first", F.expr(f"(place - first) div {ASKED}").alias("own")).agg(F.collect_list("place").alias("places"))
    wanted = spark.read.schema(SEGMENT).parquet(path).select("part", "seg", "chunks", "more", "ranks").join(lists, ["part", "seg"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [dac_access(row["chunks"], row["more"], row["ranks"], p - row["first"]) for p in row["places"]]
                yield pa.RecordBatch.from_pydict({"place": pa.array(row["places"], pa.int64()), "token": pa.array(found, pa.int64())})

    return wanted.select("first", "chunks", "more", "ranks", "places").mapInArrow(look_up, "place long, token long")


def token_binary(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_documents(spark, path)
