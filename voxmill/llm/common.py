"""Small helpers that the large-corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.sources.shared import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII white space, as the word contracts define it.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it
    back, so that lost executors never cost more than the stage at hand."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the shuffles of this write are of no more use
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are materialized inside the block when it ends, but for
    the last one. For blocks whose result is materialized last."""
    first = len(_MADE)
    yield
    for path in _MADE[first:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _MADE[first:-1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does just that for pure ASCII and
    is much faster than translate()."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about `limit` bytes of its column `text` each, so
    that the scratch arrays of a task do not grow with the batch."""
    sizes = np.asarray(_lengths(batch.column("text")))
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _lengths(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0)


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and each text's bounds in them;
    null counts as empty."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] numbers, one i after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Fixed pseudorandom 64-bit value of each byte, and the odd base of the
#: polynomial hashes below with its inverse modulo 2**64.
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < len(out):
        k = min(done, len(out) - done)
        out[done : done + k] = out[:k] * np.uint64(step)
        done, step = done + k, step * step % (1 << 64)
    return out


_POWERS: dict[str, np.ndarray] = {}


def cached_powers(name: str, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = _POWERS[name] = powers(BASE if name == "up" else INVERSE, max(n, 1 << 16))
    return have


#: Pseudorandom odd factors of the first places in a word.
PLACE_CODE = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """64-bit hash of each word raw[start:end]; words ascend and lie apart. Every
    place of a word has a factor of its own: powers of one base modulo 2**64 would
    let long words of a few letters cancel (those of Thue and Morse do)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place, longest = np.zeros(len(raw), np.int32), int((end - start).max())
    place[start] = start
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(raw), dtype=np.int32), place, out=place)
    if longest <= len(PLACE_CODE):
        factor = PLACE_CODE.take(place, mode="clip")
    else:
        factor = mix64((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(code[raw] * factor, out=total[1:])
    return mix64(total[end] - total[start] + (end - start).astype(np.uint64))


def prefix_hash(raw: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """h with h[j] - h[i] = sum of code[raw[t]] * BASE**t over i <= t < j."""
    h = np.zeros(len(raw) + 1, np.uint64)
    x = code.take(raw)
    x *= cached_powers("up", len(raw))[: len(raw)]
    np.cumsum(x, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[start:end], the same wherever the bytes stand. For spans of
    some hundred bytes at most, which may overlap; longer ones need word_hash()."""
    return mix64((h[end] - h[start]) * cached_powers("down", len(h))[start] + (end - start).astype(np.uint64))


def sliding_hash(h: np.ndarray, a: int, b: int, n: int) -> np.ndarray:
    """span_hash() of raw[i : i + n] for each i from a to b - 1."""
    x = h[a + n : b + n] - h[a:b]
    x *= cached_powers("down", len(h))[a:b]
    x += np.uint64(n)
    return mix64(x)
