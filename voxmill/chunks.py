"""Volumes as rows of binary chunks, for images of any size.

A chunk row (image_id, cx, cy, cz, data) holds a block of an image, row-major along z, y, x.
Work that needs neighbours goes by pieces: of every block, what each chunk that reads it
needs, with its halo, is sent there in one shuffle, so of a neighbour only faces, edges and
corners travel. Work along an axis (a transform, a distance) gathers the chunks of one line
of chunks; no task ever holds an image.

Chunks of an axis begin where its tiles do: at multiples of the size, the last one moved back
so that it is whole; where two would overlap the later one has the voxels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.plans.tiles import axis_starts
from voxmill.volume import KEYS, Shape, Volume

PLACE = ["cx", "cy", "cz"]
REAL, COMPLEX = "<f8", "<c16"
FALLOFF: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "linear": lambda t: 1 - t,
    "quadratic": lambda t: (1 - t) ** 2,
    "sinusoid": lambda t: np.cos(np.pi / 2 * t) ** 2,
    "gaussian": lambda t: np.exp(-(t**2)),
}
FILLS = ("zero", "mirror", *FALLOFF)


@lru_cache(maxsize=1024)
def edges(n: int, size: int) -> tuple[int, ...]:
    """Where the chunks of an axis begin, and its end."""
    return (*axis_starts(n, size), n)


@dataclass(frozen=True)
class Chunks:
    """rows: (keys..., cx, cy, cz, data); shape of the images, size of a chunk, kind of
    the numbers in data."""

    rows: DataFrame
    shape: Shape
    size: Shape
    kind: str = REAL
    keys: tuple[str, ...] = ("image_id",)

    def schema(self) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        return ", ".join(f"`{k}` {kinds[k]}" for k in self.keys) + ", cx int, cy int, cz int, data binary"


@dataclass(frozen=True)
class Layout:
    """Chunks of a size with a halo; all padded chunks have one shape, so that of a chunk which
    a later one cuts short is wider."""

    shape: Shape
    size: Shape
    before: Shape = (0, 0, 0)
    after: Shape = (0, 0, 0)
    fill: str = "zero"

    def __post_init__(self):
        if self.fill not in FILLS:
            raise ValueError(f"fill must be one of {FILLS}")

    @property
    def full(self) -> Shape:
        return tuple(s + a + b for s, a, b in zip(self.size, self.before, self.after))

    def axis(self, a: int) -> tuple:
        return self.shape[a], self.size[a], self.before[a], self.after[a], self.fill

    def start(self, place: Shape) -> Shape:
        return tuple(edges(n, s)[c] for n, s, c in zip(self.shape, self.size, place))

    def extent(self, place: Shape) -> Shape:
        """The chunk's own voxels along each axis."""
        return tuple(edges(n, s)[c + 1] - edges(n, s)[c] for n, s, c in zip(self.shape, self.size, place))

    def weights(self, place: Shape) -> np.ndarray | None:
        """What the halo of fills other than zero and mirror is multiplied with."""
        if self.fill not in FALLOFF:
            return None
        t = np.zeros(())
        for a in (2, 1, 0):
            own = _distances(*self.axis(a)[:4], place[a])
            t = np.maximum(t, own.reshape([-1 if b == a else 1 for b in (2, 1, 0)]))
        return None if not t.any() else np.where(t > 0, FALLOFF[self.fill](t), 1.0)


@lru_cache(maxsize=8192)
def _distances(n: int, size: int, before: int, after: int, c: int) -> np.ndarray:
    """How far into the image's halo each padded place of a chunk lies, 1 at most."""
    at = edges(n, size)[c] - before + np.arange(size + before + after)
    out = np.where(at < 0, -at / max(1, before), 0.0)
    return np.where(at >= n, (at - (n - 1)) / max(1, after), out)


@lru_cache(maxsize=8192)
def _sources(n: int, size: int, before: int, after: int, fill: str, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Padded places of a chunk along an axis, and the image's places that they read."""
    at = edges(n, size)[c] - before + np.arange(size + before + after)
    place = np.arange(len(at))
    if fill == "zero":
        inside = (at >= 0) & (at < n)
        return place[inside], at[inside]
    if fill == "mirror":
        at = np.mod(at, 2 * n)
        return place, np.where(at >= n, 2 * n - 1 - at, at)
    return place, np.clip(at, 0, n - 1)


@lru_cache(maxsize=8192)
def _readers(n: int, size: int, before: int, after: int, fill: str, start: int, extent: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Chunks that read [start, start + extent) of an axis: the block's places and the
    padded places they go to."""
    out = {}
    for c in range(len(edges(n, size)) - 1):
        place, at = _sources(n, size, before, after, fill, c)
        own = (at >= start) & (at < start + extent)
        if own.any():
            out[c] = at[own] - start, place[own]
    return out


PIECE = ["sx", "sy", "sz", "w", "h", "d"]


def split(cube: np.ndarray, start: Shape, layout: Layout) -> Iterator[tuple[Shape, np.ndarray]]:
    """The parts of a block (z, y, x) at a place of the image that chunks read."""
    readers = [_readers(*layout.axis(a), start[a], cube.shape[2 - a]) for a in range(3)]
    for (cx, (x, _)), (cy, (y, _)), (cz, (z, _)) in product(*(r.items() for r in readers)):
        yield (cx, cy, cz), cube[np.ix_(z, y, x)]


def piece_schema(keys: str) -> str:
    return f"{keys}, cx int, cy int, cz int, " + ", ".join(f"{p} int" for p in PIECE) + ", data binary"


def piece_batch(keys: dict[str, pa.Array], start: Shape, extent: Shape, parts: list[tuple[Shape, np.ndarray]]) -> pa.RecordBatch:
    """Rows of the parts of one block; keys have a row for each of them."""
    places = {c: pa.array([p[a] for p, _ in parts], pa.int32()) for a, c in enumerate(PLACE)}
    block = {c: pa.array([v] * len(parts), pa.int32()) for c, v in zip(PIECE, (*start, *extent))}
    return pa.RecordBatch.from_pydict({**keys, **places, **block, "data": pa.array([p.tobytes() for _, p in parts], pa.binary())})


def pieces(chunks: Chunks, layout: Layout) -> DataFrame:
    """What every chunk of a layout reads of the given chunks; blocks of zeros are sent to
    nobody but themselves."""
    kind, keys, own = np.dtype(chunks.kind), list(chunks.keys), Layout(chunks.shape, chunks.size)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in PLACE)))
            for i, (place, data) in enumerate(zip(places, batch.column("data"))):
                extent = own.extent(place)
                cube = np.frombuffer(data.as_buffer(), kind).reshape(extent[::-1])
                start = own.start(place)
                parts = [(p, part) for p, part in split(cube, start, layout) if p == place or part.any()]
                if parts:
                    named = {k: pa.concat_arrays([batch.column(k).slice(i, 1)] * len(parts)) for k in keys}
                    yield piece_batch(named, start, extent, parts)

    return chunks.rows.select(*keys, *PLACE, "data").mapInArrow(send, piece_schema(chunks.schema().split(", cx int")[0]))


def assembled(table: pa.Table, layout: Layout, kind: str) -> tuple[Shape, np.ndarray]:
    """The padded chunk that the pieces of one place make, and the place."""
    columns = {c: table[c].to_pylist() for c in (*PLACE, *PIECE)}
    place = tuple(columns[c][0] for c in PLACE)
    out = np.zeros(layout.full[::-1], kind)
    for i, data in enumerate(table["data"]):
        start, extent = (tuple(columns[c][i] for c in names) for names in (PIECE[:3], PIECE[3:]))
        to = [_readers(*layout.axis(a), start[a], extent[a])[place[a]][1] for a in (2, 1, 0)]
        out[np.ix_(*to)] = np.frombuffer(data.as_buffer(), kind).reshape([len(t) for t in to])
    weights = layout.weights(place)
    return place, out if weights is None else out * weights


def core(cube: np.ndarray, place: Shape, layout: Layout) -> np.ndarray:
    """A padded chunk without its halo."""
    return cube[tuple(slice(b, b + e) for b, e in zip(layout.before[::-1], layout.extent(place)[::-1]))]


def gather(parts: DataFrame, layout: Layout, work: Callable[[np.ndarray, Shape], np.ndarray], keys: tuple[str, ...] = ("image_id",), kind: str = REAL, out: str | None = None) -> Chunks:
    """Assembles pieces and runs work(padded chunk, place) on each; its result, of the same
    shape, loses the halo."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        place, cube = assembled(table, layout, kind)
        done = core(work(cube, place), place, layout).astype(out or kind, copy=False)
        first = table.slice(0, 1).select([*keys, *PLACE])
        return first.append_column("data", pa.array([done.tobytes()], pa.binary()))

    rows = parts.groupBy(*keys, *PLACE).applyInArrow(run, f"{named}, cx int, cy int, cz int, data binary")
    return Chunks(rows, layout.shape, layout.size, out or kind, keys)


def map_chunks(chunks: Chunks, work: Callable[[np.ndarray, Shape], np.ndarray], before: Shape = (0, 0, 0), after: Shape = (0, 0, 0), fill: str = "zero", out: str | None = None) -> Chunks:
    """work(padded chunk, place) on every chunk with its halo. Without a halo nothing is
    shuffled."""
    layout = Layout(chunks.shape, chunks.size, before, after, fill)
    if any(before) or any(after):
        return gather(pieces(chunks, layout), layout, work, chunks.keys, chunks.kind, out)
    kind = np.dtype(chunks.kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in PLACE)))
            for i, (place, data) in enumerate(zip(places, batch.column("data"))):
                cube = np.zeros(layout.full[::-1], kind)
                core(cube, place, layout)[...] = np.frombuffer(data.as_buffer(), kind).reshape(layout.extent(place)[::-1])
                done = core(work(cube, place), place, layout).astype(out or kind, copy=False)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([done.tobytes()], pa.binary())], names=row.schema.names)

    return replace(chunks, rows=chunks.rows.select(*chunks.keys, *PLACE, "data").mapInArrow(run, chunks.schema()), kind=out or chunks.kind)


def rechunk(chunks: Chunks, size: Shape) -> Chunks:
    """The same images in chunks of another size."""
    if size == chunks.size:
        return chunks
    layout = Layout(chunks.shape, size)
    return gather(pieces(chunks, layout), layout, lambda cube, _: cube, chunks.keys, chunks.kind)


def from_voxels(volume: Volume, values: str | tuple[str, str], size: Shape, keys: tuple[str, ...] = ("image_id",)) -> Chunks:
    """Chunks of a value, or of the complex number of two; voxels without a row are 0."""
    size = tuple(min(s, n) for s, n in zip(size, volume.shape))
    layout, names = Layout(volume.shape, size), [values] if isinstance(values, str) else list(values)
    kind = REAL if len(names) == 1 else COMPLEX
    kinds = {f.name: f.dataType.simpleString() for f in volume.voxels.schema}

    def pack(table: pa.Table) -> pa.Table:
        column = lambda c: table[c].to_numpy()
        place = tuple(table[c][0].as_py() for c in PLACE)
        cube = np.zeros(layout.extent(place)[::-1], kind)
        at = tuple(column(c) - a for c, a in zip("zyx", layout.start(place)[::-1]))
        cube[at] = column(names[0]) if len(names) == 1 else column(names[0]) + 1j * column(names[1])
        return table.slice(0, 1).select([*keys, *PLACE]).append_column("data", pa.array([cube.tobytes()], pa.binary()))

    places = [F.when(F.col(c) >= n - s, len(edges(n, s)) - 2).otherwise(F.expr(f"int({c} div {s})")).cast("int").alias(f"c{c}") for c, n, s in zip("xyz", volume.shape, size)]
    rows = volume.voxels.select(*keys, *places, "x", "y", "z", *(F.col(v).cast("double").alias(v) for v in names))
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return Chunks(rows.groupBy(*keys, *PLACE).applyInArrow(pack, f"{named}, cx int, cy int, cz int, data binary"), volume.shape, size, kind, keys)


def to_voxels(chunks: Chunks, *names: str) -> Volume:
    """Voxel rows with the chunks' value; of complex chunks with the real part and, where
    two names are given, the imaginary one."""
    kind, keys, layout = np.dtype(chunks.kind), list(chunks.keys), Layout(chunks.shape, chunks.size)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in PLACE)))
            for i, (place, data) in enumerate(zip(places, batch.column("data"))):
                extent = layout.extent(place)
                flat = np.frombuffer(data.as_buffer(), kind)
                at = [(a.ravel() + b).astype(np.int32) for a, b in zip(np.indices(extent[::-1]), layout.start(place)[::-1])]
                named = [batch.column(k).take(pa.array(np.full(len(flat), i))) for k in keys]
                yield pa.RecordBatch.from_arrays([*named, *map(pa.array, at[::-1]), *(pa.array(np.ascontiguousarray(part, np.float64)) for part in (flat.real, flat.imag)[: len(names)])], names=[*keys, "x", "y", "z", *names])

    kinds = chunks.schema().split(", cx int")[0]
    voxels = chunks.rows.select(*keys, *PLACE, "data").mapInArrow(unpack, f"{kinds}, x int, y int, z int, " + ", ".join(f"`{n}` double" for n in names))
    return Volume(voxels.select(*(c for c in keys if c != "image_id"), *KEYS, *names), chunks.shape)


#: Bytes of a line of chunks that a task may hold.
LINE = 64 << 20


def along(chunks: Chunks, axis: int, work: Callable[[np.ndarray, int], np.ndarray], length: int | None = None, out: str | None = None, absent: float = 0) -> Chunks:
    """work(array, numpy axis) on whole lines of an axis (0 x, 1 y, 2 z), chunk line by chunk
    line; length: the axis's extent after it; absent: the value of chunks without a row, in
    lines that have one. Chunks too wide for a line in memory are cut
    across first."""
    kind, keys, n = np.dtype(chunks.kind), chunks.keys, chunks.shape[axis]
    size = list(chunks.size)
    width = max(kind.itemsize, np.dtype(out or kind).itemsize)
    for a in sorted((a for a in range(3) if a != axis), key=lambda a: -size[a]):
        while size[a] > 1 and n * width * np.prod([s for b, s in enumerate(size) if b != axis]) > LINE:
            size[a] = -(-size[a] // 2)
    chunks = rechunk(chunks, tuple(size))
    shape = tuple(length or s if a == axis else s for a, s in enumerate(chunks.shape))
    step, at = min(size[axis], shape[axis]), f"c{'xyz'[axis]}"
    layout = Layout(chunks.shape, chunks.size)
    after = Layout(shape, tuple(step if a == axis else s for a, s in enumerate(size)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(at)
        first = tuple(table[c][0].as_py() for c in PLACE)
        blocks = {}
        for i, c in enumerate(table[at].to_pylist()):
            place = tuple(c if a == axis else p for a, p in enumerate(first))
            blocks[c] = np.frombuffer(table["data"][i].as_buffer(), kind).reshape(layout.extent(place)[::-1])
        whole = []
        for c in range(len(edges(n, layout.size[axis])) - 1):
            place = tuple(c if a == axis else p for a, p in enumerate(first))
            whole.append(blocks.get(c, np.broadcast_to(np.array(absent, kind), layout.extent(place)[::-1])))
        done = work(np.concatenate(whole, 2 - axis), 2 - axis).astype(out or kind, copy=False)
        parts = [part.tobytes() for part in np.split(done, edges(shape[axis], step)[1:-1], 2 - axis)]
        row = table.slice(0, 1)
        columns = {k: pa.concat_arrays([*row[k].chunks] * len(parts)) for k in keys}
        columns |= {c: pa.array(range(len(parts)) if a == axis else [first[a]] * len(parts), pa.int32()) for a, c in enumerate(PLACE)}
        return pa.table({**columns, "data": pa.array(parts, pa.binary())})

    others = [c for c in PLACE if c != at]
    rows = chunks.rows.select(*keys, *PLACE, "data").groupBy(*keys, *others).applyInArrow(run, chunks.schema())
    return Chunks(rows, shape, after.size, out or chunks.kind, keys)


def transform(chunks: Chunks, half: bool = False) -> Chunks:
    """The discrete Fourier transform, of real or complex chunks: lines of x, then y, then z,
    a shuffle each. half: of real chunks, frequencies x of the lower half alone."""
    if half and np.dtype(chunks.kind).kind == "c":
        raise ValueError("half of a spectrum is enough for real images only")
    first = along(chunks, 0, lambda a, i: np.fft.rfft(a, axis=i), chunks.shape[0] // 2 + 1, COMPLEX) if half else along(chunks, 0, lambda a, i: np.fft.fft(a, axis=i), None, COMPLEX)
    for axis in (1, 2):
        first = along(first, axis, lambda a, i: np.fft.fft(a, axis=i))
    return first


def inverse(spectra: Chunks, width: int | None = None) -> Chunks:
    """The inverse transform, complex; width: the images' extent along x where spectra are
    half ones, whose images are real."""
    for axis in (2, 1):
        spectra = along(spectra, axis, lambda a, i: np.fft.ifft(a, axis=i))
    if width is None:
        return along(spectra, 0, lambda a, i: np.fft.ifft(a, axis=i))
    return along(spectra, 0, lambda a, i: np.fft.irfft(a, width, axis=i), width, REAL)


def combine(a: Chunks, b: Chunks, work: Callable[[np.ndarray, np.ndarray], np.ndarray], out: str | None = None) -> Chunks:
    """work(a's chunk, b's chunk) of two volumes in the same chunks, by a join of their rows."""
    if (a.shape, a.size, a.keys) != (b.shape, b.size, b.keys):
        raise ValueError("both must have the same chunks")
    keys, kinds = [*a.keys, *PLACE], (np.dtype(a.kind), np.dtype(b.kind))
    rows = a.rows.select(*keys, "data").join(b.rows.select(*keys, F.col("data").alias("other")), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [work(*(np.frombuffer(x.as_buffer(), k) for x, k in zip(pair, kinds))).astype(out or kinds[0], copy=False).tobytes() for pair in zip(batch.column("data"), batch.column("other"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(done, pa.binary())], names=[*keys, "data"])

    return replace(a, rows=rows.mapInArrow(run, a.schema()), kind=out or a.kind)


def _envelope(f: np.ndarray) -> np.ndarray:
    """min over q of (p - q)^2 + f[q] for every place p of every line (lines, places): the
    lower envelope of the parabolas, built for all lines together, a place at a time; each
    parabola enters and leaves once."""
    lines, n = f.shape
    root = np.zeros((lines, n), np.int64)  # the envelope's parabolas
    edge = np.full((lines, n + 1), np.inf)  # from where each is the lowest
    edge[:, 0] = -np.inf
    top, all_lines = np.zeros(lines, np.int64), np.arange(lines)
    for q in range(1, n):
        left = all_lines
        while len(left):
            v = root[left, top[left]]
            meet = ((f[left, q] + q * q) - (f[left, v] + v * v)) / (2 * (q - v))
            out = meet <= edge[left, top[left]]
            stay = left[~out]
            top[stay] += 1
            root[stay, top[stay]], edge[stay, top[stay]] = q, meet[~out]
            edge[stay, top[stay] + 1] = np.inf
            left = left[out]
            top[left] -= 1
    out, at = np.empty_like(f), np.zeros(lines, np.int64)
    for p in range(n):
        while (on := edge[all_lines, at + 1] < p).any():
            at += on
        v = root[all_lines, at]
        out[:, p] = (p - v) ** 2 + f[all_lines, v]
    return out


#: A squared distance that stands for none.
FAR = 1e15


def squared_distances(masks: Chunks) -> Chunks:
    """The exact squared distance of every voxel to the nearest one whose mask is above 0, in
    three passes of lines whose cost doesn't depend on it; FAR where an image has no mask."""

    def work(a: np.ndarray, axis: int) -> np.ndarray:
        lines = np.moveaxis(a, axis, -1)
        done = np.minimum(_envelope(np.ascontiguousarray(lines).reshape(-1, lines.shape[-1])), FAR)
        return np.moveaxis(done.reshape(lines.shape), -1, axis)

    found = along(masks, 0, lambda a, i: work(np.where(a > 0, 0.0, FAR), i), None, REAL)
    for axis in (1, 2):
        found = along(found, axis, work, absent=FAR)
    return found
