"""A small TIFF codec: directories, and blocks of slices by ranges of a file's bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: tag numbers, and bytes of field types.
WIDTH, LENGTH, BITS, COMPRESSION, DESCRIPTION, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 270, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
BIG = 2 << 30


def _lzw_codes(data: np.ndarray, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n codes from a bit on and where each ends, if none of them clears the table: the
    width of a code depends on how many came since then alone."""
    widths = np.minimum(12, np.floor(np.log2(258 + np.arange(n))).astype(np.int64) + 1)
    ends = at + np.cumsum(widths)
    bits = ends - widths
    first = np.minimum(bits >> 3, len(data) - 4)  # of codes beyond the end, which are not kept
    window = data[first].astype(np.int64) << 24 | data[first + 1].astype(np.int64) << 16 | data[first + 2].astype(np.int64) << 8 | data[first + 3]
    return window >> (32 - (bits & 7) - widths) & ((1 << widths) - 1), ends


def _lzw_expanded(codes: np.ndarray) -> np.ndarray:
    """The bytes of codes since the table was cleared. Entry 258 + j is what code j stood for
    and the byte after it, so it is a copy of the output from code j on: lengths and bytes
    follow by doubling the steps back to a single byte."""
    n, single = len(codes), codes < 256
    back = np.where(single, np.arange(n), codes - 258)
    if (back > np.arange(n)).any() or (back < 0).any():
        raise ValueError("the LZW data are broken")
    sizes, to = (~single).astype(np.int64), back
    while (to[to] != to).any():
        sizes, to = sizes + sizes[to], to[to]
    sizes += 1
    starts = np.cumsum(sizes) - sizes
    step = np.repeat((starts - np.where(single, starts, starts[back])).astype(np.int32), sizes)
    source = np.arange(len(step), dtype=np.int32) - step
    while (step[source] > 0).any():
        source = source[source]
    values = np.repeat(np.where(single, codes, 0), sizes).astype(np.uint8)
    return values[source]


def lzw_decode(data: bytes) -> bytes:
    raw, end = np.frombuffer(data + bytes(8), np.uint8), 8 * len(data)
    at, out = 0, []
    while end - at >= 9:
        n = 4096
        while True:  # a table that is never cleared goes on in 12 bits
            n = min(n, (end - at) // 9)
            codes, ends = _lzw_codes(raw, at, n)
            stops = np.flatnonzero(((codes == 256) | (codes == 257)) & (ends <= end))
            if len(stops) or n == (end - at) // 9:
                break
            n *= 2
        last = int(stops[0]) if len(stops) else int(np.searchsorted(ends, end, "right"))
        out.append(_lzw_expanded(codes[:last]))
        if not len(stops) or codes[last] == 257:
            break
        at = int(ends[last])
    return b"".join(x.tobytes() for x in out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, width, size = {}, 9, 258  # code << 8 | byte to the code of both

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    code = -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        longer = table.get(code << 8 | byte)
        if longer is not None:
            code = longer
            continue
        put(code)
        table[code << 8 | byte] = size
        size += 1
        code = byte
        if size == 4094:
            put(code)
            code = -1
            put(256)
            table, width, size = {}, 9, 258
        else:
            width = max(9, size.bit_length())
    if code >= 0:
        put(code)
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    """Runs: n + 1 bytes as they are, or one byte 1 - n times, for a signed n; -128 is none."""
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


@dataclass
class Page:
    """A directory of the file: tags and where its blocks lie."""

    order: str
    tags: dict[int, list]

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def text(self) -> str:
        return bytes(self.tags.get(DESCRIPTION, [])).rstrip(b"\0").decode(errors="replace")


class Bytes:
    """A file's bytes, by ranges: (n, at) -> bytes."""

    def __init__(self, data: bytes):
        self.read_at = lambda n, at: data[at : at + n]


def pages(data) -> list[Page]:
    """The directories of bytes, or of a file with read_at(n, at)."""
    read = (Bytes(data) if isinstance(data, bytes) else data).read_at

    def unpack(kind: str, at: int) -> tuple:
        raw = read(struct.calcsize(order + kind), at)
        if len(raw) < struct.calcsize(order + kind):
            raise ValueError("the TIFF file ends early")
        return struct.unpack(order + kind, raw)

    order = {b"II": "<", b"MM": ">"}.get(read(2, 0))
    if order is None or len(read(8, 0)) < 8:
        raise ValueError("not a TIFF file")
    big = unpack("H", 2)[0] == 43
    at = unpack("Q" if big else "I", 8 if big else 4)[0]
    out = []
    while at:
        n = unpack("Q" if big else "H", at)[0]
        at += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind, count = unpack("HHQ" if big else "HHI", at)
            field, room, step = at + (12 if big else 8), 8 if big else 4, 20 if big else 12
            size = TYPE_SIZE.get(kind, 1)
            if size * count > room:
                field = unpack("Q" if big else "I", field)[0]
            code = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}.get(kind, "B")
            tags[tag] = list(unpack(f"{count}{code}", field)) if kind != 5 else []
            at += step
        out.append(Page(order, tags))
        at = unpack("Q" if big else "I", at)[0]
    return out


def metadata(data) -> dict:
    """Extent and kind of the volume; channels and slices come from the description
    where it has them, else from the number of pages."""
    return about(pages(data))


def about(found: list[Page]) -> dict:
    first = found[0]
    said = dict(line.split("=", 1) for line in first.text.splitlines() if "=" in line)
    channels = max(1, int(said.get("channels", 1)))
    return {
        "width": first.one(WIDTH), "height": first.one(LENGTH), "depth": int(said.get("slices", len(found) // channels)), "channels": channels,
        "bits": first.one(BITS, 1), "sample_format": first.one(FORMAT, 1), "samples": first.one(SAMPLES, 1), "tiled": TILE_WIDTH in first.tags,
        "rows_per_strip": first.one(ROWS, first.one(LENGTH)), "description": first.text,
    }


def _unpacked(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if how == LZW:
        return lzw_decode(data)
    if how == PACKBITS:
        return packbits_decode(data)
    raise ValueError(f"compression {how} is not supported")


#: Kinds of samples by (sample format, bits): 1 unsigned, 2 signed, 3 floating point.
SAMPLE_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
#: Predictors: none, differences of neighbours along a row, and those of the bytes of
#: floating-point numbers, the highest bytes of a row first.
PLAIN, HORIZONTAL, FLOATING = 1, 2, 3


def _unpredicted(raw: bytes, kind: np.dtype, shape: tuple[int, int, int], predictor: int) -> np.ndarray:
    """A block (rows, columns, samples) in the machine's order of bytes."""
    rows, columns, samples = shape
    if predictor != FLOATING:
        block = np.frombuffer(raw, kind, rows * columns * samples).reshape(shape)
        return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if predictor == HORIZONTAL else block
    planes = np.frombuffer(raw, np.uint8, rows * columns * samples * kind.itemsize).reshape(rows, -1, samples)
    planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * samples)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)


def page_blocks(data, page: Page, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, sample: int = 0) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(y, x, values, bytes read) of the blocks of a page that rows and columns [a, b) touch,
    cut to the page; other blocks are neither read nor decoded."""
    read = (Bytes(data) if isinstance(data, bytes) else data).read_at
    w, h, n = page.one(WIDTH), page.one(LENGTH), page.one(SAMPLES, 1)
    key, predictor = (page.one(FORMAT, 1), page.one(BITS, 1)), page.one(PREDICTOR, PLAIN)
    if key not in SAMPLE_KINDS:
        raise ValueError(f"samples of format {key[0]} with {key[1]} bits are not supported")
    if predictor not in (PLAIN, HORIZONTAL, FLOATING) or predictor == HORIZONTAL and key[0] == 3 or predictor == FLOATING and key[0] != 3:
        raise ValueError(f"predictor {predictor} is not supported for sample format {key[0]}")
    kind, how = np.dtype(page.order + SAMPLE_KINDS[key]), page.one(COMPRESSION, NONE)
    (a, b), (c, d) = rows or (0, h), columns or (0, w)
    tiled = TILE_WIDTH in page.tags
    bw, bh = (page.one(TILE_WIDTH), page.one(TILE_LENGTH)) if tiled else (w, min(page.one(ROWS, h), h))
    across, down = -(-w // bw), -(-h // bh)
    apart = n > 1 and page.one(PLANAR, 1) == 2  # each sample has its own plane of blocks
    first = sample * across * down if apart else 0
    places, sizes = page.tags[TILES if tiled else STRIPS], page.tags[TILE_BYTES if tiled else STRIP_BYTES]
    for j in range(max(0, a) // bh, min(down, -(-b // bh))):
        for i in range(max(0, c) // bw, min(across, -(-d // bw))):
            y, x, at = j * bh, i * bw, first + j * across + i
            high, deep = bh if tiled else min(bh, h - y), 1 if apart else n
            block = _unpredicted(_unpacked(read(sizes[at], places[at]), how), kind, (high, bw, deep), predictor)[:, :, 0 if apart else sample]
            yield y, x, block[: h - y, : w - x], sizes[at]


def read_page(data, page: Page, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, sample: int = 0) -> np.ndarray:
    """Rows and columns [a, b) of a page as float32."""
    (a, b), (c, d) = rows or (0, page.one(LENGTH)), columns or (0, page.one(WIDTH))
    out = np.zeros((b - a, d - c), np.float32)
    for y, x, block, _ in page_blocks(data, page, rows, columns, sample):
        top, bottom, left, right = max(a, y), min(b, y + block.shape[0]), max(c, x), min(d, x + block.shape[1])
        out[top - a : bottom - a, left - c : right - c] = block[top - y : bottom - y, left - x : right - x]
    return out


def slice_page(found: list[Page], about: dict, channel: int, z: int) -> tuple[Page, int]:
    """The page and the sample of a slice. Channels count from 1; 0 is the first too."""
    own = max(0, channel - 1)
    if own >= max(about["channels"], about["samples"]):
        raise ValueError(f"channel {channel} of {max(about['channels'], about['samples'])}")
    separate = about["channels"] > 1 and about["samples"] == 1
    return found[z * about["channels"] + own if separate else z], 0 if separate else own


def read_volume(data, channel: int = 0, z: tuple[int, int] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> np.ndarray:
    """(z, y, x) float32 of a box; without bounds, of the whole."""
    found = pages(data)
    said = about(found)
    a, b = z or (0, said["depth"])
    return np.stack([read_page(data, page, y, x, sample) for page, sample in (slice_page(found, said, channel, k) for k in range(a, b))])


#: Sample format and bits of what can be written.
WRITTEN = {"f4": (3, 32), "u1": (1, 8), "u2": (1, 16)}


def slice_blocks(plane: np.ndarray, compression: int = NONE, level: int = -1, tile: tuple[int, int] | None = None, kind: str = "f4") -> list[bytes]:
    """The compressed blocks of a slice: one strip, or tiles (width, length) whose edges
    are filled with zeros. Whole numbers are written as differences along rows."""
    plane, (h, w) = plane.astype(f"<{kind}"), plane.shape
    pack = {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, level), LZW: lzw_encode}[compression]

    def packed(block: np.ndarray) -> bytes:
        return pack((np.diff(block, axis=1, prepend=block.dtype.type(0)) if kind != "f4" else block).tobytes())

    if not tile:
        return [packed(plane)]
    tw, th = tile
    full = np.zeros((-(-h // th) * th, -(-w // tw) * tw), plane.dtype)
    full[:h, :w] = plane
    return [packed(full[y : y + th, x : x + tw]) for y in range(0, h, th) for x in range(0, w, tw)]


def header(first: int, big: bool) -> bytes:
    """The file's first bytes; first: where the first directory lies."""
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if big else struct.pack("<2sHI", b"II", 42, first)


def lists_size(n_blocks: int, big: bool) -> int:
    """Bytes of the lists of places and sizes between blocks and directory."""
    return 2 * n_blocks * (8 if big else 4) if n_blocks > 1 else 0


def directory_size(tiled: bool, big: bool) -> int:
    n = 11 if tiled else 10
    return 8 + 20 * n + 8 if big else 2 + 12 * n + 4


def directory(w: int, h: int, sizes: list[int], at: int, following: int, compression: int, tile: tuple[int, int] | None, big: bool, kind: str = "f4") -> bytes:
    """Lists and directory of a slice whose blocks begin at `at`; they stand right
    behind the blocks. following: the next directory, 0 for none."""
    word, entry, field = ("Q", "<HHQQ", 16) if big else ("I", "<HHII", 4)
    places = [at + sum(sizes[:i]) for i in range(len(sizes))]
    lists = {}
    behind = at + sum(sizes)
    tags = {WIDTH: [w], LENGTH: [h], BITS: [WRITTEN[kind][1]], COMPRESSION: [compression], SAMPLES: [1], PREDICTOR: [PLAIN if kind == "f4" else HORIZONTAL], FORMAT: [WRITTEN[kind][0]]}
    tags |= {TILE_WIDTH: [tile[0]], TILE_LENGTH: [tile[1]], TILES: places, TILE_BYTES: sizes} if tile else {STRIPS: places, ROWS: [h], STRIP_BYTES: sizes}
    fields, out = [], b""
    for tag, values in sorted(tags.items()):
        if len(values) > 1:
            lists[tag] = behind + len(out)
            out += struct.pack(f"<{len(values)}{word}", *values)
        fields.append(struct.pack(entry, tag, field, len(values), lists.get(tag, values[0])))
    return out + struct.pack("<Q" if big else "<H", len(fields)) + b"".join(fields) + struct.pack("<" + word, following)


def encode(volume: np.ndarray, compression: int = NONE, level: int = -1, tile: tuple[int, int] | None = None, big: bool | None = None, kind: str = "f4") -> bytes:
    """A page for each slice; BigTIFF from 2 GiB."""
    d, h, w = volume.shape
    big = volume.size * 4 >= BIG if big is None else big
    blocks = [slice_blocks(plane, compression, level, tile, kind) for plane in volume]
    at, behind = [len(header(0, big))], []
    for b in blocks:
        behind.append(at[-1] + sum(map(len, b)) + lists_size(len(b), big))
        at.append(behind[-1] + directory_size(bool(tile), big))
    out = [header(behind[0], big)]
    for b, place, following in zip(blocks, at, [*behind[1:], 0]):
        out += [*b, directory(w, h, [len(x) for x in b], place, following, compression, tile, big, kind)]
    return b"".join(out)
