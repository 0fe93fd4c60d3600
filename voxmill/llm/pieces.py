"""SentencePiece encoding with the source bytes of every piece, and decoding.

A text is normalised here, by the model's own description: at each place the longest key
of its compiled character map (a double array of the map's keys) is replaced, all else is
copied, and each byte that comes out records where in the text it came from. The library
merges the normalised text to pieces; a piece's bytes are known from its id, so every
piece is projected to the bytes of the original text.

Merges only make pieces of the vocabulary, so none reaches across two bytes that no piece
holds side by side: the text is cut there into runs, each distinct one of which is encoded
once by a worker (runs.py).

Spans follow the library: bytes that one character or one key was normalised to stand at
its start, so of the byte pieces of a character the last one covers it and the others
are empty; the first piece of a text may cover nothing but the space that the model puts
before it.

Rows: a null text is empty, and an empty text has no pieces; a null doc_id and repeated
rows are documents of their own; other columns are ignored; no rows give no rows. Texts
are valid UTF-8, as Spark's strings are. Models: BPE with byte fallback, spaces escaped and
put before; others are refused."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import flat_ranges, text_slices, utf8_buffer
from voxmill.llm.encoder import tokenizer_path
from voxmill.llm.runs import Runs

MODEL, SLICE = "piece_bpe_32k.model", 2 << 20
RESULT = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
#: Fixed values of the model files: fields of a model, of its trainer's and its
#: normaliser's description; kinds of models and of pieces; the sign for a space.
TRAINER, NORMALIZER = 2, 3
MODEL_TYPE, SUFFIX, BYTE_FALLBACK = 3, 24, 35
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
BPE = 2
SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def message(data: bytes) -> dict[int, list]:
    """The fields of a serialized message: numbers, and bytes of what is nested."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


class CharacterMap:
    """The compiled map: the size of a double array, the array, and the strings that its
    values point into, each with a zero byte at its end."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.strings = compiled[4 + size :]
        #: whether a key may begin with a byte, or with two of them
        self.begins = np.zeros((256, 257), bool)
        for a in range(256) if self.units else ():
            node = self._step(self._root(), a)
            if node is None:
                continue
            if self.units[node] >> 8 & 1:
                self.begins[a] = True
            for b in range(256):
                self.begins[a, b] |= self._step(self._below(node), b) is not None

    def _below(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10 << ((unit & 1 << 9) >> 6))

    def _root(self) -> int:
        return self._below(0)

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int, end: int) -> tuple[int, bytes] | None:
        """Length of the longest key at a place, and what replaces it."""
        base, found = self._root(), None
        for i in range(at, end):
            node = self._step(base, text[i])
            if node is None:
                break
            base = self._below(node)
            if self.units[node] >> 8 & 1:
                found = i + 1 - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        first = found[1]
        return found[0], self.strings[first : self.strings.index(b"\0", first)]


class Normalizer:
    """Normalises many texts at once. A space, escaped or not, is one byte 0x20 here, as a
    normalised text has no other spaces."""

    def __init__(self, compiled: bytes = b"", dummy_prefix: bool = True, remove_extra: bool = True):
        self.map, self.dummy_prefix, self.remove_extra = CharacterMap(compiled), dummy_prefix, remove_extra
        if remove_extra and b"  " in self.map.strings:
            raise ValueError("a key that becomes several spaces is not supported")

    def _replaced(self, raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, bytes, bool]]:
        """Places, lengths and new bytes, in order; and whether it is a written sign for
        a space."""
        data = raw.tobytes()
        sign = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81) if len(raw) > 2 else np.zeros(0, bool)
        maybe = np.zeros(len(raw), bool)
        maybe[: len(sign)] = sign
        if self.map.units:
            following = np.full(len(raw), 256, np.int64)
            following[:-1] = raw[1:]
            maybe |= self.map.begins[raw, following] & ((raw & 0xC0) != 0x80)
        places = np.flatnonzero(maybe)
        ends, upto = bounds[np.searchsorted(bounds, places, "right")].tolist() if len(places) else [], 0
        for at, end in zip(places.tolist(), ends):
            if at < upto:
                continue
            found = self.map.longest(data, at, end) if self.map.units else None
            if found:
                upto = at + found[0]
                yield at, found[0], found[1], False
            elif at < len(sign) and sign[at]:
                upto = at + 3
                yield at, 3, b" ", True

    def normalize(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all normalised texts, bounds of the texts in them, the place in raw
        that each byte came from, and the place where each text ends."""
        lead = np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0)
        source = np.maximum.accumulate(lead) if len(raw) else lead
        parts, places, signs, upto = [], [], [], 0
        for at, size, new, sign in self._replaced(raw, bounds):
            parts += [raw[upto:at], np.frombuffer(new, np.uint8)]
            places += [source[upto:at], np.full(len(new), at)]
            signs.append((at, sign))
            upto = at + size
        norm = np.concatenate([*parts, raw[upto:]]) if parts else raw
        source = np.concatenate([*places, source[upto:]]) if places else source
        starts = np.searchsorted(source, bounds[:-1])
        limits = np.append(starts, len(norm))
        ends = bounds[1:].copy()
        if self.remove_extra and len(norm):
            written = np.zeros(len(norm), bool)
            written[np.searchsorted(source, [at for at, sign in signs if sign])] = True
            space = (norm == 0x20) & ~written
            owner = np.repeat(np.arange(len(starts)), np.diff(limits))
            keep = np.ones(len(norm), bool)
            keep[1:] = ~(space[1:] & space[:-1])
            first = starts[np.diff(limits) > 0]
            keep[first] = ~space[first]
            # at the end of a text spaces go, whatever they were written as
            solid = np.where(norm != 0x20, np.arange(len(norm)), -1)
            last = np.maximum.accumulate(solid)
            stop = np.where(np.diff(limits) > 0, last[np.maximum(limits[1:] - 1, 0)], -1)
            stop = np.maximum(stop + 1, starts)
            tail = np.arange(len(norm)) >= stop[owner]
            kept_tail = keep & tail
            firsts = np.full(len(starts), -1)
            at = np.flatnonzero(kept_tail)[::-1]
            firsts[owner[at]] = at
            ends = np.where(firsts >= 0, source[firsts], ends)
            keep &= ~tail
            norm, source = norm[keep], source[keep]
            limits = np.concatenate([[0], np.cumsum(keep)])[limits]
        if self.dummy_prefix:
            some = np.flatnonzero(np.diff(limits) > 0)
            at = limits[some]
            norm = np.insert(norm, at, 0x20)
            source = np.insert(source, at, source[at])
            added = np.zeros(len(limits), np.int64)
            added[some + 1] = 1
            limits = limits + np.cumsum(added)
        return norm, limits, source, ends


class Pieces:
    """Encodes and decodes with a model file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        about = message(model)
        # of a field that is written several times the last one counts
        trainer, spec = (message(b"".join(about.get(f, []))) for f in (TRAINER, NORMALIZER))
        one = lambda fields, n, default: fields.get(n, [default])[-1]
        if one(trainer, MODEL_TYPE, 1) != BPE or not one(trainer, BYTE_FALLBACK, 0) or one(trainer, SUFFIX, 0) or not one(spec, ESCAPE, 1):
            raise ValueError("only BPE models with byte fallback, and with spaces escaped and before words, are supported")
        self.normalizer = Normalizer(one(spec, CHARSMAP, b""), bool(one(spec, DUMMY_PREFIX, 1)), bool(one(spec, REMOVE_EXTRA, 1)))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the same model without a normaliser, as texts are normalised here
        plain = bytes([CHARSMAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, REMOVE_EXTRA << 3, 0])
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(plain)]) + plain)
        #: bytes of each piece, a space as one byte
        self.bytes: list[bytes] = []
        #: whether some piece holds two bytes side by side
        self.joined = np.zeros((256, 256), bool)
        for i in range(self.library.vocab_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_control(i) or self.library.is_unknown(i):
                self.bytes.append(b"")
            elif self.library.is_byte(i):
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.bytes.append(piece.replace(SPACE, " ").encode())
                self.joined[list(self.bytes[-1][:-1]), list(self.bytes[-1][1:])] = True
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.runs = Runs(self._merged, self.bytes)

    def _merged(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.merges.encode([r.decode().replace(" ", SPACE) for r in runs], num_threads=1)
        return np.array([i for x in found for i in x], np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """ids of all texts and bounds of each text's ids; lo and hi: the bytes of its own
        text that each piece covers; plain: whether the bytes of a text's pieces are a space
        and the text."""
        raw, bounds = utf8_buffer(texts)
        norm, limits, source, ends = self.normalizer.normalize(raw, bounds)
        cut = np.zeros(len(norm) + 1, bool)
        if len(norm):
            cut[1:-1] = ~self.joined[norm[:-1], norm[1:]] & ((norm[1:] & 0xC0) != 0x80)
        cut[limits] = True
        starts = np.flatnonzero(cut)
        ids, _, same = self.runs.look_up(norm, starts)
        upto = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        out = np.searchsorted(upto, limits)
        owner = np.repeat(np.arange(len(limits) - 1), np.diff(out))
        after = np.append(source, 0)[upto[1:]]
        last = out[1:][np.diff(out) > 0] - 1
        after[last] = ends[owner[last]]
        # whether the runs before a place, and the bytes of the text, are all the same
        odd = np.concatenate([[0], np.cumsum(~same)])[np.searchsorted(starts, limits)]
        plain = (np.diff(odd) == 0) & (np.diff(limits) == np.diff(bounds) + 1)
        own = np.flatnonzero(plain)
        lengths = (bounds[1:] - bounds[:-1])[own]
        other = np.flatnonzero(norm[flat_ranges(limits[own] + 1, lengths)] != raw[flat_ranges(bounds[own], lengths)])
        plain[own[np.searchsorted(np.cumsum(lengths), other, "right")]] = False
        plain[own] &= norm[limits[own]] == 0x20
        return {"ids": ids, "bounds": out, "plain": plain, "lo": source[upto[:-1]] - bounds[owner], "hi": after - bounds[owner]}

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """The model, kept by the worker for its next tasks."""
    return Pieces(path)


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) of whole texts (doc_id, text): ids of the pieces,
    the bytes [start, end) of the text that each covers, and what the ids decode to."""
    path = model or tokenizer_path(MODEL)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for whole in batches:
            for batch in text_slices(whole, SLICE):
                found = pieces.encode(batch.column("text"))
                bounds = found["bounds"]
                lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32()))  # noqa: E731,B023
                decoded = [pieces.decode(found["ids"][a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": lists(found["ids"]), "starts": lists(found["lo"]), "ends": lists(found["hi"]), "decoded": pa.array(decoded, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, RESULT)


def digest(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_pieces()."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
