"""Word shingles of whole texts as 64-bit hashes, and their one-permutation
MinHash signatures; numpy over a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from voxmill.llm.common import BYTE_CODE, UPPER, flat_ranges, mix64, utf8_buffer, word_hash

#: A-Z hash as a-z do.
FOLDED = BYTE_CODE.copy()
FOLDED[[ord(c) for c in UPPER]] = BYTE_CODE[[ord(c) for c in UPPER.lower()]]
ORDER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `width` words of each text, as sorted hashes of all
    texts one after another, and each text's bounds. Words are runs of bytes that
    are not white space, A-Z in lower case; a text of fewer words, but not none,
    has its whole sequence as its one shingle."""
    raw, bounds = utf8_buffer(texts)
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    begins = solid[1:-1].copy()
    if len(raw):
        begins[1:] &= ~solid[1:-2]
        cut = bounds[:-1][bounds[:-1] < len(raw)]
        begins[cut] = solid[1:-1][cut]
    start = np.flatnonzero(begins)
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:] = solid[1:-1] & ~solid[2:]
    # a text may end with a word while the next begins with one
    edge = bounds[1:][bounds[1:] > 0]
    stop[edge] |= solid[1:-1][edge - 1]
    end = np.flatnonzero(stop)
    word = word_hash(raw, start, end, FOLDED)
    first = np.searchsorted(start, bounds)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = flat_ranges(first[:-1], count)
    whole = np.repeat(n >= width, count)
    left = np.repeat(first[1:], count)
    code = np.zeros(len(at), np.uint64)
    for k in range(width):
        here = at + k
        use = whole | (here < left)
        code[use] += word[here[use]] * ORDER[k] + np.uint64(k + 1)
    code = mix64(code)
    owner = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[new], owner[new]
    return code, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(code: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification, a row for each
    non-empty set: the least hash of each bin, and for an empty bin that of a bin
    found by trying places drawn from (bin, attempt), the same for every set."""
    rows = np.flatnonzero(np.diff(bounds))
    shift = np.uint64(64 - (bins - 1).bit_length())
    # another order than that of the sets' own hashes, so ties to them are none
    value = mix64(code ^ np.uint64(0xD1B54A32D192ED03))
    owner = np.repeat(np.arange(len(rows)), np.diff(bounds)[rows])
    key = owner * bins + (value >> shift).astype(np.int64)
    sig = np.full(len(rows) * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(sig, key, value)
    full = np.zeros(len(rows) * bins, bool)
    full[key] = True
    row, bin_ = np.divmod(np.flatnonzero(~full), bins)
    attempt = 0
    base = sig.copy()
    while len(row):
        attempt += 1
        tried = (mix64((bin_ * 1_000_003 + attempt).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        hit = full[row * bins + tried]
        sig[row[hit] * bins + bin_[hit]] = base[row[hit] * bins + tried[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return sig.reshape(len(rows), bins)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` bins."""
    banded = sig.reshape(len(sig), sig.shape[1] // rows, rows)
    key = np.broadcast_to(np.arange(banded.shape[1], dtype=np.uint64) * ORDER[4], banded.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key ^ (banded[:, :, k] * ORDER[k % len(ORDER)] + np.uint64(k)))
    return key
