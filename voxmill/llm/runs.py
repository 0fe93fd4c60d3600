"""Ids of runs of bytes that a worker has met before, looked up in arrays.

A text's tokens are often those of its runs, one after another: wherever no token can
reach across a place, the runs on both sides are encoded apart. Natural text repeats its
runs, so each distinct one is encoded once by a worker, until what it remembers is too
large and is dropped."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from voxmill.llm.common import flat_ranges

#: Distinct runs, and bytes of them, that a worker remembers.
REMEMBER, CHARACTERS = 500_000, 16_000_000


class Runs:
    """encode: from a list of runs (bytes) to the ids of all and the number of each; pieces:
    the bytes of each id."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.characters = 0
        self.ids = np.zeros(0, np.int32)
        self.start, self.size, self.same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, runs: list[bytes]) -> None:
        ids, sizes = self.encode(runs)
        upto = [0, *np.cumsum(sizes).tolist()]
        parts = list(map(self.pieces.__getitem__, ids.tolist()))
        same = [b"".join(parts[a:b]) == r for r, a, b in zip(runs, upto, upto[1:])]
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs))))
        self.characters += sum(map(len, runs))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.same = np.concatenate([self.same, np.array(same, bool)])
        self.ids = np.concatenate([self.ids, ids])

    def look_up(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all runs, the number of each, and whether the ids' bytes are the run's;
        run i is raw[starts[i]:starts[i + 1]]."""
        if len(starts) < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        if len(self.known) > REMEMBER or self.characters > CHARACTERS:
            self._forget()
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        runs = coded.dictionary.to_pylist()
        new = [r for r in runs if r not in self.known]
        if new:
            self._learn(new)
        found = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        index = found[coded.indices.to_numpy()]
        sizes = self.size[index]
        return self.ids[flat_ranges(self.start[index], sizes)], sizes, self.same[index]
