"""External induced suffix sorting, with carried common prefixes, to a bounded depth.

1. Units. The text is cut where a byte is less than the one before it, and at most
   WINDOW bytes after the last cut; what the WINDOW bytes from a cut on are says where
   the next one is. A unit's name is the rank of those bytes.
2. Recursion. The names, in the order of the text, are a shorter text; names of pairs
   of its names cover twice as many bytes. So on, until names differ or cover DEPTH
   bytes. All sorts are external (sorted runs in a scratch file, merged), and names
   and what goes with them lie in mapped files.
3. Induction. Of the units those begin seeds after which the text rises (leftmost
   S suffixes). All other suffixes are induced from the order of the seeds: a scan of
   the sorted ones inserts each one's predecessor into a priority queue by its first
   byte, upwards for L suffixes and then downwards for S suffixes. Insertions with one
   first byte come in their final order, so the priority queue is a FIFO for each byte.
   A queue's entries are tuples of the suffix's place, the bytes before it (so the text
   is not asked again), and the length of the prefix that it shares with the entry
   before it: one more than the least such value scanned between the two that induced
   them. Beyond a bound of entries held, queues live in a scratch file.

The text may be a mapped file. Everything else is streamed in stretches of bounded
size: memory does not grow with the text."""

from __future__ import annotations

import tempfile
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

from voxmill.llm.common import flat_ranges

DEPTH, WINDOW = 56, 16
#: Rows that a sort, or the queues of a direction, hold in memory; and that are scanned
#: at a time.
HELD, STRETCH = 1 << 16, 1 << 15
_LOW, _COUNT = np.uint64((1 << 56) - 1), np.uint64(56)
_8, _1, _255 = np.uint64(8), np.uint64(1), np.uint64(255)


class Scratch:
    """An unnamed file for rows of 64-bit words, made when it is first written to."""

    def __init__(self):
        self.file = None

    def write(self, rows: np.ndarray) -> int:
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(rows).tobytes())
        return at

    def read(self, at: int, n: int, columns: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n * columns), np.uint64).reshape(n, columns)


def _order(rows: np.ndarray, keys: int, kind: str | None = None) -> np.ndarray:
    order = np.argsort(rows[:, 0], kind=kind)
    if keys == 1 or not len(rows):
        return order
    # equal first keys stand together; only those need the second one
    first, second = rows[order, 0], rows[order, 1]
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
    group = np.cumsum(np.append(True, ~same))[tied]
    order[tied] = order[tied][_order_in(group, second[tied])]
    return order


def _order_in(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places by group, then key, then place: sorted as single words (group, rank of
    the key, place) where those fit, which is several times faster than by two keys."""
    n, bits = len(key), len(key).bit_length()
    if not n or bits + int(group[-1]).bit_length() + bits > 64:
        return np.lexsort((key, group))
    by = np.argsort(key)
    rank = np.empty(n, np.uint64)
    rank[by] = np.cumsum(np.append(False, key[by[1:]] != key[by[:-1]]))
    word = (group.astype(np.uint64) << np.uint64(bits) | rank) << np.uint64(bits) | np.arange(n, dtype=np.uint64)
    word.sort()
    return (word & np.uint64((1 << bits) - 1)).astype(np.int64)


class Sorter:
    """Rows of unsigned words, sorted by their first columns in bounded memory."""

    def __init__(self, columns: int, keys: int, held: int):
        self.columns, self.keys, self.room = columns, keys, max(2, held)
        self.parts: list[np.ndarray] = []
        self.n, self.runs, self.scratch = 0, [], Scratch()

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate([*self.parts, np.zeros((0, self.columns), np.uint64)])
        self.parts, self.n = [], 0
        return rows[_order(rows, self.keys)]

    def add(self, rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.n += len(rows)
        if self.n > self.room:
            n = self.n
            self.runs.append((self.scratch.write(self._sorted()), n))

    def __iter__(self) -> Iterator[np.ndarray]:
        last = self._sorted()
        if not self.runs:
            for a in range(0, len(last), STRETCH):
                yield last[a : a + STRETCH]
            return
        if len(last):
            self.runs.append((self.scratch.write(last), len(last)))
        del last
        step = max(1, self.room // len(self.runs))
        taken = [0] * len(self.runs)
        heads = [np.zeros((0, self.columns), np.uint64)] * len(self.runs)
        while True:
            for i, (at, n) in enumerate(self.runs):
                if not len(heads[i]) and taken[i] < n:
                    m = min(step, n - taken[i])
                    heads[i] = self.scratch.read(at + 8 * self.columns * taken[i], m, self.columns)
                    taken[i] += m
            rows = np.concatenate(heads)
            if not len(rows):
                return
            run = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            order = _order(rows, self.keys, "stable")  # so that heads are used from their starts
            # what comes after the end of a head may come after what its run still has
            ends = np.cumsum([len(h) for h in heads]) - 1
            open_ = [e for e, h, t, (_, n) in zip(ends.tolist(), heads, taken, self.runs) if len(h) and t < n]
            upto = len(order)
            if open_:
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                upto = int(place[open_].min()) + 1
            used = np.bincount(run[order[:upto]], minlength=len(heads))
            heads = [h[u:] for h, u in zip(heads, used.tolist())]
            yield rows[order[:upto]]


class Queues:
    """FIFOs of tuples (place << 8 | common prefix, bytes before) that share memory."""

    def __init__(self, n: int, held: int):
        self.room, self.used, self.scratch = held, 0, Scratch()
        self.each = [Queue(self) for _ in range(n)]

    def more(self, n: int) -> None:
        self.used += n
        if self.used > self.room:
            for queue in sorted(self.each, key=lambda q: -q.held):
                if self.used <= self.room // 2:
                    break
                queue.spill()


class Queue:
    def __init__(self, all_: Queues):
        self.all, self.size, self.held = all_, 0, 0
        self.starts: list[int] = []
        self.parts: list[np.ndarray | int] = []  # in memory, or where in the file

    def push(self, rows: np.ndarray) -> None:
        self.starts.append(self.size), self.parts.append(rows)
        self.size += len(rows)
        self.held += len(rows)
        self.all.more(len(rows))

    def spill(self) -> None:
        starts, parts, i = [], [], 0
        while i < len(self.parts):
            starts.append(self.starts[i])
            if isinstance(self.parts[i], int):
                parts.append(self.parts[i])
                i += 1
                continue
            j = i
            while j < len(self.parts) and not isinstance(self.parts[j], int):
                j += 1
            parts.append(self.all.scratch.write(np.concatenate(self.parts[i:j])))
            i = j
        self.starts, self.parts = starts, parts
        self.all.used -= self.held
        self.held = 0

    def read(self, a: int, b: int) -> np.ndarray:
        out, i = [], bisect_right(self.starts, a) - 1
        while a < b:
            end = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else self.size)
            part, skip = self.parts[i], a - self.starts[i]
            out.append(self.all.scratch.read(part + 16 * skip, end - a, 2) if isinstance(part, int) else part[skip : skip + end - a])
            a, i = end, i + 1
        return out[0] if len(out) == 1 else np.concatenate(out)

    def upwards(self) -> Iterator[np.ndarray]:
        """All rows, those too that are pushed meanwhile."""
        a = 0
        while a < self.size:
            b = min(self.size, a + STRETCH)
            yield self.read(a, b)
            a = b

    def downwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows from the end, and the common prefix of each with the one after it; for
        the last one of all, 0."""
        after = 0
        for b in range(self.size, 0, -STRETCH):
            rows = self.read(max(0, b - STRETCH), b)
            common = (rows[:, 0] & _255).astype(np.int64)
            yield rows[::-1], np.concatenate([[after], common[:0:-1]])
            after = int(common[0])


def _words(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of big-endian words that hold the 8 * n bytes from each place on, 0 beyond
    the end."""
    held = np.zeros((len(at), 8 * n), np.uint8)
    last = len(text) - 8 * n
    inner = at <= last
    if last >= 0:
        held[inner] = np.lib.stride_tricks.sliding_window_view(text, 8 * n)[at[inner]]
    for i in np.flatnonzero(~inner).tolist():
        rest = text[at[i] :]
        held[i, : len(rest)] = rest
    return held.view(">u8").astype(np.uint64)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes, up to DEPTH, that the suffixes at a and b share."""
    x = _words(text, a, DEPTH // 8) ^ _words(text, b, DEPTH // 8)
    word = np.argmax(x != 0, axis=1)
    first = x[np.arange(len(x)), word]
    zero = np.zeros(len(x), np.int64)
    for shift in range(8, 64, 8):
        zero += first < (_1 << np.uint64(shift))
    return np.where(first != 0, 8 * word + zero, DEPTH)


def units(text: np.ndarray) -> Iterator[np.ndarray]:
    """(two words, unit number, place << 2 | begins a seed) of each unit, in order."""
    n, count = len(text), 0
    cut = 0  # the last cut
    pending: tuple[int, bool] | None = (0, False)  # a cut after which the text has not changed yet
    for a in range(0, n, STRETCH):
        b = min(n, a + STRETCH)
        x = np.asarray(text[max(0, a - 1) : b]).astype(np.int16)
        step = np.diff(x)
        change = np.flatnonzero(step)
        falls = step[change] < 0
        at = change + max(0, a - 1) + 1
        # a fall begins a seed if the next change is a rise
        seed = falls & np.append(~falls[1:], False)
        place, flag = at[falls], seed[falls]
        if pending is not None and len(at):
            place, flag = np.append(pending[0], place), np.append(pending[1] and not falls[0], flag)
            pending = None
        if len(at) and falls[-1]:
            place, flag, pending = place[:-1], flag[:-1], (int(place[-1]), True)
        if not len(place):
            continue
        # and cuts every WINDOW bytes between two
        ends = np.append(place[1:], place[-1])
        extra = np.maximum(0, (ends - place - 1) // WINDOW)
        gap = max(0, (int(place[0]) - cut - 1) // WINDOW) if count else 0
        first = cut + WINDOW * np.arange(1, gap + 1)
        more = np.repeat(place, extra) + WINDOW * (flat_ranges(np.zeros(len(extra), np.int64), extra) + 1)
        where = np.concatenate([first, place, more])
        flags = np.concatenate([np.zeros(gap, bool), flag, np.zeros(len(more), bool)])
        order = np.argsort(where, kind="stable")
        where, flags, cut = where[order], flags[order], int(place[-1])
        yield _unit_rows(text, where, flags, count)
        count += len(where)
    last = [] if pending is None else [pending[0]]
    begin = cut if count else 0
    if last and count:
        last = [*range(begin + WINDOW, pending[0], WINDOW), *last]
        begin = pending[0]
    where = np.array([*last, *range(begin + WINDOW, n, WINDOW)], np.int64)
    if len(where):
        yield _unit_rows(text, where, np.zeros(len(where), bool), count)


def _unit_rows(text, where: np.ndarray, flags: np.ndarray, count: int) -> np.ndarray:
    number = np.arange(count, count + len(where))
    return np.concatenate([_words(text, where, 2), np.stack([number, where << 2 | flags], 1).astype(np.uint64)], 1)


def _with_end(parts):
    yield from parts
    yield None


def _split(rows: Sorter, held: int, nested: bool) -> Sorter:
    """Sorted rows (two keys, unit number) to (unit number, name, whether no other unit
    has it) by unit number. A name is the place, from 1, of the first of its rows; nested:
    in the stretch of places that the first key, an older name, stands for."""
    out, done, last, begin, base = Sorter(3, 1, held), 0, None, 0, 0
    hold = np.zeros((0, 3), np.uint64)  # the last row waits for the one after it
    for part in _with_end(rows):
        x = hold if part is None else np.concatenate([hold, part])
        if not len(x):
            continue
        old = np.append(last is None or bool(x[0, 0] != last[0]), x[1:, 0] != x[:-1, 0])
        new = old | np.append(last is None or bool(x[0, 1] != last[1]), x[1:, 1] != x[:-1, 1])
        at = np.arange(done, done + len(x))
        begins, bases = (np.maximum.accumulate(np.where(w, at, v)) for w, v in ((new, begin), (old, base)))
        whole = len(x) if part is None else len(x) - 1
        alone = new[:whole] & np.append(new[1:], True)[:whole]
        names = x[:, 0] + (begins - bases).astype(np.uint64) if nested else (begins + 1).astype(np.uint64)
        out.add(np.stack([x[:whole, 2], names[:whole], alone.astype(np.uint64)], 1))
        if whole:
            last, begin, base = x[whole - 1, :2], int(begins[whole - 1]), int(bases[whole - 1])
        hold, done = x[whole:], done + whole
    return out


def _mapped(n: int, dtype) -> np.ndarray:
    """An array in an unnamed scratch file, sparse where nothing is written."""
    with tempfile.TemporaryFile() as file:
        file.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype, "r+", shape=(n,))


def seeds(text: np.ndarray, held: int = HELD) -> Iterator[np.ndarray]:
    """Places of the seeds, in the order of the first DEPTH bytes from there on. A name
    is paired with that of the last unit that its window shows to begin in it, so a pair
    covers almost twice as many bytes; units are paired while others have their names and
    those cover less than DEPTH bytes."""
    rows, n, room = Sorter(3, 2, held), 0, len(text) + 1
    marks, follow, names = _mapped(room, np.uint64), _mapped(room, np.int64), _mapped(room, np.uint64)
    covers, alike = _mapped(room, np.uint8), _mapped(room, bool)
    for part in units(text):
        rows.add(part[:, :3])
        marks[n : n + len(part)] = part[:, 3]
        n += len(part)
    marks[n], follow[n], covers[n] = len(text) << 2, n, DEPTH
    stretches = [(a, min(n, a + STRETCH)) for a in range(0, n, STRETCH)]
    places = lambda at: (marks[at] >> np.uint64(2)).astype(np.int64)
    for a, b in stretches:
        near = places(slice(a, min(n, b + WINDOW)))
        follow[a:b] = np.maximum(np.searchsorted(near, near[: b - a] + WINDOW - 1, "right") + a - 1, np.arange(a + 1, b + 1))
        covers[a:b] = WINDOW
    nested = False
    while True:
        more = False
        for part in _split(rows, held, nested):
            unit = part[:, 0].astype(np.int64)
            names[unit] = part[:, 1]
            alike[unit] = (part[:, 2] == 0) & (covers[unit] < DEPTH)
            more = more or bool(alike[unit].any())
        if not more:
            break
        rows, nested = Sorter(3, 2, held), True
        for a, b in stretches:
            then = np.asarray(follow[a:b])
            unit = np.flatnonzero(alike[a:b])
            rows.add(np.stack([names[a + unit], names[then[unit]], (a + unit).astype(np.uint64)], 1))
            alike[a:b] = False
            covers[a:b] = np.minimum(places(then) - places(slice(a, b)) + covers[then], DEPTH)
            follow[a:b] = follow[then]
    kept = Sorter(2, 1, held)
    for a, b in stretches:
        first = np.flatnonzero(marks[a:b] & _1 == _1)
        kept.add(np.stack([names[a + first], marks[a + first] >> np.uint64(2)], 1))
    del marks, follow, names, covers, alike
    for part in kept:
        yield from (part[a : a + STRETCH, 1].astype(np.int64) for a in range(0, len(part), STRETCH))


def _before(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The seven bytes before each place, the nearest lowest, and above them how many
    there are."""
    out = np.minimum(place, 7).astype(np.uint64) << _COUNT
    for k in range(7):
        out |= text[np.maximum(place - 1 - k, 0)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _scan(text, rows: np.ndarray, common: np.ndarray, wanted, queues: Queues, least: np.ndarray) -> None:
    """Pushes the predecessors of rows, in order, where wanted(byte before). least[c]:
    the least common prefix scanned since the last push to c."""
    place, before = (rows[:, 0] >> _8).astype(np.int64), rows[:, 1]
    spent = np.flatnonzero((before >> _COUNT == 0) & (place > 0))
    if len(spent):
        before = before.copy()
        before[spent] = _before(text, place[spent])
    byte = (before & _255).astype(np.int64)
    use = np.flatnonzero((place > 0) & wanted(byte))
    if not len(use):
        np.minimum(least, common.min(), out=least)
        return
    order = use[np.argsort(byte[use], kind="stable")]
    to = byte[order]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    ends = np.append(first[1:], len(order))
    past = np.minimum.accumulate(common)
    to_come = np.append(np.minimum.accumulate(common[::-1])[::-1], DEPTH)
    value = np.zeros(len(order), np.int64)
    if len(order) > 1:
        spans = np.stack([order[:-1] + 1, order[1:] + 1], 1).ravel()
        value[1:] = np.minimum.reduceat(np.append(common, DEPTH), np.minimum(spans, len(common)))[::2] + 1
    chars = to[first]
    fresh = np.array([queues.each[c].size == 0 for c in chars.tolist()])
    value[first] = np.where(fresh, 0, np.minimum(least[chars], past[order[first]]) + 1)
    np.minimum(least, past[-1], out=least)
    least[chars] = to_come[order[ends - 1] + 1]
    entries = np.empty((len(order), 2), np.uint64)
    entries[:, 0] = (place[order] - 1).astype(np.uint64) << _8 | np.minimum(value, DEPTH).astype(np.uint64)
    held = before[order]
    entries[:, 1] = (held & _LOW) >> _8 | ((held >> _COUNT) - _1) << _COUNT
    for c, a, b in zip(chars.tolist(), first.tolist(), ends.tolist()):
        queues.each[c].push(entries[a:b].copy())


def suffix_order(text: np.ndarray, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of all suffixes of text in the order of their first DEPTH bytes, and
    the bytes, up to DEPTH, that each shares with the one before it."""
    n = len(text)
    if not n:
        return

    def seam(a: int, b: int) -> int:
        return int(common_prefix(text, np.array([a]), np.array([b]))[0])

    def entries(place: np.ndarray) -> np.ndarray:
        return np.stack([place.astype(np.uint64) << _8, _before(text, place)], 1)

    large, least, last = Queues(256, held), np.full(256, DEPTH), None
    # the end of the text is a seed that comes before all others
    _scan(text, entries(np.array([n])), np.zeros(1, np.int64), lambda byte: byte >= 0, large, least)
    waiting = _by_byte(text, seeds(text, held))
    for c in range(256):
        for rows in large.each[c].upwards():
            common = (rows[:, 0] & _255).astype(np.int64)
            _scan(text, rows, common, lambda byte: byte >= c, large, least)
            last = int(rows[-1, 0] >> _8)
        for place in waiting(c):
            value = np.append(0, common_prefix(text, place[1:], place[:-1])) if len(place) > 1 else np.zeros(1, np.int64)
            value[0] = seam(last, int(place[0])) if last is not None else 0
            _scan(text, entries(place), value, lambda byte: byte >= c, large, least)
            last = int(place[-1])
    tiny, least, last = Queues(256, held), np.full(256, DEPTH), None
    for c in range(255, -1, -1):
        for rows in tiny.each[c].upwards():
            common = (rows[:, 0] & _255).astype(np.int64)
            _scan(text, rows, common, lambda byte: byte <= c, tiny, least)
            last = int(rows[-1, 0] >> _8)
        begun = False
        for rows, common in large.each[c].downwards():
            if not begun:
                common[0] = seam(last, int(rows[0, 0] >> _8)) if last is not None else 0
                begun = True
            _scan(text, rows, common, lambda byte: byte < c, tiny, least)
            last = int(rows[-1, 0] >> _8)
    last = None
    for c in range(256):
        begun = False
        for rows in large.each[c].upwards():
            place, common = (rows[:, 0] >> _8).astype(np.int64), (rows[:, 0] & _255).astype(np.int64)
            if not begun:
                common[0] = seam(last, int(place[0])) if last is not None else 0
                begun = True
            yield place, common
            last = int(place[-1])
        begun = False
        for rows, common in tiny.each[c].downwards():
            place = (rows[:, 0] >> _8).astype(np.int64)
            if not begun:
                common[0] = seam(last, int(place[0])) if last is not None else 0
                begun = True
            yield place, common
            last = int(place[-1])


def _by_byte(text: np.ndarray, stream: Iterator[np.ndarray]):
    """A function that gives, byte after byte, the places of a sorted stream that begin
    with that byte, in stretches."""
    rest: list[np.ndarray] = []

    def of(c: int) -> Iterator[np.ndarray]:
        while True:
            if not rest:
                part = next(stream, None)
                if part is None:
                    return
                rest.append(part)
            part = rest[0]
            upto = int(np.searchsorted(text[part], c, "right"))
            if upto:
                yield part[:upto]
            if upto < len(part):
                rest[0] = part[upto:]
                return
            rest.pop()

    return of
