"""Suffix-array deduplication: removes bytes of repeated 50-byte strings.

A byte goes if a string of `size` bytes that covers it also starts in a document
with a smaller doc_id. Strings are judged on the input, overlaps count, and none
reaches across documents.

1. Contexts. Of every string its least k-byte word by hash (its anchor) is the same
   wherever the string stands. Consecutive strings with the same anchor form a
   context, named by 128 bits. Contexts that are alike are reduced to the one of the
   least document, in every batch before the shuffle and then by anchor: the strings
   of all others stand there too. A context whose anchor stands in no other context
   has nothing to find.
2. Shards. Other contexts go to shards whole, by their anchor. There the groups of their
   strings, by distance from the anchor and the hash of the bytes that those share, are
   counted: of each context the stretches whose groups have other contexts are sorted.
   Frequent anchors, of more contexts than make up an eighth of `shard_bytes`, have them
   cut by group before, and go by group; beyond `shard_bytes` the groups are dealt to so
   many shards that each gets about as much. A shard holds parts of such groups, or whole
   groups and anchors.
3. Sorting. Each shard is suffix-sorted by external induction with carried common
   prefixes (suffixes.py), in memory that does not grow with it: of the strings that
   stand side by side and share 50 bytes, those not of the least document go. What is
   left of a group in several shards is written with its bytes, and goes if the least
   document of its bytes over all shards, an aggregation by Spark, is smaller.
4. Removal. Contexts and strings that go meet their document's text.

Rows: null text is empty; a null doc_id is smaller than all others; rows with the
same doc_id do not remove each other's bytes, and each is a row of its own; other
columns are ignored; no rows give no rows."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import flat_ranges, materialize, mix64, partitions, prefix_hash, sliding_hash, span_hash, text_slices, utf8_buffer
from voxmill.llm.suffixes import suffix_order

#: Bytes of a shard, of text whose contexts are reduced together, and of a slice of it.
SIZE, ANCHOR, STEP, SHARD_BYTES, TOGETHER, PIECE = 50, 20, 8, 1 << 20, 16 << 20, 1 << 20
#: Anchors with more than this part of a shard are dealt by group.
FREQUENT = 8
#: Strings whose anchors are found at a time, so that what that takes stays in caches.
BLOCK = 1 << 14
NULL_ID = -(2**63)


def contexts(raw: np.ndarray, bounds: np.ndarray, size: int = SIZE, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Of every context: owner, its first and last string's start (lo, hi), place of
    its anchor (at), and hashes of anchor (key) and context (name); h: prefix hashes."""
    h = prefix_hash(raw)
    n, width = len(raw), size - anchor + 1
    empty = np.zeros(0, np.int64)
    if n < size:
        return {"owner": empty, "lo": empty, "hi": empty, "at": empty, "key": empty, "name": empty, "h": h}
    where, anchors, before = [], [], -1
    for a in range(0, n - size + 1, BLOCK):
        low = sliding_hash(h, a, min(a + BLOCK + width - 1, n - anchor + 1), anchor)
        low &= np.uint64(0xFFFFFFFF00000000)
        low |= np.arange(len(low), dtype=np.uint64)
        least, span = low, 1
        while span * 2 <= width:  # sliding minimum by doubling
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(low) - width + 1], least[width - span :])
        new = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        at = (least[new] & np.uint64(0xFFFFFFFF)).astype(np.int64) + a
        again = int(at[0] == before)
        where.append(new[again:] + a), anchors.append(at[again:])
        before = at[-1]
    lo, at = np.concatenate(where), np.concatenate(anchors)
    # a context begins where the anchor changes, or else a text; its last string, where the next does
    begins, last = bounds[:-1], bounds[1:] - size
    full = begins[last >= begins]
    k = np.searchsorted(lo, full)
    amid = np.append(lo, n)[k] != full
    lo, at = np.insert(lo, k[amid], full[amid]), np.insert(at, k[amid], at[k[amid] - 1])
    owner = np.searchsorted(bounds, lo, "right") - 1
    inside = lo <= np.append(last, -1)[owner]
    lo, at, owner = lo[inside], at[inside], owner[inside]
    hi = np.minimum(np.append(lo[1:], n) - 1, last[owner])
    name = span_hash(h, lo, hi + size) ^ mix64((at - lo).astype(np.uint64) + np.uint64(1))
    return {"owner": owner, "lo": lo, "hi": hi, "at": at, "key": span_hash(h, at, at + anchor).view(np.int64), "name": mix64(name).view(np.int64), "h": h}


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NULL_ID))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _anchors(size: int, anchor: int):
    """(key, name, doc_id, settled): contexts of the least document of a batch, and
    those of others, which are settled by it and have their name for a key."""

    def reduced(held: list[tuple]) -> pa.RecordBatch:
        key, name, doc = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(name)
        key, name, doc = key[order], name[order], doc[order]
        first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (key[1:] != key[:-1])))
        least = np.minimum.reduceat(doc, first)
        late = doc > np.repeat(least, np.diff(np.append(first, len(doc))))
        settled = np.repeat([False, True], [len(first), late.sum()])
        return _batch(key=np.concatenate([key[first], name[late]]), name=np.concatenate([name[first], name[late]]), doc_id=np.concatenate([least, doc[late]]), settled=settled)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, TOGETHER):
                held = []
                for piece in text_slices(part, PIECE):
                    c = contexts(*utf8_buffer(piece.column("text")), size, anchor)
                    order = np.lexsort((c["name"], c["owner"]))
                    name, owner = c["name"][order], c["owner"][order]
                    new = np.ones(len(order), bool)
                    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
                    i = order[new]
                    held.append((c["key"][i], c["name"][i], _ids(piece.column("doc_id"))[c["owner"][i]]))
                if sum(len(h[0]) for h in held):
                    yield reduced(held)

    return anchors


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, name, doc_id) to (doc_id, name, key, settled):
    contexts that stand in a smaller document, and with their key the first ones of a
    context whose key has others."""

    def marked(doc, name, key=None) -> pa.RecordBatch:
        keys = pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(name), keys, pa.array(np.full(len(doc), key is None))], names=["doc_id", "name", "key", "settled"])

    key = name = doc = None  # the head of the last context
    alone = True
    for batch in batches:
        k, c, d = (np.asarray(batch.column(x)) for x in ("key", "name", "doc_id"))
        done = np.asarray(batch.column("settled").to_numpy(zero_copy_only=False), bool)
        if done.any():
            yield marked(d[done], c[done])
            k, c, d = k[~done], c[~done], d[~done]
        if not len(k):
            continue
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        head[0] = key is None or k[0] != key or c[0] != name
        at = np.flatnonzero(head)
        run = np.cumsum(head) - 1
        least = np.append(d[at], 0)[run] if doc is None else np.where(run >= 0, np.append(d[at], 0)[run], doc)
        yes = d > least
        yield marked(d[yes], c[yes])
        if len(at):
            hk = k[at] if key is None else np.concatenate([[key], k[at]])
            hc = c[at] if key is None else np.concatenate([[name], c[at]])
            hd = d[at] if key is None else np.concatenate([[doc], d[at]])
            like = hk[1:] == hk[:-1]
            before = np.concatenate([[not alone], like])
            open_ = (before | np.append(like, False))[:-1]
            yield marked(hd[:-1][open_], hc[:-1][open_], hk[:-1][open_])
            key, name, doc, alone = hk[-1], hc[-1], hd[-1], not before[-1]
    if key is not None and not alone:
        yield marked(np.array([doc]), np.array([name]), np.array([key]))


def _chosen(c: dict, piece: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are in their document's list, and where in the flat lists."""
    lists = piece.column(column).combine_chunks() if isinstance(piece.column(column), pa.ChunkedArray) else piece.column(column)
    flat = np.asarray(lists.flatten())
    owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
    if not len(flat):
        return np.zeros(len(c["name"]), bool), np.zeros(len(c["name"]), np.int64)
    # one sorted axis of (owner, name)
    mixed = mix64(flat.view(np.uint64) + mix64(owner.astype(np.uint64)))
    wanted = mix64(c["name"].view(np.uint64) + mix64(c["owner"].astype(np.uint64)))
    by = np.argsort(mixed)
    where = by[np.minimum(np.searchsorted(mixed[by], wanted), len(by) - 1)]
    return (flat[where] == c["name"]) & (owner[where] == c["owner"]), where


def _binary(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes raw[begin:end] of each."""
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[flat_ranges(begin, end - begin)])])


def _parts(near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts whose strings lie near to far bytes before their anchor: (context, part)
    of each part, of STEP distances, that has some of them."""
    near, far = near // STEP, far // STEP
    n = far - near + 1
    return np.repeat(np.arange(len(n)), n), flat_ranges(near, n)


def _group(h: np.ndarray, at: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """Hash of the bytes of all strings at a part's distances, wherever the context ends."""
    left = at - STEP * part
    return span_hash(h, left, np.maximum(left - STEP + 1 + size, left)) ^ mix64(part.astype(np.uint64))


def _pieces(size: int, anchor: int):
    """Listed contexts, whole, by their anchor (parts 0). Those of frequent anchors are cut
    by the distance of strings from it, and go by their groups; where groups are in several
    shards, to one of those by their name and document."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, PIECE):
                raw, bounds = utf8_buffer(piece.column("text"))
                c = contexts(raw, bounds, size, anchor)
                use, where = _chosen(c, piece, "names")
                i = np.flatnonzero(use)
                if not len(i):
                    continue
                i = i[np.sort(np.unique(where[i], return_index=True)[1])]  # a document's copies of its own are one
                parts = np.asarray(piece.column("parts").flatten()).astype(np.uint64)[where[i]]
                doc = _ids(piece.column("doc_id"))[c["owner"][i]]
                key, name, lo, hi, at = (c[k][i] for k in ("key", "name", "lo", "hi", "at"))

                def rows(j, task, a, b):
                    first, before = (a - lo[j]).astype(np.int32), (at[j] - a).astype(np.int32)
                    columns = [*map(pa.array, (task, parts[j] > 1, doc[j], name[j], first, before)), _binary(raw, a, b + size)]
                    return pa.RecordBatch.from_arrays(columns, names=["task", "parted", "doc_id", "name", "first", "anchor", "bytes"])

                j = np.flatnonzero(parts == 0)
                if len(j):
                    yield rows(j, key[j], lo[j], hi[j])
                many = np.flatnonzero(parts > 0)
                if len(many):
                    j, part = _parts((at - hi)[many], (at - lo)[many])
                    j = many[j]
                    a = np.maximum(lo[j], at[j] - STEP * part - STEP + 1)
                    b = np.minimum(hi[j], at[j] - STEP * part)
                    salt = mix64(name[j].view(np.uint64) + mix64(doc[j].view(np.uint64))) % parts[j]
                    task = mix64(mix64(_group(c["h"], at[j], part, size)) + salt)
                    yield rows(j, task.view(np.int64), a, b)

    return pieces


def _matched(size: int):
    """Of rows sorted by (task, parted), the stretches of strings whose groups have other
    contexts in them: nothing can match the others. Parts of groups go as they are."""

    def stretches(batch: pa.RecordBatch) -> pa.RecordBatch:
        task, doc, name, first, anchor = (np.asarray(batch.column(x)) for x in ("task", "doc_id", "name", "first", "anchor"))
        raw, offsets = _bytes(batch)
        last = np.diff(offsets) - size
        anchor = anchor.astype(np.int64)
        j, part = _parts(anchor - last, anchor)
        group = mix64(_group(prefix_hash(raw), offsets[j] + anchor[j], part, size) + mix64(task.view(np.uint64))[j])
        order = np.argsort(group)
        same = group[order[1:]] == group[order[:-1]]
        some = np.zeros(len(j), bool)
        some[order] = np.append(same, False) | np.append(False, same)
        # parts that follow one another are one stretch again
        j, part = j[some], part[some]
        begins = np.append(True, (j[1:] != j[:-1]) | (part[1:] != part[:-1] + 1))[: len(j)]
        at = np.flatnonzero(begins)
        near, far, j = part[at], part[np.append(at[1:], len(part)) - 1] if len(at) else part, j[at]
        a = np.maximum(0, anchor[j] - STEP * far - STEP + 1)
        b = np.minimum(last[j], anchor[j] - STEP * near)
        columns = [*map(pa.array, (task[j], np.zeros(len(j), bool), doc[j], name[j], (first[j] + a).astype(np.int32))), _binary(raw, offsets[j] + a, offsets[j] + b + size)]
        return pa.RecordBatch.from_arrays(columns, names=["task", "parted", "doc_id", "name", "first", "bytes"])

    def joined(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        return pa.Table.from_batches(held).combine_chunks().to_batches() if held else []

    def once(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, name = (np.asarray(batch.column(x)) for x in ("doc_id", "name"))
        order = np.lexsort((doc, name))
        new = np.append(True, (doc[order[1:]] != doc[order[:-1]]) | (name[order[1:]] != name[order[:-1]]))
        return batch.take(pa.array(np.sort(order[new])))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, room = [], None, TOGETHER  # of the last whole task, which may go on
        for batch in batches:
            parted = batch.column("parted")
            parts, batch = batch.filter(parted), batch.filter(pc.invert(parted))
            if parts.num_rows:
                yield parts.drop_columns(["anchor"])
            if batch.num_rows:
                task = np.asarray(batch.column("task"))
                upto = int(np.searchsorted(task, task[-1]))
                if upto or task[0] != last:
                    yield from map(stretches, joined([*held, *([batch.slice(0, upto)] if upto else [])]))
                    held, room = [], TOGETHER
                held.append(batch.slice(upto))
                last = task[-1]
                if sum(x.nbytes for x in held) > room:
                    # rows of one doc_id may have the same contexts; but for those, a task is bounded
                    held = [once(x) for x in joined(held)]
                    room = max(TOGETHER, 2 * sum(x.nbytes for x in held))
        yield from map(stretches, joined(held))

    return matched


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, one after the other, and where each begins and ends."""
    data = batch.column("bytes").cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Grown:
    """Rows of a type that are appended to; a mapped scratch file beyond a bound."""

    def __init__(self, dtype, bound: int):
        self.dtype, self.bound, self.parts, self.n, self.file = np.dtype(dtype), bound, [], 0, None

    def add(self, rows: np.ndarray) -> None:
        self.parts.append(rows.astype(self.dtype, copy=False))
        self.n += len(rows)
        if self.file or self.n * self.dtype.itemsize > self.bound:
            self.file = self.file or tempfile.TemporaryFile()
            for part in self.parts:
                self.file.write(part.tobytes())
            self.parts = []

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([*self.parts, np.zeros(0, self.dtype)])
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r", shape=(self.n,))


class Shard:
    """Pieces as one text, each ended by byte 0, and what is known of each."""

    def __init__(self, size: int, bound: int):
        self.size, self.bound, self.bytes = size, bound, 0
        self.text = Grown(np.uint8, bound)
        self.about = {k: Grown(t, bound) for k, t in (("begin", np.int64), ("length", np.int32), ("doc", np.int64), ("name", np.int64), ("first", np.int32), ("parted", bool))}

    def add(self, batch: pa.RecordBatch) -> None:
        raw, offsets = _bytes(batch)
        length = np.diff(offsets)
        begin = offsets[:-1] + np.arange(len(length))
        text = np.zeros(len(raw) + len(length), np.uint8)
        text[flat_ranges(begin, length)] = raw
        self.text.add(text)
        rest = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("doc_id", "name", "first", "parted"))
        for grown, rows in zip(self.about.values(), (begin + self.bytes, length, *rest)):
            grown.add(rows)
        self.bytes += len(text)

    def strings(self) -> Iterator[pa.RecordBatch]:
        """Strings that go; of parts of groups also those that stay, with their bytes."""
        text, size = self.text.array(), self.size
        begin, length, doc, name, first, parted = (g.array() for g in self.about.values())
        run = 0
        # whose piece each byte is; for a text in a file that is searched for
        own = None if isinstance(text, np.memmap) else np.repeat(np.arange(len(length), dtype=np.int32), length + 1)
        held = np.zeros((0, 3), np.int64)  # of the last run, those of its least document: owner, place, run
        for order, common in suffix_order(text):
            runs = run + np.cumsum(common < size)
            owner = np.searchsorted(begin, order, "right") - 1 if own is None else own[order].astype(np.int64)
            place = order - begin[owner]
            whole = place <= length[owner] - size  # else no string starts here
            rows = np.concatenate([held, np.stack([owner, place, runs], 1)[whole]])
            run = int(runs[-1])
            if not len(rows):
                continue
            d = doc[rows[:, 0]]
            at = np.flatnonzero(np.append(True, rows[1:, 2] != rows[:-1, 2]))
            least = np.repeat(np.minimum.reduceat(d, at), np.diff(np.append(at, len(rows))))
            gone = d > least
            hold = ~gone & (rows[:, 2] == run)
            held = rows[hold]
            yield self._out(rows[~hold], gone[~hold], text, doc, name, first, parted)
        yield self._out(held, np.zeros(len(held), bool), text, doc, name, first, parted)

    def _out(self, rows, gone, text, doc, name, first, parted) -> pa.RecordBatch:
        use = gone | parted[rows[:, 0]]
        rows, gone = rows[use], gone[use]
        owner, place = rows[:, 0], rows[:, 1]
        at = self.about["begin"].array()[owner[~gone]] + place[~gone]
        strings = text[at[:, None] + np.arange(self.size)].tobytes()
        offsets = np.cumsum(np.concatenate([[0], np.where(gone, 0, self.size)])).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(rows), [pa.array(~gone).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(strings)])
        return _batch(doc_id=doc[owner], name=name[owner], string=(place + first[owner]).astype(np.int32), bytes=held)


def _sort(size: int, shard_bytes: int):
    """Rows sorted by shard key (task); shards take whole keys until they are full."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, task = Shard(size, shard_bytes), None
        for batch in batches:
            tasks = np.asarray(batch.column("task"))
            if not len(tasks):
                continue
            # nothing can match the only piece of a whole group; the last key may go on in the next batch
            other = np.concatenate([[task is None or tasks[0] != task], tasks[1:] != tasks[:-1], [False]])
            some = ~(other[:-1] & other[1:]) | batch.column("parted").to_numpy(zero_copy_only=False)
            batch, tasks, fresh = batch.filter(pa.array(some)), tasks[some], other[:-1][some]
            cuts = np.flatnonzero(fresh)
            upto = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column("bytes"))) + 1)])
            a = 0
            while True:
                # the first key that begins when the shard is full
                full = cuts[np.searchsorted(upto[cuts], upto[a] + shard_bytes - shard.bytes) :] if shard.bytes < shard_bytes else cuts[cuts >= a]
                b = int(full[0]) if len(full) else len(tasks)
                if b > a:
                    shard.add(batch.slice(a, b - a))
                if not len(full):
                    break
                yield from shard.strings()
                shard, a = Shard(size, shard_bytes), b
            task = tasks[-1]
        if shard.bytes:
            yield from shard.strings()

    return sort


def _remove(size: int, anchor: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, PIECE):
                raw, bounds = utf8_buffer(piece.column("text"))
                edge = np.zeros(len(raw) + 1, np.int32)
                if len(piece.column("settled").flatten()) or len(piece.column("names").flatten()):
                    c = contexts(raw, bounds, size, anchor)
                    use, _ = _chosen(c, piece, "settled")
                    np.add.at(edge, c["lo"][use], 1)
                    np.add.at(edge, c["hi"][use] + size, -1)
                    use, where = _chosen(c, piece, "names")
                    strings = piece.column("strings").flatten()
                    offsets, where = np.asarray(strings.offsets), where[use]
                    n = offsets[where + 1] - offsets[where]
                    start = np.repeat(c["lo"][use], n) + np.asarray(strings.values)[flat_ranges(offsets[where], n)]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = raw[~gone].tobytes()
                upto = np.concatenate([[0], np.cumsum(~gone)])[bounds]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                cut = bounds[:-1][bounds[:-1] < len(raw)]
                begins[cut] = gone[cut]
                spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[bounds])
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n), pa.array(n - np.diff(upto)), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.string()), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(kept)])],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return remove


def _sized(first: DataFrame, each: int, shard_bytes: int) -> DataFrame:
    """Contexts with the number of shards (parts) of their anchor's groups, 0 for anchors
    whose contexts are at most a FREQUENT part of a shard; each: the most bytes of a context,
    with one for its end. Of other anchors there is one for so many bytes of contexts at
    most, so they are sent to the tasks and no anchor's contexts meet in one."""
    total = F.count("*") * each
    frequent = first.groupBy("key").agg(total.alias("total")).where(F.col("total") > shard_bytes // FREQUENT)
    sized = frequent.select("key", F.ceil(F.col("total") / shard_bytes).alias("parts"))
    return first.join(F.broadcast(sized), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))


def remove_repeats(documents: DataFrame, size: int = SIZE, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.mapInArrow(_anchors(size, anchor), "key long, name long, doc_id long, settled boolean")
    # settled ones only pass through, wherever there is room
    to = F.when(F.col("settled"), F.xxhash64("doc_id", "name")).otherwise(F.col("key"))
    dealt = keyed.repartition(partitions(spark), to).sortWithinPartitions("key", "name", "doc_id")
    marks = materialize(dealt.mapInArrow(_settle, "doc_id long, name long, key long, settled boolean"), "marks")

    whole = F.coalesce("doc_id", F.lit(NULL_ID))
    listed = lambda df, **columns: docs.withColumn("own", whole).join(df.groupBy(F.col("doc_id").alias("own")).agg(*(v.alias(k) for k, v in columns.items())), "own", "left")
    first = marks.where("not settled")
    first = _sized(first, 2 * size - anchor + 1, shard_bytes)
    pairs = F.collect_set(F.struct("name", "parts"))
    open_ = first.groupBy(F.col("doc_id").alias("own")).agg(pairs.alias("p")).select("own", F.col("p.name").alias("names"), F.col("p.parts").alias("parts"))
    cut = docs.withColumn("own", whole).join(open_, "own").select("doc_id", "text", "names", "parts").mapInArrow(_pieces(size, anchor), "task long, parted boolean, doc_id long, name long, first int, anchor int, bytes binary")
    dealt = cut.repartition(partitions(spark), "task").sortWithinPartitions("task", "parted")
    matched, sort = _matched(size), _sort(size, shard_bytes)
    found = materialize(dealt.mapInArrow(lambda batches: sort(matched(batches)), "doc_id long, name long, string int, bytes binary"), "strings")
    candidates = found.where("bytes is not null")
    later = candidates.join(candidates.groupBy("bytes").agg(F.min("doc_id").alias("least")), "bytes").where("doc_id > least")
    found = found.where("bytes is null").drop("bytes").unionByName(later.select("doc_id", "name", "string"))

    strings = found.groupBy("doc_id", "name").agg(F.collect_set("string").alias("strings")).withColumn("settled", F.lit(None).cast("long"))
    every = marks.where("settled").select("doc_id", F.lit(None).cast("long").alias("name"), F.lit(None).cast("array<int>").alias("strings"), F.col("name").alias("settled")).unionByName(strings)
    pair = F.when(F.col("name").isNotNull(), F.struct("name", "strings"))
    joined = listed(every, settled=F.collect_list("settled"), pairs=F.collect_list(pair))
    ready = joined.select("doc_id", "text", F.coalesce("settled", F.array().cast("array<long>")).alias("settled"), F.coalesce(F.col("pairs.name"), F.array().cast("array<long>")).alias("names"), F.coalesce(F.col("pairs.strings"), F.array().cast("array<array<int>>")).alias("strings"))
    return ready.mapInArrow(_remove(size, anchor), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: Strings in hexadecimal, of stretches of 512 places at a time.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, j, h[2 * j + 1 : 2 * j + {2 * (512 + SIZE - 1)}] AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - {SIZE - 1}), 512)) AS j FROM d)),
s AS (SELECT doc_id, j + i AS i, h[2 * i + 1 : 2 * i + {2 * SIZE}] AS g FROM (SELECT doc_id, j, h, unnest(range(0, least(512, len(h) // 2 - {SIZE - 1}))) AS i FROM q)),
m AS (SELECT g, min(doc_id) AS lo FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i FROM s JOIN m USING (g) WHERE doc_id > lo),
b AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {SIZE} THEN 0 ELSE 1 END AS fresh FROM c)),
r AS (SELECT doc_id, min(i) AS a, max(i) + {SIZE} AS e FROM b GROUP BY doc_id, run),
p AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM r),
k AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS e, string_agg(h[2 * f + 1 : 2 * a], '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN e IS NULL THEN h ELSE kept || h[2 * e + 1 :] END)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
