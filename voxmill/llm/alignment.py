"""Alignment of two tokenizers' tokens, and how often their ids meet in a corpus.

Both tokenizers cut a document's bytes; where tokens of both end, the document can be cut
for both. These places are found by dividing: of an interval the common end nearest to the
middle token is sought by bisecting the other tokenizer's ends, in rings of doubled width;
both sides are divided on, less the ring that is known to hold no other, and an interval
without one is a group. All intervals of many documents are divided together, level by
level, so no step is a loop over tokens, and no end is looked at more than a few times.

A link is a pair of tokens that share a byte. Each document keeps its distinct pairs of ids
and how often it has them; the corpus-wide counts are sums of these. Counts of the most
frequent pairs, at most HEAD of them, are sent to all tasks; of the other pairs each is rare
(fewer links than the least frequent of the head), and these are joined by shuffle.

Rows: a null or empty text, and one whose tokens' bytes are not a space and the text, has no
tokens and no links; a null doc_id and repeated rows are documents of their own, and each
counts; other columns are ignored; no rows give no rows."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import flat_ranges, materialize, text_slices, utf8_buffer
from voxmill.llm.encoder import tokenizer_path
from voxmill.llm.pieces import MODEL, SLICE, Pieces
from voxmill.llm.runs import Runs

BYTE_MODEL = "byte_bpe_50k.json"
#: Pairs of ids that are sent to all tasks (17 bytes each), and bytes of texts that are
#: aligned at a time.
HEAD, TOGETHER = 1 << 20, 1 << 20
NONE = np.iinfo(np.int64).max
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"
GROUPS = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
#: Kinds of bytes: 1 ASCII letters, 2 digits, 3 punctuation, 4 the apostrophe, 5 the
#: space, 6 other white space.
KIND = np.zeros(257, np.uint8)
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
KIND[ord("'")] = 4
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[32] = 5
KIND[9:14] = 6
#: Fixed value: the pre-tokenizer whose words KIND tells apart.
WORDS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones stand
    for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def word_cuts(raw: np.ndarray) -> np.ndarray:
    """Places where the pre-tokenizer certainly begins a word, whatever stands around: a
    change of kind, a white space after a word, and a space before one."""
    kind = KIND[raw]
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        a, b, c = kind[:-1], kind[1:], np.append(kind[2:], 0)
        change = (a >= 1) & (a <= 3) & (b >= 1) & (b <= 4) & (a != b) & ~((a == 3) & (b == 4))
        cut[1:-1] = change | (b >= 5) & (a >= 1) & (a <= 4) | (b == 5) & (c >= 1) & (c <= 4)
    return cut


class ByteTokens:
    """Encodes with a byte-level tokenizer; special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as file:
            about = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        words = about["pre_tokenizer"] or {}
        self.by_words = about["normalizer"] is None and {k: words.get(k) for k in WORDS} == WORDS and all(t["special"] for t in about["added_tokens"])
        alphabet, vocabulary = byte_alphabet(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.runs = Runs(self._encoded, self.bytes)

    def _encoded(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)
        return np.array([i for x in found for i in x.ids], np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, bounds of each text's ids, and whether their bytes are the text."""
        cut = word_cuts(raw) if self.by_words else np.zeros(len(raw) + 1, bool)
        cut[bounds] = True
        starts = np.flatnonzero(cut)
        ids, sizes, same = self.runs.look_up(raw, starts)
        at = np.searchsorted(starts, bounds)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[at], np.diff(np.concatenate([[0], np.cumsum(~same)])[at]) == 0


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Indexes into the ascending ends a of those that are in b too, in order. first, last:
    of each document, its first and its last token in a; the last one's end is shared."""
    found = [last]
    lo, hi = first.astype(np.int64), last.astype(np.int64)  # where further shared ends may lie
    middle = (lo + hi) // 2
    left, right, reach = middle, middle, np.zeros(len(lo), np.int64)  # [left, right) has none
    while True:
        on = (left > lo) | (right < hi)
        lo, hi, middle, left, right, reach = (x[on] for x in (lo, hi, middle, left, right, reach))
        if not len(lo):
            return np.sort(np.concatenate(found))
        ring_lo, ring_hi = np.maximum(lo, middle - reach), np.minimum(hi, middle + reach + 1)
        sizes = (left - ring_lo) + (ring_hi - right)
        places = flat_ranges(np.stack([ring_lo, right], 1).ravel(), np.stack([left - ring_lo, ring_hi - right], 1).ravel())
        at = np.searchsorted(b, a[places])
        shared = np.flatnonzero(b[at] == a[places])
        owner = np.repeat(np.arange(len(lo)), sizes)[shared]
        places = places[shared]
        # the nearest to the middle, the lower of two that are as near
        far = 2 * np.abs(places - middle[owner]) + (places > middle[owner])
        least, starts = np.full(len(lo), NONE), np.flatnonzero(np.diff(owner, prepend=-1))
        if len(owner):
            least[owner[starts]] = np.minimum.reduceat(far, starts)
        hit = least < NONE
        d, above = least[hit] // 2, least[hit] % 2
        m, below_lo, below_hi, above_hi = middle[hit], lo[hit], middle[hit] - d, hi[hit]
        found.append(m + np.where(above == 1, d, -d))
        above_lo = m + d + ((above == 1) | (d == 0))
        lo = np.concatenate([lo[~hit], below_lo, above_lo])
        hi = np.concatenate([hi[~hit], np.maximum(below_lo, below_hi), np.maximum(above_lo, above_hi)])
        fresh = (lo[len(ring_lo[~hit]) :] + hi[len(ring_lo[~hit]) :]) // 2
        middle, left, right = (np.concatenate([x[~hit], fresh]) for x in (middle, ring_lo, ring_hi))
        reach = np.concatenate([np.maximum(1, 2 * reach[~hit]), np.zeros(2 * len(m), np.int64)])


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), Pieces(b_path)
        self.written = {s: [f"{i}{s}" for i in range(max(len(self.a.bytes), len(self.b.bytes)))] for s in ",|;"}

    def align(self, texts: pa.Array, keep: bool) -> Iterator[pa.RecordBatch]:
        """Results of texts, without the columns that name them."""
        texts = texts.cast(pa.large_string())
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        some = lengths > 0
        full = texts.filter(pa.array(some))
        raw, bounds = utf8_buffer(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), full, pa.scalar("", pa.large_string())))
        a_ids, a_bounds, whole = self.a.encode(raw, bounds)
        b = self.b.encode(full)
        b_ids, b_bounds = b["ids"], b["bounds"]
        whole &= b["plain"]
        some[some] = whole
        kept = np.flatnonzero(whole)
        upto = np.concatenate([[0], np.cumsum(some)])
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // TOGETHER)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(some)]):
            own = kept[upto[i] : upto[j]]
            pick = lambda ids, limits: (ids[flat_ranges(limits[own], limits[own + 1] - limits[own])], limits[own + 1] - limits[own])  # noqa: E731,B023
            yield self._linked(some[i:j], *pick(a_ids, a_bounds), *pick(b_ids, b_bounds), keep)

    def _linked(self, some: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, keep: bool) -> pa.RecordBatch:
        """some: which of the texts have tokens; the tokens and their numbers are of these."""
        a_upto, b_upto = np.cumsum(n_a), np.cumsum(n_b)
        a_end, b_end = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        cuts = shared_cuts(a_end, b_end, a_upto - n_a, a_upto - 1)
        b_cuts = np.searchsorted(b_end, a_end[cuts])
        a_sizes, b_sizes = np.diff(cuts, prepend=-1), np.diff(b_cuts, prepend=-1)
        groups = np.diff(np.searchsorted(cuts, a_upto - 1, "right"), prepend=0)
        # of each token of A, the tokens of B from its first to its last byte
        begin = np.searchsorted(b_end, a_end - self.a.sizes[a], "right")
        links = np.searchsorted(b_end, a_end, "left") - begin + 1
        n_links = np.diff(np.concatenate([[0], np.cumsum(links)])[a_upto], prepend=0)
        wide, pairs = len(self.b.bytes), len(self.a.bytes) * len(self.b.bytes)
        key = np.repeat(np.repeat(np.arange(len(n_a)) * pairs, n_a) + a.astype(np.int64) * wide, links) + b[flat_ranges(begin, links)]
        key, times = np.unique(key, return_counts=True)
        document = key // pairs
        shas = self._shas(a, b, a_sizes, b_sizes, a_upto, b_upto)

        def spread(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(some), np.int64)
            out[some] = x
            return out

        def lists(values: np.ndarray, numbers: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spread(numbers))]), pa.int32()), pa.array(values, pa.int32()))

        texts = np.full(len(some), "", object)
        texts[some] = shas
        distinct = np.bincount(document, minlength=len(n_a))
        out = {"n_a": spread(n_a), "n_b": spread(n_b), "n_groups": spread(groups), "n_links": spread(n_links), "groups_sha256": pa.array(texts, pa.string())}
        out |= {"a": lists(key % pairs // wide, distinct), "b": lists(key % wide, distinct), "times": lists(times, distinct)}
        if keep:
            out |= {"a_ids": lists(a, n_a), "b_ids": lists(b, n_b), "a_sizes": lists(a_sizes, groups), "b_sizes": lists(b_sizes, groups)}
        return pa.RecordBatch.from_pydict(out)

    def _shas(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> list[str]:
        """Hashes of the groups, written out: tokens of A stand before those of B in each."""
        n, wide = len(a) + len(b), max(len(self.a.bytes), len(self.b.bytes))
        a_groups, b_groups = np.cumsum(a_sizes), np.cumsum(b_sizes)
        ids, sign = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ids[np.arange(len(a)) + np.repeat(b_groups - b_sizes, a_sizes)] = a
        ids[np.arange(len(b)) + np.repeat(a_groups, b_sizes)] = b
        sign[a_groups + b_groups - b_sizes - 1] = 1
        sign[a_groups + b_groups - 1] = 2
        table = [*self.written[","], *self.written["|"], *self.written[";"]]
        parts = list(map(table.__getitem__, (ids + sign * wide).tolist()))
        upto = (a_upto + b_upto).tolist()
        return [hashlib.sha256("".join(parts[i:j])[:-1].encode()).hexdigest() for i, j in zip([0, *upto], upto)]


@lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """Both tokenizers, kept by the worker for its next tasks."""
    return Aligner(a_path, b_path)


def align(docs: DataFrame, a_model: str | None = None, b_model: str | None = None, groups: bool = False) -> DataFrame:
    """Of each text of (doc_id, text): numbers of tokens, groups and links, the groups' hash,
    and its distinct pairs of ids (a, b) with the times it has them. groups: also the ids
    of both tokenizers, and how many of each every group has."""
    paths = a_model or tokenizer_path(BYTE_MODEL), b_model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = aligner_of(*paths), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in text_slices(whole, SLICE):
                done = 0
                for found in aligner.align(batch.column("text"), groups):
                    n = found.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(done, n), *found.columns], names=["row", "doc_id", *found.schema.names])
                    row, done = row + n, done + n

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, f"{ALIGNED}, {GROUPS}" if groups else ALIGNED)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and times of all pairs, and bounds of each row's."""
    values = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(batch.column("times")), 0).to_numpy(zero_copy_only=False)
    return values("a") << 32 | values("b"), values("times"), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each pair of ids, and whether no other pair of its b has
    more. Rows are summed batch by batch before the shuffle. A window over one b holds at
    most a row for each id of A."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, times, _ = _flat(batch)
            if len(key):
                key, at = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(key >> 32, pa.int32()), "b": pa.array(key & 0xFFFFFFFF, pa.int32()), "n": pa.array(np.bincount(at, times).astype(np.int64))})

    counts = aligned.select("a", "b", "times").mapInArrow(partial, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def most_frequent(pairs: DataFrame, most: int) -> tuple[int, bool]:
    """The least n of the most frequent pairs, a power of 2, so that there are at most
    `most` of these; and whether there are other pairs."""
    levels = {r[0]: r[1] for r in pairs.groupBy(F.length(F.bin("n")).alias("digits")).count().collect()}
    least, total = max(levels, default=0) + 1, 0
    for digits in sorted(levels, reverse=True):
        total += levels[digits]
        if total > most:
            break
        least = digits
    return 1 << max(0, least - 1), any(d < least for d in levels)


def link_counts(aligned: DataFrame, pairs: DataFrame, most: int = HEAD) -> DataFrame:
    """aligned, without its lists, with n_best and count_sum: links whose pair is the best of
    its b, and the sum of the links' counts."""
    spark = aligned.sparkSession
    least, others = most_frequent(pairs, most)
    head = pairs.where(F.col("n") >= least).toPandas()
    keys = head["a"].to_numpy(np.int64) << 32 | head["b"].to_numpy(np.int64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], head["n"].to_numpy(np.int64)[order], head["best"].to_numpy(bool)[order]))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def met(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = sent.value[0]
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        return at, known[at] == key if len(known) else np.zeros(len(key), bool)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, times, bounds = _flat(batch)
            at, hit = met(key)
            _, n, best = sent.value
            summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])  # noqa: E731,B023
            counts = [summed(np.where(hit, times * x[at], 0) if len(x) else times * 0) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, counts)], names=[*names, "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, times, bounds = _flat(batch)
            own = ~met(key)[1]
            rows = np.repeat(batch.column("row").to_numpy(), np.diff(bounds))[own]
            key = key[own]
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows), "a": pa.array(key >> 32, pa.int32()), "b": pa.array(key & 0xFFFFFFFF, pa.int32()), "times": pa.array(times[own])})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in names)
    out = aligned.select(*names, "a", "b", "times").mapInArrow(total, f"{kinds}, n_best long, count_sum long")
    if others:
        rare = aligned.select("row", "a", "b", "times").mapInArrow(rest, "row long, a int, b int, times long").join(pairs.where(F.col("n") < least), ["a", "b"])
        more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("_best", "_sum")
    return out.drop("row")


def digest(docs: DataFrame, most: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    aligned = materialize(align(docs), "aligned")
    pairs = materialize(pair_counts(aligned), "pairs")
    return link_counts(aligned, pairs, most)
