"""Exact top-k search: BM25 over sharded inverted indexes with block-max pruning.

Terms are runs of ASCII letters and digits and of other characters than ASCII, A-Z
in lower case. N, df and the average length are those of the whole corpus, so
shards score alike and their results merge exactly.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5))
    score = sum of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))

A query is a bag of all its distinct terms. `most_terms` keeps of each only those of
greatest tf * idf among those that stand in another row too (ties: by hash).

Documents are dealt to the tasks, and each task gets all queries once, into an
unnamed scratch file; so the shuffle grows with documents and queries, not with
their product. A task indexes its documents shard by shard, those of a group (much the
same frequent terms: a language, say) and of like length side by side, so that the
maxima of a block are near what its documents have. Rare terms of a batch
of queries are summed by their postings first. Common ones, whose postings are held
as columns over all documents of the shard, come last, by WAND's two tests against a
query's k-th best score so far, of all shards of the task. Where all lists at their
maxima do not reach it, there is no pivot in the shard and the query is done with it.
Else sections of blocks are taken by their bounds, the greatest sum of rare terms
and the block maxima of common ones, and only queries whose score the bound reaches
are scored on a section: all its documents in float32, and in float64 those that this
sum, with its greatest error, lets into the top k. Nothing that could enter the top k
is skipped. Rows with one text are one document of a shard; rows of a text beyond the k
with the least ids are never hits and not indexed.

Rows: null and empty texts match nothing, and as queries return nothing; rows with
the same doc_id are hits of their own; queries have distinct ids; a null query id is
no query; equal scores (to 6 decimals) go by doc_id; other columns are ignored; no
rows give no rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import flat_ranges, materialize, partitions, text_slices, utf8_buffer, word_hash
from voxmill.llm.shingles import FOLDED

K1, B, TOP, BLOCK, SHARD_DOCS, SLICE = 1.2, 0.75, 10, 64, 5_000, 1 << 20
#: Terms of a shard's documents at most; blocks that are scored together; terms by which
#: groups are told apart, and queries that these are learned from; copied texts that are
#: broadcast; the greatest share by which a sum in float32 is wrong.
SHARD_TERMS, SECTION, GROUP_TERMS, GROUP_QUERIES, COPIED, ERROR = 2 << 20, 8, 512, 1_000, 100_000, 1e-4
#: Terms in more than a share of a shard's documents, and of all queries, by the mean of
#: logarithms, are common, up to a number; and queries, and terms of theirs, that are scored
#: together.
COMMON_SHARE, COMMON, QUERIES, QUERY_TERMS = 0.035, 1536, 256, 80_000
#: Tasks that documents are dealt to.
PARTS = 24
NULL_ID = -(2**63)
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of every text's distinct terms, sorted by owner and
    hash, and each text's length in terms."""
    raw, bounds = utf8_buffer(texts)
    inside = IN_TERM[raw]
    begins, stops = inside.copy(), inside.copy()
    if len(raw):
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cut = bounds[:-1][bounds[:-1] < len(raw)]
        begins[cut] = inside[cut]
        edge = bounds[1:][bounds[1:] > 0] - 1
        stops[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    word = word_hash(raw, start, end, FOLDED).view(np.int64)
    first = np.searchsorted(start, bounds)
    length = np.diff(first)
    owner = np.repeat(np.arange(len(length)), length)
    order = np.lexsort((word, owner))
    owner, word = owner[order], word[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], word[at], np.diff(np.append(at, len(word))), length


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of a task's documents, flushed when many are held; and the sum of
    lengths and the number of rows under term null."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = rows = total = 0

    def merged():
        word, count = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(word, kind="stable")
        word, count = word[order], count[order]
        at = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        return word[at], np.add.reduceat(count, at) if len(at) else count

    for batch in batches:
        for piece in text_slices(batch, SLICE):
            _, word, _, length = term_counts(piece.column("text"))
            held.append(np.unique(word, return_counts=True))
            rows, total, size = rows + piece.num_rows, total + int(length.sum()), size + len(held[-1][0])
            if size > 1_000_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1]), pa.array(np.zeros(size, np.int64))], names=["term", "df", "total"])
                    held, size = [], 0
    if held:
        word, df = merged()
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(df), pa.array(np.zeros(len(word), np.int64))], names=["term", "df", "total"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows]), pa.array([total])], names=["term", "df", "total"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch, SLICE):
            owner, word, tf, _ = term_counts(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(owner)), pa.array(word), pa.array(tf)], names=["query_id", "term", "qtf"])


def _documents(groups: Groups):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, SLICE):
                owner, word, tf, length = term_counts(piece.column("text"))
                group = groups.of(owner, word, len(length)).astype(np.int32)
                bounds = pa.array(np.searchsorted(owner, np.arange(len(length) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (word, tf.astype(np.int32))]
                found = pa.RecordBatch.from_arrays([piece.column("row"), piece.column("doc_id"), piece.column("digest"), pa.array(group), pa.array(length), *lists], names=["id", "doc_id", "digest", "group", "length", "terms", "counts"])
                yield found.filter(pa.array(length > 0))

    return documents


class Terms:
    """Distinct hashes in order, each found by its first bits."""

    def __init__(self, term: np.ndarray):
        self.size, self.padded = len(term), np.append(term, np.iinfo(np.int64).max)
        self.bits = max(1, self.size.bit_length())
        self.start = np.searchsorted(self._head(term), np.arange((1 << self.bits) + 1))
        self.deep = int(np.diff(self.start).max())

    def _head(self, term: np.ndarray) -> np.ndarray:
        return ((term.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each term, and whether it is there."""
        at = self.start[self._head(term)]
        for _ in range(self.deep):
            at += self.padded[at] < term
        return at, (self.padded[at] == term) & (at < self.size)


class Groups:
    """Rows that hold much the same frequent terms, by the nearest of some centres. They
    decide which rows lie side by side, and so how much is skipped; never what is found."""

    def __init__(self, bags: list[np.ndarray], most: int = 8, turns: int = 8):
        terms = np.concatenate([*bags, np.zeros(0, np.int64)])
        found, df = np.unique(terms, return_counts=True)
        top = np.sort(np.argsort(-df, kind="stable")[:GROUP_TERMS])
        self.terms, self.idf = Terms(found[top]), np.log(1 + len(bags) / df[top]).astype(np.float32)
        x = self._unit(self._rows(np.repeat(np.arange(len(bags)), [len(b) for b in bags]), terms, len(bags)))
        x = x[x.any(1)]
        self.centres = np.zeros((1, len(top)), np.float32)
        if not len(x):
            return
        at = [0]
        near = x @ x[0]
        while len(at) < min(most, len(x)):
            at.append(int(near.argmin()))
            near = np.maximum(near, x @ x[at[-1]])
        self.centres = x[at]
        for _ in range(turns):
            own = (x @ self.centres.T).argmax(1)
            self.centres = self._unit(np.stack([x[own == i].sum(0) if (own == i).any() else c for i, c in enumerate(self.centres)]))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def _rows(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        at, known = self.terms.find(term)
        x = np.zeros((n, self.terms.size), np.float32)
        x[owner[known], at[known]] = self.idf[at[known]]
        return x

    def of(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *((self._rows(owner[a:b] - i, term[a:b], min(1000, n - i)) @ self.centres.T).argmax(1) for i in range(0, n, 1000) for a, b in [np.searchsorted(owner, (i, i + 1000))])])


class Queries:
    """A task's queries by group and size: ids and bounds in memory, with the distinct
    terms of all and their weights; places in those in a scratch file; and the best hits of
    each so far."""

    def __init__(self, k: int, groups: Groups):
        self.k, self.groups, self.ids, self.sizes, self.group = k, groups, [], [], []
        self.file, self.held, self.n_held = tempfile.TemporaryFile(), [], 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        self.ids.append(ids), self.sizes.append(sizes)
        self.group.append(self.groups.of(np.repeat(np.arange(len(ids)), sizes), terms, len(ids)))
        self.file.write(terms.tobytes())
        self.held.append((terms, weights, np.ones(len(terms), np.int64)))
        self.n_held += len(terms)
        if self.n_held > 2_000_000:
            self._merge_terms()

    def _merge_terms(self) -> None:
        terms, weights, asked = (np.concatenate(x) for x in zip(*self.held or [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]))
        order = np.argsort(terms, kind="stable")
        terms, weights, asked = terms[order], weights[order], asked[order]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else order
        self.held, self.n_held = [(terms[first], weights[first], np.add.reduceat(asked, first) if len(first) else asked)], 0

    def close(self) -> None:
        self._merge_terms()
        [(terms, self.weight, self.asked)] = self.held
        self.terms, self.held = Terms(terms), []
        join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
        ids, sizes, group = join(self.ids), join(self.sizes), join(self.group)
        begin, order = np.cumsum(sizes) - sizes, np.lexsort((sizes, group))
        self.id, self.bounds = ids[order], np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
        self.file.flush()
        file, written = tempfile.TemporaryFile(), np.memmap(self.file, np.int64, "r") if self.bounds[-1] else np.zeros(0, np.int64)
        for a in range(0, len(order), 1000):
            own = order[a : a + 1000]
            file.write(self.terms.find(written[flat_ranges(begin[own], sizes[own])])[0].astype(np.int32).tobytes())
        del written
        self.file.close()
        self.file = file
        self.score = np.full((len(self.id), self.k), -np.inf)
        self.doc_id, self.row = (np.zeros((len(self.id), self.k), np.int64) for _ in range(2))

    def batches(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last of some queries; owner and place of their terms."""
        a = 0
        while a < len(self.id):
            b = max(a + 1, min(a + QUERIES, int(np.searchsorted(self.bounds, self.bounds[a] + QUERY_TERMS, "right")) - 1))
            self.file.seek(4 * int(self.bounds[a]))
            held = np.frombuffer(self.file.read(4 * int(self.bounds[b] - self.bounds[a])), np.int32)
            yield a, b, np.repeat(np.arange(b - a), np.diff(self.bounds[a : b + 1])), held
            a = b

    def merge(self, query: np.ndarray, doc_id: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Hits of queries beside the ones held."""
        if not len(query):
            return
        own = np.unique(query)
        old, place = np.nonzero(self.score[own] > 0)
        query = np.concatenate([own[old], query])
        doc_id, row, score = (np.concatenate([x[own[old], place], y]) for x, y in ((self.doc_id, doc_id), (self.row, row), (self.score, np.round(score, 6))))
        order = np.lexsort((row, doc_id, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, rank = order[rank < self.k], query[rank < self.k], rank[rank < self.k]
        self.score[query, rank], self.doc_id[query, rank], self.row[query, rank] = score[order], doc_id[order], row[order]

    def hits(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.id), 1000):
            query, place = np.nonzero(self.score[a : a + 1000] > 0)
            query += a
            doc_id = self.doc_id[query, place]
            yield pa.RecordBatch.from_arrays([pa.array(self.id[query]), pa.array(doc_id, mask=doc_id == NULL_ID), pa.array(self.row[query, place]), pa.array(self.score[query, place])], names=["query_id", "doc_id", "row", "score"])


class Shard:
    """Postings by term, in the order of documents; common terms as columns, and their
    block maxima. Terms are places among those of the queries, and what a document has of a
    term is weighed. doc_id and row are of all rows; first: each document's first one, as
    rows with equal terms, counts and lengths are one document. asked: how many of all
    queries hold each term."""

    def __init__(self, row: np.ndarray, doc_id: np.ndarray, first: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, asked: np.ndarray, n_queries: int):
        order = np.argsort(term, kind="stable")
        self.row, self.doc_id, self.first, n = row, doc_id, np.append(first, len(row)), len(first)
        self.blocks = -(-n // BLOCK)
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        self.begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.begin, len(term)))
        self.at = np.full(len(asked), -1, np.int32)
        self.at[term[self.begin]] = np.arange(len(self.begin))
        self.peak = np.maximum.reduceat(self.impact, self.begin) if len(term) else np.zeros(0)
        pairs = self.size * asked[term[self.begin]]
        common = np.argsort(-pairs, kind="stable")[:COMMON]
        common = common[pairs[common] > COMMON_SHARE**2 * n * n_queries]
        self.column = np.full(len(self.begin), -1)
        self.column[common] = np.arange(len(common))
        # columns in float32, by terms, and what is left of each value, by documents
        post = flat_ranges(self.begin[common], self.size[common])
        doc, column, value = self.doc[post], np.repeat(np.arange(len(common)), self.size[common]), self.impact[post].astype(np.float32)
        self.quick, self.left = np.zeros((len(common), self.blocks * BLOCK), np.float32), np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        self.quick[column, doc], self.left[doc, column] = value, self.impact[post] - value
        self.most = self.quick.reshape(len(common), self.blocks, BLOCK).max(2) if self.blocks else np.zeros((len(common), 0), np.float32)

    def answer(self, queries: Queries) -> None:
        if not len(self.begin):
            return
        n, width, k = self.blocks * BLOCK, len(self.most), queries.k
        held = np.empty((QUERIES, n))
        for a, b, owner, term in queries.batches():
            at = self.at[term]
            known = at >= 0
            owner, at = owner[known], at[known]
            # no pivot: all lists at their maxima do not reach the k-th best score
            floor = queries.score[a:b].min(1)
            pivot = np.bincount(owner, self.peak[at], b - a) >= np.maximum(floor - 1e-6, 1e-9)
            if not pivot.any():
                continue
            asked, known = np.flatnonzero(pivot), pivot[owner]
            owner, at, floor = (np.cumsum(pivot) - 1)[owner[known]], at[known], floor[asked]
            column = self.column[at]
            is_common = column >= 0
            has = np.zeros((len(asked), width), np.float32)
            has[owner[is_common], column[is_common]] = 1
            at, cut = at[~is_common], np.searchsorted(owner[~is_common], np.arange(len(asked) + 1)).tolist()
            begin, size = self.begin[at], self.size[at]
            score = held[: len(asked)]
            for i, (x, y) in enumerate(zip(cut, cut[1:])):
                post = _places(begin[x:y], size[x:y])
                score[i] = np.bincount(self.doc.take(post), self.impact.take(post), n)
            low, found = _least(floor), []
            bound = score.reshape(len(asked), self.blocks, BLOCK).max(2) + has @ self.most
            sections = np.arange(0, self.blocks, SECTION)
            for start in sections[np.argsort(-np.add.reduceat(bound.sum(0), sections), kind="stable")].tolist():
                use = np.flatnonzero((bound[:, start : start + SECTION] >= low[:, None]).any(1))
                if not len(use):
                    continue
                places = slice(start * BLOCK, (start + SECTION) * BLOCK)
                near = has[use] @ self.quick[:, places]
                near += score[use, places]
                some = near.max(1) >= np.maximum(low[use], np.finfo(np.float32).tiny)
                use, near = use[some], near[some]
                hit = (near >= low[use, None]) & (near > 0)
                for i in np.flatnonzero(hit.sum(1) > k).tolist():
                    low[use[i]] = max(low[use[i]], _least(np.partition(near[i], -k)[-k] * (1 - ERROR)))
                    hit[i] &= near[i] >= low[use[i]]
                query, doc = np.nonzero(hit)
                query, doc = use[query], doc + places.start
                full = score[query, doc] + ((self.quick.T[doc].astype(np.float64) + self.left[doc]) * has[query]).sum(1)
                good = full >= floor[query] - 1e-6
                found.append((query[good], doc[good], full[good]))
            if found:
                query, doc, full = (np.concatenate(x) for x in zip(*found))
                rows = np.diff(self.first)[doc]
                row = flat_ranges(self.first[doc], rows)
                queries.merge(a + asked[np.repeat(query, rows)], self.doc_id[row], self.row[row], np.repeat(full, rows))


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat_ranges() of lists that are not empty, by running sums of steps."""
    ends = np.cumsum(size)
    step = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(ends):
        step[0], step[ends[:-1]] = begin[0], begin[1:] - begin[:-1] - size[:-1] + 1
    return np.cumsum(step, out=step)


def _least(score):
    """Where sums in float32 begin whose true value may be no less than a score, but for the
    sixth decimal: sums of up to 1,536 terms, none below 0, are wrong by a share below ERROR."""
    return (score - 1e-6) * (1 - ERROR)


def _search(k: int, n: int, average: float, groups: Groups):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by part, its queries (kind 0) before documents (kind 1), those by group,
        length and text. A shard ends where it has its documents or terms."""
        part = queries = last = None
        loaded, held, docs, size = False, [], 0, 0

        def built() -> Shard:
            row, doc_id, new, length, sizes, terms, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            doc = np.repeat(np.arange(docs), sizes)
            at, known = queries.terms.find(terms)
            doc, at, counts = doc[known], at[known], counts[known]
            del terms, known
            impact = counts * (K1 + 1) / (counts + K1 * (1 - B + B * length[doc] / average)) * queries.weight[at]
            return Shard(row, doc_id, np.flatnonzero(new), doc, at, impact, queries.asked, len(queries.id))

        def flush():
            nonlocal docs, size, last
            if docs:
                built().answer(queries)
            docs, size, last = 0, 0, None

        def take(piece: pa.RecordBatch, ids, sizes, terms, counts):
            """Some rows more; what repeats the row before is that document once more."""
            nonlocal docs, size, last
            text, length, cut = np.asarray(piece.column("digest")), np.asarray(piece.column("length")), np.append(0, np.cumsum(sizes))
            new = np.ones(len(ids), bool)
            for i in np.flatnonzero(np.append(last is not None and last[0] == text[0], text[1:] == text[:-1])).tolist():
                own = (text[i], length[i], terms[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]])
                before = last if i == 0 else (text[i - 1], length[i - 1], terms[cut[i - 1] : cut[i]], counts[cut[i - 1] : cut[i]])
                new[i] = not all(np.array_equal(x, y) for x, y in zip(own, before))
            last = (text[-1], length[-1], terms[cut[-2] :].copy(), counts[cut[-2] :].copy())
            keep = np.repeat(new, sizes)
            held.append((ids, np.asarray(piece.column("doc_id").fill_null(NULL_ID)), new, length[new], sizes[new], terms[keep], counts[keep]))
            docs, size = docs + int(new.sum()), size + int(keep.sum())

        for batch in batches:
            at = [np.asarray(batch.column(c)) for c in ("part", "kind")]
            cut = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in at], 0)))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows]):
                p, kind = (int(c[a]) for c in at)
                if p != part:
                    if loaded:
                        flush()
                        yield from queries.hits()
                    part, queries, loaded = p, Queries(k, groups), False
                sizes = np.asarray(batch.column("terms").slice(a, b - a).value_lengths()).astype(np.int64)
                ends = np.cumsum(sizes)
                while a < b:
                    done = int(ends[-1 - (b - a)]) if b - a < len(ends) else 0
                    m = max(1, min(b - a, SHARD_DOCS, 1000, int(np.searchsorted(ends, done + SHARD_TERMS // 8, "right")) - (len(ends) - (b - a))))
                    piece, own = batch.slice(a, m), sizes[len(sizes) - (b - a) :][:m]
                    a += m
                    ids, terms, counts = np.asarray(piece.column("id")), np.asarray(piece.column("terms").flatten()), np.asarray(piece.column("counts").flatten())
                    if kind == 0:
                        queries.add(ids, own, terms, np.log(1 + (n - counts + 0.5) / (counts + 0.5)))
                        continue
                    if not loaded:
                        queries.close()
                        loaded = True
                    if docs + m > SHARD_DOCS or docs and size + int(own.sum()) > SHARD_TERMS:
                        flush()
                    take(piece, ids, own, terms, counts)
        if loaded:
            flush()
            yield from queries.hits()

    return search


def _keys(spark, parts: int) -> list[int]:
    """A key for each partition that repartition() deals to it."""
    found: dict[int, int] = {}
    for key, to in spark.range(parts * 40).select(F.col("id").cast("int"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))).collect():
        found.setdefault(to, key)
    return sorted(found.values())


def _without_surplus(docs: DataFrame, k: int) -> DataFrame:
    """docs without the rows of a text whose ids are above its k-th least: all of those
    score the same, so these are never hits. No text's copies then weigh on one task."""
    keyed = docs.withColumn("copy", F.sha2("text", 256)).withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    place = F.row_number().over(Window.partitionBy("copy").orderBy("key"))
    most = materialize(keyed.select("copy", "key").withColumn("place", place).where(F.col("place") == k).select("copy", F.col("key").alias("most")), "copied")
    copied = most.count()
    if not copied:
        return docs
    held = keyed.join(F.broadcast(most) if copied <= COPIED else most, "copy", "left")
    return held.where("most is null or key <= most").select(*docs.columns)


def search(documents: DataFrame, queries: DataFrame, k: int = TOP, most_terms: int | None = None, parts: int = PARTS) -> DataFrame:
    """queries: (query_id long, text). (query_id, rank, doc_id, score) of the k best
    rows of documents for each, with score above 0. parts: tasks that documents are
    dealt to; each of them gets all queries, so few queries allow many."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    counted = materialize(docs.select("text").mapInArrow(_frequencies, "term long, df long, total long"), "frequencies")
    n, total = counted.where("term is null").agg(F.sum("df"), F.sum("total")).first()
    average = max(1.0, (total or 0) / max(n or 0, 1))
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = materialize(asked.mapInArrow(_terms, "query_id long, term long, qtf long"), "words")
    df = counted.where("term is not null").join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = words.join(df, "term").withColumn("idf", idf)
    if most_terms is not None:
        best = Window.partitionBy("query_id").orderBy(F.desc(F.col("qtf") * F.col("idf")), "term")
        weighed = weighed.where("df > 1").withColumn("place", F.row_number().over(best)).where(F.col("place") <= most_terms)
    listed = F.array_sort(F.collect_list(F.struct("term", F.col("df").cast("int").alias("df"))))
    weighed = weighed.groupBy("query_id").agg(listed.alias("listed")).select(F.lit(0).alias("kind"), F.col("query_id").alias("id"), *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("digest", "long"), ("group", "int"), ("length", "long"))), F.col("listed.term").alias("terms"), F.col("listed.df").alias("counts"))
    weighed = materialize(weighed, "queries")

    bags = weighed.select("terms").limit(GROUP_QUERIES).toArrow().column("terms")
    groups = Groups([np.asarray(bag.values) for bag in bags])
    parts = min(partitions(spark), parts)
    keys = F.array(*map(F.lit, _keys(spark, parts)))
    texts = _without_surplus(docs.where("text is not null"), k).withColumn("digest", F.xxhash64("text"))
    indexed = texts.mapInArrow(_documents(groups), "id long, doc_id long, digest long, group int, length long, terms array<long>, counts array<int>")
    indexed = indexed.select(F.get(keys, F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")).alias("part"), F.lit(1).alias("kind"), "id", "doc_id", "digest", "group", "length", "terms", "counts")
    both = indexed.unionByName(weighed.withColumn("part", F.explode(keys)))
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "kind", "group", "length", "digest", "id")
    hits = dealt.mapInArrow(_search(k, n or 0, average, groups), "query_id long, doc_id long, row long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first(), "row")
    return hits.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def sampled_queries(documents: DataFrame, every: int = 50) -> DataFrame:
    """The rows whose id is divisible by `every`, as queries."""
    return documents.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "text")



#: Every term of every query; exact, by all postings, and so for small tables alone.
ORACLE = rf"""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM documents),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
l AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS len FROM w GROUP BY doc_id),
a AS (SELECT greatest(1.0, sum(len) / any_value(n)) AS av FROM l, n),
f AS (SELECT doc_id, t, CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY ALL),
d AS (SELECT t, CAST(count(*) AS DOUBLE) AS d FROM f GROUP BY t),
s AS (SELECT q.doc_id AS query_id, f.doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f.c * {K1 + 1} / (f.c + {K1} * ({1 - B} + {B} * len / av))), 6) AS score
  FROM f q JOIN d USING (t) JOIN (SELECT * FROM f JOIN l USING (doc_id)) f USING (t), n, a WHERE q.doc_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
