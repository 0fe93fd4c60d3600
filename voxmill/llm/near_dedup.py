"""Near-duplicate groups by MinHash, exact on full shingle sets.

1. Every text gets its set of distinct word shingles and a one-permutation MinHash
   with optimal densification; bands of it are bucket keys. Texts with the same
   set (by 128 bits of hashes) are one class, so copies cost nothing further.
2. In every bucket the least class is the centre of a star, and only edges from it
   are candidates: as many as members, not pairs. Full sets confirm them.
3. Confirmed links give components. A bucket whose members other than its centre
   lie in more than one component may hide links that no star has tried. Its
   members are dealt into blocks of bounded size, and pairs of blocks are compared
   whole, as products of incidence matrices; no row is ever made for a pair.
4. Links of both steps give the final components.

So every two classes that meet in a bucket are compared or already connected; with
42 bands of 6 rows a pair of similarity 0.8 fails to meet with probability 3e-6.

Rows: null and empty texts, and texts without words, have no shingles and are linked
with nothing; rows with the same doc_id are rows of their own; a null doc_id is
never a component's name unless all its members' are null; other columns are
ignored; no rows give no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import materialize, mix64, partitions, text_slices
from voxmill.llm.components import components
from voxmill.llm.shingles import band_keys, shingle_sets, signatures

WIDTH, SIMILARITY, BINS, ROWS, BANDS = 5, 80, 256, 6, 42
#: Sets and shingles that a block may hold.
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000


def _class_names(code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set, as longs; the same for the same set."""
    n, names = np.diff(bounds).astype(np.uint64), []
    for salt in (0x632BE59BD9B4E019, 0x9FB21C651E98DF25):
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix64(code + np.uint64(salt)), out=total[1:])
        names.append(mix64((total[bounds[1:]] - total[bounds[:-1]]) ^ n).view(np.int64))
    return names[0], names[1]


def _sign(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                code, bounds = shingle_sets(piece.column("text"), width)
                n = np.diff(bounds)
                keys = band_keys(signatures(code, bounds, BINS)[:, : ROWS * BANDS], ROWS).view(np.int64)
                sizes = np.where(n > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys.ravel()))
                node, check = map(pa.array, _class_names(code, bounds))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "copy")), node, check, pa.array(n), bands], names=["doc_id", "copy", "node", "check", "n", "bands"])

    return sign


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                code, bounds = shingle_sets(piece.column("text"), width)
                raw = pa.py_buffer(code.tobytes())
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int64)), raw]).cast(pa.binary())
                named = _class_names(code, bounds)
                same = pa.array((named[0] == np.asarray(piece.column("name"))) & (named[1] == np.asarray(piece.column("check"))))
                yield pa.RecordBatch.from_arrays([piece.column("node"), data], names=["node", "set"]).filter(same)

    return sets


def _compare(similarity: int):
    """Rows of a task: its left sets against its right ones, or its left sets
    against each other where there are no right ones. Links, once each."""

    def links(nodes, comps, sets, sides) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) // 8 for s in sets])
        code = np.frombuffer(b"".join(sets), np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        left = np.flatnonzero(sides == 0)
        right = np.flatnonzero(sides == 1)
        if not len(right):
            right = left
        shared = np.zeros((len(left), len(right)))
        mine, theirs = np.isin(owner, left), np.isin(owner, right)
        place = np.zeros(len(sets), np.int64)
        words, first, count = np.unique(code[mine], return_index=True, return_counts=True)
        if len(right) and right is not left:
            words = words[np.isin(words, code[theirs])]
        else:
            words = words[count > 1]
        at = np.searchsorted(words, code)
        known = np.zeros(len(code), bool)
        inside = at < len(words)
        known[inside] = words[at[inside]] == code[inside]
        for base in range(0, len(words), 8192):
            use = known & (at >= base) & (at < base + 8192)
            width = min(8192, len(words) - base)

            def incidence(rows, chosen):
                place[rows] = np.arange(len(rows))
                m = np.zeros((len(rows), width), np.float32)
                pick = use & chosen
                m[place[owner[pick]], at[pick] - base] = 1
                return m

            a = incidence(left, mine)
            shared += a @ (a if right is left else incidence(right, theirs)).T
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        found = (100 * shared >= similarity * union) & (comps[left][:, None] != comps[right][None, :])
        x, y = np.nonzero(found)
        keep = x < y if right is left else slice(None)
        return nodes[left[x]][keep], nodes[right[y]][keep]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        task = None

        def flush():
            node, comp, side, data = zip(*held)
            a, b = links(np.array(node), np.array(comp), data, np.array(side))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("task", "node", "comp", "side", "set")]
            for row in zip(*columns):
                if row[0] != task:
                    if len(held) > 1:
                        yield flush()
                    held, task = [], row[0]
                held.append(row[1:])
        if len(held) > 1:
            yield flush()

    return compare


def _links(tasks: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """tasks: (task, side, node, comp)."""
    rows = tasks.join(sets, "node").select("task", "node", "comp", "side", "set")
    return rows.repartition(partitions(tasks.sparkSession), "task").sortWithinPartitions("task").mapInArrow(_compare(similarity), "a long, b long")


def _blocks(n: str, shingles: str):
    return F.ceil(F.greatest(F.col(n) / BLOCK_SETS, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _told_apart(classes: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes are named by 128 bits, of which `node` (64) serves as their handle.
    Where classes share a handle, it is hashed anew with the other half for all but
    one of them; `name` is the old one."""
    shared = classes.groupBy("node").agg(F.count("*").alias("m"), F.min("check").alias("least")).where("m > 1").select("node", "least")
    classes, own = classes.withColumn("name", F.col("node")), F.coalesce(F.when(F.col("check") > F.col("least"), F.xxhash64("node", "check")), F.col("node"))
    if shared.isEmpty():
        return classes, signed
    shared = materialize(shared, "shared")
    renew = lambda rows: rows.join(shared, "node", "left").withColumn("node", own).drop("least")
    return renew(classes), renew(signed)


def near_duplicates(documents: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, copy, n_shingles, component_id, kept) of every row; kept rows are the one
    of each group with its least doc_id. copy: the hash of its text, to find the row by."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("copy"))
    signed = materialize(docs.mapInArrow(_sign(width), "doc_id long, copy long, node long, check long, n long, bands array<long>"), "signed")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy")).alias("one")
    classes = signed.where("n > 0").groupBy("node", "check").agg(one, F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("node", "check", "one.doc_id", "one.copy", "n", "bands"), "classes")
    classes, signed = _told_apart(classes, signed)

    exploded = classes.select("node", "n", F.explode("bands").alias("key"))
    stars = exploded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("m")).where("m > 1")
    members = materialize(exploded.join(stars.select("key", F.col("c.node").alias("center"), F.col("c.n").alias("center_n")), "key"), "members")

    chosen = members.select("node").distinct().join(classes.select("node", "name", "check", F.col("doc_id").alias("own"), F.col("copy").alias("own_copy")), "node")
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("copy") == F.col("own_copy"))).select("node", "name", "check", "text")
    sets = texts.mapInArrow(_sets(width), "node long, set binary").dropDuplicates(["node"])
    sets = materialize(sets, "sets")

    near = (100 * F.least("n", "center_n") >= similarity * F.greatest("n", "center_n")) & (F.col("node") != F.col("center"))
    pairs = members.where(near).select("center", "node", "n").distinct()
    dealt = pairs.join(pairs.groupBy("center").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).select("center", _blocks("m", "shingles").alias("parts")), "center")
    dealt = dealt.select("center", "node", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    task = F.xxhash64("center", "part").alias("task")
    rims = dealt.select(task, F.lit(1).alias("side"), "node", F.col("node").alias("comp"))
    hubs = dealt.select("center", "part").distinct().select(task, F.lit(0).alias("side"), F.col("center").alias("node"), F.col("center").alias("comp"))
    links = materialize(_links(rims.unionByName(hubs), sets, similarity), "links")
    labels = components(links)

    # buckets that may hide more: without the centre, in more than one component
    rest = members.where("node <> center").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("comp"))
    open_ = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("lo <> hi")
    once = open_.groupBy("m", "who").agg(F.min(F.struct("key", "shingles")).alias("k")).select(F.col("k.key").alias("key"), F.expr("m"), F.col("k.shingles").alias("shingles"))
    blocks = rest.join(once.select("key", _blocks("m", "shingles").alias("parts")), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = blocks.select("key", "node", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    tasks = blocks.select(F.xxhash64("key", lo, hi).alias("task"), (F.col("block") > lo).cast("int").alias("side"), "node", "comp")
    more = materialize(_links(tasks, sets, similarity), "links")
    if not more.isEmpty():
        a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        joined = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        final = components(joined)
        moved = final.select(F.col("node").alias("label"), F.col("label").alias("top"))
        old = labels.join(moved, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        labels = materialize(old.unionByName(final).groupBy("node").agg(F.min("label").alias("label")), "labels")

    named = classes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    out = signed.select("doc_id", "copy", "node", "n").join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "copy", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: For four words; exact, by every shared shingle, and so for small tables alone.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
m AS (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
