"""A Merkle manifest of a dataset: a root over all rows, and a proof for each.

Every row is a leaf; leaves of a group ascend by their key, and each run of `fanout`
consecutive nodes becomes their hash until one node is left, the group's root. The groups'
roots, in their order, become the dataset's root by the same function.

Rows are dealt to partitions of `block` consecutive leaves. A partition hashes its own
subtree; above it partitions exchange by a butterfly: in round r the aligned group of
`fanout` partitions whose numbers differ in digit r alone swap the roots of their subtrees,
and each of them hashes all of these to the next root. So every partition gets the roots
beside its way up, and the root itself, in as many rounds as there are levels, and nothing
is sent down again. To keep every group whole, numbers beyond the last partition take
part without rows (at most `fanout` times as many in all); a group's messages never
depend on the number of rows.

A proof is a list of levels, from the leaf to the root: the hashes before and after the own
one in its run, joined.

Rows: nulls hash as `-`; a null group comes first, a null key comes first in its group;
equal keys go by their leaves, and equal leaves are interchangeable; rows without a key are
never tampered with; columns other than the five are ignored; no rows give no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import materialize

FANOUT, BLOCK = 2, 1024
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
_LEVEL = pa.struct([("before", pa.string()), ("after", pa.string())])


def leaf_hash(values: list[Column]) -> Column:
    """The hash of values: `-` for null, else the UTF-8 bytes' number, a colon, the value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*(part(v.cast("string")) for v in values)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, group, key, leaf, tampered): tampered is the leaf of a row whose n_chars has
    grown by 1, which happens to those whose key's checksum 7 divides."""
    columns = {c: F.col(c) for c in COLUMNS}
    own = leaf_hash(list(columns.values()))
    other = leaf_hash(list((columns | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}).values()))
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    group = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("group"), F.col("doc_id").cast("long").alias("key"), own.alias("leaf"), F.when(hit, other).alias("tampered"))


def _count_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and each row's number in its group there; rows are
    sorted by group."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if batch.num_rows:
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            base = first.copy()
            base[0] = -n if groups[0] == last else 0
            at = np.arange(batch.num_rows) - np.repeat(base, np.diff(np.append(first, batch.num_rows)))
            last, n = groups[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at, pa.int64())], names=[*batch.schema.names, "part", "at"])


def positions(rows: DataFrame) -> DataFrame:
    """rows (group, key, leaf, ...) with `position`, each row's place in its group by key and
    leaf, and `total`, the group's rows, from a range partition and sums over its parts. Rows are written first, so the
    range's sample doesn't hash texts again; equal rows are spread by a row number."""
    kept = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    order = ["group", "key", "leaf", "_row"]
    dealt = kept.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    counted = materialize(dealt.mapInArrow(_count_in_part, f"{fields}, part int, at long"), "ordered")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # written, so that Spark knows how small they are when it plans the joins
    offsets = counted.groupBy("group", "part").agg(F.count("*").alias("n")).select("group", "part", before.alias("before"), F.sum("n").over(Window.partitionBy("group")).alias("total"))
    return counted.join(materialize(offsets, "offsets"), ["group", "part"]).withColumn("position", F.col("at") + F.col("before")).drop("part", "at", "before")


def _hash(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _subtree(nodes: list[str], fanout: int, levels: int | None) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Level by level: the nodes of a level, and their runs. Without a number of levels,
    until one node is left."""
    while levels != 0 if levels is not None else len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        yield nodes, runs
        nodes = [_hash("".join(r)) for r in runs]
        levels = levels - 1 if levels is not None else None
    yield nodes, []


def block_levels(fanout: int, block: int) -> int:
    levels = 0
    while fanout**levels < block:
        levels += 1
    if fanout**levels != block:
        raise ValueError("a block must be a power of the fanout")
    return levels


def exchange(roots: DataFrame, fanout: int) -> DataFrame:
    """(group, block, root) of every partition to (group, block, root, path): the group's
    root and the levels above the partition's own subtree."""
    counts = roots.groupBy("group").agg(F.count("*").alias("n"))
    state = roots.join(counts, "group").withColumn("path", F.array().cast(PATH))
    most = counts.agg(F.max("n")).first()[0] or 0
    depth, reach = F.lit(0), 1
    powers = []
    while reach < most:
        depth, powers, reach = depth + (F.col("n") > reach).cast("int"), [*powers, reach], reach * fanout
    state = materialize(state.withColumn("depth", depth.cast("int")), "butterfly")
    # the largest power below n; numbers from n to fanout times it take part without rows
    top = F.pow(F.lit(fanout), F.greatest(F.col("depth") - 1, F.lit(0))).cast("long")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("block") < top, F.lit(fanout - 1)).otherwise(F.lit(0)).cast("long")))
    all_of = state.select("*", steps.alias("_k"), top.alias("_top")).where("_k = 0 or (depth > 0 and block + _k * _top >= n)")
    state = all_of.select("group", "depth", (F.col("block") + F.col("_k") * F.col("_top")).alias("block"), F.when(F.col("_k") == 0, F.col("root")).alias("root"), "path", "n")
    for r, step in enumerate(powers):
        active = F.col("depth") > r
        digit = F.when(active, F.expr(f"block div {step} % {fanout}")).otherwise(F.lit(0)).cast("int")
        member = F.struct(digit.alias("digit"), "block", "root", "path")
        met = state.groupBy("group", "depth", "n", (F.col("block") - digit.cast("long") * step).alias("_key")).agg(F.sort_array(F.collect_list(member)).alias("m"))
        roots_of = lambda m: F.array_join(F.transform(m, lambda x: x["root"]), "")
        joined = roots_of(F.col("m"))
        above = F.when(active & (joined != ""), F.sha2(joined, 256)).when(~active, F.col("m")[0]["root"])
        each = met.select("group", "depth", "n", above.alias("root"), "m", F.explode("m").alias("x"))
        level = F.struct(roots_of(F.slice("m", 1, F.col("x.digit"))).alias("before"), roots_of(F.slice("m", F.col("x.digit") + 2, fanout)).alias("after"))
        path = F.when(active, F.concat("x.path", F.array(level))).otherwise(F.col("x.path"))
        state = materialize(each.select("group", "depth", "n", "x.block", "root", path.alias("path")), "butterfly")
    return state.where("block < n").select("group", "block", "root", "path")


def trees(rows: DataFrame, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """rows (group, key, leaf, ...) with their group's `root` and the `path` to it."""
    levels = block_levels(fanout, block)
    placed = positions(rows)
    names = [c for c in placed.columns if c not in ("position", "total")]
    # a group of one partition ends at its own top; of several, each climbs a whole block
    dealt = placed.withColumn("several", F.col("total") > block).withColumn("block", F.expr(f"position div {block}"))

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        *_, (nodes, _) = _subtree(table["leaf"].to_pylist(), fanout, levels if table["several"][0].as_py() else None)
        return pa.table({"group": table["group"][:1], "block": table["block"][:1], "root": pa.array(nodes, pa.string())})

    roots = materialize(dealt.select("group", "block", "position", "leaf", "several").groupBy("group", "block").applyInArrow(top, "group string, block long, root string"), "roots")
    above = exchange(roots, fanout)

    def prove(own: pa.Table, upper: pa.Table) -> pa.Table:
        own = own.sort_by("position")
        place = np.arange(own.num_rows)
        paths: list[list[dict]] = [[] for _ in place]
        for _, runs in _subtree(own["leaf"].to_pylist(), fanout, levels if own["several"][0].as_py() else None):
            if runs:
                sides = [[{"before": "".join(run[:d]), "after": "".join(run[d + 1 :])} for d in range(len(run))] for run in runs]
                for path, p in zip(paths, place.tolist()):
                    path.append(sides[p // fanout][p % fanout])
                place = place // fanout
        rest = upper["path"][0].as_py()
        out = own.select(names).append_column("root", pa.array([upper["root"][0].as_py()] * own.num_rows, pa.string()))
        return out.append_column("path", pa.array([p + rest for p in paths], pa.list_(_LEVEL)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name in names)
    return dealt.groupBy("group", "block").cogroup(above.groupBy("group", "block")).applyInArrow(prove, f"{fields}, root string, path {PATH}")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "")


def manifest(docs: DataFrame, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path) of every row."""
    own = trees(leaves(docs), fanout, block).withColumnRenamed("root", "subroot")
    own = materialize(own, "proofs")
    groups = own.groupBy("group").agg(F.first("subroot").alias("leaf"))
    tops = trees(groups.select(F.lit("").alias("group"), F.col("group").alias("key"), "leaf"), fanout, block)
    tops = materialize(tops.select(F.col("key").alias("group"), "root", F.col("path").alias("_above")), "tops")
    return own.join(tops, "group").select("doc_id", "leaf", "tampered", "subroot", "root", F.concat("path", "_above").alias("path"))


def digest(found: DataFrame) -> DataFrame:
    """The proof's hash, and whether the row as it is now, tampered with or not, gives the
    root by its proof."""
    folded = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The checksum goes byte by byte and bit by bit; trees and folds go level by level.
ORACLE = """
WITH RECURSIVE parts AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, n_chars, CAST(doc_id AS VARCHAR) AS name,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
sums AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda k, y: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384) ELSE k // 2 END)), 4294967295) AS crc
  FROM parts),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + (crc % 7 = 0)::INT AS VARCHAR)) || ':' || (n_chars + (crc % 7 = 0)::INT), '-') || tail) AS seen
  FROM sums),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
low AS (
  SELECT g, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY g, level, i // 2),
subroots AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, i, subroot AS node, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, i // 2),
sides AS (
  SELECT p.g, p.i, l.level, (p.i >> l.level) % 2 AS odd, coalesce(s.node, '') AS other
  FROM placed p JOIN (SELECT DISTINCT g, level FROM low WHERE n > 1) l ON l.g = p.g
  LEFT JOIN low s ON s.g = p.g AND s.level = l.level AND s.i = xor(p.i >> l.level, 1)
  UNION ALL
  SELECT p.g, p.i, 1000 + l.level, (r.i >> l.level) % 2, coalesce(s.node, '')
  FROM placed p JOIN subroots r ON r.g = p.g CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) l
  LEFT JOIN high s ON s.level = l.level AND s.i = xor(r.i >> l.level, 1)),
proofs AS (
  SELECT p.g, p.i, coalesce(string_agg(other, '' ORDER BY level), '') AS proof, coalesce(list(struct_pack(odd, other) ORDER BY level) FILTER (level IS NOT NULL), []) AS path
  FROM placed p LEFT JOIN sides s ON s.g = p.g AND s.i = p.i GROUP BY p.g, p.i),
folds AS (
  SELECT p.g, p.i, p.seen AS node, 1 AS k, path FROM placed p JOIN proofs USING (g, i)
  UNION ALL
  SELECT g, i, sha256(CASE WHEN path[k].odd = 1 THEN path[k].other || node ELSE node || path[k].other END), k + 1, path FROM folds WHERE k <= len(path))
SELECT p.doc_id, p.leaf, r.subroot, t.node AS root, sha256(o.proof) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM placed p JOIN proofs o USING (g, i) JOIN subroots r ON r.g = p.g JOIN folds f ON f.g = p.g AND f.i = p.i AND f.k > len(f.path) CROSS JOIN (SELECT node FROM high WHERE n = 1) t
"""
