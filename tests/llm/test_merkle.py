"""The Merkle manifest against a plain tree on the driver."""

import hashlib
import zlib

import pytest

from voxmill.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string, position int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The root, and the levels of every leaf."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, p in enumerate(at):
            run, d = runs[p // fanout], p % fanout
            paths[k].append(("".join(run[:d]), "".join(run[d + 1 :])))
        at = [p // fanout for p in at]
        nodes = [sha(*r) for r in runs]
    return nodes[0], paths


def expected(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[2] is None else "1" + r[2], []).append(r)
    tops, found = [], []
    for g in sorted(groups, key=lambda x: x.encode()):
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, paths = climb([leaf(r) for r in own], fanout)
        tops.append(subroot)
        found.append((own, subroot, paths))
    root, above = climb(tops, fanout) if tops else ("", [])
    out = []
    for (own, subroot, paths), rest in zip(found, above):
        for r, p in zip(own, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for before, after in p + rest:
                node = sha(before, node, after)
            out.append((r[0], leaf(r), subroot, root, sha(*(x for level in p + rest for x in level)), node, node == root))
    return out


def rows_of(n, langs):
    return [(i * 3, f"s{i % 4}", langs[i * i % len(langs)], i, "é" * (i % 5) or None) for i in range(n)]


ODD = [(None, None, None, None, None), (None, "", "", 3, ""), (5, "a", "en", None, "x"), (5, "a", "en", None, "x"), (5, "a", "en", 1, "y"), (-7, "b", "日", 2**63 - 1, "x" * 100_000), (28, None, "en", 2**63 - 1, "z")]


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("n, langs, fanout, block", [(1, ["en"], 2, 4), (5, ["en"], 2, 4), (97, ["en", "de", None], 2, 4), (97, ["a", "b", "c", "d", "e", "f", "g"], 2, 8), (100, ["en", "fr"], 3, 9), (57, ["en", "fr", "a", "b", "c"], 4, 4)])
def test_same_as_plain_tree(spark, n, langs, fanout, block):
    rows = rows_of(n, langs)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS).repartition(5)
    got = merkle.digest(merkle.manifest(docs, fanout, block))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows, fanout), key=key)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in ODD], COLUMNS).repartition(3)
    got = merkle.digest(merkle.manifest(docs, 2, 2))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(ODD), key=key)
    assert merkle.digest(merkle.manifest(docs.limit(0))).count() == 0


def test_rows_of_one_key(spark):
    """Equal rows are spread over partitions, not gathered in one."""
    rows = [(1, "a", "en", 1, "x")] * 300
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS).repartition(4)
    got = merkle.digest(merkle.manifest(docs, 2, 16))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows), key=key)
    ordered = merkle.positions(merkle.leaves(docs))
    assert sorted(r["position"] for r in ordered.collect()) == list(range(300))


def test_every_partition_has_the_root(spark):
    roots = spark.createDataFrame([("a", i, sha(str(i))) for i in range(11)] + [("b", 0, sha("b"))], "group string, block long, root string")
    found = {(r["group"], r["block"]): r for r in merkle.exchange(roots, 2).collect()}
    top, paths = climb([sha(str(i)) for i in range(11)], 2)
    assert len(found) == 12
    for i, path in enumerate(paths):
        r = found["a", i]
        assert (r["root"], [tuple(level) for level in r["path"]]) == (top, path)
    assert (found["b", 0]["root"], found["b", 0]["path"]) == (sha("b"), [])


def test_block_is_a_power(spark):
    with pytest.raises(ValueError, match="power"):
        merkle.block_levels(3, 8)
