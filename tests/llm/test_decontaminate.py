"""Decontamination against brute force, by broadcast and by shuffle."""

import hashlib
import random
import re

import pytest

from voxmill.llm.decontaminate import decontaminate, digest


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                own = windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["a", "B", "cé", "d1", "É"]) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 8, 13, 14, 30]))) for i in range(12)] + [(20, "a"), (21, None), (22, "..."), (None, "zz yy xx"), (3, "same text here"), (4, "same text here")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    docs += [(100 + k, f"{text(9)} {items[k][1]} {text(k * 20)}") for k in range(12)] + [(200, None), (201, ""), (202, "Same TEXT here, same text"), (None, "same text here"), (203, "zz yy xx")]
    return docs, items


@pytest.mark.parametrize("bound", [200_000, 0])
def test_windows(spark, bound):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    b = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, window int")
    got = sorted(map(tuple, digest(decontaminate(d, b, broadcast_windows=bound)).collect()), key=str)
    named = [(i, t) for i, t in items if i is not None]
    want = brute(docs, named, 13)
    # an item without an id still hits words, but has no name to count
    assert [r for r in got if r[0] != 203] == [r for r in want if r[0] != 203]
    assert [r[:4] for r in got if r[0] == 203] == [(203, 3, 3, 0)]


def test_null_text_without_ansi(spark):
    """size() of null is -1 there."""
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        for bound in (200_000, 0):
            assert digest(decontaminate(d, b, broadcast_windows=bound)).where("doc_id = 200").first()["n_words"] == 0
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_edges(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert sorted(r[:3] for r in map(tuple, digest(decontaminate(d, b)).collect())) == [(1, 1, 0), (1, 3, 2), (2, 0, 0)]
    assert digest(decontaminate(d.limit(0), b)).count() == 0
    assert {r["n_hit"] for r in digest(decontaminate(d, b.limit(0))).collect()} == {0}
