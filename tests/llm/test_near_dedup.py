"""Near-duplicate groups and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from voxmill.llm.components import components
from voxmill.llm.near_dedup import near_duplicates
from voxmill.llm.shingles import shingle_sets


def brute_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, similarity):
    sets = [brute_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min(ids) for g, ids in groups.items()}
    return sorted((rows[i][0], len(sets[i]), least[find(i)], rows[i][0] == least[find(i)]) for i in range(len(rows)))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "One "), (5, "a B c"), (6, "a b c d e"), (7, "a b c d e")], 8
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 8, 40, 200]))
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 15)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    base = rng.choices(words, k=120)
    for k in range(60):  # many near misses around one text, and chains among them
        own = list(base)
        for i in range(k % 12):
            own[(i * 11 + k // 12 * 3) % 120] = f"x{k // 12}"
        rows.append((n, "\t".join(own)))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rows = corpus(seed)
    found = near_duplicates(spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, node int"), width=4).drop("copy")
    assert sorted(map(tuple, found.collect())) == brute(rows, 4, 80)


def test_edges(spark):
    frame = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (7, "other words are here now"), (None, None)], "doc_id long, text string")
    found = sorted(map(tuple, near_duplicates(frame).drop("copy").collect()), key=str)
    assert found == sorted([(None, 1, 7, True), (7, 1, 7, True), (7, 1, 7, True), (7, 1, 7, True), (None, 0, None, True)], key=str)
    assert near_duplicates(frame.limit(0)).count() == 0


def test_sets():
    texts = ["A b a B a b c", None, "x", "", " y z\n", "é É q w"]
    code, bounds = shingle_sets(pa.array(texts), 2)
    assert [b - a for a, b in zip(bounds, bounds[1:])] == [len(brute_set(t, 2)) for t in texts]


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 140)] + [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(30)] + [(500, i) for i in range(501, 520)]
    parent = {x: x for ab in links for x in ab}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if any(x in ab and ab[0] != ab[1] for ab in links)}


def thue_morse(n, a, b):
    word = a
    for _ in range(n):
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_long_words_of_two_letters_differ(spark):
    """Words on which polynomial hashes modulo a power of two agree for every base."""
    rows = [(1, thue_morse(11, "a", "b")), (2, thue_morse(11, "b", "a")), (3, thue_morse(17, "a", "b") + " x"), (4, thue_morse(17, "b", "a") + " x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i in range(1, 5)]


def test_classes_with_one_handle_are_told_apart(spark):
    from voxmill.llm.near_dedup import _told_apart

    classes = spark.createDataFrame([(5, 1, "a"), (5, 2, "b"), (6, 1, "c")], "node long, check long, who string")
    signed = spark.createDataFrame([(5, 1, "a"), (5, 2, "b"), (5, 2, "b"), (6, 1, "c")], "node long, check long, who string")
    one, two = ([(r["node"], r["who"]) for r in rows.collect()] for rows in _told_apart(classes, signed))
    assert len({n for n, _ in one}) == 3 and set(one) == set(two)
    assert {n for n, w in one if w in "ac"} == {5, 6}
    assert {r["name"] for r in _told_apart(classes, signed)[0].collect()} == {5, 6}


def test_hot_ids(spark):
    """One id, and the null one, on many rows of texts that share buckets."""
    words = [f"w{i}" for i in range(50)]
    rows = [(rng % 2 or None, " ".join(words[:40] + [f"x{rng // 40}"])) for rng in range(200)] + [(9, " ".join(words[:40] + ["x0"]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == 201 and {r["component_id"] for r in got} == {1}


def test_one_very_long_text(spark):
    rng = random.Random(2)
    long = [f"v{rng.randrange(5000)}" for _ in range(400_000)]
    near = list(long)
    for i in range(0, len(near), 400):
        near[i] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[::-1]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got[1] == (len(brute_set(rows[0][1], 4)), 1) and got[2][1] == 1 and got[3][1] == 3
