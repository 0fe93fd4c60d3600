"""Targets by brute force, and what a mixture must keep to."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxmill.llm.mixing import mix, permuted, round_keys


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, list(names)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 3 * sizes[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    return out


def corpus(seed):
    rng = random.Random(seed)
    sources = ["a", "B", "é", "𝒳", None, "tiny", "hot"]
    rows = [(i, rng.choice(sources[:5] + ["hot"] * 4), " \t".join(["w"] * rng.randrange(0, 90))) for i in range(300)]
    return rows + [(300, "tiny", "one two  three"), (301, "none", None), (302, "none", ""), (303, "a", "x " * 5000), (None, "a", "p q"), (7, "B", "again"), (7, "B", "again")]


def check(spark, rows):
    frame = spark.createDataFrame([(i, s, t, 9) for i, s, t in rows], "doc_id long, source string, text string, size int").repartition(3)
    found = mix(frame)["documents"].collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    assert len(found) == len(rows)
    by = {}
    for r in found:
        key = (r["source_size"], round(r["target"], 6))
        by[key] = by.get(key, 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert set(by) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (size, target), taken in by.items():
        assert abs(taken - target) <= max(1, 0.01 * target, size / 256)
    return sorted(map(tuple, found), key=str)


def test_mixture(spark):
    rows = corpus(1)
    assert check(spark, rows) == check(spark, rows)


def test_one_source_and_none(spark):
    check(spark, [(1, "s", "a b c"), (2, "s", "d")])
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix(empty)["documents"].count() == 0
    check(spark, [(1, "s", None), (2, None, "")])


def test_slots_and_pieces(spark):
    frame = spark.createDataFrame(corpus(2), "doc_id long, source string, text string")
    parts = mix(frame, shard_slots=50)
    slots = parts["slots"].collect()
    uses = {}
    for r in slots:
        uses[r["source"], r["block"]] = uses.get((r["source"], r["block"]), 0) + 1
    for s in {r["source"] for r in slots}:
        counts = [n for (q, _), n in uses.items() if q == s]
        assert max(counts) <= 3
    held = {(r["source"], r["block"]) for r in parts["pieces"].collect()}
    assert set(uses) <= held
    per_shard = {}
    for r in slots:
        per_shard[r["shard"]] = per_shard.get(r["shard"], 0) + 1
    assert max(per_shard.values()) <= 50 + 9


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 257, 1000, 4099])
def test_permutations(spark, n):
    """One to one for every number of blocks, and another way each turn and seed."""
    rows = spark.range(n).select("id", F.lit(n).cast("long").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    found = rows.select("id", "turn", permuted(F.col("id"), F.col("n"), round_keys(F.lit("x"), 1), F.col("turn")).alias("to"), permuted(F.col("id"), F.col("n"), round_keys(F.lit("x"), 2), F.col("turn")).alias("other")).collect()
    ways = [tuple(r[c] for r in sorted(found) if r["turn"] == t) for t in (0, 1) for c in ("to", "other")]
    assert all(sorted(w) == list(range(n)) for w in ways)
    if n >= 257:
        assert len(set(ways)) == 4
        for w in ways:  # neither the identity nor a shift of it
            steps = Counter((b - a) % n for a, b in zip(w, w[1:]))
            assert max(steps.values()) < n / 20


def test_draws(spark):
    """Shards hold sources in random numbers about their shares, never all the same."""
    rows = [(i, "abc"[i % 3], "w " * 640) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    slots = mix(frame, shard_slots=500)["slots"].collect()
    shards = {}
    for r in slots:
        shards.setdefault(r["shard"], Counter())[r["source"]] += 1
    assert sorted(shards) == list(range(18)) and all(sum(c.values()) == 500 for c in shards.values())
    for source, share in zip("abc", (1 / 6, 2 / 6, 3 / 6)):
        drawn = [c[source] for c in shards.values()]
        deviation = (500 * share * (1 - share)) ** 0.5
        assert abs(sum(drawn) - 9000 * share) <= 1
        assert max(abs(d - 500 * share) for d in drawn) < 5 * deviation
        assert 0.4 * deviation < (sum((d - 500 * share) ** 2 for d in drawn) / 18) ** 0.5 < 1.8 * deviation


def test_hot_and_strided_ids(spark):
    """Ids in strides, and null ones, fall into all chunks."""
    rows = [(i * 1000, "s", "a b c") for i in range(4000)] + [(None, "s", f"x {i}") for i in range(4000)]
    check(spark, rows)
