"""The rule ensemble: accuracy on held-out rows, and its edges."""

import math
import random
import re
import zlib

import pytest

from voxmill.llm.quality import classify, fit, keep_good, statistics


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(rng.randrange(5, 60))]
        text = " ".join(words) + "." if good else rng.choice([" | ".join(words), " ".join(words).upper() + "!!", " ".join(w + "$$$" for w in words)])
        rows.append((i, text, "en", f"src{i % 3}", len(text), 0.5))
        labels.append((i, int(good), 0))
    rows += [(600, None, None, None, 0, 0.0), (601, "", "x", "y", 0, 0.0), (None, "some words here.", "x", "y", 0, 0.0), (5, rows[5][1], "q", "r", 1, 0.0)]
    labels += [(9999, 1, 0), (None, 0, 0), (7, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, chars int, score double").repartition(3).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: q for i, q, _ in labels if i is not None and q is not None}


def test_held_out(data):
    docs, labels, truth = data
    found = classify(docs, labels).collect()
    assert len(found) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    judged = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in judged) >= 0.95 * len(judged)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] for r in found)


def test_no_leaks(data):
    docs, labels, truth = data
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    flipped = labels.where(~labels.doc_id.isin(held))
    a = {(r["doc_id"], round(r["score"], 9)) for r in classify(docs, labels).collect()}
    b = {(r["doc_id"], round(r["score"], 9)) for r in classify(docs, flipped).collect()}
    assert a == b


def test_edges(spark, data):
    docs, labels, _ = data
    assert {r["score"] for r in classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).count() == 0
    ones = labels.where("quality = 1")
    assert all(r["score"] > 0.9 for r in classify(docs.limit(5), ones).collect())


def brute_statistics(text):
    """The statistics of a text, one by one, in the order of STATISTICS."""
    t = text or ""
    n, size = len(t), len(t.encode())
    of = lambda chars: sum(c in chars for c in t)
    spaces, lines = of(" \t"), of("\n")
    words = spaces + lines + 1
    share = lambda a, b: a / b if b else 0.0
    kinds = len(set(re.split(" ", t.lower().replace("\n", " "))))
    return [
        math.log1p(n), share(size - n, n), share(of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n), share(of("0123456789"), n), share(spaces, n), share(lines, n), share(of(".,"), n),
        share(of("!?;:'\"()"), n), share(of("#$%&*+/<=>@[\\]^_`{}~-"), n), share(of("|"), n), (n - spaces - lines) / words,
        kinds / words if n else 0.0, len(set(t.split("\n"))) / (lines + 1) if n else 0.0,
    ]


def test_score_by_brute_force(spark, data):
    docs, labels, _ = data
    odd = ["é𝒳 ÀB\tc\n\nd | x!", " ", "\n", "a" * 30000 + " B", "ǅ İ \x0b", "{}[]~`^\\_- 12"]
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    texts = {r["doc_id"]: r["text"] for r in every.collect()}
    for r in statistics(every, "doc_id").collect():
        assert r[1:] == pytest.approx(tuple(brute_statistics(texts[r["doc_id"]])), abs=1e-12), texts[r["doc_id"]]
    model = fit(docs, labels)
    assert len(model.rules) >= 2
    clash = every.selectExpr("*", "1 AS stats", "'x' AS stats_", "2 AS score")
    for r in classify(every, labels).collect():
        s = brute_statistics(texts[r["doc_id"]])
        total = model.base + sum(w for rule, w in model.rules if all(s[i] <= at if most else s[i] > at for i, most, at in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    kept = keep_good(clash, labels)
    assert kept.columns == clash.columns and {r["stats_"] for r in kept.collect()} == {"x"}


def test_repeated_rows_count_once(spark, data):
    """A thousand rows of one labelled id weigh as much as one."""
    docs, labels, _ = data
    one = docs.where("doc_id = 0").limit(1)
    many = docs.unionByName(one.crossJoin(spark.range(1000).select()))
    assert fit(many, labels).rules == fit(docs, labels).rules
