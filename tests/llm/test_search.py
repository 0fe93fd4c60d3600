"""Top-k search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from voxmill.llm import search as S


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, queries, k, terms):
    bags = [(i, Counter(words(t))) for i, t in rows]
    n, df = len(rows), Counter(w for _, b in bags for w in b)
    average = max(1.0, sum(sum(b.values()) for _, b in bags) / max(n, 1))
    out = {}
    for q, wanted in queries.items():
        scores = []
        for i, b in bags:
            s = 0.0
            for w in wanted if terms is None else terms[q]:
                if b[w]:
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / average))
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("k", [1, 7])
def test_search(spark, monkeypatch, k):
    monkeypatch.setattr(S, "SHARD_DOCS", 150)
    rng = random.Random(k)
    vocabulary = [f"w{i}é" if i % 5 else f"W{i}" for i in range(300)]
    text = lambda n: " ".join(vocabulary[min(299, int(rng.expovariate(0.02)))] for _ in range(n))
    rows = [(i, text(rng.randrange(0, 60))) for i in range(500)] + [(500, None), (501, "")]
    rows += [(502 + j, rows[7][1]) for j in range(20)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int").repartition(5)
    found = {}
    for r in sorted(S.search(frame, S.sampled_queries(frame), k=k, most_terms=None).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = brute(rows, {i: set(words(t)) for i, t in rows if i % 50 == 0}, k, None)
    assert set(found) == {q for q, v in want.items() if v}
    for q, hits in found.items():
        assert [h[0] for h in hits] == [h[0] for h in want[q]]
        assert all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(hits, want[q]))


def test_registered_query_takes_all_terms(spark, monkeypatch, tmp_path):
    from voxmill.llm import queries as Q

    monkeypatch.setattr(S, "SHARD_DOCS", 10)
    monkeypatch.setattr(S, "QUERIES", 3)
    monkeypatch.setattr(S, "COMMON", 20)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*(vocabulary[min(399, int(rng.expovariate(0.01)))] for _ in range(rng.randrange(60, 150))), f"own{i}"])) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in sorted(Q.QUERIES["op9_search"](spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = brute(rows, {i: set(words(t)) for i, t in rows if i % 50 == 0}, 10, None)
    assert set(found) == set(want)
    for q, hits in found.items():
        assert [h[0] for h in hits] == [h[0] for h in want[q]]
        assert all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(hits, want[q]))


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert S.search(frame, S.sampled_queries(frame)).count() == 0


def test_odd_ids(spark):
    """Null document ids are hits and come first of equal scores; repeated ones are hits
    of their own; a null query id is no query."""
    rows = [(None, "red apple"), (None, "red apple"), (7, "red apple"), (7, "green apple"), (9, "blue"), (9, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    asked = spark.createDataFrame([(1, "Red"), (None, "apple"), (2, ""), (3, "absent"), (4, "apple blue")], "query_id long, text string")
    found = {}
    for r in sorted(S.search(docs, asked, k=4).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["doc_id"])
    assert set(found) == {1, 4}
    assert found[1] == [None, None, 7]
    assert found[4][0] == 9 and found[4][1:] == [None, None, 7]


def test_long_words_of_two_letters_are_terms_of_their_own(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, word)], "query_id long, text string")
    assert [r["doc_id"] for r in S.search(docs, asked).collect()] == [1]


def test_one_very_long_text(spark):
    rng = random.Random(1)
    long = " ".join(f"t{rng.randrange(30_000)}" for _ in range(300_000))
    rows = [(1, long), (2, long[: len(long) // 2]), (3, "t5 t6"), (4, "none of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in rows if i != 2], "query_id long, text string")
    want = brute(rows, {i: set(words(t)) for i, t in rows if i != 2}, 10, None)
    found = {}
    for r in sorted(S.search(docs, asked).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for q, hits in want.items():
        assert [h[0] for h in found[q]] == [h[0] for h in hits]
        assert all(abs(a[1] - b[1]) < 1e-6 * max(1, b[1]) for a, b in zip(found[q], hits))


def test_copies_are_one_document(spark):
    """Copies of a text are one document of a shard, and rows beyond the k least ids of a
    text are not indexed; hits name the same rows."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(40))
    some = [text() for _ in range(30)]
    rows = [(i, some[rng.randrange(30)] if i % 3 else some[0]) for i in range(1500)] + [(None, some[0]), (None, some[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = S._without_surplus(docs, 7).collect()
    assert len(kept) == 30 * 7 and sorted(r["doc_id"] for r in kept if r["text"] == some[0] and r["doc_id"] is not None) == sorted(i for i, t in rows if t == some[0] and i is not None)[:5]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "query_id long, text string")
    found = {}
    for r in sorted(S.search(docs, asked, k=7).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["doc_id"])
    want = brute([(-1 if i is None else i, t) for i, t in rows], {i: set(words(t)) for i, t in enumerate(some)}, 7, None)
    assert found == {q: [None if i == -1 else i for i, _ in hits] for q, hits in want.items()}


def shard_of(bags, queries, k):
    """A shard of bags of term numbers, each of weight 1, and queries by terms."""
    asked = S.Queries(k, S.Groups(queries))
    for i, own in enumerate(queries):
        asked.add(S.np.array([i]), S.np.array([len(own)]), own, S.np.ones(len(own)))
    asked.close()
    doc, term = S.np.repeat(S.np.arange(len(bags)), [len(b) for b in bags]), S.np.concatenate(bags)
    at, known = asked.terms.find(term)
    doc, at = doc[known], at[known]
    ids = S.np.arange(len(bags))
    return asked, S.Shard(ids, ids, ids, doc, at, asked.weight[at], asked.asked, len(asked.id))


class Counted:
    """Columns that count the sums made with them."""

    __array_ufunc__ = None

    def __init__(self, data, seen):
        self.data, self.seen = data, seen

    def __getitem__(self, at):
        return Counted(self.data[at], self.seen)

    @property
    def T(self):
        return self.data.T

    def __rmatmul__(self, left):
        self.seen.append(len(left) * self.data.shape[1])
        return left @ self.data


def test_documents_of_another_group_are_not_scored():
    """Sections whose bounds lie below a query's k-th best score are passed over."""
    rng = S.np.random.default_rng(1)
    bag = lambda language: S.np.unique(language * 1000 + rng.integers(0, 100, 60))
    bags, wanted, seen = [bag(i // 1024) for i in range(4096)], [bag(0) for _ in range(20)], []
    asked, shard = shard_of(bags, wanted, 5)
    shard.quick = Counted(shard.quick, seen)
    shard.answer(asked)
    assert sum(seen) <= 20 * 1024
    for q, score in zip(asked.id.tolist(), asked.score.tolist()):
        assert sorted((len(S.np.intersect1d(wanted[q], b)) for b in bags), reverse=True)[:5] == score


def test_groups_put_languages_apart():
    rng = S.np.random.default_rng(2)
    bags = [S.np.unique(i % 4 * 1000 + rng.integers(0, 80, 40)) for i in range(400)]
    groups = S.Groups(bags[:100])
    own = groups.of(S.np.repeat(S.np.arange(400), [len(b) for b in bags]), S.np.concatenate(bags), 400)
    assert len({(i % 4, g) for i, g in enumerate(own.tolist())}) == len(set(own.tolist())) >= 4
