"""Alignment of two tokenizers against loops over every token."""

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxmill.llm import alignment
from voxmill.llm.encoder import tokenizer_path
from voxmill.llm.pieces import MODEL

TEXTS = [
    None, "", " ", "a", "The quick brown fox, it's 12345; isn't\n\nit?  x", "<|endoftext|> <s> x", "a▁b", "日本語 é ü \U0001f600\U0001f600", "  \t\n x\r\n", "x''s '' 's.'s", "don't", "don't",
    "q" * 700, "supercalifragilistic " * 40, "\0\x1c x\x85y  z", " a b　c", "def f(x):\n        return x[1:]  # ok", "ﬁ ½ Ａ", "|;,", "1 22 333 4444", "éa'sé's 9'9",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    alphabet = alignment.byte_alphabet()

    def tokens(text):
        if not text:
            return None
        one = a.encode(" " + text, add_special_tokens=False)
        x = [(i, bytes(alphabet[c] for c in p)) for i, p in zip(one.ids, one.tokens)]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        same = b"".join(t for _, t in x) == b"".join(t for _, t in y) == (" " + text).encode()
        return (x, y) if same else None

    return tokens


def brute(found):
    """(n_a, n_b, groups, links) of one text."""
    x, y = found
    spans = lambda ts: [(i, e - len(t), e) for (i, t), e in zip(ts, np.cumsum([len(t) for _, t in ts]).tolist())]
    x, y = spans(x), spans(y)
    links = [(i, k) for i, a, b in x for k, c, d in y if a < d and c < b]
    shared = sorted({e for _, _, e in x} & {e for _, _, e in y})
    groups = [([], []) for _ in shared]
    for side, ts in enumerate((x, y)):
        for i, _, e in ts:
            groups[bisect_left(shared, e)][side].append(i)
    return len(x), len(y), groups, links


def expected(tokens, rows):
    found = [(d, brute(t) if (t := tokens(text)) else None) for d, text in rows]
    counts = Counter(p for _, f in found if f for p in f[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((d, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_same_as_loops(spark, libraries, most):
    """With all pairs sent to tasks, a few of them, and none."""
    rows = list(enumerate(TEXTS)) + [(None, "The fox"), (4, "The fox"), (4, "The fox")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, a string").repartition(3)
    got = alignment.digest(docs, most).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(libraries, rows), key=key)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert alignment.digest(docs.limit(0)).count() == 0
    assert [tuple(r) for r in alignment.digest(docs.select("doc_id", docs.text.substr(9, 1).alias("text"))).select(*COLUMNS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_groups(spark, libraries):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(2)
    for r in alignment.align(docs, groups=True).collect():
        t = libraries(TEXTS[r["doc_id"]])
        groups = brute(t)[2] if t else []
        assert [[len(a), len(b)] for a, b in groups] == [list(x) for x in zip(r["a_sizes"], r["b_sizes"])]
        assert [i for a, _ in groups for i in a] == r["a_ids"] and [i for _, b in groups for i in b] == r["b_ids"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 300), max_size=90), st.sets(st.integers(1, 300), max_size=90)), min_size=1, max_size=4))
def test_shared_cuts(documents):
    a, b, sizes, base = [], [], [], 0
    for x, y in documents:
        x, y = sorted(x | {301}), sorted(y | {301})
        a, b, sizes, base = a + [base + e for e in x], b + [base + e for e in y], [*sizes, len(x)], base + 301
    upto = np.cumsum(sizes)
    a, b = np.array(a), np.array(b)
    assert a[alignment.shared_cuts(a, b, upto - sizes, upto - 1)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@pytest.fixture(scope="module")
def byte_tokens():
    return alignment.ByteTokens(tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("abZ 19.,'s\n\t|é　\x85\x1c  日"), max_size=14), min_size=1, max_size=4))
def test_words_in_any_text(byte_tokens, texts):
    texts = [" " + t for t in texts]
    raw = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, upto, whole = byte_tokens.encode(np.frombuffer(raw, np.uint8), bounds)
    assert whole.all()
    for i, t in enumerate(texts):
        assert ids[upto[i] : upto[i + 1]].tolist() == byte_tokens.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_text(libraries):
    """Many groups in several parts, and one group of a whole text."""
    texts = ["The quick brown fox jumps. " * 3000, None, "x", "zq" * 3000, "The quick brown fox jumps. " * 60_000]
    aligner = alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path(MODEL))
    rows = [r for batch in aligner.align(pa.array(texts), False) for r in batch.to_pylist()]
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        if t and len(t) < 100_000:
            n_a, n_b, groups, links = brute(libraries(t)) if len(t) < 10 else (r["n_a"], r["n_b"], [0] * r["n_groups"], [0] * sum(r["times"]))
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, len(groups), len(links))
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]
