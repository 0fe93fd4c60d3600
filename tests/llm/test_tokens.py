"""Encoding, token counts and the binary token format against brute force."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from voxmill.llm import token_binary as token_binary_module
from voxmill.llm.encoder import goes_by_runs, tokenizer_path
from voxmill.llm.token_binary import dac_access, dac_decode, dac_encode, token_at, token_binary, write_tokens
from voxmill.llm.token_counts import token_counts

TEXTS = [None, "", "  a \x0b b<|endoftext|>c é́ é x'll  ﬁ ǅ  ", "a" * 5000 + " bé", "<|startoftext|> x 12345    y", "The, cat's\n\nsat. ÉCOLE! J̌ı", "the\ncat", "the\ncat", "x" * 3 + "\n"]


def frame(spark):
    rows = [(i * 3, t, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)


def expected():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False) for t in TEXTS]


def test_binary(spark):
    rows = {r["doc_id"]: r for r in token_binary(frame(spark)).collect()}
    start = 0
    for i, e in enumerate(expected()):
        ids = np.array([*e.ids, 1], "<u4")
        assert (rows[3 * i]["start"], rows[3 * i]["n_tokens"], rows[3 * i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_random_access(spark, tmp_path):
    write_tokens(frame(spark), f"{tmp_path}/t", segment_tokens=7)
    stream = [i for e in expected() for i in [*e.ids, 1]]
    found = {r["place"]: r["token"] for r in token_at(spark, f"{tmp_path}/t", spark.range(len(stream)).toDF("place")).collect()}
    assert [found[i] for i in range(len(stream))] == stream


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_dac(n):
    ids = np.random.default_rng(n).integers(0, 1 << 17, n).astype(np.uint32)
    coded = dac_encode(ids)
    assert (dac_decode(coded["chunks"], coded["more"]) == ids).all()
    assert all(dac_access(**coded, i=i) == ids[i] for i in range(0, n, 7))


def test_empty(spark):
    assert token_binary(frame(spark).limit(0)).count() == 0
    assert token_counts(frame(spark).limit(0)).count() == 0


def test_lines(spark):
    rows = token_counts(frame(spark)).collect()
    for i, e in enumerate(expected()):
        text, own = TEXTS[i] or "", sorted((r for r in rows if r["doc_id"] == 3 * i), key=lambda r: r["section"])
        lines = text.splitlines(keepends=True) if "\n" in text else [text] * bool(text)
        upto = np.cumsum([0, *map(len, lines)])
        counts = [sum(upto[k] <= a < upto[k + 1] for a, _ in e.offsets) for k in range(len(lines))]
        assert [r["n_tokens"] for r in own] == (counts or [0])


@pytest.mark.parametrize("rule", ["first", "last", "majority"])
def test_sections(spark, rule):
    docs = spark.createDataFrame([(1, "extraordinary", [(0, 2), (2, 3), (3, 9)]), (2, "ab cd", None), (None, "zz", [(0, 1)])], "doc_id long, text string, sections array<struct<start:int,end:int>>")
    rows = token_counts(docs, rule=rule).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for r in docs.collect():
        want: dict[int, list[int]] = {}
        spans = r["sections"] or []
        for a, b in tokenizer.encode(r["text"], add_special_tokens=False).offsets:
            share = [max(0, min(b, s["end"]) - max(a, s["start"])) for s in spans]
            hold = lambda p: next((k for k, s in enumerate(spans) if s["start"] <= p < s["end"]), -1)
            to = hold(a) if rule == "first" else hold(b - 1) if rule == "last" else max(range(len(spans)), key=lambda k: share[k], default=-1) if any(share) else -1
            got = want.setdefault(to, [0, 0])
            got[0] += 1
            got[1] += to >= 0 and share[to] < b - a
        for k in range(len(spans)):
            want.setdefault(k, [0, 0])
        assert {x["section"]: [x["n_tokens"], x["n_crossing"]] for x in rows if x["doc_id"] == r["doc_id"]} == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer(spark, name):
    """One that keeps white space in its tokens gets documents as a whole."""
    path = tokenizer_path(name)
    assert goes_by_runs(path) == name.startswith("word")
    tokenizer = Tokenizer.from_file(path)
    want = [tokenizer.encode(t or "", add_special_tokens=False) for t in TEXTS]
    rows = {r["doc_id"]: r for r in token_binary(frame(spark), path).collect()}
    for i, e in enumerate(want):
        assert rows[3 * i]["ids_crc32"] == zlib.crc32(np.array([*e.ids, 1], "<u4").tobytes())
    whole = frame(spark).where("text is not null and text <> ''").selectExpr("doc_id", "text", "array(named_struct('start', 0, 'end', length(text))) AS sections")
    counts = {}
    for r in token_counts(whole, path).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + r["n_tokens"]
    assert counts == {3 * i: len(e.ids) for i, e in enumerate(want) if TEXTS[i]}


def test_null_and_repeated_ids(spark):
    """Null ids come first, and rows of one id in the order of their texts."""
    rows = [(5, "b c"), (None, "a"), (5, "a"), (None, None), (5, "a"), (2, "x y z"), (-7, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int").repartition(3)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_binary(docs).collect()), key=lambda r: r[1]) == want


def test_places_meet_segments_by_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_binary_module, "SEGMENT_TOKENS", 5)
    monkeypatch.setattr(token_binary_module, "ASKED", 3)
    write_tokens(frame(spark), f"{tmp_path}/t", segment_tokens=11)
    stream = [i for e in expected() for i in [*e.ids, 1]]
    asked = spark.createDataFrame([(p,) for p in [0, 3, 3, len(stream) - 1, len(stream), -1, *range(4, len(stream), 7)]], "place long")
    found = token_at(spark, f"{tmp_path}/t", asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["place"]: r["token"] for r in found.collect()} == {p: stream[p] for p in {0, 3, len(stream) - 1, *range(4, len(stream), 7)}}
