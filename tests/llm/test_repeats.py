"""Induced suffix sorting, and removal of repeated strings, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from voxmill.llm import repeats, suffixes
from voxmill.llm.repeats import remove_repeats
from voxmill.llm.suffixes import DEPTH, suffix_order


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"ab c\xff"])
def test_suffix_order(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(60):
        base = bytes(rng.choices(alphabet, k=120))
        parts = []
        for _ in range(rng.randrange(1, 6)):
            i = rng.randrange(0, 90)
            p = bytearray(base[i : i + rng.randrange(1, 60)])
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = rng.choice(b"abz\xff")
            parts.append(bytes(p) + b"\0")
        text = np.frombuffer(b"".join(parts), np.uint8)
        order, common = map(np.concatenate, zip(*suffix_order(text, held=rng.choice([4, 10, 10**6]))))
        assert sorted(order.tolist()) == list(range(len(text)))
        raw = text.tobytes() + b"\0" * DEPTH
        keys = [raw[i : i + DEPTH] for i in order]
        for a, b, n in zip(keys, keys[1:], common[1:]):
            w = next((k for k in range(DEPTH) if a[k] != b[k]), DEPTH)
            if 0 not in a[:w] and 0 not in b[:w]:  # behind a separator any order will do
                assert a <= b and n == w


def brute(rows, size=50):
    first: dict[bytes, int] = {}
    order = lambda i: repeats.NULL_ID if i is None else i
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in data:
        for s in range(len(raw) - size + 1):
            w = raw[s : s + size]
            first[w] = min(first.get(w, 2**63), order(i))
    out = []
    for i, raw in data:
        gone = bytearray(len(raw))
        for s in range(len(raw) - size + 1):
            if first[raw[s : s + size]] < order(i):
                gone[s : s + size] = b"\1" * size
        spans = bytes(gone).replace(b"\0", b" ").split()
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = "the of and in that é to is was for ing er tion".split()
    text = lambda n: " ".join("".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(n))
    shared = [text(n) for n in (4, 8, 12, 30, 200)]
    rows = [(None, shared[2]), (-5, shared[3][3:]), (0, None), (1, ""), (2, "a" * 400), (3, "b" + "a" * 300 + "b"), (4, "a" * 49), (5, "a" * 50), (5, shared[4])]
    for i in range(6, 70):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, len(p) // 2)
            p = p[a : a + rng.randrange(1, len(p))]
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, text(rng.randrange(0, 9))]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    rows += [(70 + k, rows[20 + k][1]) for k in range(5)] + [(80, "\0" * 120), (81, "\0" * 90 + "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removal(spark, seed):
    rows = corpus(seed)
    found = remove_repeats(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, name int").repartition(4))
    got = sorted(((r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in found.collect()), key=str)
    assert got == brute(rows)


def test_contexts_of_a_frequent_anchor_do_not_meet_in_one_task(spark):
    rows = [(1 if i % 3 else 3 if i < 15 else i, i, 2 * i) for i in range(90)]
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as if the contexts were many
    sized = repeats._sized(spark.createDataFrame(rows, "key long, name long, doc_id long"), 81, 1000)
    plan = sized._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(threshold, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = [(*r, {1: 5, 3: 1}.get(r[0], 0)) for r in rows]  # 60, 5 and single contexts of 81 bytes
    assert sorted(tuple(r) for r in sized.select("key", "name", "doc_id", "parts").collect()) == sorted(want)


@pytest.mark.parametrize("bound", [120, 1000])
def test_group_beyond_the_bound(spark, bound):
    rng = random.Random(bound)
    passage = "".join(rng.choices("abcdefgh ", k=90))
    rows = [(i, f"{rng.randrange(10**6)}{rng.choice('xyz')}{passage}{rng.choice('pqr')}{rng.randrange(10**6)}") for i in range(80)] + corpus(4)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in remove_repeats(frame, shard_bytes=bound).collect()), key=str)
    assert got == brute(rows)


def test_ties_in_single_words():
    rng = np.random.default_rng(7)
    for n, groups, keys in ((0, 1, 1), (1, 1, 1), (500, 40, 3), (500, 1, 500), (3000, 3000, 2)):
        group, key = np.sort(rng.integers(0, groups, n)), rng.integers(0, keys, n).astype(np.uint64) << np.uint64(50)
        want = np.lexsort((key, group)).tolist()
        assert suffixes._order_in(group, key).tolist() == want
        assert suffixes._order_in(group << 40, key).tolist() == want  # too wide for one word


def test_shard_far_larger_than_memory(monkeypatch, tmp_path):
    """A text of 60,000 bytes in sorts and queues of 1,000 entries; all go to files."""
    monkeypatch.setattr(suffixes, "STRETCH", 300)
    held, files = [], []
    monkeypatch.setattr(suffixes.Queues, "more", lambda self, n, more=suffixes.Queues.more: (more(self, n), held.append(self.used)))
    monkeypatch.setattr(suffixes.Scratch, "write", lambda self, rows, write=suffixes.Scratch.write: files.append(len(rows)) or write(self, rows))
    rng = random.Random(8)
    words = [bytes(rng.choices(b"abcde", k=rng.randrange(1, 9))) for _ in range(40)]
    passage = b" ".join(rng.choices(words, k=60))
    raw = b"".join(b" ".join(rng.choices(words, k=20)) + passage[rng.randrange(99) :] + b"\0" for _ in range(150))[:60_000]
    path = tmp_path / "text"
    path.write_bytes(raw)
    order, common = map(np.concatenate, zip(*suffix_order(np.memmap(path, np.uint8, "r"), held=1000)))
    assert sorted(order.tolist()) == list(range(len(raw)))
    padded = raw + b"\0" * DEPTH
    keys = [padded[i : i + DEPTH] for i in order]
    for a, b, n in zip(keys, keys[1:], common[1:]):
        w = next((k for k in range(DEPTH) if a[k] != b[k]), DEPTH)
        if 0 not in a[:w] and 0 not in b[:w]:
            assert a <= b and n == w
    assert max(held) <= 1000 + 300 and sum(files) > len(raw)


def test_a_full_shard_is_sorted_in_files(monkeypatch):
    """With the query's own bounds: queues, and the sorts of names, go to files."""
    files = {"queues": 0, "sorts": 0}

    def counted(kind, owner, method):
        def write(self, *args, call=getattr(owner, method)):
            before = self.scratch.file.seek(0, 2) if self.scratch.file else 0
            out = call(self, *args)
            files[kind] += (self.scratch.file.seek(0, 2) if self.scratch.file else 0) - before
            return out

        monkeypatch.setattr(owner, method, write)

    counted("queues", suffixes.Queues, "more"), counted("sorts", suffixes.Sorter, "add")
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(3000)]
    held, size = [], 0
    while size < repeats.SHARD_BYTES:
        held += [" ".join(rng.choices(words, k=12)).encode()] * 2
        size += 2 * len(held[-1]) + 2
    n = len(held)
    batch = repeats.pa.RecordBatch.from_pydict({"task": [*np.repeat(np.arange(n // 2), 2).tolist()], "parted": [False] * n, "doc_id": [0, 1] * (n // 2), "name": [*range(n)], "first": [0] * n, "bytes": held})
    out = sum(b.num_rows for b in repeats._sort(repeats.SIZE, repeats.SHARD_BYTES)(iter([batch])))
    assert out == sum(max(0, len(b) - repeats.SIZE + 1) for b in held[::2])
    assert files["queues"] > 8 * repeats.SHARD_BYTES and files["sorts"] > repeats.SHARD_BYTES


def test_shards_take_whole_keys_until_full(monkeypatch):
    sizes = []
    monkeypatch.setattr(repeats, "suffix_order", lambda text: sizes.append(len(text)) or suffix_order(text))
    piece = b"0123456789" * 5 + b"abcdefg"
    rows = {"task": [1, 1] + [2] * 10 + [3] * 30 + [4, 4], "parted": [False] * 12 + [True] * 30 + [False] * 2, "doc_id": [0, 1, *range(10), *range(30), 0, 1], "name": [*range(44)], "first": [0] * 44, "bytes": [piece] * 44}
    whole = repeats.pa.RecordBatch.from_pydict(rows)
    for step in (5, 44):
        sizes.clear()
        out = [r for b in repeats._sort(50, 300)(iter([whole.slice(a, step) for a in range(0, 44, step)])) for r in b.to_pylist()]
        assert sizes == [12 * 58, 30 * 58, 2 * 58]
        assert sum(r["bytes"] is None for r in out) == 8 * (10 + 29 + 1)
        # strings that stay are named where their group has other parts
        assert sorted(r["string"] for r in out if r["bytes"]) == list(range(8))
        assert {bytes(r["bytes"]) for r in out if r["bytes"]} == {piece[i : i + 50] for i in range(8)}


def test_contexts_are_reduced_before_the_shuffle():
    text = " ".join(f"{i * 7919 % 1000}" for i in range(60))
    batch = repeats.pa.RecordBatch.from_pydict({"doc_id": [5, 3, None, 9], "text": [text, text, "", text]})
    (out,) = [b.to_pydict() for b in repeats._anchors(50, 20)(iter([batch]))]
    n = out["settled"].count(False)
    assert n == len({(k, c) for k, c, s in zip(out["key"], out["name"], out["settled"]) if not s})
    assert {d for d, s in zip(out["doc_id"], out["settled"]) if not s} == {3}
    assert sorted(d for d, s in zip(out["doc_id"], out["settled"]) if s) == [5] * n + [9] * n


@pytest.mark.parametrize("block", [1, 7, 64, 10**6])
def test_contexts(block, monkeypatch):
    """Each string has the anchor of least hash, wherever blocks and texts end; texts too
    short for a string have none, even if there are no others."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(30):
        lengths = rng.choices([0, 1, 30, 49, 50, 51, 90, 200], k=rng.randrange(1, 7))
        raw = np.frombuffer(bytes(rng.choices(rng.choice([b"a", b"ab", b"abcdefgh"]), k=sum(lengths))), np.uint8)
        bounds = np.cumsum([0, *lengths])
        c = repeats.contexts(raw, bounds)
        words = np.arange(max(0, len(raw) - 19))
        code = [int(w) >> 32 for w in repeats.span_hash(c["h"], words, words + 20)]
        want = []
        for owner, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            for s in range(a, b - 49):
                at = min(range(s, s + 31), key=lambda i: (code[i], i))
                if want and want[-1][0] == owner and want[-1][3] == at:
                    want[-1][2] = s
                else:
                    want.append([owner, s, s, at])
        assert np.stack([c[k] for k in ("owner", "lo", "hi", "at")], 1).tolist() == want


def test_a_slice_of_short_texts():
    raw = np.frombuffer(b"a" * 90, np.uint8)
    assert [len(repeats.contexts(raw, np.array([0, 30, 60, 90]))[k]) for k in ("owner", "lo", "hi", "at", "key", "name")] == [0] * 6


def listed(texts, parts=0):
    """Rows of (doc_id, text, names, parts): all contexts of every text."""
    lists = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        lists.append(sorted({*repeats.contexts(raw, np.array([0, len(raw)]))["name"].tolist()}))
    columns = {"doc_id": range(len(texts)), "text": texts, "names": lists, "parts": [[parts] * len(x) for x in lists]}
    types = [("doc_id", repeats.pa.int64()), ("text", repeats.pa.string()), ("names", repeats.pa.list_(repeats.pa.int64())), ("parts", repeats.pa.list_(repeats.pa.int64()))]
    return repeats.pa.RecordBatch.from_arrays([repeats.pa.array(columns[k], t) for k, t in types], names=list(columns))


def test_a_context_is_shuffled_once():
    """A context's bytes go to its shard once, not again for each part of its strings; and
    a document's own copies of it are one."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghij ", k=3000))
    raw = np.frombuffer(text.encode(), np.uint8)
    c = repeats.contexts(raw, np.array([0, len(raw)]))
    batch = listed([text, text + text])
    out = list(repeats._pieces(repeats.SIZE, repeats.ANCHOR)(iter([batch])))
    once = sum((c["hi"] - c["lo"] + repeats.SIZE).tolist())
    assert sum(len(x) for b in out for x, d in zip(b["bytes"].to_pylist(), b["doc_id"].to_pylist()) if d == 0) == once
    assert sum(b.num_rows for b in out) == sum(len(x) for x in batch["names"].to_pylist())


@pytest.mark.parametrize("parts", [0, 1])
@pytest.mark.parametrize("step", [1, 3, 50, 10**6])
def test_stretches_that_may_match(step, parts, monkeypatch):
    """All strings that two contexts share stay, wherever batches end, and no byte of a
    context stands twice in a shard's text."""
    monkeypatch.setattr(repeats, "TOGETHER", 5000)
    rng = random.Random(6)
    passages = ["".join(rng.choices("abcdefghij ", k=k)) for k in (50, 55, 70, 140)]
    texts = ["".join(rng.choices("klmnop", k=30)).join(["", *rng.sample(passages, 2), ""]) for _ in range(40)]
    rows = repeats.pa.Table.from_batches(repeats._pieces(repeats.SIZE, repeats.ANCHOR)(iter([listed(texts, parts)])))
    (rows,) = rows.sort_by("task").combine_chunks().to_batches()
    whole = parts == 0
    parts = rows.slice(0, 3).set_column(1, "parted", repeats.pa.array([True] * 3))
    cut = [rows.slice(a, step) for a in range(0, len(rows), step)]
    out = list(repeats._matched(repeats.SIZE)(iter([*cut[:1], parts, *cut[1:]])))
    got = [r for b in out for r in b.to_pylist()]
    assert [{k: v for k, v in r.items() if k != "anchor"} for r in parts.to_pylist()] == [r for r in got if r["parted"]]
    got = [r for r in got if not r["parted"]]
    strings = lambda b: [b[i : i + repeats.SIZE] for i in range(len(b) - repeats.SIZE + 1)]
    where = {}
    for r in rows.to_pylist():
        for i, s in enumerate(strings(r["bytes"])):
            where.setdefault((r["task"], s), set()).add((r["doc_id"], r["name"], r["first"] + i))
    shared = {x for at in where.values() if len({n for _, n, _ in at}) > 1 for x in at}
    found = [(r["doc_id"], r["name"], r["first"] + i) for r in got for i in range(len(strings(r["bytes"])))]
    assert len(found) == len({*found}) and shared and shared <= {*found}
    assert all(x in where[r["task"], s] for r in got for x, s in zip(((r["doc_id"], r["name"], r["first"] + i) for i in range(99)), strings(r["bytes"])))
    tasks = [r["task"] for r in got]
    assert tasks == sorted(tasks)
    if not whole:
        assert max(len(r["bytes"]) for r in got) < repeats.SIZE + repeats.STEP
        return
    # stretches of one context lie apart
    ends = sorted((r["doc_id"], r["name"], r["first"], r["first"] + len(strings(r["bytes"]))) for r in got)
    assert all(x[:2] != y[:2] or x[3] < y[2] for x, y in zip(ends, ends[1:]))


def test_rows_of_one_doc_id_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 20_000)
    sizes, take = [], repeats._bytes
    monkeypatch.setattr(repeats, "_bytes", lambda batch: sizes.append(batch.num_rows) or take(batch))
    rows = {"task": [7] * 5000, "parted": [False] * 5000, "doc_id": [3] * 4999 + [4], "name": [1] * 4999 + [2], "first": [0] * 5000, "anchor": [0] * 5000, "bytes": [b"0123456789" * 6] * 5000}
    schema = repeats.pa.schema([("task", "int64"), ("parted", "bool"), ("doc_id", "int64"), ("name", "int64"), ("first", "int32"), ("anchor", "int32"), ("bytes", "binary")])
    batch = repeats.pa.RecordBatch.from_pydict(rows, schema=schema)
    out = [r for b in repeats._matched(50)(iter([batch.slice(a, 100) for a in range(0, 5000, 100)])) for r in b.to_pylist()]
    assert max(sizes) < 1000 and {(r["doc_id"], r["name"]) for r in out} == {(3, 1), (4, 2)}


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
