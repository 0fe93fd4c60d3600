"""The stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from voxmill.llm.token_binary import END_ID  # noqa: F401


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(i, text(20)) for i in range(5)]
    rows = [(i, text(40), "en", f"src{i % 4}", 0) for i in range(200)]
    junk = set(range(150, 200))
    rows = [(i, t.upper().replace(" ", "!! ") if i in junk else t, lang, s, n) for i, t, lang, s, n in rows]
    rows += [(300, rows[3][1], "en", "src0", 0), (301, rows[4][1].rsplit(" ", 1)[0] + " end", "en", "src1", 0), (302, f"{text(10)} {items[2][1]} {text(10)}", "en", "src2", 0), (303, None, None, None, 0), (304, "", "en", "src1", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        kept.append([r["doc_id"] for r in docs.collect()])
    assert not junk & set(kept[0]) and len(set(range(150)) & set(kept[0])) == 150
    assert set(kept[0]) - set(kept[1]) == {300, 301} and set(kept[1]) - set(kept[2]) == {302}
    assert set(kept[3]) <= set(kept[2]) and max(kept[3].count(i) for i in set(kept[3])) <= 3
    assert sorted(kept[4]) == sorted(kept[3])
    run = corpus_pipeline.run(spark, folder)
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(run.collect()) == key(docs.collect())


def tables(spark, folder, rows, items=(), labels=()):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, d string, _id long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_empty_tables(spark, tmp_path):
    docs = tables(spark, str(tmp_path), [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_rows(spark, tmp_path):
    """Rows are told apart by doc_id and text; extra columns, whatever their names, stay."""
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(30))
    copy, dirty, clean = text(), text(), text()
    own = lambda i, t, s="s": (i, t, "en", s, 0, "x", 5)
    rows = [own(1, copy), own(2, copy), own(2, clean), own(None, copy), own(None, dirty), own(None, None), own(3, dirty), own(3, ""), own(4, clean + " more"), own(4, clean + " more"), own(7, None, None)]
    docs = tables(spark, str(tmp_path), rows, [(1, dirty)])
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = lambda gone: sorted(((r[0], r[1]) for k, r in enumerate(rows) if k not in gone), key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert key(stages["quality"](spark, docs, str(tmp_path))) == want(set())
    found = stages["near_dedup"](spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    # of copies the least doc_id stays; of 2 and 4 the clean text of 2; null goes where 3 stays
    assert key(found) == want({1, 3, 4, 8, 9})
    assert key(stages["decontamination"](spark, docs, str(tmp_path))) == want({4, 6})
    taken = stages["mixing"](spark, docs, str(tmp_path))
    assert taken.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in taken.collect()]
    assert all(got.count(r) <= 3 * want(set()).count(r) for r in got) and not any(t in (None, "") for _, t in got)
    assert stages["tokens"](spark, docs, str(tmp_path)).count() == len(rows)


def test_mixing_meets_its_targets(spark, tmp_path):
    rng = random.Random(9)
    size = lambda: max(1, int(rng.lognormvariate(3, 1.2)))
    rows = [(i, "w " * size() + str(i), "en", rng.choice(["a", "b", "b", "b", "c", "c"]), 0, "", 0) for i in range(3000)]
    docs = tables(spark, str(tmp_path), rows)
    sizes, got = {}, {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    total, weights = sum(sizes.values()), {"a": 1, "b": 2, "c": 3}
    for s, w in weights.items():
        target = min(3 * sizes[s], total * w / 6)
        assert abs(got[s] - target) < 0.02 * target, (s, got[s], target)
