"""The data source with filters, blocks that it reads, and the sink in two phases."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, LessThanOrEqual

from voxmill import chunks as ch
from voxmill.sources import tiff, tiff_sink, tiff_source


def cube(shape=(6, 20, 24), seed=3):
    return np.random.default_rng(seed).random(shape).astype(np.float32)


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    found = {}
    for i, name in enumerate(["a.tif", "deep/b.tiff"]):
        found[tiff_source.image_id(f"file:{tmp_path}/in/{name}")] = g = cube(seed=i)
        (tmp_path / "in" / name).write_bytes(tiff.encode(g, tile=(16, 16) if i else None))
    (tmp_path / "in" / "other.txt").write_text("not a file of this source")
    return tmp_path, found


@pytest.mark.parametrize("task_bytes", [tiff_source.TASK_BYTES, 700])
def test_read(spark, files, task_bytes):
    """Whole, and in more shares than slices."""
    where, found = files
    tiff_source.register(spark)
    rows = spark.read.format("tiff").option("taskBytes", task_bytes).load(f"{where}/in").toPandas()
    assert len(rows) == sum(g.size for g in found.values())
    for image, own in rows.groupby("image_id"):
        assert np.array_equal(found[image][own["z"], own["y"], own["x"]], own["v"])


@pytest.mark.parametrize("condition", ["z = 3 and x < 9", "x >= 4 and x <= 6 and y > 17 and z <> 2", "z in (1, 4)", "z > 9", "v > 0.5 and x = 23", "x < 5 or y = 1", "z between 2 and 3 and abs(x - y) = 1"])
def test_filters(spark, files, condition):
    where, found = files
    tiff_source.register(spark)
    source = spark.read.format("tiff").load(f"file://{where}/in")
    rows = source.where(condition).toPandas()
    every = source.toPandas().query({"v > 0.5 and x = 23": "v > 0.5 and x == 23"}.get(condition, condition.replace("<>", "!=").replace(" = ", " == ").replace("z in (1, 4)", "z in [1, 4]").replace("z between 2 and 3", "2 <= z <= 3")))
    key = ["image_id", "z", "y", "x"]
    assert rows.sort_values(key).reset_index(drop=True).equals(every.sort_values(key).reset_index(drop=True))


def read_bytes(reader, monkeypatch):
    """Bytes of blocks that a reader reads."""
    total = []
    blocks = tiff.page_blocks

    def counted(*args):
        for found in blocks(*args):
            total.append(found[3])
            yield found

    monkeypatch.setattr(tiff, "page_blocks", counted)
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    return rows, sum(total)


def test_only_blocks_of_the_filter_are_read(files, monkeypatch):
    where, _ = files
    whole = tiff_source.TiffReader({"path": f"{where}/in/deep"})
    assert read_bytes(whole, monkeypatch) == (6 * 20 * 24, 6 * 4 * 16 * 16 * 4)
    part = tiff_source.TiffReader({"path": f"{where}/in/deep"})
    left = list(part.pushFilters([EqualTo(("z",), 3), LessThan(("x",), 9), LessThanOrEqual(("y",), 4), In(("v",), (1.0,))]))
    assert left == [In(("v",), (1.0,))]
    assert read_bytes(part, monkeypatch) == (9 * 5, 16 * 16 * 4)
    none = tiff_source.TiffReader({"path": f"{where}/in"})
    assert not list(none.pushFilters([EqualTo(("image_id",), 1), GreaterThan(("z",), 1)]))
    assert read_bytes(none, monkeypatch) == (0, 0)


def test_pushed_filters_are_not_left_in_the_plan(spark, files):
    where, _ = files
    tiff_source.register(spark)
    rows = spark.read.format("tiff").load(f"{where}/in").where("z = 3 and x < 9 and v > 0.1")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "(v#" in plan and "(x#" not in plan and "(z#" not in plan and "isnotnull" not in plan


def test_block_rows(spark, files):
    where, found = files
    tiff_source.register(spark)
    rows = spark.read.format("tiff").option("rows", "blocks").load(f"{where}/in/deep").where("z = 2 and x > 3").collect()
    assert [(r["x"], r["y"], r["w"], r["h"], r["bytes"]) for r in sorted(rows, key=lambda r: r["y"])] == [(16, 0, 8, 16, 1024), (16, 16, 8, 4, 1024)]
    (g,) = (found[r["image_id"]] for r in rows[:1])
    for r in rows:
        assert np.array_equal(np.frombuffer(r["data"], "<f4").reshape(r["h"], r["w"]), g[2, r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]])


def test_pieces_of_files_are_those_of_chunks(spark, files):
    where, found = files
    layout = ch.Layout((24, 20, 6), (10, 7, 4), (3, 2, 1), (2, 2, 2), "mirror")
    out = ch.to_voxels(ch.gather(tiff_source.read_pieces(spark, f"{where}/in", layout), layout, lambda c, _: c * 2, kind=tiff_source.KIND), "v").voxels.toPandas()
    assert len(out) == 2 * 24 * 20 * 6
    for image, own in out.groupby("image_id"):
        assert np.allclose(found[image][own["z"], own["y"], own["x"]] * 2, own["v"])


@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("how", [tiff.NONE, tiff.DEFLATE])
def test_several_tasks_write_one_file(spark, files, tile, how, monkeypatch):
    where, found = files
    small = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        _written_by_several(spark, where, found, tile, how, monkeypatch)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _written_by_several(spark, where, found, tile, how, monkeypatch):
    monkeypatch.setattr(tiff_sink, "SLAB", 24 * 20 * 8 * 2)
    layout = ch.Layout((24, 20, 6), (10, 7, 4))
    chunks = ch.gather(tiff_source.read_pieces(spark, f"{where}/in", layout), layout, lambda c, _: c, kind=tiff_source.KIND)
    names = tiff_source.list_files(spark, f"{where}/in").select("image_id", F.col("image_id").cast("string").alias("name"))
    done = tiff_sink.write_tiff(tiff_sink.encode_chunks(chunks, how, tile=tile), f"file://{where}/out", names).collect()
    assert len(done) == 2 and all(r["tasks"] > 1 for r in done)
    for image, g in found.items():
        assert (where / "out" / f"{image}.tiff").read_bytes() == tiff.encode(g, how, tile=tile)


def test_a_failed_task_leaves_no_file(spark, files):
    where, _ = files
    layout = ch.Layout((24, 20, 6), (24, 20, 6))
    pieces = tiff_sink.encode_chunks(ch.gather(tiff_source.read_pieces(spark, f"{where}/in", layout), layout, lambda c, _: c, kind=tiff_source.KIND))
    broken = pieces.withColumn("piece", F.when(F.col("z") == 5, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("piece")))
    with pytest.raises(Exception, match="lost"):
        tiff_sink.write_tiff(broken, f"file://{where}/out")
    assert not (where / "out").exists() or not list((where / "out").rglob("*"))
    # a piece that is missing is noticed before the file is shown
    with pytest.raises(Exception, match="in pieces that end at"):
        tiff_sink.write_tiff(pieces.where("z <> 2"), f"file://{where}/out")
    assert not list((where / "out").rglob("*"))


def test_packbits_and_floating_predictor():
    assert tiff.packbits_decode(bytes([2, 1, 2, 3, 254, 7, 128, 0, 9])) == bytes([1, 2, 3, 7, 7, 7, 9])
    g = cube((1, 5, 7))[0]
    planes = g.astype(">f4").view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    coded = np.diff(planes, axis=1, prepend=np.uint8(0))
    page = tiff.Page("<", {tiff.WIDTH: [7], tiff.LENGTH: [5], tiff.BITS: [32], tiff.FORMAT: [3], tiff.PREDICTOR: [tiff.FLOATING], tiff.STRIPS: [0], tiff.STRIP_BYTES: [140], tiff.ROWS: [5]})
    assert np.array_equal(tiff.read_page(coded.tobytes(), page), g)
