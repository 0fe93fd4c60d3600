"""Boxes, ranges, labels and blending."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill import chunks as ch
from voxmill.volume import KEYS, Shape, Volume

BOX = ("x", "y", "z", "w", "h", "d")


def box(x, y, z, w, h, d) -> Column:
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (x, y, z, w, h, d)]
    return F.struct(*(p.cast("int").alias(n) for p, n in zip(parts, BOX)))


def intersect(a: Column, b: Column) -> Column:
    """The common box, with no extent where there is none."""
    lo = [F.greatest(a[p], b[p]) for p in "xyz"]
    hi = [F.least(a[p] + a[s], b[p] + b[s]) for p, s in zip("xyz", "whd")]
    return box(*lo, *(F.greatest(e - s, F.lit(0)) for s, e in zip(lo, hi)))


def is_within(inner: Column, outer: Column) -> Column:
    out = F.lit(True)
    for p, s in zip("xyz", "whd"):
        out = out & (inner[p] >= outer[p]) & (inner[p] + inner[s] <= outer[p] + outer[s])
    return out


def subtract(outer: Column, inner: Column) -> Column:
    """outer without inner, as an array of at most six disjoint boxes: what lies
    before and after the common box along x, then y, then z."""
    i = intersect(outer, inner)
    o = outer
    end = lambda b, p, s: b[p] + b[s]
    slabs = F.array(
        box(o["x"], o["y"], o["z"], i["x"] - o["x"], o["h"], o["d"]),
        box(end(i, "x", "w"), o["y"], o["z"], end(o, "x", "w") - end(i, "x", "w"), o["h"], o["d"]),
        box(i["x"], o["y"], o["z"], i["w"], i["y"] - o["y"], o["d"]),
        box(i["x"], end(i, "y", "h"), o["z"], i["w"], end(o, "y", "h") - end(i, "y", "h"), o["d"]),
        box(i["x"], i["y"], o["z"], i["w"], i["h"], i["z"] - o["z"]),
        box(i["x"], i["y"], end(i, "z", "d"), i["w"], i["h"], end(o, "z", "d") - end(i, "z", "d")),
    )
    some = (i["w"] > 0) & (i["h"] > 0) & (i["d"] > 0)
    return F.when(some, F.filter(slabs, lambda b: (b["w"] > 0) & (b["h"] > 0) & (b["d"] > 0))).otherwise(F.array(outer))


def _level(extent: Column) -> Column:
    """The least level whose cells, 2^level wide, are no smaller than an extent."""
    return F.ceil(F.log2(extent.cast("double"))).cast("int")


#: A box covers at most 2^2 + 1 cells of its class along an axis, and is at least 2^-3 as wide
#: as one; a class of fewer boxes than its share goes into the next wider one.
CLASS, REACH, FEW = 5, 2, 0.1


def _classes(a: dict[int, int], b: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(class, level of its cells) for each level of extents along one axis. a, b: boxes of
    each table by level. Cells of class 0 are as wide as the two tables' extents are in the
    mean of logarithms, which compares the fewest boxes."""
    n_a, n_b = sum(a.values()), sum(b.values())
    base = round((sum(k * n for k, n in a.items()) / max(n_a, 1) + sum(k * n for k, n in b.items()) / max(n_b, 1)) / 2)
    levels = sorted({*a, *b})
    own = {n: (n - base + REACH) // CLASS for n in levels}
    for c in sorted(set(own.values()))[:-1]:
        held = [n for n in levels if own[n] == c]
        if sum(a.get(n, 0) for n in held) * sum(b.get(n, 0) for n in held) <= FEW * n_a * n_b:
            own |= dict.fromkeys(held, min(x for x in own.values() if x > c))
    return {n: (c, min(max(base + CLASS * c, 0), 31)) for n, c in own.items()}


def place_boxes(a: DataFrame, b: DataFrame, left: str = "box", right: str = "other", within: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tables' boxes with extent, once for each cell (_pair, _x, _y, _z) in which boxes
    of the other table may meet them. Each axis has cells of its own width, and boxes much
    wider or narrower than most make classes: a pair of classes has the wider one's cells."""
    some = lambda c: (F.col(c)["w"] > 0) & (F.col(c)["h"] > 0) & (F.col(c)["d"] > 0)
    leveled = [rows.where(some(c)).withColumns({f"_{p}": _level(F.col(c)[s]) for p, s in zip("xyz", "whd")}) for rows, c in ((a, left), (b, right))]
    counts = [rows.groupBy("_x", "_y", "_z").count().collect() for rows in leveled]  # 32^3 at most
    axes = []
    for i in range(3):
        of = [{}, {}]
        for own, found in zip(of, counts):
            for r in found:
                own[r[i]] = own.get(r[i], 0) + r["count"]
        axes.append(_classes(*of))
    kinds = [{tuple(r[:3]): tuple(axis[n] for axis, n in zip(axes, r)) for r in found} for found in counts]
    met = [(x, y) for x in sorted(set(kinds[0].values())) for y in sorted(set(kinds[1].values())) if not within or all(m[0] <= n[0] for m, n in zip(x, y))]
    placed = []
    for side, (rows, kind, name) in enumerate(zip(leveled, kinds, (left, right))):
        pairs = [(*levels, n, *(max(m[1], k[1]) for m, k in zip(*pair))) for levels, own in kind.items() for n, pair in enumerate(met) if pair[side] == own]
        pairs = a.sparkSession.createDataFrame(pairs, "_x int, _y int, _z int, _pair int, _sx int, _sy int, _sz int")
        rows = rows.join(F.broadcast(pairs), ["_x", "_y", "_z"]).drop("_x", "_y", "_z")
        for c, size in zip("xyz", "whd"):
            first = F.expr(f"shiftright({name}.{c}, _s{c})")
            if within and side == 0:
                rows = rows.withColumn(f"_{c}", first)
            else:
                rows = rows.withColumn(f"_{c}", F.explode(F.sequence(first, F.expr(f"shiftright({name}.{c} + {name}.{size} - 1, _s{c})"))))
        placed.append(rows)
    return placed[0], placed[1].drop("_sx", "_sy", "_sz")


def join_boxes(a: DataFrame, b: DataFrame, keys: list[str], left: str = "box", right: str = "other", within: bool = False) -> DataFrame:
    """Pairs of boxes of two tables that have equal keys and share a voxel, or of which the
    left one lies within the right one. Boxes meet by equal cells, in the one that holds the
    first corner of what they share, or of a left one within the right one. So no
    pair meets twice and no box is compared with all others. Boxes without extent meet
    nothing. The column names of both tables are distinct but for the keys."""
    a, b = place_boxes(a, b, left, right, within)
    met = a.join(b, [*keys, "_pair", "_x", "_y", "_z"])
    if within:
        met = met.where(is_within(F.col(left), F.col(right)))
    else:
        for c, size in zip("xyz", "whd"):
            first = F.greatest(F.col(left)[c], F.col(right)[c])
            met = met.where((first < F.least(F.col(left)[c] + F.col(left)[size], F.col(right)[c] + F.col(right)[size])) & (F.expr(f"shiftright(greatest({left}.{c}, {right}.{c}), _s{c})") == F.col(f"_{c}")))
    return met.drop("_pair", "_x", "_y", "_z", "_sx", "_sy", "_sz")


def stitch(pieces: DataFrame, value: str, order: str = "chunk_id") -> DataFrame:
    """Overlapping pieces, the one with the greatest order over the others."""
    return pieces.groupBy(*KEYS).agg(F.max_by(value, order).alias(value))


def add_ranges(ranges: DataFrame) -> DataFrame:
    """(ordinal, lo, hi, value) rows: the values of equal ranges in one row, which
    stands where the first of them stood."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda s: s["value"])
    return ranges.groupBy("lo", "hi").agg(F.min("ordinal").alias("ordinal"), values.alias("values"))


def holds(label: Column, lo: Column, hi: Column) -> Column:
    """lo <= label < hi; one point where both are equal; no end where hi is null."""
    return (lo <= label) & (hi.isNull() | (label < hi) | ((lo == hi) & (label == lo)))


#: Labels and bounds are moved up by OFFSET, so that spans count from 0; labels beyond it on
#: either side, and bounds, are taken for it.
LEVELS, OFFSET = 62, 1 << 61


def _moved(place: Column) -> Column:
    return F.least(F.greatest(place.cast("long"), F.lit(-OFFSET)), F.lit(OFFSET - 1)) + F.lit(OFFSET)


def _spans(lo: Column, hi: Column) -> Column:
    """[lo, hi) as spans of numbers that share all but their last `level` bits, at most
    two of a level: an array of (level, prefix)."""
    end = F.when(hi.isNull(), F.lit(1 << LEVELS)).when(hi == lo, _moved(lo) + 1).otherwise(_moved(hi))
    span = lambda level, prefix: F.array(F.struct(level.cast("int").alias("level"), prefix.cast("long").alias("prefix")))
    none = F.array().cast("array<struct<level:int,prefix:bigint>>")

    def climb(s: Column, level: Column) -> Column:
        some, odd = s["a"] < s["b"], lambda x: x % 2 == 1
        left, right = some & odd(s["a"]), some & odd(s["b"])
        out = F.concat(s["out"], F.when(left, span(level, s["a"])).otherwise(none), F.when(right & (s["b"] - 1 >= s["a"] + left.cast("long")), span(level, s["b"] - 1)).otherwise(none))
        return F.struct(F.shiftright(s["a"] + left.cast("long"), 1).alias("a"), F.shiftright(s["b"] - right.cast("long"), 1).alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), F.struct(_moved(lo).alias("a"), end.cast("long").alias("b"), none.alias("out")), climb, lambda s: s["out"])


def look_up(labels: DataFrame, ranges: DataFrame, most_ranges: int = 10_000) -> DataFrame:
    """labels with the values of the first range that holds each label, or null.
    Distinct labels are matched first, so the join is as small as they are. Ranges are
    a configuration table: within most_ranges they are broadcast. More are cut to spans
    by bits, and labels meet those by equality, level by level; none is compared with
    each range."""
    few = ranges.limit(most_ranges + 1).count() <= most_ranges
    distinct = labels.select("label").distinct()
    if few:
        found = distinct.join(F.broadcast(ranges), holds(F.col("label"), F.col("lo"), F.col("hi")))
    else:
        cut = ranges.select("ordinal", "values", F.explode(_spans(F.col("lo"), F.col("hi"))).alias("s")).select("ordinal", "values", "s.*")
        levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
        reach = distinct.select("label", _moved(F.col("label")).alias("_at"), levels.alias("level")).withColumn("prefix", F.expr("shiftright(_at, level)")).drop("_at")
        found = reach.join(cut, ["level", "prefix"])
    return labels.join(found.groupBy("label").agg(F.min_by("values", "ordinal").alias("values")), "label", "left")


def mask_groups(labels: DataFrame, ranges: DataFrame) -> DataFrame:
    """A mask (image_id, x, y, z, values, weight 1) for each list of values."""
    return look_up(labels, ranges).where(F.col("values").isNotNull()).select(*KEYS, "values", F.lit(1.0).alias("weight"))


def accumulate(parts: DataFrame, value: str = "v", weight: str = "weight") -> DataFrame:
    return parts.groupBy(*KEYS).agg(F.sum(F.col(value) * F.col(weight)).alias(value))


def blend(parts: DataFrame, value: str = "v", weight: str = "weight") -> DataFrame:
    """The weighted mean, with 1e-6 more in the weights' sum."""
    return parts.groupBy(*KEYS).agg((F.sum(F.col(weight) * F.col(value)) / (F.sum(weight) + 1e-6)).alias(value))


def feathered(masks: Volume, radius: int, background: str | None = None, size: Shape = (64, 64, 64)) -> DataFrame:
    """Weights 1 - min(distance to the mask, radius) / radius of masks by (image_id, group),
    from exact distances whose cost doesn't grow with the radius; rows where weights are
    above 0. background: a group that gets, everywhere, what the others' sum leaves of 1."""
    rows = masks.voxels.where("weight > 0").select("group", *KEYS, "weight")
    far = ch.squared_distances(ch.from_voxels(Volume(rows, masks.shape), "weight", size, ("image_id", "group")))
    near = ch.map_chunks(far, lambda cube, _: 1 - np.minimum(np.sqrt(cube), radius) / radius)
    found = ch.to_voxels(near, "weight").voxels.where("weight > 0").select(*KEYS, "group", "weight")
    if background is None:
        return found
    others = found.unionByName(masks.voxels.select(*KEYS).distinct().select(*KEYS, F.lit(None).cast("string").alias("group"), F.lit(0.0).alias("weight")))
    rest = others.groupBy(*KEYS).agg((1 - F.sum("weight")).alias("weight")).select(*KEYS, F.lit(background).alias("group"), "weight")
    return found.unionByName(rest)


def mask_chunks(labels: ch.Chunks, ranges: DataFrame) -> ch.Chunks:
    """Masks by (image_id, group) of label chunks, group being the values of the first range
    that holds a label, joined by commas. Each chunk's distinct labels meet the ranges."""
    kind, own_keys, keys = np.dtype(labels.kind), list(labels.keys), [*labels.keys, *ch.PLACE]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("data")):
                own = np.unique(np.frombuffer(data.as_buffer(), kind).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([batch.column(k).slice(i, 1)] * len(own)) for k in keys), pa.array(own)], names=[*keys, "label"])

    def mask(left: pa.Table, right: pa.Table) -> pa.Table:
        cube = np.frombuffer(left["data"][0].as_buffer(), kind).astype(np.int64)
        groups: dict[str, list[int]] = {}
        for label, group in zip(right["label"].to_pylist(), right["group"].to_pylist()):
            groups.setdefault(group, []).append(label)
        row = left.slice(0, 1)
        columns = {k: pa.concat_arrays(row[k].chunks * len(groups)) if groups else row[k].slice(0, 0) for k in keys}
        data = [np.isin(cube, own).astype(np.float64).tobytes() for own in groups.values()]
        return pa.table({**columns, "group": pa.array(list(groups), pa.string()), "data": pa.array(data, pa.binary())}).select([*own_keys, "group", *ch.PLACE, "data"])

    kinds = labels.schema().removesuffix(", data binary")
    sets = labels.rows.select(*keys, "data").mapInArrow(distinct, f"{kinds}, label long")
    known = look_up(sets, ranges).where(F.col("values").isNotNull()).select(*keys, "label", F.array_join("values", ",").alias("group"))
    named = kinds.split(", cx int")[0]
    rows = labels.rows.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(mask, f"{named}, group string, cx int, cy int, cz int, data binary")
    return ch.Chunks(rows, labels.shape, labels.size, ch.REAL, (*labels.keys, "group"))


def last_psf(psfs: DataFrame, groups: DataFrame) -> DataFrame:
    """The PSF that a group ends up with: the last of its ids that exists."""
    named = groups.select("group_id", F.posexplode("values").alias("at", "psf_id"))
    return named.join(psfs, "psf_id").withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("at")))).where("r = 1").drop("r", "at")
