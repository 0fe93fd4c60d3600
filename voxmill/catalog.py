"""All registered queries of the volume engine, each beside its SQL.

Images are derived from lineitem: one for every 2,048 order keys, 16 x 16 x 4 voxels,
a the summed quantity and b the number of lines. So the number of images grows with
the table, and every operator works on all of them. Small images (8 x 8 x 4) serve
the queries whose SQL writes a Fourier transform out as sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill import chunks, engine
from voxmill.functions import text
from voxmill.operators import arithmetic as ar
from voxmill.operators import deconvolution as dec
from voxmill.operators import geometry as geo
from voxmill.operators import reductions as red
from voxmill.operators import regions as reg
from voxmill.operators import stencils as st
from voxmill.plans import psf, tiles
from voxmill.sources import shared, tiff, tiff_sink, tiff_source
from voxmill.volume import KEYS, Volume, voxelize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHAPE, SMALL, ORDERS = (16, 16, 4), (8, 8, 4), 2048
#: Chunks of transforms: several along each axis.
PENCIL = (4, 3, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(spark: SparkSession, sf_dir: str, shape=SHAPE) -> Volume:
    w, h, d = shape
    c = F.col
    place = (F.pmod(c("l_partkey"), F.lit(w)), F.pmod(c("l_suppkey"), F.lit(h)), F.pmod(c("l_linenumber"), F.lit(d)))
    return voxelize(table(spark, sf_dir, "lineitem"), F.expr(f"l_orderkey div {ORDERS}"), place, shape, a=c("l_quantity"), b=F.lit(1))


def _vol(shape=SHAPE, name="vol") -> str:
    w, h, d = shape
    return f"""{name}_s AS (SELECT l_orderkey // {ORDERS} AS image_id, l_partkey % {w} AS x, l_suppkey % {h} AS y, l_linenumber % {d} AS z, sum(l_quantity) AS a, CAST(count(*) AS DOUBLE) AS b FROM lineitem GROUP BY ALL),
{name} AS (SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT DISTINCT image_id FROM {name}_s) CROSS JOIN range({w}) AS _x(x) CROSS JOIN range({h}) AS _y(y) CROSS JOIN range({d}) AS _z(z) LEFT JOIN {name}_s USING (image_id, x, y, z))"""


VOL = "WITH " + _vol()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(v: Volume | DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Both engines round, and make -0.0 to 0.0."""
    rows = v.voxels if isinstance(v, Volume) else v
    return rows.select(*(c for c in rows.columns if c not in names), *((F.round(n, digits) + 0.0).alias(n) for n in names))


# sources, projections and filters


@query(VOL + " SELECT * FROM vol")
def voxelize_v1(spark, sf):
    return volume(spark, sf).voxels


@query("WITH e AS (SELECT CAST(vec_id // 256 AS BIGINT) AS image_id, CAST(vec_id % 8 AS INTEGER) AS z, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) SELECT image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, z, round(sum(CAST(v AS DOUBLE)), 4) + 0.0 AS v FROM e GROUP BY ALL")
def voxelize_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return _rounded(voxelize(e, F.expr("vec_id div 256"), (F.col("i") % 8, F.expr("i div 8"), F.col("vec_id") % 8), (8, 8, 8), v=F.col("v")), "v", digits=4)


@query(VOL + " SELECT image_id, x, y, z, CASE WHEN a BETWEEN 50 AND 200 THEN 1.0 ELSE 0.0 END::DOUBLE AS mask FROM vol")
def in_range_mask(spark, sf):
    return volume(spark, sf).map(mask=ar.in_range(F.col("a"), 50, 200)).voxels


@query(VOL + " SELECT image_id, x - 3 AS x, y - 2 AS y, z - 1 AS z, a, b FROM vol WHERE x BETWEEN 3 AND 9 AND y BETWEEN 2 AND 9 AND z BETWEEN 1 AND 2")
def crop_box(spark, sf):
    return geo.crop(volume(spark, sf), (3, 2, 1), (7, 8, 2)).voxels


@query(VOL + " SELECT * FROM vol WHERE x = 5 AND y = 6 AND z = 2")
def get_pixel(spark, sf):
    return geo.at(volume(spark, sf), 5, 6, 2)


@query(VOL + " SELECT image_id, x, y, z, CASE WHEN x = y AND z = 1 THEN -1.0 ELSE a END AS a, b FROM vol")
def set_pixels(spark, sf):
    v = volume(spark, sf)
    edits = v.voxels.where("x = y AND z = 1").select(*KEYS, F.lit(-1.0).alias("a"))
    return geo.put(v, edits, "a").voxels


@query(VOL + " SELECT image_id, x, y, z, greatest(a * 2 + x, 10) - b AS a, b FROM vol")
def fused_operations(spark, sf):
    double = lambda c: c | {"a": c["a"] * 2 + F.col("x")}
    floor = lambda c: c | {"a": F.greatest(c["a"], F.lit(10.0))}
    less = lambda c: c | {"a": c["a"] - c["b"]}
    return volume(spark, sf).then(double, floor, less).voxels


@query(VOL + " SELECT image_id, x, y, z, CAST((z * 16 + y) * 16 + x AS BIGINT) AS place, a FROM vol")
def linear_index(spark, sf):
    v = volume(spark, sf)
    return v.voxels.select(*KEYS, geo.linear_index(v).alias("place"), "a")


@query(VOL + " SELECT v.image_id, v.x, v.y, v.z, v.a, coalesce(n.a, 0) AS near FROM vol v LEFT JOIN vol n ON n.image_id = v.image_id AND n.x = v.x + 1 AND n.y = v.y - 1 AND n.z = v.z + 1")
def neighbour_voxel(spark, sf):
    return geo.neighbour(volume(spark, sf), "a", 1, -1, 1).voxels


# halos and shifts

_BEFORE, _AFTER = (3, 2, 5), (4, 0, 1)


def _padded(source: str, value: str) -> str:
    """source: SQL for the source place of padded place {o} on an axis of {n}."""
    axis = lambda c, n, a, b: f"(SELECT CAST(o AS INTEGER) AS {c}, {source.format(o=f'(o - {a})', n=n)} AS s{c}, CASE WHEN o < {a} THEN ({a} - o) / CAST({max(a, 1)} AS DOUBLE) WHEN o >= {a + n} THEN (o - {a + n - 1}) / CAST({max(b, 1)} AS DOUBLE) ELSE 0 END AS t{c} FROM range({n + a + b}) AS r(o))"
    w, h, d = (axis(c, n, a, b) for c, n, a, b in zip("xyz", SHAPE, _BEFORE, _AFTER))
    return f"{VOL}, p AS (SELECT v.image_id, px.x, py.y, pz.z, greatest(tx, ty, tz) AS t, v.a FROM vol v JOIN {w} px ON px.sx = v.x JOIN {h} py ON py.sy = v.y JOIN {d} pz ON pz.sz = v.z) SELECT image_id, x, y, z, round({value}, 6) + 0.0 AS a FROM p"


def _padding(fill: str, source: str, value: str) -> None:
    def pad(spark, sf):
        v = volume(spark, sf).map(a=F.col("a"))
        return _rounded(geo.pad(v, _BEFORE, _AFTER, fill), "a")

    QUERIES[f"pad_{fill}"], ORACLES[f"pad_{fill}"] = pad, _padded(source, value)


_CLAMP = "least(greatest({o}, 0), {n} - 1)"
_padding("mirror", "least((({o}) % (2 * {n}) + 2 * {n}) % (2 * {n}), 2 * {n} - 1 - (({o}) % (2 * {n}) + 2 * {n}) % (2 * {n}))", "a")
_padding("zero", _CLAMP, "CASE WHEN t > 0 THEN 0 ELSE a END")
_padding("linear", _CLAMP, "a * (1 - t)")
_padding("quadratic", _CLAMP, "a * (1 - t) * (1 - t)")
_padding("sinusoid", _CLAMP, "a * cos(pi() / 2 * t) * cos(pi() / 2 * t)")
_padding("gaussian", _CLAMP, "a * exp(-t * t)")


@query(VOL + " SELECT i.image_id, CAST(gx.x AS INTEGER) AS x, CAST(gy.y AS INTEGER) AS y, CAST(gz.z AS INTEGER) AS z, coalesce(v.a, 0) AS a FROM (SELECT DISTINCT image_id FROM vol) i CROSS JOIN range(21) gx(x) CROSS JOIN range(16) gy(y) CROSS JOIN range(7) gz(z) LEFT JOIN vol v ON v.image_id = i.image_id AND v.x = gx.x - 2 AND v.y = gy.y AND v.z = gz.z - 1")
def pad_to_shape(spark, sf):
    return geo.pad_to_shape(volume(spark, sf).map(a=F.col("a")), (21, 16, 7)).voxels


@query(VOL + " SELECT v.image_id, CAST(gx.x AS INTEGER) AS x, y, CAST(gz.z AS INTEGER) AS z, a FROM vol v JOIN range(20) gx(x) ON v.x = CASE WHEN gx.x < 16 THEN gx.x ELSE 31 - gx.x END JOIN range(6) gz(z) ON v.z = CASE WHEN gz.z < 4 THEN gz.z ELSE 7 - gz.z END")
def expand_to_min_size(spark, sf):
    return geo.expand_to_min_size(volume(spark, sf).map(a=F.col("a")), (20, 10, 6)).voxels


@query(VOL + " SELECT image_id, x - 2 AS x, y - 1 AS y, z - 1 AS z, a, b FROM vol WHERE x BETWEEN 2 AND 12 AND y BETWEEN 1 AND 15 AND z BETWEEN 1 AND 3")
def remove_padding(spark, sf):
    return geo.remove_padding(volume(spark, sf), (2, 1, 1), (3, 0, 0)).voxels


@query(VOL + " SELECT image_id, x - 3 AS x, y - 4 AS y, z - 1 AS z, a, b FROM vol WHERE x BETWEEN 3 AND 11 AND y BETWEEN 4 AND 11 AND z BETWEEN 1 AND 2")
def crop_to_original(spark, sf):
    return geo.crop_to_original(volume(spark, sf), (9, 8, 2)).voxels


@query(VOL + " SELECT image_id, CAST((x + 8) % 16 AS INTEGER) AS x, CAST((y + 8) % 16 AS INTEGER) AS y, CAST((z + 2) % 4 AS INTEGER) AS z, a, b FROM vol")
def octant_shift(spark, sf):
    return geo.octant_shift(volume(spark, sf)).voxels


@query(VOL + " SELECT image_id, CAST((x + 8) % 16 AS INTEGER) AS x, CAST((y + 8) % 16 AS INTEGER) AS y, CAST((z + 2) % 4 AS INTEGER) AS z, a, b FROM vol")
def inverse_quadrant_shift(spark, sf):
    return geo.inverse_quadrant_shift(volume(spark, sf)).voxels


@query(VOL + " SELECT image_id, 15 - x AS x, y, z, a, b FROM vol")
def flip_x(spark, sf):
    return geo.flip(volume(spark, sf), "x").voxels


# elementwise arithmetic: (a, b) and its shift by one along x are two complex volumes

_PAIR = VOL + ", pair AS (SELECT v.image_id, v.x, v.y, v.z, v.a AS ar, v.b AS ai, s.a / 16 - 4 AS br, s.b - 3 AS bi FROM vol v JOIN vol s ON s.image_id = v.image_id AND s.x = (v.x + 1) % 16 AND s.y = v.y AND s.z = v.z)"


def _first() -> ar.Complex:
    return F.col("ar"), F.col("ai")


def _second() -> ar.Complex:
    return F.col("br"), F.col("bi")


def _pair(spark, sf) -> Volume:
    v = volume(spark, sf)
    other = geo.roll(v, (-1, 0, 0)).map(br=F.col("a") / 16 - 4, bi=F.col("b") - 3)
    return ar.combine(v.map(ar=F.col("a"), ai=F.col("b")), other)


def _complex(name: str, expression, re: str, im: str) -> None:
    def run(spark, sf):
        out = expression()
        return _rounded(_pair(spark, sf).map(re=out[0], im=out[1]), "re", "im")

    QUERIES[name], ORACLES[name] = run, f"{_PAIR} SELECT image_id, x, y, z, round({re}, 6) + 0.0 AS re, round({im}, 6) + 0.0 AS im FROM pair"


def _real(name: str, expression, sql: str) -> None:
    def run(spark, sf):
        return _rounded(_pair(spark, sf).map(v=expression()), "v")

    QUERIES[name], ORACLES[name] = run, f"{_PAIR} SELECT image_id, x, y, z, round({sql}, 6) + 0.0 AS v FROM pair"


_TOP = ("(ar * br + ai * bi)", "(ai * br - ar * bi)")
_NORM = "(br * br + bi * bi)"
_real("real_mul", lambda: _first()[0] * _second()[0], "ar * br")
_real("real_div_eps", lambda: ar.divide(_first()[0], _second()[0], 1e-3), "ar / CASE WHEN br < 1e-3 THEN 1e-3 ELSE br END")
_real("scalar_mul", lambda: _first()[0] * 2.5, "ar * 2.5")
_real("complex_magnitude", lambda: ar.magnitude(_second()), f"sqrt{_NORM}")
_complex("complex_scale", lambda: ar.scale(_first(), 0.5), "ar * 0.5", "ai * 0.5")
_complex("complex_add", lambda: ar.add(_first(), _second()), "ar + br", "ai + bi")
_complex("complex_mul", lambda: ar.multiply(_first(), _second()), "ar * br - ai * bi", "ar * bi + ai * br")
_complex("complex_mul_conj", lambda: ar.multiply_conjugate(_first(), _second()), *_TOP)
_complex("complex_div", lambda: ar.divide_complex(_first(), _second(), 2.0), *(f"CASE WHEN {_NORM} < 2 THEN 0 ELSE {t} / {_NORM} END" for t in _TOP))
_complex("complex_div_stab", lambda: ar.divide_stabilized(_first(), _second(), 2.0), *(f"{t} / greatest(2, {_NORM})" for t in _TOP))


@query(VOL + " SELECT image_id, x, y, z, round(a * -2 * (cos(2 * pi() * x / 16) + cos(2 * pi() * y / 16) + cos(2 * pi() * z / 4) - 3), 6) + 0.0 AS a FROM vol")
def laplacian_symbol(spark, sf):
    v = volume(spark, sf)
    return _rounded(v.map(a=F.col("a") * ar.laplacian_symbol(v)), "a")


@query(VOL + " SELECT image_id, x, y, z, a / 1024 AS a FROM vol")
def normalize_data(spark, sf):
    v = volume(spark, sf)
    w, h, d = v.shape
    return v.map(a=F.col("a") / (w * h * d)).voxels


# stencils

_G = ", g AS (SELECT image_id, x, y, z, coalesce(a - lead(a) OVER (PARTITION BY image_id, y, z ORDER BY x), 0) AS gx, coalesce(a - lead(a) OVER (PARTITION BY image_id, x, z ORDER BY y), 0) AS gy, coalesce(a - lead(a) OVER (PARTITION BY image_id, x, y ORDER BY z), 0) AS gz FROM vol)"
_N = _G + ", n AS (SELECT image_id, x, y, z, gx / sqrt(gx * gx + gy * gy + gz * gz + 0.1) AS gx, gy / sqrt(gx * gx + gy * gy + gz * gz + 0.1) AS gy, gz / sqrt(gx * gx + gy * gy + gz * gz + 0.1) AS gz FROM g)"
_DIV = "(gx - coalesce(lag(gx) OVER (PARTITION BY image_id, y, z ORDER BY x), 0) + gy - coalesce(lag(gy) OVER (PARTITION BY image_id, x, z ORDER BY y), 0) + gz - coalesce(lag(gz) OVER (PARTITION BY image_id, x, y ORDER BY z), 0))"


@query(VOL + _G + " SELECT * FROM g")
def gradient_xyz(spark, sf):
    return st.gradient(volume(spark, sf), "a").voxels


@query(VOL + " SELECT image_id, x, y, z, coalesce(a - lead(a) OVER w, 0) AS re, coalesce(b - lead(b) OVER w, 0) AS im FROM vol WINDOW w AS (PARTITION BY image_id, y, z ORDER BY x)")
def complex_gradient_x(spark, sf):
    return volume(spark, sf).map(re=st.ahead("x", "a"), im=st.ahead("x", "b")).voxels


_GC = ", gc AS (SELECT image_id, x, y, z, " + ", ".join(f"coalesce({v} - lead({v}) OVER (PARTITION BY image_id, {other} ORDER BY {c}), 0) AS g{c}{p}" for c, other in (("x", "y, z"), ("y", "x, z"), ("z", "x, y")) for v, p in (("a", "_re"), ("b", "_im"))) + " FROM vol)"
_DIVC = lambda p: " + ".join(f"g{c}{p} - coalesce(lag(g{c}{p}) OVER (PARTITION BY image_id, {other} ORDER BY {c}), 0)" for c, other in (("x", "y, z"), ("y", "x, z"), ("z", "x, y")))


@query(VOL + _GC + " SELECT * FROM gc")
def complex_gradient(spark, sf):
    return st.gradient(volume(spark, sf), ("a", "b")).voxels


@query(VOL + _GC + f" SELECT image_id, x, y, z, {_DIVC('_re')} AS div_re, {_DIVC('_im')} AS div_im FROM gc")
def complex_divergence(spark, sf):
    return st.complex_divergence(st.gradient(volume(spark, sf), ("a", "b"))).voxels


@query(VOL + _GC + ", m AS (SELECT image_id, x, y, z, " + ", ".join(f"g{c}{p} / sqrt(0.1 + " + " + ".join(f"g{d}{q} * g{d}{q}" for d in "xyz" for q in ("_re", "_im")) + f") AS g{c}{p}" for c in "xyz" for p in ("_re", "_im"))
       + f" FROM gc) SELECT image_id, x, y, z, round({_DIVC('_re')}, 6) + 0.0 AS div_re, round({_DIVC('_im')}, 6) + 0.0 AS div_im FROM m")
def complex_tv(spark, sf):
    return _rounded(st.complex_divergence(st.complex_normalize_tv(st.gradient(volume(spark, sf), ("a", "b")), 0.1)), "div_re", "div_im")


@query(VOL + _G + f" SELECT image_id, x, y, z, {_DIV} AS div FROM g")
def divergence(spark, sf):
    return st.divergence(st.gradient(volume(spark, sf), "a")).voxels


@query(VOL + _N + " SELECT image_id, x, y, z, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy, round(gz, 6) + 0.0 AS gz FROM n")
def normalize_tv(spark, sf):
    return _rounded(st.normalize_tv(st.gradient(volume(spark, sf), "a"), 0.1), "gx", "gy", "gz")


@query(VOL + _N + f" SELECT image_id, x, y, z, round(1 / greatest(1 - 0.2 * {_DIV}, 1e-8), 6) + 0.0 AS tv FROM n")
def compute_tv(spark, sf):
    div = st.divergence(st.normalize_tv(st.gradient(volume(spark, sf), "a"), 0.1))
    return _rounded(div.map(tv=st.tv_factor(F.col("div"), 0.2)), "tv")


@query(VOL + _N + f" SELECT image_id, x, y, z, round({_DIV}, 6) + 0.0 AS div FROM n")
def tv_test_algorithm(spark, sf):
    return _rounded(st.total_variation(volume(spark, sf), "a", 1.0), "div")


# reductions


@query(VOL + " SELECT image_id, sum(a) AS re, sum(b) AS im FROM vol GROUP BY image_id")
def sum_reduce(spark, sf):
    return red.total(volume(spark, sf), re=F.col("a"), im=F.col("b"))


@query(_PAIR + " SELECT image_id, round(avg((ar - br) * (ar - br) + (ai - bi) * (ai - bi)), 4) AS mse FROM pair GROUP BY image_id")
def mean_square_error(spark, sf):
    return _rounded(red.mean_square_error(_pair(spark, sf), _first(), _second()), "mse", digits=4)


@query(_PAIR + " SELECT image_id, x, y, z, 2 * ar + br AS re, 2 * ai + bi AS im FROM pair")
def nary_add(spark, sf):
    p = _pair(spark, sf)
    first = p.map(re=_first()[0], im=_first()[1])
    return red.add_all([first, first, p.map(re=_second()[0], im=_second()[1])]).voxels


_MASKS = VOL + ", m AS (SELECT image_id, x, y, z, g, CASE g WHEN 0 THEN a WHEN 1 THEN b ELSE CAST(x % 3 AS DOUBLE) END AS weight FROM vol, range(3) r(g))"


def _masks(v: Volume) -> DataFrame:
    g = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("g")
    return v.voxels.select("*", g).select(*KEYS, F.col("g").cast("long").alias("g"), F.when(F.col("g") == 0, F.col("a")).when(F.col("g") == 1, F.col("b")).otherwise((F.col("x") % 3).cast("double")).alias("weight"))


@query(_MASKS + " SELECT image_id, x, y, z, g, round(CASE WHEN sum(weight) OVER w = 0 THEN 0 ELSE weight / sum(weight) OVER w END, 6) AS weight FROM m WINDOW w AS (PARTITION BY image_id, x, y, z)")
def sum_to_one(spark, sf):
    return _rounded(red.sum_to_one(_masks(volume(spark, sf))), "weight")


@query(VOL + " SELECT image_id, greatest(max(a), 0) AS max FROM vol GROUP BY image_id")
def volume_max(spark, sf):
    return red.maximum(volume(spark, sf), "a")


@query(VOL + " SELECT image_id, coalesce(max(x) FILTER (a > 290) - min(x) FILTER (a > 290) + 1, 0) AS width, coalesce(max(y) FILTER (a > 290) - min(y) FILTER (a > 290) + 1, 0) AS height, coalesce(max(z) FILTER (a > 290) - min(z) FILTER (a > 290) + 1, 0) AS depth FROM vol GROUP BY image_id")
def bbox_over_threshold(spark, sf):
    return red.region_above(volume(spark, sf), "a", 290)


@query(VOL + ", c AS (SELECT *, greatest(a - 20, 0) AS v FROM vol), e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM c GROUP BY image_id) SELECT image_id, x, y, z, round(CASE WHEN hi = lo OR (v - lo) / (hi - lo) < 1e-6 THEN 0 ELSE (v - lo) / (hi - lo) END, 6) AS v FROM c JOIN e USING (image_id)")
def normalize_channel(spark, sf):
    return _rounded(red.normalize_channel(volume(spark, sf).map(v=F.col("a") - 20), "v"), "v")


@query(VOL + " SELECT image_id, bool_and(NOT (x = y AND image_id % 2 = 0)) AS equal, count(*) FILTER (x = y AND image_id % 2 = 0) AS n_different FROM vol GROUP BY image_id")
def volumes_equal(spark, sf):
    v = volume(spark, sf).map(a=F.col("a"))
    other = v.map(a=F.col("a") + F.when((F.col("x") == F.col("y")) & (F.col("image_id") % 2 == 0), 1.0).otherwise(1e-9))
    return red.equal(v, other, "a", 1e-6)


@query(VOL + " SELECT image_id, count(*) FILTER (b = 0 AND a = 0) AS n_nan, count(*) FILTER (b = 0 AND a <> 0 OR b = 1) AS n_inf, min(a) FILTER (b > 1) AS least, max(a) FILTER (b > 1) AS greatest FROM vol GROUP BY image_id")
def nan_inf_stats(spark, sf):
    bad = F.when(F.col("b") == 0, F.lit(float("nan"))).when(F.col("b") == 1, F.lit(float("inf"))).otherwise(F.col("a"))
    return red.finite_statistics(volume(spark, sf).map(a=bad), "a")


def _shapes(spark, sf) -> DataFrame:
    """A shape for each supplier, from what its lines span."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg((F.max(F.col("l_partkey") % 300) + 20).cast("int").alias("width"), (F.count("*") % 200 + 30).cast("int").alias("height"), (F.max("l_linenumber") * 9).cast("int").alias("depth"))


_SHAPES = "WITH s AS (SELECT l_suppkey AS image_id, CAST(max(l_partkey % 300) + 20 AS INTEGER) AS width, CAST(count(*) % 200 + 30 AS INTEGER) AS height, CAST(max(l_linenumber) * 9 AS INTEGER) AS depth FROM lineitem GROUP BY l_suppkey)"


@query(_SHAPES + " SELECT max(width) AS width, max(height) AS height, max(depth) AS depth FROM s")
def largest_shape(spark, sf):
    return red.largest_shape(_shapes(spark, sf))


@query(_SHAPES + " SELECT *, CAST(ceil(width / 64.0) * ceil(height / 50.0) * ceil(depth / 32.0) AS BIGINT) AS n_cubes, CAST(width AS BIGINT) * height * depth AS volume FROM s")
def subcubes(spark, sf):
    return red.subcubes(_shapes(spark, sf), (64, 50, 32))


# ranges, labels, boxes

_RANGES = "0:2[a],2:[b, c],1:3[d],2:[e]"
_LABELS = VOL + ", l AS (SELECT *, CAST(x // 8 + 2 * (y // 8) + CASE WHEN b > 6 THEN 1 ELSE 0 END AS BIGINT) - 1 AS label FROM vol)"


def _ranges(spark) -> DataFrame:
    parsed = spark.range(1).select(F.posexplode(text.parse_ranges(F.lit(_RANGES))).alias("ordinal", "r"))
    return reg.add_ranges(parsed.select("ordinal", "r.lo", "r.hi", F.explode("r.values").alias("value")))


def _labels(v: Volume) -> DataFrame:
    bump = F.when(F.col("b") > 6, 1).otherwise(0)
    return v.voxels.select(*KEYS, "a", (F.expr("x div 8 + 2 * (y div 8)") + bump - 1).cast("long").alias("label"))


@query(_LABELS + " SELECT image_id, x, y, z, label, CASE WHEN label < 0 THEN NULL WHEN label < 2 THEN 'a' ELSE 'b,c,e' END AS ids FROM l")
def range_join_labels(spark, sf):
    found = reg.look_up(_labels(volume(spark, sf)), _ranges(spark))
    return found.select(*KEYS, "label", F.array_join("values", ",").alias("ids"))


@query("WITH r AS (SELECT o_orderkey AS ordinal, o_custkey * 3 - 2500 AS lo, CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE o_custkey * 3 - 2500 + o_orderkey % 7 END AS hi FROM orders WHERE o_orderkey % 997 <> 0 OR o_custkey % 50 = 0), "
       "l AS (SELECT DISTINCT l_partkey * 2 - l_suppkey * 40 AS label FROM lineitem) SELECT label, (SELECT min(ordinal) FROM r WHERE label >= lo AND (hi IS NULL OR label < hi OR (lo = hi AND label = lo))) AS first FROM l")  # fmt: skip
def range_join_many(spark, sf):
    """Ranges of a table, also negative and open ones: more than are broadcast."""
    c = F.col
    orders = table(spark, sf, "orders").where("o_orderkey % 997 <> 0 or o_custkey % 50 = 0")
    lo = c("o_custkey") * 3 - 2500
    ranges = orders.select(c("o_orderkey").alias("ordinal"), lo.alias("lo"), F.when(c("o_orderkey") % 997 != 0, lo + c("o_orderkey") % 7).alias("hi"), F.array("o_orderkey").alias("values"))
    labels = table(spark, sf, "lineitem").select((c("l_partkey") * 2 - c("l_suppkey") * 40).alias("label")).distinct()
    return reg.look_up(labels, ranges).select("label", F.get("values", F.lit(0)).alias("first"))


@query(_LABELS + " SELECT image_id, CASE WHEN label < 2 THEN 'a' ELSE 'b,c,e' END AS ids, count(*) AS n_voxels FROM l WHERE label >= 0 GROUP BY ALL")
def mask_groups(spark, sf):
    return reg.mask_groups(_labels(volume(spark, sf)), _ranges(spark)).groupBy("image_id", F.array_join("values", ",").alias("ids")).agg(F.count("*").alias("n_voxels"))


@query("WITH g AS (SELECT l_suppkey AS group_id, l_returnflag AS psf_id, max(l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL) SELECT group_id, arg_max(psf_id, n * 10 + CASE psf_id WHEN 'N' THEN 1 ELSE 0 END) AS psf_id FROM g GROUP BY group_id")
def last_psf(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("group_id"), F.col("l_returnflag").alias("psf_id")).agg(F.max("l_linenumber").alias("n"))
    groups = lines.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("n", "psf_id"))).alias("v")).select("group_id", F.col("v.psf_id").alias("values"))
    psfs = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_returnflag").alias("psf_id")).distinct()
    return reg.last_psf(psfs, groups)


@query(_MASKS + " SELECT image_id, x, y, z, round(sum((x + y * g) * weight), 6) + 0.0 AS v FROM m GROUP BY ALL")
def weighted_accumulate(spark, sf):
    parts = _masks(volume(spark, sf)).withColumn("v", (F.col("x") + F.col("y") * F.col("g")).cast("double"))
    return _rounded(reg.accumulate(parts), "v")


@query(_MASKS + " SELECT image_id, x, y, z, round(sum((x + y * g) * weight) / (sum(weight) + 1e-6), 5) + 0.0 AS v FROM m GROUP BY ALL")
def weighted_blend(spark, sf):
    parts = _masks(volume(spark, sf)).withColumn("v", (F.col("x") + F.col("y") * F.col("g")).cast("double"))
    return _rounded(reg.blend(parts), "v", digits=5)


@query(VOL + ", m AS (SELECT image_id, x, y, z FROM vol WHERE a > 250) SELECT v.image_id, v.x, v.y, v.z, round(1 - min(sqrt((v.x - m.x) ** 2 + (v.y - m.y) ** 2 + (v.z - m.z) ** 2)) / 3, 6) + 0.0 AS weight FROM vol v JOIN m ON m.image_id = v.image_id AND (v.x - m.x) ** 2 + (v.y - m.y) ** 2 + (v.z - m.z) ** 2 < 9 GROUP BY ALL")
def feathered_mask(spark, sf):
    v = volume(spark, sf)
    masks = v.with_(v.voxels.select(*KEYS, F.lit("m").alias("group"), ar.in_range(F.col("a"), 250.5, 1e9).alias("weight")))
    return _rounded(reg.feathered(masks, 3).drop("group"), "weight")


_BOXES = "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS x, l_suppkey % 7 AS y, l_linenumber AS z, 3 + l_partkey % 11 AS w, 2 + l_suppkey % 9 AS h, 4 AS d FROM lineitem)"


def _boxes(spark, sf) -> DataFrame:
    c = F.col
    own = reg.box(c("l_partkey") % 5, c("l_suppkey") % 7, c("l_linenumber"), 3 + c("l_partkey") % 11, 2 + c("l_suppkey") % 9, 4)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", own.alias("own"))


@query(_BOXES + ", c AS (SELECT *, greatest(x, 3) AS cx, greatest(y, 4) AS cy, greatest(z, 3) AS cz, least(x + w, 9) AS ex, least(y + h, 10) AS ey, least(z + d, 8) AS ez FROM b), "
       "p AS (SELECT l_orderkey, l_linenumber, CASE WHEN cx >= ex OR cy >= ey OR cz >= ez THEN [w * h * d] ELSE [(cx - x) * h * d, (x + w - ex) * h * d, (ex - cx) * (cy - y) * d, (ex - cx) * (y + h - ey) * d, (ex - cx) * (ey - cy) * (cz - z), (ex - cx) * (ey - cy) * (z + d - ez)] END AS v FROM c), "
       "q AS (SELECT l_orderkey, l_linenumber, list_filter(v, lambda n: n > 0) AS v FROM p) SELECT l_orderkey, l_linenumber, CAST(len(v) AS BIGINT) AS n_boxes, CAST(coalesce(list_sum(v), 0) AS BIGINT) AS voxels FROM q")  # fmt: skip
def box_subtract(spark, sf):
    parts = _boxes(spark, sf).select("l_orderkey", "l_linenumber", reg.subtract(F.col("own"), reg.box(3, 4, 3, 6, 6, 5)).alias("p"))
    size = F.aggregate("p", F.lit(0).cast("long"), lambda n, b: n + b["w"] * b["h"] * b["d"])
    return parts.select("l_orderkey", "l_linenumber", F.size("p").cast("long").alias("n_boxes"), size.alias("voxels"))


@query(VOL + ", g AS (SELECT image_id, CAST(floor(a / 100) AS INTEGER) % 3 AS g, x, y, z FROM vol WHERE a > 250), w AS (SELECT v.image_id, v.x, v.y, v.z, CAST(g AS VARCHAR) AS grp, 1 - min(sqrt((v.x - g.x) ** 2 + (v.y - g.y) ** 2 + (v.z - g.z) ** 2)) / 40 AS weight FROM vol v JOIN g ON g.image_id = v.image_id GROUP BY ALL) SELECT image_id, x, y, z, grp, round(weight, 6) + 0.0 AS weight FROM w WHERE weight > 0 UNION ALL SELECT v.image_id, v.x, v.y, v.z, 'background', round(1 - coalesce(sum(weight), 0), 6) + 0.0 FROM vol v LEFT JOIN w ON w.image_id = v.image_id AND w.x = v.x AND w.y = v.y AND w.z = v.z GROUP BY ALL")
def feathered_groups(spark, sf):
    """A radius beyond the image's extent, several groups and their background."""
    v = volume(spark, sf)
    masks = v.with_(v.voxels.select(*KEYS, (F.floor(F.col("a") / 100).cast("int") % 3).cast("string").alias("group"), (F.col("a") > 250).cast("double").alias("weight")))
    return _rounded(reg.feathered(masks, 40, "background", (6, 5, 3)).withColumnRenamed("group", "grp"), "weight")


_PLACED = ("WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey % 10 AS image_id, l_partkey % 401 - 200 AS x, l_orderkey % 307 AS y, l_suppkey % 53 AS z, 1 + l_quantity::INT AS w, 1 + l_orderkey % 3 AS h, l_linenumber AS d FROM lineitem), "
           "b AS (SELECT o_orderkey, o_custkey % 10 AS image_id, o_custkey % 397 - 200 AS x, o_orderkey % 311 AS y, o_custkey % 50 AS z, 1 + o_custkey % 60 AS w, 1 + o_orderkey % 4 AS h, 1 + o_orderkey % 30 AS d FROM orders WHERE o_orderkey % 3 = 0) "
           "SELECT l_orderkey, l_linenumber, o_orderkey FROM a JOIN b ON a.image_id = b.image_id AND ")  # fmt: skip


def _placed_boxes(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = F.col
    a = reg.box(c("l_partkey") % 401 - 200, c("l_orderkey") % 307, c("l_suppkey") % 53, 1 + c("l_quantity").cast("int"), 1 + c("l_orderkey") % 3, c("l_linenumber"))
    b = reg.box(c("o_custkey") % 397 - 200, c("o_orderkey") % 311, c("o_custkey") % 50, 1 + c("o_custkey") % 60, 1 + c("o_orderkey") % 4, 1 + c("o_orderkey") % 30)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_suppkey") % 10).alias("image_id"), a.alias("box"))
    return lines, table(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", (c("o_custkey") % 10).alias("image_id"), b.alias("other"))


@query(_PLACED + " AND ".join(f"a.{c} < b.{c} + b.{s} AND b.{c} < a.{c} + a.{s}" for c, s in zip("xyz", "whd")))
def box_join(spark, sf):
    return reg.join_boxes(*_placed_boxes(spark, sf), ["image_id"]).select("l_orderkey", "l_linenumber", "o_orderkey")


@query(_PLACED + " AND ".join(f"a.{c} >= b.{c} AND a.{c} + a.{s} <= b.{c} + b.{s}" for c, s in zip("xyz", "whd")))
def box_join_within(spark, sf):
    return reg.join_boxes(*_placed_boxes(spark, sf), ["image_id"], within=True).select("l_orderkey", "l_linenumber", "o_orderkey")


@query(_BOXES + " SELECT l_orderkey, l_linenumber, CAST(greatest(least(x + w, 9) - greatest(x, 3), 0) AS INTEGER) AS w, CAST(greatest(least(y + h, 10) - greatest(y, 4), 0) AS INTEGER) AS h, CAST(greatest(least(z + d, 8) - greatest(z, 3), 0) AS INTEGER) AS d, x >= 3 AND x + w <= 9 AND y >= 4 AND y + h <= 10 AND z >= 3 AND z + d <= 8 AS inside FROM b")
def box_intersect(spark, sf):
    other = reg.box(3, 4, 3, 6, 6, 5)
    i = reg.intersect(F.col("own"), other)
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", *(i[c].alias(c) for c in "whd"), reg.is_within(F.col("own"), other).alias("inside"))


@query(VOL + ", t AS (SELECT v.*, c.i FROM vol v JOIN (VALUES (0, 0), (1, 6), (2, 8)) c(i, s) ON v.x >= c.s AND v.x < c.s + 8) SELECT image_id, x, y, z, arg_max(a + 1000 * i, i) AS a FROM t GROUP BY ALL")
def stitch_last_wins(spark, sf):
    v = volume(spark, sf)
    pieces = None
    for i, s in enumerate((0, 6, 8)):
        own = v.voxels.where(F.col("x").between(s, s + 7)).select(*KEYS, (F.col("a") + 1000 * i).alias("a"), F.lit(i).alias("chunk_id"))
        pieces = own if pieces is None else pieces.unionByName(own)
    return reg.stitch(pieces, "a")


# scalar functions, on values of the tables


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS lo, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN l_linenumber + 4 ELSE CAST(l_linenumber AS BIGINT) END AS hi, l_returnflag || '|' || l_linestatus AS names, 2 AS n FROM lineitem")
def range_map_parse(spark, sf):
    head = F.when(F.col("l_linenumber") % 3 == 0, F.concat("l_linenumber", F.lit(":"))).when(F.col("l_linenumber") % 3 == 1, F.concat("l_linenumber", F.lit(": "), F.col("l_linenumber") + 4)).otherwise(F.col("l_linenumber").cast("string"))
    written = F.concat(head, F.lit("[ "), "l_returnflag", F.lit(", "), "l_linestatus", F.lit(",],7:9[z]"))
    r = text.parse_ranges(written)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r[0]["lo"].alias("lo"), r[0]["hi"].alias("hi"), F.array_join(r[0]["values"], "|").alias("names"), F.size(r).alias("n"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda v: trim(v)), lambda v: v <> ''), '|') AS names FROM part")
def string_split(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.split_list(F.concat(F.lit(" ,"), F.regexp_replace("p_name", " ", " , "), F.lit(",, "))), "|").alias("names"))


@query("SELECT o_orderkey, '.tif' AS extension, o_orderstatus || '_' || o_orderkey AS stem, o_orderstatus || '_' || o_orderkey || '.tif' AS file FROM orders")
def path_functions(spark, sf):
    path = F.concat(F.lit("/d.x/"), "o_orderstatus", F.lit("/"), "o_orderstatus", F.lit("_"), "o_orderkey", F.lit(".tif"))
    return table(spark, sf, "orders").select("o_orderkey", text.extension(path).alias("extension"), text.stem(path).alias("stem"), text.file_name(path).alias("file"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 5 WHEN 2 THEN 8 WHEN 3 THEN 8 WHEN 4 THEN 1 WHEN 5 THEN 5 ELSE 1 END AS code, CASE WHEN l_linenumber = 2 THEN 1 WHEN l_linenumber = 3 THEN 2 ELSE 0 END AS fill FROM lineitem")
def name_lookups(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ("lzw", "deflate", "ZIP", "none", "5", "Lzw", "jpeg"))), F.col("l_linenumber"))
    fill = F.element_at(F.array(*map(F.lit, ("zero", "mirror", "linear", "?", "", "x", "y"))), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.compression(name).alias("code"), text.choice(fill, ["zero", "mirror", "linear"]).cast("int").alias("fill"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS channels, CAST(l_partkey AS VARCHAR) AS slices FROM lineitem")
def description_parse(spark, sf):
    said = F.concat(F.lit("ImageJ=1\nchannels="), "l_linenumber", F.lit("\nslices="), "l_partkey", F.lit("\nloop=false"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.description(said)["channels"].alias("channels"), text.description(said)["slices"].alias("slices"))


@query("WITH s AS (SELECT n FROM (SELECT CAST(2 ** i * 3 ** j * 5 ** k AS BIGINT) AS n FROM range(13) a(i), range(8) b(j), range(6) c(k)) WHERE n <= 8192), p AS (SELECT DISTINCT l_partkey % 4000 AS n FROM lineitem) SELECT n, CASE WHEN n <= 1 THEN n ELSE (SELECT min(s.n) FROM s WHERE s.n >= p.n) END AS next, CASE WHEN n <= 1 THEN n ELSE (SELECT max(s.n) FROM s WHERE s.n < p.n) END AS previous FROM p")
def smooth_numbers(spark, sf):
    n = table(spark, sf, "lineitem").select((F.col("l_partkey") % 4000).alias("n")).distinct()
    return n.select("n", text.next_smooth(F.col("n"), 4000).cast("long").alias("next"), text.previous_smooth(F.col("n"), 4000).cast("long").alias("previous"))


@query(_SHAPES + " SELECT image_id, width || ' x ' || height || ' x ' || depth AS shape, CAST(2 ** ceil(log2(width)) AS BIGINT) AS power, CAST(ceil(width / CAST(depth AS DOUBLE)) AS BIGINT) AS parts, least(greatest(height, 64), 128) AS clamped, width > 100 AND height > 100 AND depth > 100 AS all_above, width < 100 OR height < 100 OR depth < 100 AS any_below FROM s")
def shape_algebra(spark, sf):
    w, h, d = F.col("width"), F.col("height"), F.col("depth")
    return _shapes(spark, sf).select("image_id", text.shape_text(w, h, d).alias("shape"), text.next_power_of_two(w).alias("power"), text.ceiling_divide(w, d).alias("parts"), F.least(F.greatest(h, F.lit(64)), F.lit(128)).alias("clamped"), ((w > 100) & (h > 100) & (d > 100)).alias("all_above"), ((w < 100) | (h < 100) | (d < 100)).alias("any_below"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(c, '$.iterations') AS INTEGER), 10) AS iterations, coalesce(CAST(json_extract_string(c, '$.lambda') AS DOUBLE), 0.001) AS weight FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' WHEN event_id % 3 = 1 THEN '{\"iterations\": ' || event_id % 50 || '}' ELSE '{\"lambda\": 0.25, \"other\": [1]}' END AS c FROM events)")
def json_settings(spark, sf):
    written = F.when(F.col("event_id") % 3 == 0, F.lit("{}")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"iterations": '), F.col("event_id") % 50, F.lit("}"))).otherwise(F.lit('{"lambda": 0.25, "other": [1]}'))
    found = F.from_json(written, "iterations int, lambda double")
    return table(spark, sf, "events").select("event_id", F.coalesce(found["iterations"], F.lit(10)).alias("iterations"), F.coalesce(found["lambda"], F.lit(0.001)).alias("weight"))


# point-spread functions


def _sigmas(spark, sf) -> DataFrame:
    ids = table(spark, sf, "lineitem").select(F.expr(f"l_orderkey div {ORDERS}").alias("image_id")).distinct()
    return ids.select("image_id", *((F.lit(s) + (F.col("image_id") + i) % 3 * 0.5).alias(f"sigma_{c}") for i, (c, s) in enumerate(zip("xyz", (1.0, 1.5, 0.5)))))


@query("WITH i AS (SELECT DISTINCT l_orderkey // 2048 AS image_id FROM lineitem), g AS (SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, 1.0 + image_id % 3 * 0.5 AS sx, 1.5 + (image_id + 1) % 3 * 0.5 AS sy, 0.5 + (image_id + 2) % 3 * 0.5 AS sz FROM i, range(12) a(x), range(11) b(y), range(7) c(z)), "
       "r AS (SELECT image_id, x, y, z, CASE WHEN x BETWEEN floor(5.5 - 5 * sx) AND ceil(5.5 + 5 * sx) AND y BETWEEN floor(5 - 5 * sy) AND ceil(5 + 5 * sy) AND z BETWEEN floor(3 - 5 * sz) AND ceil(3 + 5 * sz) THEN exp(-0.5 * (((x - 5.5) / sx) ** 2 + ((y - 5) / sy) ** 2 + ((z - 3) / sz) ** 2)) ELSE 0 END AS v FROM g) SELECT image_id, x, y, z, round(v / sum(v) OVER (PARTITION BY image_id), 9) + 0.0 AS v FROM r")  # fmt: skip
def gaussian_psf(spark, sf):
    return _rounded(psf.gaussian(_sigmas(spark, sf), (12, 11, 7)), "v", digits=9)


# J0 by 64 nodes and Simpson's rule over 1,024 steps, both far past convergence
_LANNI = """WITH i AS (SELECT DISTINCT l_orderkey // 2048 AS image_id FROM lineitem), q AS (SELECT image_id, 1.0::DOUBLE + image_id % 4 * 0.1::DOUBLE AS na, CAST(image_id % 5 * 200 AS DOUBLE) AS particle FROM i),
n AS (SELECT DISTINCT na FROM q), t AS (SELECT s, j, na, j / 1024.0::DOUBLE AS rho, CASE WHEN j IN (0, 1024) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END AS w FROM n, range(22) a(s), range(1025) b(j)),
b AS (SELECT s, j, na, rho, w, avg(cos(2 * pi() / 450 * na * s * 50 * rho * sin((m + 0.5) * pi() / 64))) AS j0 FROM t, range(64) c(m) GROUP BY ALL),
p AS (SELECT image_id, z, s, j0 * rho * w AS f, 2 * pi() / 450 * (1.33 * particle * sqrt(greatest(0, 1 - (na * rho / 1.33) ** 2)) + 1.515 * 100 * (z - 2) * sqrt(greatest(0, 1 - (na * rho / 1.515) ** 2))) AS phase FROM q JOIN b USING (na), range(5) d(z)),
r AS (SELECT image_id, z, s, ((sum(f * cos(phase)) / 1024) ** 2 + (sum(f * sin(phase)) / 1024) ** 2) AS v FROM p GROUP BY ALL),
g AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, 2 * sqrt((x - 7) ** 2 + (y - 7) ** 2) AS d FROM range(15) e(x), range(15) f(y))
SELECT l.image_id, x, y, CAST(l.z AS INTEGER) AS z, round(l.v + (d - floor(d)) * (h.v - l.v), 6) + 0.0 AS v FROM g JOIN r l ON l.s = floor(d) JOIN r h ON h.s = l.s + 1 AND h.image_id = l.image_id AND h.z = l.z"""


@query(_LANNI)
def gibson_lanni_psf(spark, sf):
    ids = _sigmas(spark, sf).select("image_id", (F.lit(1.0) + F.col("image_id") % 4 * 0.1).alias("na"), (F.col("image_id") % 5 * 200.0).alias("particle"))
    return _rounded(psf.gibson_lanni(ids, (15, 15, 5), tolerance=1e-7), "v")


# convolution and deconvolution; taps with dyadic weights, so sums are exact

TAPS = [(0, 0, 0, 0.5), (1, 0, 0, 0.125), (-1, 0, 0, 0.0625), (0, 1, 0, 0.125), (0, -1, 0, 0.0625), (0, 0, 1, 0.125)]


def _conv(source: str, value: str, shape, sign: int = 1) -> str:
    w, h, d = shape
    taps = ", ".join(f"({i}, {j}, {k}, {c})" for i, j, k, c in TAPS)
    return f"SELECT image_id, CAST((x + {sign} * i + {w}) % {w} AS INTEGER) AS x, CAST((y + {sign} * j + {h}) % {h} AS INTEGER) AS y, CAST((z + {sign} * k + {d}) % {d} AS INTEGER) AS z, sum({value} * w) AS v FROM {source}, (VALUES {taps}) t(i, j, k, w) GROUP BY ALL"


@query(VOL + ", c AS (" + _conv("vol", "a", SHAPE) + ") SELECT image_id, x, y, z, round(v, 6) AS a FROM c")
def convolution(spark, sf):
    return _rounded(dec.convolve(volume(spark, sf), "a", TAPS), "a")


@query(VOL + ", c AS (" + _conv("vol", "a", SHAPE) + ") SELECT image_id, x, y, z, round(v, 4) + 0.0 AS a FROM c")
def convolution_fft(spark, sf):
    return _rounded(dec.deconvolve(volume(spark, sf), "a", dec.tap_psf(TAPS), "Convolution"), "a", digits=4)


@query(_padded(_CLAMP, "a").split(", p AS")[0] + ", q AS (SELECT v.image_id, CAST(gx.x AS INTEGER) AS x, CAST(gy.y AS INTEGER) AS y, CAST(gz.z AS INTEGER) AS z, sum(v.a * w) AS v FROM (VALUES " + ", ".join(f"({i}, {j}, {k}, {c})" for i, j, k, c in TAPS) + ") t(i, j, k, w), range(16) gx(x), range(16) gy(y), range(4) gz(z), vol v WHERE v.x = gx.x - i AND v.y = gy.y - j AND v.z = gz.z - k GROUP BY ALL) SELECT image_id, x, y, z, round(coalesce(q.v, 0), 4) + 0.0 AS a FROM vol LEFT JOIN q USING (image_id, x, y, z)")
def convolution_tiled(spark, sf):
    """Overlapping tiles with zero halos: a linear convolution, whatever the tiles."""
    return _rounded(dec.deconvolve(volume(spark, sf), "a", dec.tap_psf(TAPS), "Convolution", tile=(6, 7, 3), halo=((1, 1, 1), (1, 1, 1))), "a", digits=4)


_SMALL = "WITH " + _vol(SMALL)
_DFT = (
    ", f AS (SELECT CAST(x AS INTEGER) AS kx, CAST(y AS INTEGER) AS ky, CAST(z AS INTEGER) AS kz FROM range(8) a(x), range(8) b(y), range(4) c(z)), "
    "s AS (SELECT image_id, kx, ky, kz, sum(a * cos(2 * pi() * (kx * x / 8.0 + ky * y / 8.0 + kz * z / 4.0))) AS re, -sum(a * sin(2 * pi() * (kx * x / 8.0 + ky * y / 8.0 + kz * z / 4.0))) AS im FROM vol, f GROUP BY ALL), "
    "h AS (SELECT kx, ky, kz, sum(w * cos(2 * pi() * (kx * i / 8.0 + ky * j / 8.0 + kz * k / 4.0))) AS hr, -sum(w * sin(2 * pi() * (kx * i / 8.0 + ky * j / 8.0 + kz * k / 4.0))) AS hi FROM f, (VALUES " + ", ".join(f"({i}, {j}, {k}, {c})" for i, j, k, c in TAPS) + ") t(i, j, k, w) GROUP BY ALL)"
)


def _filtered(power: str) -> str:
    p = f"CASE WHEN {power} >= 1e-6 THEN {power} END"
    q = f", q AS (SELECT image_id, kx, ky, kz, coalesce((re * hr + im * hi) / {p}, 0) AS qr, coalesce((im * hr - re * hi) / {p}, 0) AS qi FROM s JOIN h USING (kx, ky, kz))"
    return _SMALL + _DFT + q + " SELECT v.image_id, v.x, v.y, v.z, round(sum(qr * cos(2 * pi() * (kx * x / 8.0 + ky * y / 8.0 + kz * z / 4.0)) - qi * sin(2 * pi() * (kx * x / 8.0 + ky * y / 8.0 + kz * z / 4.0))) / 256, 4) + 0.0 AS a FROM vol v JOIN q ON q.image_id = v.image_id GROUP BY ALL"


@query(_SMALL + _DFT + " SELECT image_id, kx AS x, ky AS y, kz AS z, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM s")
def fourier_transform(spark, sf):
    return _rounded(dec.spectrum(volume(spark, sf, SMALL), "a", PENCIL), "re", "im", digits=4)


@query(_SMALL + " SELECT image_id, x, y, z, round(a, 6) + 0.0 AS a FROM vol")
def fourier_roundtrip(spark, sf):
    return _rounded(dec.inverse_spectrum(dec.spectrum(volume(spark, sf, SMALL), "a", PENCIL), "a", PENCIL), "a")


_DFT_COMPLEX = ", s2 AS (SELECT image_id, kx, ky, kz, sum(a * cos(t) + b * sin(t)) AS re, sum(b * cos(t) - a * sin(t)) AS im FROM (SELECT *, 2 * pi() * (kx * x / 8.0 + ky * y / 8.0 + kz * z / 4.0) AS t FROM vol, f) GROUP BY ALL)"


@query(_SMALL + _DFT + _DFT_COMPLEX + " SELECT image_id, kx AS x, ky AS y, kz AS z, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM s2")
def fourier_complex(spark, sf):
    """Of complex images, a + ib."""
    return _rounded(dec.spectrum(volume(spark, sf, SMALL), ("a", "b"), PENCIL), "re", "im", digits=4)


@query(VOL + ", c AS (" + _conv("vol", "a", SHAPE) + ") SELECT image_id, x, y, z, round(v, 4) + 0.0 AS a FROM c")
def convolution_lines(spark, sf):
    """By the spectra of whole images, which no task holds."""
    return _rounded(_by_lines(volume(spark, sf), "Convolution"), "a", digits=4)


def _by_lines(v: Volume, algorithm: str, **settings) -> Volume:
    own = chunks.from_voxels(v, "a", PENCIL)
    return chunks.to_voxels(dec.filter_spectra(own, dec.tap_psf(TAPS), algorithm, **settings), "a")


@query(_filtered("hr * hr + hi * hi"))
def inverse_filter_lines(spark, sf):
    return _rounded(_by_lines(volume(spark, sf, SMALL), "InverseFilter", epsilon=1e-6), "a", digits=4)


@query(_filtered("greatest(1e-9, hr * hr + hi * hi + 0.01 * (-2 * (cos(2 * pi() * kx / 8) + cos(2 * pi() * ky / 8) + cos(2 * pi() * kz / 4) - 3)) ** 2)"))
def regularized_inverse_lines(spark, sf):
    return _rounded(_by_lines(volume(spark, sf, SMALL), "RegularizedInverseFilter", weight=0.01), "a", digits=4)


@query(_SMALL + " SELECT image_id, x, y, z, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM vol")
def fourier_complex_roundtrip(spark, sf):
    return _rounded(dec.inverse_spectrum(dec.spectrum(volume(spark, sf, SMALL), ("a", "b"), PENCIL), ("a", "b"), PENCIL), "a", "b")


@query(_SMALL + _DFT + " SELECT image_id, kx AS x, ky AS y, kz AS z, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM s WHERE kx <= 4")
def fourier_half(spark, sf):
    return _rounded(dec.spectrum(volume(spark, sf, SMALL), "a", PENCIL, half=True), "re", "im", digits=4)


@query(_SMALL + " SELECT image_id, x, y, z, round(a, 6) + 0.0 AS a FROM vol")
def fourier_half_roundtrip(spark, sf):
    return _rounded(dec.inverse_spectrum(dec.spectrum(volume(spark, sf, SMALL), "a", PENCIL, half=True), "a", PENCIL, width=SMALL[0]), "a")


@query(_filtered("hr * hr + hi * hi"))
def inverse_filter(spark, sf):
    return _rounded(dec.deconvolve(volume(spark, sf, SMALL), "a", dec.tap_psf(TAPS), "InverseFilter", epsilon=1e-6), "a", digits=4)


@query(_filtered("greatest(1e-9, hr * hr + hi * hi + 0.01 * (-2 * (cos(2 * pi() * kx / 8) + cos(2 * pi() * ky / 8) + cos(2 * pi() * kz / 4) - 3)) ** 2)"))
def regularized_inverse(spark, sf):
    return _rounded(dec.deconvolve(volume(spark, sf, SMALL), "a", dec.tap_psf(TAPS), "RegularizedInverseFilter", weight=0.01), "a", digits=4)


def _lucy(iterations: int, damping: bool = False, weight: float = 0.0, shape=SHAPE) -> str:
    out, f = [VOL, "f0 AS MATERIALIZED (SELECT image_id, x, y, z, a AS v FROM vol)"], "f0"
    for n in range(iterations):
        out.append(f"d{n} AS MATERIALIZED ({_conv(f, 'v', shape)})")
        out.append(f"c{n} AS MATERIALIZED (SELECT image_id, x, y, z, a / greatest(d.v, 1e-9) AS v FROM vol JOIN d{n} d USING (image_id, x, y, z))")
        out.append(f"r{n} AS MATERIALIZED ({_conv(f'c{n}', 'v', shape, -1)})")
        factor = f" * 0.9 * exp(-0.01 * {n})" if damping else ""
        out.append(f"f{n + 1} AS MATERIALIZED (SELECT image_id, x, y, z, f.v * r.v{factor} AS v FROM {f} f JOIN r{n} r USING (image_id, x, y, z))")
        f = f"f{n + 1}"
        if weight:
            g, beta = f"g{n}", 0.1 * weight
            out.append(f"{g} AS MATERIALIZED (SELECT image_id, x, y, z, v, coalesce(v - lead(v) OVER (PARTITION BY image_id, y, z ORDER BY x), 0) AS gx, coalesce(v - lead(v) OVER (PARTITION BY image_id, x, z ORDER BY y), 0) AS gy, coalesce(v - lead(v) OVER (PARTITION BY image_id, x, y ORDER BY z), 0) AS gz FROM {f})")
            out.append(f"n{n} AS MATERIALIZED (SELECT image_id, x, y, z, v, gx / sqrt(gx * gx + gy * gy + gz * gz + {beta}) AS gx, gy / sqrt(gx * gx + gy * gy + gz * gz + {beta}) AS gy, gz / sqrt(gx * gx + gy * gy + gz * gz + {beta}) AS gz FROM {g})")
            out.append(f"t{n} AS MATERIALIZED (SELECT image_id, x, y, z, v / greatest(1 - {weight} * {_DIV}, 1e-8) AS v FROM n{n})")
            f = f"t{n}"
    return ", ".join(out) + f" SELECT image_id, x, y, z, round(v, 4) + 0.0 AS a FROM {f}"


@query(_lucy(3))
def richardson_lucy(spark, sf):
    return _rounded(dec.deconvolve(volume(spark, sf), "a", dec.tap_psf(TAPS), "RichardsonLucy", iterations=3), "a", digits=4)


_WIDE = tuple(n + 8 for n in SHAPE)


def _lucy_wide() -> str:
    """Two steps on images with mirrored halos of 4, as far as two steps reach."""
    axis = lambda c, n: f"(SELECT CAST(o AS INTEGER) AS {c}, " + _mirrored_sql("o", 0, n, 4) + f" AS s{c} FROM range({n + 8}) r(o))"
    px, py, pz = (axis(c, n) for c, n in zip("xyz", SHAPE))
    wide = f", wide AS (SELECT v.image_id, px.x, py.y, pz.z, v.a FROM vol v JOIN {px} px ON px.sx = v.x JOIN {py} py ON py.sy = v.y JOIN {pz} pz ON pz.sz = v.z)"
    steps = _lucy(2, shape=_WIDE).replace(VOL, "").replace("FROM vol", "FROM wide")
    w, h, d = SHAPE
    return f"{VOL}{wide}{steps.split(' SELECT image_id, x, y, z, round')[0]} SELECT image_id, x - 4 AS x, y - 4 AS y, z - 4 AS z, CAST(v AS FLOAT) AS a FROM f2 WHERE x BETWEEN 4 AND {w + 3} AND y BETWEEN 4 AND {h + 3} AND z BETWEEN 4 AND {d + 3}"


def _mirrored_sql(c: str, lo: int, hi: int, missing: int) -> str:
    n = hi - lo
    m = f"((({c} - {missing}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"least({m}, {2 * n - 1} - {m}) + {lo}"


@query(_lucy_wide())
def richardson_lucy_files(spark, sf):
    """From files to files in planned tiles whose halos hold what two steps reach."""
    v = volume(spark, sf)
    folder, out = _files(spark, v, tile=(8, 4)), shared.new_folder(spark, "tiff")
    halo = ((4, 4, 4), (4, 4, 4))
    full = tiles.tile_shape(v.shape, halo, 3000, 2, (9, 9, 9))
    layout = chunks.Layout(v.shape, tuple(min(n, f - 8) for n, f in zip(v.shape, full)), *halo, "mirror")
    done = dec.deconvolve_pieces(tiff_source.read_pieces(spark, folder, layout), layout, dec.tap_psf(TAPS), "RichardsonLucy", kind=tiff_source.KIND, iterations=2)
    names = tiff_source.list_files(spark, folder).select("image_id", text.stem(F.col("path")).alias("name"))
    tiff_sink.write_tiff(tiff_sink.encode_chunks(done), out, names)
    return _from_files(spark, out, tiff_source.read_tiff(spark, out)).withColumnRenamed("v", "a")


@query(_lucy(3, damping=True))
def rl_adaptive_damping(spark, sf):
    return _rounded(dec.deconvolve(volume(spark, sf), "a", dec.tap_psf(TAPS), "RichardsonLucywithAdaptiveDamping", iterations=3), "a", digits=4)


@query(_lucy(2, weight=0.02))
def rl_total_variation(spark, sf):
    return _rounded(dec.deconvolve(volume(spark, sf), "a", dec.tap_psf(TAPS), "RichardsonLucyTotalVariation", iterations=2, weight=0.02), "a", digits=4)


@query(VOL + ", c AS (" + _conv("vol", "a", SHAPE) + ") SELECT v.image_id, v.x, v.y, v.z, round(CASE WHEN v.x < 8 THEN c.v * 0.75 ELSE v.a * 2 * 0.5 END, 6) + 0.0 AS a FROM vol v JOIN c USING (image_id, x, y, z)")
def labeled_deconvolution(spark, sf):
    v = volume(spark, sf)
    left = F.col("x") < 8
    weights = v.voxels.select(*KEYS, F.when(left, "wide").otherwise("point").alias("group"), F.when(left, 0.75).otherwise(0.5).alias("weight"))
    return _rounded(dec.labelled(v, "a", weights, {"wide": dec.tap_psf(TAPS), "point": dec.tap_psf([(0, 0, 0, 2.0)])}, "Convolution"), "a")


_HALF = ", ml AS (SELECT image_id, x, y, z, CASE WHEN x < 8 THEN 1.0 ELSE 0.0 END AS v FROM vol), mr AS (SELECT image_id, x, y, z, 1 - v AS v FROM ml), cl AS (" + _conv("ml", "v", SHAPE) + "), cr AS (" + _conv("mr", "v", SHAPE) + ")"


@query(VOL + _HALF + " SELECT image_id, x, y, z, 'l' AS group, round(l.v / (l.v + r.v), 6) + 0.0 AS weight FROM cl l JOIN cr r USING (image_id, x, y, z) UNION ALL SELECT image_id, x, y, z, 'r', round(r.v / (l.v + r.v), 6) + 0.0 FROM cl l JOIN cr r USING (image_id, x, y, z)".replace("AS group", 'AS "group"'))
def label_weights(spark, sf):
    v = volume(spark, sf)
    masks = v.with_(v.voxels.select(*KEYS, F.when(F.col("x") < 8, "l").otherwise("r").alias("group"), F.lit(1.0).alias("weight")))
    return _rounded(engine.weights(masks, dec.tap_psf(TAPS)), "weight")


# plans and files


def _plan_sql(strategy: str, halo=(5, 5, 3), most=200_000, fewest=2, least=(21, 21, 11)) -> str:
    """The planner's rules over shapes s, axis by axis: a, b, c are padded extents."""
    smooth = str(text.smooth_numbers(2000))
    axes = list(zip("abc", ("width", "height", "depth"), halo, least))
    count = lambda c, n, h, v=None: f"CAST(ceil({n} / CAST(least({n}, greatest(1, {v or c} - {2 * h})) AS DOUBLE)) AS BIGINT)"
    number = " * ".join(count(c, n, h) for c, n, h, _ in axes)
    smaller = lambda c: f"list_max(list_filter({smooth}, lambda v: v < {c}))"
    allowed = lambda c, h, m: f"{smaller(c)} >= {m} AND {smaller(c)} > {2 * h}"
    start = ", ".join(f"list_min(list_filter({smooth}, lambda v: v >= greatest({m}, {n}{'' if strategy == 'none' else f' + {2 * h}'}))) AS {c}" for c, n, h, m in axes)
    marked = ", ".join(f"CASE WHEN {allowed(c, h, m)} THEN {c} END AS u{c}" for c, _, h, m in axes)
    top = "greatest(ua, ub, uc)"
    turn = f"CASE WHEN ua = {top} THEN 'a' WHEN ub = {top} THEN 'b' WHEN uc = {top} THEN 'c' END"
    shrunk = ", ".join(f"CASE WHEN turn = '{c}' THEN {smaller(c)} ELSE {c} END" for c, *_ in axes)
    final = ", ".join(f"list_min(list_filter({smooth}, lambda v: v = {c} OR v < {c} AND v >= {m} AND v > {2 * h} AND {count(c, n, h, 'v')} <= {count(c, n, h)})) AS {c}" for c, n, h, m in axes)
    if strategy == "none":
        split = ", ".join(f"least({n}, CASE WHEN {c} < {n} THEN {c} - {h} ELSE {c} END) AS s{c}, 0 AS l{c}" for c, n, h, _ in axes)
    else:
        split = ", ".join(f"least({n}, {c} - {2 * h}) AS s{c}, {h} AS l{c}" for c, n, h, _ in axes)
    starts = ", ".join(f"CAST(ceil({n} / CAST(s{c} AS DOUBLE)) AS BIGINT) AS n{c}" for c, n, _, _ in axes)
    columns = ", ".join([*(f"CAST(least(i{c} * s{c}, {n} - s{c}) AS INTEGER) AS {o}" for (c, n, _, _), o in zip(axes, "xyz")), *(f"CAST(s{c} AS INTEGER) AS {o}" for (c, *_), o in zip(axes, "whd")),
                         *(f"CAST(l{c} AS INTEGER) AS before_{o}" for (c, *_), o in zip(axes, "xyz")), *(f"CAST({c} - s{c} - l{c} AS INTEGER) AS after_{o}" for (c, *_), o in zip(axes, "xyz"))])
    return f"""{_SHAPES.replace("WITH s", "WITH RECURSIVE s")},
p AS (SELECT *, {start} FROM s UNION ALL SELECT image_id, width, height, depth, {shrunk} FROM (SELECT *, {turn} AS turn FROM (SELECT *, {marked} FROM p WHERE a * b * c >= {most} OR {number} < {fewest}))),
f AS (SELECT image_id, width, height, depth, {final} FROM p WHERE a * b * c < {most} AND {number} >= {fewest}),
z AS (SELECT *, {starts} FROM (SELECT *, {split} FROM f))
SELECT image_id, CAST((ic * nb + ib) * na + ia AS INTEGER) AS chunk_id, {columns} FROM (SELECT *, unnest(range(nc)) AS ic FROM (SELECT *, unnest(range(nb)) AS ib FROM (SELECT *, unnest(range(na)) AS ia FROM z)))"""


@query(_plan_sql("full_psf"))
def plan_tiles(spark, sf):
    return tiles.plan_tiles(_shapes(spark, sf), ((5, 5, 3), (5, 5, 3)), 200_000, least_tiles=2, least_shape=(21, 21, 11))


@query(_plan_sql("none"))
def plan_tiles_without_padding(spark, sf):
    return tiles.plan_tiles(_shapes(spark, sf), ((5, 5, 3), (5, 5, 3)), 200_000, least_tiles=2, least_shape=(21, 21, 11), strategy="none")


def _files(spark, v: Volume, **how) -> str:
    """A folder of the volume's images as TIFF files, named by their ids."""
    folder = shared.new_folder(spark, "tiff")
    tiff_sink.write_tiff(tiff_sink.encode_slices(v.voxels, "a", v.shape, **how), folder)
    return folder


def _from_files(spark, folder: str, rows: DataFrame) -> DataFrame:
    ids = tiff_source.list_files(spark, folder).select("image_id", text.stem(F.col("path")).cast("long").alias("own"))
    return rows.join(ids, "image_id").select(F.col("own").alias("image_id"), *(c for c in rows.columns if c != "image_id"))


@query(VOL + " SELECT image_id, x, y, z, CAST(a AS FLOAT) AS v FROM vol")
def tiff_roundtrip(spark, sf):
    folder = _files(spark, volume(spark, sf), compression=tiff.DEFLATE, level=1, tile=(16, 16))
    return _from_files(spark, folder, tiff_source.read_tiff(spark, folder))


@query(VOL + " SELECT image_id, x, y, z, CAST(a AS FLOAT) AS v FROM vol")
def tiff_predictor(spark, sf):
    """Whole numbers of 16 bits, written as differences along rows."""
    folder = _files(spark, volume(spark, sf), compression=tiff.LZW, kind="u2")
    return _from_files(spark, folder, tiff_source.read_tiff(spark, folder))


@query(VOL + " SELECT image_id, x, y, z, CAST(a AS FLOAT) AS v FROM vol WHERE x BETWEEN 3 AND 13 AND y BETWEEN 4 AND 10 AND z BETWEEN 1 AND 2")
def tiff_region(spark, sf):
    folder = _files(spark, volume(spark, sf), tile=(8, 4))
    return _from_files(spark, folder, tiff_source.read_tiff(spark, folder, z=(1, 3), y=(4, 11), x=(3, 14)))


@query(VOL + " SELECT image_id, x, y, z, CAST(a AS FLOAT) AS v FROM vol WHERE z = 3 AND x < 9 AND y >= 5 AND x + y <> 9")
def tiff_pushdown(spark, sf):
    """Filters in SQL; those on one coordinate prune slices and blocks of the files."""
    folder = _files(spark, volume(spark, sf), tile=(4, 4))
    tiff_source.register(spark)
    return _from_files(spark, folder, spark.read.format("tiff").load(folder).where("z = 3 AND x < 9 AND y >= 5 AND x + y <> 9"))


@query(VOL + " SELECT image_id, x, y, z, CAST(4 AS INTEGER) AS w, CAST(4 AS INTEGER) AS h, CAST(64 AS BIGINT) AS bytes FROM vol WHERE z = 3 AND x < 9 AND x % 4 = 0 AND y % 4 = 0")
def tiff_block_rows(spark, sf):
    """Blocks as binary rows; only those that the filter keeps are read."""
    folder = _files(spark, volume(spark, sf), tile=(4, 4))
    tiff_source.register(spark)
    rows = spark.read.format("tiff").option("rows", "blocks").load(folder).where("z = 3 AND x < 9")
    return _from_files(spark, folder, rows.drop("path", "data"))


@query(VOL + " SELECT image_id, x, y, z, CAST(a AS FLOAT) AS v FROM vol")
def tiff_slabs(spark, sf):
    """Chunks to files without voxel rows."""
    v = volume(spark, sf)
    folder = shared.new_folder(spark, "tiff")
    tiff_sink.write_tiff(tiff_sink.encode_chunks(chunks.from_voxels(v, "a", (6, 5, 3)), compression=tiff.DEFLATE), folder)
    return _from_files(spark, folder, tiff_source.read_tiff(spark, folder))


@query(VOL + " SELECT image_id, z, CAST(4 AS INTEGER) AS depth, CAST(16 AS INTEGER) AS width, CAST(16 AS INTEGER) AS height, CAST(1 AS INTEGER) AS channels, CAST(1 AS INTEGER) AS samples FROM vol WHERE x = 0 AND y = 0")
def tiff_metadata(spark, sf):
    """What the directories of files say; no voxel is read."""
    found = tiff_source.list_slices(spark, _files(spark, volume(spark, sf)))
    return found.select(text.stem(F.col("path")).cast("long").alias("image_id"), "z", "depth", "width", "height", "channels", "samples")


@query(VOL + ", g AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z FROM range(13) a(x), range(11) b(y), range(5) c(z)) SELECT image_id, g.x, g.y, g.z, v.a AS v FROM vol v JOIN g ON "
       + " AND ".join(f"v.{c} = {_mirrored_sql('g.' + c, *box)}" for c, box in (("x", (0, 11, 2)), ("y", (8, 16, 0)), ("z", (0, 4, 0)))))
def tiff_halo_read(spark, sf):
    """A box with a halo that reaches beyond the image on three sides."""
    v = volume(spark, sf)
    folder = _files(spark, v)
    return _from_files(spark, folder, engine.read_box(spark, folder, v.shape, (0, 10, 1), (8, 6, 2), (2, 2, 1), (3, 3, 2), "mirror").voxels)
