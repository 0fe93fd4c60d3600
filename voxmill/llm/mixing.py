"""Mixing sources to target weights.

The words of each source, document after document, are packed into fixed-length
blocks. A source may give up to `repeats` times its size; what its share exceeds
that goes to the others by weight. A source's target gives its number of slots of
the output, which has shards of `shard_slots` slots. Which slots a shard holds is
drawn without replacement, by a keyed permutation of all slots: its counts of slots
per source are those of a multinomial draw with the targets as weights, given that
all shards together use each source to its target. The slots of a source, numbered
through all shards, are mapped to its blocks by keyed permutations of block numbers,
another one each round, so a block is used as often as any other or once more, and
never more than `repeats` times.

Permutations are Feistel networks over a grid of at least as many cells as numbers,
of six rounds that multiply, add and flip bits by keys modulo a prime. Who leaves the numbers
walks on; the grid exceeds them by less than a row, and a walk is shorter than that.

Scale: sizes are summed in chunks of documents, about as many chunks as a chunk has
documents, so no task sees a whole source; the windows over one partition hold a
row for each source. Slots are made in parallel, in two steps of bounded ranges, and
meet blocks by (source, block number).

Rows: null text has size 0 and is never taken; a null source is a source of its
own, the last; null doc_ids and repeated rows are documents of their own; other
columns are ignored; no rows give no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import materialize, partitions

BLOCK, LEAST_BLOCKS, SHARD_SLOTS, REPEATS = 64, 256, 1024, 3
#: Feistel steps (two rounds each), the prime of their arithmetic, and steps of a walk
#: beyond which none goes: who leaves a grid of 64 rows or more with a chance of at
#: most 1/64 does so 64 times in a row with one of 1e-115.
STEPS, PRIME, WALK = 3, 2_147_483_647, 64
#: Slots that one row stands for before each explosion.
COARSE, FINE = 1 << 22, 1 << 11
WEIGHTS = (1, 2, 3)


def times_taken(rows: DataFrame) -> DataFrame:
    """(doc_id, copy, source, times) from mix()'s rows: how often whole documents go into
    a mix that takes so many of their words. Shares (taken by size) are rounded along
    the documents of a chunk in the order of their sizes, carrying what is left over: a
    chunk's sum of times is its sum of shares but for one, spread over all sizes, so each
    source comes near its target, and no share of 3 at most gives more than 3. Equal rows
    share alike."""
    alike = rows.where("size > 0").groupBy("doc_id", "copy", "source", "rank", "chunk").agg((F.avg("taken") / F.max("size")).alias("share"), F.max("size").alias("size"))
    order = Window.partitionBy("rank", "chunk").orderBy("size", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    # rounded to millionths, which sum exactly
    upto = F.sum(F.round(F.col("share") * 1_000_000).cast("long")).over(order) + F.pmod(F.xxhash64("rank", "chunk"), F.lit(1_000_000))
    part = F.round(F.col("share") * 1_000_000).cast("long")
    return alike.select("doc_id", "copy", "source", upto.alias("upto"), part.alias("part")).select("doc_id", "copy", "source", (F.expr("upto div 1000000") - F.expr("(upto - part) div 1000000")).alias("times")).where("times > 0")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digits(text: Column) -> Column:
    """A number below 2**28 from a text."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def round_keys(name: Column, seed: int) -> Column:
    """Four numbers (a to d, e to h) for each of both rounds of each Feistel step."""
    key = lambda i: digits(F.concat_ws(":", F.lit(str(seed)), name.cast("string"), F.lit(str(i))))
    return F.array(*(F.struct(*(key(8 * s + j).alias(k) for j, k in enumerate("abcdefgh"))) for s in range(STEPS)))


def permuted(x: Column, n: Column, keys: Column, turn: Column) -> Column:
    """x below n to another number below n, one to one; another way for each turn."""
    high = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    low = F.ceil(n / high).cast("long")
    mixed = lambda v, k, names: F.pmod(F.pmod(v * k[names[0]] + k[names[1]] + turn * 7919, F.lit(PRIME)).bitwiseXOR(k[names[2]]) * k[names[3]], F.lit(PRIME))

    def step(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + mixed(s["r"], k, "abcd"), high)
        return F.struct(left.alias("l"), F.pmod(s["r"] + mixed(left, k, "efgh"), low).alias("r"))

    once = lambda v: F.aggregate(keys, F.struct(F.floor(v / low).cast("long").alias("l"), F.pmod(v, low).alias("r")), step, lambda s: s["l"] * low + s["r"])
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(high * low - n, F.lit(WALK)).cast("int")))
    first = once(x)
    return F.when(high * low == n, first).otherwise(F.aggregate(steps, first, lambda v, _: F.when(v < n, v).otherwise(once(v))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, target): weights repeat over the sources in the
    order of their names, null last. The level at which capped shares use up the
    total is found by summing along the sources in the order they reach their caps."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = by.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("double"))
    cap = repeats * F.col("source_size")
    reach = Window.orderBy(cap / F.col("weight"), "rank")
    everyone = Window.partitionBy(F.lit(1))
    level = ranked.select(
        "*", cap.alias("cap"), F.sum("source_size").over(everyone).alias("total"),
        F.coalesce(F.sum(cap).over(reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(reach.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    ).withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everyone)
    target = F.least(first["level"] * F.col("weight"), F.col("cap").cast("double"))
    return level.select("source", "rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> dict[str, DataFrame]:
    """documents: (doc_id, size, source_size, target, taken, first_shard) for every
    row, first_shard the first of the output that has words of it, or null;
    rows: (doc_id, copy, source, rank, chunk, size, taken), the same with the hash of the
    text, the source and its rank, and the chunk of the source's documents;
    slots: (shard, source, slot, block), the mixture in blocks;
    pieces: (source, block, doc_id, first_word, n_words), what blocks hold."""
    spark = documents.sparkSession
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")), F.lit(str(seed)))
    sized = materialize(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), digits(named).alias("draw"), F.xxhash64("text").alias("copy"), F.monotonically_increasing_id().alias("row")), "sizes")
    n_chunks = max(1, math.ceil(math.sqrt(sized.count() / 8)))
    targets = source_targets(sized, weights, repeats).withColumn("length", F.least(F.lit(block), F.greatest(F.lit(1), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long"))
    targets = targets.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("length"))).withColumn(
        "n_slots", F.when(F.col("source_size") > 0, F.least(repeats * F.col("n_blocks"), F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))).otherwise(F.lit(0))
    )
    before = lambda w, c="size": F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = materialize(targets.select("*", before(Window.orderBy("rank"), "n_slots").alias("first_slot"), F.sum("n_slots").over(Window.partitionBy(F.lit(1))).alias("all_slots")), "targets")

    # places of documents in the stream of their source
    rows = sized.withColumn("chunk", F.pmod(F.col("draw"), F.lit(n_chunks)))
    rows = rows.join(targets.select("source", "rank", "length"), rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    chunks = rows.groupBy("rank", "chunk").agg(F.sum("size").alias("size")).select("rank", "chunk", before(Window.partitionBy("rank").orderBy("chunk")).alias("base"))
    placed = rows.withColumn("inner", before(Window.partitionBy("rank", "chunk").orderBy("doc_id", "row"))).join(chunks, ["rank", "chunk"]).withColumn("at", F.col("base") + F.col("inner"))
    touched = F.sequence(F.expr("at div length"), F.expr("(at + size - 1) div length"))
    pieces = placed.where("size > 0").select("rank", "source", "doc_id", "row", "at", "size", "length", F.explode(touched).alias("block"))
    first = F.greatest(F.col("at"), F.col("block") * F.col("length"))
    pieces = pieces.select("rank", "source", "block", "doc_id", "row", (first - F.col("at")).alias("first_word"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("length")) - first).alias("n_words"))

    # the slots of all sources, in tasks of their own
    ranges = lambda df, lo, hi, width: df.select(*(c for c in df.columns if c not in ("lo", "hi")), F.explode(F.sequence(lo, hi - 1, F.lit(width).cast("long"))).alias("lo"), hi.alias("hi"))
    parts = targets.where("n_slots > 0").select("source", "rank", "n_blocks", "first_slot", "all_slots", F.lit(0).cast("long").alias("lo"), F.col("n_slots").alias("hi"))
    for width in (COARSE, FINE):
        parts = ranges(parts, F.col("lo"), F.col("hi"), width).withColumn("hi", F.least("hi", F.col("lo") + width))
        parts = parts.repartition(partitions(spark), "rank", "lo")
    slots = parts.select("source", "rank", "n_blocks", "first_slot", "all_slots", round_keys(F.col("rank"), seed).alias("keys"), round_keys(F.lit("shards"), seed).alias("shard_keys"), "lo", "hi")
    slots = ranges(slots, F.col("lo"), F.col("hi"), 1).withColumnRenamed("lo", "slot")
    block_ = permuted(F.pmod("slot", "n_blocks"), F.col("n_blocks"), F.col("keys"), F.expr("slot div n_blocks"))
    place = permuted(F.col("first_slot") + F.col("slot"), F.col("all_slots"), F.col("shard_keys"), F.lit(0))
    # never null, which spares the join's filter on nulls a second permutation
    slots = slots.select(F.floor(place / shard_slots).alias("shard"), "source", "rank", "slot", F.coalesce(block_, F.lit(-1)).alias("block"))

    uses = slots.groupBy("rank", "block").agg(F.count("*").alias("uses"), F.min("shard").alias("shard"))
    # the planner takes exploded slots for as small as their sources; they are not
    taken = pieces.join(uses.hint("merge"), ["rank", "block"]).groupBy("row").agg(F.sum(F.col("uses") * F.col("n_words")).alias("taken"), F.min("shard").alias("first_shard"))
    result = placed.select("row", "doc_id", "copy", "rank", "chunk", "size").join(targets.select("rank", "source", "source_size", "target"), "rank").join(taken.hint("merge"), "row", "left")
    result = result.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return {
        "documents": result.select("doc_id", "size", "source_size", "target", "taken", "first_shard"),
        "rows": result.select("doc_id", "copy", "source", "rank", "chunk", "size", "taken"),
        "slots": slots.select("shard", "source", "slot", "block"),
        "pieces": pieces.drop("rank", "row"),
    }


def _sql_digits(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"


def _sql_once(x: str, keys: str, turn: str) -> str:
    """SQL of one pass of the network over x, with columns high and low."""
    left, right = f"({x}) // low", f"({x}) % low"
    mixed = lambda v, k: f"(xor((({v}) * {keys}[{k}] + {keys}[{k + 1}] + {turn} * 7919) % {PRIME}, {keys}[{k + 2}]) * {keys}[{k + 3}] % {PRIME})"
    for s in range(STEPS):
        left = f"(({left} + {mixed(right, 8 * s + 1)}) % high)"
        right = f"(({right} + {mixed(left, 8 * s + 5)}) % low)"
    return f"({left} * low + {right})"


def _sql_keys(name: str) -> str:
    return f"[{', '.join(_sql_digits(f"'1:' || {name} || ':{i}'") for i in range(8 * STEPS))}]"


def _sql_permuted(name: str, source: str, x: str, n: str, keys: str, turn: str) -> str:
    """Tables name_g, name_w and name: source with y, the number that x goes to."""
    return f"""{name}_g AS (SELECT *, {x} AS x0, CAST(ceil({n} / ceil(sqrt({n}))) AS BIGINT) AS low, CAST(ceil(sqrt({n})) AS BIGINT) AS high, {keys} AS k, {turn} AS turn FROM {source}),
{name}_w(id, y, n, low, high, k, turn) AS (SELECT id, {_sql_once("x0", "k", "turn")}, {n}, low, high, k, turn FROM {name}_g
  UNION ALL SELECT id, {_sql_once("y", "k", "turn")}, n, low, high, k, turn FROM {name}_w WHERE y >= n),
{name} AS (SELECT s.*, w.y FROM {source} s JOIN {name}_w w USING (id) WHERE w.y < w.n)"""


ORACLE = rf"""
WITH RECURSIVE s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size, {_sql_digits("doc_id || ':1'")} AS draw FROM documents),
n AS (SELECT greatest(1, CAST(ceil(sqrt(count(*) / 8.0)) AS BIGINT)) AS n_chunks FROM s),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s GROUP BY source),
r AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, {REPEATS} * source_size AS cap FROM b),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT arg_min(level, rank) AS level FROM l WHERE cap / weight = (SELECT min(cap / weight) FROM l WHERE level * weight <= cap) AND level * weight <= cap),
t AS (SELECT source, rank, source_size, coalesce(least((SELECT level FROM f) * weight, CAST(cap AS DOUBLE)), 0) AS target, least({BLOCK}, greatest(1, source_size // {LEAST_BLOCKS})) AS length FROM r),
u AS (SELECT *, CAST(ceil(source_size / CAST(length AS DOUBLE)) AS BIGINT) AS n_blocks FROM t),
v0 AS (SELECT *, CASE WHEN source_size > 0 THEN least({REPEATS} * n_blocks, CAST(round(target * n_blocks / source_size) AS BIGINT)) ELSE 0 END AS n_slots FROM u),
v AS (SELECT *, CAST(coalesce(sum(n_slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_slot, CAST(sum(n_slots) OVER () AS BIGINT) AS all_slots, {_sql_keys("rank")} AS keys FROM v0),
e AS (SELECT rank, n_blocks, first_slot, all_slots, keys, slot, first_slot + slot AS id FROM (SELECT *, unnest(range(n_slots)) AS slot FROM v WHERE n_slots > 0)),
{_sql_permuted("bl", "e", "slot % n_blocks", "n_blocks", "keys", "slot // n_blocks")},
{_sql_permuted("sh", "e", "id", "all_slots", _sql_keys("'shards'"), "0")},
uses AS (SELECT bl.rank, bl.y AS block, count(*) AS uses, min(sh.y // {SHARD_SLOTS}) AS shard FROM bl JOIN sh USING (id) GROUP BY ALL),
p AS (SELECT doc_id, size, source_size, target, rank, length,
  CAST(coalesce(sum(size) OVER (PARTITION BY rank ORDER BY draw % n_chunks, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source, n),
k AS (SELECT doc_id, rank, block, least(a + size, (block + 1) * length) - greatest(a, block * length) AS words FROM (SELECT *, unnest(range(a // length, (a + size - 1) // length + 1)) AS block FROM p WHERE size > 0)),
taken AS (SELECT doc_id, CAST(sum(words * uses) AS BIGINT) AS taken, min(shard) AS first_shard FROM k JOIN uses USING (rank, block) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_shard FROM p LEFT JOIN taken USING (doc_id)
"""
