"""Token counts by field or section of a document.

A document is encoded once, as a whole (encoder.py says how). Each token's code points are then
interval-joined with the document's sections, in sorted arrays inside the batch,
and the token goes to one section by an explicit rule:

  first     the section that holds the token's first code point (default)
  last      the section that holds its last code point
  majority  the section that holds most of them, the earlier one on a tie

Sections are the document's lines (with their line feed), or the spans of a
column `sections` array<struct<start:int,end:int>> (code points, end exclusive,
sorted and disjoint, each non-empty). Tokens in no section count under section -1.

Rows: null text is empty; a document without sections yields one row for section
-1; a null doc_id and repeated rows are documents of their own; other columns
are ignored; no rows give no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import text_slices
from voxmill.llm.encoder import Encoder, tokenizer_path

RULES = ("first", "last", "majority")
RESULT = "doc_id long, section int, start int, end int, n_tokens long, n_crossing long"


def _lines(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and end code point of every line."""
    raw, bounds, points = found["raw"], found["text_bounds"], found["points"]
    ends = np.union1d(np.flatnonzero(raw == 10) + 1, bounds[1:])
    ends = ends[ends > 0]
    owner = np.searchsorted(bounds, ends, "left") - 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    base = points[bounds[owner]]
    return owner, points[starts] - base, points[ends] - base


def _given(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = column.to_pylist()
    owner = np.array([i for i, x in enumerate(rows) for _ in x or ()], np.int64)
    return owner, np.array([s["start"] for x in rows for s in x or ()], np.int64), np.array([s["end"] for x in rows for s in x or ()], np.int64)


def attribute(lo, hi, token_owner, owner, start, end, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The row of (owner, start, end) that each token goes to, or -1; and whether
    the token has code points outside it. Tokens and sections are sorted by owner
    and place; a key of owner and place makes that one sorted axis."""
    wide = int(max(hi.max(initial=0), end.max(initial=0))) + 2
    s, e = owner * wide + start, owner * wide + end
    a, b = token_owner * wide + lo, token_owner * wide + hi

    def holder(point: np.ndarray) -> np.ndarray:
        at = np.searchsorted(s, point, "right") - 1
        return np.where((at >= 0) & (point < e[at]) if len(e) else False, at, -1)

    first, last = holder(a), holder(np.maximum(b - 1, a))
    if rule == "first":
        to = first
    elif rule == "last":
        to = last
    else:
        inside = lambda at: np.where(at >= 0, np.minimum(b, e[at]) - np.maximum(a, s[at]), 0) if len(e) else np.zeros(len(a))
        to = np.where(inside(last) > inside(first), last, first)
        many = np.flatnonzero((first != last) & (np.searchsorted(s, b, "left") - np.searchsorted(e, a, "right") > 2))
        for i in many.tolist():  # a token over three sections or more
            x, y = np.searchsorted(e, a[i], "right"), np.searchsorted(s, b[i], "left")
            share = np.minimum(b[i], e[x:y]) - np.maximum(a[i], s[x:y])
            to[i] = x + int(np.argmax(share))
    return to, (to >= 0) & ((a < s[to]) | (b > e[to])) if len(e) else np.zeros(len(a), bool)


def _count(path: str, rule: str, given: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, spans=True)
        for batch in batches:
            for piece in text_slices(batch):
                found = encoder.encode(piece.column("text"))
                n = piece.num_rows
                owner, start, end = _given(piece.column("sections")) if given else _lines(found)
                own = np.repeat(np.arange(n), np.diff(found["bounds"]))
                to, crossing = attribute(found["lo"], found["hi"], own, owner, start, end, rule)
                counts = np.bincount(to[to >= 0], minlength=len(owner))
                crossed = np.bincount(to[crossing], minlength=len(owner))
                outside = np.bincount(own[to < 0], minlength=n)
                extra = np.flatnonzero((outside > 0) | (np.bincount(owner, minlength=n) == 0))
                rank = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
                row = np.concatenate([owner, extra]).astype(np.int64)
                pad = lambda x, v: np.concatenate([x, np.full(len(extra), v)])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(row)), pa.array(pad(rank, -1), pa.int32()), pa.array(pad(start, 0), pa.int32()), pa.array(pad(end, 0), pa.int32()), pa.array(np.concatenate([counts, outside[extra]]), pa.int64()), pa.array(pad(crossed, 0), pa.int64())], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return count


def token_counts(docs: DataFrame, tokenizer: str | None = None, rule: str = "first") -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = "sections" in docs.columns
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns, *["sections"] * given).mapInArrow(_count(tokenizer or tokenizer_path(), rule, given), RESULT)
