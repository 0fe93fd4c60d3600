"""Small text and number functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v)), lambda v: v != "")


def parse_ranges(text: Column) -> Column:
    """`start:end[v1,v2],start[v]` to an array of (lo, hi, values): no colon means one
    point, no start 0, no end an open range (null). A range's values end at the first
    closing bracket. No bracket, no ranges; an opening one without a closing one, and
    a bound that is no number, are errors."""
    block = r"([^\[]*\[[^\]]*\])"
    parts = F.regexp_extract_all(text, F.lit(block), F.lit(1))

    def one(part: Column) -> Column:
        head = F.trim(F.regexp_replace(F.substring_index(part, "[", 1), r"^[,\s]+", ""))
        values = split_list(F.regexp_extract(part, r"\[([^\]]*)\]", 1))
        lo, hi = F.trim(F.substring_index(head, ":", 1)), F.trim(F.regexp_extract(head, r":(.*)$", 1))
        low = F.coalesce(F.nullif(lo, F.lit("")).cast("long"), F.lit(0).cast("long"))
        return F.struct(low.alias("lo"), F.when(F.contains(head, F.lit(":")), F.nullif(hi, F.lit("")).cast("long")).otherwise(low).alias("hi"), values.alias("values"))

    unmatched = F.contains(F.regexp_replace(text, block, ""), F.lit("["))
    return F.when(unmatched, F.raise_error(F.concat(F.lit("a bracket is not closed: "), text))).otherwise(F.transform(parts, one))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def compression(name: Column) -> Column:
    """TIFF codes by name (all lower or all upper case) or digit; others are none (1)."""
    fixed = {"none": 1, "lzw": 5, "deflate": 8, "zip": 8}
    out = F.when(name.isin("1", "5", "8"), name.try_cast("int"))
    for k, v in fixed.items():
        out = out.when(name.isin(k, k.upper()), v)
    return out.otherwise(1)


def description(text: Column) -> Column:
    """key=value lines to a map."""
    return F.str_to_map(text, F.lit("\n"), F.lit("="))


def shape_text(w: Column, h: Column, d: Column) -> Column:
    return F.format_string("%d x %d x %d", w, h, d)


def choice(key: Column, names: list[str]) -> Column:
    """The number of a name in a list; unknown names are the first."""
    return F.greatest(F.array_position(F.array(*map(F.lit, names)), key) - 1, F.lit(0))


def smooth_numbers(most: int) -> list[int]:
    """All products of powers of 2, 3 and 5 up to most, ascending."""
    out = [1]
    for p in (2, 3, 5):
        for n in list(out):
            while (n := n * p) <= most:
                out.append(n)
    return sorted(out)


def next_smooth(n: Column, most: int) -> Column:
    return F.when(n <= 1, n).otherwise(F.array_min(F.filter(F.array(*map(F.lit, smooth_numbers(2 * most))), lambda s: s >= n)))


def previous_smooth(n: Column, most: int) -> Column:
    return F.when(n <= 1, n).otherwise(F.array_max(F.filter(F.array(*map(F.lit, smooth_numbers(most))), lambda s: s < n)))


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n)))).cast("long")


def ceiling_divide(a: Column, b: Column) -> Column:
    return ((a + b - 1) / b).cast("long")
