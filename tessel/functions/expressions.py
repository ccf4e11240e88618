"""Column expressions that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts joined by underscores: a hash that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *parts)), 1, 13), 16, 10).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters a-z and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of an array; the rank is rounded half to even."""
    ranked = F.array_sort(values)
    at = F.bround(F.lit(p) * (F.size(values) - 1)).cast("int")
    return F.when(F.size(values) > 0, F.element_at(ranked, at + 1))


def type_prefix(node: Column) -> Column:
    """The text before the first colon, empty if there is none."""
    return F.when(F.instr(node, ":") > 0, F.substring_index(node, ":", 1)).otherwise("")


def shortened(text: Column, most: int) -> Column:
    """Text of over ``most`` characters, cut and ended with three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def fragment_of(address: Column) -> Column:
    """The fragment of a row address: its upper 32 bits."""
    return F.shiftrightunsigned(address, 32)


def offset_of(address: Column) -> Column:
    """The place in the fragment of a row address: its lower 32 bits."""
    return address.bitwiseAND(F.lit(0xFFFFFFFF))


def row_address(fragment: Column, offset: Column) -> Column:
    return F.shiftleft(fragment.cast("long"), 32) + offset
