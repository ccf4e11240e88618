"""Pattern matches with their places, as DataFrame expressions.

Places are code points, ends exclusive. A text is cut at the matches of a
pattern and the matches are listed; both come from the same leftmost
non-overlapping search, so running lengths give the places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,rank:int,kind:string,found:string>"


def matches(text: Column, pattern: str, kind: str, rank: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """The matches of a Java pattern that ``valid`` lets pass, as an array of SPAN."""
    none = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["gap"])
        end = (first + F.length(x["found"])).cast("bigint")
        span = F.struct(first.cast("bigint").alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    if valid is not None:
        spans = F.filter(spans, lambda s: valid(s["found"]))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def ordered(*spans: Column) -> Column:
    """Spans of several kinds by start, then kind as ranked."""
    return F.array_sort(F.concat(*spans), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"]))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with each span replaced; a span that begins inside an earlier one goes with it."""
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] + 1 >= acc["at"]
        part = F.array(F.substring(text, acc["at"].cast("int"), (s["start"] + 1 - acc["at"]).cast("int")), by(s))
        return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), F.when(fresh, F.concat(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    def last(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"].cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, last)).otherwise(text)
