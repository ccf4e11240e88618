"""Row ids, filters and ordered picks."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import fragment_of, offset_of, row_address
from ..functions.numbering import numbered

#: Lists up to this length become an IN filter, longer ones a join.
IN_LIST = 1000


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Dense row ids in a total order; keep the column, and updates keep the ids."""
    return numbered(df, order, name)


def take(df: DataFrame, ids: list[int], row_id: str = "row_id") -> DataFrame:
    """Rows with the given ids, each once however often it is asked for."""
    wanted = sorted(set(ids))
    if len(wanted) <= IN_LIST:
        return df.where(F.col(row_id).isin(wanted)) if wanted else df.where(F.lit(False))
    return df.join(df.sparkSession.createDataFrame([(i,) for i in wanted], f"{row_id} long"), row_id, "left_semi")


def take_in_order(df: DataFrame, ids: list[int], row_id: str = "row_id") -> DataFrame:
    """A row for each asked id, with its place ``pos`` in the request."""
    asked = df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {row_id} long")
    return asked.join(df, row_id)


def take_offsets(df: DataFrame, offsets: list[int], order: list[str]) -> DataFrame:
    """Rows at places of the given order; a place out of range raises."""
    n = df.count()
    if bad := [o for o in offsets if not 0 <= o < n]:
        raise IndexError(f"offsets {bad} are outside 0..{n - 1}")
    return take(with_row_id(df, order, "offset"), offsets, "offset")


def decoded(df: DataFrame, address: str) -> DataFrame:
    return df.withColumn("fragment", fragment_of(F.col(address))).withColumn("offset", offset_of(F.col(address)))


def addressed(fragments: list[DataFrame], order: list[str]) -> DataFrame:
    """Appended fragments as one table with row addresses: fragment number and place in it."""
    parts = [numbered(f, order, "__at").withColumn("row_address", row_address(F.lit(k), F.col("__at"))).drop("__at") for k, f in enumerate(fragments)]
    return functools.reduce(DataFrame.unionByName, parts)


def compacted(df: DataFrame, fragment: int, address: str = "row_address") -> DataFrame:
    """The rows that are left, rewritten as one fragment with dense places."""
    return numbered(df, [address], "__at").withColumn(address, row_address(F.lit(fragment), F.col("__at"))).drop("__at")


def point(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def equal_all(df: DataFrame, **values) -> DataFrame:
    return df.where(functools.reduce(operator.and_, [F.col(k) == F.lit(v) for k, v in values.items()], F.lit(True)))


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is listed; an empty list gives none."""
    unique = list(dict.fromkeys(values))
    if not unique:
        return df.where(F.lit(False))
    if len(unique) <= IN_LIST:
        return df.where(F.col(column).isin(unique))
    return df.join(df.sparkSession.createDataFrame([(v,) for v in unique], df.select(column).schema), column, "left_semi")


def half_open(df: DataFrame, column: str, lo, hi) -> DataFrame:
    return df.where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi)))


_COMPARE = {"$gte": operator.ge, "$lte": operator.le, "$gt": operator.gt, "$lt": operator.lt}


def predicate(where: dict | None) -> Column:
    """{column: value} or {column: {"$gte": n, ...}} to a conjunction; other types raise."""
    out = F.lit(True)
    for name, want in (where or {}).items():
        if isinstance(want, dict):
            for op, value in want.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown comparison {op!r}")
                if not isinstance(value, int) or isinstance(value, bool):
                    raise TypeError(f"{op} takes a whole number, not {value!r}")
                out = out & _COMPARE[op](F.col(name), F.lit(value))
        elif isinstance(want, (str, int)) and not isinstance(want, bool):
            out = out & (F.col(name) == F.lit(want))
        else:
            raise TypeError(f"cannot filter {name} by {want!r}")
    return out


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in order."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def evenly_spaced(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """About ``n`` rows at an even step through the order."""
    total = df.count()
    step = max(1, total // n)
    got = numbered(df, order, "__at")
    return got.where((F.col("__at") % step == 0) & (F.expr(f"__at div {step}") < n)).drop("__at")
