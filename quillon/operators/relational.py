"""Relational operators over DataFrames. Catalyst plans them; a join may name its strategy."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateObjectError

#: Strategy names and the hints that ask for them.
STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl", "broadcast": "broadcast"}


def project(df: DataFrame, *columns: Column | str, **named: Column) -> DataFrame:
    return df.select(*columns, *(c.alias(name) for name, c in named.items()))


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; null is not."""
    return df.filter(predicate)


def join(left: DataFrame, right: DataFrame, on: Column | None, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """A join on any predicate: inner, left, right, full, semi, anti; on None is a cross join.

    strategy: hash, merge, nested_loop or broadcast, for the right side. Left out, Catalyst and AQE choose."""
    if strategy:
        right = right.hint(STRATEGIES[strategy])
    if on is None:
        return left.crossJoin(right)
    return left.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def join_using(left: DataFrame, right: DataFrame, names: Iterable[str], how: str = "inner") -> DataFrame:
    """Equal columns of the same names; both sides' columns stay, the left ones first."""
    on = F.lit(True)
    for n in names:
        on = on & (left[n] == right[n])
    return left.join(right, on, how)


def join_null_safe(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """An equi-join in which null equals null, as index keys compare."""
    on = F.lit(True)
    for a, b in pairs:
        on = on & left[a].eqNullSafe(right[b])
    return left.join(right, on)


def aggregate(df: DataFrame, keys: Iterable[Column | str], *aggregates: Column, having: Column | None = None, empty_row: bool = True) -> DataFrame:
    """Groups and aggregates; empty_row False gives no row where a global aggregate has no input."""
    keys = list(keys)
    if not keys and not empty_row:
        out = df.agg(*aggregates, F.count(F.lit(1)).alias("_rows")).filter("_rows > 0").drop("_rows")
    else:
        out = df.groupBy(*keys).agg(*aggregates)
    return out if having is None else out.filter(having)


def count_rows() -> Column:
    return F.count(F.lit(1))


def sort(df: DataFrame, *keys: Column) -> DataFrame:
    """Null counts as least. Spark's sort is not stable: end the keys with a unique one."""
    return df.orderBy(*keys)


def sort_numbered(df: DataFrame, *keys: Column, name: str = "position") -> DataFrame:
    """Sorted rows with their place from 1. The sort deals ranges to tasks and each numbers its own; only the ranges'
    sizes, a number for each partition, meet on the driver. The sorted rows are materialized, so that both passes see the same."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise DuplicateObjectError(f"column {name}")
    # The low 33 bits of the id count rows inside a partition, the others are the partition.
    ordered = materialize(sort(df, *keys).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    first, starts = 1, []
    for p, n in sorted(ordered.groupBy(part.alias("p")).count().collect()):
        starts.append(F.when(part == p, F.lit(first)))
        first += n
    local = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn(name, F.coalesce(*starts, F.lit(0)) + local)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def top_n(df: DataFrame, n: int, *keys: Column, offset: int = 0) -> DataFrame:
    """Sort and limit in one operator (TakeOrderedAndProject): no task sorts all rows."""
    return limit(df.orderBy(*keys), n, offset)


def materialize(df: DataFrame) -> DataFrame:
    """Rows computed once and read many times, spilled to disk where memory is short; release() frees them."""
    return df.persist()


def release(df: DataFrame) -> None:
    df.unpersist()


def subquery(df: DataFrame, alias: str) -> DataFrame:
    return df.alias(alias)
