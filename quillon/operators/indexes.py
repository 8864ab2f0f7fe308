"""What indexes answer, as filters that reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: dict[str, object]) -> DataFrame:
    """Rows whose key columns equal the values; a value of None finds nulls."""
    out = df
    for name, value in key.items():
        out = out.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return out


def _order(columns: list[str], forward: bool) -> list[Column]:
    return [F.col(c).asc_nulls_first() if forward else F.col(c).desc_nulls_last() for c in columns]


def range_scan(df: DataFrame, columns: list[str], start: tuple | None = None, forward: bool = True, stop: tuple | None = None, ordered: bool = True) -> DataFrame:
    """Rows from the start key on, in key order: forward those not below it, backward those not above it.

    Keys compare column by column. stop: the last key wanted. Rows with a null in the key belong to an unbounded scan only.
    A bound on the first column is also given on its own, which the scan can use."""

    def bounded(out: DataFrame, bound: tuple, low: bool) -> DataFrame:
        first = F.col(columns[0])
        key = F.struct(*[F.col(c) for c in columns[: len(bound)]])
        edge = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, bound)])
        for c in columns[: len(bound)]:
            out = out.filter(F.col(c).isNotNull())
        out = out.filter(first >= F.lit(bound[0]) if low else first <= F.lit(bound[0]))
        return out.filter(key >= edge if low else key <= edge) if len(bound) > 1 else out

    out = df
    if start is not None:
        out = bounded(out, start, forward)
    if stop is not None:
        out = bounded(out, stop, not forward)
    return out.orderBy(*_order(columns, forward)) if ordered else out


def clustered(df: DataFrame, path: str, columns: list[str], parts: int) -> None:
    """Writes rows in key ranges, sorted, so that a scan skips files and row groups by their statistics."""
    df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).write.parquet(path)
