"""INSERT, UPDATE and DELETE as functions from a table to its next version and the number of rows affected.

All expressions see the version before, so no statement meets its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoSuchObjectError, TypeMismatchError, UnsupportedError


def arranged(table: DataFrame, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows under the table's columns: by position, or the listed columns, the others null."""
    names = columns or table.columns
    if len(names) != len(rows.columns):
        raise TypeMismatchError(f"{len(rows.columns)} values for {len(names)} columns")
    places = {}
    for name, source in zip(names, range(len(names))):
        match = [c for c in table.columns if c.lower() == name.lower()]
        if not match:
            raise NoSuchObjectError(f"column {name}")
        places[match[0]] = source
    rows = rows.toDF(*[f"_{k}" for k in range(len(names))])
    return rows.select(*[(F.col(f"_{places[f.name]}") if f.name in places else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])


def insert(table: DataFrame, rows: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    new = arranged(table, rows, columns)
    return table.unionByName(new), new.agg(F.count(F.lit(1)).alias("affected"))


def _true(table: DataFrame, predicate: Column | None) -> Column:
    """Whether the predicate holds; a number holds unless it is 0, null never does."""
    if predicate is None:
        return F.lit(True)
    if isinstance(table.select(predicate.alias("p")).schema["p"].dataType, T.NumericType):
        predicate = predicate != 0
    return F.coalesce(predicate, F.lit(False))


def update(table: DataFrame, assignments: dict[str, Column], predicate: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """New values come from the old row, whatever the order of the assignments."""
    unknown = {a.lower() for a in assignments} - {c.lower() for c in table.columns}
    if unknown:
        raise NoSuchObjectError(f"column {sorted(unknown)[0]}")
    hit, new = _true(table, predicate), {k.lower(): v for k, v in assignments.items()}
    out = table.select(*[F.when(hit, new[f.name.lower()].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name.lower() in new else F.col(f.name) for f in table.schema])
    return out, table.filter(hit).agg(F.count(F.lit(1)).alias("affected"))


def delete(table: DataFrame, predicate: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows for which the predicate is true go, the first `limit` of them in `order` if given; null keeps a row."""
    hit = _true(table, predicate)
    if limit is None:
        return table.filter(~hit), table.filter(hit).agg(F.count(F.lit(1)).alias("affected"))
    if not order:
        raise UnsupportedError("a limit on DELETE needs an order")
    # Equal rows can't be told apart, so of each kind only the number that goes matters. Only the rows that equal one of
    # the few that go are grouped; all others pass a join with these.
    gone = table.filter(hit).orderBy(*order, *[F.col(c) for c in table.columns]).limit(limit)
    names = [f"_{k}" for k in range(len(table.columns))]
    kinds = gone.toDF(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("_gone"))
    same = F.lit(True)
    for c, name in zip(table.columns, names):
        same = same & F.col(f"t.`{c}`").eqNullSafe(F.col(f"k.{name}"))
    equal = table.alias("t").join(kinds.alias("k"), same).groupBy(*names).agg((F.count(F.lit(1)) - F.first("_gone")).cast("int").alias("_left"))
    equal = equal.filter("_left > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_left")))).select(*names)
    return table.alias("t").join(kinds.alias("k"), same, "left_anti").union(equal), gone.agg(F.count(F.lit(1)).alias("affected"))
