"""From a join graph over DataFrames to Spark joins in the order and by the algorithms that the search chose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cost import DEFAULT_BUFFERS, JoinGraph, Plan, Predicate, best_plan, explain

#: Broadcast hints are given up to this many bytes, shuffled hash tables up to this many in each partition.
BROADCAST_BYTES = HASHED_BYTES = 64 << 20


@dataclass
class Input:
    name: str
    df: DataFrame
    indexes: tuple[tuple[str, ...], ...] = ()
    rows: int | None = None


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size; it runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Size:
    """At most so many rows and bytes: counted for an input, and the product of both sides for a join, whatever its keys."""

    def __init__(self, rows: int, df: DataFrame | None = None, width: int = 0):
        self.rows, self.width, least = rows, width, 0
        if df is not None:
            self.width, least = df._jdf.schema().defaultSize(), estimated_bytes(df)
        self.bytes = max(rows * self.width, least)

    def joined(self, other: Size) -> Size:
        return Size(self.rows * other.rows, width=self.width + other.width)


@dataclass(frozen=True)
class Hint:
    name: str
    right: bool  # for the side that is joined; else for what was there before


def join_hint(algorithm: str, left: Size, right: Size, partitions: int = 1) -> Hint | None:
    """The hint for a join: the smaller side is sent whole where it is certain to be small, or hashed where its
    partitions are. Without a hint the engine decides while the query runs, by the sizes that it meets."""
    small, on_right = (right, True) if right.bytes <= left.bytes else (left, False)
    if algorithm == "SortMergeJoin":
        return Hint("merge", True)
    if algorithm in ("HashJoin", "IndexNestedLoopJoin") and small.bytes <= BROADCAST_BYTES:
        return Hint("broadcast", on_right)
    if algorithm == "HashJoin" and small.bytes <= HASHED_BYTES * partitions:
        return Hint("shuffle_hash", on_right)
    return None


class JoinQuery:
    """Inner joins of several inputs. on(a, x, b, y) asks for a.x = b.y; where(...) for anything else, after all joins."""

    def __init__(self, *inputs: Input, buffers: int = DEFAULT_BUFFERS, sorted_inputs: bool = False):
        self.inputs, self.buffers, self.sorted_inputs = list(inputs), buffers, sorted_inputs
        self.links: list[tuple[int, str, int, str]] = []
        self.rest: list[Column] = []

    def _position(self, name: str) -> int:
        return next(k for k, x in enumerate(self.inputs) if x.name == name)

    def on(self, a: str, x: str, b: str, y: str) -> JoinQuery:
        self.links.append((self._position(a), x, self._position(b), y))
        return self

    def where(self, predicate: Column) -> JoinQuery:
        self.rest.append(predicate)
        return self

    def graph(self) -> JoinGraph:
        """Sizes are counts of the inputs, unless given."""
        unknown = [i for i in self.inputs if i.rows is None]
        if unknown:  # one job for all of them
            counts = None
            for k, i in enumerate(unknown):
                own = i.df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
                counts = own if counts is None else counts.union(own)
            for k, n in counts.collect():
                unknown[k].rows = n
        predicates = [Predicate(a, b, True, x, y) for a, x, b, y in self.links]
        return JoinGraph([i.name for i in self.inputs], [i.rows for i in self.inputs], predicates, {k: list(i.indexes) for k, i in enumerate(self.inputs) if i.indexes}, self.buffers, self.sorted_inputs)

    def plan(self) -> Plan | None:
        return best_plan(self.graph())

    def explain(self) -> str:
        graph = self.graph()
        return explain(graph, best_plan(graph))

    def dataframe(self, reorder: bool = True) -> DataFrame:
        """All columns of all inputs, in the order of the inputs, whatever the order of the joins."""
        names = [(i.name, c) for i in self.inputs for c in i.df.columns]
        sides = {k: i.df.alias(i.name) for k, i in enumerate(self.inputs)}
        plan = self.plan() if reorder else None
        if plan is None:
            steps = [(k, None) for k in range(len(self.inputs))]
        else:
            steps = [(plan.order()[0], None), *((s.right, s.algorithm) for s in plan.steps())]
        (first, _), *others = steps
        out, known = sides[first], 1 << first
        sizes = [Size(i.rows, i.df) for i in self.inputs] if plan is not None else None
        size = sizes[first] if sizes else None
        partitions = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        for table, algorithm in others:
            right = sides[table]
            links = [(a, x, b, y) for a, x, b, y in self.links if Predicate(a, b).joins(known, table)]
            if algorithm is not None:
                hint = join_hint(algorithm, size, sizes[table], partitions)
                if hint is not None and hint.right:
                    right = right.hint(hint.name)
                elif hint is not None:
                    out = out.hint(hint.name)
                size = size.joined(sizes[table])
            if links:
                on = F.lit(True)
                for a, x, b, y in links:
                    on = on & (F.col(f"{self.inputs[a].name}.{x}") == F.col(f"{self.inputs[b].name}.{y}"))
                out = out.join(right, on)
            else:
                out = out.crossJoin(right)
            known |= 1 << table
        for predicate in self.rest:
            out = out.filter(predicate)
        return out.select(*[F.col(f"{t}.{c}") for t, c in names])
