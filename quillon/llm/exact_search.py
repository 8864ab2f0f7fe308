"""Exact top-k by inner product with a KD-tree for each shard.

Vectors are dealt to shards of about SHARD rows by a hash of their ids. A shard's tree splits at the median of the
widest dimension down to LEAF rows; each node has a tight bounding box. The largest inner product that a box
allows a query is the sum of the larger of q * low and q * high; nodes are visited best first, and a
subtree goes unseen once that bound is under the k-th score so far. Queries travel to the trees in blocks. Each block first
searches one shard; the k-th scores found there travel with it to all other shards. CHUNK blocks share one copy of a
tree, which is read once for them; every query meets every shard, as an exact search must, and what leaves a shard is
at most k rows for each query.

Scores are exact integers: components are floor(scale * x), and products are computed in double precision
where all sums stay under 2**53, else in Python's integers (scores beyond a long are set to its limits).

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows without an id
take no part. Rows that repeat an id with the same vector count once; an id with several vectors asks for each of them, and
is found once for each of them. A vector of any length is searched whole. Vectors of different lengths do
not meet. Ties go to the smaller id. An empty table gives an empty result; other columns do no harm.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_arrow

SHARD, LEAF, QUERIES, TOGETHER = 16_384, 64, 512, 8
#: Blocks of queries that visit a tree one after the other: about the tree's own size.
CHUNK = 8
#: Tasks of a search have a chunk each, up to this many tasks.
MOST_PARTITIONS = 100_000


def quantised(scale: float):
    """(vec_id, array of doubles) to (vec_id, size, components as bytes) of the vectors that take part."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lists = batch.column(1)
            if not len(lists):
                continue
            values, offsets = np.asarray(lists.values.fill_null(np.nan), np.float64), np.asarray(lists.offsets, np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * values)
            out: tuple[list, ...] = ([], [], [])
            ids = batch.column(0).to_pylist()
            for k in np.flatnonzero(np.asarray(pc.and_(batch.column(0).is_valid(), lists.is_valid()))):
                v = whole[offsets[k] : offsets[k + 1]]
                if len(v) and np.isfinite(v).all():
                    for column, x in zip(out, (ids[k], len(v), v.tobytes())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary()))], ["vec_id", "size", "vector"])

    return run


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


@dataclass
class Tree:
    ids: np.ndarray  # in the order of the leaves
    vectors: np.ndarray  # whole numbers as doubles
    low: np.ndarray  # bounding boxes, a row for each node
    high: np.ndarray
    first: np.ndarray  # rows of each node
    last: np.ndarray
    left: np.ndarray  # children, -1 for leaves
    right: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.arange(len(ids))
    low, high, first, last, left, right = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        own = vectors[order[a:b]]
        k = len(low)
        low.append(own.min(0))
        high.append(own.max(0))
        first.append(a)
        last.append(b)
        left.append(-1)
        right.append(-1)
        return k

    waiting = [node(0, len(ids))]
    while waiting:
        k = waiting.pop()
        a, b = first[k], last[k]
        wide = high[k] - low[k]
        if b - a <= leaf or not wide.any():  # equal vectors need no split
            continue
        middle = (a + b) // 2
        own = order[a:b]
        order[a:b] = own[np.argpartition(vectors[own, int(wide.argmax())], middle - a)]
        left[k], right[k] = node(a, middle), node(middle, b)
        waiting += [left[k], right[k]]
    whole = lambda x: np.array(x, np.int64)
    return Tree(ids[order], vectors[order], np.array(low), np.array(high), whole(first), whole(last), whole(left), whole(right))


_LONG = (-(1 << 63), (1 << 63) - 1)


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries, ids and scores: for each query its k best rows that reach its bound, its own id left out.

    bounds: a score that k other rows have reached elsewhere, or -inf."""
    safe = len(tree.ids) and np.abs(queries).max() * max(np.abs(tree.low).max(), np.abs(tree.high).max()) * queries.shape[1] < 2.0**53
    if not safe:  # exact at any size, without the tree's bounds
        vectors = np.array([[int(x) for x in v] for v in tree.vectors], object)
    above = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T  # what each box allows
    out_q, out_id, out_score = [], [], []
    for q in range(len(queries)):
        if not safe:
            scores = np.array([min(max(int(x), _LONG[0]), _LONG[1]) for x in vectors @ np.array([int(x) for x in queries[q]], object)], np.int64)
            own = tree.ids != ids[q]
            found, names = scores[own], tree.ids[own]
            top = np.lexsort((names, -found.astype(object)))[:k] if len(found) else np.zeros(0, int)
            found, names = found[top], names[top]
        else:
            found, names, worst = np.zeros(0), np.zeros(0, np.int64), bounds[q]
            bound = above[q]
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= worst:
                leaves = []
                while heap and len(leaves) < TOGETHER and -heap[0][0] >= worst:
                    _, n = heapq.heappop(heap)
                    if tree.left[n] < 0:
                        leaves.append(n)
                    else:
                        for child in (int(tree.left[n]), int(tree.right[n])):
                            if bound[child] >= worst:
                                heapq.heappush(heap, (-bound[child], child))
                if not leaves:  # a box allowed what none of its parts does
                    break
                rows = np.concatenate([np.arange(tree.first[n], tree.last[n]) for n in leaves])
                scores = tree.vectors[rows] @ queries[q]
                good = (scores >= worst) & (tree.ids[rows] != ids[q])
                if good.any():
                    found, names = np.concatenate([found, scores[good]]), np.concatenate([names, tree.ids[rows[good]]])
                    if len(found) >= k:
                        top = np.lexsort((names, -found))[:k]
                        found, names = found[top], names[top]
                        worst = max(worst, found[-1])
            top = np.lexsort((names, -found))[:k]
            found, names = found[top].astype(np.int64), names[top]
        out_q.append(np.full(len(found), q))
        out_id.append(names)
        out_score.append(found)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_id]), np.concatenate([none, *out_score]).astype(np.int64)


def plant(key, held):
    """A shard's rows to one row with its tree."""
    tree = build(held["vec_id"].to_numpy(), _matrix(held["vector"], held["size"][0].as_py()))
    small = np.int16 if len(tree.ids) and max(np.abs(tree.low).max(), np.abs(tree.high).max()) < 32_768 else np.float64
    parts = [tree.ids, tree.vectors.astype(small), tree.low, tree.high, tree.first, tree.last, tree.left, tree.right]
    return pa.table({"size": held["size"].slice(0, 1), "shard": held["shard"].slice(0, 1), "tree": pa.array([pickle.dumps(parts)], pa.binary())})


def gathered(key, held):
    """A block's queries to one row."""
    queries = _matrix(held["vector"], held["size"][0].as_py())
    small = np.int16 if np.abs(queries).max() < 32_768 else np.float64
    parts = [held["vec_id"].to_numpy(), queries.astype(small), held["bound"].to_numpy()]
    return pa.table({"size": held["size"].slice(0, 1), "block": held["block"].slice(0, 1), "queries": pa.array([pickle.dumps(parts)], pa.binary())})


def visit(k: int):
    """Rows (place, held), a tree at place 0 and blocks of queries after it, to (query_id, vec_id, score)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in rows:
            for place, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = pickle.loads(held.as_buffer())
                parts[1] = parts[1].astype(np.float64)
                if place == 0:
                    tree = Tree(*parts)
                    continue
                ids, queries, bounds = parts
                q, names, scores = search(tree, ids, queries, bounds, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(names), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, vec_id long, score long"


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(embeddings: DataFrame, scratch: Scratch, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `every`."""
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.write(in_arrow(source, quantised(scale), "vec_id long, size int, vector binary").dropDuplicates(), "vectors")
    spark = scratch.spark
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")).collect()
    plan = [(s, max(1, -(-n // SHARD)), max(1, -(-asked // QUERIES))) for s, n, asked in sizes]
    counts = F.broadcast(spark.createDataFrame(plan, "size int, shards int, blocks int"))
    dealt = rows.join(counts, "size").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"))
    trees = scratch.write(dealt.select("size", "shard", "vec_id", "vector").groupBy("size", "shard").applyInArrow(plant, "size int, shard int, tree binary"), "trees")
    asked = dealt.filter(F.col("vec_id") % every == 0).select("size", "shards", "block", "vec_id", "vector")

    def sent(queries: DataFrame) -> DataFrame:
        own = queries.select("size", "block", "vec_id", "vector", "bound").groupBy("size", "block").applyInArrow(gathered, "size int, block int, queries binary")
        return own.join(counts, "size").select("size", "block", "shards", "queries")

    def searched(pairs: DataFrame, blocks_each, name: str) -> DataFrame:
        """pairs: size, shard, block, turn (its number among the blocks of the shard), queries; blocks_each: the number of turns."""
        chunks = sum(s * max(1, -(-blocks_each(s, b) // CHUNK)) for _, s, b in plan)
        copies = F.sequence(F.lit(0), F.floor((F.greatest(F.col("turns"), F.lit(1)) - 1) / CHUNK).cast("int"))
        turns = F.broadcast(spark.createDataFrame([(size, blocks_each(s, b)) for size, s, b in plan], "size int, turns int"))
        planted = trees.join(turns, "size").select("size", "shard", F.explode(copies).alias("chunk"), F.lit(0).alias("place"), F.col("tree").alias("held"))
        sent = pairs.select("size", "shard", F.floor(F.col("turn") / CHUNK).cast("int").alias("chunk"), (F.col("turn") + 1).cast("int").alias("place"), F.col("queries").alias("held"))
        met = planted.unionByName(sent).repartition(max(1, min(chunks, MOST_PARTITIONS)), "size", "shard", "chunk").sortWithinPartitions("size", "shard", "chunk", "place")
        return scratch.write(in_arrow(met.select("place", "held"), visit(k), FOUND), name)

    home = F.pmod(F.col("block"), F.col("shards")).cast("int")
    blocks = sent(asked.withColumn("bound", F.lit(float("-inf"))))
    # Blocks 0, s, 2 s ... have shard 0 of s as their home.
    first = searched(blocks.withColumn("shard", home).withColumn("turn", F.floor(F.col("block") / F.col("shards"))), lambda s, b: -(-b // s), "home")
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(None).cast("double").alias("bound"))
    known = asked.join(bounds.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    others = sent(known).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).filter(F.col("shard") != home)
    rest = searched(others.withColumn("turn", F.col("block")), lambda s, b: b, "rest")
    return best(first.union(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
