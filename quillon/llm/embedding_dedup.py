"""Near-duplicate embeddings by sorted projection passes.

1. Vectors with the same label and the same components form a class; one vector stands for it.
2. Each pass orders the vectors of a label by the concatenated signs of random projections and compares
   each one with the WINDOW vectors after it, across the borders of partitions too. The number of
   passes follows from the largest label: where its vectors point in all directions, a pair at the threshold stays
   unseen with probability `miss`. Only what is verified in double precision links, and a partition reports its
   links as a forest.
3. Each pass tells from the sorted codes how many signs a vector must share with another before the window holds
   all that share them. Vectors for which this leaves a partner at the threshold unseen with more than `miss` (many of
   a label in one cone, or near the borders of partitions too often) meet all others of that kind in blocks.
4. Components by alternating large-star and small-star.
5. Windows see a few partners of each vector only, so the links are counted anew, whole: inside each component
   all its vectors meet in blocks, and only counts leave a block.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those without
a label or an id, link with nothing (n_links 0, component_id their own id, kept true). Vectors of different
lengths never link, nor do 0.0 and -0.0 make one class. Rows that repeat an id with the same vector count once and are all
returned. An id with several vectors is all of them: it has the links of the one with most, and the smallest of their
components. A vector of any length is compared whole.
An empty table gives an empty result; other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forest, in_arrow, in_blocks

WINDOW, BITS, BLOCK = 64, 62, 4096
#: Rows of a block that meet another block at once.
ROWS = 512


def vectors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, array of numbers) to (vec_id, label, size, bytes) of the vectors that can link: floats as floats, all
    else as doubles. Lengths tell the two apart."""
    for batch in rows:
        kind = np.float32 if pa.types.is_float32(batch.column(2).type.value_type) else np.float64
        lists = batch.column(2)
        if not len(lists):
            continue
        values, offsets = np.asarray(lists.values.fill_null(np.nan), kind), np.asarray(lists.offsets, np.int64)
        good = np.asarray(pc.and_(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()), lists.is_valid())).copy()
        out: tuple[list, ...] = ([], [], [], [])
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k in np.flatnonzero(good):
            v = values[offsets[k] : offsets[k + 1]]
            if len(v) and np.isfinite(v).all() and v.any():
                for column, x in zip(out, (ids[k], labels[k], len(v), v.tobytes())):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["vec_id", "label", "size", "vector"])


def unit(column: pa.Array, size: int) -> np.ndarray:
    """Rows of length 1, in double precision."""
    raw = b"".join(column.to_pylist())
    v = np.frombuffer(raw, np.float32 if len(raw) == 4 * size * len(column) else np.float64).reshape(-1, size).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # very large and very small components keep their precision
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def projected(passes: int, seed: int):
    """(class_id, label, size, vector, most) to a row for each pass, with the signs as one number."""

    def project(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in rows:
            sizes = np.asarray(batch.column(2))
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                v = unit(own.column(3), int(size))
                for number in range(passes):
                    if (size, number) not in planes:
                        planes[size, number] = np.random.Generator(np.random.PCG64([seed, int(size), number])).standard_normal((int(size), BITS))
                    code = ((v @ planes[size, number]) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), number, np.int32)), *own.columns[1:3], pa.array(code), own.column(0), own.column(3), own.column(4)], ["pass", "label", "size", "code", "class_id", "vector", "most"])

    return project


def window_links(v: np.ndarray, window: int, threshold: float, reach: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions at most `window` apart whose cosine meets the threshold; reach: only across that position."""
    ones, twos = [], []
    step = 4 * window
    for first in range(0, len(v), step):
        near = v[first : first + step + window]
        i, j = np.nonzero(v[first : first + step] @ near.T >= threshold)
        keep = (j > i) & (j - i <= window)
        i, j = i[keep] + first, j[keep] + first
        if reach is not None:
            across = (i < reach) & (j >= reach)
            i, j = i[across], j[across]
        ones.append(i)
        twos.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *ones]), np.concatenate([none, *twos])


#: Signs beyond log2(vectors of the label / window) that a pass may need and still count: in a cone most signs part
#: nobody, and those that do part its close pairs more often than the formula has it.
SPARE = 2


def depths(group: np.ndarray, code: np.ndarray, window: int) -> np.ndarray:
    """Signs that each vector must share with another, so that all that share them are at most `window` places away.

    group: numbers that rise where a pass, label or size ends; codes are in order inside a group. BITS + 1: even the
    whole code does not do, or the group may go on before the first or after the last row."""
    far, n = window + 1, len(code)
    before, after = np.where(group == group[:1], BITS, -1), np.where(group == group[-1:], BITS, -1)
    if n > far:
        odd = code[far:] ^ code[:-far]
        high = odd >> np.int64(31)
        length = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 31, np.frexp((odd & np.int64((1 << 31) - 1)).astype(np.float64))[1])
        shared = np.where(group[far:] == group[:-far], BITS - length, -1)
        before[far:], after[:-far] = shared, shared
    return np.maximum(before, after) + 1


#: a, b: a link; seen, unseen: a vector and the logarithm of the probability that a pass leaves a partner of it unseen; part, side, place and the rest: a vector near a border (side 0 first, 1 last).
FOUND = "a long, b long, seen long, unseen double, part long, side int, place int, pass int, label long, size int, class_id long, vector binary"
FOUND_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("seen", pa.int64()), ("unseen", pa.float64()), ("part", pa.int64()), ("side", pa.int32()), ("place", pa.int32()), ("pass", pa.int32()), ("label", pa.int64()), ("size", pa.int32()), ("class_id", pa.int64()), ("vector", pa.binary())])


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in FOUND_SCHEMA], schema=FOUND_SCHEMA)


def compare(window: int, threshold: float):
    """Sorted rows of a partition to links, to what the windows leave unseen and to the vectors near its borders."""
    far, same = window + 1, 1 - np.arccos(threshold) / np.pi

    def links_of(held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = held["class_id"].to_numpy()
        group = np.column_stack([held["pass"].to_numpy(), held["label"].to_numpy(), held["size"].to_numpy()])
        cut = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, [len(ids)]])
        a, b = [], []
        for first, last in zip(cut[:-1], cut[1:]):
            if last - first > 1:
                v = unit(held["vector"].slice(first, last - first), int(group[first, 2]))
                one, two = window_links(v, window, threshold)
                low = forest(last - first, one, two)
                linked = np.flatnonzero(low != np.arange(last - first))
                a.append(ids[first + linked])
                b.append(ids[first + low[linked]])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def unseen_of(held: pa.Table, first: int, last: int) -> pa.RecordBatch:
        names = np.column_stack([held["pass"].to_numpy(), held["label"].to_numpy(), held["size"].to_numpy()])
        group = np.concatenate([[0], np.cumsum((names[1:] != names[:-1]).any(1))])
        need = depths(group, held["code"].to_numpy(), window)[first:last]
        counts = need <= np.minimum(held["most"].to_numpy()[first:last], BITS)
        ids, unseen = held["class_id"].to_numpy()[first:last][counts], np.log1p(-np.minimum(1 - 1e-9, same ** need[counts]))
        return _rows(len(ids), seen=pa.array(ids), unseen=pa.array(unseen))

    def border(held: pa.Table, part: int, side: int) -> pa.RecordBatch:
        n = held.num_rows
        own = {name: held[name].combine_chunks() for name in ("pass", "label", "size", "class_id", "vector")}
        return _rows(n, part=pa.array(np.full(n, part, np.int64)), side=pa.array(np.full(n, side, np.int32)), place=pa.array(np.arange(n, dtype=np.int32)), **own)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tail = TaskContext.get().partitionId(), None
        codes, told = None, 0  # rows of which `told` have been dealt with; the others wait for those after them
        for batch in rows:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch]).select(["pass", "label", "size", "code", "class_id", "most"])
            codes = own if codes is None else pa.concat_tables([codes, own])
            if (last := codes.num_rows - far) > told:
                yield unseen_of(codes, told, last)
                codes, told = codes.slice(max(0, last - far)), min(last, far)
            held = pa.Table.from_batches([batch])
            if tail is None:
                yield border(held.slice(0, window), part, 0)
            else:
                held = pa.concat_tables([tail, held])
            a, b = links_of(held)
            yield _rows(len(a), a=pa.array(a), b=pa.array(b))
            tail = held.slice(max(0, held.num_rows - window))
        if tail is not None:
            yield unseen_of(codes, told, codes.num_rows)
            yield border(tail, part, 1)

    return run


def across(window: int, threshold: float):
    """The last vectors of a partition and the first of the next one to links between them."""

    def run(key, held):
        held = held.sort_by([("side", "descending"), ("place", "ascending")])
        a, b = [], []
        side = held["side"].to_numpy()
        names = np.column_stack([held["pass"].to_numpy(), held["label"].to_numpy(), held["size"].to_numpy()])
        last = int((side == 1).sum())
        if 0 < last < len(side):
            same = (names == names[last - 1]).all(1)
            own = held.filter(pa.array(same))
            v = unit(own["vector"], int(names[last - 1][2]))
            one, two = window_links(v, window, threshold, int(same[:last].sum()))
            ids = own["class_id"].to_numpy()
            a, b = ids[one], ids[two]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def count_links(threshold: float):
    """Rows sorted by (component, low, high) to (class_id, links) summed over each block pair."""

    def tell(held: pa.Table) -> pa.RecordBatch:
        ids, weight = held["class_id"].to_numpy(), held["weight"].to_numpy()
        v = unit(held["vector"], held["size"][0].as_py())
        block = held["block"].to_numpy()
        low, high = held["low"][0].as_py(), held["high"][0].as_py()
        links = np.zeros(len(ids), weight.dtype)
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for first in range(0, len(x), ROWS):
            own = x[first : first + ROWS]
            near = v[own] @ v[y].T >= threshold
            if low == high:  # not with itself
                near[np.arange(len(own)), first + np.arange(len(own))] = False
            else:
                links[y] += near.T @ weight[own]
            links[own] += near @ weight[y]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64))], ["class_id", "links"])

    return in_blocks(tell, ["component", "low", "high"])


def block_links(threshold: float):
    """Rows sorted by (label, size, low, high) to the links (a, b) of each block pair, as a forest."""

    def tell(held: pa.Table) -> pa.RecordBatch:
        ids, block = held["class_id"].to_numpy(), held["block"].to_numpy()
        v = unit(held["vector"], held["size"][0].as_py())
        x, y = np.flatnonzero(block == held["low"][0].as_py()), np.flatnonzero(block == held["high"][0].as_py())
        low = np.arange(len(ids))
        for first in range(0, len(x), ROWS):
            one, two = np.nonzero(v[x[first : first + ROWS]] @ v[y].T >= threshold)
            some = np.flatnonzero(low != np.arange(len(ids)))
            low = forest(len(ids), np.concatenate([some, x[first + one]]), np.concatenate([low[some], y[two]]))
        linked = np.flatnonzero(low != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[low[linked]])], ["a", "b"])

    return in_blocks(tell, ["label", "size", "low", "high"])


def block_pairs(rows: DataFrame, n: str) -> DataFrame:
    """Each row once for each pair (low, high) of blocks that its block is in; n: rows that meet."""
    rows = rows.withColumn("blocks", F.ceil(F.col(n) / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def passes_needed(largest: int, threshold: float, window: int, miss: float) -> int:
    """Passes after which a pair at the threshold has been missed with probability `miss` at most,
    if a window holds the vectors that share log2(largest / window) + 1 signs: one for buckets that halves leave too large."""
    same = 1 - np.arccos(threshold) / np.pi
    hit = min(1 - 1e-9, same ** max(0.0, np.log2(2 * max(largest, 1) / window)))
    return max(4, int(np.ceil(np.log(miss) / np.log(1 - hit))))


def partitions(rows: int, window: int, most: int) -> int:
    """At most `most`, and so few that each of them holds several windows."""
    return max(1, min(most, rows // (8 * window)))


def near_duplicates(embeddings: DataFrame, scratch: Scratch, threshold: float = 0.93, window: int = WINDOW, miss: float = 1e-6, seed: int = 11) -> DataFrame:
    """A row for each row of embeddings (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    numbers = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    source = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast(numbers).alias("embedding"))
    usable = in_arrow(source, vectors, "vec_id long, label long, size int, vector binary").dropDuplicates()
    usable = scratch.write(usable, "vectors")
    classes = usable.groupBy("label", "size", "vector").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.write(classes, "classes")
    crowds = scratch.write(classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"), "crowds")
    largest, crowded = (x or 0 for x in crowds.agg(F.max("crowd"), F.sum("crowd")).first())
    passes = passes_needed(largest, threshold, window, miss)
    met = classes.join(crowds, ["label", "size"])
    most = F.ceil(F.log2(F.greatest(F.col("crowd") / window, F.lit(1.0)))).cast("int") + SPARE
    dealt = in_arrow(met.select("class_id", "label", "size", "vector", most.alias("most")), projected(passes, seed), "pass int, label long, size int, code long, class_id long, vector binary, most int")
    order = ["pass", "label", "size", "code", "class_id"]
    parts = partitions(crowded * passes, window, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = scratch.write(in_arrow(dealt.select("pass", "label", "size", "code", "class_id", "vector", "most"), compare(window, threshold), FOUND), "found")
    near = found.filter("part is not null").withColumn("border", F.col("part") + F.col("side"))
    between = near.groupBy("border").applyInArrow(across(window, threshold), "a long, b long")
    links = found.filter("a is not null").select("a", "b").union(between)
    unseen = found.filter("seen is not null").groupBy(F.col("seen").alias("class_id")).agg(F.sum("unseen").alias("unseen"))
    hidden = met.join(unseen, "class_id", "left").filter(F.coalesce("unseen", F.lit(0.0)) > float(np.log(miss)))
    hidden = scratch.write(hidden.select("class_id", "label", "size", "vector"), "hidden")
    meet = block_pairs(hidden.join(hidden.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["label", "size"]), "n")
    key = ["label", "size", "low", "high"]
    meet = meet.select(*key, "block", "class_id", "vector").repartition(*key).sortWithinPartitions(*key)
    links = links.union(in_arrow(meet, block_links(threshold), "a long, b long"))
    groups = scratch.write(components(links, scratch), "groups")
    scratch.drop(found)

    members = classes.join(groups.withColumnRenamed("id", "class_id"), "class_id")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = block_pairs(members.join(sizes, "component"), "n")
    members = members.select("component", "low", "high", "block", "class_id", "weight", "size", "vector")
    key = ["component", "low", "high"]
    counted = in_arrow(members.repartition(*key).sortWithinPartitions(*key), count_links(threshold), "class_id long, links long")
    counted = counted.groupBy("class_id").agg(F.sum("links").alias("links"))

    told = classes.join(groups.withColumnRenamed("id", "class_id"), "class_id", "left").join(counted, "class_id", "left")
    told = told.select("label", "size", "vector", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    told = usable.join(told, ["label", "size", "vector"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = embeddings.select("vec_id").join(told, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
