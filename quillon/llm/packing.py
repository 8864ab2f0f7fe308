"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids, one end id each; documents longer than a sequence are cut into whole sequences
with the remainder first. Full pieces need no packing. The others go at random to islands of
about ISLAND pieces, so that an island's work and memory do not grow with the input. On each
island a population of packings evolves: the crossover injects whole well-filled sequences of one parent
into the other, drops the sequences that hold the same pieces a second time, and puts the displaced
pieces, largest first, where they fit best. Between epochs each island sends its best-filled sequences
as lists of lengths to the next one, which builds them from pieces of its own. Sequences
that stay badly filled after the last epoch are opened and packed again on fewer islands.

Defined results: texts of any length are encoded whole; null texts count as empty and have the end id alone; repeated rows are packed each, in
any order; an empty table gives an empty result; other columns do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_arrow
from .word_ids import text_batches, worker_ids

#: Pieces of an island, packings of its population, children in an epoch, epochs, length lists an island sends.
ISLAND, POPULATION, CHILDREN, EPOCHS, ELITE = 16_384, 4, 24, 2, 64
#: A sequence counts as well filled from here; below, it is opened for the second packing.
WELL_FILLED = 0.98
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of PIECE for every document."""
    end = int(end_id).to_bytes(4, "little")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_ids(tokenizer, True)
        for batch in rows:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            own = batch.column(0).to_pylist()
            for first, last in text_batches(texts):
                out: tuple[list, ...] = ([], [], [], [], [])
                for name, ids in zip(own[first:last], words.ids(texts[first:last])):
                    ids += end
                    size = len(ids) // 4
                    at, step = 0, size if size <= capacity else size % capacity or capacity
                    number = 0
                    while at < size:
                        for values, x in zip(out, (name, number, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)]))):
                            values.append(x)
                        at, step, number = at + step, capacity, number + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_arrow(docs.select(doc_id, text), cut, PIECE)


# ------------------------------------------------------------- one island


def best_fit(order: np.ndarray, size: np.ndarray, bin_of: np.ndarray, fill: list[int], capacity: int, usable: np.ndarray | None = None) -> None:
    """Puts the items, in order, into the fullest bin that takes each, else into a new one.

    Bins wait by free space; the bits of one number tell which spaces are there."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for b in range(len(fill)) if usable is None else usable.tolist():
        space = capacity - fill[b]
        if space:
            waiting[space].append(b)
            bits |= 1 << space
    for item, need in zip(order.tolist(), size[order].tolist()):
        fits = bits >> need
        if fits:
            space = need + (fits & -fits).bit_length() - 1
            b = waiting[space].pop()
            if not waiting[space]:
                bits ^= 1 << space
        else:
            b, space = len(fill), capacity
            fill.append(0)
        fill[b] += need
        bin_of[item] = b
        space -= need
        if space:
            if not waiting[space]:
                bits |= 1 << space
            waiting[space].append(b)


class Packing:
    """bin_of: a bin for each item, numbered without gaps; fill: length in each bin."""

    def __init__(self, bin_of: np.ndarray, size: np.ndarray, capacity: int):
        _, self.bin_of = np.unique(bin_of, return_inverse=True)
        self.fill = np.bincount(self.bin_of, size).astype(np.int64)
        self.fitness = (len(self.fill), -float(((self.fill / capacity) ** 2).sum()))


def decreasing(size: np.ndarray, noise: np.ndarray | float = 0.0) -> np.ndarray:
    return np.argsort(-(size + noise), kind="stable")


def fresh_packing(size: np.ndarray, capacity: int, random: np.random.Generator, spread: float) -> Packing:
    bin_of = np.zeros(len(size), np.int64)
    best_fit(decreasing(size, random.random(len(size)) * spread), size, bin_of, [], capacity)
    return Packing(bin_of, size, capacity)


def inject(target: Packing, items: np.ndarray, groups: np.ndarray, size: np.ndarray, capacity: int) -> Packing:
    """target with the items' groups as bins of their own; what they displace goes where it fits best."""
    count = len(target.fill)
    hit = np.zeros(count, bool)
    hit[target.bin_of[items]] = True
    placed = np.zeros(len(size), bool)
    placed[items] = True
    bin_of = target.bin_of.copy()
    _, bin_of[items] = np.unique(groups, return_inverse=True)
    bin_of[items] += count
    displaced = np.flatnonzero(hit[target.bin_of] & ~placed)
    keep = ~hit
    fill = [*np.where(keep, target.fill, capacity).tolist(), *np.bincount(bin_of[items] - count, size[items]).astype(np.int64).tolist()]
    best_fit(displaced[decreasing(size[displaced])], size, bin_of, fill, capacity)
    return Packing(bin_of, size, capacity)


def crossover(mother: Packing, father: Packing, size: np.ndarray, capacity: int, random: np.random.Generator) -> Packing:
    """Some well-filled bins of the father whole in the mother, and her emptiest bins opened too."""
    full = np.flatnonzero(father.fill >= WELL_FILLED * capacity)
    if not len(full):
        full = np.argsort(-father.fill)[: max(1, len(father.fill) // 10)]
    chosen = random.choice(full, max(1, min(len(full), len(father.fill) >> int(random.integers(3, 8)))), replace=False)
    wanted = np.zeros(len(father.fill), bool)
    wanted[chosen] = True
    items = np.flatnonzero(wanted[father.bin_of])
    return inject(mother, items, father.bin_of[items], size, capacity)


def from_lengths(packing: Packing, lists: list[np.ndarray], size: np.ndarray, capacity: int) -> Packing:
    """The packing with bins of the lengths given, as far as items of these lengths are there."""
    order = np.argsort(size, kind="stable")
    first = np.searchsorted(size[order], np.arange(capacity + 2))
    taken = first[:-1].copy()
    items, groups = [], []
    for k, lengths in enumerate(lists):
        need, n = np.unique(lengths, return_counts=True)
        if (taken[need] + n > first[need + 1]).any():
            continue
        for x, m in zip(need, n):
            items.append(order[taken[x] : taken[x] + m])
            groups.append(np.full(m, k))
            taken[x] += m
    if not items:
        return packing
    return inject(packing, np.concatenate(items), np.concatenate(groups), size, capacity)


def evolve(size: np.ndarray, capacity: int, seed: int, start: np.ndarray | None = None, elites: list[np.ndarray] = ()) -> Packing:
    """The best packing after CHILDREN crossovers; stops early at the least number possible."""
    random = np.random.Generator(np.random.PCG64(seed))
    least = -(-int(size.sum()) // capacity)
    people = [Packing(start, size, capacity)] if start is not None else [fresh_packing(size, capacity, random, 0.0)]
    if len(people[0].fill) > least:
        if len(elites):
            people.append(from_lengths(people[0], elites, size, capacity))
        while len(people) < POPULATION:
            people.append(fresh_packing(size, capacity, random, capacity / 16 * len(people)))
        for _ in range(CHILDREN):
            people.sort(key=lambda p: p.fitness)
            if len(people[0].fill) <= least:
                break
            a, b = random.choice(len(people), 2, replace=False)
            child = crossover(people[a], people[b], size, capacity, random)
            if child.fitness < people[-1].fitness:
                people[-1] = child
    return min(people, key=lambda p: p.fitness)


def elite_lists(best: Packing, size: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Lengths in the fullest bins that hold several pieces."""
    number = np.bincount(best.bin_of)
    top = np.argsort(-np.where(number > 1, best.fill, 0), kind="stable")[:ELITE]
    order = np.argsort(best.bin_of, kind="stable")
    at = np.searchsorted(best.bin_of[order], np.arange(len(best.fill) + 1))
    return [size[order[at[b] : at[b + 1]]] for b in top if number[b] > 1]


# ------------------------------------------------------------- all islands


def _flat(lists: list[np.ndarray]) -> list[list[int]]:
    return [x.tolist() for x in lists]


def pack(items: DataFrame, capacity: int, scratch: Scratch, seed: int = 7) -> DataFrame:
    """items: PIECE columns, lengths from 1 to capacity. Adds sequence_id and offset."""
    spark = items.sparkSession
    whole = items.filter(F.col("length") >= capacity).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    # A random island for each row, fixed by the table that it is written to.
    loose = scratch.write(items.filter(F.col("length") < capacity).withColumn("deal", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))), "loose")
    done, level = [], 0
    while True:
        count = loose.count()
        if not count:
            break
        islands = -(-count // ISLAND)
        at = loose.withColumn("island", F.pmod("deal", F.lit(islands)).cast("int"))
        state = _epoch(at, None, capacity, seed + level, islands, scratch)
        for epoch in range(1, EPOCHS):
            state = _epoch(state.filter("length > 0").drop("elite"), state, capacity, seed + 100 * epoch + level, islands, scratch)
        placed = state.filter("length > 0").drop("elite")
        if islands == 1:
            done.append(_named(placed, level))
            break
        done.append(_named(placed.filter(F.col("fill") >= WELL_FILLED * capacity), level))
        rest = scratch.write(placed.filter(F.col("fill") < WELL_FILLED * capacity).select(*items.columns, F.xxhash64("deal").alias("deal")), "rest")
        if rest.count() > 0.7 * count:  # hardly anything fits together: more rounds would change nothing
            done[-1] = _named(placed, level)
            break
        loose, level = rest, level + 1
    out = whole
    for part in done:
        out = out.union(part.select(*whole.columns))
    return out


def _named(placed: DataFrame, level: int) -> DataFrame:
    return placed.withColumn("sequence_id", F.lit(level << 56) + F.col("island").cast("long") * (1 << 32) + F.col("bin")).withColumn("offset", F.col("place"))


STATE = f"{PIECE}, deal long, island int, bin long, place long, fill long, elite array<array<long>>"
ROWS = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64()}.get(x.split()[1], pa.list_(pa.list_(pa.int64())))) for x in STATE.split(", ")])


def _epoch(at: DataFrame, before: DataFrame | None, capacity: int, seed: int, islands: int, scratch: Scratch) -> DataFrame:
    """One epoch of every island; the rows, and one row without length for each island with what it sends."""

    def run(rows: pa.Table, sent: pa.Table | None) -> pa.Table:
        rows = rows.sort_by([("deal", "ascending")])
        size = rows["length"].to_numpy()
        island = rows["island"][0].as_py()
        start = rows["bin"].to_numpy() if "bin" in rows.schema.names else None
        lists = [np.array(x) for x in (sent["elite"][0].as_py() if sent is not None and sent.num_rows else [])]
        best = evolve(size, capacity, seed * 1_000_003 + island, start, lists)
        order = np.argsort(best.bin_of, kind="stable")
        place = np.empty(len(size), np.int64)
        total = np.cumsum(size[order]) - size[order]
        first = np.searchsorted(best.bin_of[order], np.arange(len(best.fill)))
        place[order] = total - total[first][best.bin_of[order]]
        own = rows.select(["doc_id", "piece", "start", "length", "ids_crc32", "deal", "island"])
        for name, value in (("bin", best.bin_of.astype(np.int64)), ("place", place), ("fill", best.fill[best.bin_of])):
            own = own.append_column(name, pa.array(value))
        own = own.append_column("elite", pa.nulls(len(size), pa.list_(pa.list_(pa.int64()))))
        send = [_flat(elite_lists(best, size, capacity))]
        letter = pa.table({**{f.name: pa.nulls(1, f.type) for f in own.schema}, "length": pa.array([0], pa.int64()), "island": pa.array([island], pa.int32()), "elite": pa.array(send, pa.list_(pa.list_(pa.int64())))}, schema=own.schema)
        return pa.concat_tables([own, letter])

    if before is None:
        out = at.groupBy("island").applyInArrow(lambda rows: run(rows, None), STATE)
    else:
        letters = before.filter("length = 0").select(((F.col("island") + 1) % islands).alias("island"), "elite")
        out = at.groupBy("island").cogroup(letters.groupBy("island")).applyInArrow(lambda rows, sent: run(rows, sent) if rows.num_rows else ROWS.empty_table(), STATE)
    return scratch.write(out, "epoch")


def packing_query(docs: DataFrame, tokenizer: str, scratch: Scratch, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(scratch.write(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, scratch)
