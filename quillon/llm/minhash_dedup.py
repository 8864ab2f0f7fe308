"""MinHash near-duplicate documents, confirmed on whole shingle sets.

1. One pass over the texts gives each document a key of its word sequence, its number of
   distinct shingles, and PERMUTATIONS minima of universal hashes (a * x + b modulo 2**64, upper half).
   Documents with equal word sequences form a class; the smallest id stands for it from here on.
2. Banding: BANDS bands of ROWS minima. A pair at the threshold of 0.8 shares no band with a probability
   of (1 - 0.8**6)**42 = 3e-6. Within a bucket nothing is paired off: first each document meets only the leads (first nodes) of
   the buckets that it shares most bands with, and verified links are merged to components. What is left are the buckets
   that hold several components. Where these are so large that comparing them would multiply their rows, their
   documents meet others at random for a few rounds first.
3. At last all documents of such a bucket meet in blocks of bounded size, wherever their components still
   differ. One task holds a pair of blocks; blocks of one large component do not meet. Two passes: the first
   finds the documents with a partner that sizes and a compact signature (4 bits of each minimum) allow, each pair in the first
   band that it shares; the second has the whole sets of those and returns at most a link for each document of a block.
4. Verification counts the intersection of the whole sets of 64-bit shingle hashes.
5. Components by alternating large-star and small-star.

Defined results: null, empty and wordless texts have an empty set and link with nothing; fewer words
than a shingle make one shingle. Texts of any length count whole; one with more shingles than a block may hold has blocks of its
own. Rows with a null id stand alone (component_id null,
kept true). Rows that repeat an id and a text count as one document and are all returned; if the texts of
an id differ, each row has the component of its own text. An empty table gives an empty result. Other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Scratch, components, forest, fresh, in_arrow, in_blocks, mix, runs, slices, span_hashes, utf8

PERMUTATIONS, ROWS, BANDS = 252, 6, 42
#: Longs of the compact signature: 16 minima of 4 bits in each.
PACKED = 16
#: Compact signatures of a pair at similarity 0.8 differ in 18.75 % of 252 places, 47; this is 4.4 standard deviations more.
MOST_DIFFERENT = 74
#: Nodes that a node meets in a round; the blocks have what that leaves.
LEADS = 2
#: Rounds against random nodes, while the blocks would have more than CROWDED rows for each row that is left.
STAR_ROUNDS, CROWDED = 4, 4
#: Nodes of a block, and shingles of all of them (more only where one node has more).
BLOCK, SHINGLES = 1024, 1 << 20
#: Pairs, and cells of a table, that are looked at in one step.
STEP = 1 << 16
_RANDOM = np.random.Generator(np.random.PCG64(8675309))
_MULTIPLY = _RANDOM.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_rows(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, their offsets by row, and two keys of each row's word sequence."""
    rows, starts, ends = runs(raw, offsets, IS_SPACE)
    words = span_hashes(raw, starts, ends)
    n = len(offsets) - 1
    at = np.searchsorted(rows, np.arange(n + 1))
    number = np.diff(at)
    place = np.arange(len(words)) - at[:-1][rows] if len(words) else np.zeros(0, np.int64)
    keys = []
    for salt in (0x1F83D9AB, 0x5BE0CD19):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + mix(place.astype(np.uint64) + np.uint64(salt))), out=total[1:])
        keys.append(mix(total[at[1:]] - total[at[:-1]] + number.astype(np.uint64)))
    last = np.maximum(number - width + 1, np.minimum(number, 1))  # shingles of each row
    offset = np.concatenate([[0], np.cumsum(last)])
    of = np.repeat(np.arange(n), last)
    first = at[:-1][of] + np.arange(offset[-1]) - offset[:-1][of]
    value = np.zeros(len(first), np.uint64)
    for j in range(width):
        there = j < number[of]
        step = mix(words[np.minimum(first + j, len(words) - 1)] + np.uint64(j + 1)) if len(words) else np.zeros(0, np.uint64)
        value = mix(value * np.uint64(3) + np.where(there, step, np.uint64(0)))
    return value, offset, keys[0], keys[1]


def minima(values: np.ndarray, offsets: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """PERMUTATIONS minima for each row that has shingles; others get the largest number."""
    n = len(offsets) - 1
    out = np.full((PERMUTATIONS, n), np.uint64(0xFFFFFFFFFFFFFFFF))
    x = values >> np.uint64(32)
    for first in range(0, len(x), block):  # stays in the processor's cache
        part = x[first : first + block]
        end = first + len(part)
        low, high = np.searchsorted(offsets, first, "right") - 1, np.searchsorted(offsets, end, "left")
        at = offsets[low:high]
        own = np.flatnonzero(offsets[low + 1 : high + 1] > at)
        cut = np.maximum(at[own] - first, 0)
        target = low + own
        work = np.empty(len(part), np.uint64)
        for k in range(PERMUTATIONS):
            np.multiply(part, _MULTIPLY[k], out=work)
            work += _ADD[k]
            out[k, target] = np.minimum(out[k, target], np.minimum.reduceat(work, cut))
    return (out >> np.uint64(32)).astype(np.uint32).T


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys for each row."""
    out = np.empty((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(signature), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            value = mix(value * np.uint64(3) + signature[:, k])
        out[:, band] = value
    return out


def packed(signature: np.ndarray) -> np.ndarray:
    """PACKED longs for each row: 4 bits of each minimum."""
    four = np.zeros((len(signature), PACKED * 16), np.uint64)
    four[:, :PERMUTATIONS] = signature & np.uint32(15)
    return (four.reshape(-1, PACKED, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(width: int):
    def sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw, offsets, _ = utf8(batch.column(1))
            for first, last in slices(offsets):
                value, at, one, two = shingle_rows(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                number = np.array([len(np.unique(value[a:b])) for a, b in zip(at[:-1], at[1:])], np.int64)
                own = minima(value, at)
                bands, compact = band_keys(own), packed(own)
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(number), _lists(bands.ravel(), np.arange(n + 1) * BANDS), _lists(compact.ravel(), np.arange(n + 1) * PACKED)],
                    ["doc_id", "key1", "key2", "n_shingles", "bands", "compact"],
                )

    return sign


def different(a: str, b: str):
    """Places in which two compact signatures differ."""
    total = F.lit(0)
    for k in range(PACKED):
        odd = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        odd = odd.bitwiseOR(F.shiftrightunsigned(odd, 2))
        total = total + F.bit_count(odd.bitwiseOR(F.shiftrightunsigned(odd, 1)).bitwiseAND(F.lit(0x1111111111111111)))
    return total


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each input row: doc_id, n_shingles, class_id (smallest id with the same words),
    component_id (smallest id reachable by links), kept. Links: 100 * intersection >= percent * union."""
    return grouped(docs, width, percent, doc_id, text).select("doc_id", "n_shingles", "class_id", "component_id", "kept")


def grouped(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same with key1 and key2 of the row's word sequence, and its component (null for an empty set or a null id):
    ids with several texts may give their id to several components."""
    if percent < 80:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    scratch = Scratch(docs.sparkSession, "minhash")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.write(in_arrow(source, signatures(width), "doc_id long, key1 long, key2 long, n_shingles long, bands array<long>, compact array<long>"), "signed")
    full = signed.filter("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("key1", "key2").agg(F.min("doc_id").alias("class_id"))
    member = full.select("doc_id", "key1", "key2", "n_shingles")
    # The smallest id of a class carries its signature.
    first = full.join(classes, ["key1", "key2"]).filter("doc_id = class_id").groupBy("doc_id", "key1", "key2").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("compact").alias("compact"))
    first = scratch.write(first.withColumn("node", F.col("key1")), "representatives")
    banded = first.select("node", "n", F.explode("bands").alias("band"))

    brief = first.select("node", "n", "compact")
    sets = Sets(source, first, width, scratch)
    tried = None  # pairs whose sets have been compared
    groups = scratch.write(first.select(F.col("node").alias("id"), F.col("node").alias("component")).limit(0), "groups")

    def confirm(pairs: DataFrame) -> bool:
        """Compares the sets of new pairs and merges what they link; False if there were none."""
        nonlocal tried, groups
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = scratch.write(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.limit(1).count():
            return False
        links = scratch.write(verified(pairs, sets.of(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), percent), "links")
        tried = pairs if tried is None else tried.union(pairs)
        groups = scratch.write(merged(groups, links, scratch), "groups")
        return True

    # Round 1: each node against the smallest nodes of its buckets, those LEADS it shares most bands with.
    lead = banded.groupBy("band").agg(F.min("node").alias("lead"))
    confirm(pair_up(closest(banded.join(lead, "band")), brief, percent))
    left = between_components(banded, groups, scratch)
    size, before = left.count(), None
    for number in range(STAR_ROUNDS + 1):
        blocks = Blocks(left, scratch)
        if number == STAR_ROUNDS or blocks.rows <= CROWDED * size or before is not None and size > 0.7 * before:
            break
        lead = left.groupBy("band").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(number))).alias("found")).select("band", F.col("found.node").alias("lead"), F.col("found.component").alias("other"))
        if not confirm(pair_up(closest(left.join(lead, "band").filter("component <> other")), brief, percent)):
            break
        scratch.drop(left)
        left, before = between_components(banded, groups, scratch), size
        size = left.count()
    if size:  # all that is left between components, in blocks
        key = ["band", "low", "high"]
        met = blocks.dealt().join(first.select("node", "bands", "compact"), "node").select(*key, "block", "node", "n", "component", "bands", "compact")
        met = in_arrow(met.repartition(*key).sortWithinPartitions(*key), in_blocks(candidates(percent), key), "band long, low long, high long, block long, node long, component long")
        met = scratch.write(met, "candidates")
        held = met.join(sets.of(met.select("node")), "node").select(*key, "block", "node", "component", "shingles")
        links = in_arrow(held.repartition(*key).sortWithinPartitions(*key), in_blocks(block_links(percent), key), "a long, b long")
        groups = scratch.write(merged(groups, scratch.write(links, "links"), scratch), "groups")

    # From nodes to ids: the smallest id of all classes in the component.
    node = first.select("key1", "key2", "node", F.col("doc_id").alias("class_id")).join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = node.groupBy("component").agg(F.min("class_id").alias("component_id"))
    node = node.join(least, "component").select("key1", "key2", "class_id", "component_id", "component")
    told = member.join(node, ["key1", "key2"])
    rest = signed.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), "key1", "key2", F.lit(None).cast("long").alias("component"))
    told = told.select("doc_id", "n_shingles", "class_id", "component_id", "key1", "key2", "component").union(rest)
    return told.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def sizes_fit(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def pair_up(pairs: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and compact signatures allow the threshold."""
    one = brief.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("compact").alias("c_a"))
    two = brief.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("compact").alias("c_b"))
    both = pairs.join(one, "a").join(two, "b")
    return both.filter(sizes_fit(F.col("n_a"), F.col("n_b"), percent) & (different("c_a", "c_b") <= MOST_DIFFERENT)).select("a", "b")


def closest(met: DataFrame) -> DataFrame:
    """(a, b): each node with those LEADS leads that it met most often."""
    met = met.groupBy("node").agg(F.collect_list("lead").alias("leads"))  # a band each at most
    met = met.withColumn("leads", F.array_remove("leads", F.col("node"))).filter(F.size("leads") > 0)
    ranked = F.transform(F.array_distinct("leads"), lambda x: F.struct((-F.size(F.filter("leads", lambda y: y == x))).alias("n"), x.alias("lead")))
    return met.select(F.col("node").alias("a"), F.explode(F.slice(F.array_sort(ranked), 1, LEADS)["lead"]).alias("b"))


def between_components(banded: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """node, n, band, component of the buckets that hold several components."""
    labelled = banded.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    return scratch.write(labelled.join(mixed, "band").select("node", "n", "band", "component"), "between")


def merged(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """groups after more links: components of components."""
    ends = links
    for c in ("a", "b"):
        of = groups.select(F.col("id").alias(c), F.col("component").alias("of"))
        ends = ends.join(of, c, "left").withColumn(c, F.coalesce("of", c)).drop("of")
    ends = scratch.write(ends.select("a", "b"), "ends")
    tops = scratch.write(components(ends, scratch), "tops").select(F.col("id").alias("component"), F.col("component").alias("top"))
    # Nodes that had no component are one of their own.
    known = groups.select("id", "component").union(ends.select(F.col("a"), F.col("a"))).union(ends.select(F.col("b"), F.col("b"))).groupBy("id").agg(F.min("component").alias("component"))
    return known.join(tops, "component", "left").select("id", F.coalesce("top", "component").alias("component"))


class Blocks:
    """The rows of buckets that hold several components, in blocks of at most BLOCK rows and SHINGLES shingles.

    A component that would fill half a block has blocks of its own, the others of a bucket share the rest, each
    component in one block. Blocks of the same owner do not meet, but those that are shared do."""

    def __init__(self, left: DataFrame, scratch: Scratch):
        self.left = left
        per = left.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
        large = (2 * F.col("c") > BLOCK) | (2 * F.col("w") > SHINGLES)
        per = per.withColumn("shared", ~large).withColumn("owner", F.when(large, F.col("component")).otherwise(F.lit(0)))
        number = F.ceil(F.greatest(F.sum("c") / BLOCK, F.sum("w") / SHINGLES))
        owners = per.groupBy("band", "shared", "owner").agg(F.sum("c").alias("c"), number.alias("blocks"))
        several = owners.groupBy("band").agg(F.sum("blocks").alias("all")).filter("all > 1")
        self.owners = scratch.write(owners.join(several, "band"), "owners")
        met = F.col("c") * (F.col("all") - F.when(F.col("shared"), F.lit(0)).otherwise(F.col("blocks")))
        #: Rows that dealt() makes of buckets with several blocks.
        self.rows = self.owners.agg(F.sum(met)).first()[0] or 0

    def dealt(self) -> DataFrame:
        """Each row once for each pair of blocks (low, high) that its block is in."""
        zero = F.lit(0).cast("long")
        crowded = self.owners.select("band").distinct()
        out = self.left.join(crowded, "band", "left_anti").select(*self.left.columns, zero.alias("low"), zero.alias("high"), zero.alias("block"))
        if not self.rows:
            return out
        number = lambda shared, owner, index: F.when(shared, index.cast("long")).otherwise(F.xxhash64(owner, index))
        rows = self.left.join(crowded, "band", "left_semi")
        large = self.owners.filter("not shared").select("band", F.col("owner").alias("component"), F.col("owner").alias("large"))
        rows = rows.join(large, ["band", "component"], "left").withColumn("shared", F.col("large").isNull()).withColumn("owner", F.coalesce("large", F.lit(0))).drop("large")
        two = self.owners.select("band", F.col("shared").alias("shared_"), F.col("owner").alias("owner_"), F.col("blocks").alias("blocks_"))
        meet = self.owners.join(two, "band").filter((F.col("owner") != F.col("owner_")) | (F.col("shared") != F.col("shared_")) | F.col("shared"))
        rows = rows.join(meet.select("band", "shared", "owner", "blocks", "shared_", "owner_", "blocks_"), ["band", "shared", "owner"])
        index = F.pmod(F.when(F.col("shared"), F.xxhash64("component")).otherwise(F.xxhash64("node")), F.col("blocks"))
        rows = rows.withColumn("block", number(F.col("shared"), F.col("owner"), index))
        rows = rows.withColumn("index_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1)))
        rows = rows.withColumn("other", number(F.col("shared_"), F.col("owner_"), F.col("index_")))
        rows = rows.select(*self.left.columns, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")
        return out.unionByName(rows)


def _pairs(held: pa.Table, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of two nodes of different components, one of each block, whose sizes fit; about STEP pairs at once."""
    component, block = held["component"].to_numpy(), held["block"].to_numpy()
    low, high = held["low"][0].as_py(), held["high"][0].as_py()
    x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
    step = max(1, STEP // max(1, len(y)))
    for first in range(0, len(x), step):
        own = x[first : first + step]
        small, large = np.minimum(n[own][:, None], n[y]), np.maximum(n[own][:, None], n[y])
        i, j = np.nonzero((component[own][:, None] != component[y]) & (100 * small >= percent * large))
        i, j = own[i], y[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def _table(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(kind).reshape(-1, width)


def candidates(percent: int):
    """Rows of a pair of blocks to those that have a partner which sizes and compact signatures allow, the band
    being the first that both share."""
    odd, three, one = np.uint64(0x1111111111111111), np.uint64(2), np.uint64(1)

    def tell(held: pa.Table) -> pa.RecordBatch:
        compact, bands = _table(held["compact"], PACKED, np.uint64), _table(held["bands"], BANDS, np.int64)
        band, hit = held["band"][0].as_py(), np.zeros(held.num_rows, bool)
        for i, j in _pairs(held, held["n"].to_numpy(), percent):
            bits = compact[i] ^ compact[j]
            bits |= bits >> three
            bits |= bits >> one
            near = np.flatnonzero(np.bitwise_count(bits & odd).sum(1, dtype=np.int32) <= MOST_DIFFERENT)
            i, j = i[near], j[near]
            first = (bands[i] == bands[j]).argmax(1)
            own = bands[i, first] == band
            hit[i[own]] = True
            hit[j[own]] = True
        names = ["band", "low", "high", "block", "node", "component"]
        return pa.RecordBatch.from_arrays([pa.array(held[c].to_numpy()[hit]) for c in names], names)

    return tell


def block_links(percent: int):
    """Rows of a pair of blocks, with whole sets, to the links between components (a, b), as a forest."""

    def tell(held: pa.Table) -> pa.RecordBatch:
        lists = held["shingles"].combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        values, where, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        some = np.cumsum(count > 1) - 1  # only shingles that several sets have matter
        of, shingle = np.repeat(np.arange(len(n)), n), np.where(count > 1, some, -1)[where]
        of, shingle = of[shingle >= 0], shingle[shingle >= 0]
        order = np.argsort(shingle, kind="stable")
        of, shingle = of[order], shingle[order]
        block, low, high = held["block"].to_numpy(), held["low"][0].as_py(), held["high"][0].as_py()
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        shared = int(shingle[-1]) + 1 if len(shingle) else 0
        common, width = np.zeros((len(x), len(y))), max(1, min(shared, STEP * 64 // len(n)))
        for first in range(0, shared, width):
            a, b = np.searchsorted(shingle, [first, first + width])
            has = np.zeros((len(n), width), np.float32)
            has[of[a:b], shingle[a:b] - first] = 1
            common += has[x] @ has[y].T
        place = np.zeros((2, len(n)), np.int64)
        place[0, x], place[1, y] = np.arange(len(x)), np.arange(len(y))
        ones, twos = [], []
        for i, j in _pairs(held, n, percent):
            both = common[place[0, i], place[1, j]]
            linked = np.flatnonzero(100 * both >= percent * (n[i] + n[j] - both))
            ones.append(i[linked])
            twos.append(j[linked])
        none = np.zeros(0, np.int64)
        root = forest(len(n), np.concatenate([none, *ones]), np.concatenate([none, *twos]))
        nodes, linked = held["node"].to_numpy(), np.flatnonzero(root != np.arange(len(n)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["a", "b"])

    return tell


class Sets:
    """Whole shingle sets by node, computed from the texts where a pair first asks for them."""

    def __init__(self, source: DataFrame, first: DataFrame, width: int, scratch: Scratch):
        self.source, self.first, self.width, self.scratch = source, first, width, scratch
        self.held: DataFrame | None = None

    def of(self, nodes: DataFrame) -> DataFrame:
        """node, shingles: of all those nodes, at least."""
        wanted = nodes.distinct()
        if self.held is not None:
            wanted = wanted.join(self.held.select("node"), "node", "left_anti")
        wanted = self.scratch.write(self.first.select("doc_id", "node", "key1", "key2").join(wanted, "node"), "wanted")
        if wanted.limit(1).count():
            texts = self.source.join(wanted.select("doc_id").distinct(), "doc_id")
            sets = in_arrow(texts, shingle_sets(self.width), "key1 long, key2 long, shingles array<long>")
            sets = sets.join(wanted.select("key1", "key2", "node"), ["key1", "key2"]).select("node", "shingles")
            sets = self.scratch.write(sets.dropDuplicates(["node"]), "sets")
            self.held = sets if self.held is None else self.held.union(sets)
        return self.held


def shingle_sets(width: int):
    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw, offsets, _ = utf8(batch.column(1))
            for first, last in slices(offsets):
                value, at, one, two = shingle_rows(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                own = [np.unique(value[a:b]) for a, b in zip(at[:-1], at[1:])]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _lists(np.concatenate(own), ends)], ["key1", "key2", "shingles"])

    return gather


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets meet the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    return both.filter(100 * F.col("common") >= percent * (F.size("s_a") + F.size("s_b") - F.col("common"))).select("a", "b")


def dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept with shingles of four words."""
    return near_duplicates(docs, width=4).select("doc_id", "n_shingles", "component_id", "kept")


def word_keys(position: int, names: list[str]):
    """Appends the keys of the word sequence and whether there are words."""

    def tell(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw, offsets, _ = utf8(batch.column(position))
            for first, last in slices(offsets):
                _, at, one, two = shingle_rows(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], 1)
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(at) > 0)], [*own.schema.names, *names])

    return tell


def dedup_stage(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8) stays: the smallest id; all columns stay.

    Ids that stand for one row go or stay by id. Rows of other ids go or stay by id and text, one row of each that
    stays. Rows without an id take part under an id made of their text; those without words all stay."""
    id_, one, two, words = (fresh(docs.columns, f"{x}_of_row") for x in ("id", "one", "two", "words"))
    # Over 2**62, so that usual ids come first; one that meets another id is a repeated id like any.
    own = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))))
    scratch = Scratch(docs.sparkSession, "minhash-stage")
    told = scratch.write(grouped(own, doc_id=id_), "told")
    repeated = scratch.write(told.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_)), "repeated")
    gone = told.filter(~F.col("kept")).select(F.col("doc_id").alias(id_)).union(repeated).distinct()
    out = own.join(gone, id_, "left_anti").select(docs.columns)
    if not repeated.limit(1).count():
        return out
    several = own.join(repeated, id_, "left_semi")
    schema = several.select("*", F.lit(0).cast("long").alias(one), F.lit(0).cast("long").alias(two), F.lit(True).alias(words)).schema
    several = in_arrow(several, word_keys(several.columns.index("text"), [one, two, words]), schema)
    # Of each component whose smallest id is repeated, the smallest text of that id; wordless texts are their own.
    told = told.join(repeated.withColumnRenamed(id_, "doc_id"), "doc_id", "left_semi").filter("kept")
    stay = told.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "key1", "key2")).alias("x")).select("x.*")
    stay = stay.union(told.filter("component is null").select("doc_id", "key1", "key2").distinct()).toDF(id_, one, two)
    nameless = several.filter(F.col("doc_id").isNull() & ~F.col(words)).select(docs.columns)
    several = several.filter(F.col("doc_id").isNotNull() | F.col(words)).join(stay, [id_, one, two], "left_semi").dropDuplicates([id_, one, two])
    return out.union(several.select(docs.columns)).union(nameless)
