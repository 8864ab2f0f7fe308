"""Shared pieces: scratch tables, text buffers, hashes, components and global positions."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir, as in tests on one machine.
LOCAL_SCRATCH = "/tmp/checkpoints"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids fall in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name that clashes with none of the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="quillon-"), f"{package.name}.zip"))
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(application)


#: Most bytes of an Arrow batch on its way to or from Python; one row may be larger.
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Sends the package and bounds the session's Arrow batches by bytes, whatever the length of the texts."""
    ship(spark)
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if now is None or not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow with this package at hand on the executors."""
    prepare(df.sparkSession)
    return df.mapInArrow(function, schema)


def in_arrow_column(spark: SparkSession, function: Callable[[pa.Array], pa.Array], kind: str) -> Callable[..., Column]:
    """A column function over Arrow arrays. Only its arguments and its result pass through Python, not the other columns."""
    prepare(spark)
    return F.arrow_udf(function, kind)


class Scratch:
    """Tables in the folder that the cluster shares (spark.checkpoint.dir).

    A table cuts lineage: later stages read it again, whichever executor is lost.
    drop() removes what is no longer needed; the rest goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        prepare(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{LOCAL_SCRATCH}"
        self.root = f"{base.rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._remove(table._scratch_path)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception as error:  # the session may have ended before the interpreter
            if os.environ.get("QUILLON_DEBUG"):
                print(error)


# ---------------------------------------------------------------- text buffers


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and validity of a text column; null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        valid = np.asarray(array.is_valid())
        array = array.fill_null("")
    else:
        valid = np.ones(len(array), bool)
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0], valid


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Row ranges of about `limit` bytes, a longer text alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


# ------------------------------------------------------------------ hashing

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random 64-bit number for each byte; A-Z count as a-z.
BYTE_CODE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_CODE[65:91] = BYTE_CODE[97:123]
#: ASCII white space: space and 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [powers(_BASE, n), powers(_BASE_INVERSE, n)]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the longest runs without separator bytes; no run crosses rows."""
    inside = ~separator[raw]
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, starts, ends


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for spans that differ in the case of A-Z only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# ------------------------------------------------------------- distributed steps


def forest(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest position that links lead to, for each of n positions."""
    root = np.arange(n)
    while len(one):
        low = np.minimum(root[one], root[two])
        np.minimum.at(root, root[one], low)
        np.minimum.at(root, root[two], low)
        while (root[root] != root).any():
            root = root[root]
        on = root[one] != root[two]
        one, two = one[on], two[on]
    return root


def in_blocks(tell: Callable, names: list[str], together: int = 8192) -> Callable:
    """Rows sorted by names to what `tell` makes of the rows of each key; its results leave in batches."""

    def told(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.Table] = []  # parts of the last key met
        for batch in rows:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            key = np.column_stack([now[c].to_numpy() for c in names])
            if held and any(held[-1][c][-1].as_py() != now[c][0].as_py() for c in names):
                yield tell(pa.concat_tables(held))
                held = []
            cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
            for first, last in zip(cut[:-1], cut[1:]):
                yield tell(pa.concat_tables([*held, now.slice(first, last - first)]))
                held = []
            held.append(now.slice(cut[-1]))
        if held:
            yield tell(pa.concat_tables(held))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        out, size = [], 0
        for batch in told(rows):
            if batch.num_rows:
                out.append(batch)
                size += batch.num_rows
            if size >= together:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, size = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def global_index(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """Adds the position (from 0) in the order given, without one task that sees all rows.

    Rows go to ranges; each range numbers its rows; the ranges' sizes (as many numbers as
    there are partitions) give what comes before. Order by a key without ties for a fixed result.
    """
    spark = df.sparkSession
    part, local = fresh(df.columns, "part"), fresh(df.columns, "local")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The low 33 bits of monotonically_increasing_id count rows inside a partition, the others are the partition.
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(local, F.monotonically_increasing_id())
    dealt = dealt.withColumn(part, F.shiftright(local, 33)).withColumn(local, F.col(local).bitwiseAND(F.lit((1 << 33) - 1)))
    table = scratch.write(dealt, name)
    sizes = sorted(table.groupBy(part).count().collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    starts = spark.createDataFrame(before, f"{part} long, {name} long")
    out = table.join(F.broadcast(starts), part)
    return out.withColumn(name, F.col(name) + F.col(local)).drop(part, local)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): smallest id reachable, for every id of the edges (a, b).

    Alternates large-star and small-star until no edge changes. Each step groups neighbours
    by minimum only, so no vertex's neighbours are gathered in one row.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        if not large:  # only smaller neighbours count
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:  # larger neighbours go to the smallest one
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # smaller neighbours and the vertex go to the smallest one
            out = joined.select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        after = scratch.write(stars(stars(now, True), False), "stars")
        scratch.drop(now)
        now = after
        last, sign = sign, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == last:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
