"""Token ids in files coded by a static range asymmetric numeral system.

A store is a folder of two Parquet tables, so that any file system that Spark reads can hold it:
  frequencies  one row: the shared table, a frequency for each token id, summing to 2**PRECISION
  blocks       rows sorted by (segment, block); each is coded on its own:
    segment, block, first (ids before the block in its segment), n_tokens, pieces of documents as
    doc_id, part, length (little-endian int64 lists), the id stream as
    states (LANES 64-bit states), words (32-bit little-endian, in reading order), checkpoints
    (each: step, words read, crc32 of the ids from there to the block's end, states; decoding can start at any of them:
    read_span does), crc32 of the ids.
Token t of a block belongs to lane t % LANES and step t // LANES: the lanes interleave, and all lanes of a step
are coded at once. Coding runs from the last step to the first, decoding from the first to the last.

A segment holds a range of documents in ascending id order, segments ascend too. Documents fill blocks of about
BLOCK ids; only a document longer than a block is split.

Defined results: texts of any length are encoded whole; null texts count as empty and hold the end id alone; rows without an id come first; rows
that repeat an id are coded each; an empty table gives an empty store; other columns do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_arrow
from .word_ids import text_batches, worker_ids

PRECISION, LANES, BLOCK, CHECKPOINT = 20, 1024, 1 << 18, 128
_LOW = np.uint64(1 << 31)
_32, _MASK32 = np.uint64(32), np.uint64(0xFFFFFFFF)


def shared_frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies summing to 2**PRECISION, at least 1 for every id of the vocabulary."""
    total, size = 1 << PRECISION, len(counts)
    spare = total - size
    share = counts / max(counts.sum(), 1) * spare
    out = np.floor(share).astype(np.int64)
    rest = spare - int(out.sum())
    out[np.argsort(-(share - out), kind="stable")[: rest % size]] += 1
    return (out + rest // size + 1).astype(np.uint32)


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        ends = np.cumsum(self.frequency)
        self.start = ends - self.frequency
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)
        self.limit = self.frequency << np.uint64(63 - PRECISION)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """States, words and checkpoints (step, words before it, states)."""
        steps = -(-len(ids) // LANES)
        padded = np.zeros(steps * LANES, np.int64)
        padded[: len(ids)] = ids
        table = padded.reshape(steps, LANES)
        state = np.full(LANES, _LOW)
        flushed, marks = [], []
        for step in range(steps - 1, -1, -1):
            own = table[step]
            f = self.frequency[own]
            out = state >= self.limit[own]
            if out.any():
                flushed.append((state[out] & _MASK32).astype(np.uint32))
                state = np.where(out, state >> _32, state)
            q = state // f
            state = (q << np.uint64(PRECISION)) + (state - q * f) + self.start[own]
            if step and step % CHECKPOINT == 0:
                marks.append((step, sum(map(len, flushed)), state.copy()))
        words = np.concatenate(flushed[::-1]) if flushed else np.zeros(0, np.uint32)
        return state, words, [(step, len(words) - after, s) for step, after, s in reversed(marks)]

    def decode(self, n: int, state: np.ndarray, words: np.ndarray, step: int = 0, at: int = 0) -> np.ndarray:
        """Ids from a step on, given the states and the words read before it."""
        steps = -(-n // LANES)
        out = np.empty((steps - step, LANES), np.uint32)
        mask, bits = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
        state = state.copy()
        for k in range(steps - step):
            slot = state & mask
            own = self.symbol[slot]
            out[k] = own
            state = self.frequency[own] * (state >> bits) + slot - self.start[own]
            low = np.flatnonzero(state < _LOW)
            if len(low):
                state[low] = (state[low] << _32) | words[at : at + len(low)]
                at += len(low)
        return out.ravel()[: n - step * LANES]


_CODERS: dict[str, Coder] = {}


def _coder(frequencies) -> Coder:
    """One for each Python worker and table."""
    table = np.frombuffer(frequencies.value, np.uint32)
    name = f"{zlib.crc32(frequencies.value)}-{len(table)}"
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(table)
    return _CODERS[name]


# ------------------------------------------------------------------- writing


def tokens(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, ids (16-bit if the vocabulary allows, else 32-bit), each text followed by the end id."""
    end = int(end_id).to_bytes(4, "little")

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_ids(tokenizer, False)
        narrow = words.library.get_vocab_size() <= 1 << 16
        for batch in rows:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, last in text_batches(texts):
                ids = [x + end for x in words.ids(texts[first:last])]
                if narrow:
                    ids = [np.frombuffer(x, np.uint32).astype(np.uint16).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return in_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), encode, "doc_id long, ids binary")


def count_ids(kind: str, size: int):
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in rows:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size) if len(x.as_buffer()) > size else 0
                if len(x.as_buffer()) <= size:
                    np.add.at(total, np.frombuffer(x.as_buffer(), kind), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return count


BLOCKS = "segment long, block long, first long, n_tokens long, doc_id binary, part binary, length binary, states binary, words binary, checkpoints binary, crc32 long"


def _block(coder: Coder, segment: int, number: int, first: int, docs: list, parts: list, ids: list) -> list:
    flat = np.concatenate(ids)
    states, words, marks = coder.encode(flat)
    raw = flat.astype("<u4").tobytes()
    held = b"".join(np.array([step, at, zlib.crc32(raw[4 * step * LANES :])], "<i8").tobytes() + s.astype("<u8").tobytes() for step, at, s in marks)
    whole = lambda x: np.array(x, "<i8").tobytes()
    crc = zlib.crc32(raw)
    return [segment, number, first, len(flat), whole([NO_ID if d is None else d for d in docs]), whole(parts), whole([len(x) for x in ids]), states.astype("<u8").tobytes(), words.astype("<u4").tobytes(), held, crc]


#: Stands for a missing id in a block.
NO_ID = -(1 << 63)


def encode_blocks(frequencies, kind: str):
    """Sorted (doc_id, ids) of a partition to its segment's blocks."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, segment = _coder(frequencies), TaskContext.get().partitionId()
        number = first = held = 0
        docs, parts, ids = [], [], []
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        types = [pa.binary() if x.endswith("binary") else pa.int64() for x in BLOCKS.split(", ")]

        def close() -> pa.RecordBatch:
            nonlocal number, first, held, docs, parts, ids
            row = _block(coder, segment, number, first, docs, parts, ids)
            number, first, held, docs, parts, ids = number + 1, first + held, 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        for batch in rows:
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(own.as_buffer(), kind).astype(np.int64)
                for part, at in enumerate(range(0, len(values), BLOCK)):
                    piece = values[at : at + BLOCK]
                    if held and held + len(piece) > BLOCK:
                        yield close()
                    docs.append(doc)
                    parts.append(part)
                    ids.append(piece)
                    held += len(piece)
        if held:
            yield close()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, scratch: Scratch, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every document into the store at path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    coded = scratch.write(tokens(docs, tokenizer, end_id, doc_id, text), "tokens", codec="lz4")
    counted = in_arrow(coded.select("ids"), count_ids(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    table = shared_frequencies(counts).astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(table),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/frequencies")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = coded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    blocks = in_arrow(dealt, encode_blocks(spark.sparkContext.broadcast(table), kind), BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop(coded)


# ------------------------------------------------------------------- reading


#: Bytes of a checkpoint.
MARK = 24 + 8 * LANES


def decode_block(coder: Coder, row: dict, checkpoint: int | None = None) -> np.ndarray:
    """Ids of a block, from one of its checkpoints on if given; they must meet the checksum."""
    words, state, step, at, crc = np.frombuffer(row["words"], "<u4"), np.frombuffer(row["states"], "<u8"), 0, 0, row["crc32"]
    if checkpoint is not None:
        mark = row["checkpoints"][checkpoint * MARK : (checkpoint + 1) * MARK]
        (step, at, crc), state = np.frombuffer(mark[:24], "<i8").tolist(), np.frombuffer(mark[24:], "<u8")
    ids = coder.decode(row["n_tokens"], state, words, step, at)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError(f"block {row['block']} of segment {row['segment']} does not meet its checksum")
    return ids


def read_span(spark: SparkSession, path: str, segment: int, start: int, n: int) -> DataFrame:
    """The ids from `start` of a segment on, n at most, as rows (start, ids) in any order. Only blocks of the span are read, each
    from the last checkpoint before it."""
    frequencies = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/frequencies").first()[0]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(frequencies)
        for batch in rows:
            for row in batch.to_pylist():
                low, high = max(start - row["first"], 0), min(start + n - row["first"], row["n_tokens"])
                marks = [int(np.frombuffer(row["checkpoints"][k : k + 8], "<i8")[0]) * LANES for k in range(0, len(row["checkpoints"]), MARK)]
                before = sum(x <= low for x in marks)
                skipped = marks[before - 1] if before else 0
                ids = decode_block(coder, row, before - 1 if before else None)[low - skipped : high - skipped]
                yield pa.RecordBatch.from_arrays([pa.array([row["first"] + low]), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["start", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").filter((F.col("segment") == segment) & (F.col("first") < start + n) & (F.col("first") + F.col("n_tokens") > start))
    return in_arrow(blocks.select(*[x.split()[0] for x in BLOCKS.split(", ")]), run, "start long, ids array<long>")


def crc32_joined(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from theirs and the second one's length."""

    def times(matrix: list[int], vector: int) -> int:
        total, k = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[k]
            vector >>= 1
            k += 1
        return total

    def square(matrix: list[int]) -> list[int]:
        return [times(matrix, x) for x in matrix]

    odd = [0xEDB88320, *(1 << k for k in range(31))]  # a zero bit
    step = square(square(square(odd)))  # a zero byte
    while length:
        if length & 1:
            first = times(step, first)
        step = square(step)
        length >>= 1
    return first ^ second


PARTS = "segment long, doc_id long, part long, start long, length long, ids_crc32 long"


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, or each part of one that is longer than a block; start within its segment."""
    table = bytes(spark.read.parquet(f"{path}/frequencies").first()[0])
    frequencies = spark.sparkContext.broadcast(table)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(frequencies)
        for batch in rows:
            for row in batch.to_pylist():
                raw = decode_block(coder, row).astype("<u4").tobytes()
                docs, parts, lengths = (np.frombuffer(row[c], "<i8") for c in ("doc_id", "part", "length"))
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["segment"])), pa.array(docs, mask=docs == NO_ID), pa.array(parts), pa.array(starts + row["first"]), pa.array(lengths), pa.array(crc, pa.int64())], [x.split()[0] for x in PARTS.split(", ")])

    blocks = spark.read.parquet(f"{path}/blocks")
    return in_arrow(blocks.select(*[x.split()[0] for x in BLOCKS.split(", ")]), run, PARTS)


def _join_parts(key, held):
    """The parts of documents that blocks have split, joined."""
    held = held.sort_by([("start", "ascending")])
    out: list[list] = []
    for row in held.to_pylist():
        if row["part"] == 0 or not out:
            out.append([row["segment"], row["doc_id"], 0, row["start"], row["length"], row["ids_crc32"]])
        else:
            out[-1][5] = crc32_joined(out[-1][5], row["ids_crc32"], 4 * row["length"])
            out[-1][4] += row["length"]
    names = [x.split()[0] for x in PARTS.split(", ")]
    return pa.table({name: pa.array([x[k] for x in out], pa.int64()) for k, name in enumerate(names)})


def read_documents(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the store."""
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("segment").agg(F.sum("n_tokens").alias("n")).orderBy("segment").collect()
    before, total = [], 0
    for segment, n in sizes:  # as many as the partitions that wrote the store
        before.append((segment, total))
        total += n
    starts = spark.createDataFrame(before, "segment long, before long")
    parts = scratch.write(read_parts(spark, path), "parts")
    long = parts.filter("part > 0").select("segment", "doc_id").distinct()
    same = ["segment", "doc_id"]
    whole = parts
    if long.limit(1).count():
        match = (parts["segment"] == long["segment"]) & parts["doc_id"].eqNullSafe(long["doc_id"])
        split = parts.join(long, match, "left_semi").groupBy(*same).applyInArrow(_join_parts, PARTS)
        whole = parts.join(long, match, "left_anti").union(split)
    out = whole.join(F.broadcast(starts), "segment")
    return out.select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.col("length").alias("n_tokens"), "ids_crc32")


def store_query(docs: DataFrame, tokenizer: str, scratch: Scratch) -> DataFrame:
    """Writes the store and reads it again: doc_id, start, n_tokens, ids_crc32 of every document."""
    path = scratch.path("store")
    write_store(docs, path, tokenizer, scratch)
    return read_documents(docs.sparkSession, path, scratch)
