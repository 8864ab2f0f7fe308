"""Shards of nearly equal size by longest-processing-time scheduling.

Documents with equal texts form a group that stays together. Groups are taken from the largest to the smallest,
each goes to the least-loaded shard, which a heap gives. Groups of one size are alike to the
schedule, so it runs over sizes and how often each occurs: a run of n equal groups costs the driver as
much as a few. Sizes are exact. n different sizes need more than n * n / 2 bytes of text, so the driver holds at most
sqrt(2 * bytes) runs: 14 million for 100 TB, as arrays of numbers.

Groups of one run are told apart by their position in the order of (size, text hash), which is found without
one task that sees all groups.

A popular text's rows meet its group in a join that Spark splits where a partition is skewed; nothing gathers them.

Defined results: a text of any length counts by its bytes; a null text has size 1 and crc32 0, and all null texts form one group, as do all empty texts;
rows without an id are placed too, first in their shard; rows that repeat an id are placed each; an
empty table gives an empty result; other columns do no harm.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, global_index

def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """sizes: different ones, largest first; counts: groups of each. Groups of each size for each shard.

    While a size has many groups left they go to all shards alike, once the loads differ by no more than one of them."""
    loads = [(0, s) for s in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for k, (each, count) in enumerate(zip(sizes.tolist(), counts.tolist())):
        while count:
            if count >= shards and max(x for x, _ in loads) - loads[0][0] <= each:
                turns = count // shards
                out[k] += turns
                loads = [(x + turns * each, s) for x, s in loads]
                heapq.heapify(loads)
                count -= turns * shards
                continue
            # The least-loaded shard takes what brings it level with the next one, one group at least.
            load, s = heapq.heappop(loads)
            take = min(count, max(1, (loads[0][0] - load) // each)) if loads else count
            out[k, s] += take
            heapq.heappush(loads, (load + take * each, s))
            count -= take
    return out


def assign(docs: DataFrame, scratch: Scratch, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    spark = docs.sparkSession
    own = F.col(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(own), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(own, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(own.cast("binary")), F.lit("null")).alias("group"),
    )
    rows = scratch.write(rows, "rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("whole"))
    groups = global_index(groups, [F.col("whole").desc(), F.col("group")], "position", scratch)
    groups = scratch.write(groups, "groups")
    runs = groups.groupBy("whole").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("whole", "descending")])
    sizes, counts = runs["whole"].to_numpy(), runs["n"].to_numpy()
    ends = (np.cumsum(counts) - counts)[:, None] + np.cumsum(schedule(sizes, counts, shards), 1)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(ends.ravel()), shards).cast(pa.list_(pa.int64()))
    table = spark.createDataFrame(pa.table({"whole": pa.array(sizes, pa.int64()), "ends": lists}), "whole long, ends array<long>")
    placed = groups.join(table, "whole").select("group", F.size(F.filter("ends", lambda end: end <= F.col("position"))).alias("shard"))
    rows = rows.join(placed, "group").select("doc_id", "size", "text_crc32", "shard")
    # The other columns make ties between equal ids fixed.
    rows = scratch.write(global_index(rows, [F.col("shard"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", scratch), "placed")
    counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    before = F.lit(0).cast("long")
    for s in range(shards):
        before = before + F.when(F.col("shard") > s, counts.get(s, 0)).otherwise(0)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("slot") - before).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
