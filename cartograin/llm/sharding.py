"""Sharding by longest-processing-time scheduling (LPT), in two levels.

Rows that must stay together are summed to groups. Groups above a small share of all bytes (so at most shards * FINE of
them) are sorted by size on the driver and each goes to the least-loaded shard through a heap. The others are sorted by
size within their Spark partitions, where each partition's own heap deals them to as many bins as there are shards; then
the bins (partitions * shards of them) go to the shards by the same rule, the bins of one partition to different shards.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: A group is large if it has more than 1 / (shards * FINE) of all bytes.
FINE = 1000


def _large_first(sizes: list[tuple], loads: list[int]) -> dict:
    """LPT: key to bin for (size, key) pairs; loads are the bins' loads so far and are updated."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, k = heap[0]
        out[key] = k
        heapq.heapreplace(heap, (load + size, k))
        loads[k] = load + size
    return out


def _binned(shards: int):
    def deal(batches):
        from pyspark import TaskContext

        part, heap = TaskContext.get().partitionId(), [(0, k) for k in range(shards)]
        for b in batches:
            bins = []
            for size in b.column(1).to_pylist():
                load, k = heap[0]
                bins.append(k)
                heapq.heapreplace(heap, (load + size, k))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([part] * b.num_rows, pa.int32()), pa.array(bins, pa.int32())], ["key", "bytes", "part", "bin"])

    return deal


def _numbered(batches):
    """Adds the place of each row among its task's rows of the same shard."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        at = []
        for s in b.column("shard").to_pylist():
            at.append(seen.get(s, 0))
            seen[s] = at[-1] + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(at, pa.int64())], [*b.schema.names, "part", "at"])


def _looked_up(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def shards_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row, with shards of near equal bytes.

    Rows with equal texts are one group and share a shard; null and empty texts are equal and have size 1, other texts have
    their UTF-8 bytes plus 1. slot counts each shard's rows from 0 without gaps. law is "bytes", grown_shard null. Rows
    without an id and repeated rows are dealt like others. Other columns are ignored. An empty table gives an empty table.
    The driver gets the large groups (shards * 1000 at most) and counts for each partition and shard, never all groups.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    rows = written(rows, "sharding-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "sharding-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    cut = total // (shards * FINE)
    loads = [0] * shards
    large = _large_first([(r["bytes"], r["key"]) for r in groups.filter(F.col("bytes") > cut).collect()], loads)
    small = groups.filter(F.col("bytes") <= cut).repartition("key").sortWithinPartitions(F.desc("bytes"), "key")
    small = written(small.mapInArrow(_binned(shards), "key string, bytes long, part int, bin int"), "sharding-bins")
    sums: dict[int, list] = {}
    for r in small.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes")).collect():
        sums.setdefault(r["part"], []).append((r["bytes"], r["bin"]))
    places = []
    for part, bins in sorted(sums.items(), key=lambda x: (-sum(b for b, _ in x[1]), x[0])):
        for (size, b), k in zip(sorted(bins, key=lambda x: (-x[0], x[1])), sorted(range(shards), key=lambda k: (loads[k], k))):
            places.append((part, b, k))
            loads[k] += size
    at = small.join(_looked_up(spark, places, "part int, bin int, shard int"), ["part", "bin"]).select("key", "shard")
    at = at.unionByName(spark.createDataFrame([*large.items()], "key string, shard int"))
    dealt = rows.join(at, "key").select("doc_id", "size", "text_crc32", "shard")
    dealt = written(dealt.mapInArrow(_numbered, "doc_id long, size long, text_crc32 long, shard int, part int, at long"), "sharding-dealt")
    before, offsets = [0] * shards, []
    for r in sorted(dealt.groupBy("part", "shard").count().collect()):
        offsets.append((r["part"], r["shard"], before[r["shard"]]))
        before[r["shard"]] += r["count"]
    slots = dealt.join(_looked_up(spark, offsets, "part int, shard int, before long"), ["part", "shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes. Nulls and repeats as shards_by_bytes() says."""
    return shards_by_bytes(table(spark, sf_dir, "documents"))
