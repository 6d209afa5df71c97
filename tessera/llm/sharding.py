"""Longest-processing-time sharding of groups that must stay together.

Groups, largest first, go to the least-loaded shard (ties to the smaller number), taken from a heap. Groups of
equal size are interchangeable, so the heap runs over the histogram of group sizes. Sizes below 2 ** BITS have bins of their
own; larger ones share a bin if their first BITS bits are the same, and count as its mean, so that the histogram is bounded
whatever the input and a load is off by less than one part in 2 ** (BITS - 1). For a size that many groups share,
whole rounds are dealt at once and only the last few through the heap; the shard
loads are the same as one by one. Groups get their number within their bin, and gapless slots come from counts
of hash buckets, whose number follows the rows, so that no window holds a whole size, shard or group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: Bits of a group's size that its bin keeps: 4096 bins for each doubling.
BITS = 13
#: Hash buckets of a size or a shard that are numbered apart: so many at least, and so many rows to one over all.
BUCKETS, BUCKET_ROWS = 256, 20_000


def deal(sizes: list[int], counts: list[int], shards: int) -> list[list[tuple[int, int]]]:
    """For each size (descending), how many of its groups each shard takes: [(shard, number)], as a heap would deal them one by one."""
    heap = [(0, k) for k in range(shards)]
    out = []
    for size, count in zip(sizes, counts, strict=True):
        took: dict[int, int] = {}
        if size > 0 and count > 4 * shards:
            # all places below a level t come before those above it; keep t so low that no more than `count` lie below
            t = (sum(load for load, _ in heap) + count * size) // shards - size
            fits = lambda t: sum(-(-(t - load) // size) for load, _ in heap if load < t)
            while fits(t) > count:
                t -= size
            took = {k: -(-(t - load) // size) for load, k in heap if load < t}
            heap = [(load + took.get(k, 0) * size, k) for load, k in heap]
            heapq.heapify(heap)
            count -= sum(took.values())
        for _ in range(count):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            took[k] = took.get(k, 0) + 1
        out.append(sorted(took.items()))
    return out


def _numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... within equal keys, by (hash bucket, order); df has a column _bucket."""
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(*keys, "_bucket", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = df.withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    return within.join(before, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_before", "_at", "_bucket")


def shard_groups(rows: DataFrame, group: Column, size: Column, order: list[str], shards: int = 40) -> DataFrame:
    """rows with shard (int) and slot (long): rows of equal `group` share a shard, shard loads (sums of `size`) are near equal.

    group: any value; nulls are one group. size: a non-negative long (null counts as 0). order: columns that order
    rows inside a shard's hash bucket. slot is gapless from 0 within a shard. Equal rows get slots of their own. Without
    rows there are none. Columns of rows named shard or slot are replaced. A group larger than a fair share still goes
    to one shard, as groups must stay together; the others then share the rest.
    """
    spark: SparkSession = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    key = F.coalesce(F.unhex(F.sha2(group.cast("string").cast("binary"), 256)), F.lit(b"\x00").cast("binary"))
    slim = stage(rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), key.alias("_key"), F.coalesce(size.cast("long"), F.lit(0)).alias("_size")), "shard-rows")
    buckets = max(BUCKETS, slim.count() // BUCKET_ROWS)
    more = F.greatest(F.length(F.bin("_total")) - BITS, F.lit(0))
    groups = slim.groupBy("_key").agg(F.sum("_size").alias("_total")).withColumn("_more", more)
    groups = groups.select("_key", F.expr("shiftleft(shiftright(_total, _more), _more)").alias("_bin"), "_total", F.pmod(F.xxhash64("_key"), F.lit(buckets)).alias("_bucket"))
    groups = stage(groups, "shard-groups")
    histogram = groups.groupBy("_bin").agg(F.count("*").alias("n"), F.sum("_total").alias("bytes")).toPandas().sort_values("_bin", ascending=False)  # some 150,000 rows at most
    dealt = deal([round(b / n) for b, n in zip(histogram["bytes"].tolist(), histogram["n"].tolist(), strict=True)], [int(x) for x in histogram["n"]], shards)
    ascending = dealt[::-1]
    many = np.array([len(x) for x in ascending], np.int64)
    table = spark.sparkContext.broadcast({
        "bin": histogram["_bin"].to_numpy(np.int64)[::-1].copy(),
        "first": np.concatenate([[0], np.cumsum(many)]).astype(np.int64),
        "shard": np.array([k for x in ascending for k, _ in x], np.int16),
        # number within the size up to which the shard takes, made ascending over all sizes by adding the size's first
        "upto": np.array([n for x in ascending for n in np.cumsum([n for _, n in x])], np.int64),
    })

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        base = np.concatenate([[0], np.cumsum(np.maximum.reduceat(t["upto"], t["first"][:-1]) if len(t["upto"]) else [])]).astype(np.int64)
        ends = t["upto"] + np.repeat(base[:-1], np.diff(t["first"]))
        for batch in batches:
            at = base[np.searchsorted(t["bin"], batch.column(1).to_numpy())] + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t["shard"][np.searchsorted(ends, at, "right")], pa.int32())], ["_key", "shard"])

    numbered = _numbered(groups.drop("_total"), ["_bin"], [F.col("_key")], "_rank").select("_key", "_bin", "_rank")
    placed = numbered.mapInArrow(place, "_key binary, shard int")
    joined = slim.join(placed, "_key").select("_row", "shard", F.pmod(F.xxhash64(*[F.col("_row")[c] for c in order]), F.lit(buckets)).alias("_bucket"))
    found = _numbered(stage(joined, "sharded"), ["shard"], [F.col("_row")[c] for c in order], "slot")
    return found.select("_row.*", "shard", "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, repeated rows each; a null text has no bytes, and all null texts are one group, as are all equal ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "text")
    # the text is needed for the group's digest alone; it is not carried further
    slim = rows.withColumn("_group", F.sha2("text", 256)).drop("text")
    found = shard_groups(slim, F.col("_group"), F.col("size"), ["doc_id", "text_crc32"], 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
