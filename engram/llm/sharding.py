"""Minimax contiguous sharding of atomic groups (op5).

Groups are rows of equal text, in one list: groups larger than an even share of what is left come first, largest first,
all others follow in the order of a 64-bit hash of the text. A group of the first kind fills a shard by itself. For the
others the smallest shard capacity for which a greedy pass needs no more than the shards left is found by binary
search, and the cuts are those of that pass. So shard loads are as small as contiguous cuts of that list allow, from the
largest load on.

The passes run over sums. Groups of more than a 4,096th of all bytes (at most 4,096 of them) are items by themselves, and
the hash ranges between are one item each. Moving a cut to the end of its range adds at most that range to a shard, which
bounds the optimum from below; the greedy passes for both bounds say in which ranges a cut can fall, and only those are
split further, down to single groups. So the driver holds a few thousand sums at any input size, and the capacity is the
exact optimum over single groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm import common

LEAST, MOST = -(1 << 63), (1 << 63) - 1
SUMS = pa.schema([("item", pa.int64()), ("size", pa.int64()), ("n", pa.int64())])


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for ordered sizes, and the index at which each shard after the first begins."""
    upto = np.concatenate(([0], np.cumsum(np.asarray(sizes, dtype=np.int64))))

    def cuts(capacity: int) -> list[int] | None:
        found, at = [], 0
        while (at := int(np.searchsorted(upto, upto[at] + capacity, side="right")) - 1) < len(sizes):
            found.append(at)
            if len(found) >= shards:
                return None
        return found

    total = int(upto[-1])
    low, high = max([-(-total // shards), *sizes], default=0), total
    while low < high:
        middle = (low + high) // 2
        if cuts(middle) is None:
            low = middle + 1
        else:
            high = middle
    return int(low), cuts(low) or []


def range_sums(groups: DataFrame, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of sizes, number of groups) of each range of keys that starts at begins[i] and ends before the next."""
    held = groups.sparkSession.sparkContext.broadcast(begins)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(held.value), dtype=np.int64), np.zeros(len(held.value), dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(held.value, batch.column("key").to_numpy(), side="right") - 1
            np.add.at(size, at, batch.column("size").to_numpy())
            n += np.bincount(at, minlength=len(n))
        some = np.flatnonzero(n)
        yield common.table(SUMS, {"item": some, "size": size[some], "n": n[some]})

    rows = groups.select("key", "size").mapInArrow(add, "item long, size long, n long").groupBy("item").agg(F.sum("size"), F.sum("n")).collect()
    size, n = np.zeros(len(begins), dtype=np.int64), np.zeros(len(begins), dtype=np.int64)
    for item, s, k in rows:
        size[item], n[item] = s, k
    held.destroy()
    return size, n


def _open(size: np.ndarray, n: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of more than one group that a cut of the optimum can fall into."""
    upto = np.concatenate(([0], np.cumsum(size)))
    many = n > 1
    high, _ = minimax_cuts(size.tolist(), shards)
    low = max(-(-int(upto[-1]) // shards), int(size[~many].max(initial=0)), high - int(size[many].max(initial=0)))
    wanted = np.zeros(len(size), dtype=bool)
    first = last = 0
    for _ in range(shards - 1):
        # The earliest and the latest place of this cut, for any capacity from low to high.
        begin = int(np.searchsorted(upto, first + low, side="right")) - 1
        end = min(int(np.searchsorted(upto, last + high, side="right")) - 1, len(size) - 1)
        first = int(upto[min(begin, len(size))])
        last = last + high if many[end] else int(upto[end])
        wanted[begin : end + 1] = True
    return np.flatnonzero(wanted & many)


def cut_keys(groups: DataFrame, shards: int, ranges: int = 4_096, pieces: int = 64) -> list[int]:
    """groups: (key long, size long), keys distinct. The keys at which shards 1, 2, ... begin, in ascending order."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    if shards <= 1 or not total:
        return []
    large = [r.key for r in groups.where(F.col("size") > total // ranges).select("key").collect()]
    step = (1 << 64) // ranges
    begins = {LEAST + i * step for i in range(ranges)} | set(large) | {k + 1 for k in large if k < MOST}
    while True:
        begin = np.array(sorted(begins), dtype=np.int64)
        size, n = range_sums(groups, begin)
        split = _open(size, n, shards)
        if not len(split):
            return begin[minimax_cuts(size.tolist(), shards)[1]].tolist()
        for i in split.tolist():
            a, b = int(begin[i]), int(begin[i + 1]) if i + 1 < len(begin) else MOST + 1
            begins.update(a + (b - a) * k // pieces for k in range(1, pieces))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Adds to each row's doc_id: size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law).

    A null text counts as an empty one, size 1. Equal texts share a shard, whoever's they are. Repeated rows have slots
    of their own, a null doc_id stays null, other columns are not read, and an empty table gives no rows.
    """
    scratch = common.Scratch(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit(""))
    digest = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.spark_partition_id().alias("pid"),
    )
    rows = scratch.write(digest, "digest")
    groups = scratch.write(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    total = rows.agg(F.sum("size")).first()[0] or 0
    own: list[int] = []
    left = total
    for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if r["size"] * (shards - len(own)) <= left:
            break
        own.append(r["key"])
        left -= r["size"]
    rest = groups.where(~F.col("key").isin(own)) if own else groups
    cuts = cut_keys(rest, shards - len(own))
    at: Column = F.lit(len(own))
    for k in cuts:
        at = at + (F.col("key") >= F.lit(k)).cast("int")
    for i, k in reversed([*enumerate(own)]):
        at = F.when(F.col("key") == F.lit(k), F.lit(i)).otherwise(at)
    placed = rows.withColumn("shard", at.cast("int"))
    base = common.partition_offsets(placed, ["shard"])
    order = W.partitionBy("pid", "shard").orderBy("key", "doc_id")
    return (
        placed.withColumn("local", F.row_number().over(order) - 1)
        .join(base, ["pid", "shard"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.read(spark, sf_dir, "documents"))
