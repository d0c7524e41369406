"""Sharding by Karmarkar-Karp differencing.

Texts that are equal are one group, which is never divided. Each group starts as a partial partition: all its bytes in one of
the shards, none in the others. The two partial partitions with the largest spread (largest part less smallest) are combined,
the largest part of one with the smallest of the other, until one is left.

On Spark the groups are dealt by hash into buckets; each bucket is differenced in one task down to one partial partition,
whose parts are then nearly equal. The buckets' partial partitions are differenced in the same way, level after level, `fan_in` at a
time, so no task ever has more than `fan_in` partial partitions and the driver has none. A group's shard follows from where its part
went at each level.

Slots number the rows of a shard from 0 without gaps: counts of hash ranges are summed first, then rows are numbered within a range.

Defined results: a null text has 0 bytes and crc 0 and forms a group of its own, apart from empty texts; repeated rows are in one
shard, as any equal texts; ties are broken by group hash; an empty table gives an empty result; where one group outweighs
a shard's share, its shard has that group and as little else as balance allows. A row keeps all its columns in `row`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 24
FAN_IN = 4096
OVERHEAD = 8  # bytes of a row besides its text


def difference(parts: np.ndarray) -> np.ndarray:
    """parts: an array of n partial partitions of k sums. Returns where each part goes: an n by k array of positions 0 to k - 1 in
    the one partition that is left, whose sums rise with position."""
    n, k = parts.shape
    sums = {i: np.sort(parts[i]) for i in range(n)}
    # What each position of a partition holds: (row, part) of the input. Empty parts needn't be followed.
    place = {i: [[(i, int(p))] if parts[i, p] else [] for p in np.argsort(parts[i], kind="stable")] for i in range(n)}
    heap = [(-int(s[-1] - s[0]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        if len(place[a][-1]) < len(place[b][-1]):
            a, b = b, a
        added = sums[a] + sums.pop(b)[::-1]
        order = np.argsort(added, kind="stable")
        own, other = place[a], place.pop(b)
        for position in range(k):
            own[position].extend(other[k - 1 - position])
        place[a], sums[a] = [own[p] for p in order], added[order]
        heapq.heappush(heap, (-int(sums[a][-1] - sums[a][0]), a))
    out = np.zeros((n, k), np.int32)
    if n:
        for position, held in enumerate(place[heap[0][1]]):
            for i, p in held:
                out[i, p] = position
    return out


def _level(nodes: DataFrame, shards: int) -> DataFrame:
    """nodes: (bucket, node, sums). Adds `moved` (positions of its parts) and the bucket's own sums, `total`, on its first node."""

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable").reset_index(drop=True)
        parts = np.array(frame["sums"].tolist(), np.int64).reshape(len(frame), shards)
        moved = difference(parts)
        total = np.zeros(shards, np.int64)
        np.add.at(total, moved.ravel(), parts.ravel())
        return pd.DataFrame({"bucket": frame["bucket"], "node": frame["node"], "moved": list(moved), "total": [total if i == 0 else None for i in range(len(frame))]})

    return nodes.groupBy("bucket").applyInPandas(combine, "bucket bigint, node bigint, moved array<int>, total array<bigint>")


def _groups_level(groups: DataFrame, shards: int) -> DataFrame:
    """groups: (bucket, k1, k2, bytes). The first level, where every partial partition is one group: (bucket, k1, k2, part, sums on one row)."""

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["k1", "k2"], kind="stable").reset_index(drop=True)
        parts = np.zeros((len(frame), shards), np.int64)
        parts[:, -1] = frame["bytes"]
        moved = difference(parts)[:, -1]
        total = np.zeros(shards, np.int64)
        np.add.at(total, moved, parts[:, -1])
        return pd.DataFrame({"bucket": frame["bucket"], "k1": frame["k1"], "k2": frame["k2"], "part": moved, "total": [total if i == 0 else None for i in range(len(frame))]})

    return groups.groupBy("bucket").applyInPandas(combine, "bucket bigint, k1 bigint, k2 bigint, part int, total array<bigint>")


def assign(groups: DataFrame, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """(k1, k2, shard) from (k1, k2, bytes), one row a group."""
    spark = groups.sparkSession
    scratch = common.Scratch(spark, "sharding")
    n = groups.count()
    buckets = max(1, -(-2 * n // fan_in))  # half full, so that chance doesn't fill one beyond fan_in
    dealt = scratch.save(_groups_level(groups.withColumn("bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(buckets))), shards))
    place = dealt.select("k1", "k2", "bucket", "part")
    nodes = dealt.where("total is not null").select(F.col("bucket").alias("node"), F.col("total").alias("sums"))
    while True:
        last = buckets <= fan_in
        above = 1 if last else -(-buckets // fan_in)
        level = scratch.save(_level(nodes.withColumn("bucket", F.pmod("node", F.lit(above)).cast("bigint")), shards))
        step = level.select(F.col("node").alias("bucket"), F.col("bucket").alias("above"), "moved")
        place = place.join(step, "bucket").select("k1", "k2", F.col("above").alias("bucket"), F.get("moved", F.col("part")).alias("part"))
        if last:
            return place.select("k1", "k2", F.col("part").alias("shard"))
        nodes, buckets = level.where("total is not null").select(F.col("bucket").alias("node"), F.col("total").alias("sums")), above


def shard(docs: DataFrame, keep: list[str] | None = None, text: str = "text", shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """Every row of docs as `row` (its columns, or those in keep), with size, text_crc32, shard and slot."""
    scratch = common.Scratch(docs.sparkSession, "shards")
    t = F.col(f"`{text}`")
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)])
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("bigint")
    # 128 bits name a text; a null hashes to the seeds alone, which no text does.
    s = docs.select(row.alias("row"), size.alias("size"), F.coalesce(F.crc32(t), F.lit(0)).cast("bigint").alias("text_crc32"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))
    groups = scratch.save(s.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")))
    where = scratch.save(assign(groups, shards, fan_in))
    # A row's range is a hash of its own, so that a large group's rows are spread over the ranges.
    named = "doc_id" in (keep or docs.columns)
    placed = s.join(where, ["k1", "k2"]).withColumn("part", F.pmod(F.xxhash64("row.doc_id" if named else "row", "k1"), F.lit(1024)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).selectExpr("shard", "part", "coalesce(sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding), 0) as before")
    order = "k1, k2, row.doc_id" if named else "k1, k2"
    numbered = placed.selectExpr("*", f"row_number() over (partition by shard, part order by {order}) - 1 as place").join(F.broadcast(counts), ["shard", "part"])  # at most shards * 1024 rows
    return numbered.selectExpr("row", "size", "text_crc32", "shard", "before + place as slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shard(common.read(spark, sf_dir, "documents"), keep=["doc_id"])
    return s.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One Parquet folder for each shard, rows by slot within its files."""
    s = common.unnested(shard(docs, shards=shards), F.col("shard"), F.col("slot"))
    s.repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
