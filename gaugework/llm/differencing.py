"""Shards of nearly equal bytes for groups that must stay whole, by Karmarkar-Karp differencing.

Rows with equal texts form a group. Groups of at least 1/``grain`` of an even share are items of their own; all others
are dealt by digest to ``shards * grain`` parcels. So at most ``2 * shards * grain`` weights reach the driver, whatever
the table's size. Each weight starts as a partition of itself and zeros; the two partial partitions with the largest
spread are combined again and again, the largest part of one with the smallest of the other.

Defined cases: null and empty texts have size 1 and form one group; repeated rows count each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import documents, numbered
from gaugework.llm.registry import query
from gaugework.session import materialise

SHARDS = 16
GRAIN = 512


def difference(weights: dict, shards: int) -> dict:
    """item: shard, for items with weights, by Karmarkar-Karp differencing.

    A partial partition is a list of (sum, tree of items), largest first; ties go by age.
    """
    heap = []
    for age, (item, weight) in enumerate(sorted(weights.items(), key=lambda x: (-x[1], str(x[0])))):
        parts = [(weight, (item,))] + [(0, ())] * (shards - 1)
        heap.append((-weight, age, parts))
    heapq.heapify(heap)
    age = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parts = sorted(((x + y, (s, t)) for (x, s), (y, t) in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], age, parts))
        age += 1
    shard_of = {}
    for shard, (_, tree) in enumerate(heap[0][2] if heap else []):
        left = [tree]
        while left:
            node = left.pop()
            if len(node) == 1:
                shard_of[node[0]] = shard
            else:
                left.extend(node)
    return shard_of


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... within a shard by id) for every row."""
    text, raw = F.col(text_column), F.col(text_column).cast("binary")
    rows = materialise(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
            F.unhex(F.md5(F.coalesce(raw, F.lit(b"")))).alias("digest"),
        ).withColumn("parcel", F.pmod(F.xxhash64("digest"), F.lit(shards * grain))),
        "sizes",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = materialise(rows.groupBy("digest", "parcel").agg(F.sum("size").alias("weight")), "groups")
    heavy = F.col("weight") * shards * grain >= total
    own = groups.filter(heavy).select("digest", "weight").collect()
    parcels = groups.filter(~heavy).groupBy("parcel").agg(F.sum("weight").alias("weight")).collect()
    weights = {("own", bytes(r[0])): r[1] for r in own} | {("parcel", r[0]): r[1] for r in parcels}
    shard_of = difference(weights, shards)

    spark = docs.sparkSession
    by_digest = spark.createDataFrame(
        [(bytearray(k), s) for (kind, k), s in shard_of.items() if kind == "own"], "digest binary, own_shard int")
    by_parcel = spark.createDataFrame(
        [(k, s) for (kind, k), s in shard_of.items() if kind == "parcel"], "parcel long, parcel_shard int")
    dealt = (
        rows.join(F.broadcast(by_digest), "digest", "left").join(F.broadcast(by_parcel), "parcel", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "parcel_shard").alias("shard"))
    )
    return numbered(dealt, "shard", ["doc_id"], "slot", "shards")


@query("op6_differencing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
