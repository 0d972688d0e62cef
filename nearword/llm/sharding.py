"""Shards by fixed virtual slots.

A record is an id with its text. Its slot is a hash of the id and the text's CRC modulo a number of slots
that never changes, so that an id with many texts, or none, spreads over the slots. The bytes of each slot
are summed, and a small versioned table says which shard holds which slot. Rebalancing and growing write
a new version that moves whole slots; no record is hashed anew. Places in a shard are counted over the rows
that are placed, so a map serves whatever rows there are by then. All of it is DataFrame functions; what
the driver holds is the slot table alone, whose size is the fixed number of slots.

Defined cases: a null text has no bytes (size 1) and the CRC of an empty text. Null ids are an id like others.
Rows that repeat an id and its text are placed one by one, next to each other. An empty table gives an empty result. Other
columns are ignored by :func:`place`. A record larger than a shard's fair share makes its shard larger.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Never change this for data that has been placed.
SLOTS = 4096

MAP = T.StructType([T.StructField("virtual_slot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False), T.StructField("bytes", T.LongType(), False)])


def virtual_slot(doc_id: Column, text_crc32: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_crc32), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row; size is the text's UTF-8 bytes plus 1."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(F.col("doc_id"), F.crc32(text), slots).alias("virtual_slot"))


def slot_totals(placed: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of each slot: ``slots`` values, whatever the input's size."""
    found = {r[0]: (r[1], r[2]) for r in placed.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    return [found.get(s, (0, 0)) for s in range(slots)]


def _dealt(out: list[int], loose: list[int], totals: list[tuple[int, int]], sizes: dict[int, int]) -> None:
    """Give loose slots to the shards of ``sizes``: those with bytes in descending order, each to the shard with the fewest so far; empty ones so that slots are even."""
    heap = [(size, shard) for shard, size in sizes.items()]
    heapq.heapify(heap)
    for slot in sorted((s for s in loose if totals[s][0]), key=lambda s: (-totals[s][0], s)):
        size, out[slot] = heapq.heappop(heap)
        heapq.heappush(heap, (size + totals[slot][0], out[slot]))
    empty = [s for s in loose if not totals[s][0]]
    counts = Counter(out[s] for s in range(len(out)) if s not in set(empty))
    heap = [(counts[shard], shard) for shard in sizes]
    heapq.heapify(heap)
    for slot in empty:
        n, out[slot] = heapq.heappop(heap)
        heapq.heappush(heap, (n + 1, out[slot]))


def assign(totals: list[tuple[int, int]], shards: int) -> list[int]:
    """Each slot's shard, so that bytes are near equal, and empty slots' future ones are spread."""
    out = [-1] * len(totals)
    _dealt(out, list(range(len(totals))), totals, dict.fromkeys(range(shards), 0))
    return out


def rebalance(current: list[int], totals: list[tuple[int, int]], shards: int) -> list[int]:
    """A map for ``shards`` shards that moves few slots: only out of shards above the mean in bytes or empty slots, or that are gone.

    Where there are more shards than before, slots move into the new ones only.
    """
    out = list(current)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    loose = []
    for slot, shard in enumerate(current):
        (held[shard] if shard < shards else loose).append(slot)
    sizes = {s: sum(totals[x][0] for x in held[s]) for s in range(shards)}
    mean = sum(t[0] for t in totals) / shards
    most_empty = -(-sum(not t[0] for t in totals) // shards)
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda x: (-totals[x][0], x)):
            if 0 < totals[slot][0] <= sizes[shard] - mean:
                sizes[shard] -= totals[slot][0]
                loose.append(slot)
        loose += [x for x in held[shard] if not totals[x][0]][most_empty:]
    before = max(current, default=-1) + 1
    for slot in loose:
        out[slot] = -1
    _dealt(out, loose, totals, {s: sizes[s] for s in range(before if shards > before else 0, shards)})
    return out


def map_rows(assigned: list[int], totals: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(virtual_slot, shard, bytes) of each slot; the bytes are those that the map was made for."""
    return [(slot, shard, int(totals[slot][0])) for slot, shard in enumerate(assigned)]


class SlotMap:
    """The versions of a slot-to-shard map below ``path``: one Parquet folder each, never overwritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, rows: list[tuple[int, int, int]], version: int) -> None:
        self.spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(f"{self.path}/version={version:06d}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(f"{self.path}/version={version:06d}")

    def latest(self) -> int | None:
        """The highest version that was written whole, or None."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(root):
            return None
        names = [s.getPath() for s in store.listStatus(root)]
        return max((int(p.getName().removeprefix("version=")) for p in names if store.exists(hadoop.Path(p, "_SUCCESS"))), default=None)


def place(docs: DataFrame, table: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) of each row under a map.

    ``slot`` is the row's place in its shard, gapless from 0: rows of ``docs`` in the shard's earlier virtual
    slots, plus the row's rank by doc_id in its own. The map has ``slots`` rows, so it is broadcast.
    """
    own = records(docs, slots)
    counts = own.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.coalesce("n", F.lit(0))
    bases = table.select("virtual_slot", "shard").join(F.broadcast(counts), "virtual_slot", "left").select("virtual_slot", "shard", before.alias("base"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return own.withColumn("rank", rank).join(F.broadcast(bases), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("rank") - 1).alias("slot")
    )


def build(docs: DataFrame, path: str, shards: int, slots: int = SLOTS) -> SlotMap:
    """Sum the slots' bytes and write version 1 of their map."""
    totals = slot_totals(records(docs, slots), slots)
    out = SlotMap(docs.sparkSession, path)
    out.save(map_rows(assign(totals, shards), totals), 1)
    return out


def edit(docs: DataFrame, maps: SlotMap, shards: int, slots: int = SLOTS) -> int:
    """Write the next version of a map for the rows as they are now and ``shards`` shards; returns its number."""
    version = maps.latest()
    if version is None:
        raise ValueError(f"no map in {maps.path}")
    current = [r[0] for r in maps.load(version).orderBy("virtual_slot").select("shard").collect()]
    totals = slot_totals(records(docs, slots), slots)
    maps.save(map_rows(rebalance(current, totals, shards), totals), version + 1)
    return version + 1
