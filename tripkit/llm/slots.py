"""Sharding by fixed virtual slots.

A record's hash names one of a few thousand slots, for good. Bytes are added up per slot, and
a versioned map says which shard holds which slot. Rebalancing edits the map: a record moves
only if its slot does.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripkit.llm.common import broadcast_if_small, row_hash
from tripkit.operators.layout import checkpointed

SLOTS = 4096
SHARDS = 16
# Rows alike in all columns stay in one slot up to so many copies; more are dealt over the slots.
COPIES = 64


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot (``shard_of[slot]``) in one version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def load(self, sizes: Sequence[int]) -> list[int]:
        total = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            total[shard] += sizes[slot]
        return total


def balanced_map(sizes: Sequence[int], shards: int, version: int = 1) -> SlotMap:
    """Give the slots, largest first, to the shard with the fewest bytes so far."""
    shard_of = [0] * len(sizes)
    heap = [(0, 0, shard) for shard in range(shards)]
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, count, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], count + 1, shard))
    return SlotMap(version, shards, tuple(shard_of))


def rebalanced(current: SlotMap, sizes: Sequence[int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
    """The next version of a map for new sizes, or for more shards, moving few slots.

    Added shards are filled to the mean from the fullest ones, and nothing else moves. Without
    added shards slots go from the fullest shard to the emptiest one until both are within
    ``slack`` of the mean or no slot would help.
    """
    shards = shards or current.shards
    if shards < current.shards:
        raise ValueError("shards can only be added")
    shard_of = list(current.shard_of)
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        held[shard].append(slot)
    load = [sum(sizes[s] for s in slots) for slots in held]
    mean = sum(load) / shards
    takers = range(current.shards, shards) if shards > current.shards else range(shards)
    while True:
        full = max(range(current.shards), key=lambda i: (load[i], -i))
        empty = min(takers, key=lambda i: (load[i], i))
        gap, need = load[full] - load[empty], mean - load[empty]
        done = need <= mean * slack and (shards > current.shards or load[full] <= mean * (1 + slack))
        fits = [s for s in held[full] if 0 < sizes[s] < gap]
        if done or not fits:
            break
        slot = min(fits, key=lambda s: (abs(min(gap / 2, need) - sizes[s]), s))
        held[full].remove(slot)
        held[empty].append(slot)
        shard_of[slot] = empty
        load[full], load[empty] = load[full] - sizes[slot], load[empty] + sizes[slot]
    return SlotMap(current.version + 1, shards, tuple(shard_of))


def save_map(spark: SparkSession, slot_map: SlotMap, folder: str) -> None:
    """Append a version to the map table in ``folder``: ``(version, slot, shard)``, never rewritten."""
    rows = [(slot_map.version, slot, shard) for slot, shard in enumerate(slot_map.shard_of)]
    spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.mode("append").parquet(folder)


def has_map(spark: SparkSession, folder: str) -> bool:
    """Whether ``folder`` holds a map, in whatever store Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
    """One version of a stored map, the latest by default. Maps have one row per slot."""
    table = spark.read.parquet(folder)
    wanted = version if version is not None else table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == wanted).orderBy("slot").collect()
    if [r["slot"] for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError(f"version {wanted} is not whole")
    shard_of = tuple(r["shard"] for r in rows)
    return SlotMap(wanted, max(shard_of) + 1, shard_of)


def with_slots(
    docs: DataFrame, text: str = "text", slots: int = SLOTS, carry: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) in ``row``, with ``size`` (UTF-8 bytes plus 1), ``mark`` and ``virtual_slot``.

    The slot is that of a hash of the whole row, so rows that share an id or a text spread out.
    Rows that are alike in all columns can stand for one another: more than ``COPIES`` of them
    are dealt over the slots by their place in the input, so that no slot fills up with copies. ``docs`` is
    a stored table, whose rows come in the same order whenever a task reads them. A NULL text has no bytes.
    """
    mark = row_hash(docs, F.lit(SLOTS))
    many = docs.select(mark.alias("hot")).groupBy("hot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES)
    hot = broadcast_if_small(checkpointed(many.select("hot")))
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in (carry or docs.columns)]).alias("row"),
        (F.coalesce(F.octet_length(docs[f"`{text}`"].cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        mark.alias("mark"),
        F.monotonically_increasing_id().alias("at"),
    )
    dealt = F.when(F.col("hot").isNotNull(), F.xxhash64("mark", "at")).otherwise(F.col("mark"))
    return packed.join(hot, F.col("mark") == F.col("hot"), "left").select(
        "row", "size", dealt.alias("mark"), F.pmod(dealt, F.lit(slots)).cast("int").alias("virtual_slot")
    )


def slot_sizes(slotted: DataFrame) -> DataFrame:
    """``(virtual_slot, n, bytes)`` of the slots in use: at most one row per slot."""
    return slotted.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def shard(
    docs: DataFrame,
    text: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
    slot_map: SlotMap | None = None,
    carry: Sequence[str] | None = None,
    map_folder: str | None = None,
) -> DataFrame:
    """``(row, size, virtual_slot, shard, position)``: every row's shard and its number in the shard.

    Without ``slot_map`` the latest map in ``map_folder`` is taken; if there is none yet, one is made
    from the slots' bytes, so that shards get nearly equal bytes, and stored there as version 1. The driver sees one count and one size per slot. Positions in a shard run from 0
    without gaps, slot after slot and by row hash within a slot, so that a task numbers one
    slot, never a shard. No rows give no rows.
    """
    slotted = with_slots(docs, text, slots, carry)
    counts = checkpointed(slot_sizes(slotted)).collect()
    sizes, numbers = [0] * slots, [0] * slots
    for r in counts:
        sizes[r["virtual_slot"]], numbers[r["virtual_slot"]] = r["bytes"], r["n"]
    if slot_map is None and map_folder is None:
        slot_map = balanced_map(sizes, shards)
    elif slot_map is None:
        spark = docs.sparkSession
        if not has_map(spark, map_folder):
            save_map(spark, balanced_map(sizes, shards), map_folder)
        slot_map = load_map(spark, map_folder)
    if len(slot_map.shard_of) != slots:
        raise ValueError("the map has another number of slots")
    offsets, filled = [0] * slots, [0] * slot_map.shards
    for slot in range(slots):
        offsets[slot] = filled[slot_map.shard_of[slot]]
        filled[slot_map.shard_of[slot]] += numbers[slot]
    table = docs.sparkSession.createDataFrame(
        [(slot, slot_map.shard_of[slot], offsets[slot]) for slot in range(slots)],
        "virtual_slot int, shard int, offset long",
    )
    within = Window.partitionBy("virtual_slot").orderBy("mark")
    # One row per slot: a broadcast of fixed size.
    return slotted.join(F.broadcast(table), "virtual_slot").select(
        "row",
        "size",
        "virtual_slot",
        "shard",
        (F.col("offset") + F.row_number().over(within) - 1).cast("long").alias("position"),
    )


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the text in UTF-8; that of no bytes for NULL."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
