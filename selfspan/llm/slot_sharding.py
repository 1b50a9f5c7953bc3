"""Sharding by fixed virtual slots and a versioned slot-to-shard map, in DataFrame operations only.

Every record hashes into one of a few thousand virtual slots for good. Bytes and rows are summed per slot (partial sums
before the shuffle), and a small map says which shard holds a slot. Version 1 deals slots in turn; rebalancing writes a
next version that moves as few slots as it can: each shard keeps its largest slots up to the mean load, and what
overflows goes, largest first, to whichever shard then has least. Adding shards is the same edit with more shards.

The map has one row per slot however many records there are, so it may be broadcast. An id whose records weigh more than
a mean slot (there are fewer of these than slots) is hot: its records are spread over the slots by what tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SLOTS = 4096
SHARDS = 8


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def virtual_slot(*by: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(slots)).cast("int")


def with_slots(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Add ``vslot`` to records that have doc_id, size, text_crc32 and ``row``, a number of their own.

    The slot is a hash of doc_id, but for ids that hold more bytes than a mean slot: each of their records goes by doc_id,
    text and row. There are at most ``slots`` of these ids, so they are broadcast.
    """
    mean = (records.agg(F.sum("size")).first()[0] or 0) / slots
    hot = records.groupBy("doc_id").agg(F.sum("size").alias("held"), F.count("*").alias("n")).where((F.col("held") > mean) & (F.col("n") > 1))
    r, h = records.alias("r"), F.broadcast(hot.select("doc_id", F.lit(True).alias("hot"))).alias("h")
    slot = F.when(F.col("hot"), virtual_slot("r.doc_id", "text_crc32", "row", slots=slots)).otherwise(virtual_slot("r.doc_id", slots=slots))
    return r.join(h, F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")), "left").select("r.*", slot.alias("vslot"))


def slot_loads(records: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of records that have ``vslot`` and ``size``."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots dealt in turn. Columns: vslot, bytes, rows, shard, version."""
    return loads.select("vslot", "bytes", "rows", (F.col("vslot") % shards).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalance(current: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map: near-equal bytes over ``shards`` (as many as before, or more), moving few slots.

    Both steps run over the map alone, whose size is the number of slots.
    """
    everything = Window.partitionBy(F.lit(0))
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    judged = (
        current.withColumn("mean", F.sum("bytes").over(everything) / shards)
        .withColumn("keeps", F.sum("bytes").over(largest_first.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("mean"))
    )
    summary = judged.agg(
        F.collect_list(F.when(F.col("keeps"), F.struct("shard", "bytes"))).alias("held"),
        F.reverse(F.sort_array(F.collect_list(F.when(~F.col("keeps"), F.struct("bytes", "vslot"))))).alias("over"),
    )
    start = "transform(sequence(0, {n} - 1), s -> aggregate(filter(held, h -> h.shard = s), 0L, (a, h) -> a + h.bytes))"
    moved = summary.selectExpr(
        f"""aggregate(over,
            named_struct('loads', {start.format(n=shards)}, 'moves', cast(array() as array<struct<vslot:int,to:int>>)),
            (acc, o) -> named_struct(
                'loads', transform(acc.loads, (x, i) -> if(i + 1 = array_position(acc.loads, array_min(acc.loads)), x + o.bytes, x)),
                'moves', concat(acc.moves, array(named_struct('vslot', o.vslot, 'to', cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int)))))
        ).moves AS moves"""
    ).select(F.inline("moves"))
    return current.join(F.broadcast(moved), "vslot", "left").select(
        "vslot", "bytes", "rows", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version")
    )


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    A place is the rows of the shard's earlier virtual slots (from the map) plus the place within the own virtual slot,
    so no task ever sorts a whole shard.
    """
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("vslot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    own = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    return (
        records.withColumn("slot", F.row_number().over(own).cast("long") - 1)
        .join(F.broadcast(offsets), "vslot")
        .withColumn("slot", F.col("slot") + F.col("offset"))
        .drop("offset")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), vslot.

    Only ``doc_id`` and ``text`` are read, whatever other columns there are. A null text has size 1 and the crc32 of no
    bytes; a null doc_id is an id like another; repeated rows get places of their own; an empty table gives no rows.
    Records of one doc_id stay together, as its hash decides the slot, unless they outweigh a mean slot: then they are
    spread, as else no map could make the shards equal. Records of equal text but other ids are not kept together, for
    the same reason: a group of copies may hold more bytes than a shard.
    """
    records = materialise(
        docs.select(
            "doc_id",
            record_size().alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-records",
    )
    placed = materialise(with_slots(records, slots).drop("row"), "shard-slots")
    slot_map = materialise(rebalance(first_map(slot_loads(placed), shards), shards), "slot-map")
    return place(placed, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
