"""Sharding by fixed virtual slots, in DataFrame operations only.

A record's hash names one of `SLOTS` virtual slots for good. A slot-to-shard map says where each
slot lives; it is a small table with a version, and rebalancing edits the map, never the hash. The
first version deals slots out in turn. Bytes are then added up per slot, and the next version moves
slots out of shards that would exceed their part: slots are taken from large to small, each stays
where it is while its shard has room and goes to the emptiest shard otherwise.

The query's law is `bytes`: shards end near the mean size, and never further above it than the
smallest slot moved. Everything that is broadcast or folded in one row has `SLOTS` rows.

A record's place in its shard comes from two levels: counts per slot and stretch give the offset,
a sort inside a stretch gives the rest, so no shard is ever numbered in one task. The pipeline's
stage orders places by the mix of sources instead of by hash, with stretches of positions.

Defined results: a null text has no bytes and checksum 0, and its size is 1. A null id hashes as
empty text. Records equal in id and text share a slot, and take a place each. An empty table gives
an empty result. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stopscan.llm.common import id_text, settle
from stopscan.llm.pfair_mix import interleave

SLOTS = 4096
SHARDS = 16
#: A shard may exceed its even part by this many thousandths before slots leave it.
SLACK = 2
STRETCH_ROWS = 50_000


def records(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, size, text_crc32, hash, virtual_slot) of every document, and the columns `more`."""

    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                         F.crc32(text).alias("text_crc32"),
                         F.xxhash64(id_text(), text).alias("hash"), *more)
    return hashed.withColumn("virtual_slot", F.pmod("hash", F.lit(SLOTS)).cast("int"))


def first_map(spark: SparkSession, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots dealt out in turn."""

    return spark.range(SLOTS).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"),
        (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(current: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map, given (virtual_slot, bytes); most slots stay where they are."""

    known = current.join(F.broadcast(sizes), "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    packed = known.agg(
        F.max("version").alias("version"), F.sum("bytes").alias("total"),
        F.array_sort(F.collect_list(F.struct(
            (-F.col("bytes")).alias("order"), "virtual_slot", "shard", "bytes"))).alias("slots"))
    room = F.ceil(F.col("total") * (1000 + SLACK) / (1000 * shards))

    def place(state: Column, slot: Column) -> Column:
        load = F.get(state["loads"], slot["shard"])
        emptiest = F.array_min(F.transform(
            state["loads"], lambda v, i: F.struct(v.alias("v"), i.alias("i"))))["i"]
        to = F.when(load + slot["bytes"] <= F.col("room"), slot["shard"]).otherwise(emptiest)
        return F.get(F.transform(F.array(to), lambda t: F.struct(
            F.transform(state["loads"], lambda v, i: v + F.when(
                i == t, slot["bytes"]).otherwise(0)).alias("loads"),
            F.concat(state["to"], F.array(t)).alias("to"))), 0)

    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"),
                     F.expr("cast(array() as array<int>)").alias("to"))
    return packed.withColumn("room", room).select(
        (F.col("version") + 1).alias("version"), F.explode(F.arrays_zip(
            F.col("slots.virtual_slot").alias("virtual_slot"),
            F.aggregate("slots", start, place, lambda s: s["to"]).alias("shard"))).alias("z")
    ).select("version", "z.virtual_slot", "z.shard")


def grown(current: DataFrame, shards: int) -> DataFrame:
    """The next version with shard number `shards` added; it alone receives slots.

    Of each old shard's slots, in order of a hash, every (shards + 1)-th moves to the new one.
    """

    place = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("virtual_slot")))
    return current.select(
        (F.col("version") + 1).alias("version"), "virtual_slot",
        F.when(place % (shards + 1) == 0, shards).otherwise(F.col("shard")).alias("shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, slot_map: DataFrame | None = None,
            mixed: bool = False) -> DataFrame:
    """Every document with its shard and its place there, by the map given or a rebalanced one.

    Places follow the hash, or, if `mixed`, the documents' positions in the mix of their sources.
    """

    spark = docs.sparkSession
    listed = interleave(records(docs, "source"), carried=(
        "size", "text_crc32", "hash", "virtual_slot")).drop("slot") if mixed else records(docs)
    kept, _ = settle(listed, "records")
    loads, _ = settle(kept.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "slot-bytes")
    if slot_map is None:
        first, _ = settle(first_map(spark, shards), "slot-map-1")
        slot_map, _ = settle(rebalanced(first, loads.select("virtual_slot", "bytes"), shards),
                             "slot-map-2")
    placed = kept.join(F.broadcast(slot_map), "virtual_slot")
    if mixed:
        # Positions are unique, so a stretch holds at most STRETCH_ROWS documents.
        lane, order = ["shard"], ["position"]
        placed = placed.withColumn("stretch", F.floor(F.col("position") / STRETCH_ROWS))
    else:
        most = loads.agg(F.max("n")).first()[0] or 1
        stretches = max(1, -(-most // STRETCH_ROWS))
        lane, order = ["shard", "virtual_slot"], ["hash", "doc_id", "text_crc32"]
        placed = placed.withColumn("stretch", F.pmod(F.shiftright("hash", 12), F.lit(stretches)))
    before = placed.groupBy(*lane, "stretch").agg(
        F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(
            W.partitionBy("shard").orderBy(*lane[1:], "stretch").rowsBetween(
                W.unboundedPreceding, -1))).select(
        *lane, "stretch", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy(*lane, "stretch").orderBy(*order)) - 1
    return placed.withColumn("own", own).join(before, [*lane, "stretch"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("own")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        F.col("version").alias("map_version"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The last stage: every document's shard, and its place there in the order of the mix."""

    return sharded(docs, mixed=True)
