"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots that never change. Bytes are summed per slot, and a versioned
map, one row per slot and version, says which shard holds a slot. Rebalancing edits the map: a shard
over its fair share gives up its smallest slots, and these go, largest first, to the emptiest shard.

Only slot sums leave the tasks, at most ``SLOTS`` rows, whatever the input is. All work on rows is done by
DataFrame functions.

Defined cases: a null text has no bytes and counts one; a null id is hashed like any value; equal rows
fall into one slot and get different positions; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelake.llm.common import documents
from tunelake.session import cut_lineage

SLOTS = 4096
#: A slot is cut into so many cells by other bits of the hash, so that positions are counted in small groups.
CELLS = 16
SHARDS = 16


def _hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def slot_rows(frame: DataFrame, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, virtual ``slot_no`` and ``cell`` of every record; the text is not carried on."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = documents(frame, id_column, text_column).select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    key = _hash("doc_id", "text_crc32")
    return rows.withColumn("slot_no", F.pmod(key, F.lit(slots)).cast("int")).withColumn(
        "cell", F.pmod(F.shiftright(key, 32), F.lit(CELLS)).cast("int")
    )


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot_no``, ``bytes`` and ``rows`` of every slot, empty ones too."""
    sums = rows.groupBy("slot_no").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot_no"))
    return every.join(sums, "slot_no", "left").select(
        "slot_no", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def first_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0: slots dealt to shards in turn, without looking at sizes."""
    return loads.select(F.lit(0).alias("version"), "slot_no", F.pmod("slot_no", F.lit(shards)).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map, for ``shards`` shards (more or fewer than before).

    A shard keeps its largest slots as long as their sum stays within the mean. All other slots are
    placed one by one, largest first, on the shard with the fewest bytes. The map has one row per slot,
    so it is sorted and folded as one array; records are not touched here.
    """
    held = slot_map.join(loads, "slot_no")
    mean = F.sum("bytes").over(W.partitionBy()) / F.lit(shards)
    within = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "slot_no"))
    held = held.withColumn("stays", (F.col("shard") < shards) & (within <= mean))
    entry = F.struct((-F.col("bytes")).alias("order"), "slot_no", "bytes", "shard", "stays", "version")
    table = held.agg(F.array_sort(F.collect_list(entry)).alias("slots"))

    def kept_bytes(shard: int) -> Column:
        kept = F.filter("slots", lambda s: s["stays"] & (s["shard"] == shard))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda total, s: total + s["bytes"])

    start = F.struct(F.array(*[kept_bytes(shard) for shard in range(shards)]).alias("loads"), F.array().cast("array<struct<slot_no:int,shard:int>>").alias("picks"))

    def place(state, slot):
        target = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda load, n: F.when(n == target, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["picks"], F.array(F.struct(slot["slot_no"].alias("slot_no"), target.alias("shard")))).alias("picks"),
        )

    moved = F.aggregate(F.filter("slots", lambda s: ~s["stays"]), start, place)["picks"]
    stay = F.transform(F.filter("slots", lambda s: s["stays"]), lambda s: F.struct(s["slot_no"].alias("slot_no"), s["shard"].alias("shard")))
    version = F.get("slots", F.lit(0))["version"] + 1
    pairs = table.select(version.alias("version"), F.explode(F.concat(stay, moved)).alias("pair"))
    return pairs.select("version", "pair.slot_no", "pair.shard")


def positions(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with their ``shard`` and their position in it, from 0 without gaps.

    A position is the number of rows in the cells before plus the place in the cell. Cells are at most
    ``SLOTS * CELLS`` rows, which bounds the table that is joined; only a cell is ever sorted.
    """
    cells = rows.groupBy("slot_no", "cell").agg(F.count("*").alias("n")).join(slot_map.select("slot_no", "shard"), "slot_no")
    before = F.sum("n").over(W.partitionBy("shard").orderBy("slot_no", "cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cut_lineage(cells.select("slot_no", "cell", "shard", F.coalesce(before, F.lit(0)).alias("before")))
    place = F.row_number().over(W.partitionBy("slot_no", "cell").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("place", place - 1)
    # At most 65,536 cells whatever the input is.
    joined = placed.join(F.broadcast(cells), ["slot_no", "cell"])
    return joined.withColumn("slot", (F.col("before") + F.col("place")).cast("long"))


def shard_documents(frame: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Placed rows, and the map with both of its versions."""
    rows = cut_lineage(slot_rows(frame, slots))
    loads = cut_lineage(slot_loads(rows, slots))
    first = first_map(loads, shards)
    current = cut_lineage(rebalanced(first, loads, shards))
    return positions(rows, current), first.unionByName(current)


def sharded(frame: DataFrame) -> DataFrame:
    """Every document with its shard under the law ``bytes``, which the map's sizes decide."""
    placed, _ = shard_documents(frame)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot_no").alias("virtual_slot"),
        F.lit(1).alias("map_version"),
    )
