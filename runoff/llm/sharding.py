"""Sharding over fixed virtual slots.

A record's hash names one of SLOTS slots for good. Bytes are added up by slot, and a versioned map, stored as Parquet,
says which shard holds each slot. The first version hands out slots, heaviest first, to the lightest shard; later
versions edit the one before: a new shard takes slots until it holds its share, and nothing else moves. Everything that
is gathered in one task or broadcast is the map or a count for each cell: SLOTS or SLOTS * CELLS rows, however many
records there are.

Defined results: null text has no bytes, a null identifier hashes like any other value; rows repeated in full share a
slot and take places of their own. Equal texts with different identifiers may lie in different shards: a group of them
may hold a third of all rows, which no one shard can take under the law `bytes`. Of a text of any length only its size
and checksum are kept. An empty table gives an empty result and a map of empty slots. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runoff.llm.common import durable

SLOTS = 4096
#: Parts of a slot, so that numbering the rows of a shard takes SLOTS * CELLS small sorts.
CELLS = 16
#: Bytes that each record counts besides its text.
OVERHEAD = 8


def _records(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    one = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + OVERHEAD).cast("long").alias("size"), crc.alias("text_crc32"))
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOTS * CELLS)).cast("int")
    return one.withColumn("_cell", cell)


def slot_bytes(spark: SparkSession, records: DataFrame) -> DataFrame:
    """slot, bytes: a row for every slot, filled or not."""
    filled = records.groupBy(F.floor(F.col("_cell") / CELLS).cast("int").alias("slot")).agg(F.sum("size").alias("bytes"))
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _folded(slots: DataFrame, start: str, step: str) -> DataFrame:
    """The rows of slots, heaviest first, folded into `start` by `step`; acc.out holds (slot, shard, bytes)."""
    whole = slots.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot", *[c for c in slots.columns if c not in ("bytes", "slot")]))).alias("s"), F.sum("bytes").alias("total"))
    return whole.select(F.expr(f"aggregate(s, {start}, (acc, x) -> {step})").alias("acc")).select(F.explode("acc.out").alias("o")).select("o.*")


def first_map(slots: DataFrame, shards: int) -> DataFrame:
    """version 1: slots by falling bytes, each to the shard that holds least."""
    lightest = "cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int)"
    start = f"named_struct('loads', array_repeat(0L, {shards}), 'out', cast(array() as array<struct<slot:int,shard:int,bytes:bigint>>))"
    step = f"""named_struct(
        'loads', transform(acc.loads, (v, i) -> if(i = {lightest}, v - x.less, v)),
        'out', concat(acc.out, array(named_struct('slot', x.slot, 'shard', {lightest}, 'bytes', -x.less))))"""
    return _folded(slots, start, step).withColumn("version", F.lit(1))


def grown_map(old: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """The next version, for shards + 1 shards: only slots that the new shard takes are edited.

    Heaviest first, a slot moves if the new shard stays within its share and the old one doesn't fall below it.
    """
    now = slots.join(F.broadcast(old.select("slot", "shard", "version")), "slot")
    version = old.agg(F.max("version")).first()[0]
    start = f"""named_struct('loads', transform(sequence(0, {shards}), k -> aggregate(filter(s, y -> y.shard = k), 0L, (a, y) -> a - y.less)),
        'out', cast(array() as array<struct<slot:int,shard:int,bytes:bigint>>))"""
    moves = f"(x.less < 0 and acc.loads[{shards}] - x.less <= total / {shards + 1} and acc.loads[x.shard] + x.less >= total / {shards + 1})"
    step = f"""named_struct(
        'loads', if({moves}, transform(acc.loads, (v, i) -> case when i = {shards} then v - x.less when i = x.shard then v + x.less else v end), acc.loads),
        'out', concat(acc.out, array(named_struct('slot', x.slot, 'shard', if({moves}, {shards}, x.shard), 'bytes', -x.less))))"""
    return _folded(now.drop("version"), start, step).withColumn("version", F.lit(version + 1))


def save_map(slot_map: DataFrame, root: str) -> None:
    """Adds one version to the maps under root."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.coalesce(1).write.parquet(f"{root}/version={version}")


def load_map(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest unless one is named."""
    maps = spark.read.parquet(root)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == version)


def shard(docs: DataFrame, shards: int, root: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every record with its size, CRC-32, shard and place in the shard (gapless from 0); the map is stored under root."""
    spark = docs.sparkSession
    records = durable(_records(docs, doc_id, text))
    save_map(first_map(slot_bytes(spark, records), shards), root)
    return place(records, load_map(spark, root))


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Numbers each shard's records: those of earlier cells come first, then the order within the cell."""
    of_slot: Column = F.floor(F.col("_cell") / CELLS).cast("int")
    cells = records.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("slot", of_slot).join(F.broadcast(slot_map.select("slot", "shard")), "slot")
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("_cell", F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("_at", within - 1).join(F.broadcast(starts), "_cell").select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_at")).alias("slot"), "virtual_slot")
