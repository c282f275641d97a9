"""Sharding by fixed virtual slots and a versioned map from slots to shards."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridbrook.llm.shared import new_path, save

SLOTS, SHARDS = 4096, 16
MAP = "version int, virtual_slot int, shard int, bytes long, rows long, first long"


def slot_of(slots: int = SLOTS):
    """Virtual slot of a record: a hash of its id and text checksum, so one hot id or text doesn't fill a slot."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")


def assign(loads: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """(slot, bytes, rows) -> shard: largest slots first, each to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size, _ in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + size, shard))
    return out


def rebalance(loads: list[tuple[int, int, int]], old: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for ``shards`` shards; all other slots stay where they are.

    Slots of shards that were taken away go to the emptiest shards.  Then, as long as it brings the two nearer to
    each other, a slot of the fullest shard moves to the emptiest; where shards were added, only to those.
    """
    size = {s: b for s, b, _ in loads}
    new = {s: old[s] for s in size}
    total, held = dict.fromkeys(range(shards), 0), {k: set() for k in range(shards)}

    def put(s, k):
        new[s] = k
        total[k] += size[s]
        held[k].add(s)

    for s, k in new.items():
        if k < shards:
            put(s, k)
    for s in sorted((s for s, k in new.items() if k >= shards), key=lambda s: (-size[s], s)):
        put(s, min(total, key=lambda k: (total[k], k)))
    added = [k for k in range(shards) if k > max((x for x in old.values() if x < 1 << 30), default=-1)] or list(range(shards))
    while True:
        a, b = max(total, key=lambda k: (total[k], -k)), min(added, key=lambda k: (total[k], k))
        gap = total[a] - total[b]
        fit = [s for s in held[a] if 0 < size[s] < gap]
        if not fit:
            return new
        s = min(fit, key=lambda s: (abs(gap / 2 - size[s]), s))
        held[a].remove(s)
        total[a] -= size[s]
        put(s, b)


def slot_map(loads: list[tuple[int, int, int]], shards: dict[int, int], version: int) -> list[tuple]:
    """Rows of the map; first is the place of a slot's first record within its shard."""
    first: dict[int, int] = {}
    out = []
    for slot, size, rows in sorted(loads):
        shard = shards[slot]
        out.append((version, slot, shard, size, rows, first.get(shard, 0)))
        first[shard] = first.get(shard, 0) + rows
    return out


def write_map(spark: SparkSession, folder: str, rows: list[tuple]) -> DataFrame:
    """Store a version of the map below ``folder``; a version is written once and never changed."""
    path = f"{folder}/version={rows[0][0] if rows else 1}"
    spark.createDataFrame(rows, MAP).drop("version").coalesce(1).write.parquet(path)
    return read_map(spark, folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard, bytes, rows, first, version) of a version, the last one where none is named."""
    every = spark.read.schema(MAP).parquet(folder)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(version))


def _measured(docs: DataFrame, slots: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Ids, sizes, checksums and virtual slots of the documents, and (slot, bytes, rows) of the slots in use."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    base = save(base.withColumn("virtual_slot", slot_of(slots)), "slots")
    return base, [tuple(r) for r in base.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()]


def _placed(base: DataFrame, stored: DataFrame) -> DataFrame:
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    out = base.withColumn("n", F.row_number().over(place) - 1).join(F.broadcast(stored.select("virtual_slot", "shard", "first", "version")), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> tuple[DataFrame, str]:
    """Documents with their places under the law ``bytes``, and the folder of the map, of which version 1 is written.

    Each row gets size (UTF-8 bytes of its text, null 0, plus 1), text_crc32, virtual_slot, shard and slot, its
    place within the shard, gapless from 0 in the order of virtual slots and ids.  grown_shard is null: under this
    law an edited map (``reshard_documents``) decides it.  Null ids are hashed like others; repeated rows have places of
    their own; no rows give no rows; other columns, whatever their names, are ignored.  Only ids, sizes and checksums are
    shuffled; the map has at most ``slots`` rows, whatever the input.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "slot-map")
    base, loads = _measured(docs, slots)
    return _placed(base, write_map(spark, folder, slot_map(loads, assign(loads, shards), 1))), folder


def reshard_documents(docs: DataFrame, folder: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Places by the next version of the stored map: the last one is read, edited for ``shards`` shards and today's loads, and written anew.

    Slots that the old map lacks go to the emptiest shards; all others move only as ``rebalance`` says.
    """
    spark = docs.sparkSession
    last = read_map(spark, folder).collect()
    old = {r["virtual_slot"]: r["shard"] for r in last}
    base, loads = _measured(docs, slots)
    for slot, _, _ in loads:
        old.setdefault(slot, 1 << 30)  # of no shard that stays: dealt out
    version = max((r["version"] for r in last), default=0) + 1
    return _placed(base, write_map(spark, folder, slot_map(loads, rebalance(loads, old, shards), version)))
