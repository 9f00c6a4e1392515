"""Shards from fixed virtual slots.

A record's virtual slot is a hash of its id and text, one of `n_slots`, and never changes. Bytes are summed per slot, and a map
from slots to shards is kept as a table of versions: the first version deals the slots out in turn; each later one
edits the one before. Rebalancing moves slots from the fullest shard to the emptiest one, then swaps slots between
them, while that brings the two closer; growing by a shard moves slots to the new shard only. Only slots that an edit
moves change their shard.

The map has a row per slot, whatever the input, so it is edited on the driver; records only ever join it.

Within a shard, records are numbered without gaps in the order of a hash.

Defined cases: a null text has 8 bytes and the checksum of no bytes; null ids are told apart by their texts; repeated
rows share a slot and get neighbouring numbers; an empty table gives an empty result and a map that deals the slots out in turn.
A stored map of another number of slots, or of more shards than asked for, is refused.
"""

from __future__ import annotations

import logging
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.ordering import cells_for, hash60, running
from linkweave.session import shared_folder, staged

N_SLOTS = 8192


def slot_of(id_col: Column, text_crc32: Column, n_slots: int = N_SLOTS) -> Column:
    """Virtual slot of a record; depends on nothing but its id and text."""
    return F.pmod(F.xxhash64(id_col.cast("string"), text_crc32), F.lit(n_slots)).cast("int")


def first_map(n_slots: int, n_shards: int) -> np.ndarray:
    return np.arange(n_slots, dtype=np.int64) % n_shards


def rebalanced(slots: np.ndarray, sizes: np.ndarray, n_shards: int) -> np.ndarray:
    """The map after moves and swaps between the fullest and the emptiest shard."""
    slots = slots.copy()
    held = np.bincount(slots, weights=sizes, minlength=n_shards).astype(np.int64)
    for _ in range(20 * len(slots)):
        high, low = int(held.argmax()), int(held.argmin())
        gap = held[high] - held[low]
        ours, theirs = np.flatnonzero((slots == high) & (sizes > 0)), np.flatnonzero(slots == low)
        if gap <= 1 or not len(ours):
            break
        # moving d bytes leaves a gap of |gap - 2 d|; look for the single move or swap that leaves the least
        move = ours[np.abs(gap - 2 * sizes[ours]).argmin()]
        best, swap = abs(gap - 2 * sizes[move]), -1
        if len(theirs):
            back = theirs[np.argsort(sizes[theirs], kind="stable")]
            want = sizes[ours] - gap // 2
            at = np.clip(np.searchsorted(sizes[back], want), 0, len(back) - 1)
            at = np.where((at > 0) & (np.abs(sizes[back[at - 1]] - want) < np.abs(sizes[back[at]] - want)), at - 1, at)
            left = np.abs(gap - 2 * (sizes[ours] - sizes[back[at]]))
            if left.min() < best:
                best, i = left.min(), left.argmin()
                move, swap = ours[i], back[at[i]]
        if best >= gap:
            break
        moved = sizes[move] - (sizes[swap] if swap >= 0 else 0)
        slots[move] = low
        if swap >= 0:
            slots[swap] = high
        held[high] -= moved
        held[low] += moved
    else:
        logging.getLogger(__name__).warning("shards still differ by %d bytes after %d steps", gap, 20 * len(slots))
    return slots


def grown(slots: np.ndarray, sizes: np.ndarray, n_shards: int) -> np.ndarray:
    """The map with shard `n_shards` added: it takes slots from the fullest shards until it holds an equal share."""
    slots = slots.copy()
    held = np.bincount(slots, weights=sizes, minlength=n_shards + 1).astype(np.int64)
    share = sizes.sum() / (n_shards + 1)
    for _ in range(len(slots)):
        high = int(held[:n_shards].argmax())
        ours = np.flatnonzero((slots == high) & (sizes > 0))
        room = share - held[n_shards]
        fitting = ours[sizes[ours] <= room]
        if not len(fitting) or held[high] <= share:
            break
        move = fitting[np.abs(sizes[fitting] - min(held[high] - share, room)).argmin()]
        slots[move] = n_shards
        held[high] -= sizes[move]
        held[n_shards] += sizes[move]
    return slots


class SlotMap:
    """Versions of a slot-to-shard map, a folder `version=N` of Parquet files for each: (n_shards, slot, shard)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def latest(self) -> int:
        """The newest version, 0 where there is none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return max([int(n.removeprefix("version=")) for n in names if n.startswith("version=")], default=0)

    def append(self, version: int, n_shards: int, slots: np.ndarray) -> None:
        """Writes a version; one that exists is refused."""
        rows = [(n_shards, i, int(s)) for i, s in enumerate(slots)]
        frame = self.spark.createDataFrame(rows, "n_shards int, slot int, shard int")
        frame.coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")

    def _version(self, version: int) -> DataFrame:
        return self.spark.read.schema("n_shards int, slot int, shard int").parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        """(slot, shard) of a version: `n_slots` rows."""
        return self._version(version).select("slot", "shard")

    def load(self, version: int) -> tuple[int, np.ndarray]:
        """Number of shards and the shard of each slot."""
        rows = self._version(version).orderBy("slot").collect()  # n_slots rows
        return rows[0]["n_shards"], np.array([r["shard"] for r in rows], np.int64)


def slot_bytes(records: DataFrame, n_slots: int) -> np.ndarray:
    """Bytes of each slot; `records` has slot and size."""
    sizes = np.zeros(n_slots, np.int64)
    for row in records.groupBy("_slot").agg(F.sum("size").alias("size")).collect():  # n_slots rows at most
        sizes[row["_slot"]] = row["size"]
    return sizes


def placed(records: DataFrame, slots: DataFrame, rows: int) -> DataFrame:
    """`records` with shard, and their gapless number within the shard."""
    located = records.join(F.broadcast(slots.withColumnRenamed("slot", "_at")), F.col("_slot") == F.col("_at")).drop("_at")
    order = hash60(F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    numbered = running(located, ["shard"], order, F.lit(1).cast("long"), "_n", cells_for(rows // 16))
    return numbered.withColumn("slot", F.col("_n") - 1).drop("_n")


def edited(slot_map: SlotMap, sizes: np.ndarray, n_shards: int) -> int:
    """The version to place records by: the latest of the stored map, edited where it needs to be. A map that does not exist is dealt
    out first. A map of fewer shards grows to `n_shards`, a version for each shard, and moves nothing else; one of as
    many is rebalanced, which makes a version if any slot moves."""
    version = slot_map.latest()
    if not version:
        version = 1
        slot_map.append(1, n_shards, first_map(len(sizes), n_shards))
    stored, slots = slot_map.load(version)
    if len(slots) != len(sizes):
        raise ValueError(f"the map at {slot_map.path} has {len(slots)} slots, not {len(sizes)}: slots never change")
    if stored > n_shards:
        raise ValueError(f"the map at {slot_map.path} has {stored} shards already")
    if stored < n_shards:
        for n in range(stored, n_shards):
            slots, version = grown(slots, sizes, n), version + 1
            slot_map.append(version, n + 1, slots)
        return version
    after = rebalanced(slots, sizes, n_shards)
    if (after != slots).any():
        version += 1
        slot_map.append(version, n_shards, after)
    return version


def sharded(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) of each record, and the map that placed it. The map is kept under `path`
    and edited by the next run there; without one it is new and belongs to this run."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    records = docs.select(F.col(id_col).alias("doc_id"), (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), slot_of(F.col(id_col), F.crc32(data), n_slots).alias("_slot"))
    records = staged(records)
    slot_map = SlotMap(spark, path or f"{shared_folder(spark)}/slots-{uuid.uuid4().hex}")
    version = edited(slot_map, slot_bytes(records, n_slots), n_shards)
    return placed(records, slot_map.read(version), records.count()).withColumnRenamed("_slot", "virtual_slot"), slot_map


def query(docs: DataFrame) -> DataFrame:
    rows, _ = sharded(docs)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
