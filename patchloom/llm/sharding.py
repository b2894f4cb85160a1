"""Op 4: put documents into a fixed number of shards by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group and stay together. Groups go from the largest to the smallest into the shard with the least
room that still holds them; the shards stand in a balanced tree by remaining capacity, and the least capacity that holds
all is found by bisection. Groups of one size are interchangeable, so the driver packs a histogram of sizes: the tightest
shard takes as many of them as fit, which is what taking them one by one comes to. Sizes from 64 KiB on are rounded up to
a 1024th of their power of two, so there are at most some 110,000 different ones, whatever the input. Which of its size
a group is, is a number counted in buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, crc32, map_batches, stored

#: Sizes that are packed as they are, and groups of a bucket on the mean.
PLAIN, BUCKET = 1 << 16, 100_000
#: A group with at least this share of all rows is looked up by broadcast; there are at most so many.
HOT = 1 << 16


class Rooms:
    """Bins by remaining capacity in a balanced tree (a treap, its priorities a hash of the bin)."""

    def __init__(self, rooms: list[int]):
        self.root: list | None = None
        for b, room in enumerate(rooms):
            self.add(room, b)

    def add(self, room: int, b: int) -> None:
        low, high = self._split(self.root, (room, b))
        self.root = self._merge(self._merge(low, [(room, b), (b * 0x9E3779B1 + 0x7F4A7C15) % 2**32, None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes the bin with the least room of at least size, the first of equals: (room, bin), or None."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._merge(low, rest)
        return node[0]

    def _split(self, node: list | None, key: tuple) -> tuple:
        """Trees of the keys below key and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a if b is None else b
        if a[1] >= b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def fit(sizes: dict[int, int], bins: int, capacity: int) -> list[tuple[int, int, int, int]] | None:
    """Best fit decreasing of a histogram of sizes: (size, from, to, bin), or None if something doesn't fit."""
    rooms = Rooms([capacity] * bins)
    out = []
    for size in sorted(sizes, reverse=True):
        at = 0
        while at < sizes[size]:
            hit = rooms.take(size)
            if hit is None:
                return None
            n = min(sizes[size] - at, hit[0] // size)
            out.append((size, at, at + n, hit[1]))
            rooms.add(hit[0] - n * size, hit[1])
            at += n
    return out


def pack(sizes: dict[int, int], bins: int) -> list[tuple[int, int, int, int]]:
    """``fit`` at the least capacity, found by bisection between the even share and one item more.

    An item larger than an even share of what is left has a bin of its own, so that the others stay even.
    """
    left, out, free = dict(sizes), [], list(range(bins))
    total = sum(s * n for s, n in left.items())
    while len(free) > 1 and left and (most := max(left)) * len(free) > total:
        at = sizes[most] - left[most]
        out.append((most, at, at + 1, free.pop(0)))
        total -= most
        left[most] -= 1
        if not left[most]:
            del left[most]
    most = max(left, default=0)
    low = max(math.ceil(total / len(free)), most)
    high = low + most
    best = fit(left, len(free), low)
    if best is None:
        while (best := fit(left, len(free), high)) is None:
            high *= 2
        for _ in range(24):
            if high - low <= max(1, low >> 14):
                break
            mid = (low + high) // 2
            got = fit(left, len(free), mid)
            if got is None:
                low = mid
            else:
                best, high = got, mid
    return out + [(s, lo + sizes[s] - left[s], hi + sizes[s] - left[s], free[b]) for s, lo, hi, b in best]


def rounded(size: Column) -> Column:
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(PLAIN)))) - 10)
    return F.when(size < PLAIN, size).otherwise((F.ceil(size / step) * step).cast("long"))


def ahead(counts: DataFrame, key: str, part: str) -> DataFrame:
    """counts (key, part, n) with ``ahead``: how many of the key stand in earlier parts. One row a key and part."""
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")


def placed(rows: DataFrame, bins: int) -> DataFrame:
    """digest, copies, shard of the groups of rows (digest, size)."""
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")).withColumn("cls", rounded(F.col("bytes"))), "shard-groups")
    buckets = math.ceil(groups.count() / BUCKET)
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(max(1, buckets))))
    counts = stored(groups.groupBy("cls", "bucket").agg(F.count("*").alias("n")), "shard-sizes")
    runs = pack({r.cls: r.n for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}, bins)
    table = rows.sparkSession.createDataFrame(runs, "cls long, lo long, hi long, shard int")
    within = F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("digest")) - 1
    numbered = groups.withColumn("within", within).join(ahead(counts, "cls", "bucket"), ["cls", "bucket"]).withColumn("i", F.col("within") + F.col("ahead"))
    return stored(numbered.join(table, "cls").where("i >= lo and i < hi").select("digest", "copies", "shard"), "shard-places")


def shards(docs: DataFrame, n: int = 40) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard. Law: bytes, sizes near equal.

    size: UTF-8 bytes of the text and 16. Null texts share the group of empty ones. A group larger than an even share
    has a shard of its own, as groups aren't cut. Repeated rows and null doc_ids each have a slot. An empty table gives
    an empty result. Slots follow the reading order.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), crc32(F.col("text")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    rows = stored(rows, "shard-rows")
    groups = placed(rows.select("digest", "size"), n)
    # rows of frequent texts don't move: their groups are few, each with a 65,536th of the rows or more
    often = F.col("copies") * HOT >= F.lit(rows.count())
    hot = F.broadcast(groups.where(often).select("digest", "shard"))
    cold = groups.where(~often).select("digest", "shard")
    dealt = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest")).select("doc_id", "size", "text_crc32", "shard")
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("shard", pa.int32()), ("_pid", pa.int32()), ("_local", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), np.zeros(n, dtype="i8")
        for b in batches:
            shard = b.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=n)
            local = np.empty(len(shard), dtype="i8")
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            yield batch(schema, {c: b.column(c) for c in ("doc_id", "size", "text_crc32", "shard")} | {"_pid": np.full(len(shard), pid), "_local": local})

    local = stored(map_batches(dealt, run, "doc_id long, size long, text_crc32 long, shard int, _pid int, _local long"), "shard-slots")
    before = ahead(local.groupBy("shard", "_pid").agg(F.count("*").alias("n")), "shard", "_pid")
    done = local.join(before, ["shard", "_pid"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_local") + F.col("ahead")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
