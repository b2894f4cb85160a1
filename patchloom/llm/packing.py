"""Op 9: pack documents into sequences of fixed length by swap-based local search.

Pieces are dealt into groups of bounded size by a hash of their own row, so that no document or source weighs on one
task. Each group is packed by best fit, largest first, and improved by exchanges between underfull bins (move, one for
one, two for one) that increase the sum of squared fills, which drains the emptiest bins. Bins still underfull after a
round go on, with all their pieces, to a next round over fewer groups; the last round is a single group of bounded size,
the round after one that brought nothing more, or the eighth. It closes all of its bins, so every piece is placed.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, groups, map_batches, stored
from .token_ids import library

#: Pieces in a group on the mean, and a round's limit.
GROUP = 4096
#: Rounds of packing at most; the last one closes every bin, however full.
ROUNDS = 8
#: Bins that give their pieces away in a step of the search: the emptiest ones.
GIVERS = 64


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: each item goes to the fullest bin that it fits into. Bins wait in lists by room left."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # sorted rooms that some bin has
    by: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect_left(rooms, s)
        if k == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[k]
            b = by[room].pop()
            if not by[room]:
                del by[room], rooms[k]
        bins[b].append(i)
        left = room - s
        if left not in by:
            insort(rooms, left)
            by[left] = []
        by[left].append(b)
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int, rounds: int = 4) -> list[list[int]]:
    """Exchange pieces between underfull bins while that increases the sum of squared fills.

    Every bin, from the fullest on, is filled from emptier ones: by the largest piece that fits (move), by the piece
    that most exceeds one of its own within its room (one for one), or by a pair that does (two for one, where two of
    its small pieces leave for a larger one). All three raise the fuller bin, so each step gains; bins end up empty.
    """
    size = sizes.tolist()
    bins = [list(b) for b in bins if b]
    fill = [sum(size[i] for i in b) for b in bins]
    for _ in range(rounds):
        order = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (-fill[b], b))
        if len(order) < 2:
            break
        gained = False
        givers = order[len(order) // 2 :][-GIVERS:]  # the emptiest bins are the ones to drain
        where = sorted((size[i], i, b) for b in givers for i in bins[b])
        for b in order:
            room = capacity - fill[b]
            if not room or not where:
                continue
            for _ in range(8):
                room = capacity - fill[b]
                if not room:
                    break
                best = None
                k = bisect_left(where, (room + 1,)) - 1
                while k >= 0 and (where[k][2] == b or fill[where[k][2]] > fill[b]):
                    k -= 1
                if k >= 0 and where[k][0]:
                    best = (where[k][0], (), k)
                own = sorted((size[i], i) for i in bins[b])
                outs = [(s, (i,)) for s, i in own] + [(own[x][0] + own[y][0], (own[x][1], own[y][1])) for x in range(min(len(own), 12)) for y in range(x)]
                for s, out in outs:
                    k = bisect_left(where, (s + room + 1,)) - 1
                    while k >= 0 and where[k][0] > s and (where[k][2] == b or fill[where[k][2]] > fill[b]):
                        k -= 1
                    if k >= 0 and where[k][0] - s > (best[0] if best else 0):
                        best = (where[k][0] - s, out, k)
                if not best:
                    break
                gain, out, k = best
                s, i, g = where.pop(k)
                bins[g].remove(i)
                bins[b].append(i)
                for o in out:
                    bins[b].remove(o)
                    bins[g].append(o)
                    insort(where, (size[o], o, g))
                fill[b] += gain
                fill[g] -= gain
                if b in givers:
                    where = [x for x in where if x[2] != b]
                gained = True
        # what is left in the givers is packed afresh, which never takes more bins
        rest = [i for g in givers for i in bins[g]]
        again = best_fit(np.array([size[i] for i in rest], dtype="i8"), capacity) if rest else []
        if len(again) <= sum(bool(bins[g]) for g in givers):
            for g in givers:
                bins[g], fill[g] = [], 0
            for g, packed in zip(givers, again, strict=False):
                bins[g] = [rest[x] for x in packed]
                fill[g] = sum(size[i] for i in bins[g])
        if not gained:
            break
    return [b for b in bins if b]


def pieces(docs: DataFrame, length: int = 4096, vocab: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row: every document's pieces; only documents over length are cut."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, end = TaskContext.get().partitionId() << 36, end_id.to_bytes(4, "little")
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, ids in zip(b.column("doc_id").to_pylist(), library(vocab).encode([t or b"" for t in b.column("text").to_pylist()]), strict=True):
                data = memoryview(ids + end)
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    for name, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), row), strict=True):
                        out[name].append(v)
                    row += 1
            yield batch(schema, out)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def pack(items: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """items with a long ``length`` of 1 to capacity and a unique long ``row``: adds sequence_id and offset.

    Sequences are whole within a group, so a group's tasks need nothing from each other. sequence_id is the least row
    of its pieces. An empty table gives an empty result.
    """
    full = items.where(F.col("length") >= capacity).select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = pa.schema([("row", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
    waiting, done = items.where(F.col("length") < capacity).select("row", "length"), []
    before = total = None
    for n in range(ROUNDS):
        count = waiting.count()
        total = count if total is None else total
        n_groups = max(1, math.ceil(count / group))
        last = n_groups == 1 or count == before or n == ROUNDS - 1
        before = count

        def run(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            for t in groups(batches, ["g"]):
                rows, sizes = t.column("row").to_numpy(), t.column("length").to_numpy()
                bins = local_search(sizes, best_fit(sizes, capacity), capacity)
                fills = [int(sizes[b].sum()) for b in bins]
                # bins at most 98 % full try again with those of other groups
                keep = [last or f * 50 > capacity * 49 for f in fills]
                at = np.concatenate([np.array(b) for b in bins])
                yield batch(schema, {
                    "row": rows[at], "length": sizes[at], "sequence_id": np.concatenate([np.full(len(b), rows[b].min()) for b in bins]),
                    "offset": np.concatenate([np.cumsum(sizes[b]) - sizes[b] for b in bins]), "open": np.repeat([not k for k in keep], [len(b) for b in bins]),
                })

        dealt = waiting.withColumn("g", F.pmod(F.xxhash64("row", F.lit(n)), F.lit(n_groups))).repartition("g").sortWithinPartitions("g", "row")
        packed = stored(map_batches(dealt, run, "row long, length long, sequence_id long, offset long, open boolean"), "packed")
        done.append(packed.where("not open"))
        if last:
            break
        waiting = packed.where("open").select("row", "length")
    placed = done[0]
    for d in done[1:]:
        placed = placed.union(d)
    if (n_placed := placed.count()) != total:
        raise RuntimeError(f"{total} pieces came in and {n_placed} were placed")
    return full.unionByName(items.join(placed.select("row", "sequence_id", "offset"), "row").select(full.columns))


def sequences(docs: DataFrame, length: int = 4096, vocab: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and hold just the end id; repeated rows and null doc_ids are packed each by itself. Texts
    are encoded whole and once: the pieces, without their ids, are kept in the shared folder while they are packed.
    """
    return pack(stored(pieces(docs, length, vocab, end_id), "pieces"), length).drop("row")
