"""Op 12: near-duplicate vectors by an exact metric range join.

Of unit vectors a cosine of c or more is a Euclidean distance of at most r = sqrt(2 - 2c). In each group of equal labels,
pivots partition the vectors: each lives in the cell of its nearest pivot, and is replicated into every other cell that
the triangle inequality can't rule out within r. Every neighbour of a vector then stands in the vector's own cell, so cells
are joined independently, and a vector's links are counted where it lives. Links aren't emitted: a cell gives a count of
links a vector and a spanning forest of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, components, map_batches, stored
from .vectors import unit

#: Distinct vectors for each pivot of a group, pivots of a group at most, and rows that pivots are chosen among for each.
CELL, PIVOTS, AMONG = 1024, 128, 16
#: Vectors living in a cell that one task holds; a larger cell is dealt to more tasks, each of which meets the whole cell.
HELD, BLOCK = 16384, 2048
#: Vectors of a packed block, whose group's pivots are read once for all of them.
PACKED = 512
#: Rounding that bounds allow for.
MARGIN = 1e-9


def narrow(vectors: DataFrame) -> bool:
    kind = vectors.schema["embedding"].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


def representatives(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the group and vector hashes (null where they can't link), and each distinct vector of a group once."""
    # vectors of floats are kept as such, which is half the bytes; tasks compute with doubles
    v = F.col("embedding") if narrow(vectors) else F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("v", lambda c: c != 0)
    plain = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True))
    of = lambda seed: F.when(plain, F.xxhash64("label", F.size("v"), "v", F.lit(seed)))
    keyed = rows.select("vec_id", of(1).alias("h1"), of(2).alias("h2"), "label", "v")
    # copies of a hot vector are combined before the shuffle; equal hashes of 128 bits are equal vectors
    each = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    return keyed.select("vec_id", "h1", "h2"), stored(each.withColumn("d", F.size("v")), "distinct-vectors")


def packed(reps: DataFrame) -> DataFrame:
    """(label, d, n, rows, data): h1, id, copies and vectors in blocks of a group's vectors, so that a hot group is many rows."""
    size = reps.groupBy("label", "d").agg(F.count("*").alias("n"))
    schema = pa.schema([("label", pa.string()), ("d", pa.int32()), ("n", pa.int64()), ("rows", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(b.column("label").to_pylist(), b.column("d").to_pylist(), b.column("n").to_pylist(), strict=True)):
                keys.setdefault(key, []).append(k)
            numbers = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "id", "copies")], axis=1).astype("<i8")
            for (label, d, n), at in keys.items():
                x = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                for a in range(0, len(at), PACKED):
                    yield batch(schema, {"label": [label], "d": [d], "n": [n], "rows": [numbers[at[a : a + PACKED]].tobytes()], "data": [x[a : a + PACKED].tobytes()]})

    sized = reps.join(size, ["label", "d"])
    return stored(map_batches(sized.select("label", "d", "n", "h1", "id", "copies", "v").repartition("label", "d", F.pmod("h1", F.ceil(F.col("n") / PACKED))).sortWithinPartitions("label", "d"), run, "label string, d int, n long, rows binary, data binary"), "packed-vectors")


def pivots_of(x: np.ndarray, m: int, r: float) -> np.ndarray:
    """m rows as pivots: those with most rows within r first, as tight bunches need a cell of their own, each at more than
    r from those before it; then the farthest from all so far."""
    near = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0))
    crowd = (near <= r).sum(axis=1)
    gap, out = np.full(len(x), np.inf), []
    while len(out) < min(m, len(x)):
        free = (gap > r) & (crowd > 1)
        best = int(np.argmax(np.where(free, crowd, 0))) if free.any() else int(np.argmax(gap))
        if out and gap[best] <= 0:
            break
        out.append(best)
        gap = np.minimum(gap, near[best])
        gap[best] = -1
    return x[out]


def with_pivots(blocks: DataFrame, reps: DataFrame, r: float, cell: int) -> DataFrame:
    """Blocks with their group's pivots, chosen in tasks from the rows of least hashes: a bounded number a group."""
    share = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / cell))
    sized = reps.join(reps.groupBy("label", "d").agg(F.count("*").alias("n")), ["label", "d"]).where(F.col("n") > cell)
    # one row in so many, by hash: AMONG rows a pivot on the mean
    few = sized.where(F.pmod("h2", F.greatest(F.lit(1), F.floor(F.col("n") / (share * AMONG)))) == 0)
    chosen = few.groupBy("label", "d").agg(F.max(share).cast("int").alias("m"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("h1", "v"))), lambda s: s["v"])).alias("flat"))
    schema = pa.schema([("label", pa.string()), ("d", pa.int32()), ("pivots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = units(np.array(row["flat"]).reshape(-1, row["d"]))
                yield batch(schema, {"label": [row["label"]], "d": [row["d"]], "pivots": [pivots_of(x, row["m"], r).tobytes()]})

    return blocks.join(stored(map_batches(chosen, run, "label string, d int, pivots binary"), "pivots"), ["label", "d"], "left")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """h1, id and copies of a packed row's vectors, and the vectors as they were, floats or doubles."""
    rows = np.frombuffer(row["rows"], dtype="<i8").reshape(-1, 3)
    return rows, np.frombuffer(row["data"], dtype=f"<f{len(row['data']) // (len(rows) * row['d'])}").reshape(-1, row["d"])


def units(x: np.ndarray) -> np.ndarray:
    return unit(x.astype("f8"))


def far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def homes(blocks: DataFrame) -> DataFrame:
    """(label, d, cell, n, radius): how many vectors live in a cell, and the farthest from its pivot."""
    schema = pa.schema([("label", pa.string()), ("d", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("radius", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = units(opened(row)[1])
                if row["pivots"]:
                    gaps = far(x, np.frombuffer(row["pivots"], dtype="<f8").reshape(-1, row["d"]))
                    cell, gap = gaps.argmin(axis=1), gaps.min(axis=1)
                else:
                    cell, gap = np.zeros(len(x), dtype="i8"), np.full(len(x), 2.0)
                for c in np.unique(cell).tolist():
                    yield batch(schema, {"label": [row["label"]], "d": [row["d"]], "cell": [c], "n": [int((cell == c).sum())], "radius": [float(gap[cell == c].max())]})

    return map_batches(blocks, run, "label string, d int, cell int, n long, radius double").groupBy("label", "d", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))


def reached(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and the cells that may hold one within r of it (rows by cells).

    y in cell j is at most radius[j] from its pivot, so d(x, j) <= radius[j] + r. And y is nearer to j than to x's own i,
    so x is at most r from the plane halfway between them: d(x, j)^2 - d(x, i)^2 <= 2 r d(i, j), which is tighter than
    the d(x, j) - d(x, i) <= 2 r of metrics at large.
    """
    gaps = far(x, pivots)
    own = gaps.argmin(axis=1)
    here = gaps[np.arange(len(x)), own]
    planes = gaps**2 - here[:, None] ** 2 <= 2 * r * far(pivots, pivots)[own] + MARGIN
    reach = planes & (gaps <= radius[None] + r + MARGIN)
    reach[np.arange(len(x)), own] = True
    return own, reach


def dealt(blocks: DataFrame, r: float, held: int) -> DataFrame:
    """(label, d, cell, part, home, rows, data): vectors in all their cells, packed; each part of a cell has the vectors
    that live in it with home = true, and all vectors of the cell with home = false."""
    cells = stored(homes(blocks), "cells")
    known = cells.groupBy("label", "d").agg(F.collect_list(F.struct("cell", "n", "radius")).alias("cells"))
    schema = pa.schema([("label", pa.string()), ("d", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("home", pa.bool_()), ("rows", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rows, data = opened(row)
                x = units(data)
                size, radius = {c["cell"]: c["n"] for c in row["cells"]}, {c["cell"]: c["radius"] for c in row["cells"]}
                if row["pivots"]:
                    pivots = np.frombuffer(row["pivots"], dtype="<f8").reshape(-1, row["d"])
                    own, reach = reached(x, pivots, np.array([radius.get(c, -9.0) for c in range(len(pivots))]), r)
                else:
                    own, reach = np.zeros(len(x), dtype="i8"), np.ones((len(x), 1), dtype=bool)
                for c in np.flatnonzero(reach.any(axis=0)).tolist():
                    parts = math.ceil(size[c] / held) if c in size else 0
                    here = rows[:, 0] % max(1, parts)
                    for part in range(parts):
                        for home, on in ((True, (own == c) & (here == part)), (False, reach[:, c])):
                            if on.any():
                                yield batch(schema, {"label": [row["label"]], "d": [row["d"]], "cell": [c], "part": [part], "home": [home], "rows": [rows[on].tobytes()], "data": [data[on].tobytes()]})

    return map_batches(blocks.join(known, ["label", "d"]), run, "label string, d int, cell int, part int, home boolean, rows binary, data binary")


class Cell:
    """The vectors that live in a part of a cell; the cell's vectors pass by in blocks."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, threshold: float):
        self.rows, self.x, self.threshold = rows, x, threshold
        self.links = np.zeros(len(rows), dtype="i8")
        self.root = np.arange(len(rows))
        self.seen = False

    def join(self, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts links with a block; returns the block's linked ids and, for each, an id it links to that lives here."""
        linked = np.full(len(rows), -1)
        for a in range(0, len(self.rows), BLOCK):
            mine = self.rows[a : a + BLOCK]
            near = self.x[a : a + BLOCK] @ x.T >= self.threshold
            near &= mine[:, 1][:, None] != rows[:, 1][None]
            if not near.any():
                continue
            self.links[a : a + BLOCK] += near @ rows[:, 2]
            first = near.argmax(axis=0) + a
            hit = near.any(axis=0)
            linked = np.where(hit & (linked < 0), first, linked)
            self.unite(near, a, linked)
        at = np.flatnonzero(linked >= 0)
        return rows[at, 1], self.rows[linked[at], 1]

    def unite(self, near: np.ndarray, a: int, linked: np.ndarray) -> None:
        """All that link to one vector of the block come under one root."""
        while True:
            here = self.root[a : a + len(near)]
            apart = near & (here[:, None] != self.root[np.maximum(linked, 0)][None])
            i, j = np.nonzero(apart)
            if not len(i):
                return
            one, other = here[i], self.root[linked[j]]
            # a root takes the least root that it meets; chains of them shorten until none is left
            to = np.arange(len(self.root))
            np.minimum.at(to, np.maximum(one, other), np.minimum(one, other))
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.rows[at, 1], self.rows[self.root[at], 1]


def joined(cells: DataFrame, threshold: float) -> DataFrame:
    """(h1, links, u, v): a vector's links, or an edge of the spanning forest."""
    schema = pa.schema([("h1", pa.int64()), ("id", pa.int64()), ("links", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return batch(schema, {"h1": [None] * len(u), "id": [None] * len(u), "links": [None] * len(u), "u": u, "v": v})

    def counted(cell: Cell) -> pa.RecordBatch:
        return batch(schema, {"h1": cell.rows[:, 0], "id": cell.rows[:, 1], "links": cell.links, "u": [None] * len(cell.rows), "v": [None] * len(cell.rows)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, living = None, None, []
        for b in batches:
            for row in b.to_pylist():
                now = (row["label"], row["d"], row["cell"], row["part"])
                if now != key:
                    if cell:
                        yield counted(cell)
                        yield edges(*cell.forest())
                    key, cell, living = now, None, []
                rows, data = opened(row)
                x = units(data)
                if row["home"]:
                    living.append((rows, x))
                    continue
                if not living:
                    continue
                if cell is None:
                    cell = Cell(np.concatenate([r for r, _ in living]), np.concatenate([x for _, x in living]), threshold)
                yield edges(*cell.join(rows, x))
        if cell:
            yield counted(cell)
            yield edges(*cell.forest())

    order = cells.repartition("label", "d", "cell", "part").sortWithinPartitions("label", "d", "cell", "part", F.col("home").desc())
    return stored(map_batches(order, run, "h1 long, id long, links long, u long, v long"), "cell-links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, cell: int = CELL, held: int = HELD) -> DataFrame:
    """Op 12. Every row with vec_id, n_links, component_id, kept: links join equal labels by a cosine of ``threshold`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows under a
    null label; vectors only meet those of their own dimension. Rows that repeat a vector link with each other; rows that
    repeat a vec_id are one node and aren't linked to each other. A null vec_id links with nothing, its component_id is
    null and it is kept. A group has a pivot for every ``cell`` distinct vectors; a task holds ``held`` of a cell's. An empty table gives an empty result. Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    r = math.sqrt(2 - 2 * threshold)
    rows, reps = representatives(vectors)
    blocks = stored(with_pivots(packed(reps), reps, r, cell), "pivoted-blocks")
    found = joined(dealt(blocks, r, held), threshold)
    roots = components(found.where("u is not null").select("u", "v"), "near-vectors")
    ends = reps.select("h1", "h2", "id", "copies").join(found.where("h1 is not null").select("h1", "id", "links"), ["h1", "id"])
    ends = ends.join(roots.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = rows.join(ends, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
