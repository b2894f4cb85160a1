"""Ops 2 and 10: vectors in blocks, an approximate permutation index and an exact pivot table.

The index is written once: vectors are gathered into blocks of bounded bytes, each with its own part of the index beside
the original vectors. A stated query set meets all rows block by block: queries go out in batches of bounded bytes, and
every task reads its blocks of the index in place, so that no vector is shuffled again. A block gives at most k rows a
query; these are cut to k by a window, which Spark limits on the map side too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, groups, map_batches, stored

INT64 = 2**63 - 1
#: Bytes of queries that are sent out at once, and of a block of them.
BATCH_BYTES, QUERY_BYTES = 16 << 20, 256 << 10
#: Dimensions with block numbers of their own, and bytes of all pivots; rarer dimensions are searched without an index.
DIMENSIONS, PIVOT_BYTES = 1000, 32 << 20


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, v (doubles), d: rows whose vector is whole and finite (and not zero, nor empty, if asked)."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad: Column = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("d", F.size("v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def dimensions(rows: DataFrame) -> dict[int, int]:
    """Rows of each of the commonest dimensions; a rarer one has no more than the least of these."""
    return {r.d: r.n for r in rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(DIMENSIONS).collect()}


Extra = Callable[[int, np.ndarray, np.ndarray], bytes]


def blocks(rows: DataFrame, sizes: dict[int, int], size: int, salt: int, extra: Extra) -> DataFrame:
    """Gather rows into blocks of ``size`` vectors on the mean, by a hash of the id: (d, b, ids, data, extra).

    A block holds vectors of one dimension, in order of their ids, as little-endian 64-bit integers and doubles, and what
    extra(d, ids, data) makes of them. Repeated ids share a block, so ids are taken to be unique on the whole.
    """
    most = F.lit(math.ceil(min(sizes.values(), default=1) / size) if len(sizes) == DIMENSIONS else 1)
    number = F.coalesce(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, math.ceil(n / size))])[F.col("d")], most) if sizes else most
    schema = pa.schema([("d", pa.int32()), ("b", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("extra", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["d", "b"]):
            d = t.column("d")[0].as_py()
            ids, v = t.column("vec_id").to_numpy(), matrix(t.column("v").combine_chunks(), d)
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order].astype("<i8"), np.ascontiguousarray(v[order], dtype="<f8")
            yield batch(schema, {"d": [d], "b": [t.column("b")[0].as_py()], "ids": [ids.tobytes()], "data": [v.tobytes()], "extra": [extra(d, ids, v)]})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(salt)), number)).repartition("d", "b").sortWithinPartitions("d", "b")
    return stored(map_batches(dealt, run, "d int, b long, ids binary, data binary, extra binary"), "vector-blocks")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    ids = np.frombuffer(row["ids"], dtype="<i8")
    return ids, np.frombuffer(row["data"], dtype="<f8").reshape(len(ids), -1), row["extra"]


def search(rows: DataFrame, sizes: dict[int, int], every: int, k: int, score: str, block: int, index: Extra, ask: Extra, made: Callable) -> DataFrame:
    """Each query's k best: query_id, rank, vec_id, score.

    index and ask give what is kept beside a block of vectors and of queries; made(d, ids, data, extra) opens a block,
    and its top(queries) yields (query_id, places, scores) of each query, with queries as opened blocks.
    """
    spark = rows.sparkSession
    table = blocks(rows, sizes, block, 1, index)
    mine = rows.where(F.col("vec_id") % every == 0)
    asked = {d: n for d, n in sizes.items()}
    per = {d: max(1, QUERY_BYTES // (8 * d + 8)) for d in asked}
    queries = blocks(mine, {d: math.ceil(n / every) for d, n in asked.items()}, min(per.values(), default=1), 2, ask)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score == "long" else pa.float64())])

    def found(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    here = [opened(q) for q in sent.value if q["d"] == row["d"]]
                    if not here:
                        continue
                    ids, data, extra = opened(row)
                    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
                    for i, at, scores in made(row["d"], ids, data, extra).top(here):
                        out["query_id"] += [i] * len(at)
                        out["vec_id"] += ids[at].tolist()
                        out["score"] += scores if isinstance(scores, list) else scores.tolist()
                    yield batch(schema, out)

        return map_batches(table, run, f"query_id long, vec_id long, score {score}")

    # whole blocks of queries, of so many numbers that a batch has its bytes on the mean
    last = queries.agg(F.max("b"), F.sum(F.octet_length("ids") + F.octet_length("data") + F.octet_length("extra"))).first()
    if last[0] is None:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
    step = max(1, (last[0] + 1) * BATCH_BYTES // max(1, last[1]))
    every_part = []
    for lo in range(0, last[0] + 1, step):
        sent = spark.sparkContext.broadcast([r.asDict() for r in queries.where(F.col("b").between(lo, lo + step - 1)).collect()])
        part = found(sent)
        every_part.append(part if step > last[0] else stored(cut(part, k), "found"))
    out = every_part[0]
    for part in every_part[1:]:
        out = out.union(part.select(out.columns))
    return cut(out, k)


def cut(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def sample(rows: DataFrame, d: int, n: int, salt: int) -> list:
    """The n rows of dimension d with the least hashes: a bounded sample."""
    return rows.where(F.col("d") == d).orderBy(F.xxhash64("vec_id", F.lit(salt)), "vec_id").limit(n).select("vec_id", "v").collect()


def pivoted(sizes: dict[int, int], n: int) -> list[int]:
    """The commonest dimensions, as long as n pivots of each keep to ``PIVOT_BYTES``."""
    out, used = [], 0
    for d in sizes:
        used += 8 * d * n
        if used <= PIVOT_BYTES:
            out.append(d)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Permutations:
    """A vector as its ``prefix`` nearest pivots in order. Nearest by angle: direction tells large inner products apart."""

    def __init__(self, pivots: np.ndarray, prefix: int):
        self.pivots, self.prefix = pivots, min(prefix, len(pivots))

    def order(self, x: np.ndarray) -> np.ndarray:
        near = np.nan_to_num(unit(x) @ self.pivots.T)
        top = np.argpartition(-near, self.prefix - 1, axis=1)[:, : self.prefix] if self.prefix < len(self.pivots) else np.tile(np.arange(len(self.pivots)), (len(x), 1))
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)

    def posted(self, x: np.ndarray) -> bytes:
        """The inverted file of a block: per pivot a list of one byte a vector, ``prefix`` less the pivot's place in it,
        or 0 where it isn't posted. Lists are kept dense, as each names a good part of the vectors."""
        lists = np.zeros((len(self.pivots), len(x)), dtype="u1")
        order = self.order(x)
        lists[order.T, np.arange(len(x))[None]] = (self.prefix - np.arange(self.prefix)).astype("u1")[:, None]
        return lists.tobytes()


class PostedBlock:
    """Reads, for a query, the lists of its own nearest pivots. Places i and j of a pivot take 2 min(l - i, l - j) off
    the footrule distance of two prefixes of length l, to which a missing pivot counts as place l; so the sum of those
    minima orders vectors by footrule. The first ``share`` of the block is reranked on the original vectors."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, extra: bytes, prefix: int, share: float):
        self.ids, self.data, self.prefix = ids, data, prefix
        self.lists = np.frombuffer(extra, dtype="u1").reshape(-1, len(ids)).astype("u2") if extra else None
        self.keep = min(len(ids), math.ceil(share * len(ids)) + 1)  # and the query itself

    def top(self, queries: list, k: int) -> Iterator[tuple]:
        agree, low = np.empty(len(self.ids), dtype="u2"), np.empty(len(self.ids), dtype="u2")
        for q_ids, q_data, q_extra in queries:
            orders = np.frombuffer(q_extra, dtype="<u2").reshape(len(q_ids), -1)
            for i, v, order in zip(q_ids.tolist(), q_data, orders, strict=True):
                at = np.arange(len(self.ids))
                if self.lists is not None and self.keep < len(at):
                    agree.fill(0)
                    for place, p in enumerate(order.tolist()):
                        np.minimum(self.lists[p], self.prefix - place, out=low)
                        np.add(agree, low, out=agree)
                    at = np.argpartition(agree, len(agree) - self.keep)[len(agree) - self.keep :]
                at = at[self.ids[at] != i]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = (self.data[at] * v).sum(axis=1)
                got = best(scores, self.ids[at], k)
                yield i, at[got], scores[got]


def approximate(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = 512, prefix: int = 255, probes: int = 128, share: float = 0.02, least: int = 16, block: int = 8192) -> DataFrame:
    """Op 2. Per query its k nearest found by largest inner product: query_id, rank, vec_id, score (double).

    Every row whose vec_id is divisible by ``every`` is a query; every row is indexed under its ``prefix`` nearest pivots
    (255 at most). A query reads the lists of its ``probes`` nearest pivots and reranks ``share`` of the rows, or
    ``least`` times k of them where that is more. Pivots are a bounded sample of rows, by hash; dimensions too rare for
    any are searched whole. Null, zero or non-finite vectors
    and null ids take no part; vectors only meet those of their own dimension. Rows that repeat a vec_id are each a
    candidate but for the query's own id. Empty tables give an empty result.
    """
    rows = usable(vectors, True)
    sizes = dimensions(rows)
    fitted = {d: Permutations(unit(np.array([r.v for r in sample(rows, d, pivots, 11)], dtype="f8")), prefix) for d in pivoted(sizes, pivots)}
    lengths = {d: p.prefix for d, p in fitted.items()}
    sent = vectors.sparkSession.sparkContext.broadcast({d: (p.pivots, p.prefix) for d, p in fitted.items()})

    def permutations(d: int) -> Permutations | None:
        return Permutations(*sent.value[d]) if d in sent.value else None

    def index(d: int, ids: np.ndarray, data: np.ndarray) -> bytes:
        p = permutations(d)
        return p.posted(data) if p else b""

    def ask(d: int, ids: np.ndarray, data: np.ndarray) -> bytes:
        p = permutations(d)
        return np.ascontiguousarray(p.order(data)[:, :probes], dtype="<u2").tobytes() if p else np.zeros((len(ids), 1), dtype="<u2").tobytes()

    class Opened(PostedBlock):
        def __init__(self, d: int, ids: np.ndarray, data: np.ndarray, extra: bytes):
            super().__init__(ids, data, extra, lengths.get(d, 0), max(share, least * k / sizes[d]) if d in lengths else 1.0)

        def top(self, queries: list) -> Iterator[tuple]:
            return super().top(queries, k)

    return search(rows, sizes, every, k, "double", block, index, ask, Opened)


def exact(x: float) -> int:
    """floor(1024 * x) with the product as a double, as a Python integer; beyond doubles it is the largest double."""
    y = 1024.0 * float(x)
    return math.floor(y) if math.isfinite(y) else int(math.copysign(1.7976931348623157e308, y))


def floored(data: np.ndarray) -> tuple[np.ndarray, bool]:
    """floor(1024 * x), and whether sums of their products are whole doubles and longs."""
    with np.errstate(over="ignore"):
        floor = np.floor(1024.0 * data)
    peak = float(np.abs(floor).max(initial=0))
    return floor, peak * peak * max(1, data.shape[1]) < 2.0**62 and peak < 2.0**52


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Places of n rows, each the farthest from those before it; the first is the one of greatest norm."""
    chosen = [int(np.argmax((x * x).sum(axis=1)))] if len(x) else []
    gap = np.full(len(x), np.inf)
    while chosen and len(chosen) < min(n, len(x)):
        gap = np.minimum(gap, distances(x, x[chosen[-1:]])[:, 0])
        gap[chosen] = -1
        chosen.append(int(np.argmax(gap)))
    return np.array(chosen, dtype="i8")


class TableBlock:
    """A block of the pivot table: every vector's distances to the pivots, computed once. By the triangle inequality their
    greatest difference from the query's is a lower bound of a vector's distance, hence an upper bound of its inner
    product. Candidates are evaluated in bound order until the next bound is below the k-th score, which starts at that
    of the pivots themselves, as they are candidates too, in whatever block they stand."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, extra: bytes, pivots: tuple[np.ndarray, np.ndarray] | None):
        self.ids, self.data = ids, data
        self.floor, whole = floored(data)
        self.wide = not whole or pivots is None or not extra
        self.evaluated = 0
        if not self.wide:
            self.pivot_ids, self.pivots = pivots
            self.table = np.frombuffer(extra, dtype="<f8").reshape(len(self.pivots), len(ids))
            self.norms = (self.floor * self.floor).sum(axis=1)
            self.ints, self.pivot_ints = self.floor.astype("i8"), self.pivots.astype("i8")

    def top(self, queries: list, k: int) -> Iterator[tuple]:
        for q_ids, q_data, _ in queries:
            for i, v in zip(q_ids.tolist(), q_data, strict=True):
                floor, whole = floored(v[None])
                yield i, *(self.by_bounds(i, floor[0], k) if whole and not self.wide else self.by_integers(i, v, k))

    def by_integers(self, query: int, v: np.ndarray, k: int) -> tuple:
        """Every candidate with Python's integers, for components that sums of doubles or longs can't hold."""
        w = [exact(x) for x in v]
        rows = np.flatnonzero(self.ids != query)
        scores = [max(-INT64 - 1, min(INT64, sum(exact(a) * b for a, b in zip(self.data[r], w, strict=True)))) for r in rows]
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        return rows[order], [scores[i] for i in order]

    def by_bounds(self, query: int, w: np.ndarray, k: int) -> tuple:
        here = distances(w[None], self.pivots)[0]
        low = np.zeros(len(self.ids))
        for p in range(len(here)):
            np.maximum(low, np.abs(self.table[p] - here[p]), out=low)
        size = self.norms + float(w @ w)
        bound = (size - low * low) / 2 + 1e-6 * size + 2  # the margin covers rounding
        w8 = w.astype("i8")
        others = np.sort((self.pivot_ints @ w8)[self.pivot_ids != query])
        floor = others[-k] if len(others) >= k else -INT64 - 1
        left = np.flatnonzero((bound >= floor) & (self.ids != query))
        left = left[np.argsort(-bound[left], kind="stable")]
        got_at, got = np.empty(0, dtype="i8"), np.empty(0, dtype="i8")
        done, n = 0, max(64, 4 * k)
        while done < len(left):
            at = left[done : done + n]
            if len(got) >= k and bound[at[0]] < got.min():
                break
            done += len(at)
            at, scores = np.concatenate([got_at, at]), np.concatenate([got, self.ints[at] @ w8])
            best_at = best(scores, self.ids[at], k)
            got_at, got = at[best_at], scores[best_at]
            n *= 2
        self.evaluated += done
        return got_at, got


def pivots_apart(rows: DataFrame, sizes: dict[int, int], n: int, among: int = 2048) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension the ids and floored vectors of n pivots far apart, out of a bounded sample by hash. A sampled id that
    repeats is left out, as its score would count twice."""
    out = {}
    for d in pivoted(sizes, among):
        got = sample(rows, d, among, 13)
        ids, x = np.array([r.vec_id for r in got], dtype="i8"), np.array([r.v for r in got], dtype="f8").reshape(len(got), d)
        floor, whole = floored(x)
        if not whole:  # pivots of the plain vectors only
            fits = np.array([floored(r[None])[1] for r in x], dtype=bool)
            ids, floor = ids[fits], floor[fits]
        ids, first = np.unique(ids, return_index=True)
        floor = floor[first]
        at = far_apart(floor, n)
        if len(at) and floored(floor[at] / 1024.0)[1]:
            out[d] = ids[at], floor[at]
    return out


def exact_top(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = 64, block: int = 8192) -> DataFrame:
    """Op 10. Per query its k highest integer inner products: query_id, rank, vec_id, score (long), exactly.

    Rows whose vec_id is divisible by ``every`` are queries. Null or non-finite vectors and null ids take no part;
    vectors only meet those of their own dimension; scores beyond a long are held at its limits and tie there. Rows that
    repeat a vec_id are each a candidate but for the query's own id; a repeated query gives its rows once a rank.
    """
    rows = usable(vectors, False)
    sizes = dimensions(rows)
    sent = vectors.sparkSession.sparkContext.broadcast(pivots_apart(rows, sizes, pivots))

    def index(d: int, ids: np.ndarray, data: np.ndarray) -> bytes:
        floor, whole = floored(data)
        return np.ascontiguousarray(distances(floor, sent.value[d][1]).T, dtype="<f8").tobytes() if whole and d in sent.value else b""

    class Opened(TableBlock):
        def __init__(self, d: int, ids: np.ndarray, data: np.ndarray, extra: bytes):
            super().__init__(ids, data, extra, sent.value.get(d))

        def top(self, queries: list) -> Iterator[tuple]:
            return super().top(queries, k)

    return search(rows, sizes, every, k, "long", block, index, lambda d, ids, data: b"", Opened)
