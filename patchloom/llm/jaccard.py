"""Op 5: n-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles. Equal sets are one class from the start and go on as one representative.
Each run samples, per set, the tokens whose hash along the path so far is below 1.25 / size: about 1.25 tokens, and at
least one shared token on the mean for a pair at 0.8. The sets that share a token share a path; a path with more than
``small`` sets is split again by tokens sampled along it, to ``LEVELS`` levels. Within a final path all sets meet by a
128-byte sketch of their minimum hashes. Pairs whose sketches agree are edges of a graph; its components, found by a
distributed star algorithm, are compared exactly, in blocks of bounded size. No pair list is ever made: a block yields
link counts and the edges of a spanning forest.

Runs repeat until the target recall, which is measured: of the edges that new runs find, the share between components
that the earlier runs had left apart estimates what those had missed, and independent runs multiply. The first two
groups of runs share one pass over the texts; further groups are only made if the target isn't met by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, components, forget, groups, map_batches, stored

#: Runs of a group, levels of a path, sets of a path that isn't split, words of a shingle, and the least similarity.
RUNS, LEVELS, SMALL, SHINGLE, LEAST = 8, 3, 64, 5, 0.8
#: Share of the links that the runs have to find, by the estimate above.
TARGET = 0.999
#: Bins of a sketch, its least agreement for an exact comparison.
BINS, SKETCH_LEAST = 128, 0.62
#: Sets of a path that meet at once; sets and tokens of a block that is compared exactly at once.
PART, BLOCK, TOKENS = 2048, 1024, 1 << 20
#: Odd multipliers (fixed values): 64-bit mixing and the shingles' rolling weights.
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What separates words: ASCII but letters and digits (fixed values).
SPACE = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * TURN
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


class Shingler:
    def __init__(self, n: int = SHINGLE):
        self.n = n

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes. Fewer words than n are one shingle; no words, none."""
        words = (text or "").lower().encode().translate(SPACE).split()
        if not words:
            return np.empty(0, dtype="u8")
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="u8", count=len(words))
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = np.zeros(len(h) - n + 1, dtype="u8")
            for k in range(n):
                out = out * TURN + h[k : len(h) - n + 1 + k]
            return np.unique(mixed(out + np.uint64(len(h) if n < self.n else 0)))


def sketch(tokens: np.ndarray) -> bytes:
    """One byte a bin: of the least hash in each of 128 equal ranges of hashes; 0 for a bin without any."""
    ends = np.searchsorted(tokens, np.arange(BINS, dtype="u8") << np.uint64(57))
    stops = np.append(ends[1:], len(tokens))
    out = np.zeros(BINS, dtype="u1")
    some = ends < stops
    out[some] = (mixed(tokens[ends[some]]) % np.uint64(255) + np.uint64(1)).astype("u1")
    return out.tobytes()


def paths(tokens: np.ndarray, first: int, runs: int, levels: int = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the (place of the parent in the level above, path hash) of all paths that a set takes, by parent.

    Runs are numbered, so that later runs differ from earlier ones; at the first level the parent is the run's place.
    """
    none = (np.empty(0, dtype="i8"), np.empty(0, dtype="u8"))
    if not len(tokens):
        return [none] * levels
    limit = np.uint64(min(2**64 - 1, int(1.25 / len(tokens) * 2**64)))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1 << 14  # tokens at once, which bounds memory for very long texts
    with np.errstate(over="ignore"):
        parents = mixed(np.arange(first + 1, first + runs + 1, dtype="u8"))
        for _ in range(levels):
            odd = (parents | np.uint64(1))[:, None]  # multiplying by it hashes a token along its path
            found = []
            for i in range(0, len(tokens), step):
                part = tokens[i : i + step]
                k, t = np.nonzero(odd * part <= limit)
                found.append((k, odd[k, 0] * part[t]))
            up = np.concatenate([k for k, _ in found])
            parents = mixed(np.concatenate([h for _, h in found]) ^ mixed(parents[up]))
            order = np.argsort(up, kind="stable")
            up, parents = up[order], parents[order]
            out.append((up, parents))
    return out


def trees(found: list[list[tuple[np.ndarray, np.ndarray]]], runs: int) -> pa.Array:
    """Each set's paths as a column of nested arrays: late (the second group of runs), path, and the paths below it."""
    below = None
    for k in reversed(range(LEVELS)):
        path = pa.array(np.concatenate([t[k][1] for t in found]).view("i8"), pa.int64())
        fields = {"path": path} | ({} if below is None else {"kids": below})
        if k:
            counts = np.concatenate([np.bincount(t[k][0], minlength=len(t[k - 1][1])) for t in found])
        else:
            fields = {"late": pa.array(np.concatenate([t[0][0] for t in found]) >= RUNS, pa.bool_())} | fields
            counts = np.array([len(t[0][1]) for t in found])
        values = path if below is None else pa.StructArray.from_arrays(list(fields.values()), list(fields))
        below = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
    return below


TREE = pa.list_(pa.struct([("late", pa.bool_()), ("path", pa.int64()), ("kids", pa.list_(pa.struct([("path", pa.int64()), ("kids", pa.list_(pa.int64()))])))]))
TREE_SQL = "array<struct<late: boolean, path: bigint, kids: array<struct<path: bigint, kids: array<bigint>>>>>"
SETS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("sketch", pa.binary()), ("tree", TREE)])
SETS_SQL = f"doc_id long, k1 long, k2 long, digest binary, n int, sketch binary, tree {TREE_SQL}"


def sets(docs: DataFrame, first: int, runs: int) -> DataFrame:
    """docs (doc_id, k1, k2, text) to their shingle sets: digest, size, sketch, and the paths of the runs from ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches:
            if not b.num_rows:
                continue
            out: dict[str, list] = {"n": [], "digest": [], "sketch": []}
            found = []
            for text in b.column("text"):
                tokens = shingle(text.as_py())
                out["n"].append(len(tokens))
                out["digest"].append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                out["sketch"].append(sketch(tokens))
                found.append(paths(tokens, first, runs))
            yield batch(SETS, {c: b.column(c) for c in ("doc_id", "k1", "k2")} | out | {"tree": trees(found, runs)})

    return map_batches(docs, run, SETS_SQL)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each node's component, for edges a-b over n nodes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    return root


def agreeing(one: np.ndarray, size: int, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the other sketches that agree with one."""
    some = ((other > 0) | (one > 0)).sum(axis=1)
    agree = ((other == one) & (one > 0)).sum(axis=1)
    return np.flatnonzero((agree >= SKETCH_LEAST * some) & (np.minimum(sizes, size) >= 0.79 * np.maximum(sizes, size)))


def sketch_edges(found: DataFrame, survivors: bool = False, apart: bool = False) -> DataFrame:
    """Edges (u, v, late) of a spanning forest of each path's sets whose sketches agree.

    found: path, part, late, rep, n, sketch. With ``survivors`` each tree's least set also gives a row (u, u, late) and
    its path, for it to meet those of the path's other parts. With ``apart`` rows marked ``first`` meet only the part's
    other rows, and of them only those of another root.
    """
    schema = pa.schema([("path", pa.int64()), ("late", pa.bool_()), ("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            full = batch(schema, {f.name: np.concatenate([h[k] for h in held]) for k, f in enumerate(schema)})
            held, size = [], 0
            return full

        for t in groups(batches, ["path", "part"]):
            if len(t) < 2 and not survivors:
                continue
            rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
            s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype="u1").reshape(len(rep), BINS)
            left, right = [np.empty(0, dtype="i8")], [np.empty(0, dtype="i8")]
            if apart:
                root, first = t.column("root").to_numpy(), t.column("first").to_numpy()
                for r in np.unique(root[first]):
                    j = np.flatnonzero(~first & (root != r))
                    met, size_j = s[j], n[j]
                    for i in np.flatnonzero(first & (root == r)):
                        right.append(j[agreeing(s[i], n[i], met, size_j)])
                        left.append(np.full(len(right[-1]), i))
            else:
                for i in range(len(rep) - 1):
                    right.append(agreeing(s[i], n[i], s[i + 1 :], n[i + 1 :]) + i + 1)
                    left.append(np.full(len(right[-1]), i))
            root = roots(len(rep), np.concatenate(left), np.concatenate(right))
            at = np.arange(len(rep)) if survivors else np.flatnonzero(root != np.arange(len(rep)))
            held.append((np.full(len(at), t.column("path")[0].as_py()), np.full(len(at), t.column("late")[0].as_py()), rep[at], rep[root[at]]))
            size += len(at)
            if size > 50_000:
                yield flush()
        if held:
            yield flush()

    return map_batches(found, run, "path long, late boolean, u long, v long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> np.ndarray:
    """Sizes of all intersections, as a matrix product over the tokens that occur twice, in chunks of bounded memory."""
    both = left if same else left + right
    if len(left) * len(right) <= 36:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], dtype="f4")
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    order = np.argsort(flat := np.concatenate(both), kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    times = np.diff(np.append(starts, len(flat)))
    keep = np.repeat(times > 1, times)
    column = np.repeat(np.cumsum(times > 1) - 1, times)[keep]
    owner = owner[keep]
    out = np.zeros((len(left), len(right)), dtype="f4")
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, z = np.searchsorted(column, (c, c + 4096))
        m = np.zeros((len(both), 4096), dtype="f4")
        m[owner[a:z], column[a:z] - c] = 1
        out += m[: len(left)] @ (m if same else m[len(left) :]).T
    return out


def compared(found: DataFrame, least: float) -> DataFrame:
    """Exact comparison within (comp, i, j): rows of kind 'links' (rep, number) and of kind 'edge' (rep, root)."""
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for t in groups(batches, ["comp", "i", "j"]):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            block, rep, copies = (t.column(c).to_numpy() for c in ("block", "rep", "copies"))
            texts = [shingle(x) for x in t.column("text").to_pylist()]
            a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
            left, right = [texts[k] for k in a], [texts[k] for k in b]
            size_a, size_b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
            inter = overlaps(left, right, i == j)
            near = inter >= least * (size_a[:, None] + size_b[None] - inter) - 1e-6
            if i == j:
                np.fill_diagonal(near, False)
            links = np.zeros(len(rep), dtype="i8")
            np.add.at(links, a, near @ copies[b])
            if i != j:
                np.add.at(links, b, near.T @ copies[a])
            x, y = np.nonzero(near)
            root = roots(len(rep), a[x], b[y])
            at = np.flatnonzero(links)
            yield batch(schema, {"rep": rep[at], "root": rep[root[at]], "links": links[at], "whole": np.full(len(at), t.column("blocks")[0].as_py() == 1)})

    return map_batches(found, run, "rep long, root long, links long, whole boolean")


def spread(rows: DataFrame, n_rows: int, keys: list[str], each: int = 20_000) -> DataFrame:
    """Rows dealt and sorted by keys into about so many a task. The number is given, as rows are dear for their bytes."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n_rows // each)), *keys).sortWithinPartitions(*keys, "rep")


def final_paths(body: DataFrame, small: int) -> DataFrame:
    """rep, late, path, size: the paths that aren't split further and that at least two sets share.

    A level's rows meet the sizes of its paths once; only the sets of large paths are looked up again, for their next
    tokens. Every level has about as many rows as sets, whatever the paths' sizes.
    """
    rows = body.select("rep", F.posexplode("tree").alias("i", "t")).select("rep", "i", "t.late", "t.path")
    out = None
    for k in range(LEVELS):
        sizes = stored(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "path-sizes")
        sized = rows.join(sizes, "path")
        last = k == LEVELS - 1 or not sizes.where(F.col("size") > small).head(1)
        done = (sized if last else sized.where(F.col("size") <= small)).select("rep", "late", "path", "size")
        out = done if out is None else out.union(done)
        if last:
            return out
        large = sized.where(F.col("size") > small)
        if k == 0:
            kid = large.join(body.select("rep", "tree"), "rep").select("rep", "late", F.explode(F.col("tree")[F.col("i")]["kids"]).alias("t"))
            rows = stored(kid.select("rep", "late", "t.path", "t.kids"), "path-level")
        else:
            rows = stored(large.select("rep", "late", F.explode("kids").alias("path")), "path-level")


def edges_of(body: DataFrame, small: int) -> DataFrame:
    """u, v, late: what the sets of each final path have as sketch edges. A path of over ``PART`` sets meets in parts by
    hash; the least sets of the parts' trees meet again, in pairs of parts if they are still too many for one. Then all
    sets of the path that are still in different components meet, so no edge between components is left out."""
    found = stored(final_paths(body, small).join(body.select("rep", "n", "sketch"), "rep"), "final-paths")
    few = found.where(F.col("size") <= PART).withColumn("part", F.lit(0).cast("long"))
    edges = sketch_edges(spread(few, found.count(), ["path", "part"])).select("u", "v", "late")
    many = found.where(F.col("size") > PART)
    n_many = many.count()
    if not n_many:
        return stored(edges, "edges")
    parted = many.withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / PART)))
    first = stored(sketch_edges(spread(parted, n_many, ["path", "part"]), True), "part-edges")
    alive = first.where("u = v").select("path", F.col("u").alias("rep"))
    left = stored(many.drop("size").join(alive, ["path", "rep"]).join(alive.groupBy("path").agg(F.count("*").alias("size")), "path"), "survivors")
    parts = F.ceil(F.col("size") / PART)
    own = left.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.least(x, F.col("own")) * F.col("parts") + F.greatest(x, F.col("own"))))
    again = sketch_edges(spread(own.withColumn("part", pair), left.count(), ["path", "part"])).select("u", "v", "late")
    edges = stored(edges.union(first.where("u <> v").select("u", "v", "late")).union(again), "edges")
    rest = between(many, alive, components(edges.select("u", "v"), "path-graph"))
    n_rest = rest.count()
    return stored(edges.union(sketch_edges(spread(rest, n_rest, ["path", "part"]), apart=True).select("u", "v", "late")), "edges") if n_rest else edges


def between(many: DataFrame, alive: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the paths that hold several components: the sets outside the largest, marked ``first``, meet every set.

    Both sides are dealt into parts by hash, and each pair of parts meets in one place, so its size is bounded. A path
    whose sets are all ``alive`` has met in full already.
    """
    root = comps.select(F.col("node").alias("rep"), "root")
    placed = stored(many.join(root, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "placed")
    by_root = placed.groupBy("path", "root").agg(F.count("*").alias("k"))
    ways = by_root.groupBy("path").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("total"), F.count("*").alias("roots"))
    ways = ways.join(alive.groupBy("path").agg(F.count("*").alias("alive")), "path").where("roots > 1 and alive < total")
    ways = ways.select("path", F.col("most.root").alias("main"), F.ceil((F.col("total") - F.col("most.k")) / PART).alias("firsts"), F.ceil(F.col("total") / PART).alias("seconds"))
    rows = placed.join(ways, "path")
    cell = lambda i, j: i * F.col("seconds") + j
    own = lambda salt, c: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(c))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    keep = ["path", "late", "rep", "n", "sketch", "root"]
    one = rows.where("root <> main").select(*keep, F.lit(True).alias("first"), F.explode(F.transform(upto("seconds"), lambda j: cell(own(2, "firsts"), j))).alias("part"))
    return one.unionByName(rows.select(*keep, F.lit(False).alias("first"), F.explode(F.transform(upto("firsts"), lambda i: cell(i, own(4, "seconds")))).alias("part")))


def grown(comps: DataFrame, edges: DataFrame) -> tuple[DataFrame, float]:
    """Components (node, root) with more edges, and the share of those that ran between different components before."""
    root = lambda c, r: comps.select(F.col("node").alias(c), F.col("root").alias(r))
    named = edges.select("u", "v").distinct().join(root("u", "ru"), "u", "left").join(root("v", "rv"), "v", "left")
    named = stored(named.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")), "named-edges")
    n, cross = named.agg(F.count("*"), F.count_if(F.col("u") != F.col("v"))).first()
    if not cross:
        return comps, 0.0
    more = stored(components(named, "merged").select("node", F.col("root").alias("now")), "merged-roots")
    old = comps.join(more.select(F.col("node").alias("root"), "now"), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    new = more.join(comps.select("node"), "node", "left_anti").select("node", F.col("now").alias("root"))
    return stored(old.union(new), "comps"), cross / n


def join(docs: DataFrame, least: float = LEAST, small: int = SMALL, target: float = TARGET) -> DataFrame:
    """One row a document: doc_id, class_id, n_links.

    class_id is the least doc_id of the class, n_links the number of other rows at ``least`` or more, copies counted
    each. Null, empty and wordless texts have no shingles: they link to nothing and are their own class. Texts of fewer
    than five words are one shingle of all their words. Repeated rows link to each other. A null doc_id gets a class but
    names it only if no other row has an id. Sets are told apart by 128 bits, so texts that merge by chance need some
    10^19 different ones.
    """
    return classes(docs, least, small, target).select("doc_id", "class_id", "n_links")


def keyed(docs: DataFrame, k1: str = "k1", k2: str = "k2") -> DataFrame:
    """docs' columns, and under two new names 128 bits of doc_id and text that name a row (equal rows share them)."""
    doc = F.col("doc_id").cast("long")
    return docs.select("*", F.xxhash64(doc, "text").alias(k1), F.xxhash64(F.lit(1), "text", doc).alias(k2))


def classes(docs: DataFrame, least: float = LEAST, small: int = SMALL, target: float = TARGET) -> DataFrame:
    """The rows of ``join`` with k1 and k2 (see ``keyed``) and root: a number of the class, null for a text without words."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    made = stored(sets(rows, 0, 2 * RUNS), "sets")
    shared = made.where("digest is not null")
    one = shared.groupBy("digest").agg(F.min(F.struct("k1", "k2")).alias("f"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    # numbers are unique by construction, and fixed once written
    reps = stored(one.select(F.monotonically_increasing_id().alias("rep"), "digest", F.col("f.k1").alias("k1"), F.col("f.k2").alias("k2"), "least_id", "copies"), "reps")
    body = stored(shared.join(reps.select("rep", "digest", "k1", "k2"), ["digest", "k1", "k2"]).dropDuplicates(["rep"]).select("rep", "n", "sketch", "tree"), "chosen")
    names = stored(made.select("doc_id", "k1", "k2", "digest"), "names")
    forget(made)

    edges = edges_of(body, small)
    comps = stored(components(edges.where("not late").select("u", "v"), "sketch-graph"), "comps")
    comps, missed = grown(comps, edges.where("late"))
    apart, runs = missed * missed, 2 * RUNS
    # a group that finds nothing but new edges says that the runs so far missed all: they go on, as each merges components
    while apart > 1 - target:
        again = rows.join(reps.select("rep", "k1", "k2"), ["k1", "k2"]).dropDuplicates(["rep"])
        more = stored(sets(again.select(F.col("rep").alias("doc_id"), "k1", "k2", "text"), runs, RUNS).select(F.col("doc_id").alias("rep"), "n", "sketch", "tree"), "chosen")
        comps, missed = grown(comps, edges_of(more, small))
        apart, runs = apart * missed, runs + RUNS

    comps = comps.select(F.col("node").alias("rep"), F.col("root").alias("comp")).join(body.select("rep", "n"), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / TOKENS)).alias("blocks")
    inside = comps.join(comps.groupBy("comp").agg(blocks), "comp").join(reps.select("rep", "k1", "k2", "copies"), "rep")
    inside = inside.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")))
    texts = rows.select("k1", "k2", "text").join(inside, ["k1", "k2"]).dropDuplicates(["rep"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = texts.withColumn("other", each).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    exact = stored(compared(met.select("comp", "i", "j", "block", "blocks", "rep", "copies", "text").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "rep"), least), "links")

    linked = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    # a component in one block has its classes already; across blocks the forests are put together
    roots = exact.where("whole").select(F.col("rep").alias("node"), "root")
    parted = exact.where("not whole")
    if parted.head(1):
        roots = roots.union(components(parted.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")), "classes"))
    own = reps.join(linked, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    low = own.groupBy("root").agg(F.min("least_id").alias("class_id"))
    named = own.join(low, "root").select("digest", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return names.join(named, "digest", "left").select("doc_id", "k1", "k2", F.coalesce("class_id", "doc_id").alias("class_id"), "root", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
