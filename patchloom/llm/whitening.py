"""Op 11: whitening of embeddings onto their leading components, found by a randomised range finder.

Vectors become whole numbers, floor(256 c). Moments are taken over the fit list, each distinct vector once. A pass over all
centred rows of the fit list multiplies the covariance with a thin basis: tasks sum their rows, the sums are added by
dimension in a shuffle, and only the small product comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, stored

LIMIT = 2**63 - 1
#: Basis vectors beyond the components asked for, and power passes before the basis becomes the full space.
OVERSAMPLE, PASSES = 8, 6
#: A component is found if its residual is this small against the first eigenvalue and against the gap to its neighbours.
RESIDUAL, GAP = 1e-13, 1e-10
#: An eigenvalue below this share of the first one is no variance but rounding.
NOTHING = 1e-12


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, x (longs), d: rows whose vector is whole and finite. Entries beyond a long are held at its limits."""
    v = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(~F.coalesce(F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True)))
    # floor of a double is a long with both limits held; it has no negative zero
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(256 * c)).alias("x"), F.size("v").alias("d"))


def by_dimension(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, places, matrix) of a batch's rows of each dimension."""
    x, sizes = b.column("x"), b.column("d").to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def summed(x: np.ndarray) -> list[int]:
    """Column sums as Python integers, exact beyond 64 bits."""
    if len(x) and int(np.abs(x.astype("f8")).max()) * len(x) < 2**62:
        return x.sum(axis=0).tolist()
    return [sum(c) for c in x.T.tolist()]


def moments(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per dimension d the number of fit rows and the sums of their entries."""
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("s", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_dimension(b):
                yield batch(schema, {"d": [d] * (d + 1), "i": list(range(-1, d)), "s": [len(at), *summed(x)]})

    rows = map_batches(fit, run, "d int, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").alias("s")).collect()
    got: dict[int, list[int]] = {}
    for r in rows:
        got.setdefault(r.d, [0] * (r.d + 1))[r.i + 1] = int(r.s)
    return {d: (s[0], s[1:]) for d, s in got.items()}


Row = Callable[[int, np.ndarray], tuple[np.ndarray, float]]


def totals(fit: DataFrame, means: dict[int, np.ndarray], multiply: Row) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Per dimension the sums over all fit rows of multiply(d, centred rows): a matrix by its rows, and a number.

    A task adds up its rows and hands on one row a line of the matrix; lines of one number meet in one task, which adds
    them as they come.
    """
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("y", pa.list_(pa.float64()))])
    sent = fit.sparkSession.sparkContext.broadcast(means)

    def lines(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = sorted(sums)
        for a in range(0, len(keys), 256):
            part = keys[a : a + 256]
            yield batch(schema, {"d": [k[0] for k in part], "i": [k[1] for k in part], "y": [sums[k].tolist() for k in part]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mats: dict[int, np.ndarray] = {}
        numbers: dict[int, float] = {}
        for b in batches:
            for d, _, x in by_dimension(b):
                y, t = multiply(d, x.astype("f8") - sent.value[d])
                mats[d] = mats[d] + y if d in mats else y
                numbers[d] = numbers.get(d, 0.0) + t
        for d, y in mats.items():
            yield from lines({(d, -1): np.array([numbers[d]])} | {(d, i): line for i, line in enumerate(y)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                key, y = (r["d"], r["i"]), np.array(r["y"])
                sums[key] = sums[key] + y if key in sums else y
        yield from lines(sums)

    kind = "d int, i int, y array<double>"
    out: dict[int, dict[int, list[float]]] = {}
    for r in map_batches(map_batches(fit, run, kind).repartition("d", "i"), add, kind).collect():
        out.setdefault(r.d, {})[r.i] = r.y
    return {d: np.array([rows[i] for i in range(max(rows) + 1)]) for d, rows in out.items()}, {d: rows[-1][0] for d, rows in out.items()}


@dataclass
class Model:
    """What one dimension's vectors are whitened by: n and the sums, unit components in columns, their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    #: Greatest entry of the whitened fit list's covariance minus the identity.
    error: float = 0.0
    #: Passes over the fit list, and whether the basis had to be the full space.
    passes: int = 0
    full: bool = False

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def found(self) -> np.ndarray:
        """Components with variance; a list of equal vectors has none."""
        return self.variances > NOTHING * max(self.variances.max(initial=0.0), 1e-300)

    def scaled(self) -> np.ndarray:
        """Components over the roots of their variances; those without variance are zero."""
        return self.components * np.where(self.found, 1 / np.sqrt(np.where(self.found, self.variances, 1)), 0)


def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values in falling order, vectors, and the residual of each, from V times the basis."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def converged(values: np.ndarray, residuals: np.ndarray, k: int) -> bool:
    """The first k are to double precision: residuals small, also against the gaps, which bound the vectors' errors."""
    r, top = residuals[:k], max(values[0], 0.0)
    gaps = np.minimum(np.abs(np.diff(values, prepend=np.inf))[:k], np.append(np.abs(np.diff(values)), values[-1] if len(values) else 0)[:k])
    return bool((r <= RESIDUAL * top).all() and (r <= GAP * gaps).all())


def fitted(fit: DataFrame, k: int = 4, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 7) -> dict[int, Model]:
    """A model of each dimension that occurs. Each pass serves all of them; bases are thin until residuals fail."""
    known = moments(fit)
    means = {d: np.array([s / n for s in sums]) for d, (n, sums) in known.items()}
    rng = np.random.default_rng(seed)
    bases = {d: np.eye(d) if d <= k + oversample else np.linalg.qr(rng.standard_normal((d, k + oversample)))[0] for d in sorted(known)}
    models: dict[int, Model] = {}
    done = 0
    while bases:
        sent = fit.sparkSession.sparkContext.broadcast(bases)
        part = fit.where(F.col("d").isin(sorted(bases))) if len(bases) < len(known) else fit
        images, squares = totals(part, {d: means[d] for d in bases}, lambda d, x: (x.T @ (x @ sent.value[d]), float((x * x).sum())))  # noqa: B023
        done += 1
        left = {}
        for d, basis in bases.items():
            n, sums = known[d]
            image = images[d] / n
            values, vectors, residuals = ritz(basis, image)
            full = basis.shape[1] == d
            if full or converged(values, residuals, k):
                values, vectors = np.maximum(values[:k], 0), vectors[:, :k]
                models[d] = Model(n, sums, vectors, values, squares[d] / n, passes=done, full=full)
            else:
                left[d] = np.linalg.qr(image)[0] if done < passes else np.eye(d)
        bases = left
    # what the whitened fit list really has as its covariance
    if models:
        scaled = fit.sparkSession.sparkContext.broadcast({d: m.scaled() for d, m in models.items()})
        squares, _ = totals(fit, means, lambda d, x: ((w := x @ scaled.value[d]).T @ w, 0.0))
        for d, m in models.items():
            off = np.abs(squares[d] / m.n - np.eye(len(m.variances)))[np.ix_(m.found, m.found)]
            m.error = float(off.max(initial=0.0))
    return models


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums over the dimensions of (n x - S)^2, exact; beyond a long at its limit."""
    peak = n * int(np.abs(x.astype("f8")).max(initial=0)) + max(map(abs, sums), default=0)
    if peak < 2**52 and peak * peak * x.shape[1] < 2**62:
        y = n * x - np.array(sums, dtype="i8")
        return (y * y).sum(axis=1).tolist()
    return [min(LIMIT, sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True))) for row in x.tolist()]


def whitened(vectors: DataFrame, k: int = 4, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """Op 11. vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every usable vector.

    Vectors that are null, empty or hold null or non-finite entries are dropped. Rows that repeat a vector are fitted once
    and each get their rows; so do rows that repeat a vec_id or have none. Vectors of each dimension are whitened among
    themselves; fewer than k dimensions have as many components. A component without variance (a single distinct vector)
    has a null in whitened and no part in identity_error, which is one value for all rows. Empty tables give an empty
    result. Other columns are ignored.
    """
    rows = whole(vectors)
    # grouped by the vectors themselves, with repeats combined before the shuffle
    fit = stored(rows.groupBy("d", "x").agg(F.lit(1).alias("one")).select("d", "x"), "fit-list")
    models = fitted(fit, k, oversample, passes)
    sent = vectors.sparkSession.sparkContext.broadcast(models)
    error = max((m.error for m in models.values()), default=0.0)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_dimension(b):
                m = sent.value[d]
                size, c = len(at), len(m.variances)
                values = (x.astype("f8") - m.mean) @ m.scaled()
                values = [[v if on else None for v, on in zip(r, m.found, strict=True)] for r in values.tolist()]
                share = [float(v / m.trace) if m.trace > 0 else 0.0 for v in m.variances]
                ids = b.column("vec_id").take(pa.array(at)).to_pylist()
                far = deviations(x, m.n, m.sums)
                yield batch(schema, {
                    "vec_id": [i for i in ids for _ in range(c)], "component": list(range(1, c + 1)) * size, "n": [m.n] * (size * c), "deviation": [f for f in far for _ in range(c)],
                    "whitened": [v for r in values for v in r], "explained": share * size, "identity_error": [error] * (size * c),
                })

    return map_batches(rows, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
