"""What the operators share: shared scratch space, Arrow plumbing, a bounded memo, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python; both bound a worker's memory with very long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and bytes, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder in spark.checkpoint.dir (a local one only where that is unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="patchloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/patchloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing lazy reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def crc32(text: Column) -> Column:
    """Unsigned crc32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of rows sorted by them. One run is held at a time, so callers bound its size beforehand."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, z in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


class Memo(dict):
    """A bounded memo: two generations of at most ``size`` entries, the older dropped whole. make(key) fills it."""

    def __init__(self, make: Callable[[bytes], bytes], size: int = 1 << 16, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) of the undirected graph edges(u, v): root is the least node of the component.

    Alternates large-star and small-star steps. Every step is a min-aggregation (combined before the shuffle, so a
    hub costs one row a task) and an equi-join that adaptive execution can split; each round is written to the shared
    folder. Null ends and self loops are allowed and ignored; nodes without a link don't appear.
    """
    table = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        both = table.union(table.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = table.where("u > v").join(low, "u").where("u <> m").select("u", F.col("m").alias("v"))
        after = large.union(least).distinct()
        low = after.groupBy("u").agg(F.min("v").alias("m"))
        small = after.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stored(small, name)
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(table) if table.inputFiles() else None
        table = new
        if now == seen:
            return table.select(F.col("u").alias("node"), F.col("v").alias("root")).union(table.select("v", "v").distinct())
        seen = now
