"""Op 1: token ids on disk, each document compressed by itself with one shared zstandard dictionary.

File format. A store is a folder of two tables: ``dictionary`` (one row: hash, bytes) and ``blocks``. A block holds
consecutive documents in ascending doc_id order: ``payload`` is their zstandard frames one after the other (each frame:
the ids as little-endian unsigned 32-bit integers), ``offsets`` the offset index, one little-endian 64-bit end offset a
document, ``docs`` the doc_ids, ``counts`` the token counts, ``dict_hash`` the dictionary needed. ``part`` and ``block``
order the blocks, and ``before`` is the number of ids ahead of the block within its part. A single document is read by
its block (min/max statistics of ``first`` and ``last`` prune the rest) and two entries of the offset index.
Spark's own writer puts the tables into whatever store the path names, with its commit protocol, so a lost executor
leaves no half-written block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_batches, prepare
from .token_ids import library

BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("dict_hash", pa.string()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.binary()), ("payload", pa.binary())])
BLOCK_SQL = "part int, block int, before long, first long, last long, n_docs int, n_tokens long, dict_hash string, docs array<long>, counts array<long>, offsets binary, payload binary"


#: Bytes of texts that one task sorts and encodes.
PART_BYTES = 64 << 20


def train(docs: DataFrame, vocab: str, sample_docs: int = 400, sample_chars: int = 16384, size: int = 64 << 10) -> bytes:
    """A dictionary fitted on a bounded sample: the sample_docs rows of least hash, at most sample_chars of each."""
    import zstandard

    h = F.xxhash64("doc_id", F.lit(7))
    some = docs.where("text is not null")
    # the hashes first, so that no task sends texts which another's replace
    last = some.select(h.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    rows = some.where(h <= last).select(F.substring("text", 1, sample_chars).alias("text")).limit(sample_docs).collect() if last is not None else []
    samples = [s for s in library(vocab).encode([r.text.encode() for r in rows]) if s]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b"".join(samples)[:size]


def write(docs: DataFrame, path: str, vocab: str = "word_bpe_49k.json", end_id: int = 1, level: int = 3, block_bytes: int = 1 << 20, partitions: int | None = None) -> None:
    """Encode every whole text, append end_id, and write the store at path.

    Range-partitioned by (doc_id, hash of the text), so that no repeated doc_id gathers in one task; null doc_ids come
    first. Null texts count as empty and hold just the end id. A document larger than a block has one for itself.
    """
    spark = docs.sparkSession
    dictionary = train(docs, vocab)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    # as many parts as the texts' bytes ask for, so that a task's sort is bounded whatever the table's size
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        end = end_id.to_bytes(4, "little")
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, block, before
            ids, counts, frames = zip(*held, strict=True)
            known = [i for i in ids if i is not None]
            row = {"part": part, "block": block, "before": before, "first": min(known, default=None), "last": max(known, default=None), "n_docs": len(ids), "n_tokens": sum(counts), "dict_hash": name, "docs": list(ids), "counts": list(counts), "offsets": np.cumsum([len(f) for f in frames]).astype("<i8").tobytes(), "payload": b"".join(frames)}
            before, block, held, size = before + sum(counts), block + 1, [], 0
            return batch(BLOCK, {k: [v] for k, v in row.items()})

        for b in batches:
            texts = b.column("text").to_pylist()
            for doc, ids in zip(b.column("doc_id").to_pylist(), library(vocab).encode(texts), strict=True):
                frame = press.compress(ids + end)
                if held and size + len(frame) > block_bytes:
                    yield flush()
                held.append((doc, len(ids) // 4 + 1, frame))
                size += len(frame)
        if held:
            yield flush()

    map_batches(dealt, run, BLOCK_SQL).write.option("compression", "none").parquet(f"{path}/blocks")


def dictionary_of(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["bytes"])
    if hashlib.sha256(data).hexdigest() != row["hash"]:
        raise ValueError(f"{path}: the dictionary doesn't have its hash")
    return row["hash"], data


def _reader(spark: SparkSession, path: str, schema: pa.Schema, sql: str, make):
    name, dictionary = dictionary_of(spark, path)
    blocks = prepare(spark).read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        read = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for b in batches:
            for row in b.to_pylist():
                if row["dict_hash"] != name:
                    raise ValueError("a block names another dictionary")
                ends = np.frombuffer(row["offsets"], dtype="<i8")
                frames = (read.decompress(row["payload"][a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True))
                yield batch(schema, make(row, frames))

    return blocks, lambda df: map_batches(df, run, sql)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids: all that a store holds."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    blocks, read = _reader(spark, path, schema, "doc_id long, ids array<long>", lambda row, frames: {"doc_id": row["docs"], "ids": [np.frombuffer(f, dtype="<u4").astype("i8") for f in frames]})
    return read(blocks)


def document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with that doc_id, by the index: only their own frames are decompressed."""
    import zstandard

    name, dictionary = dictionary_of(spark, path)
    read = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    out = []
    for row in spark.read.parquet(f"{path}/blocks").where((F.col("first") <= doc_id) & (F.col("last") >= doc_id)).orderBy("part", "block").toLocalIterator():
        ends = [0, *np.frombuffer(row["offsets"], dtype="<i8")]
        out += [np.frombuffer(read.decompress(bytes(row["payload"][ends[k] : ends[k + 1]])), dtype="<u4").tolist() for k, d in enumerate(row["docs"]) if d == doc_id]
    return out


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The ids ahead of each part are summed over one row a part; their number is the writer's number of partitions.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(row: dict, frames: Iterator[bytes]) -> dict:
        data = list(frames)
        counts = np.array([len(f) // 4 for f in data], dtype="i8")
        if counts.tolist() != row["counts"]:
            raise ValueError("a block's counts don't match its frames")
        return {"doc_id": row["docs"], "part": [row["part"]] * len(data), "start": row["before"] + np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": [zlib.crc32(f) for f in data]}

    blocks, read = _reader(spark, path, schema, "doc_id long, part int, start long, n_tokens long, ids_crc32 long", rows)
    totals = sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    sums = np.cumsum([0, *(r.n for r in totals)]).tolist()
    ahead = spark.createDataFrame([(r.part, s) for r, s in zip(totals, sums, strict=False)], "part int, ahead long")
    return read(blocks).join(F.broadcast(ahead), "part").select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
