"""Op 7: substring dedup by hashing the units of a text.

A unit is a sentence of a line: it ends at a line end or after a word that ends in . ! or ? (a longer one is cut after
words chosen by their hash, so that a passage is cut alike wherever it stands). Units are normalised to lower-case
words, and their digests grouped over all documents. The earliest occurrence by (doc_id, place) is kept. Another is
removed if it stands in a run of repeated units with at least ``least_words`` words in all, so single short lines that
many documents share don't make holes in clean text. A shorter run goes too if it has over 50 words with the units on
either side, as a passage that starts and ends inside sentences has its first and last words in those. What is kept stays byte for byte, with its original offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, unused

#: Words in a run of repeated units that is removed.
LEAST_WORDS = 12
#: Words of a passage, beyond which a shorter run that it may lie around is removed as well.
PASSAGE = 50
#: Words of a unit after which it is cut at a word chosen by hash.
LONG = 24
#: A unit with more than one in so many of all unit rows is joined by broadcast.
HOT = 1000
UNIT = re.compile(rb"[^\n.!?]*(?:[.!?]+(?![\s])[^\n.!?]*)*(?:[.!?]+[ \t\r\f\v]*|\n|\Z)")
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def units(text: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """(start, end, digest, words) of each unit that has words, as byte offsets of the original text."""
    at, n = 0, len(text)
    while at < n:
        end = UNIT.match(text, at).end()
        if end == at:
            end = at + 1
        raw = text[at:end]
        words = TOKEN.findall(raw.lower())  # bytes: only ASCII is lowered, so offsets hold
        if len(words) <= LONG:
            if words:
                yield at, end, xxhash.xxh3_128_digest(b" ".join(words)), len(words)
        else:
            start, held = at, []
            for m in re.finditer(rb"\S+\s*", raw):
                held += TOKEN.findall(m[0].lower())
                if held and len(held) >= 4 and xxhash.xxh3_64_intdigest(held[-1]) % 8 == 0:
                    yield start, at + m.end(), xxhash.xxh3_128_digest(b" ".join(held)), len(held)
                    start, held = at + m.end(), []
            if held:
                yield start, end, xxhash.xxh3_128_digest(b" ".join(held)), len(held)
        at = end


def unit_rows(docs: DataFrame) -> DataFrame:
    """d1, d2 (128 bits of a unit), doc_id, doc_key, n (place of the unit); a text's own repeats of a unit are rows too."""
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("doc_id", pa.int64()), ("doc_key", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, counts = [], []
            for t in b.column("text"):
                found = list(units(t.as_py()))
                counts.append(len(found))
                digests += [u[2] for u in found]
            for_each = np.array(counts)
            place = np.arange(len(digests)) - np.repeat(np.cumsum(for_each) - for_each, for_each)
            index = pa.array(np.repeat(np.arange(len(counts)), for_each))
            halves = np.frombuffer(b"".join(digests), dtype="i8").reshape(-1, 2)
            full = pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), b.column("doc_id").take(index), b.column("doc_key").take(index), pa.array(place, pa.int32())], schema=schema)
            for a in range(0, full.num_rows, 1 << 17):
                yield full.slice(a, 1 << 17)

    return map_batches(docs, run, "d1 long, d2 long, doc_id long, doc_key long, n int")


def doc_keys(doc_id: str = "doc_id", doc_key: str = "doc_key") -> list[Column]:
    """What names a document: its doc_id, for null the largest number, and 64 bits of doc_id and text."""
    doc = F.col("doc_id").cast("long")
    return [F.coalesce(doc, F.lit(2**63 - 1)).alias(doc_id), F.xxhash64(doc, "text").alias(doc_key)]


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, places: the units of each document that repeat an earlier one. One row a document that has any.

    Units are grouped with a partial minimum, so a line of a third of all documents is a row a task. Those that make up
    more than 1 / ``HOT`` of all rows are fewer than ``HOT``, so they are broadcast back to their rows; the join of the
    rest is dealt by unit, and no unit there gathers more than that share in a task.
    """
    found = stored(unit_rows(docs.where("text is not null and text <> ''").select(*doc_keys(), F.col("text").cast("binary").alias("text"))), "units")
    unit, total = ["d1", "d2"], found.count()
    first = found.groupBy(*unit).agg(F.min(F.struct("doc_id", "doc_key", "n")).alias("first"), F.count("*").alias("times"))
    first = stored(first.where("times > 1"), "first-units")
    hot, rest = (first.where(c).drop("times") for c in (F.col("times") * HOT > total, F.col("times") * HOT <= total))
    near = found.join(F.broadcast(hot), unit)
    far = found.join(F.broadcast(hot.select(*unit)), unit, "left_anti").join(rest, unit)
    again = near.unionByName(far).where(F.struct("doc_id", "doc_key", "n") != F.col("first"))
    return again.groupBy("doc_id", "doc_key").agg(F.collect_set("n").alias("places"))


def spans(text: bytes, places: set[int], least_words: int) -> list[tuple[int, int]]:
    """The byte ranges to remove: runs of repeated units with enough words, by themselves or with the units beside."""
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    words = before = 0
    for k, (a, z, _, w) in enumerate([*units(text), (len(text), len(text), b"", 0)]):
        if k in places:
            run.append((a, z))
            words += w
            continue
        if run and (words >= least_words or before + words + w > PASSAGE):
            out.append((run[0][0], run[-1][1]))
        run, words, before = [], 0, w
    return out


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs' columns with the text that is left, and spans: the original byte ranges removed, as [start, end) pairs.

    Null and empty texts stay as they are, without spans. Rows equal in doc_id and text count as one document, and each
    copy of such a row gets its result. Documents with equal doc_id and different texts are ranked by a hash. Null
    doc_ids rank last, beside the largest number. Units are told apart by 128 bits. A text all of whose units repeat earlier ones becomes empty; its row stays.
    """
    from pyspark.sql.types import ArrayType, LongType, StructType

    number, key, held = (unused(docs, c) for c in ("doc_number", "doc_key", "places"))
    places = repeats(docs).select(F.col("doc_id").alias(number), F.col("doc_key").alias(key), F.col("places").alias(held))
    rows = docs.select("*", *doc_keys(number, key)).join(places, [number, key], "left").drop(number, key)
    fields = [f for f in docs.schema.fields if f.name != "spans"]
    schema = StructType([*fields]).add("spans", ArrayType(ArrayType(LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cut = [], []
            for t, p in zip(b.column("text"), b.column(held), strict=True):
                text, places = t.as_py(), p.as_py()
                gone: list[tuple[int, int]] = []
                if text and places:
                    data = text.encode()
                    gone = spans(data, set(places), least_words)
                    edges = [0, *(x for s in gone for x in s), len(data)]
                    text = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)).decode()
                texts.append(text)
                cut.append([list(s) for s in gone])
            cols = {f.name: b.column(f.name) for f in fields}
            cols["text"] = pa.array(texts, b.column("text").type)
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(cut, pa.list_(pa.list_(pa.int64())))], names=[*cols, "spans"])

    return map_batches(rows.drop("spans"), run, schema)
