"""Greedy dedup of findings and maximum matching of predictions to labels: folds over the rows of one file or case."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows handed on at once (fixed value).
BATCH = 10_000


class Spans:
    """The kept findings of one group, and which of them a span overlaps first.

    No two kept spans overlap, so sorted by start they are also sorted by end, and those that a span overlaps are neighbours.
    A span that ends before it starts overlaps what holds both its ends; such ones are looked through one by one.
    """

    def __init__(self):
        self.los: list[int] = []
        self.his: list[int] = []
        self.nth: list[int] = []
        self.turned: list[tuple[int, int, int]] = []
        self.ids: list[str | None] = []

    def place(self, name: str | None, lo: int | None, hi: int | None) -> str | None:
        """The id of the first kept finding that lo to hi overlaps; without one the finding is kept itself."""
        if lo is None or hi is None:  # overlaps nothing, and nothing overlaps it
            return name
        a, z = bisect_left(self.his, lo), bisect_right(self.los, hi)
        first = min(self.nth[a:z], default=None)
        for k, start, end in self.turned:
            if lo <= end and start <= hi and (first is None or k < first):
                first = k
        if first is not None:
            return self.ids[first]
        if lo > hi:
            self.turned.append((len(self.ids), lo, hi))
        else:
            at = bisect_left(self.los, lo)
            self.los.insert(at, lo)
            self.his.insert(at, hi)
            self.nth.insert(at, len(self.ids))
        self.ids.append(name)
        return name


def greedy_dedup(findings: DataFrame) -> DataFrame:
    """In order (ord, id, then lo, hi; nulls last), a finding joins the first kept one of its (change, category, file, side) that its own lines overlap.

    Not transitive: only the kept finding's original span counts. Columns: change_id, category, file, side, ord, id,
    lo, hi. Adds kept_id. A null lo or hi overlaps nothing. Rows pass once, sorted by group and order; of a group only
    the kept findings are held.
    """
    keys, rest = ["change_id", "category", "file", "side"], ["ord", "id", "lo", "hi"]
    schema = "change_id string, category string, file string, side string, ord long, id string, lo long, hi long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, Spans()
        for b in batches:
            out = []
            for *key, name, lo, hi in zip(*(b.column(c).to_pylist() for c in [*keys, "id", "lo", "hi"]), strict=True):
                if key != last:
                    last, kept = key, Spans()
                out.append(kept.place(name, lo, hi))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "kept_id"])

    rows = findings.select([F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")])
    # a partition holds whole groups, one after another
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *(F.asc_nulls_last(c) for c in rest))
    return dealt.mapInArrow(fold, f"{schema}, kept_id string")


def matched(fits: dict[str, list[str]]) -> dict[str, str]:
    """label to prediction of a maximum one-to-one assignment; fits has a prediction's labels in order.

    Predictions in order look breadth first for a free label along labels that others hold; the way to it is then turned
    round. A queue stands for recursion, so that chains may be of any length.
    """
    owner: dict[str, str] = {}
    mine: dict[str, str] = {}
    for p in sorted(fits):
        came: dict[str, str] = {}
        todo, free = deque([p]), None
        while todo and free is None:
            q = todo.popleft()
            for label in fits[q]:
                if label not in came:
                    came[label] = q
                    if label not in owner:
                        free = label
                        break
                    todo.append(owner[label])
        while free is not None:
            q = came[free]
            owner[free], before = q, mine.get(q)
            mine[q], free = free, before
    return owner


def maximum_matching(candidates: DataFrame) -> DataFrame:
    """case_id, pred_id, label_id pairs that fit to a maximum one-to-one assignment within each case; a case is one group."""

    names = ["case_id", "pred_id", "label_id"]

    def in_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
        case, pairs = None, []
        for b in batches:
            for c, p, label in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if pairs and c != case:
                    yield case, pairs
                    pairs = []
                case = c
                pairs.append((p, label))
        if pairs:
            yield case, pairs

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for case, pairs in in_cases(batches):
            fits: dict[str, list[str]] = {}
            for p, label in sorted(pairs):
                fits.setdefault(p, []).append(label)
            out += [(case, p, label) for label, p in sorted(matched(fits).items())]
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=names)

    # a pair that has no other choice on either side is matched as it is; only the rest is put together by case
    pairs = candidates.select("case_id", "pred_id", "label_id").distinct()
    choices = lambda key: F.count("*").over(Window.partitionBy("case_id", key))
    counted = pairs.withColumn("of_pred", choices("pred_id")).withColumn("of_label", choices("label_id"))
    alone = (F.col("of_pred") == 1) & (F.col("of_label") == 1)
    # a partition holds whole cases, one after another; a call a case would take far longer than the matching
    rest = counted.where(~alone).select(pairs.columns).repartition("case_id").sortWithinPartitions("case_id").mapInArrow(assign, "case_id string, pred_id string, label_id string")
    return counted.where(alone).select(pairs.columns).unionByName(rest)
