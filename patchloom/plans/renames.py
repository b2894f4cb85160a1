"""Renamed symbols: removed and added ones of a file whose bodies are alike, paired one to one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least similarity of a renamed symbol's bodies (fixed value).
LEAST = 0.78
KEY = ["change_id", "path"]


def matched(a: str, b: str) -> int:
    """Characters in the longest block that both texts have (the first in a, then in b), and in those left and right of it."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        size, at = 0, lo
        for i in range(lo, hi):
            # a text's own search finds whether a longer block begins here
            while i + size < hi and b.find(a[i : i + size + 1], low, high) >= 0:
                size, at = size + 1, i
            if hi - i - 1 <= size:
                break
        if size:
            there = b.find(a[at : at + size], low, high)
            total += size
            todo += [(lo, at, low, there), (at + size, hi, there + size, high)]
    return total


def similarity(a: str | None, b: str | None, least: float = LEAST) -> float:
    """Ratcliff and Obershelp's ratio, or 0 where its cheaper bounds are already below ``least``."""
    if not a or not b:
        return 0.0
    length = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / length < least or 2.0 * (Counter(a) & Counter(b)).total() / length < least:
        return 0.0
    return 2.0 * matched(a, b) / length


def candidates(changes: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of a removed and an added symbol of one file, kind and parent, with their similarity of ``least`` or more.

    Bodies meet only if their lengths allow the ratio: 2 min / (a + b) is its upper bound. Length bands make that part of
    the join's key, so that a file of many symbols isn't paired with itself.
    """
    band = F.log(F.length("body").cast("double")) / F.log(F.lit((2 - least) / least))
    side = lambda which, s: changes.where(F.col("change") == which).select(*KEY, F.col(f"{s}.kind").alias("kind"), F.coalesce(f"{s}.parent", F.lit("")).alias("parent"), F.col(f"{s}.qualname").alias(f"{which}_name"), F.col(f"{s}.ord").alias(f"{which}_ord"), F.col(f"{s}.body").alias("body")).where("length(body) > 0").withColumn("band", F.floor(band))
    changes = changes.hint("merge")
    removed, added = side("removed", "old"), side("added", "new").withColumnRenamed("body", "to")
    # a length within the bound lies in the same band or the next one
    removed = removed.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    pairs = removed.join(added, [*KEY, "kind", "parent", "band"]).where(2 * F.least(F.length("body"), F.length("to")) >= least * (F.length("body") + F.length("to")))

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["ratio"] = [similarity(x, y, least) for x, y in zip(b["body"], b["to"], strict=True)]
            yield b.loc[b["ratio"] >= least, [*KEY, "removed_name", "removed_ord", "added_name", "added_ord", "ratio"]]

    return pairs.mapInPandas(rated, "change_id string, path string, removed_name string, removed_ord int, added_name string, added_ord int, ratio double")


def renames(changes: DataFrame, least: float = LEAST) -> DataFrame:
    """change_id, path, old_name, new_name, ratio: every removed symbol in order takes the free added one most like it.

    Equal ratios go to the earlier added symbol. A file's pairs, few after the ratio, are folded as one sorted array.
    """

    pair = F.struct(F.col("removed_ord").alias("r"), (-F.col("ratio")).alias("unlike"), F.col("added_ord").alias("a"), "removed_name", "added_name")
    taken = F.aggregate(
        F.array_sort(F.collect_list(pair)), F.array().cast("array<struct<r: int, unlike: double, a: int, removed_name: string, added_name: string>>"),
        lambda done, x: F.when(F.exists(done, lambda d: (d["r"] == x["r"]) | (d["a"] == x["a"])), done).otherwise(F.concat(done, F.array(x))),
    )
    chosen = candidates(changes, least).groupBy(*KEY).agg(taken.alias("taken")).select(*KEY, F.explode("taken").alias("t"))
    return chosen.select(*KEY, F.col("t.removed_name").alias("old_name"), F.col("t.added_name").alias("new_name"), (-F.col("t.unlike")).alias("ratio"))


def with_renames(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The changes with each pair as one row under the new name: change ``renamed``, its old and new symbol."""
    keep = [*KEY, "qualname", "change", "old", "new"]
    old = changes.where("change = 'removed'").join(pairs.select(*KEY, F.col("old_name").alias("qualname"), "new_name"), [*KEY, "qualname"], "left")
    new = changes.where("change = 'added'").join(pairs.select(*KEY, F.col("new_name").alias("qualname"), "old_name"), [*KEY, "qualname"], "left")
    both = old.where("new_name is not null").select(*KEY, F.col("new_name").alias("qualname"), "old").join(new.where("old_name is not null").select(*KEY, "qualname", "new"), [*KEY, "qualname"]).withColumn("change", F.lit("renamed"))
    return changes.where("change = 'modified'").select(keep).unionByName(old.where("new_name is null").select(keep)).unionByName(new.where("old_name is null").select(keep)).unionByName(both.select(keep))
