"""Evidence of findings: excerpts of files, checks that they still hold, and what of it fits into a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_rules import redacted

#: Lines of an excerpt, lines around a place, and a file's hunk lines in a report (fixed values).
EXCERPT, CONTEXT, HUNK_LINES = 30, 2, 3000
PLACE = ["change_id", "side", "path"]


def lines_of(text: str) -> Column:
    """A text's lines; a last line end doesn't start another."""
    cut = F.split(text, "\n")
    return F.when(F.col(text).endswith("\n"), F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(1)))).otherwise(cut)


def excerpts(places: DataFrame, files: DataFrame, diff: DataFrame, context: int = CONTEXT, most: int = EXCERPT) -> DataFrame:
    """places (change_id, id, side, path, start_line, end_line) with excerpt and excerpt_start, null where nothing is visible.

    A known file gives the lines from ``context`` before to as many behind, ``most`` in all; a place behind its end gives
    none. Without the file the diff's visible lines stand in: the first run of neighbouring ones in that range.
    """
    end = F.coalesce("end_line", "start_line")
    lo = F.greatest(F.lit(1), F.col("start_line") - context)
    texts = files.where("text is not null").select(*PLACE, lines_of("text").alias("lines"))
    held = places.join(texts, PLACE, "left")
    hi = F.least(F.size("lines"), end + context, lo + most - 1)
    seen = (F.size("lines") > 0) & (F.col("start_line") <= F.size("lines"))
    whole = held.where("lines is not null").select(*places.columns, F.when(seen, F.array_join(F.slice("lines", lo, F.greatest(hi - lo + 1, F.lit(0))), "\n")).alias("excerpt"), F.when(seen, lo).alias("excerpt_start"))
    shown = diff.where("kind <> 'del' and new_line is not null").select("change_id", F.lit("head").alias("side"), "path", F.col("new_line").alias("n"), "content")
    shown = shown.unionByName(diff.where("kind <> 'add' and old_line is not null").select("change_id", F.lit("base").alias("side"), "path", F.col("old_line").alias("n"), "content"))
    rest = held.where("lines is null").drop("lines").join(shown.distinct(), PLACE, "left").withColumn("in_range", F.col("n").between(lo, end + context))
    visible = rest.groupBy(*places.columns).agg(F.array_sort(F.collect_list(F.when(F.col("in_range"), F.struct("n", "content")))).alias("v"))
    # the first run: numbers less their places are equal
    run = F.slice(F.filter("v", lambda x, i: x["n"] - i == F.col("v")[0]["n"]), 1, most)
    some = F.size("v") > 0
    parts = visible.select(*places.columns, F.when(some, F.array_join(F.transform(run, lambda x: x["content"]), "\n")).alias("excerpt"), F.when(some, F.col("v")[0]["n"]).alias("excerpt_start"))
    return whole.unionByName(parts)


def rechecked(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """evidence with ``holds``: its lines exist in its file, and its excerpt is what stands there, secrets aside.

    evidence: change_id, id, side, path, start_line, end_line, excerpt, excerpt_start. Evidence without a file or line
    makes no claim and holds; a file that isn't there doesn't.
    """
    texts = files.where("text is not null").select(*PLACE, lines_of("text").alias("lines"))
    held = evidence.join(texts, PLACE, "left")
    end, n = F.coalesce("end_line", "start_line"), F.size("lines")
    inside = F.col("start_line").between(1, n) & end.between(1, n)
    rows = F.split("excerpt", "\n")
    start = F.coalesce("excerpt_start", "start_line")
    there = F.transform(F.slice("lines", F.greatest(start, F.lit(1)), F.size(rows)), redacted)
    holds = F.when(F.col("path").isNull() | F.col("start_line").isNull(), True).when(F.col("lines").isNull(), False).when(~inside, False).when(F.col("excerpt").isNull(), True).otherwise((start >= 1) & (there == rows))
    return held.select(*evidence.columns, holds.alias("holds"))


def valid_ranges(places: DataFrame, files: DataFrame) -> DataFrame:
    """Places whose lines exist in their revision; those of files that aren't known stay."""
    size = files.select(*PLACE, F.size(lines_of("text")).alias("n_lines"))
    return places.join(size, PLACE, "left").where("n_lines is null or start_line is null or (start_line between 1 and n_lines and coalesce(end_line, start_line) between start_line and n_lines)").drop("n_lines")


def within_budget(blocks: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """blocks with ``included``: in order, each that still fits is taken; one that doesn't is skipped and takes nothing.

    A running sum can't say that, so a key's sizes are folded in one ordered array of bounded structs.
    """
    taken = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))), F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(f"array<{dict(blocks.dtypes)[order]}>").alias("kept")),
        lambda acc, b: F.when(b["s"] <= acc["left"], F.struct((acc["left"] - b["s"]).alias("left"), F.concat(acc["kept"], F.array(b["o"])).alias("kept"))).otherwise(acc),
    )["kept"]
    kept = blocks.groupBy(key).agg(taken.alias("kept"))
    return blocks.join(kept, key).withColumn("included", F.array_contains("kept", F.col(order))).drop("kept")


def clipped_hunks(diff: DataFrame, most: int = HUNK_LINES) -> DataFrame:
    """The first ``most`` diff lines of each file, in order of hunk and line: a running count cuts a prefix."""
    nth = F.row_number().over(Window.partitionBy("change_id", "path").orderBy("hunk", "i"))
    return diff.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
