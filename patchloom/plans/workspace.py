"""The two revisions of a change: where a snapshot's root lies, and the whole head that follows from base and patch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.patch_apply import head_files


def aligned(files: DataFrame, diff: DataFrame) -> DataFrame:
    """Snapshot files (change_id, side, path, text) without the folder that holds them all, where that lets more of the
    patch's old paths match.

    A side has a root if all its files lie in one folder. Old paths of added files don't vote; without a vote, and on a
    tie, paths stay as they are.
    """
    # every side grows with the changes; a plan by the sizes of compressed files would send them to the driver
    files, diff = files.hint("merge"), diff.hint("merge")
    first = F.split("path", "/")[0]
    rooted = files.groupBy("change_id", "side").agg(F.min(first).alias("root"), (F.count_distinct(first) == 1).alias("one"), F.min(F.size(F.split("path", "/"))).alias("depth")).where("one and depth > 1").select("change_id", "side", "root")
    old = diff.where("status <> 'added' and old_path is not null").select("change_id", "old_path").distinct()
    held = files.join(rooted, ["change_id", "side"]).select("change_id", "side", "path", F.expr("substring(path, length(root) + 2)").alias("bare")).hint("merge")
    direct = held.join(old.withColumnRenamed("old_path", "path"), ["change_id", "path"]).groupBy("change_id", "side").agg(F.count("*").alias("direct"))
    stripped = held.join(old.withColumnRenamed("old_path", "bare"), ["change_id", "bare"]).groupBy("change_id", "side").agg(F.count("*").alias("stripped"))
    votes = rooted.join(stripped.hint("merge"), ["change_id", "side"]).join(direct.hint("merge"), ["change_id", "side"], "left").where("stripped > coalesce(direct, 0)").select("change_id", "side", "root")
    out = files.join(votes.hint("merge"), ["change_id", "side"], "left")
    return out.select("change_id", "side", F.when(F.col("root").isNotNull(), F.expr("substring(path, length(root) + 2)")).otherwise(F.col("path")).alias("path"), "text")


def whole_head(base: DataFrame, diff: DataFrame) -> DataFrame:
    """The head's files (change_id, path, text): patched ones, and those of the base that the patch doesn't touch.

    Old paths of deleted and renamed files go; a copy leaves its source. A file whose hunks don't fit has no row.
    """
    base, diff = base.hint("merge"), diff.hint("merge")
    touched = diff.where("path is not null").select("change_id", "path", "old_path", "status").distinct()
    gone = touched.select("change_id", "path").unionByName(touched.where("status in ('deleted', 'renamed')").select("change_id", F.col("old_path").alias("path"))).distinct()
    untouched = base.join(gone.hint("merge"), ["change_id", "path"], "left_anti").select("change_id", "path", "text")
    return untouched.unionByName(head_files(base, diff).where("text is not null").select("change_id", "path", "text"))
