"""Changed lines that no test runs: reports matched to files by their longest shared path suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finding_id, shared_suffix
from ..operators.relational import innermost
from ..sources.tables import dealt


def matched_paths(files: DataFrame, reported: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """change_id, path, cov_path: the one report path that shares most parts of a file's path from the right.

    One shared part is enough where the base name is unique on both sides, else two (or all the path has); a tie
    matches nothing. Joined on the base name, so a report's size doesn't multiply a change's.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    n = lambda c: F.size(F.split(c, "/"))
    spread = lambda rows, *keys: rows if n_tasks is None else dealt(rows, *keys, n=n_tasks)
    left = spread(files.select("change_id", "path").withColumn("b", base("path")), "change_id", "b").distinct().withColumn("left_n", F.count("*").over(Window.partitionBy("change_id", "b")))
    right = spread(reported.select("change_id", "cov_path").withColumn("b", base("cov_path")), "change_id", "b").distinct().withColumn("right_n", F.count("*").over(Window.partitionBy("change_id", "b")))
    scored = left.join(right, ["change_id", "b"]).withColumn("score", shared_suffix(F.col("path"), F.col("cov_path")))
    least = F.when((F.col("left_n") == 1) & (F.col("right_n") == 1), 1).otherwise(F.least(F.lit(2), n("path"), n("cov_path")))
    # a path has one base name, so that its rows already lie together
    best = F.max("score").over(Window.partitionBy("change_id", "b", "path"))
    top = scored.where(F.col("score") >= least).withColumn("best", best).where("score = best")
    return top.groupBy("change_id", "b", "path").agg(F.first("cov_path").alias("cov_path"), F.count("*").alias("n")).where("n = 1").drop("n", "b")


def changed_coverage(diff: DataFrame, coverage: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """change_id, path, line, hits of added lines that a report knows (the most, where it repeats a line); coverage has change_id, path, line, hits.

    n_tasks is the number of tasks that lines are dealt over; without one Spark's own counts hold, whose tasks grow with the lines.
    """
    added = diff.where("kind = 'add'").select("change_id", "path", F.col("new_line").alias("line"))
    report = coverage.select("change_id", F.col("path").alias("cov_path"), "line", "hits")
    matched = matched_paths(added, report, n_tasks)
    if n_tasks is not None:
        added, report = dealt(added, "change_id", "path", n=n_tasks), dealt(report, "change_id", "cov_path", "line", n=n_tasks)
        matched = dealt(matched, "change_id", "path", n=n_tasks).hint("merge")
    report = report.groupBy("change_id", "cov_path", "line").agg(F.max("hits").alias("hits"))
    found = added.distinct().join(matched, ["change_id", "path"])
    if n_tasks is not None:
        found = dealt(found, "change_id", "cov_path", "line", n=n_tasks).hint("merge")
    return found.join(report, ["change_id", "cov_path", "line"]).select("change_id", "path", "line", "hits")


#: Share of a report's lines that may lie where no code is before it counts as stale (fixed value).
STALE = 0.10


def stale(files: DataFrame, coverage: DataFrame, most: float = STALE) -> DataFrame:
    """change_id, path, share of files (change_id, path, text) whose report speaks of other lines than the file has: more than
    ``most`` of them lie behind its end, or are blank or comments."""
    report = coverage.select("change_id", F.col("path").alias("cov_path"), "line").distinct()
    at = matched_paths(files, report).join(report, ["change_id", "cov_path"]).select("change_id", "path", "line")
    lines = files.where("text is not null").select("change_id", "path", F.split("text", "\n").alias("lines"))
    text = F.trim(F.try_element_at("lines", F.col("line")))
    off = text.isNull() | (text == "") | text.startswith("#") | text.startswith("//")
    counted = at.where("line >= 1").join(lines, ["change_id", "path"]).groupBy("change_id", "path").agg(F.avg(off.cast("double")).alias("share"))
    return counted.where(F.col("share") > most)


def unmatched(files: DataFrame, coverage: DataFrame) -> DataFrame:
    """change_id, cov_path of reported files that stand for none of the change's."""
    report = coverage.select("change_id", F.col("path").alias("cov_path")).distinct()
    return report.join(matched_paths(files, report).select("change_id", "cov_path"), ["change_id", "cov_path"], "left_anti")


def patch_coverage(diff: DataFrame, coverage: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """change_id, covered, executable, percent (one digit; no row where nothing is executable)."""
    known = changed_coverage(diff, coverage, n_tasks)
    out = (known if n_tasks is None else dealt(known, "change_id", n=n_tasks)).groupBy("change_id").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count("*").alias("executable"))
    return out.withColumn("percent", F.round(F.col("covered") * 100.0 / F.col("executable"), 1))


def ranges(lines: str) -> Column:
    """Sorted, distinct integers of a column as text: 1–3, 7."""
    step = F.aggregate(
        F.col(lines), F.array().cast("array<struct<a: int, z: int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["z"] == x - 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), x.alias("z"))))).otherwise(F.concat(acc, F.array(F.struct(x.alias("a"), x.alias("z"))))),
    )
    return F.array_join(F.transform(step, lambda r: F.when(r["a"] == r["z"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("–"), r["z"].cast("string")))), ", ")


def coverage_findings(diff: DataFrame, coverage: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """CG-COV-001 and 002: change_id, id, rule_id, severity, file, start_line, symbol, detail.

    A file none of whose changed lines ever ran gives one finding; others one a function (symbols: change_id, path,
    qualname, ord, start_line, end_line) and one for lines outside of any. A changed code file that the change's report
    lacks gives CG-COV-002.
    """
    known = changed_coverage(diff, coverage)
    # a window over what is known, so that the joins before it run once
    missed = known.withColumn("never", F.bool_and(F.col("hits") == 0).over(Window.partitionBy("change_id", "path"))).where("hits = 0")
    if symbols is not None:
        held = innermost(missed.where("not never"), symbols.where("kind in ('function', 'method', 'test')").select("change_id", "path", "qualname", "ord", "start_line", "end_line"), ["change_id", "path"], "line", "start_line", "end_line", ["change_id", "path", "line"], ["ord"])
        named = held.select("change_id", "path", "line", "qualname")
        missed = missed.join(named, ["change_id", "path", "line"], "left")
    else:
        missed = missed.withColumn("qualname", F.lit(None).cast("string"))
    grouped = missed.groupBy("change_id", "path", F.when(F.col("never"), F.lit(None)).otherwise(F.col("qualname")).alias("symbol")).agg(F.sort_array(F.collect_set("line")).alias("lines"))
    gaps = grouped.select("change_id", F.lit("CG-COV-001").alias("rule_id"), F.when(F.size("lines") >= 3, "medium").otherwise("low").alias("severity"), F.col("path").alias("file"), F.col("lines")[0].alias("start_line"), "symbol", F.concat(F.lit("not run: "), ranges("lines")).alias("detail"))
    files = diff.where("kind = 'add'").where(F.lower("path").rlike(r"\.(py|[cm]?[jt]sx?)$")).select("change_id", "path").distinct()
    report = coverage.withColumnRenamed("path", "cov_path")
    absent = files.join(report.select("change_id").distinct(), "change_id", "left_semi").join(matched_paths(files, report), ["change_id", "path"], "left_anti")
    none = lambda t: F.lit(None).cast(t)
    lost = absent.select("change_id", F.lit("CG-COV-002").alias("rule_id"), F.lit("low").alias("severity"), F.col("path").alias("file"), none("int").alias("start_line"), none("string").alias("symbol"), F.lit("not in the report").alias("detail"))
    both = gaps.unionByName(lost)
    return both.select("change_id", finding_id(F.col("rule_id"), F.col("file"), F.col("start_line"), F.coalesce("symbol", F.lit("file"))).alias("id"), *both.columns[1:])
