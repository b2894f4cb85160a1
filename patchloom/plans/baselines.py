"""Systems that an evaluation compares: each turns changes into predictions (system, case_id, pred_id, category, file,
start_line, end_line, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.manifests import kind
from . import evaluation

#: Words of risky lines in order, with the category that the first hit gives (fixed categories).
KEYWORDS = (
    (r"\b(eval|exec)\s*\(|\bnew\s+Function\b|\b(inner|outer)HTML\b|dangerouslySetInnerHTML|document\.write", "security"), (r"\bshell\s*=\s*True\b|\bos\.system\b|\bchild_process\b|\bexecSync\b|\b(pickle|yaml|marshal)\.loads?\b|\bverify\s*=\s*False\b", "security"),
    (r"\.execute\s*\(\s*(f['\"]|.*%)", "security"), (r"(?i)\b\w*(password|secret|api_?key|token)\w*\s*[:=]\s*['\"]", "secret_exposure"), (r"(?i)\b(drop|truncate)\s+(table|column)\b|\bdrop_(table|column)\b|\bdelete\s+from\b", "data_migration"),
    (r"\bexcept(\s+Exception)?\s*:|\bcatch\s*(\(\w*\))?\s*\{\s*\}", "error_handling"), (r"\btime\.sleep\b|\brequests\.(get|post)\b|\bforEach\s*\(\s*async\b", "concurrency"), (r"\.(only|skip)\s*\(|\bpytest\.mark\.skip|\bxit\s*\(", "test_integrity"), (r"[<>]=?|[!=]=", "logic_change"),
)


def predictions(rows: DataFrame, system: str, category: Column, mark: str, lo: Column, hi: Column, file: str = "path") -> DataFrame:
    return rows.select(F.lit(system).alias("system"), F.col("change_id").alias("case_id"), F.concat(F.lit(mark), F.sha1(F.concat_ws("|", file, lo.cast("string"), category).cast("binary")).substr(1, 10)).alias("pred_id"), category.alias("category"), F.col(file).alias("file"), lo.cast("int").alias("start_line"), hi.cast("int").alias("end_line"), F.lit("medium").alias("severity")).distinct()


def keywords(diff: DataFrame) -> DataFrame:
    """One prediction an added line with a risky word, the first of the list; every added line of a manifest is a dependency."""
    added = diff.where("kind = 'add' and content is not null and new_line is not null")
    hit = F.coalesce(F.when(kind(F.col("path")).isNotNull(), F.lit("dependency")), *[F.when(F.col("content").rlike(p), F.lit(c)) for p, c in KEYWORDS])
    return predictions(added.withColumn("hit", hit).where("hit is not null"), "baseline-keyword", F.col("hit"), "K-", F.col("new_line"), F.col("new_line"))


def changed_symbols(changes: DataFrame) -> DataFrame:
    """One prediction a changed function or method that stays: a breaking change if its parameters differ, else a test gap."""
    kept = changes.where("new.params is not null and new.kind in ('function', 'method')")
    breaking = F.col("old").isNotNull() & (F.to_json("old.params") != F.to_json("new.params"))
    return predictions(kept, "baseline-changed-symbols", F.when(breaking, "breaking_change").otherwise("test_gap"), "S-", F.col("new.start_line"), F.col("new.end_line"))


def of_findings(findings: DataFrame, system: str) -> DataFrame:
    """A system's findings as predictions."""
    return findings.select(F.lit(system).alias("system"), F.col("change_id").alias("case_id"), F.col("id").alias("pred_id"), "category", "file", F.col("start_line").cast("int").alias("start_line"), F.coalesce("end_line", "start_line").cast("int").alias("end_line"), "severity")


def compared(found: DataFrame, labels: DataFrame, cases: DataFrame) -> DataFrame:
    """system, tp, fp, fn, precision, recall, f1, wrong_negatives of every system over the same cases.

    A system's cases are told apart by its name, so that all systems are matched in one pass.
    """
    named = lambda rows: rows.withColumn("case_id", F.concat_ws("\t", "system", "case_id"))
    # the systems of an evaluation are a handful of names
    systems = F.array(*[F.lit(r.system) for r in found.select("system").distinct().orderBy("system").collect()]).cast("array<string>")
    each_label, each_case = (named(rows.withColumn("system", F.explode(systems))) for rows in (labels, cases))
    results = evaluation.outcomes(named(found).drop("system"), each_label.drop("system"))
    scores = evaluation.scores(results, each_case, ("system",)).where("grouping = 'system'").withColumnRenamed("value", "system").drop("grouping")
    wrong = results.where("outcome = 'fp'").select("case_id").distinct().join(each_case.where("negative").select("case_id", "system"), "case_id").groupBy("system").agg(F.count("*").alias("wrong_negatives"))
    return scores.join(wrong, "system", "left").withColumn("wrong_negatives", F.coalesce("wrong_negatives", F.lit(0).cast("long")))
