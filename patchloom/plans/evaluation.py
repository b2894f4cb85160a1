"""Predictions against labels: one-to-one matching, precision and recall by every grouping, and a gate between two runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..operators.matching import maximum_matching
from ..operators.relational import overlapping

#: Lines by which a prediction may miss a label, and the drops that a gate lets pass (fixed values).
SLACK, METRIC_DROP, NEGATIVE_RISE = 3, 0.02, 0.05


def outcomes(predictions: DataFrame, labels: DataFrame, acceptable: DataFrame | None = None) -> DataFrame:
    """case_id, category, outcome (tp, fp, fn), pred_id, label_id. Acceptable predictions that match nothing aren't wrong."""
    fits = overlapping(predictions.alias("p"), labels.select("case_id", "label_id", "category", "file", "line_lo", "line_hi"), ["case_id", "category", "file"], ("start_line", "end_line"), ("line_lo", "line_hi"), SLACK)
    pairs = maximum_matching(fits.select("case_id", F.col("pred_id").cast("string"), F.col("label_id").cast("string")))
    none = F.lit(None).cast("string")
    hit = pairs.join(labels.select("case_id", "label_id", "category"), ["case_id", "label_id"]).select("case_id", "category", F.lit("tp").alias("outcome"), "pred_id", "label_id")
    wrong = predictions.join(pairs, ["case_id", "pred_id"], "left_anti")
    if acceptable is not None:
        a = acceptable.select("case_id", "category", F.col("file").alias("a_file"), "line_lo", "line_hi")
        ok = wrong.join(a, ["case_id", "category"]).where("(a_file is null or a_file = file) and (line_lo is null or (start_line <= line_hi + 3 and line_lo - 3 <= coalesce(end_line, start_line)))")
        wrong = wrong.join(ok.select("case_id", "pred_id").distinct(), ["case_id", "pred_id"], "left_anti")
    lost = labels.join(pairs, ["case_id", "label_id"], "left_anti")
    return hit.unionByName(wrong.select("case_id", "category", F.lit("fp").alias("outcome"), "pred_id", none.alias("label_id"))).unionByName(lost.select("case_id", "category", F.lit("fn").alias("outcome"), none.alias("pred_id"), "label_id"))


def scores(results: DataFrame, cases: DataFrame, by: tuple[str, ...] = ("split", "difficulty", "language", "category")) -> DataFrame:
    """grouping, value, tp, fp, fn, precision, recall, f1 of every grouping and of all: one pass by grouping sets."""
    flat = results.join(cases.drop("category"), "case_id").select(F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("value")) for c in by])).alias("g"), "outcome")
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]
    out = flat.groupBy("g.grouping", "g.value").agg(*n)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(p + r == 0, 0.0).otherwise(F.round(F.try_divide(2 * p * r, p + r), 4))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def negatives(results: DataFrame, cases: DataFrame) -> DataFrame:
    """n, flagged, rate of cases without labels that got a wrong finding."""
    wrong = results.where("outcome = 'fp'").select("case_id").distinct().withColumn("w", F.lit(1))
    return cases.where("negative").join(wrong, "case_id", "left").agg(F.count("*").alias("n"), F.count("w").alias("flagged")).withColumn("rate", ratio(F.col("flagged"), F.col("n")))


def regressions(now: DataFrame, before: DataFrame, cases: DataFrame) -> DataFrame:
    """check, detail, fails of one run against an earlier: lost labels and metrics beyond their drop fail, new wrong findings warn."""
    keys = ["case_id", "label_id"]
    lost = before.where("outcome = 'tp'").join(now.where("outcome = 'tp'"), keys, "left_anti").select(F.lit("lost_label").alias("check"), F.concat_ws("/", "case_id", "label_id").alias("detail"), F.lit(True).alias("fails"))
    new = now.where("outcome = 'fp'").join(before.where("outcome = 'fp'"), ["case_id", "pred_id"], "left_anti").select(F.lit("new_wrong").alias("check"), F.concat_ws("/", "case_id", "pred_id").alias("detail"), F.lit(False).alias("fails"))
    a, b = (scores(x, cases, ()).select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in ("precision", "recall", "f1")])).alias("x")).select("x.*") for x in (now, before))
    drop = a.join(b.withColumnRenamed("v", "was"), "m").where(F.col("was") - F.col("v") > METRIC_DROP).select(F.concat(F.col("m"), F.lit("_drop")).alias("check"), F.format_string("%.4f to %.4f", "was", "v").alias("detail"), F.lit(True).alias("fails"))
    both = negatives(now, cases).withColumn("run", F.lit(1)).unionByName(negatives(before, cases).withColumn("run", F.lit(0)))
    rate = both.agg(F.max(F.when(F.col("run") == 1, F.col("rate"))).alias("rate"), F.max(F.when(F.col("run") == 0, F.col("rate"))).alias("was"))
    rise = rate.where(F.col("rate") - F.col("was") > NEGATIVE_RISE).select(F.lit("negative_rise").alias("check"), F.format_string("%.4f to %.4f", "was", "rate").alias("detail"), F.lit(True).alias("fails"))
    return lost.unionByName(new).unionByName(drop).unionByName(rise)


#: Resamples of a bootstrap, and the modulus of its draws: a prime below 2^31, so that squares fit 63 bits (fixed values).
RESAMPLES, PRIME = 2000, 2147483647
#: Chances of at most 0, 1, … draws of a case in a resample, by Poisson's law of mean 1, as shares of the modulus.
POISSON = [int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(10)]


def draws(cases: np.ndarray, resamples: np.ndarray) -> np.ndarray:
    """How often each resample (columns) draws each case (rows): a keyed hash of both, mixed by squares modulo a prime and read
    as a Poisson number."""
    c, b = cases.astype("i8")[:, None], resamples.astype("i8")[None]
    x = (c % PRIME * 48271 + b * 69621 + 1) % PRIME
    for turn in (16807, 39373, 69069):
        x = (x * x + (c % 65536 + 1) * turn + b * (turn + 2)) % PRIME
    return np.searchsorted(np.array(POISSON), x, side="left")


def bootstrap(counts: DataFrame, case: str, resamples: int = RESAMPLES) -> DataFrame:
    """metric, lo, hi of precision, recall and f1: the 2.5 and 97.5 % ranks over resamples of cases with replacement.

    counts: a case's integer key, tp, fp, fn. Each resample draws every case a Poisson number of times, so rows need no
    numbers and meet only in sums: a task hands on one row a resample. Resamples in which a metric
    isn't defined don't count for it.
    """
    schema = pa.schema([("b", pa.int32()), ("tp", pa.int64()), ("fp", pa.int64()), ("fn", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sums = np.arange(resamples), np.zeros((3, resamples), dtype="i8")
        for part in batches:
            for at in range(0, part.num_rows, 500):
                rows = part.slice(at, 500)
                drawn = draws(rows.column("c").to_numpy(zero_copy_only=False), numbers)
                sums += np.stack([rows.column(k).to_numpy(zero_copy_only=False).astype("i8") @ drawn for k in ("tp", "fp", "fn")])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *map(pa.array, sums)], schema=schema)

    known = counts.where(F.col(case).isNotNull()).select(F.col(case).cast("long").alias("c"), *[F.coalesce(F.col(k).cast("long"), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])
    total = known.repartition("c").mapInArrow(run, "b int, tp long, fp long, fn long").groupBy("b").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    metrics = {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}
    rows = total.select("b", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in metrics.items()])).alias("m")).select("b", "m.*").where("v is not null")
    # one row a resample: a bounded window
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy("v", "b")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("metric")))
    at = lambda q: F.round(F.min(F.when(F.col("r") == F.rint(F.lit(q) * (F.col("n") - 1)).cast("long"), F.col("v"))), 4)
    return ranked.groupBy("metric").agg(at(0.025).alias("lo"), at(0.975).alias("hi"))


#: Severities from the gravest (fixed order).
GRADES = ("critical", "high", "medium", "low", "info")


def severity_agreement(results: DataFrame, predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """n, exact, within_one of matched findings whose label has a severity: shares of equal grades, and of grades one apart at most."""
    grade = lambda c: F.array_position(F.array(*map(F.lit, GRADES)), c)
    both = results.where("outcome = 'tp'").join(predictions.select("case_id", "pred_id", F.col("severity").alias("p")), ["case_id", "pred_id"]).join(labels.select("case_id", "label_id", F.col("severity").alias("l")), ["case_id", "label_id"]).where("l is not null")
    gap = F.abs(grade(F.col("p")) - grade(F.col("l")))
    return both.agg(F.count("*").alias("n"), F.round(F.avg((gap == 0).cast("double")), 4).alias("exact"), F.round(F.avg((gap <= 1).cast("double")), 4).alias("within_one"))


def rejections(claims: DataFrame) -> DataFrame:
    """reason, n of rejected claims."""
    return claims.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def missed_by(results: DataFrame, primary: str) -> DataFrame:
    """case_id, label_id, found_by of labels that the primary system misses: the other systems that find them, in order.

    results has system besides the columns of ``outcomes``.
    """
    missed = results.where((F.col("system") == primary) & (F.col("outcome") == "fn")).select("case_id", "label_id").distinct()
    others = results.where((F.col("system") != primary) & (F.col("outcome") == "tp")).groupBy("case_id", "label_id").agg(F.array_sort(F.collect_set("system")).alias("found_by"))
    return missed.join(others, ["case_id", "label_id"], "left").withColumn("found_by", F.coalesce("found_by", F.array().cast("array<string>")))
