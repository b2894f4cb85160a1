"""Joins, differences, islands and dedup that SQL has no word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_in_head(base: DataFrame, head: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of head beyond as many equal rows of base; the first equal ones are cancelled, so the later survive."""
    known = base.groupBy(*keys).agg(F.count("*").alias("_known"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return head.withColumn("_nth", nth).join(known, keys, "left").where(F.col("_nth") > F.coalesce("_known", F.lit(0))).drop("_nth", "_known")


def islands(rows: DataFrame, keys: list[str], number: str, bucket: int = 1 << 16) -> DataFrame:
    """Runs of consecutive integers: keys, lo, hi, n.

    Numbers are ordered within buckets of ``bucket`` neighbouring ones, so that a key of many isn't one task; only runs
    that touch a bucket's ends, two a bucket at most, are put together over the whole key.
    """
    distinct = rows.select(*keys, number).distinct().withColumn("_b", F.floor(F.col(number) / bucket))
    at = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(number))
    runs = distinct.withColumn("_g", F.col(number) - at).groupBy(*keys, "_b", "_g").agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("n"))
    open_ends = F.col("lo").isNull() | (F.pmod("lo", F.lit(bucket)) == 0) | (F.pmod("hi", F.lit(bucket)) == bucket - 1)
    inner = runs.where(~open_ends).select(*keys, "lo", "hi", "n")
    order = Window.partitionBy(*keys).orderBy("lo")
    edge = runs.where(open_ends).withColumn("_new", F.coalesce((F.lag("hi").over(order) + 1 != F.col("lo")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    return inner.unionByName(edge.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).select(*keys, "lo", "hi", "n"))


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: str, lo: str, hi: str, point_id: list[str], tie: list[str]) -> DataFrame:
    """Each point with the shortest span of its keys that holds it; points without one go. Equi-join on keys first."""
    held = points.join(spans, keys).where(F.col(point).between(F.col(lo), F.col(hi)))
    first = F.row_number().over(Window.partitionBy(*point_id).orderBy(F.col(hi) - F.col(lo), *tie))
    return held.withColumn("_r", first).where("_r = 1").drop("_r")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], slack: int) -> DataFrame:
    """Pairs of equal keys whose spans overlap, or miss each other by up to slack; a null label span fits any."""
    lo, hi = F.col(b_span[0]), F.col(b_span[1])
    fits = lo.isNull() | ((F.col(a_span[0]) <= hi + slack) & (lo - slack <= F.coalesce(a_span[1], a_span[0])))
    return a.join(b, keys).where(fits)


def last_state(log: DataFrame, key: str, seq: str, state: list[str]) -> DataFrame:
    """The latest row of each key: a partial aggregate, no sort."""
    return log.groupBy(key).agg(F.max_by(F.struct(*state), seq).alias("s"), F.count("*").alias("n_events")).select(key, "n_events", "s.*")


def keep_best(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
