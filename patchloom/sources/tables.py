"""Tables by name, and the tables derived from them that stand for changes, lines and event logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts at most, as far as no key has more (fixed value).
ROWS = 500_000


def tasks(*tables: DataFrame, each: int = ROWS) -> int:
    """As many tasks as the session shuffles into, and more where these tables' rows are over ``each`` times as many, so that a
    task's memory doesn't grow with them. Tables should be files or written ones, whose rows their footers count."""
    spark = tables[0].sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, *(-(-t.count() // each) for t in tables))


def dealt(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """rows over n tasks, else as many as the session shuffles into, at least one a core. A small file is a task or two however
    long its rows' texts take, and a repartition without a number is put together again by its bytes."""
    spark = rows.sparkSession
    return rows.repartition(n or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def spread(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """rows by these keys over n tasks, for a merge join with others so dealt, or a group; without n as Spark plans it."""
    return rows if n is None else dealt(rows, *keys, n=n).hint("merge")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, doc_id, head, n, line: a change is a pair of documents, base (even doc_id) and head (odd)."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    cut = docs.select((F.col("doc_id").cast("long") - F.col("doc_id") % 2).alias("pid"), "doc_id", (F.col("doc_id") % 2 == 1).alias("head"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return cut.withColumn("n", F.col("n") + 1)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """analysis_id, seq, kind, ts, event_id, value: every user's events in order are one append-only log."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "started", "view", "stage", "click", "stage", "purchase", "completed", "error", "failed")])
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("analysis_id"), seq.alias("seq"), kinds[F.col("event_type")].alias("kind"), "ts", "event_id", "value")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder in spark.checkpoint.dir and read back: plans stay small, and lost executors lose
    nothing. A folder of this machine's stands in only where that setting is unset, as in tests."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="patchloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/patchloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
