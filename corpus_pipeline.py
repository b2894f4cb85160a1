"""A corpus pipeline of the training-data operators: toxicity, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import jaccard, packing, substring, toxicity
from patchloom.llm.common import scratch, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores at 0.7 or more go; the others stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scores(docs, toxicity.fit(docs, labels)).where("tox_predicted = 0").select(docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, 0.8 or more) one row stays: the least doc_id, then hash; null doc_ids are last.

    Documents without words are classes of their own and stay, and so do unique texts under a null doc_id.
    """
    joined = jaccard.classes(docs)
    first = joined.where("root is not null").groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "k1", "k2")).alias("f"))
    # a class of one is its own first; so only classes with links lose rows
    k1, k2, links = (unused(docs, c) for c in ("k1", "k2", "n_links"))
    own = (F.col("n_links") == 0) | ((F.col("f.k1") == F.col("k1")) & (F.col("f.k2") == F.col("k2")))
    kept = joined.join(first, "root", "left").where(own).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n_links").alias(links)).dropDuplicates([k1, k2])
    rows = jaccard.keyed(docs, k1, k2).join(kept, [k1, k2])
    alone = rows.where(F.col(links) == 0).select(docs.columns)
    return alone.unionByName(rows.where(F.col(links) > 0).dropDuplicates([k1, k2]).select(docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out; n_chars follows the text."""
    out = substring.dedup(docs)
    return out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as token pieces in sequences of 4096."""
    return packing.sequences(docs, 4096)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each_class), ("substring_dedup", cut_repeats), ("packing", pack)]
#: Tokenisation and the grammar's weights aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
