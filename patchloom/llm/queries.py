"""The queries of this subpackage: op1 to op13 by the names that the driver runs, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, lexical, metric_join, packing, sharding, substring, token_store, toxicity, url_rules, vectors, whitening
from .common import scratch

VOCAB = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, VOCAB)
    return token_store.summary(spark, path)


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.approximate(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return url_rules.judged(url_rules.labelled_pages(pages, labels))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 40)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "spans")


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(table(spark, sf_dir, "documents"), VOCAB)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"), 4096, VOCAB)


def op10_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), k=4)


def op12_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_ids, op2_permutation_index, op3_url_rules, op4_shards, op5_jaccard_join, op6_toxicity, op7_substring_dedup, op8_bpe_roundtrip, op9_packing, op10_pivot_table, op11_whitening, op12_metric_join, op13_ranked_search)}

#: floor(1024 x) and sums of products are whole doubles here, so the exact search is plain SQL.
ORACLE_SQL: dict[str, str] = {
    "op10_pivot_table": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_ranked_search": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
             g AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
             p AS (SELECT doc_id, term, 10 + (90 * CAST(len AS BIGINT) * g.n) // g.l AS m, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d), g GROUP BY ALL),
             w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(g.n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY term),
             s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY ALL),
             r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_metric_join": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                             AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false) AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
             l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
             r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
             c AS (SELECT u, min(v) AS least FROM r GROUP BY u), n AS (SELECT u, count(DISTINCT v) AS n FROM l GROUP BY u)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
}
