"""Op 3: URL filters. Association rules over URL token combinations, mined by FP-growth from labelled URLs, behind a
list of explicit host and path rules.

Tokens that stand in exactly the same labelled URLs are one item to the mining and stand for each other in its rules, so
long paths and hosts that always go together don't multiply the item sets, and no rule is lost. Rules are pruned by
support and confidence, kept if no rule with fewer tokens is within them, and looked up through an inverted index from
token to rules. At most (tokens of a URL / support) tokens are frequent; these go to the driver and to the tasks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, stored

#: The explicit rules of the query: verdict, host, path (fixed values).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCK = "label=block"
#: Labelled URLs that a rule needs at least: fewer agree by chance.
LEAST_ROWS = 10
TOKEN = re.compile(r"[^/?#&=.\-_:]+")


@dataclass(frozen=True)
class Mined:
    tokens: tuple[str, ...]
    confidence: float
    support: float
    #: For each token those that stood in just the same labelled URLs, itself among them.
    alike: tuple[tuple[str, ...], ...] = ()


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds _host and _path: after the first ``://`` up to /, ? or #, A-Z lower-cased; then up to ? or #. Else empty."""
    rest = after_scheme(F.col("url"))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"_host": F.coalesce(lower, F.lit("")), "_path": F.coalesce(path, F.lit(""))})


def ruled(rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule of _host and _path as text, and its verdict; null if none fits."""
    name = verdict = None
    for v, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1])):
        fits = ((F.col("_host") == host) | F.col("_host").endswith(f".{host}")) & F.col("_path").startswith(path)
        name = F.when(fits, f"{host}{path}") if name is None else name.when(fits, f"{host}{path}")
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def tokens(host: str, path: str, query: str) -> list[str]:
    """A URL's distinct tokens: host labels by level from the right, path words by place, query names."""
    labels = host.split(".")[::-1] if host else []
    out = [f"h{min(i, 4)}:{t}" for i, t in enumerate(labels) if t]
    out += [f"p{min(i, 3)}:{'0' if t.isdigit() else t.lower()}" for i, part in enumerate(path.split("/")[1:]) for t in TOKEN.findall(part)]
    out += [f"q:{t.partition('=')[0].lower()}" for t in query.partition("#")[0].split("&") if t]
    return list(dict.fromkeys(out))


def token_column(pages: DataFrame) -> DataFrame:
    """page_id, _host, _path, items. Long URLs keep all their tokens."""
    schema = pa.schema([("page_id", pa.int64()), ("_host", pa.string()), ("_path", pa.string()), ("label", pa.string()), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [tokens(h, p, (u or "").partition("?")[2]) for h, p, u in zip(*(b.column(c).to_pylist() for c in ("_host", "_path", "url")), strict=True)]
            yield batch(schema, {c: b.column(c) for c in ("page_id", "_host", "_path", "label")} | {"items": items})

    return map_batches(pages.select("page_id", "_host", "_path", "label", "url"), run, "page_id long, _host string, _path string, label string, items array<string>")


def alike(rows: DataFrame, least: float) -> dict[str, tuple[str, ...]]:
    """The tokens of at least so many rows, under the first of those that stand in the same rows. rows: row, items.

    The same rows are told by their count and two sums of 64-bit hashes of their numbers.
    """
    each = rows.select("row", F.explode(F.array_distinct("items")).alias("t"))
    sums = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in (1, 2)]
    common = each.groupBy("t").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    out: dict[tuple, list[str]] = defaultdict(list)
    for r in common.collect():
        out[r.n, r.s1, r.s2].append(r.t)
    return {min(ts): tuple(sorted(ts)) for ts in out.values()}


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.7) -> list[Mined]:
    """Rules ``tokens => block`` from rows of ``items`` and ``label`` (block or allow). No labels, no rules.

    A rule holds for ``support`` of the labelled rows, or ``LEAST_ROWS`` of them where that is more.
    """
    from pyspark.ml.fpm import FPGrowth

    # numbered once and written, so that a row keeps its number
    rows = stored(labelled.where("label in ('block', 'allow')").select(F.monotonically_increasing_id().alias("row"), "items", "label"), "labelled-urls")
    n = rows.count()
    least = max(LEAST_ROWS, support * n)
    classes = alike(rows, least) if n else {}
    if not classes:
        return []
    frequent = rows.sparkSession.sparkContext.broadcast(frozenset(classes))
    schema = pa.schema([("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [[t for t in dict.fromkeys(i) if t in frequent.value] + [BLOCK] * (y == "block") for i, y in zip(b.column("items").to_pylist(), b.column("label").to_pylist(), strict=True)]
            yield batch(schema, {"items": [i for i in kept if i]})

    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=confidence).fit(map_batches(rows.select("items", "label"), run, "items array<string>"))
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select("antecedent", "confidence", "support").collect()
    # a rule adds nothing to one with fewer tokens that it contains
    out: list[Mined] = []
    for r in sorted(found, key=lambda r: (len(r.antecedent), sorted(r.antecedent))):
        tokens = tuple(sorted(r.antecedent))
        if not any(set(o.tokens) <= set(tokens) for o in out):
            out.append(Mined(tokens, r.confidence, r.support, tuple(classes[t] for t in tokens)))
    return out


class RuleIndex:
    """Inverted index from token to rules; a rule matches once each of its tokens, or one alike, was met."""

    def __init__(self, rules: list[Mined]):
        self.rules = rules
        self.posted: dict[str, list[int]] = defaultdict(list)
        self.first: dict[str, str] = {}
        for i, r in enumerate(rules):
            for t, same in zip(r.tokens, r.alike or [(t,) for t in r.tokens], strict=True):
                self.posted[t].append(i)
                self.first.update(dict.fromkeys(same, t))

    def match(self, items: list[str]) -> Mined | None:
        """The matching rule of highest confidence; ties to the shorter and then the first in order."""
        met = Counter(i for t in {self.first[t] for t in items if t in self.first} for i in self.posted[t])
        full = [i for i, n in met.items() if n == len(self.rules[i].tokens)]
        return min((self.rules[i] for i in full), key=lambda r: (-r.confidence, len(r.tokens), r.tokens), default=None)


def judged(pages: DataFrame, rules: tuple = RULES, support: float = 0.002, confidence: float = 0.7) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, mined. pages have page_id, url, label (block, allow or null).

    The longest explicit rule decides; elsewhere a page is blocked if a mined rule matches and allowed otherwise. Null
    urls and urls without ``://`` have empty host and path and are allowed. Repeated rows each give a row. A rule's tokens
    are found wherever they stand in a long URL, as all its tokens are read.
    """
    rows = token_column(with_parts(pages.withColumn("page_id", F.col("page_id").cast("long"))))
    index = RuleIndex(mine(rows, support, confidence))
    name, verdict = ruled(rules)
    schema = pa.schema([("page_id", pa.int64()), ("_host", pa.string()), ("_path", pa.string()), ("mined", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = [index.match(i) for i in b.column("items").to_pylist()]
            yield batch(schema, {c: b.column(c) for c in ("page_id", "_host", "_path")} | {"mined": [" & ".join(m.tokens) if m else None for m in met]})

    out = map_batches(rows, run, "page_id long, _host string, _path string, mined string")
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), name.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, label: a page has the labels of the document whose doc_id its path ends in; poor or toxic is block."""
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)[^0-9/]*$', 1) as bigint)")
    judged_docs = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("_bad"))
    rows = pages.select("page_id", "url", F.when(number.isNotNull(), number).alias("_n"))
    return rows.join(judged_docs, F.col("_n") == F.col("_doc"), "left").select("page_id", "url", F.when(F.col("_bad"), "block").when(~F.col("_bad"), "allow").alias("label"))
