"""Secrets on added lines: tokens of known formats, and assignments whose value looks random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_id
from .line_rules import SECRET, TEST_PATH

#: A name that speaks of a secret, and a quoted value of at least 16 characters without blanks.
ASSIGNED = r"(?i)[\w.-]*(?:api_?key|secret|token|passw(?:or)?d|credential|private_?key)[\w.-]*['\"]?\s*(?::=|[:=])\s*['\"]([A-Za-z0-9+/_=.~-]{16,})['\"]"
#: Bits a character that a random value has at least, and words that stand for a value to be filled in.
BITS, PLACEHOLDER = 3.2, r"(?i)example|placeholder|changeme|your[_-]|xxxx|dummy|sample|redacted"


def entropy(text: Column) -> Column:
    """Shannon's entropy of a text's characters, in bits; 0 for an empty one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.when(F.length(text) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def masked(text: Column) -> Column:
    """The first four characters and how many follow."""
    return F.concat(F.substring(text, 1, 4), F.lit("…("), F.length(text).cast("string"), F.lit(")"))


def redacted(text: Column) -> Column:
    """The text with its secrets as four stars: known formats, and random values that are assigned to telling names."""
    plain = F.regexp_replace(text, f"({SECRET})", "****")
    values = F.filter(F.regexp_extract_all(plain, F.lit(ASSIGNED), 1), lambda v: (entropy(v) >= BITS) & ~v.rlike(PLACEHOLDER))
    return F.aggregate(values, plain, lambda t, v: F.replace(t, v, F.lit("****")))


def secret_findings(diff: DataFrame) -> DataFrame:
    """CG-SEC-010: change_id, id, rule_id, severity, confidence, file, start_line, kind (provider, generic), masked.

    Known formats are critical. A random value is high, in tests medium with low confidence; a line's known formats
    aren't reported again as random values. The token itself is in no column.
    """
    added = diff.where("kind = 'add' and content is not null and path is not null")
    known = F.transform(F.regexp_extract_all("content", F.lit(f"({SECRET})"), 1), lambda v: F.struct(F.lit("provider").alias("kind"), v.alias("v")))
    values = F.filter(F.regexp_extract_all("content", F.lit(ASSIGNED), 1), lambda v: ~v.rlike(SECRET) & (entropy(v) >= BITS) & ~v.rlike(PLACEHOLDER))
    each = added.select("change_id", F.col("path").alias("file"), F.col("new_line").alias("start_line"), "content", F.explode(F.concat(known, F.transform(values, lambda v: F.struct(F.lit("generic").alias("kind"), v.alias("v"))))).alias("s"))
    provider, test = F.col("s.kind") == "provider", F.col("file").rlike(TEST_PATH)
    place = F.instr("content", F.col("s.v")) - 1
    return each.select(
        "change_id", finding_id(F.lit("CG-SEC-010"), F.col("file"), F.col("start_line"), place.cast("string")).alias("id"), F.lit("CG-SEC-010").alias("rule_id"),
        F.when(provider, "critical").when(test, "medium").otherwise("high").alias("severity"), F.when(provider, "high").when(test, "low").otherwise("medium").alias("confidence"),
        "file", "start_line", F.col("s.kind").alias("kind"), masked(F.col("s.v")).alias("masked"),
    ).distinct()
