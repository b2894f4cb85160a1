"""A change's findings in order, as JSON, SARIF, Markdown and text, one row a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_rules import SEVERITIES

KINDS, CONFIDENCES = ("deterministic", "heuristic", "ai"), ("high", "medium", "low")
#: Findings that the Markdown shows, and the bytes that a comment may have (fixed values).
SHOWN, COMMENT = 50, 60_000
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def rank(c: str, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col(c))


def ordered(findings: DataFrame) -> DataFrame:
    """findings with ord, from 1 in each change: severity, kind, confidence, file, line (null first as 0), rule, id.

    Of equal ids one row stays, so an export never repeats a finding.
    """
    one = findings.dropDuplicates(["change_id", "id"])
    return one.withColumn("ord", F.row_number().over(Window.partitionBy("change_id").orderBy(*places())))


def places() -> list[Column]:
    """What findings are ordered by."""
    return [rank("severity", SEVERITIES), rank("kind", KINDS), rank("confidence", CONFIDENCES), F.col("file"), F.coalesce("start_line", F.lit(0)), F.col("rule_id"), F.col("id")]


def escaped(text: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(e))
    return F.regexp_replace(text, r"([\\`*_\[\]|])", r"\\$1")


def fenced(text: Column) -> Column:
    """The text in a fence that is longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def listed(item: Column, among: Column | None = None) -> Column:
    """The findings' items in their order; those of ``among`` only."""
    entry = F.struct("ord", item.alias("x"))
    return F.transform(F.sort_array(F.collect_list(entry if among is None else F.when(among, entry))), lambda e: e["x"])


def to_json(findings: DataFrame) -> DataFrame:
    item = F.struct("id", "rule_id", "category", "kind", "severity", "confidence", F.struct("file", "start_line").alias("location"), "title", "excerpt")
    return ordered(findings).groupBy("change_id").agg(listed(item).alias("findings")).select("change_id", F.to_json(F.struct("change_id", "findings")).alias("json"))


def to_sarif(findings: DataFrame, tool: str = "patchloom") -> DataFrame:
    """SARIF 2.1.0: rules in the order of their first finding, and results that name them by index."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")]
    # one row a change, sorted in itself: findings are shuffled once to drop repeats and once by change
    entry = F.struct(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(places())]).alias("at"), "rule_id", "title", "file", "start_line", "id", level.alias("level"))
    sorted_rows = findings.dropDuplicates(["change_id", "id"]).groupBy("change_id").agg(F.sort_array(F.collect_list(entry)).alias("f"))
    named = sorted_rows.withColumn("ids", F.transform("f", lambda x: F.coalesce(x["rule_id"], F.lit("")))).withColumn("rule_ids", F.array_distinct("ids"))

    def result(x: Column) -> Column:
        region = F.when(x["start_line"].isNotNull(), F.struct(x["start_line"].alias("startLine")))
        place = F.array(F.struct(F.struct(F.struct(x["file"].alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
        index = (F.array_position("rule_ids", F.coalesce(x["rule_id"], F.lit(""))) - 1).cast("int")
        return F.struct(x["rule_id"].alias("ruleId"), index.alias("ruleIndex"), x["level"].alias("level"), F.struct(x["title"].alias("text")).alias("message"), place.alias("locations"), F.struct(x["id"].alias("findingId")).alias("partialFingerprints"))

    def rule(r: Column) -> Column:
        first = F.element_at("f", F.array_position("ids", r).cast("int"))
        return F.struct(first["rule_id"].alias("id"), F.struct(first["title"].alias("text")).alias("shortDescription"))

    out = named.select("change_id", F.transform("f", result).alias("results"), F.transform("rule_ids", rule).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return out.select("change_id", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def to_markdown(findings: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first findings with their excerpts, and how many more there are."""
    where = F.concat(F.lit("`"), F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("start_line")), F.lit("")), F.lit("`"))
    item = F.concat(F.format_string("### %d. ", "ord"), escaped(F.col("title")), F.format_string(" (%s)\n", "severity"), where, F.lit(" · "), F.col("rule_id"), F.coalesce(F.concat(F.lit("\n\n"), fenced(F.col("excerpt"))), F.lit("")))
    out = ordered(findings).groupBy("change_id").agg(listed(item, F.col("ord") <= shown).alias("items"), F.count("*").alias("n"))
    more = F.when(F.col("n") > shown, F.format_string("\n\n…and %d more", F.col("n") - shown)).otherwise("")
    return out.select("change_id", F.concat(F.format_string("# %d findings\n\n", "n"), F.array_join("items", "\n\n"), more).alias("markdown"))


def to_text(findings: DataFrame) -> DataFrame:
    line = F.concat(F.rpad("severity", 9, " "), F.rpad("rule_id", 12, " "), F.concat_ws(":", "file", "start_line"), F.lit("  "), F.col("title"))
    return ordered(findings).groupBy("change_id").agg(listed(line).alias("x")).select("change_id", F.array_join("x", "\n").alias("text"))


def write(findings: DataFrame, path: str) -> None:
    """All exports as one table at path, partitioned by format: change_id, body. Spark commits it as a whole or not at all."""
    parts = {"json": to_json(findings).withColumnRenamed("json", "body"), "sarif": to_sarif(findings).withColumnRenamed("sarif", "body"), "markdown": to_markdown(findings).withColumnRenamed("markdown", "body"), "text": to_text(findings).withColumnRenamed("text", "body")}
    out = None
    for name, rows in parts.items():
        one = rows.select("change_id", "body", F.lit(name).alias("format"))
        out = one if out is None else out.unionByName(one)
    out.write.partitionBy("format").parquet(path)


def comment(text: Column, most: int = COMMENT) -> Column:
    """A text cut at the last line end before the limit, with a note that it was."""
    head = F.substring(text, 1, most)
    last = F.instr(F.reverse(head), "\n")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(head, F.when(last > 0, most - last).otherwise(F.lit(most))), F.lit("\n\n…cut")))


def gate(findings: DataFrame, fail_on: str = "high") -> DataFrame:
    """change_id, fails, priority: fails if a rule's finding (not a model's) is at least that severe."""
    s = rank("severity", SEVERITIES)
    rules = F.col("kind") != "ai"
    top = [F.bool_or((s == 1) & (F.col("kind") == "deterministic")), F.bool_or((s <= 2) & rules), F.bool_or(s <= 3)]
    priority = F.when(top[0], "block").when(top[1], "high").when(top[2], "elevated").otherwise("routine")
    return findings.groupBy("change_id").agg(F.bool_or((s <= SEVERITIES.index(fail_on) + 1) & rules).alias("fails"), priority.alias("priority"))
