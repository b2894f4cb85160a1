"""Coverage reports (lcov, Cobertura, JSON) as rows of change_id, path, line, hits; of repeats the most hits count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Line numbers that a report may have (fixed value).
MOST = 5_000_000


def lcov(reports: DataFrame) -> DataFrame:
    """The SF record last seen names the file of each DA record. Reports of one change are read each for itself."""
    # cut at the SF lines, each piece's first line is its path; what comes before the first belongs to no file
    pieces = F.split("text", r"(^|\r?\n)SF:")
    records = reports.select("change_id", F.explode(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))).alias("r")).select("change_id", F.split("r", "\r?\n").alias("l"))
    rest = F.slice("l", 2, F.greatest(F.size("l"), F.lit(1)))
    named = records.select("change_id", F.col("l")[0].alias("path"), rest.alias("l")).where("path <> ''")
    end = F.array_position("l", "end_of_record")
    cut = named.select("change_id", "path", F.explode(F.when(end > 0, F.slice("l", 1, F.greatest(end.cast("int"), F.lit(1)))).otherwise(F.col("l"))).alias("line"))
    hit = F.regexp_extract("line", r"^DA:(\d+),(\d+)", 1), F.regexp_extract("line", r"^DA:(\d+),(\d+)", 2)
    return cut.where("line like 'DA:%'").select("change_id", "path", hit[0].try_cast("int").alias("line"), hit[1].try_cast("long").alias("hits"))


def cobertura(reports: DataFrame) -> DataFrame:
    """The lines of every class element, wherever it stands, read as XML; a document type or entity of its own is refused."""
    safe = reports.where(~F.col("text").rlike("<!(DOCTYPE|ENTITY)"))
    classes = safe.select("change_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(<class\b.*?</class>)"), 1)).alias("c"))
    line = "line array<struct<_number: string, _hits: string>>"
    tree = F.from_xml("c", f"_filename string, lines struct<{line}>, {line}")
    none = F.array().cast("array<struct<_number: string, _hits: string>>")
    found = classes.select("change_id", tree.alias("c")).select("change_id", F.col("c._filename").alias("path"), F.explode(F.concat(F.coalesce("c.lines.line", none), F.coalesce("c.line", none))).alias("l"))
    return found.select("change_id", "path", F.col("l._number").try_cast("int").alias("line"), F.col("l._hits").try_cast("long").alias("hits"))


def json_report(reports: DataFrame) -> DataFrame:
    """files.{path}.executed_lines and missing_lines."""
    files = F.from_json("text", "files map<string, struct<executed_lines: array<int>, missing_lines: array<int>>>")
    each = reports.select("change_id", F.explode(files["files"]).alias("path", "f"))
    hits = lambda c, n: F.transform(F.coalesce(F.col(c), F.array().cast("array<int>")), lambda x: F.struct(x.alias("line"), F.lit(n).cast("long").alias("hits")))
    return each.select("change_id", "path", F.explode(F.concat(hits("f.executed_lines", 1), hits("f.missing_lines", 0))).alias("l")).select("change_id", "path", "l.line", "l.hits")


def coverage_lines(reports: DataFrame) -> DataFrame:
    """change_id, text of any of the three formats, told apart by their first characters."""
    start = F.ltrim("text")
    both = lcov(reports.where(F.col("text").contains("SF:") & F.col("text").contains("end_of_record")))
    both = both.unionByName(cobertura(reports.where(start.startswith("<")))).unionByName(json_report(reports.where(start.startswith("{"))))
    return both.where(F.col("line").between(1, MOST) & (F.col("hits") >= 0)).groupBy("change_id", "path", "line").agg(F.max("hits").alias("hits"))
