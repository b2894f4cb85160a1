"""Destructive migrations, graded by what they do, and the columns that they take from code that still names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finding_id
from ..sources.code import language

MIGRATION_PATH = r"(?i)\.sql$|(^|/)(migrations?|alembic|migrate|db/versions|schema)/"
#: A line outside of a migration holds SQL only if it speaks of running some.
SQL_NEAR = r"(?i)\b(execute|executescript|raw|query|sql|runsql)\b"
NAME = r"[\w.\"`]+"
#: Operations in order with their severities (fixed values); the first that a line shows counts. Calls of frameworks
#: come before SQL, which counts in migrations or near words that run it.
CALLS = (
    ("op.drop_table", "critical", r"\bop\.drop_table\s*\("), ("op.drop_column", "high", r"\bop\.drop_column\s*\("), ("op.rename_table", "high", r"\bop\.rename_table\s*\("),
    ("column rename (op.alter_column)", "high", r"\bop\.alter_column\s*\(.*\bnew_column_name\b"), ("op.alter_column", "medium", r"\bop\.alter_column\s*\(.*(\btype_\s*=|\bnullable\s*=\s*False\b)"),
    ("migrations.DeleteModel", "critical", r"\bmigrations\.DeleteModel\s*\("), ("migrations.RemoveField", "high", r"\bmigrations\.RemoveField\s*\("), ("migrations.Rename", "high", r"\bmigrations\.(RenameField|RenameModel)\s*\("),
    ("migrations.AlterField", "medium", r"\bmigrations\.AlterField\s*\("), ("knex dropTable", "critical", r"\.(dropTable|dropTableIfExists)\s*\("), ("knex dropColumn", "high", r"\.(dropColumn|dropColumns)\s*\("), ("knex renameColumn", "high", r"\.renameColumn\s*\("),
)
SQL = (
    ("DROP TABLE", "critical", r"(?i)\bdrop\s+table\b"), ("TRUNCATE", "critical", rf"(?i)\btruncate(\s+table)?\s+{NAME}"),
    ("DROP COLUMN", "high", rf"(?i)\bdrop\s+column\b|\balter\s+table\s+{NAME}\s+drop\s+(?!constraint|index|default|not)"),
    ("DELETE without WHERE", "high", rf"(?i)\bdelete\s+from\s+{NAME}\s*([;\"']|$)"), ("RENAME", "high", r"(?i)\brename\s+(column|to)\b"),
    ("column type change", "medium", r"(?i)\balter\s+column\b.*\btype\b"), ("SET NOT NULL", "medium", r"(?i)\bset\s+not\s+null\b"),
)
WORD, QUOTE = r"([A-Za-z_]\w*)", r"['\"]"
#: Where an operation names its column.
COLUMNS = (
    rf"\bop\.drop_column\s*\(\s*{QUOTE}[^'\"]+{QUOTE}\s*,\s*{QUOTE}{WORD}{QUOTE}", rf"\bop\.alter_column\s*\(\s*{QUOTE}[^'\"]+{QUOTE}\s*,\s*{QUOTE}{WORD}{QUOTE}.*new_column_name",
    rf"(?i)\bdrop\s+column\s+(?:if\s+exists\s+)?[\"`]?{WORD}", rf"(?i)\brename\s+column\s+[\"`]?{WORD}", rf"\bmigrations\.(?:RemoveField|RenameField)\s*\(.*?\b(?:old_)?name\s*=\s*{QUOTE}{WORD}{QUOTE}",
    rf"\.dropColumn\s*\(\s*{QUOTE}{WORD}{QUOTE}", rf"\.renameColumn\s*\(\s*{QUOTE}{WORD}{QUOTE}",
)
#: Columns whose names say nothing, the least length of a telling one, and mentions after which a file stops (fixed values).
STOPWORDS, SHORTEST, MENTIONS = "id name type data value key status created updated user".split(), 4, 20


def first_of(line: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns])


def migrations(diff: DataFrame) -> DataFrame:
    """Added lines of a diff that drop or rewrite data: change_id, path, line, operation, severity, column."""
    text, path = F.col("content"), F.col("path")
    added = diff.where("kind = 'add' and content is not null and path is not null").where(~F.ltrim(text).rlike(r"^(--|#|//)"))
    named = lambda op, severity: F.struct(F.lit(op).alias("operation"), F.lit(severity).alias("severity"))
    found = F.coalesce(*[F.when(text.rlike(p), named(op, s)) for op, s, p in CALLS], F.when(path.rlike(MIGRATION_PATH) | text.rlike(SQL_NEAR), F.coalesce(*[F.when(text.rlike(p), named(op, s)) for op, s, p in SQL])))
    return added.select("change_id", "path", F.col("new_line").alias("line"), found.alias("m"), first_of(text, COLUMNS).alias("column")).where("m is not null").select("change_id", "path", "line", "m.*", "column")


def mentions(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Where the head's code still names a column: change_id, column, from_path, line, path.

    Lines are cut into words once, and only words that some migration of the change drops go on, so the join is on
    equal words. A file stops at the line with which the column has ``MENTIONS`` of them in all; each later file gives
    one line. Migrations and files of no known language don't count.
    """
    # both sides grow with the changes; a plan by the sizes of compressed files would send them to the driver
    hits, files = hits.hint("merge"), files.hint("merge")
    asked = hits.where(F.col("column").isNotNull() & (F.length("column") >= SHORTEST) & ~F.lower("column").isin(*STOPWORDS)).select("change_id", "column", F.col("path").alias("from_path"), F.col("line").alias("from_line")).distinct()
    code = files.where("side = 'head' and text is not null").where(language(F.col("path")).isNotNull() & ~F.col("path").rlike(MIGRATION_PATH))
    lines = code.join(asked.select("change_id").distinct(), "change_id", "left_semi").select("change_id", "path", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    words = lines.select("change_id", "path", (F.col("n") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), 1))).alias("column"))
    met = words.join(asked, ["change_id", "column"]).where("path <> from_path")
    key = ["change_id", "column", "from_path", "from_line"]
    # a window over per-file counts gives what the files before have taken; within a file its lines are numbered
    nth = F.row_number().over(Window.partitionBy(*key, "path").orderBy("line"))
    taken = met.groupBy(*key, "path").agg(F.count("*").alias("n"))
    # after the first twenty each file gives one line, so what counts before a file is the plain sum until it is reached
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(1), F.lit(MENTIONS) - before)
    return met.withColumn("nth", nth).hint("merge").join(taken.withColumn("room", room).select(*key, "path", "room"), [*key, "path"]).where("nth <= room").select(*key, "path", "line")


def migration_findings(diff: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """CG-MIG-001 for each line, and CG-MIG-002 for each column that code still names: change_id, id, rule_id, severity,
    confidence, file, start_line, detail, evidence (the first six mentions), n (all mentions that count)."""
    hits = migrations(diff)
    one = hits.select("change_id", finding_id(F.lit("CG-MIG-001"), F.col("path"), F.col("line"), F.col("operation")).alias("id"), F.lit("CG-MIG-001").alias("rule_id"), "severity", F.lit("high").alias("confidence"), F.col("path").alias("file"), F.col("line").alias("start_line"), F.col("operation").alias("detail"), F.array().cast("array<string>").alias("evidence"), F.lit(0).cast("long").alias("n"))
    if files is None:
        return one
    found = mentions(hits, files).groupBy("change_id", "column", "from_path", "from_line").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("at"))
    named = F.transform(F.slice("at", 1, 6), lambda x: F.concat_ws(":", x["path"], x["line"].cast("string")))
    two = found.select("change_id", finding_id(F.lit("CG-MIG-002"), F.col("from_path"), F.col("from_line"), F.col("column")).alias("id"), F.lit("CG-MIG-002").alias("rule_id"), F.lit("high").alias("severity"), F.lit("medium").alias("confidence"), F.col("from_path").alias("file"), F.col("from_line").alias("start_line"), F.col("column").alias("detail"), named.alias("evidence"), F.size("at").cast("long").alias("n"))
    return one.unionByName(two)
