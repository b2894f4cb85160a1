"""Rules on calls that a change adds or touches: read from parsed calls, so comments and strings don't count and calls over
several lines do. Files that don't parse keep the rules on lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_id
from ..sources.code import language
from ..sources.lint import BLOCKING
from ..sources.python_code import part
from .line_rules import line_findings

#: Callees by rule (fixed values), by the names that imports give them.
EVALUATES, TIMERS = ("eval", "exec", "builtins.eval", "builtins.exec"), ("setTimeout", "setInterval", "window.setTimeout", "window.setInterval")
MARKUP = ("document.write", "document.writeln")
SHELLS, NODE_SHELLS = ("os.system", "os.popen"), ("exec", "execSync")
UNSAFE = ("yaml.unsafe_load", "yaml.unsafe_load_all", "marshal.loads", "marshal.load", "pickle.loads", "pickle.load", "jsonpickle.decode")
#: Rules that calls decide; only what isn't a call of theirs stays with lines.
BY_CALL = ("CG-SEC-001", "CG-SEC-003", "CG-SEC-004")


def named_calls(index: DataFrame) -> DataFrame:
    """Head calls with ``full``: the callee by the name that the file's imports give its first part."""
    head = index.where("side = 'head' and error is null").hint("merge")
    calls = part(head, "calls").withColumn("root", F.substring_index("callee", ".", 1))
    python = language(F.col("path")) == "python"
    whole = F.when(F.col("module").startswith(F.concat(F.col("local_name"), F.lit("."))), F.col("local_name")).otherwise(F.col("module"))
    of_python = F.when(F.col("imported_name").isNull(), whole).otherwise(F.concat_ws(".", "module", "imported_name"))
    # a script's modules aren't names, so only what a name was before it was renamed counts
    of_script = F.when(F.col("kind") == "name", F.col("imported_name")).otherwise(F.col("local_name"))
    gives = F.when(python, of_python).otherwise(of_script)
    imports = part(head, "imports").where("level = 0 and local_name <> ''").withColumn("gives", gives)
    known = imports.groupBy("change_id", "path", F.col("local_name").alias("root")).agg(F.min("gives").alias("gives"), F.min("module").alias("from_module"))
    rest = F.expr("substring(callee, length(root) + 1)")
    return calls.join(known, ["change_id", "path", "root"], "left").withColumn("full", F.when(F.col("gives").isNotNull(), F.concat("gives", rest)).otherwise(F.col("callee")))


def rule_of(calls: DataFrame) -> Column:
    """The rule that a call breaks, or null."""
    full, python = F.col("full"), language(F.col("path")) == "python"
    script = ~python
    dynamic = F.col("first").isin("built", "other")
    node = F.regexp_replace(F.coalesce("from_module", F.lit("")), "^node:", "") == "child_process"
    return (
        F.when(python & full.isin(*EVALUATES) | script & (full.isin("eval", "window.eval", "Function") | (full.isin(*TIMERS) & F.col("first").isin("text", "built"))), "CG-SEC-001")
        .when(script & (full.isin(*MARKUP) | (F.col("name") == "insertAdjacentHTML")), "CG-SEC-002")
        .when(python & full.isin(*SHELLS) | script & node & (full.isin(*NODE_SHELLS) | F.col("name").isin(*NODE_SHELLS)) & dynamic, "CG-SEC-003")
        .when(python & (full.isin(*UNSAFE) | (full.isin("yaml.load", "yaml.load_all") & (F.col("positional") < 2) & ~F.array_contains("keywords", "Loader"))), "CG-SEC-004")
    )


def call_findings(index: DataFrame, diff: DataFrame) -> DataFrame:
    """CG-SEC-001 to 004 by calls, and CG-CON-002 (a blocking call within an async function): change_id, id, rule_id,
    severity, file, start_line, symbol (the enclosing function), callee.

    A call counts if one of its lines is added; it is joined to them by its lines, so a file's calls and lines don't meet
    as a product.
    """
    added = diff.where("kind = 'add' and new_line is not null").select("change_id", "path", F.col("new_line").alias("at")).distinct()
    calls = named_calls(index)
    lines = calls.withColumn("at", F.explode(F.sequence("line", F.greatest("line", F.coalesce("end_line", "line")))))
    touched = lines.join(added, ["change_id", "path", "at"], "left_semi").drop("at").distinct()
    ruled = touched.withColumn("rule_id", rule_of(touched)).where("rule_id is not null")
    waits = part(index.where("side = 'head'"), "symbols").where("is_async").select("change_id", "path", F.col("qualname").alias("enclosing")).distinct()
    blocking = touched.where(F.col("full").isin(*BLOCKING) & (language(F.col("path")) == "python") & ~F.col("awaited")).join(waits, ["change_id", "path", "enclosing"], "left_semi").withColumn("rule_id", F.lit("CG-CON-002"))
    both = ruled.unionByName(blocking)
    severity = F.when(F.col("rule_id") == "CG-CON-002", "medium").otherwise("high")
    return both.select("change_id", finding_id(F.col("rule_id"), F.col("path"), F.col("line"), F.col("callee")).alias("id"), "rule_id", severity.alias("severity"), F.col("path").alias("file"), F.col("line").alias("start_line"), F.col("enclosing").alias("symbol"), "callee").distinct()


def security_findings(diff: DataFrame, index: DataFrame) -> DataFrame:
    """change_id, id, rule_id, severity, file, start_line: calls where files parse, lines elsewhere and for all other rules."""
    parsed = index.where("side = 'head' and error is null").select("change_id", F.col("path").alias("file")).distinct()
    rows = line_findings(diff).select("change_id", "id", "rule_id", "severity", "file", "start_line")
    of_lines = rows.where(~F.col("rule_id").isin(*BY_CALL)).unionByName(rows.where(F.col("rule_id").isin(*BY_CALL)).join(parsed, ["change_id", "file"], "left_anti"))
    found = call_findings(index, diff).select("change_id", "id", "rule_id", "severity", "file", "start_line")
    # document.write and its kin are found both ways
    rest = of_lines.join(found.where("rule_id = 'CG-SEC-002'").select("change_id", "file", "rule_id", "start_line"), ["change_id", "file", "rule_id", "start_line"], "left_anti")
    return rest.select(found.columns).unionByName(found)
