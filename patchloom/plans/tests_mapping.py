"""Changed symbols and the tests that reach them: directly, or by one call within the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_id
from ..operators.relational import keep_best
from ..sources.tables import kept
from .api_contract import symbol_changes
from .references import references, resolved_imports
from .line_rules import TEST_PATH

#: Findings of a change (fixed value).
MOST = 12


def test_calls(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls by tests (change_id, path, qualname, test_path, test, strength) and by symbols within their file (change_id, path,
    qualname, caller)."""
    # only what the two read is written, each once
    called = references(index, kept(resolved_imports(index), "imports")).where("kind = 'call'")
    by_test = F.col("path").rlike(TEST_PATH) & (F.col("path") != F.col("target"))
    rows = called.select("change_id", "target", "symbol", "path", "enclosing", "resolution", by_test.alias("by_test")).where("by_test or (path = target and enclosing is not null)")
    refs = kept(rows, "references").hint("merge")
    direct = refs.where("by_test").select("change_id", F.col("target").alias("path"), F.col("symbol").alias("qualname"), F.col("path").alias("test_path"), F.col("enclosing").alias("test"), F.when(F.col("resolution") == "resolved", "import").otherwise("name").alias("strength"))
    return direct, refs.where("path = target and enclosing is not null").select("change_id", "path", F.col("symbol").alias("qualname"), F.col("enclosing").alias("caller"))


def links_to_tests(index: DataFrame) -> DataFrame:
    """change_id, path, qualname, test_path, test, strength (import, name, indirect): which tests call which symbols."""
    direct, callers = (rows.distinct() for rows in test_calls(index))
    hop = callers.join(direct.withColumnRenamed("qualname", "caller"), ["change_id", "path", "caller"]).select("change_id", "path", "qualname", "test_path", "test", F.lit("indirect").alias("strength")).distinct()
    return direct.unionByName(hop.join(direct, ["change_id", "path", "qualname"], "left_anti"))


def untested(index: DataFrame, most: int = MOST) -> DataFrame:
    """CG-TST-001: changed functions and methods outside tests that no test reaches; exported ones need a direct test."""
    changed = symbol_changes(index).where(F.col("change").isin("added", "modified") & F.col("new.params").isNotNull() & ~F.col("path").rlike(TEST_PATH) & (F.col("new.kind") != "test"))
    rows = changed.select("change_id", "path", "qualname", F.col("new.start_line").alias("start_line"), F.col("new.exported").alias("exported"))
    key = ["change_id", "path", "qualname"]
    direct, callers = test_calls(index)
    tested = kept(direct.select(*key).distinct(), "tested").hint("merge")
    near = callers.withColumnRenamed("qualname", "of").withColumnRenamed("caller", "qualname").join(tested, key, "left_semi").select("change_id", "path", F.col("of").alias("qualname"))
    # every changed symbol asks once how it is reached: in one join, as its plan would be run again by each
    reached = tested.withColumn("direct", F.lit(True)).unionByName(near.withColumn("direct", F.lit(False))).groupBy(*key).agg(F.max("direct").alias("direct"))
    gaps = rows.hint("merge").join(reached, key, "left").where("direct is null or not coalesce(direct or not exported, false)")
    best = keep_best(gaps, ["change_id"], [F.desc("exported"), F.col("path"), F.col("start_line"), F.col("qualname")], most)
    return best.select("change_id", finding_id(F.lit("CG-TST-001"), F.col("path"), F.col("start_line"), F.col("qualname")).alias("id"), F.lit("CG-TST-001").alias("rule_id"), F.when(F.col("exported"), "medium").otherwise("low").alias("severity"), F.col("path").alias("file"), "start_line", F.col("qualname").alias("symbol"))
