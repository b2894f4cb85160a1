"""Diagnostics that need scopes: undefined and redefined names, found by joins of uses with bindings."""

from __future__ import annotations

import builtins

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import new_in_head
from ..sources.scopes import scope_rows
from ..sources.tables import kept

#: Names that every module has.
GIVEN = [*dir(builtins), "__file__", "__path__", "__builtins__", "__annotations__", "__class__", "__all__", "WindowsError", "reveal_type"]
FILE = ["change_id", "side", "path"]
#: Bindings that are made to be used, so that making them again unused is an oversight.
MADE = ("import", "definition")


def scope_diagnostics(files: DataFrame) -> DataFrame:
    """change_id, side, path, line, code, message: F821, F822, F823, F811, F704, F706 and PLE1142 of Python files.

    A use is resolved by the nearest scope that binds its name, in the order of running as far as that is known. Where a
    visible scope takes all names of a module, names aren't judged.
    """
    # every rule reads the rows; files are parsed once
    rows = kept(scope_rows(files), "scope-rows").hint("merge")
    binds = rows.where("kind = 'bind'").select(*FILE, "scope", "name", F.col("ord").alias("at"), "line", "binding", "forks")
    uses = rows.where("kind = 'use'").select(*FILE, "name", "ord", "line", "chain", F.col("scope").alias("own"))
    out = lambda found, code, message: found.select(*FILE, "line", F.lit(code).alias("code"), message.alias("message"))

    unknown = uses.where(~F.col("name").isin(*GIVEN))
    stars = binds.where("name = '*'").select(*FILE, "scope").distinct()
    seen = unknown.select(*FILE, "name", "ord", "line", "own", F.posexplode("chain").alias("depth", "c")).select(*FILE, "name", "ord", "line", "own", "depth", F.col("c.scope").alias("scope"), "c.ordered")
    open_ended = seen.join(stars, [*FILE, "scope"], "left_semi").select(*FILE, "ord").distinct()
    # a name's first binding in a scope tells both whether there is one and whether it comes before
    first = binds.groupBy(*FILE, "scope", "name").agg(F.min("at").alias("first"))
    met = seen.join(first, [*FILE, "scope", "name"])
    judged = met.withColumn("in_time", ~F.col("ordered") | (F.col("first") < F.col("ord"))).groupBy(*FILE, "ord").agg(
        F.min(F.when(F.col("in_time"), F.col("depth"))).alias("resolved"), F.min(F.when(~F.col("in_time") & (F.col("scope") == F.col("own")), F.col("depth"))).alias("late"))
    state = unknown.join(judged, [*FILE, "ord"], "left").join(open_ended, [*FILE, "ord"], "left_anti")
    # a function's own later binding hides those of outer scopes
    functions = rows.where("kind = 'bind' and binding = 'argument'").select(*FILE, F.col("scope").alias("own"))
    local = functions.unionByName(rows.where("kind = 'use' and not element_at(chain, -1).ordered").select(*FILE, F.col("scope").alias("own"))).distinct().withColumn("in_function", F.lit(True))
    state = state.join(local, [*FILE, "own"], "left")
    early = state.where("late is not null and resolved is not null and late < resolved and in_function")
    f823 = out(early, "F823", F.concat(F.lit("local variable "), "name", F.lit(" is used before it is assigned")))
    f821 = out(state.where("resolved is null"), "F821", F.concat(F.lit("undefined name "), "name"))

    exports = rows.where("kind = 'export'").select(*FILE, "name", "line")
    # a module that takes all names of another, or makes them when asked, may have any
    open_modules = binds.where("scope = 0 and name in ('*', '__getattr__')").select(*FILE).distinct()
    f822 = out(exports.join(binds.where("scope = 0").select(*FILE, "name"), [*FILE, "name"], "left_anti").join(open_modules, FILE, "left_anti"), "F822", F.concat(F.lit("undefined name "), "name", F.lit(" in __all__")))

    in_order = Window.partitionBy(*FILE, "scope", "name").orderBy("at")
    before = lambda c: F.lag(c).over(in_order)
    again = binds.where(~F.col("name").rlike("^_+$")).select("*", before("at").alias("was_at"), before("binding").alias("was"), before("forks").alias("was_forks")).where(F.col("binding").isin(*MADE) & F.col("was").isin(*MADE))
    split = F.exists("forks", lambda a: F.exists("was_forks", lambda b: (F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)) & (a != b)))
    again = again.where(~split)
    between = uses.select(*FILE, "name", "ord", F.explode(F.filter("chain", lambda c: c["ordered"])).alias("c")).select(*FILE, "name", "ord", F.col("c.scope").alias("scope"))
    used = again.join(between, [*FILE, "scope", "name"]).where("ord > was_at and ord < at").select(*FILE, "scope", "name", "at").distinct()
    f811 = out(again.join(used, [*FILE, "scope", "name", "at"], "left_anti"), "F811", F.concat(F.lit("redefinition of unused "), "name"))

    placed = rows.where("kind in ('F704', 'F706', 'PLE1142')").select(*FILE, "line", F.col("kind").alias("code"), F.concat("name", F.lit(" out of place")).alias("message"))
    return f821.unionByName(f822).unionByName(f823).unionByName(f811).unionByName(placed).distinct()


def new_scope_diagnostics(files: DataFrame) -> DataFrame:
    """Those of head beyond as many equal ones of base, by code, message and stripped source line: change_id, path, line,
    rule_id, message. A use that loses its import is new although its own line didn't change."""
    line = files.select(*FILE, F.split("text", "\n").alias("lines"))
    known = scope_diagnostics(files)
    located = known.join(line, FILE).withColumn("source", F.trim(F.coalesce(F.try_element_at("lines", F.greatest("line", F.lit(1))), F.lit("")))).drop("lines").withColumn("ord", F.lit(0))
    keys = ["change_id", "path", "code", "message", "source"]
    fresh = new_in_head(located.where("side = 'base'"), located.where("side = 'head'"), keys, ["line", "ord"])
    return fresh.select("change_id", "path", "line", F.concat(F.lit("RUFF-"), "code").alias("rule_id"), "message")
