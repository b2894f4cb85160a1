"""What changed in a file's symbols, and who still relies on what they were: joins over the code index."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_id
from ..sources.code import language, of_head
from ..sources.tables import kept
from .references import references, resolved_imports
from .renames import renames, with_renames

#: What the rules read of a code index.
CONTRACT = ("error", "error_line", "symbols", "imports", "calls")


def symbol_changes(index: DataFrame) -> DataFrame:
    """change_id, path, qualname, change (added, removed, modified), old, new (symbol structs); of equal names the last counts."""
    # one aggregate over both sides: the index is read, or its files parsed, once; symbols are sorted only behind the shuffle, which
    # is by file, so that what joins files needs no other
    flat = index.where("side in ('base', 'head')").select("change_id", "side", "path", F.explode("symbols").alias("s")).repartition("change_id", "path")
    last = lambda v: F.max_by(F.when(F.col("side") == v, F.col("s")), F.when(F.col("side") == v, F.col("s.ord")))
    both = flat.groupBy("change_id", "path", F.col("s.qualname").alias("qualname")).agg(last("base").alias("old"), last("head").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old.body").eqNullSafe(F.col("new.body")), "modified")
    return both.withColumn("change", change).where("change is not null")


def call_problem(ps: Column, language_of: Column) -> Column:
    """Why a call can't be bound to the parameters, or null. A call that spreads arguments can't be judged."""
    kind = lambda *k: F.filter(ps, lambda p: p["kind"].isin(*k))
    name = lambda p: p["name"]
    places, named = kind("positional_only", "positional"), kind("positional", "keyword_only")
    none = F.array().cast("array<string>")
    taken = F.when(F.col("positional") > 0, F.transform(F.slice(places, 1, F.greatest(F.col("positional"), F.lit(1))), name)).otherwise(none)
    rest = F.filter(ps, lambda p: ~p["has_default"] & ~p["kind"].isin("var_positional", "var_keyword"))
    given = F.coalesce("keywords", none)
    missing = F.array_except(F.array_except(F.transform(rest, name), taken), given)
    unknown = F.array_except(given, F.transform(named, name))
    twice = F.array_intersect(F.array_intersect(given, taken), F.transform(named, name))
    open_ended = F.size(kind("var_positional")) > 0
    surplus = F.when((F.col("positional") > F.size(places)) & ~open_ended, F.format_string("takes %d positional arguments but %d are given", F.size(places), F.col("positional")))
    python = (
        F.when(surplus.isNotNull(), surplus)
        .when((F.size(unknown) > 0) & (F.size(kind("var_keyword")) == 0), F.concat(F.lit("unexpected keyword argument "), F.array_join(unknown, ", ")))
        .when(F.size(twice) > 0, F.concat(F.lit("multiple values for argument "), F.array_join(twice, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing argument "), F.array_join(missing, ", ")))
    )
    # scripts may pass fewer or more: too few break a call, too many only where types are checked
    needed = F.size(F.filter(ps, lambda p: ~p["has_default"] & (p["kind"] != "var_positional")))
    script = F.when(F.col("positional") < needed, F.format_string("needs %d arguments but %d are given", needed, F.col("positional"))).when(language_of == "typescript", surplus)
    return F.when(F.coalesce("star_args", F.lit(False)) | F.coalesce("star_kwargs", F.lit(False)), F.lit(None)).when(language_of == "python", python).otherwise(script)


def removed_modules(index: DataFrame, imports: DataFrame) -> DataFrame:
    """Head imports of files that only the base has: change_id, path (of the file), r_path, r_line.

    What the head resolves isn't meant; the rest is resolved as if the base's files were still there.
    """
    gone = index.where("side = 'base'").select("change_id", "path").distinct().join(of_head(index).select("change_id", "path"), ["change_id", "path"], "left_anti")
    # only changes that lose a file have anything to resolve
    lossy = index.join(gone.select("change_id").distinct(), "change_id", "left_semi")
    as_before = resolved_imports(lossy, paths=lossy.select("change_id", "path").distinct())
    at = ["change_id", "path", "line", "local_name"]
    left = as_before.join(imports.select(at), at, "left_anti")
    return left.select("change_id", F.col("target").alias("path"), F.col("path").alias("r_path"), F.col("line").alias("r_line")).join(gone, ["change_id", "path"], "left_semi")


def contract_findings(index: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """CG-API-001 to 007, SYN-001, ERR-002, TST-004, TST-005 and CPX-001 as findings with the lines that show them.

    change_id, id, rule_id, severity, confidence, file, start_line, symbol, detail, evidence (sorted, distinct
    ``path:line``). files (change_id, side, path, text) bring path aliases of scripts.
    """
    # sides are as large as the parsed files, but files compress so well that a plan by their size would broadcast them
    index = index.hint("merge")
    # a side that doesn't parse has no symbols, which doesn't mean that they were removed
    errors = index.where("error is not null and side in ('base', 'head')").groupBy("change_id", "path").agg(F.max(F.when(F.col("side") == "base", F.col("error"))).alias("b"), F.max(F.when(F.col("side") == "head", F.col("error"))).alias("detail"), F.max(F.when(F.col("side") == "head", F.col("error_line"))).alias("start_line"))
    # the rules and renames read the changes: written, as a plan that repeats them takes much of the driver's memory
    raw = kept(symbol_changes(index).join(errors.select("change_id", "path"), ["change_id", "path"], "left_anti"), "symbol-changes").hint("merge")
    changes = kept(with_renames(raw, kept(renames(raw), "renames")), "named-changes").hint("merge")
    imports = kept(resolved_imports(index, files), "imports").hint("merge")
    refs = kept(references(index, imports), "references").hint("merge")
    old, new = F.col("old"), F.col("new")
    at = F.concat_ws(":", "r_path", "r_line")
    uses = refs.select("change_id", F.col("target").alias("path"), F.col("symbol").alias("asked"), F.col("path").alias("r_path"), F.col("line").alias("r_line"), "kind", "resolution", "drop_first", "positional", "keywords", "star_args", "star_kwargs", "awaited")

    def finding(rule: str, severity: Column | str, detail: Column | str, line: Column, symbol: Column = F.col("qualname"), evidence: Column | None = None, confidence: Column | str = "medium") -> Column:
        literal = lambda c: F.lit(c) if isinstance(c, str) else c
        none = F.array().cast("array<string>")
        return F.struct(F.lit(rule).alias("rule_id"), literal(severity).alias("severity"), literal(confidence).alias("confidence"), line.alias("start_line"), symbol.alias("symbol"), literal(detail).alias("detail"), (none if evidence is None else evidence).alias("evidence"))

    # what a change breaks by itself
    modified = F.col("change") == "modified"
    function = modified & new["params"].isNotNull() & old["params"].isNotNull()
    body = modified & new["params"].isNotNull()
    removed = F.col("change") == "removed"
    required = lambda s: F.transform(F.filter(s["params"], lambda p: ~p["has_default"] & ~p["kind"].isin("var_positional", "var_keyword")), lambda p: p["name"])
    names = lambda s: F.transform(s["params"], lambda p: p["name"])
    changed = function & (old["params"] != new["params"])
    breaking = (F.size(F.array_except(names(old), names(new))) > 0) | (F.size(F.array_except(required(new), required(old))) > 0)
    defaults = F.filter(F.arrays_zip(names(new), F.transform(new["params"], lambda p: p["default"])), lambda x: F.exists(old["params"], lambda o: (o["name"] == x["0"]) & o["has_default"] & (o["default"] != x["1"])))
    retyped = (old["returns"] != new["returns"]) & (language(F.col("path")) != "javascript")
    fell = lambda f: old[f] > new[f]
    more = ((new["complexity"] >= 10) & (new["complexity"] - old["complexity"] >= 4)) | (old.isNull() & (new["complexity"] >= 15))
    alone = F.array_compact(
        F.array(
            F.when(changed & (F.size("defaults") > 0), finding("CG-API-005", "medium", F.concat(F.lit("default of "), F.try_element_at("defaults", F.lit(1))["0"], F.lit(" changed")), new["start_line"])),
            F.when(function & retyped, finding("CG-API-006", "low", F.concat(F.lit("returns "), new["returns"], F.lit(", not "), old["returns"]), new["start_line"])),
            F.when(body & fell("try_blocks"), finding("CG-ERR-002", "medium", "fewer try blocks", new["start_line"])),
            F.when(body & fell("assertions") & (new["kind"] == "test"), finding("CG-TST-004", "medium", "fewer assertions", new["start_line"])),
            F.when(more & new["params"].isNotNull(), finding("CG-CPX-001", "low", F.format_string("complexity %d", new["complexity"]), new["start_line"])),
        )
    )
    # what counts only where no use is found
    unless = F.when(changed & breaking & new["exported"] & old["parent"].isNull(), finding("CG-API-003", "medium", "parameters changed incompatibly", new["start_line"])).when(
        removed & old["parent"].isNull() & old["exported"] & (old["kind"] != "test") & ((old["kind"] != "variable") | (F.upper(old["name"]) == old["name"])), finding("CG-API-007", "low", "a public symbol was removed", old["start_line"])
    )
    # a renamed symbol is gone under its old name
    gone = F.col("change").isin("removed", "renamed")
    line = F.when(gone, old["start_line"]).otherwise(new["start_line"]).alias("start_line")
    awaits = function & new["is_async"] & ~old["is_async"]
    asked = F.when(gone, old["qualname"]).otherwise(F.col("qualname")).alias("asked")
    told_by = [gone, new["complexity"] >= 10, *[~old[f].eqNullSafe(new[f]) for f in ("params", "returns", "is_async", "try_blocks", "assertions")]]
    # most edits are within a body and break no rule
    telling = changes.where(reduce(or_, told_by))

    # every change meets its uses in one join; only uses that tell something are put together
    key = ["change_id", "path", "asked"]
    asks = telling.where(gone | changed | awaits).select("change_id", "path", asked, gone.alias("gone"), awaits.alias("awaits"), F.when(changed, new["params"]).alias("params"))
    ps = F.when(F.col("drop_first"), F.slice("params", 2, F.greatest(F.size("params"), F.lit(1)))).otherwise(F.col("params"))
    used = asks.join(uses, key).where("gone or kind = 'call'").withColumn("ps", ps)
    # as a generator's row a problem is looked for once; as a column it would be again for every use of it
    problem = F.explode(F.array(F.when(F.col("ps").isNotNull(), call_problem(F.col("ps"), language(F.col("path"))))))
    used = used.select(*key, "kind", "resolution", at.alias("at"), "gone", "awaits", "awaited", problem.alias("problem"))
    hit = (F.col("resolution") == "resolved") & (F.col("gone") | (F.col("awaits") & ~F.col("awaited")))
    told = used.withColumn("hit", hit).where("problem is not null or hit").groupBy(*key).agg(
        F.min("problem").alias("problem"), F.sort_array(F.collect_set(F.when(F.col("problem").isNotNull(), F.col("at")))).alias("broken"), F.max(F.when(F.col("problem").isNotNull(), F.col("resolution") == "resolved")).alias("sure"),
        F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("at")))).alias("hit"), F.max(F.when(F.col("hit"), F.col("kind") == "import")).alias("imported"),
    )
    each = telling.withColumn("defaults", F.when(changed, defaults)).select("change_id", "path", asked, "change", F.col("new.qualname").alias("now"), line, awaits.alias("awaits"), alone.alias("alone"), unless.alias("unless"))
    told = each.join(told, key, "left")
    symbol, start, broken, hit = F.col("asked"), F.col("start_line"), F.coalesce(F.size("broken") > 0, F.lit(False)), F.coalesce(F.size("hit") > 0, F.lit(False))
    # a guess by name alone is graded lower where no type checker would stop it
    graded = F.when(F.col("sure") | (language(F.col("path")) == "typescript"), "high").otherwise("medium")
    api1 = finding("CG-API-001", graded, F.col("problem"), start, symbol, F.col("broken"), F.when(F.col("sure"), "high").otherwise("medium"))
    api4 = finding("CG-API-004", "high", "the caller doesn't await", start, symbol, F.col("hit"), "high")
    still = F.when(F.col("change") == "renamed", F.concat(F.lit("renamed to "), F.col("now"), F.lit(" but still used"))).otherwise("removed but still used")
    api2 = finding("CG-API-002", F.when(F.col("imported"), "critical").otherwise("high"), still, start, symbol, F.col("hit"), "high")
    of_uses = F.array_compact(F.array(F.when(broken, api1), F.when(hit & F.col("awaits"), api4), F.when(hit & ~F.col("awaits"), api2), F.when(~broken & (~hit | F.col("awaits")), F.col("unless"))))
    found = told.select("change_id", "path", F.explode(F.concat("alone", of_uses)).alias("f")).select("change_id", "path", "f.*")

    def of_file(rows: DataFrame, rule: str, severity: str, detail: Column, line: Column, evidence: Column | None = None) -> DataFrame:
        return rows.select("change_id", "path", finding(rule, severity, detail, line, F.lit(None).cast("string"), evidence, "high").alias("f")).select("change_id", "path", "f.*")

    lost = removed_modules(index, imports).groupBy("change_id", "path").agg(F.sort_array(F.collect_set(at)).alias("evidence"))
    tests = changes.where("change = 'removed' and old.kind = 'test'").groupBy("change_id", "path").agg(F.min("old.start_line").alias("start_line"), F.array_join(F.sort_array(F.collect_list("qualname")), ", ").alias("detail"))
    every = found.unionByName(of_file(lost, "CG-API-002", "critical", F.lit("the file is gone but still imported"), F.lit(None).cast("int"), F.col("evidence")))
    every = every.unionByName(of_file(tests, "CG-TST-005", "medium", F.col("detail"), F.col("start_line"))).unionByName(of_file(errors.where("detail is not null and b is null"), "CG-SYN-001", "critical", F.col("detail"), F.col("start_line")))
    return every.select("change_id", finding_id(F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("symbol")).alias("id"), "rule_id", "severity", "confidence", F.col("path").alias("file"), "start_line", "symbol", "detail", "evidence")
