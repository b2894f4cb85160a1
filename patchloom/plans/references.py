"""Which file an import means, and who refers to a symbol: path algebra on columns and ranked candidate joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.code import SCRIPTS, language, of_head
from ..sources.python_code import part

#: Names too common to mean one definition by themselves (fixed values).
COMMON_NAMES = """
    get set run save update delete add remove close open read write send call execute process handle validate render init start stop load
    dump apply build create fetch parse format to_dict from_dict copy clear append extend pop items keys values join split map filter reduce push
    then catch emit on off use next reset flush log info debug warn error find list count exists post put patch toString valueOf main
    setup teardown configure connect query insert select
""".split()
CALL = ["line", "end_line", "callee", "name", "receiver", "positional", "keywords", "star_args", "star_kwargs", "awaited", "enclosing", "first"]


def normal_path(path: Column) -> Column:
    """a/b of a/./x/../b; a path that leaves its root keeps its leading ``..``."""
    step = lambda done, p: (
        F.when(p.isin("", "."), done)
        .when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(p)))
    )
    # most paths have nothing to leave out, and a fold over arrays isn't compiled
    return F.when(path.rlike(r"(^|/)\.{0,2}(/|$)"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")).otherwise(path)


def folder(path: Column) -> Column:
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def under(base: Column, name: Column) -> Column:
    return F.when(base == "", name).otherwise(F.concat_ws("/", base, name))


def without_comments(text: Column) -> Column:
    """JSON of a text with comments and trailing commas; strings stay as they are."""
    text = F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', "$1")


def aliases(files: DataFrame) -> DataFrame:
    """change_id, ord, prefix, star, target: path aliases of the head's tsconfig.json, then jsconfig.json, at the root."""
    config = F.from_json(without_comments(F.col("text")), "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")
    # as a generator's row each text is read once; as a column it would be read again for every field and filter
    found = files.where("side = 'head' and path in ('tsconfig.json', 'jsconfig.json')").select("change_id", (F.col("path") == "jsconfig.json").cast("int").alias("f"), F.explode(F.array(config["compilerOptions"])).alias("o"))
    each = found.select("change_id", "f", F.coalesce("o.baseUrl", F.lit(".")).alias("base"), F.posexplode("o.paths").alias("k", "alias", "targets"))
    each = each.select("change_id", "f", "k", "base", "alias", F.posexplode("targets").alias("t", "target"))
    plain = lambda c: F.regexp_replace(c, r"\*$", "")
    return each.select("change_id", F.struct("f", "k", "t").alias("ord"), plain("alias").alias("prefix"), F.col("alias").endswith("*").alias("star"), F.concat(normal_path(under(F.col("base"), plain("target"))), F.when(F.col("target").rlike(r"(^|/)\*$"), "/").otherwise("")).alias("target"))


def names(paths: DataFrame) -> DataFrame:
    """change_id, key, target, ord, tail: what a module's path may stand for. = is a Python file by its whole path, ~ by a path
    suffix that one file has (or one outside of tests), @ a script by its path, or without one of SCRIPTS, or /index and
    one of them: tail is 0, or the place of what is left out in that order."""
    python = paths.where(language(F.col("path")) == "python").withColumn("stem", F.regexp_replace("path", r"(?i)(/__init__)?\.pyi?$", ""))
    order = F.when(F.col("path").endswith("/__init__.py"), 1).when(F.col("path").endswith(".pyi"), 2).otherwise(0)
    row = lambda mark, name, target, order, tail=F.lit(0): ("change_id", F.concat(F.lit(mark), name).alias("key"), target.alias("target"), order.alias("ord"), tail.alias("tail"))
    whole = python.select(*row("=", F.col("stem"), F.col("path"), order))
    levels = F.length("stem") - F.length(F.replace(F.col("stem"), F.lit("/"), F.lit(""))) + 1
    ends = python.select("change_id", "path", "stem", F.explode(F.sequence(F.lit(1), levels)).alias("k")).select("change_id", "path", F.expr("substring_index(stem, '/', -k)").alias("suffix"))
    outside = F.when(~F.substring_index("path", "/", 1).contains("test"), F.col("path"))
    # one path is both the least and the greatest: counting distinct ones would multiply the rows and shuffle them twice;
    # few rows meet before the shuffle, so they are sorted only behind it
    least = ends.repartition("change_id", "suffix").groupBy("change_id", "suffix").agg(F.min("path").alias("only"), F.max("path").alias("last"), F.min(outside).alias("plain"), F.max(outside).alias("plain_last"))
    target = F.when(F.col("only") == F.col("last"), F.col("only")).when(F.col("plain") == F.col("plain_last"), F.col("plain"))
    suffix = least.withColumn("target", target).where("target is not null").select(*row("~", F.col("suffix"), F.col("target"), F.lit(0)))
    ending = lambda of: F.coalesce(*[F.when(F.col("path").endswith(t), F.lit(of(t, k))) for k, t in enumerate(SCRIPTS, 1)])
    cut = lambda n: F.left("path", F.length("path") - n)
    scripts = paths.where(language(F.col("path")).isin("javascript", "typescript")).select("change_id", "path", ending(lambda t, k: k).alias("k"), ending(lambda t, k: len(t)).alias("n"))
    entry = lambda base, tail: F.struct(base.alias("base"), tail.alias("tail"))
    ended = F.array(entry(F.col("path"), F.lit(0)), F.when(F.col("n").isNotNull(), entry(cut(F.col("n")), F.col("k"))), F.when(cut(F.col("n")).endswith("/index"), entry(cut(F.col("n") + len("/index")), F.col("k") + len(SCRIPTS))))
    scripts = scripts.select("change_id", "path", F.explode(ended).alias("e")).where("e is not null")
    return whole.unionByName(suffix).unionByName(scripts.select(*row("@", F.col("e.base"), F.col("path"), F.lit(0), F.col("e.tail"))))


def resolved_imports(index: DataFrame, files: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Head imports with the file they mean: change_id, path, line, local_name, imported_name, kind, module, target, refers.

    refers is ``module`` if the local name stands for the file, ``symbol`` if for something in it. Each import has ranked
    candidates; of those that exist the least rank wins. Imports of files that the change doesn't have are left out.
    files (change_id, side, path, text) bring path aliases; paths (change_id, path) stand for the head's files.
    """
    # written tables compress so well that a plan by their size would send sides as large as the code to the driver
    head = of_head(index).hint("merge")
    imports = part(head, "imports").select("change_id", "path", "line", "module", "imported_name", "local_name", "kind", "level")
    dotted = F.regexp_replace("module", r"\.", "/")
    up = F.when(F.col("level") <= 1, folder(F.col("path"))).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("level"), F.lit(1))), F.col("path"), lambda p, _: folder(p)))
    relative = F.when(F.col("module") == "", up).otherwise(under(up, dotted))
    where = F.when(F.col("level") > 0, F.concat(F.lit("="), relative)).otherwise(F.concat(F.lit("~"), dotted))
    is_python = language(F.col("path")) == "python"
    placed = imports.where(is_python).withColumn("place", F.explode(F.array(where)))
    option = lambda rank, key, refers: F.struct(F.lit(rank).alias("rank"), key.alias("key"), F.lit(refers).alias("refers"))
    inner = F.concat(F.substring("place", 1, 1), under(F.substring("place", 2, 1 << 20), F.col("imported_name")))
    first = F.when(F.col("kind") == "module", option(0, F.col("place"), "module")).when(F.col("kind") == "name", option(0, inner, "module"))
    second = F.when(~F.col("kind").eqNullSafe("module"), option(10, F.col("place"), "symbol"))
    asked = placed.withColumn("option", F.explode(F.array(first, second))).where("option is not null")

    scripts = imports.where(~is_python)
    local = scripts.where(F.col("module").startswith(".")).withColumn("base", normal_path(under(folder(F.col("path")), F.col("module")))).withColumn("ord", F.struct(F.lit(0).alias("f"), F.lit(0).alias("k"), F.lit(0).alias("t")))
    bases = local
    if files is not None:
        known = aliases(files)
        fits = (F.col("module") == F.regexp_replace("prefix", "/$", "")) | (F.col("star") & F.col("module").startswith(F.col("prefix")))
        rest = F.when(F.col("star"), F.expr("substring(module, length(prefix) + 1)")).otherwise("")
        bases = local.unionByName(scripts.where(~F.col("module").startswith(".")).join(known.hint("merge"), "change_id").where(fits).withColumn("base", normal_path(F.concat("target", rest))).drop("prefix", "star", "target"))
    kept = ["change_id", "path", "line", "module", "imported_name", "local_name", "kind"]
    # a script's import is one key, and each file has the few that may mean it
    tried = bases.where(~F.col("base").startswith("..")).select(*kept, F.col("ord").alias("rank"), F.concat(F.lit("@"), "base").alias("key"), F.when(F.col("kind") == "namespace", "module").otherwise("symbol").alias("refers"))
    row = F.struct(F.col("rank").alias("f"), F.lit(0).alias("k"), F.lit(0).alias("t"))
    every = asked.select(*kept, "option.*").withColumn("rank", row).unionByName(tried)
    hit = every.hint("merge").join(names(head.select("change_id", "path") if paths is None else paths), ["change_id", "key"]).withColumn("rank", F.struct("rank.*", "tail"))
    best = hit.groupBy(*kept).agg(F.min(F.struct("rank", "ord", "target", "refers")).alias("b"))
    return best.select(*kept, "b.target", "b.refers")


def references(index: DataFrame, imports: DataFrame) -> DataFrame:
    """Uses in the head of what the head or base defines, each once: change_id, target, symbol (qualified name), path, line,
    kind (call, import), resolution (resolved, name_only), drop_first (the receiver takes the first parameter), call fields.

    Calls are tied to a module's own names by imports, to methods by self and its kin within the class, by the class's
    names elsewhere, or else by name alone where the name has one definition and isn't common. A use found in two ways
    counts once, as resolved if one of them is.
    """
    index, imports = index.hint("merge"), imports.hint("merge")
    head = of_head(index)
    calls = part(head, "calls")
    symbols = index.select("change_id", "path", F.explode("symbols").alias("s")).select("change_id", "path", "s.qualname", "s.name", "s.parent", "s.kind", "s.decorators")
    keep = ["change_id", "target", "symbol", "path", "kind", "resolution", "drop_first", *CALL]
    at = imports.select("change_id", "path", "local_name", "imported_name", F.col("target").alias("to"), "refers", "module", F.col("kind").alias("how"), F.col("line").alias("import_line"))
    of_symbols = at.where("refers = 'symbol' and imported_name is not null and imported_name <> '*'")
    marked = lambda name: F.exists("decorators", lambda d: F.regexp_replace(d, r"\(.*", "").endswith(name))
    python = language(F.col("defined_in")) == "python"
    methods = symbols.where("parent is not null and kind in ('method', 'function', 'test')").distinct().select("change_id", F.col("path").alias("defined_in"), "qualname", "name", "parent", marked("staticmethod").alias("static"), marked("classmethod").alias("of_class"))
    binds, bound = python & ~F.col("static"), python & F.col("of_class")
    itself = ("self", "cls", "this")
    class_name = F.regexp_extract("parent", r"[^.]+$", 0)
    key = lambda mark, *parts: F.concat(F.lit(mark), F.concat_ws("\0", *parts))

    def means(rows: DataFrame, at: Column, key: Column, target: Column | None, symbol: Column | None, drop: Column | bool = False, parent: Column | None = None, resolution: str = "resolved") -> DataFrame:
        given = {"target": target, "symbol": symbol, "parent": parent}
        return rows.select("change_id", at.alias("at"), key.alias("key"), F.lit(resolution).alias("resolution"), (F.lit(drop) if isinstance(drop, bool) else drop).alias("drop_first"), *[(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in given.items()])

    # every way that a call finds what it means is a key in its file (or of the change), so that calls meet all of them in one
    # join: n a plain name, m a module, c a class and its method, s a method of self, g a telling name alone
    spelled = F.when((F.col("how") == "module") & F.col("module").startswith(F.concat(F.col("local_name"), F.lit("."))), F.col("module")).otherwise(F.col("local_name"))
    there = methods.withColumn("imported_name", class_name).join(of_symbols.select("change_id", F.col("to").alias("defined_in"), "imported_name", F.col("path"), F.col("local_name").alias("receiver")), ["change_id", "defined_in", "imported_name"]).where("path <> defined_in")
    # one definition is both the least and the greatest, as in names
    place = F.struct("path", "qualname")
    single = symbols.where("kind in ('method', 'function') and path is not null").groupBy("change_id", "name").agg(F.min(place).alias("only"), F.max(place).alias("last")).where("only = last").select("change_id", "name")
    telling = single.where((F.length("name") >= 4) & ~F.col("name").isin(*COMMON_NAMES) & ~F.col("name").startswith("__"))
    defined, qualname, name = F.col("defined_in"), F.col("qualname"), F.col("name")
    meant = [
        means(of_symbols, F.col("path"), key("n", F.col("local_name")), F.col("to"), F.col("imported_name")),
        # an imported name isn't the file's own, whatever file it comes from
        means(head.select("change_id", "path", F.explode(F.array_distinct("imports.local_name")).alias("local_name")), F.col("path"), key("n", F.col("local_name")), None, None),
        means(at.where("refers = 'module'"), F.col("path"), key("m", spelled), F.col("to"), None),
        means(methods, defined, key("s", name), defined, qualname, binds, F.col("parent")),
        means(methods, defined, key("c", class_name, name), defined, qualname, bound),
        means(there, F.col("path"), key("c", F.col("receiver"), name), defined, qualname, bound),
        means(methods.join(telling, ["change_id", "name"]), F.lit(""), key("g", name), defined, qualname, binds, None, "name_only"),
    ]
    receiver, alone = F.col("receiver"), F.col("receiver").isNull()
    own = F.col("receiver").isin(*itself)
    asks = lambda at, key: F.struct(at.alias("at"), key.alias("key"))
    by = F.array(F.when(alone, asks(F.col("path"), key("n", name))).otherwise(asks(F.col("path"), key("m", receiver))), F.when(~alone, asks(F.col("path"), key("c", receiver, name))), F.when(own, asks(F.col("path"), key("s", name))).when(~alone, asks(F.lit(""), key("g", name))))
    asked = calls.select("change_id", "path", *CALL, F.explode(by).alias("ask")).where("ask is not null").select("change_id", "path", *CALL, "ask.at", "ask.key")
    hit = asked.join(reduce(DataFrame.unionByName, meant).hint("merge"), ["change_id", "at", "key"], "left")
    # a plain name that nothing brings into the file is its own
    mine = F.col("resolution").isNull() & alone
    found = hit.where((F.col("target").isNotNull() & (F.col("parent").isNull() | F.col("enclosing").startswith(F.concat("parent", F.lit("."))))) | mine)
    called = found.select("change_id", F.coalesce("target", "path").alias("target"), F.coalesce("symbol", "name").alias("symbol"), "path", F.lit("call").alias("kind"), F.coalesce("resolution", F.lit("resolved")).alias("resolution"), F.coalesce("drop_first", F.lit(False)).alias("drop_first"), *CALL)

    empty = {"positional": F.lit(None).cast("int"), "keywords": F.lit(None).cast("array<string>"), "star_args": F.lit(None).cast("boolean"), "star_kwargs": F.lit(None).cast("boolean"), "awaited": F.lit(None).cast("boolean"), "enclosing": F.lit(None).cast("string"), "receiver": F.lit(None).cast("string"), "first": F.lit(None).cast("string")}
    uses = of_symbols.select("change_id", F.col("to").alias("target"), F.col("imported_name").alias("symbol"), "path", F.lit("import").alias("kind"), F.lit("resolved").alias("resolution"), F.lit(False).alias("drop_first"), F.col("import_line").alias("line"), F.col("import_line").alias("end_line"), F.col("imported_name").alias("callee"), F.col("imported_name").alias("name"), *[c.alias(n) for n, c in empty.items()])
    every = called.select(keep).unionByName(uses.select(keep))
    # max of a struct: resolved comes after name_only
    rest = [c for c in keep if c not in ("change_id", "target", "symbol", "path", "line", "kind", "callee")]
    best = every.groupBy("change_id", "target", "symbol", "path", "line", "kind", "callee").agg(F.max(F.struct("resolution", *[c for c in rest if c != "resolution"])).alias("b"))
    return best.select("change_id", "target", "symbol", "path", "line", "kind", "callee", "b.*").select(keep)
