"""Diagnostics of Python files from the standard parser, and those that a change brings: codes by public linter rules."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import new_in_head
from .python_code import FUNCTIONS, dotted, own

SQL = "change_id string, side string, path string, line int, ord int, code string, message string"
#: Codes by the call that they flag (fixed values: code, callee).
CALLS = {
    "eval": "S307", "exec": "S102", "pickle.load": "S301", "pickle.loads": "S301", "os.system": "S605", "os.popen": "S605", "breakpoint": "T100", "pdb.set_trace": "T100", "print": "T201", "pprint.pprint": "T203", "tempfile.mktemp": "S306",
    "hashlib.md5": "S324", "hashlib.sha1": "S324", "random.random": "S311", "random.randint": "S311", "random.choice": "S311", "ssl._create_unverified_context": "S323",
}
BLOCKING = {"time.sleep": "ASYNC251", "open": "ASYNC230", "os.system": "ASYNC221", "subprocess.run": "ASYNC221", "subprocess.call": "ASYNC221", "subprocess.check_output": "ASYNC221", "subprocess.Popen": "ASYNC220", "requests.get": "ASYNC210", "requests.post": "ASYNC210", "requests.request": "ASYNC210", "urllib.request.urlopen": "ASYNC210"}
HTTP = re.compile(r"requests\.(get|post|put|patch|delete|head|options|request)|httpx\.(get|post|put|patch|delete|head|options|request)")
STATEMENT = re.compile(r"(?is)^\s*(select\b.*\bfrom\b|insert\s+into\b|update\b.*\bset\b|delete\s+from\b)")
PASSWORD = re.compile(r"(?i)(^|_)(pass(wo?rd)?|pwd|secret|token)($|_)")
MUTABLE = (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)


def constant(node: ast.AST | None) -> object:
    return node.value if isinstance(node, ast.Constant) else None


def text_of(node: ast.AST) -> str | None:
    """The known parts of a string that is put together, or null for a plain one."""
    if isinstance(node, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in node.values):
        return "".join(str(constant(v)) if isinstance(v, ast.Constant) else "?" for v in node.values)
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod)) and not isinstance(node.right, ast.Constant):
        left = node.left
        while isinstance(left, ast.BinOp):
            left = left.left
        return constant(left) if isinstance(constant(left), str) else None
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format" and isinstance(constant(node.func.value), str):
        return constant(node.func.value)
    return None


def own_names(node: ast.AST) -> Iterator[ast.Name]:
    """Names of an expression that aren't bound within it by a comprehension or a lambda."""
    inner: set[str] = set()
    for n in ast.walk(node):
        if isinstance(n, ast.comprehension):
            inner |= {x.id for x in ast.walk(n.target) if isinstance(x, ast.Name)}
        elif isinstance(n, ast.Lambda):
            inner |= {a.arg for a in [*n.args.args, *n.args.kwonlyargs]}
    yield from (n for n in ast.walk(node) if isinstance(n, ast.Name) and n.id not in inner)


def at_call(n: ast.Call, full: str) -> Iterator[str]:
    given = {k.arg: k.value for k in n.keywords if k.arg}
    if full in CALLS:
        yield CALLS[full]
    if full in ("yaml.load", "yaml.load_all") and "Safe" not in (ast.unparse(n.args[1]) if len(n.args) > 1 else ast.unparse(given["Loader"]) if "Loader" in given else ""):
        yield "S506"
    if constant(given.get("verify")) is False:
        yield "S501"
    if HTTP.fullmatch(full) and "timeout" not in given:
        yield "S113"
    if constant(given.get("shell")) is True:
        yield "S602" if full.startswith("subprocess.") else "S604"
    if full.endswith(".run") and constant(given.get("debug")) is True:
        yield "S201"
    if full.endswith("Environment") and "autoescape" not in given and full.startswith(("jinja2", "Environment")):
        yield "S701"
    mode = constant(n.args[1]) if len(n.args) > 1 else constant(given.get("mode"))
    # writable by all, or executable by all
    if full == "os.chmod" and isinstance(mode, int) and mode & 0o022 | mode & 0o111:
        yield "S103"
    if full.endswith(".extractall"):
        yield "S202"
    if any(k and PASSWORD.search(k) and isinstance(constant(v), str) and constant(v) for k, v in given.items()):
        yield "S106"


def diagnostics(text: str) -> list[tuple[int, str, str]]:
    """(line, code, message) in order of line; a file that doesn't parse has just its syntax error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(getattr(e, "lineno", None) or 1, "invalid-syntax", str(getattr(e, "msg", None) or e))]
    names = {a.asname or a.name.split(".")[0]: (a.name if a.asname else a.name.split(".")[0]) for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
    names |= {a.asname or a.name: f"{n.module}.{a.name}" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module and not n.level for a in n.names}
    out: list[tuple[int, str, str]] = []
    say = lambda n, code, more="": out.append((n.lineno, code, more))

    def full(node: ast.AST) -> str:
        head, dot, rest = (dotted(node) or "").partition(".")
        return names.get(head, head) + dot + rest

    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            for code in at_call(n, full(n.func)):
                say(n, code, dotted(n.func) or "")
        elif isinstance(n, ast.ExceptHandler):
            if n.type is None:
                say(n, "E722")
            elif dotted(n.type) in ("Exception", "BaseException") and not any(isinstance(x, ast.Raise) for x in own(n)):
                say(n, "BLE001", dotted(n.type))
            if len(n.body) == 1 and isinstance(n.body[0], (ast.Pass, ast.Continue)):
                say(n, "S110" if isinstance(n.body[0], ast.Pass) else "S112")
            for r in own(n):
                if isinstance(r, ast.Raise) and isinstance(r.exc, ast.Call) and r.cause is None:
                    say(r, "B904")
        elif isinstance(n, FUNCTIONS):
            for a, d in zip([*n.args.posonlyargs, *n.args.args][::-1], n.args.defaults[::-1], strict=False):
                if isinstance(d, MUTABLE) or (isinstance(d, ast.Call) and dotted(d.func) in ("list", "dict", "set")):
                    say(d, "B006", a.arg)
                elif isinstance(d, ast.Call):
                    say(d, "B008", dotted(d.func) or "")
                if PASSWORD.search(a.arg) and isinstance(constant(d), str) and constant(d):
                    say(d, "S107", a.arg)
            if isinstance(n, ast.AsyncFunctionDef):
                for c in own(n):
                    if isinstance(c, ast.Call) and full(c.func) in BLOCKING:
                        say(c, BLOCKING[full(c.func)], dotted(c.func) or "")
        elif isinstance(n, ast.Assert) and constant(n.test) is False:
            say(n, "B011")
        elif isinstance(n, ast.Try):
            for x in (y for s in n.finalbody for y in [s, *own(s)] if isinstance(y, (ast.Return, ast.Break, ast.Continue))):
                say(x, "B012", type(x).__name__.lower())
        elif isinstance(n, ast.Expr):
            if isinstance(n.value, ast.Compare):
                say(n, "B015")
            elif isinstance(n.value, (ast.Name, ast.List, ast.Set, ast.Dict, ast.BinOp)):
                say(n, "B018")
            elif isinstance(n.value, ast.Call) and full(n.value.func) in ("asyncio.create_task", "asyncio.ensure_future"):
                say(n, "RUF006", dotted(n.value.func) or "")
        elif isinstance(n, ast.Compare) and any(isinstance(o, (ast.Is, ast.IsNot)) and isinstance(constant(c), (str, bytes, int)) and not isinstance(constant(c), bool) for o, c in zip(n.ops, n.comparators, strict=True)):
            say(n, "F632")
        elif isinstance(n, ast.Dict):
            keys = [(type(constant(k)), constant(k)) for k in n.keys if isinstance(k, ast.Constant)]
            if len(keys) > len(set(keys)):
                say(n, "F601")
        elif isinstance(n, ast.For):
            taken_over = {x.id for x in ast.walk(n.target) if isinstance(x, ast.Name)} & {x.id for x in own_names(n.iter)}
            for v in sorted(taken_over):
                say(n.target, "B020", v)
            late = {x.id for x in ast.walk(n.target) if isinstance(x, ast.Name)}
            for f in (x for s in n.body for x in [s, *own(s)] if isinstance(x, (ast.Lambda, *FUNCTIONS))):
                taken = {a.arg for a in [*f.args.args, *f.args.kwonlyargs]}
                for v in sorted({x.id for x in ast.walk(f) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)} & (late - taken)):
                    say(f, "B023", v)
        elif isinstance(n, ast.Assign) and isinstance(constant(n.value), str) and constant(n.value):
            for t in n.targets:
                if PASSWORD.search((dotted(t) or "").rpartition(".")[2]):
                    say(n, "S105", dotted(t) or "")
        if constant(n) == "0.0.0.0" and isinstance(n, ast.Constant):
            say(n, "S104")
        built = text_of(n)
        if built and STATEMENT.search(built):
            say(n, "S608")
    return sorted(set(out))


def linted(files: DataFrame) -> DataFrame:
    """change_id, side, path, text of Python files to their diagnostics. Null and empty texts have none."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(c, s, p, line, k, code, more) for c, s, p, t in b.itertuples(index=False) for k, (line, code, more) in enumerate(diagnostics(t if isinstance(t, str) else ""))]
            yield pd.DataFrame(rows, columns=["change_id", "side", "path", "line", "ord", "code", "message"])

    return files.where(F.lower("path").rlike(r"\.pyi?$")).select("change_id", "side", "path", "text").mapInPandas(run, SQL)


def new_diagnostics(files: DataFrame) -> DataFrame:
    """Those of head beyond as many equal ones of base; equal: same file, code, message and stripped source line."""
    line = files.select("change_id", "side", "path", F.split("text", "\n").alias("lines"))
    known = linted(files).join(line, ["change_id", "side", "path"]).withColumn("source", F.trim(F.coalesce(F.try_element_at("lines", F.greatest("line", F.lit(1))), F.lit("")))).drop("lines")
    keys = ["change_id", "path", "code", "message", "source"]
    return new_in_head(known.where("side = 'base'"), known.where("side = 'head'"), keys, ["line", "ord"]).select("change_id", "path", "line", F.concat(F.lit("RUFF-"), "code").alias("rule_id"), "message")
