"""Python files as tables of scopes' bindings and uses, in the order in which they run; names are resolved by joins."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .python_code import FUNCTIONS, dotted

ROW = "kind string, scope int, name string, ord int, line int, binding string, forks array<string>, chain array<struct<scope: int, ordered: boolean>>"
SCHEMA = f"change_id string, side string, path string, {ROW}"
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


class Reader:
    """Walks a module as it runs: values before targets, bodies of functions in scopes of their own.

    Rows of kind ``bind``, ``use``, ``export`` (a name in __all__), or a code of a statement out of place. A use carries
    the scopes that it sees, nearest first; ``ordered`` means that only what is bound before it counts there, which holds
    until a function's border is crossed, as its body runs later.
    """

    def __init__(self):
        self.rows: list[dict] = []
        self.kinds = ["module"]
        self.parents = [-1]
        self.scope = 0
        self.forks: list[str] = []
        self.globals: dict[int, dict[str, int]] = {0: {}}
        self.is_async = [True]
        self.late = False
        self.guarded = 0

    def row(self, kind: str, scope: int, name: str, line: int, binding: str | None = None, chain: list[dict] | None = None) -> None:
        self.rows.append({"kind": kind, "scope": scope, "name": name, "ord": len(self.rows), "line": line, "binding": binding, "forks": list(self.forks), "chain": chain})

    def bind(self, name: str, node: ast.AST, binding: str = "assign", scope: int | None = None) -> None:
        scope = self.scope if scope is None else scope
        to = self.globals[scope].get(name, scope)
        if to >= 0:
            self.row("bind", to, name, getattr(node, "lineno", 1), binding)

    def use(self, name: str, node: ast.AST) -> None:
        chain, s, ordered = [], self.scope, not self.late
        outer = self.globals[s].get(name, s)
        if outer != s:
            s, ordered = max(outer, 0) if outer >= 0 else self.parents[s], False
        first = True
        while s >= 0:
            # a class's names are seen by its own statements, not from functions within it
            if self.kinds[s] != "class" or first:
                chain.append({"scope": s, "ordered": ordered})
            ordered = ordered and self.kinds[s] not in ("function", "lambda")
            first = first and self.kinds[s] == "comprehension"
            s = self.parents[s]
        if not self.guarded:
            self.row("use", self.scope, name, node.lineno, None, chain)

    def enter(self, kind: str) -> int:
        self.kinds.append(kind)
        self.parents.append(self.scope)
        self.scope = len(self.kinds) - 1
        self.globals[self.scope] = {}
        return self.scope

    def leave(self) -> None:
        self.scope = self.parents[self.scope]

    def visit(self, node: ast.AST | Iterable[ast.AST] | None) -> None:
        if node is None:
            return
        if not isinstance(node, ast.AST):
            for n in node:
                self.visit(n)
            return
        handle = getattr(self, type(node).__name__, None)
        if handle:
            handle(node)
        else:
            self.visit(ast.iter_child_nodes(node))

    def Name(self, n: ast.Name) -> None:
        if isinstance(n.ctx, ast.Load):
            self.use(n.id, n)
        elif isinstance(n.ctx, ast.Store):
            self.bind(n.id, n)

    def NamedExpr(self, n: ast.NamedExpr) -> None:
        self.visit(n.value)
        s = self.scope
        while self.kinds[s] == "comprehension":
            s = self.parents[s]
        self.bind(n.target.id, n.target, scope=s)

    def Assign(self, n: ast.Assign) -> None:
        self.visit(n.value)
        self.visit(n.targets)
        self.exports(n.targets, n.value)

    def AugAssign(self, n: ast.AugAssign) -> None:
        self.visit(n.value)
        if isinstance(n.target, ast.Name):
            self.use(n.target.id, n.target)
        self.visit(n.target)
        self.exports([n.target], n.value)

    def AnnAssign(self, n: ast.AnnAssign) -> None:
        self.annotation(n.annotation)
        self.visit(n.value)
        if n.value is not None or not isinstance(n.target, ast.Name):
            self.visit(n.target)
        else:
            self.bind(n.target.id, n.target, "annotation")

    def exports(self, targets: list, value: ast.AST) -> None:
        if self.scope == 0 and any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(value, (ast.List, ast.Tuple)):
            for e in value.elts:
                if isinstance(e, ast.Constant) and isinstance(e.value, str):
                    self.row("export", 0, e.value, e.lineno)

    def annotation(self, n: ast.AST | None) -> None:
        was, self.late = self.late, self.late or self.postponed
        self.visit(n)
        self.late = was

    def For(self, n: ast.For) -> None:
        self.visit(n.iter)
        self.visit(n.target)
        self.visit(n.body)
        self.visit(n.orelse)

    AsyncFor = For

    def comprehension(self, n: ast.AST) -> None:
        self.visit(n.generators[0].iter)
        self.enter("comprehension")
        for k, g in enumerate(n.generators):
            if k:
                self.visit(g.iter)
            self.visit(g.target)
            self.visit(g.ifs)
        self.visit([n.key, n.value] if isinstance(n, ast.DictComp) else [n.elt])
        self.leave()

    ListComp = SetComp = DictComp = GeneratorExp = comprehension

    def Import(self, n: ast.Import) -> None:
        for a in n.names:
            self.bind(a.asname or a.name.split(".")[0], n, "import" if a.asname or "." not in a.name else "submodule")

    def ImportFrom(self, n: ast.ImportFrom) -> None:
        for a in n.names:
            self.bind(a.asname or a.name, n, "future" if n.module == "__future__" else "import")

    def Global(self, n: ast.Global) -> None:
        self.globals[self.scope] |= dict.fromkeys(n.names, 0)
        for name in n.names:
            self.row("bind", 0, name, n.lineno, "global")

    def Nonlocal(self, n: ast.Nonlocal) -> None:
        self.globals[self.scope] |= dict.fromkeys(n.names, -1)

    def typed(self, n: ast.AST) -> bool:
        params = getattr(n, "type_params", None)
        if params:
            self.enter("types")
            for p in params:
                self.bind(p.name, p, "argument")
                self.visit(getattr(p, "bound", None))
        return bool(params)

    def function(self, n: ast.AST) -> None:
        self.visit(n.decorator_list)
        args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs, *filter(None, (n.args.vararg, n.args.kwarg))]
        self.visit([*n.args.defaults, *filter(None, n.args.kw_defaults)])
        typed = self.typed(n)
        for a in [*(x.annotation for x in args), n.returns]:
            self.annotation(a)
        outside = self.parents[self.scope] if typed else self.scope
        overload = any((dotted(d) or "").rpartition(".")[2] == "overload" for d in n.decorator_list)
        self.bind(n.name, n, "overload" if overload else "definition", scope=outside)
        self.body(args, n.body, isinstance(n, ast.AsyncFunctionDef), "function")
        if typed:
            self.leave()

    FunctionDef = AsyncFunctionDef = function

    def body(self, args: list, body: list, is_async: bool, kind: str) -> None:
        forks, self.forks = self.forks, []
        late, self.late = self.late, False
        self.enter(kind)
        self.is_async.append(is_async)
        for a in args:
            self.bind(a.arg, a, "argument")
        self.visit(body)
        self.is_async.pop()
        self.leave()
        self.forks, self.late = forks, late

    def Lambda(self, n: ast.Lambda) -> None:
        self.visit([*n.args.defaults, *filter(None, n.args.kw_defaults)])
        args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs, *filter(None, (n.args.vararg, n.args.kwarg))]
        self.body(args, [n.body], False, "lambda")

    def ClassDef(self, n: ast.ClassDef) -> None:
        self.visit(n.decorator_list)
        typed = self.typed(n)
        self.visit([*n.bases, *(k.value for k in n.keywords)])
        outside = self.parents[self.scope] if typed else self.scope
        self.enter("class")
        for name in ("__module__", "__qualname__"):
            self.bind(name, n)
        self.visit(n.body)
        self.leave()
        if typed:
            self.leave()
        self.bind(n.name, n, "definition", scope=outside)

    def TypeAlias(self, n: ast.TypeAlias) -> None:
        self.bind(n.name.id, n.name)
        typed = self.typed(n)
        was, self.late = self.late, True  # the value is only looked at when asked for
        self.visit(n.value)
        self.late = was
        if typed:
            self.leave()

    def arms(self, n: ast.AST, *arms: list) -> None:
        for k, arm in enumerate(arms):
            self.forks.append(f"{n.lineno}.{n.col_offset}:{k}")
            self.visit(arm)
            self.forks.pop()

    def If(self, n: ast.If) -> None:
        self.visit(n.test)
        self.arms(n, n.body, n.orelse)

    def Try(self, n: ast.Try) -> None:
        catches = any("NameError" in (dotted(t) or "") for h in n.handlers for t in (h.type.elts if isinstance(h.type, ast.Tuple) else [h.type]))
        self.guarded += catches
        self.arms(n, [*n.body, *n.orelse], *[[h] for h in n.handlers])
        self.guarded -= catches
        self.visit(n.finalbody)

    TryStar = Try

    def ExceptHandler(self, n: ast.ExceptHandler) -> None:
        self.visit(n.type)
        if n.name:
            self.bind(n.name, n)
        self.visit(n.body)

    def Match(self, n: ast.Match) -> None:
        self.visit(n.subject)
        self.arms(n, *[[c] for c in n.cases])

    def named(self, n: ast.AST) -> None:
        self.visit(ast.iter_child_nodes(n))
        name = n.rest if isinstance(n, ast.MatchMapping) else n.name
        if name:
            self.bind(name, n)

    MatchAs = MatchStar = MatchMapping = named

    def inside(self) -> str:
        s = self.scope
        while self.kinds[s] in ("comprehension", "types"):
            s = self.parents[s]
        return self.kinds[s]

    def Return(self, n: ast.Return) -> None:
        if self.inside() in ("module", "class"):
            self.row("F706", self.scope, "return", n.lineno)
        self.visit(n.value)

    def Yield(self, n: ast.AST) -> None:
        if self.inside() in ("module", "class"):
            self.row("F704", self.scope, "yield", n.lineno)
        self.visit(n.value)

    YieldFrom = Yield

    def Await(self, n: ast.Await) -> None:
        if self.inside() in ("module", "class"):
            self.row("F704", self.scope, "await", n.lineno)
        elif not self.is_async[-1]:
            self.row("PLE1142", self.scope, "await", n.lineno)
        self.visit(n.value)

    postponed = False


def read(text: str) -> list[dict]:
    """A file's rows; one that doesn't parse has none. Statements out of place are no syntax errors to the parser."""
    try:
        tree = ast.parse(text)
        r = Reader()
        r.postponed = any(isinstance(n, ast.ImportFrom) and n.module == "__future__" and any(a.name == "annotations" for a in n.names) for n in tree.body)
        r.visit(tree.body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return r.rows


def scope_rows(files: DataFrame) -> DataFrame:
    """change_id, side, path, text of Python files to their bindings, uses, exports and statements out of place."""

    fields = pa.schema([(c, pa.string()) for c in ("change_id", "side", "path")] + [("kind", pa.string()), ("scope", pa.int32()), ("name", pa.string()), ("ord", pa.int32()), ("line", pa.int32()), ("binding", pa.string()), ("forks", pa.list_(pa.string())), ("chain", pa.list_(pa.struct([("scope", pa.int32()), ("ordered", pa.bool_())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [{"change_id": f["change_id"], "side": f["side"], "path": f["path"], **row} for f in b.to_pylist() for row in read(f["text"] or "")]
            for k in range(0, len(found), 20_000):
                yield pa.RecordBatch.from_pylist(found[k : k + 20_000], schema=fields)

    return files.where(F.lower("path").rlike(r"\.pyi?$")).select("change_id", "side", "path", "text").mapInArrow(run, SCHEMA)
