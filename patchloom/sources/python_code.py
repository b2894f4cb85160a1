"""Python files as tables of symbols, imports, calls and identifiers: one map over files by the standard parser."""

from __future__ import annotations

import ast
import gc
import hashlib
import io
import re
import token
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAM = "struct<name: string, kind: string, has_default: boolean, `default`: string, annotation: string>"
SYMBOL = f"struct<ord: int, name: string, qualname: string, kind: string, start_line: int, end_line: int, params: array<{PARAM}>, returns: string, is_async: boolean, parent: string, exported: boolean, decorators: array<string>, complexity: int, body: string, try_blocks: int, assertions: int>"
IMPORT = "struct<line: int, module: string, imported_name: string, local_name: string, kind: string, level: int>"
CALL = "struct<line: int, end_line: int, callee: string, name: string, receiver: string, positional: int, keywords: array<string>, star_args: boolean, star_kwargs: boolean, awaited: boolean, enclosing: string, first: string>"
TEXT, INT, FLAG = pa.string(), pa.int32(), pa.bool_()
#: The same types as Arrow has them.
PARAM_ARROW = pa.struct({"name": TEXT, "kind": TEXT, "has_default": FLAG, "default": TEXT, "annotation": TEXT})
SYMBOL_ARROW = pa.struct({"ord": INT, "name": TEXT, "qualname": TEXT, "kind": TEXT, "start_line": INT, "end_line": INT, "params": pa.list_(PARAM_ARROW), "returns": TEXT, "is_async": FLAG, "parent": TEXT, "exported": FLAG, "decorators": pa.list_(TEXT), "complexity": INT, "body": TEXT, "try_blocks": INT, "assertions": INT})
IMPORT_ARROW = pa.struct({"line": INT, "module": TEXT, "imported_name": TEXT, "local_name": TEXT, "kind": TEXT, "level": INT})
CALL_ARROW = pa.struct({"line": INT, "end_line": INT, "callee": TEXT, "name": TEXT, "receiver": TEXT, "positional": INT, "keywords": pa.list_(TEXT), "star_args": FLAG, "star_kwargs": FLAG, "awaited": FLAG, "enclosing": TEXT, "first": TEXT})
FOUND = {"error": TEXT, "error_line": INT, "symbols": pa.list_(SYMBOL_ARROW), "imports": pa.list_(IMPORT_ARROW), "calls": pa.list_(CALL_ARROW), "identifiers": pa.list_(pa.struct({"name": TEXT, "line": INT}))}
#: Characters of texts that are parsed and handed on at once, and files (fixed values).
MOST_CHARS, MOST_FILES = 1 << 21, 2000
INDEX = {"change_id": "string", "side": "string", "path": "string", "error": "string", "error_line": "int", "symbols": f"array<{SYMBOL}>", "imports": f"array<{IMPORT}>", "calls": f"array<{CALL}>", "identifiers": "array<struct<name: string, line: int>>"}

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: What has no name, call, symbol or import in it, and the fields of each other kind of node that may hold nodes.
LEAVES = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop, ast.type_ignore, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal)
PLAIN = frozenset(("id", "attr", "ctx", "op", "ops", "type_comment", "kind", "level", "module", "is_async", "conversion", "simple", "arg", "name", "type_ignores"))
FIELDS: dict[type, tuple[str, ...]] = {}
#: The kinds of node that tell something by themselves.
TOLD = frozenset((ast.Call, *FUNCTIONS, ast.ClassDef, ast.Lambda, ast.Assign, ast.AnnAssign, ast.Import, ast.ImportFrom, ast.Await, *BRANCHES, ast.BoolOp, ast.Try))
#: Tokens of plain ASCII text: names, whole numbers, strings on one line without a prefix or backslash, and marks.
MARKS = "|".join(re.escape(m) + (r"(?!\d)" if m == "." else "") for m in sorted(token.EXACT_TOKEN_TYPES, key=len, reverse=True))
SIMPLE = re.compile(rf"""[A-Za-z_]\w*+(?!['"])|\d++(?![\w.'"])|'[^'\\\n]*+'(?!')|"[^"\\\n]*+"(?!")|{MARKS}""", re.A)


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a name or attribute, else None."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


def own(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a function's body without those of functions within it."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
            todo.extend(ast.iter_child_nodes(n))


def first_argument(call: ast.Call) -> str | None:
    """text for a plain string, built for one that is put together, other, or null without arguments."""
    if not call.args:
        return None
    a = call.args[0]
    if isinstance(a, ast.Constant) and isinstance(a.value, str):
        return "text"
    joined = isinstance(a, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in a.values)
    added = isinstance(a, ast.BinOp) and any(isinstance(x, ast.JoinedStr) or (isinstance(x, ast.Constant) and isinstance(x.value, str)) for x in ast.walk(a))
    formatted = isinstance(a, ast.Call) and isinstance(a.func, ast.Attribute) and a.func.attr == "format"
    return "built" if joined or added or formatted else "text" if isinstance(a, ast.JoinedStr) else "other"


def written(node: ast.expr | None) -> str | None:
    """An expression's source; a name or whole number is its own, without the time that building an unparser takes."""
    if node is None:
        return None
    return node.id if type(node) is ast.Name else repr(node.value) if type(node) is ast.Constant and type(node.value) is int else ast.unparse(node)


def params(args: ast.arguments) -> list[dict]:
    if not (args.posonlyargs or args.vararg or args.kwonlyargs or args.kwarg or args.defaults):
        return [{"name": a.arg, "kind": "positional", "has_default": False, "default": None, "annotation": written(a.annotation)} for a in args.args]
    plain = [(a, "positional_only") for a in args.posonlyargs] + [(a, "positional") for a in args.args]
    values: list[ast.expr | None] = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    rows = [(a, k, v) for (a, k), v in zip(plain, values, strict=True)]
    rows += [(args.vararg, "var_positional", None)] if args.vararg else []
    rows += [(a, "keyword_only", v) for a, v in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    rows += [(args.kwarg, "var_keyword", None)] if args.kwarg else []
    return [{"name": a.arg, "kind": k, "has_default": v is not None, "default": written(v), "annotation": written(a.annotation)} for a, k, v in rows]


def normal(text: str) -> str:
    """Tokens without comments and layout; of more than 20,000 characters the rest is a hash, so that any edit shows."""
    if text.isascii():
        out = " ".join(SIMPLE.findall(text))
        # nothing but blanks lies between the tokens, so they are the tokenizer's; it is asked where anything else does
        if len(out) <= 20_000 and "".join(out.split()) == "".join(text.split()) and all(text.count(a) == text.count(z) for a, z in ("()", "[]", "{}")):
            return out
    skip = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER}
    try:
        out = " ".join(t.string for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in skip)
    except (tokenize.TokenError, SyntaxError):
        out = " ".join(text.split())
    return out if len(out) <= 20_000 else f"{out[:20_000]} {hashlib.sha256(out.encode('utf-8', 'replace')).hexdigest()}"


def index(text: str) -> dict:
    """A file's symbols, imports, calls and identifiers; a file that doesn't parse has its error and none of them."""
    out: dict = {"error": None, "error_line": None, "symbols": [], "imports": [], "calls": [], "identifiers": []}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return out | {"error": str(getattr(e, "msg", None) or e), "error_line": getattr(e, "lineno", None)}
    listed = {e.value for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)) for e in n.value.elts if isinstance(e, ast.Constant)}
    try:
        walk(tree, out, text.split("\n"), listed)
    except RecursionError:
        return {"error": "nested too deeply", "error_line": None, "symbols": [], "imports": [], "calls": [], "identifiers": []}
    return out


def fields(kind: type) -> tuple[str, ...]:
    """The fields of a kind of node that may hold nodes, in order; none of a leaf or of what is no node."""
    if kind not in FIELDS:
        named = frozenset(("name",)) if kind in (ast.TypeAlias,) else frozenset()
        FIELDS[kind] = () if issubclass(kind, LEAVES) or not issubclass(kind, ast.AST) else tuple(f for f in kind._fields if f not in PLAIN or f in named)
    return FIELDS[kind]


def symbol(node: ast.AST, name: str, kind: str, above: list[str], out: dict, source: list[str], listed: set, **more) -> dict:
    """A symbol's row, added to the others; what its body holds is counted by ``walk``."""
    decorators = getattr(node, "decorator_list", [])
    public = all(not p.startswith("_") or (p.startswith("__") and p.endswith("__")) for p in [*above, name])
    row = {
        "ord": len(out["symbols"]), "name": name, "qualname": ".".join([*above, name]), "kind": kind, "start_line": min([node.lineno, *(d.lineno for d in decorators)]), "end_line": node.end_lineno, "params": None, "returns": None, "is_async": None,
        "parent": ".".join(above) or None, "exported": name in listed if listed and not above else public, "decorators": [written(d) for d in decorators],
        "complexity": 1, "body": normal("\n".join(source[node.lineno - 1 : node.end_lineno])), "try_blocks": 0, "assertions": 0,
    } | more
    out["symbols"].append(row)
    return row


def called(n: ast.Call, callee: str, receiver: str, name: str, awaited: bool, inside: str | None) -> dict:
    starred = sum(type(a) is ast.Starred for a in n.args)
    return {
        "line": n.lineno, "end_line": n.end_lineno, "callee": callee, "name": name, "receiver": receiver or None, "positional": len(n.args) - starred, "keywords": [k.arg for k in n.keywords if k.arg],
        "star_args": starred > 0, "star_kwargs": any(k.arg is None for k in n.keywords), "awaited": awaited, "enclosing": inside, "first": first_argument(n),
    }


def walk(tree: ast.Module, out: dict, source: list[str], listed: set) -> None:
    """Adds to out what stands within a file."""
    identifiers, calls, imports, awaited = out["identifiers"], out["calls"], out["imports"], set()

    def into(node: ast.AST, above: list[str], inside: str | None, in_class: bool, counted: dict | None) -> None:
        """counted is the row of the function whose body this is, or null outside of any, in a class's own body and in a lambda."""
        for field in FIELDS[type(node)]:
            value = getattr(node, field, None)
            if value is None:
                continue
            for n in value if type(value) is list else (value,):
                kind = type(n)
                while kind is ast.Attribute:
                    identifiers.append({"name": n.attr, "line": n.lineno})
                    n = n.value
                    kind = type(n)
                if kind is ast.Name:
                    identifiers.append({"name": n.id, "line": n.lineno})
                    continue
                if kind is ast.arg and n.annotation is None:
                    continue
                if not (FIELDS[kind] if kind in FIELDS else fields(kind)):
                    continue
                if kind not in TOLD:
                    into(n, above, inside, in_class, counted)
                    continue
                names, within, is_class, row = above, inside, in_class, counted
                if kind is ast.Call:
                    callee = dotted(n.func)
                    if callee:
                        receiver, _, name = callee.rpartition(".")
                        if counted is not None and name.startswith("assert"):
                            counted["assertions"] += 1
                        calls.append(called(n, callee, receiver, name, id(n) in awaited, inside))
                elif kind in FUNCTIONS:
                    what = "test" if n.name.startswith("test") else "method" if in_class else "function"
                    row = symbol(n, n.name, what, above, out, source, listed, params=params(n.args), returns=written(n.returns), is_async=kind is ast.AsyncFunctionDef)
                    names, within, is_class = [*above, n.name], row["qualname"], False
                elif kind is ast.ClassDef:
                    symbol(n, n.name, "class", above, out, source, listed)
                    names, is_class, row = [*above, n.name], True, None
                elif kind is ast.Lambda:
                    row = None
                elif kind in (ast.Assign, ast.AnnAssign):
                    if inside is None:
                        for t in n.targets if kind is ast.Assign else [n.target]:
                            if isinstance(t, ast.Name):
                                symbol(n, t.id, "variable", above, out, source, listed)
                elif kind is ast.Import:
                    imports.extend({"line": n.lineno, "module": a.name, "imported_name": None, "local_name": a.asname or a.name.split(".")[0], "kind": "module", "level": 0} for a in n.names)
                    continue
                elif kind is ast.ImportFrom:
                    imports.extend({"line": n.lineno, "module": n.module or "", "imported_name": a.name, "local_name": a.asname or a.name, "kind": "wildcard" if a.name == "*" else "name", "level": n.level} for a in n.names)
                    continue
                elif kind is ast.Await:
                    if isinstance(n.value, ast.Call):
                        awaited.add(id(n.value))
                elif counted is not None:
                    if kind in BRANCHES:
                        counted["complexity"] += 1
                        counted["assertions"] += kind is ast.Assert
                    elif kind is ast.BoolOp:
                        counted["complexity"] += len(n.values) - 1
                    elif kind is ast.Try:
                        counted["try_blocks"] += 1
                into(n, names, within, is_class, row)

    fields(type(tree))
    into(tree, [], None, False, None)


def indexed(files: DataFrame, *parts: str) -> DataFrame:
    """change_id, side, path, text of Python files to one row a file with all that ``index`` finds. Null texts are empty."""

    return parsed(files.where(F.lower("path").rlike(r"\.pyi?$")), lambda _: index, *parts)


def parsed(files: DataFrame, parser: Callable[[str], Callable[[str], dict]], *parts: str, once: bool = False) -> DataFrame:
    """Files to rows of INDEX by the parser of each path, of what is found only these parts if any are named. A text that both
    sides of a change have, side by side, is parsed once, and with ``once`` is one row of the side ``both``; rows go on in pieces
    of bounded text."""
    kinds = {c: t for c, t in FOUND.items() if c in parts or not parts}

    def rows_of(keys: list[tuple], found: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([k[i] for k in keys], TEXT) for i in range(3)] + [pa.array([f[c] for f in found], t) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, names=["change_id", "side", "path", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a piece's rows are plain lists without cycles: looking through them for garbage again and again takes longer than they
        gc.freeze()
        gc.set_threshold(100_000)
        for b in batches:
            keys, found, seen, size, last = [], [], {}, 0, None
            for *key, text in zip(*(b.column(c).to_pylist() for c in ("change_id", "side", "path", "text")), strict=True):
                text, parse = text or "", parser(key[2])
                if once and keys and last == text and keys[-1][::2] == key[::2] and {keys[-1][1], key[1]} == {"base", "head"}:
                    keys[-1][1] = "both"
                    continue
                last = text
                if (parse, text) not in seen:
                    seen[parse, text] = parse(text)
                    size += len(text)
                keys.append(key)
                found.append(seen[parse, text])
                if size >= MOST_CHARS or len(keys) >= MOST_FILES:
                    yield rows_of(keys, found)
                    keys, found, seen, size = [], [], {}, 0
            if keys:
                yield rows_of(keys, found)

    schema = ", ".join(f"{c} {t}" for c, t in INDEX.items() if c in ("change_id", "side", "path", *kinds))
    return files.select("change_id", "side", "path", "text").mapInArrow(run, schema)


def part(files: DataFrame, name: str) -> DataFrame:
    """One of the index's arrays as rows: change_id, side, path and the fields of its elements."""
    return files.select("change_id", "side", "path", F.explode(name).alias("x")).select("change_id", "side", "path", "x.*")
