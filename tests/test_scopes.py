import ast
import symtable

import pytest

from patchloom.plans.scope_rules import GIVEN, new_scope_diagnostics, scope_diagnostics

FILES = "change_id string, side string, path string, text string"
CASES = [
    ("x\n", {(1, "F821", "x")}),
    ("print(a)\na = 1\n", {(1, "F821", "a")}),
    ("def f():\n    return later\nlater = 1\n", set()),
    ("def f():\n    return nowhere\n", {(2, "F821", "nowhere")}),
    ("n = 1\ndef f():\n    print(n)\n    n = 2\n", {(3, "F823", "n")}),
    ("def f():\n    print(n)\n    n = 2\n", {(2, "F821", "n")}),
    ("n = 1\ndef f():\n    global n\n    print(n)\n    n = 2\n", set()),
    ("def f():\n    global g\n    g = 1\nprint(g)\n", set()),
    ("def f():\n    a = 1\n    def h():\n        nonlocal a\n        a = 2\n        return a\n    return h\n", set()),
    ("class A:\n    b = 1\n    c = b\n    def m(self):\n        return b\n", {(5, "F821", "b")}),
    ("class A:\n    xs = [1]\n    ys = [x for x in xs]\n    zs = [xs for _ in ys]\n", set()),
    ("[i for i in range(3) if i]\ni\n", {(2, "F821", "i")}),
    ("[(y := x) for x in range(3)]\ny\nx\n", {(3, "F821", "x")}),
    ("f = lambda a, *b, c=1, **d: (a, b, c, d, e)\n", {(1, "F821", "e")}),
    ("from m import *\nanything\n", set()),
    ("try:\n    unicode\nexcept NameError:\n    unicode = str\n", set()),
    ("try:\n    import a\nexcept ImportError as e:\n    a = e\nprint(a)\n", set()),
    ("match p:\n    case [u, *v]: w = u, v\n    case {'k': z, **r}: q = z, r\n    case C(t) as s: q = t, s\n", {(1, "F821", "p"), (4, "F821", "C")}),
    ("from __future__ import annotations\ndef f(a: Later) -> Never: ...\nclass Later: ...\n", {(2, "F821", "Never")}),
    ("def f(a: Later): ...\nclass Later: ...\n", {(1, "F821", "Later")}),
    ("def f[T](a: T) -> T: ...\nclass B[U](list[U]): ...\ntype X[V] = list[V]\n", set()),
    ("__all__ = ['a', 'b']\na = 1\n", {(1, "F822", "b")}),
    ("import os\nimport os\n", {(2, "F811", "os")}),
    ("import os\nos.x\nimport os\nos.y\n", set()),
    ("import a.b\nimport a.c\n", set()),
    ("def f(): pass\ndef f(): pass\n", {(2, "F811", "f")}),
    ("class A:\n    def m(self): pass\n    def m(self): pass\n    @property\n    def p(self): pass\n    @p.setter\n    def p(self, v): pass\n", {(3, "F811", "m")}),
    ("if c:\n    import x\nelse:\n    import x\n", {(1, "F821", "c")}),
    ("try:\n    import x\nexcept ImportError:\n    import y as x\n", set()),
    ("from typing import overload\n@overload\ndef f(a: int): ...\n@overload\ndef f(a: str): ...\ndef f(a): ...\n", set()),
    ("import os\ndef g():\n    return os\ndef os(): pass\n", {(4, "F811", "os")}),
    ("return 1\nclass A:\n    return 2\n", {(1, "F706", None), (3, "F706", None)}),
    ("yield 1\nx = [(yield 2)]\nawait z\n", {(1, "F704", None), (2, "F704", None), (3, "F704", None), (3, "F821", "z")}),
    ("def f():\n    await g()\nasync def g():\n    await f()\n    return lambda: (yield)\n", {(2, "PLE1142", None)}),
    ("x: int\nprint(x)\nx += 1\ny += 1\n", {(4, "F821", "y")}),
    ("for k in range(3): pass\nelse: k\nwith open(k) as h: h\ndel h\n", set()),
    ("def (", set()), ("", set()), (None, set()),
]


def test_scope_diagnostics(spark):
    files = spark.createDataFrame([(str(k), "head", "a.py", t) for k, (t, _) in enumerate(CASES)] + [("md", "head", "a.md", "x")], FILES)
    got = {k: set() for k in range(len(CASES))}
    for r in scope_diagnostics(files).collect():
        name = {"F821": 2, "F822": 2, "F811": 3, "F823": 2}.get(r.code)
        got[int(r.change_id)].add((r.line, r.code, name and r.message.split()[name]))
    assert {CASES[k][0]: v for k, v in got.items()} == dict(CASES)


def test_only_what_a_change_brings(spark):
    base = "import os\nx = 1\n\ndef f():\n    return os.path, gone\n"
    head = "x = 1\n\ndef f():\n    return os.path, gone\n"
    files = spark.createDataFrame([("c", "base", "a.py", base), ("c", "head", "a.py", head), ("n", "head", "b.py", "y\n")], FILES)
    got = {(r.change_id, r.line, r.rule_id, r.message) for r in new_scope_diagnostics(files).collect()}
    assert got == {("c", 4, "RUFF-F821", "undefined name os"), ("n", 1, "RUFF-F821", "undefined name y")}


@pytest.mark.parametrize("module", ["argparse", "dataclasses", "typing", "asyncio.tasks", "json.decoder"])
def test_names_agree_with_symtable(spark, module):
    """Names of the standard library's own files are all defined, and the module's bindings are those of symtable."""
    import importlib

    from patchloom.sources.scopes import read

    text = open(importlib.import_module(module).__file__).read()
    rows = read(text)
    table = symtable.symtable(text, "m", "exec")
    want = {s.get_name() for s in table.get_symbols() if s.is_assigned() or s.is_imported() or s.is_namespace()}
    assert {r["name"] for r in rows if r["kind"] == "bind" and r["scope"] == 0 and r["name"] != "*"} >= {w for w in want if not w.startswith(".")}
    found = scope_diagnostics(spark.createDataFrame([("c", "head", "m.py", text)], FILES)).where("code in ('F821', 'F822', 'F823')").collect()
    assert found == [] and ast.parse(text) and "print" in GIVEN
