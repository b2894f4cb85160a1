import pytest

from patchloom.plans.references import aliases, normal_path, references, resolved_imports
from patchloom.sources.code import indexed

FILES = "change_id string, side string, path string, text string"


def heads(spark, files, change="c"):
    return spark.createDataFrame([(change, "head", p, t) for p, t in files.items()], FILES)


def test_paths(spark):
    from pyspark.sql import functions as F

    cases = {"a/b": "a/b", "a/./b//c": "a/b/c", "a/x/../b": "a/b", "./a": "a", "../a": "../a", "a/../../b": "../b", "": "", "..": "..", "a/..": ""}
    rows = spark.createDataFrame(list(cases.items()), "p string, want string").withColumn("got", normal_path(F.col("p"))).collect()
    assert [(r.p, r.got) for r in rows] == [(r.p, r.want) for r in rows]


PYTHON = {
    "src/app/__init__.py": "", "src/app/core/api.py": "x = 1", "src/app/core/__init__.py": "", "src/app/util.py": "", "tests/util2.py": "", "lib/util2.py": "", "one/dup.py": "", "two/dup.py": "",
    "src/app/core/use.py": "from . import api\nfrom .api import x\nfrom .. import util\nfrom ..core.api import x as y\nfrom ... import nothing\nimport app.util\nimport util2\nimport dup\nimport os\nfrom app.core import api as z\nfrom app.util import *\n",
}


def test_python_imports(spark):
    got = {(r.line, r.local_name): (r.target, r.refers) for r in resolved_imports(indexed(heads(spark, PYTHON))).collect()}
    assert got == {
        (1, "api"): ("src/app/core/api.py", "module"), (2, "x"): ("src/app/core/api.py", "symbol"), (3, "util"): ("src/app/util.py", "module"), (4, "y"): ("src/app/core/api.py", "symbol"), (6, "app"): ("src/app/util.py", "module"),
        (7, "util2"): ("lib/util2.py", "module"), (10, "z"): ("src/app/core/api.py", "module"), (11, "*"): ("src/app/util.py", "symbol"),
    }


SCRIPTS = {
    "tsconfig.json": '{ // roots\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["lib/*", "*"], "exact": ["lib/b.ts"], "//": ["x//y"],}, /* end */ }, }',
    "src/lib/a.ts": "export const f = (n: number) => n;", "src/lib/b.ts": "", "src/lib/b.js": "", "src/dir/index.tsx": "", "src/c.mjs": "",
    "src/use.ts": 'import {f} from "./lib/a";\nimport * as b from "./lib/b.js";\nimport d from "./dir";\nimport {g} from "@/a";\nimport h from "@/c";\nimport i from "exact";\nimport j from "../../out";\nimport k from "react";\nimport l from "./lib/../lib/b";\n',
}


def test_script_imports(spark):
    files = heads(spark, SCRIPTS)
    got = {r.line: (r.target, r.refers) for r in resolved_imports(indexed(files), files).collect()}
    assert got == {1: ("src/lib/a.ts", "symbol"), 2: ("src/lib/b.js", "module"), 3: ("src/dir/index.tsx", "symbol"), 4: ("src/lib/a.ts", "symbol"), 5: ("src/c.mjs", "symbol"), 6: ("src/lib/b.ts", "symbol"), 9: ("src/lib/b.ts", "symbol")}
    assert {r.prefix for r in aliases(files).collect()} == {"@/", "exact", "//"}
    assert resolved_imports(indexed(files)).where("line in (4, 5, 6)").count() == 0


METHODS = {
    "shop.py": "class Cart:\n    def total_price(self, a):\n        return self.helper_one(1)\n    def helper_one(self, b):\n        return b\n    @staticmethod\n    def make_cart(c):\n        return c\n    @classmethod\n    def of_parts(cls, d):\n        return cls.make_cart(d)\n    def get(self):\n        pass\nCart.make_cart(2)\ntotal_free(1)\ndef total_free(x):\n    pass\n",
    "use.py": "from shop import Cart as C, total_free\nimport shop\nC.of_parts(1)\ncart.total_price(3)\ncart.get()\nshop.total_free(4)\ntotal_free(5)\nself.total_price(6)\n",
    "a.ts": "export class Box { put_in(x) { return this.look_at(x); } look_at(y) { return y; } }\n",
    "b.ts": 'import {Box} from "./a";\nbox.put_in(1);\nBox.look_at(2);\n',
}


def test_references(spark):
    index = indexed(heads(spark, METHODS))
    rows = references(index, resolved_imports(index)).collect()
    got = {(r.symbol, r.path, r.line, r.kind): (r.resolution, r.drop_first) for r in rows}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if k[0] != "Cart" and k[0] != "Box"} == {
        ("Cart.helper_one", "shop.py", 3, "call"): ("resolved", True), ("Cart.make_cart", "shop.py", 11, "call"): ("resolved", False), ("Cart.make_cart", "shop.py", 14, "call"): ("resolved", False),
        ("Cart.of_parts", "use.py", 3, "call"): ("resolved", True), ("Cart.total_price", "use.py", 4, "call"): ("name_only", True), ("total_free", "shop.py", 15, "call"): ("resolved", False),
        ("total_free", "use.py", 6, "call"): ("resolved", False), ("total_free", "use.py", 7, "call"): ("resolved", False), ("total_free", "use.py", 1, "import"): ("resolved", False),
        ("Box.look_at", "a.ts", 1, "call"): ("resolved", False), ("Box.put_in", "b.ts", 2, "call"): ("name_only", False), ("Box.look_at", "b.ts", 3, "call"): ("resolved", False),
    }
    assert {k for k in got if k[0] in ("Cart", "Box")} == {("Cart", "use.py", 1, "import"), ("Box", "b.ts", 1, "import")}
    assert references(index.where("false"), resolved_imports(index.where("false"))).count() == 0


JS = '''import React, {useState as us, type Foo} from "react";
import * as path from './util/path';
const {a, b: c} = require("fs"); const q = require("./q");
export default function main(x, y = 2, ...rest) { if (x && y) { return helper(x, `v${fmt(`n${y}`)}`); } return x / 2 / 3; }
export const add = async (p: number, q?: string): Promise<number> => { await fetchIt(p); return p; };
const one = x => x + 1;
let re = /ab[/]c(/g, count = 5;
class Cart extends Base {
  static async load(id) { return new Cart(await this.api.get(id)); }
  handle = (e) => { this.load(e); };
}
export interface Opts { a: number; }
export type Id = string | number;
describe("cart", () => { it("adds", async () => { expect(add(1)).toBe(2); }); });
module.exports = { one, count };
function over(a: any) { try { a.b.c(1, ...z); } catch (e) {} } // comment's (
'''


def test_script_structure():
    from patchloom.sources.javascript_code import index

    got = index(JS)
    assert got["error"] is None
    assert [(s["kind"], s["qualname"], s["start_line"], s["exported"]) for s in got["symbols"]] == [
        ("function", "main", 4, True), ("function", "add", 5, True), ("function", "one", 6, True), ("variable", "re", 7, False), ("variable", "count", 7, True), ("class", "Cart", 8, False), ("method", "Cart.load", 9, True),
        ("method", "Cart.handle", 10, True), ("type", "Opts", 12, True), ("type", "Id", 13, True), ("test", "cart.adds", 14, True), ("function", "over", 16, False),
    ]
    by = {s["qualname"]: s for s in got["symbols"]}
    assert [(p["name"], p["kind"], p["has_default"]) for p in by["main"]["params"]] == [("x", "positional", False), ("y", "positional", True), ("rest", "var_positional", False)]
    assert (by["main"]["complexity"], by["over"]["try_blocks"], by["cart.adds"]["assertions"], by["add"]["is_async"], by["add"]["returns"]) == (3, 1, 1, True, "Promise < number >")
    assert [p["annotation"] for p in by["add"]["params"]] == ["number", "string"]
    assert [(i["module"], i["imported_name"], i["local_name"], i["kind"]) for i in got["imports"]] == [
        ("react", "default", "React", "default"), ("react", "useState", "us", "name"), ("react", "Foo", "Foo", "name"), ("./util/path", None, "path", "namespace"), ("fs", "a", "a", "name"), ("fs", "b", "c", "name"), ("./q", None, "q", "namespace"),
    ]
    assert {(c["line"], c["callee"], c["positional"], c["star_args"], c["awaited"], c["enclosing"]) for c in got["calls"] if c["line"] in (4, 5, 9, 10, 16)} == {
        (4, "helper", 2, False, False, "main"), (4, "fmt", 1, False, False, "main"), (5, "fetchIt", 1, False, True, "add"), (9, "Cart", 1, False, False, "Cart.load"), (9, "this.api.get", 1, False, True, "Cart.load"), (10, "this.load", 1, False, False, "Cart.handle"), (16, "a.b.c", 1, True, False, "over"),
    }


@pytest.mark.parametrize(("text", "line"), [("function f( {\n", 1), ("a = 'x\n", 1), ("x = `a${b", 1), ("\n}", 2), ("a\n(]", 2), ("\\", 1)])
def test_broken_scripts(text, line):
    from patchloom.sources.javascript_code import index

    got = index(text)
    assert got["error"] and got["error_line"] == line and got["symbols"] == []


def test_awkward_scripts():
    from patchloom.sources.javascript_code import index

    for text in ("", "\n\n", "//", "a / b / c; (d) / e; f = /g/.test(h)", "for (const x of xs) {}", "export * from './a'; export {b as c} from './d';", "const {x, ...y} = z;", "@dec() class A { @p() q; constructor(private a: B) {} get [Symbol.iterator]() {} }", "x = {a() {}, b: 1, ...c};", "<T,>(x) => x", "é = `\\``;"):
        assert index(text)["error"] is None, text
    assert index("(" * 20000 + ")" * 20000)["error"] in (None, "nested too deeply")


def sides(spark, base, head):
    return indexed(spark.createDataFrame([("c", side, p, t) for side, fs in (("base", base), ("head", head)) for p, t in fs.items()], FILES))


def found(index, *rules):
    from patchloom.plans.api_contract import contract_findings

    rows = contract_findings(index).collect()
    return {(r.rule_id, r.symbol): (r.severity, r.confidence, r.detail, r.evidence) for r in rows if r.rule_id in rules}


def test_contract_grades_by_resolution(spark):
    base = {"m.py": "class A:\n    def load_it(self, a, b=1):\n        return a\n    def save_it(self, c):\n        return c\n", "u.py": "from m import A\nA.save_it(x, 1)\nx.load_it(1, b=2)\nx.load_it(*y)\n"}
    head = base | {"m.py": "class A:\n    def load_it(self, a):\n        return a\n    def save_it(self, c, d):\n        return c\n"}
    got = found(sides(spark, base, head), "CG-API-001")
    assert got[("CG-API-001", "A.load_it")] == ("medium", "medium", "unexpected keyword argument b", ["u.py:3"])
    assert got[("CG-API-001", "A.save_it")] == ("high", "high", "missing argument d", ["u.py:2"])


def test_contract_of_scripts(spark):
    base = {"a.ts": "export function f(a, b) { return a; }\nexport function g(a) { return a; }\nexport function gone(z) { return 5; }\n", "b.ts": 'import {f, g, gone} from "./a";\nf(1, 2);\ng(1);\nf(...xs);\n'}
    head = base | {"a.ts": "export function f(a) { return a; }\nexport function g(a, b) { return a; }\n"}
    got = found(sides(spark, base, head), "CG-API-001", "CG-API-002")
    assert got == {
        ("CG-API-001", "f"): ("high", "high", "takes 1 positional arguments but 2 are given", ["b.ts:2"]), ("CG-API-001", "g"): ("high", "high", "needs 2 arguments but 1 are given", ["b.ts:3"]),
        ("CG-API-002", "gone"): ("critical", "high", "removed but still used", ["b.ts:1"]),
    }


def test_renamed_symbols_and_lost_modules(spark):
    body = "(a):\n    total = 0\n    for x in a:\n        total += x * 3\n    return total\n"
    base = {"m.py": f"def one{body}def two(q):\n    return q\n", "old.py": "y = 1\n", "u.py": "from m import one\nimport old\none(1)\n"}
    head = {"m.py": f"def other{body}def three(q, r, s):\n    raise ValueError(r)\n", "u.py": base["u.py"]}
    got = found(sides(spark, base, head), "CG-API-002", "CG-API-007")
    assert got[("CG-API-002", "one")] == ("critical", "high", "renamed to other but still used", ["u.py:1", "u.py:3"])
    assert got[("CG-API-002", None)] == ("critical", "high", "the file is gone but still imported", ["u.py:2"])
    assert ("CG-API-007", "two") in got and ("CG-API-007", "one") not in got


def test_renames_like_brute_force(spark):
    import random

    from patchloom.plans.api_contract import symbol_changes
    from patchloom.plans.renames import renames, similarity

    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta rho tau".split())

    def function(name, words):
        return f"def {name}(x):\n" + "".join(f"    {w} = {w}_of(x)\n" for w in words) + "    return x\n"

    bodies = [[word() for _ in range(rng.randint(3, 9))] for _ in range(12)]
    base = {"m.py": "".join(function(f"a{i}", b) for i, b in enumerate(bodies)) + "x = 1\n"}
    changed = [b[:-1] + [word()] if i % 2 else list(b) for i, b in enumerate(bodies)]
    rng.shuffle(changed)
    head = {"m.py": "".join(function(f"b{i}", b) for i, b in enumerate(changed))}
    changes = symbol_changes(sides(spark, base, head)).cache()
    rows = changes.collect()
    removed = sorted((r.old for r in rows if r.change == "removed"), key=lambda s: s.ord)
    added = sorted((r.new for r in rows if r.change == "added"), key=lambda s: s.ord)
    taken, want = set(), set()
    for r in removed:
        options = [(similarity(r.body, a.body), -a.ord, a.qualname) for a in added if a.kind == r.kind and a.parent == r.parent and a.qualname not in taken]
        best = max((o for o in options if o[0] >= 0.78), default=None)
        if best:
            taken.add(best[2])
            want.add((r.qualname, best[2]))
    assert len(want) > 6 and {(r.old_name, r.new_name) for r in renames(changes).collect()} == want
    assert renames(changes.where("false")).count() == 0
