"""Queries over code, migrations, evidence and reports: each builds its files from the driver's rows, calls the library, and
has SQL that states the outcome from the rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.code import indexed
from ..sources.coverage import coverage_lines
from ..sources.diff import diff_lines
from ..sources.lint import new_diagnostics
from ..sources.python_code import part
from ..sources.tables import dealt, kept, table, tasks
from . import baselines, call_rules as calls_of, coverage_gaps, evaluation, evidence, logic, migrations, references, renames, report, scope_rules, secrets, synthesis, tests_mapping, workspace
from .api_contract import CONTRACT, contract_findings, symbol_changes
from .line_rules import dependency_changes, line_findings
from .registry import query

K = "CAST(p_partkey AS VARCHAR)"


def text(*parts) -> Column:
    """Strings and columns put together; {k} of a string is the part's key, {s} its size."""
    out = []
    for p in parts:
        if isinstance(p, Column):
            out.append(p)
            continue
        for piece in p.replace("{k}", "\0k\0").replace("{s}", "\0s\0").split("\0"):
            out.append(F.col("p_partkey").cast("string") if piece == "k" else F.col("p_size").cast("string") if piece == "s" else F.lit(piece))
    return F.concat(*out)


def of_parts(spark, sf_dir: str, *files: tuple) -> DataFrame:
    """change_id, side, path, text: the files (side, path, text or null for none) of every part's change."""
    rows = F.array(*[F.struct(F.lit(side).alias("side"), (F.lit(path) if isinstance(path, str) else path).alias("path"), (text(t) if isinstance(t, str) else t).alias("text")) for side, path, t in files])
    # keys are dealt before their texts are made
    each = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("change_id"), F.explode(rows).alias("f")).select("change_id", "f.*")
    return each.where("text is not null")


def when(condition: str, a, b=None) -> Column:
    as_text = lambda t: F.lit(None).cast("string") if t is None else text(t) if isinstance(t, str) else t
    return F.when(F.expr(condition), as_text(a)).otherwise(as_text(b))


def patches(rows: DataFrame, change: Column, path: Column, *lines: Column) -> DataFrame:
    """change_id, patch_text: a new file of these lines for every row."""
    body = F.array_join(F.transform(F.filter(F.array(*lines), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("+"), x)), "\n")
    n = F.size(F.filter(F.array(*lines), lambda x: x.isNotNull())).cast("string")
    return dealt(rows).select(change.cast("string").alias("change_id"), F.concat(F.lit("--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), n, F.lit(" @@\n"), body, F.lit("\n")).alias("patch_text"))


@query(f"SELECT {K} AS change_id, 'f' || p_partkey AS qualname, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS n_params, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS complexity, true AS exported, 'h' || p_partkey AS callee, 2 AS positional, 3 AS line, './h' AS module FROM part")
def script_structure(spark, sf_dir):
    """ST3: symbols, imports and calls of TypeScript files, past patterns, templates and types."""
    body = text('import {h{k}} from "./h";\nexport function f{k}<T>(a: number, b = {s}', when("p_partkey % 2 = 0", ", ...c: T[]", ""), "): number {\n  if (a > {s}", when("p_partkey % 3 = 0", " && /[/)]{s}/.test(`)`)", ""), ") { return h{k}(a / 2 / b, `v${b})`); }\n  return a; // f(\n}\n")
    index = kept(indexed(of_parts(spark, sf_dir, ("head", "web/f.ts", body))), "script-index")
    symbols = part(index, "symbols").select("change_id", "qualname", F.size("params").alias("n_params"), "complexity", "exported")
    calls = part(index, "calls").where("enclosing is not null and callee like 'h%'").select("change_id", F.col("enclosing").alias("qualname"), "callee", "positional", "line")
    imports = part(index, "imports").select("change_id", F.col("imported_name").alias("callee"), "module")
    return symbols.join(calls, ["change_id", "qualname"]).join(imports, ["change_id", "callee"]).select("change_id", "qualname", "n_params", "complexity", "exported", "callee", "positional", "line", "module")


@query(f"""SELECT {K} AS change_id, 'pkg/a/use.py' AS path, 1 AS line, 'pkg/a/lib' || p_partkey % 3 || '.py' AS target, 'module' AS refers FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT {K}, 'pkg/a/use.py', 2, 'pkg/top.py', 'symbol' FROM part
 UNION ALL SELECT {K}, 'pkg/a/use.py', 3, 'src/solo' || p_partkey || '.py', 'module' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT {K}, 'web/use.ts', 1, 'src/m0.ts', 'symbol' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT {K}, 'web/use.ts', 2, CASE WHEN p_partkey % 5 = 0 THEN 'web/d.js' ELSE 'web/d/index.tsx' END, 'module' FROM part""")
def imports_resolved(spark, sf_dir):
    """Which file an import means, by ranked candidates."""
    files = of_parts(
        spark, sf_dir, ("head", "pkg/a/use.py", text("from . import lib", F.col("p_partkey") % 3, "\nfrom ..top import x\nimport solo{k}\n")), ("head", "pkg/a/lib0.py", ""), ("head", "pkg/a/lib1.py", ""), ("head", "pkg/top.py", "x = 1\n"), ("head", text("src/solo{k}.py"), when("p_partkey % 2 = 0", "")),
        ("head", "web/use.ts", text('import {g} from "@/m', F.col("p_partkey") % 2, '";\nimport * as d from "./x/../d";\n')), ("head", "tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}, /* all */}'), ("head", "src/m0.ts", ""), ("head", "web/d/index.tsx", ""), ("head", "web/d.js", when("p_partkey % 5 = 0", "")),
    )
    return references.resolved_imports(kept(indexed(files, "imports"), "import-index"), files).select("change_id", "path", "line", "target", "refers")


@query(f"""SELECT {K} AS change_id, 'C.end_' || p_partkey || '_it' AS symbol, 'm.py' AS path, 3 AS line, 'call' AS kind, 'resolved' AS resolution, true AS drop_first FROM part UNION ALL SELECT {K}, 'C.end_' || p_partkey || '_it', 'u.py', 2, 'call', 'resolved', false FROM part
 UNION ALL SELECT {K}, 'C.go_' || p_partkey || '_on', 'u.py', 3, 'call', 'name_only', true FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT {K}, 'C', 'u.py', 1, 'import', 'resolved', false FROM part""")
def method_references(spark, sf_dir):
    """Uses of methods by self, by the class's names, and by a telling name alone."""
    lib = text("class C:\n    def go_{k}_on(self, a):\n        return self.end_{k}_it(a)\n    def end_{k}_it(self, a):\n        return a\n", when("p_partkey % 2 = 0", "", "def go_{k}_on(q):\n    return q\n"))
    index = kept(indexed(of_parts(spark, sf_dir, ("head", "m.py", lib), ("head", "u.py", "from m import C as D\nD.end_{k}_it(1)\nx.go_{k}_on(2)\nx.get(3)\n")), "symbols", "imports", "calls"), "method-index")
    imports = kept(references.resolved_imports(index), "method-imports")
    return references.references(index, imports).select("change_id", "symbol", "path", "line", "kind", "resolution", "drop_first")


@query(f"SELECT {K} AS change_id, 'a' || p_partkey AS old_name, 'b' || p_partkey AS new_name FROM part WHERE p_partkey % 3 <> 0")
def renamed_symbols(spark, sf_dir):
    """Removed and added symbols with alike bodies are renames."""
    body = "(x):\n    y = x * {s}\n    z = [q for q in range(y) if q > 1]\n    return sum(z) + y\n"
    head = when("p_partkey % 3 <> 0", "def b{k}" + body, "def b{k}(path, mode):\n    raise NotImplementedError\n")
    index = indexed(of_parts(spark, sf_dir, ("base", "m.py", "def a{k}" + body), ("head", "m.py", head)))
    return renames.renames(kept(symbol_changes(index), "rename-changes")).select("change_id", "old_name", "new_name")


#: Files by a part's key modulo ten, and the code and line that each has.
SCOPES = ("x{k}\n", "import os\nimport os\n", "n = 1\ndef f():\n    print(n)\n    n = {s}\n", "__all__ = ['q']\n", "return 1\n", "yield {s}\n", "def f():\n    await g()\ndef g(): pass\n", "def f():\n    return later\nlater = {s}\n", "class A:\n    b = {s}\n    def m(self):\n        return b\n", "from os import *\nanything\n")


@query(f"SELECT {K} AS change_id, CASE p_partkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 6 THEN 2 WHEN 8 THEN 4 ELSE 1 END AS line, CASE p_partkey % 10 WHEN 0 THEN 'F821' WHEN 1 THEN 'F811' WHEN 2 THEN 'F823' WHEN 3 THEN 'F822' WHEN 4 THEN 'F706' WHEN 5 THEN 'F704' WHEN 6 THEN 'PLE1142' ELSE 'F821' END AS code FROM part WHERE p_partkey % 10 NOT IN (7, 9)")
def scope_diagnostics(spark, sf_dir):
    """R2: names resolved through scopes, in the order of running."""
    body = F.coalesce(*[when(f"p_partkey % 10 = {i}", t) for i, t in enumerate(SCOPES)])
    return scope_rules.scope_diagnostics(of_parts(spark, sf_dir, ("head", "a.py", body))).select("change_id", "line", "code")


@query(f"SELECT {K} AS change_id, 4 AS line, 'RUFF-F821' AS rule_id FROM part WHERE p_partkey % 2 = 0")
def scope_changes(spark, sf_dir):
    """R2: a removed import leaves an undefined name on a line that didn't change."""
    body = "x = {s}\n\ndef f():\n    return os.path, lost{k}\n"
    files = of_parts(spark, sf_dir, ("base", "a.py", "import os\n" + body), ("head", "a.py", when("p_partkey % 2 = 0", body, "import os\n" + body)))
    return scope_rules.new_scope_diagnostics(files).select("change_id", "line", "rule_id")


LINTS = ("eval(x)\n", "exec(x)\n", "import pickle\npickle.loads(x)\n", "import yaml\nyaml.load(x)\n", "try:\n    x()\nexcept:\n    pass\n", "def f(a=[]): pass\n", "y = x is 'a'\n", "import subprocess\nsubprocess.run(x, shell=True)\n", "assert False\n", "import requests as r\nr.get(x)\n")


@query(f"""WITH f(m, line, rule_id) AS (VALUES (0, 1, 'S307'), (1, 1, 'S102'), (2, 2, 'S301'), (3, 2, 'S506'), (4, 3, 'E722'), (4, 3, 'S110'), (5, 1, 'B006'), (6, 1, 'F632'), (7, 2, 'S602'), (8, 1, 'B011'), (9, 2, 'S113'))
 SELECT {K} AS change_id, CAST(line AS INTEGER) AS line, 'RUFF-' || rule_id AS rule_id FROM part JOIN f ON p_partkey % 10 = m WHERE (p_partkey // 10) % 2 = 1""")
def lint_changes(spark, sf_dir):
    """ST5, R1, R3: diagnostics that a change brings; those that the base has too aren't new."""
    body = F.coalesce(*[when(f"p_partkey % 10 = {i}", t) for i, t in enumerate(LINTS)])
    files = of_parts(spark, sf_dir, ("base", "a.py", F.when(F.expr("(p_partkey div 10) % 2 = 0"), body).otherwise("")), ("head", "a.py", body))
    return new_diagnostics(files).select("change_id", "line", "rule_id")


@query(f"""WITH r(m, rule_id, severity, confidence, symbol) AS (VALUES (0, 'CG-API-001', 'high', 'high', 'f'), (1, 'CG-API-001', 'medium', 'medium', 'A.work_with'), (2, 'CG-API-002', 'critical', 'high', 'f'), (3, 'CG-API-002', 'critical', 'high', 'f'), (4, 'CG-API-003', 'medium', 'medium', 'lone'), (5, 'CG-API-004', 'high', 'high', 'f'),
   (6, 'CG-API-005', 'medium', 'medium', 'lone'), (7, 'CG-API-006', 'low', 'medium', 'lone'), (8, 'CG-API-007', 'low', 'medium', 'lone'), (9, 'CG-ERR-002', 'medium', 'medium', 'lone'), (10, 'CG-SYN-001', 'critical', 'high', NULL), (11, 'CG-CPX-001', 'low', 'medium', 'lone'))
 SELECT {K} AS change_id, rule_id, severity, confidence, symbol FROM part JOIN r ON p_partkey % 12 = m""")
def contract_rules(spark, sf_dir):
    """CG-API-001 to 007, SYN-001, ERR-002, CPX-001: one rule each, graded by how callers were found."""
    f, lone, method, same = "def f(a, b=1):\n    return a\n", "def lone(a, b=1):\n    return a\n", "class A:\n    def work_with(self, a, b=1):\n        return a\n", "from m import f\nf(1, b=2)\n"
    branch = "".join(f"    if a > {i}:\n        a += {i}\n" for i in range(10))
    cases = [
        (f, "def f(a):\n    return a\n", same), (method, "class A:\n    def work_with(self, a):\n        return a\n", "x.work_with(1, b=2)\n"), (f, "q = 1\n", same), (f, "def g(a, b=1):\n    return a\n", same), (lone, "def lone(a, b=1, *, c):\n    return a\n", ""), ("def f(a):\n    return a\n", "async def f(a):\n    return a\n", "from m import f\nf(1)\n"),
        (lone, "def lone(a, b=2):\n    return a\n", ""), ("def lone(a) -> int:\n    return a\n", "def lone(a) -> str:\n    return a\n", ""), (lone, "q = 1\n", ""), ("def lone(a):\n    try:\n        return a\n    finally:\n        a = 1\n", "def lone(a):\n    return a\n", ""), ("q = 1\n", "q = (\n", ""), ("def lone(a):\n    return a\n", "def lone(a):\n" + branch + "    return a\n", ""),
    ]
    pick = lambda j: F.coalesce(*[when(f"p_partkey % 12 = {i}", c[j]) for i, c in enumerate(cases)])
    files = of_parts(spark, sf_dir, ("base", "m.py", pick(0)), ("head", "m.py", pick(1)), ("base", "u.py", pick(2)), ("head", "u.py", pick(2)))
    return contract_findings(kept(indexed(files, *CONTRACT, once=True), "rule-index")).select("change_id", "rule_id", "severity", "confidence", "symbol")


@query(f"SELECT {K} AS change_id, 'CG-TST-001' AS rule_id, CASE WHEN p_partkey % 5 = 0 THEN 'low' ELSE 'medium' END AS severity, CASE WHEN p_partkey % 5 = 0 THEN '_a' ELSE 'a' END || p_partkey AS symbol FROM part WHERE p_partkey % 2 = 1")
def untested_symbols(spark, sf_dir):
    """J17, J18, CG-TST-001: changed symbols that no test reaches, directly or by a caller."""
    name = when("p_partkey % 5 = 0", "_a{k}", "a{k}")
    lib = lambda n: text("def ", name, "():\n    return ", n, "\ndef via{k}():\n    return ", name, "()\n")
    tests = text("from lib import via{k}, ", name, "\ndef test_it():\n    ", when("p_partkey % 2 = 0", text(name, "()"), "pass"), "\n")
    files = of_parts(spark, sf_dir, ("base", "lib.py", lib("1")), ("head", "lib.py", lib("2")), ("base", "test_lib.py", tests), ("head", "test_lib.py", tests))
    return tests_mapping.untested(kept(indexed(files, *CONTRACT, once=True), "test-index")).select("change_id", "rule_id", "severity", "symbol")


@query(f"SELECT {K} AS change_id, CASE WHEN p_partkey % 3 = 0 THEN 'CG-LOG-001' ELSE 'CG-LOG-002' END AS rule_id, CASE WHEN p_partkey % 3 = 1 THEN 'low' ELSE 'medium' END AS severity, CASE p_partkey % 3 WHEN 0 THEN '> → >=' WHEN 1 THEN p_size || ' → ' || p_size + 1 ELSE '+ 1 → ' END AS detail FROM part WHERE p_partkey % 4 <> 0")
def logic_edits(spark, sf_dir):
    """X5 to X7, CG-LOG: conditions and numbers that an edit changes."""
    before = F.coalesce(when("p_partkey % 3 = 0", "if n > {s}:"), when("p_partkey % 3 = 1", "    wait({s})"), text("    t = a[i + 1]"))
    after = F.coalesce(when("p_partkey % 4 = 0", text(before, "  # {s}")), when("p_partkey % 3 = 0", "if n >= {s}:"), when("p_partkey % 3 = 1", text("    wait(", F.col("p_size") + 1, ")")), text("    t = a[i]"))
    rows = dealt(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("change_id"), text("--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n-", before, "\n+", after, "\n x\n").alias("patch_text"))
    return logic.logic_findings(diff_lines(rows)).select("change_id", "rule_id", "severity", "detail")


MIGRATE = (("DROP TABLE t{k};", "DROP TABLE", "critical"), ("ALTER TABLE t DROP COLUMN col_{k};", "DROP COLUMN", "high"), ("truncate table t{k}", "TRUNCATE", "critical"), ("DELETE FROM t{k};", "DELETE without WHERE", "high"), ("alter table t rename column col_{k} to b", "RENAME", "high"), ("ALTER TABLE t ALTER COLUMN c TYPE int", "column type change", "medium"), ("alter table t alter c set not null", "SET NOT NULL", "medium"), ("op.drop_column('t', 'col_{k}')", "op.drop_column", "high"), ("select {s}", None, None))


@query(f"""WITH o(m, detail, severity) AS (VALUES {", ".join(f"({i}, '{d}', '{s}')" for i, (_, d, s) in enumerate(MIGRATE) if d)}), h AS (SELECT p_partkey, p_size, m, detail, severity FROM part JOIN o ON p_partkey % 9 = m)
 SELECT CAST(p_partkey AS VARCHAR) AS change_id, 'CG-MIG-001' AS rule_id, severity, detail, CAST(0 AS BIGINT) AS n FROM h UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'CG-MIG-002', 'high', 'col_' || p_partkey, CAST(least(20, p_size) + 1 AS BIGINT) FROM h WHERE m IN (1, 4, 7)""")
def migration_rules(spark, sf_dir):
    """X3, X4, J24, CG-MIG: graded operations, and columns that code still names, up to a cap."""
    line = F.coalesce(*[when(f"p_partkey % 9 = {i}", t) for i, (t, _, _) in enumerate(MIGRATE)])
    diff = kept(diff_lines(patches(table(spark, sf_dir, "part"), F.col("p_partkey"), F.lit("db/migrations/1.sql"), line)), "migration-diff")
    code = text(F.repeat(text("x = row.col_{k}  # col_{k}\n"), F.col("p_size").cast("int")), "col_{k}s = 1\n")
    files = of_parts(spark, sf_dir, ("head", "a.py", code), ("head", "b.py", "y = 'col_{k}'\n"), ("head", "db/migrations/0.sql", "col_{k}"))
    return migrations.migration_findings(diff, files).select("change_id", "rule_id", "severity", "detail", "n")


@query("""WITH v AS (SELECT p_partkey AS k, p_partkey % 5 = 0 AS t, p_partkey % 3 AS m, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part), c AS (SELECT k, unnest(string_split(h, '')) AS c FROM v), n AS (SELECT k, c, count(*) AS n FROM c GROUP BY ALL), e AS (SELECT k, -sum(n / 32 * log2(n / 32)) AS bits FROM n GROUP BY k)
 SELECT CAST(k AS VARCHAR) AS change_id, CASE WHEN m = 0 THEN 'provider' ELSE 'generic' END AS kind, CASE WHEN m = 0 THEN 'critical' WHEN t THEN 'medium' ELSE 'high' END AS severity, CASE WHEN m = 0 THEN 'high' WHEN t THEN 'low' ELSE 'medium' END AS confidence,
 CASE WHEN m = 0 THEN 'ghp_…(40)' ELSE substr(h, 1, 4) || '…(32)' END AS masked FROM v JOIN e USING (k) WHERE m = 0 OR (m = 1 AND bits >= 3.2)""")
def secrets_found(spark, sf_dir):
    """X1, CG-SEC-010: tokens of known formats, and random values by entropy; tests are graded lower."""
    digest = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    line = F.coalesce(when("p_partkey % 3 = 0", text("T = 'ghp_", digest, "abcd'")), when("p_partkey % 3 = 1", text('SERVICE_API_KEY = "', digest, '"')), text("name = '", digest, "'"))
    diff = diff_lines(patches(table(spark, sf_dir, "part"), F.col("p_partkey"), when("p_partkey % 5 = 0", "tests/test_a.py", "a.py"), line))
    return secrets.secret_findings(diff).select("change_id", "kind", "severity", "confidence", "masked")


@query("""WITH d AS (SELECT c_custkey AS k, '^' || c_custkey % 4 || '.1' AS before, CASE WHEN c_custkey % 7 <> 0 THEN '^' || c_custkey % 3 || '.1' END AS after FROM customer)
 SELECT CAST(k AS VARCHAR) AS change_id, f AS file, n || k AS name, CASE WHEN after IS NULL THEN 'CG-DEP-003' ELSE 'CG-DEP-001' END AS rule_id, CASE WHEN after IS NOT NULL THEN 'medium' WHEN k % 2 = 0 AND f = 'package.json' THEN 'high' ELSE 'low' END AS severity FROM d, (VALUES ('package.json', '@s/p'), ('pyproject.toml', 'q')) t(f, n) WHERE before IS DISTINCT FROM after""")
def manifest_rules(spark, sf_dir):
    """X9, J22, J23, CG-DEP: package.json and pyproject.toml before and after, and packages that scripts still import."""
    k = F.col("c_custkey")
    spec = lambda n: F.concat(F.lit("^"), (k % n).cast("string"), F.lit(".1"))
    npm = lambda v: F.concat(F.lit('{"name": "n", "dependencies": {'), F.coalesce(F.concat(F.lit('"@s/p'), k, F.lit('": "'), v, F.lit('"')), F.lit("")), F.lit("}}"))
    toml = lambda v: F.concat(F.lit('[tool.poetry.dependencies]\npython = "^3"\n'), F.coalesce(F.concat(F.lit("q"), k, F.lit(' = {version = "'), v, F.lit('"}\n')), F.lit("")))
    after = F.when(k % 7 != 0, spec(3))
    files = [("base", "package.json", npm(spec(4))), ("head", "package.json", npm(after)), ("base", "pyproject.toml", toml(spec(4))), ("head", "pyproject.toml", toml(after)), ("head", "a.ts", F.when(k % 2 == 0, F.concat(F.lit('import x from "@s/p'), k, F.lit('/deep";\n'))))]
    rows = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(p).alias("path"), t.alias("text")) for s, p, t in files])
    every = table(spark, sf_dir, "customer").select(k.cast("string").alias("change_id"), F.explode(rows).alias("f")).select("change_id", "f.*").where("text is not null")
    return dependency_changes(every, part(indexed(every), "imports")).select("change_id", "file", "name", "rule_id", "severity")


@query("""WITH RECURSIVE b AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM b),
 f AS (SELECT l_orderkey, l_linenumber, r, size <= 60 AS included, 60 - CASE WHEN size <= 60 THEN size ELSE 0 END AS room FROM s WHERE r = 1
   UNION ALL SELECT s.l_orderkey, s.l_linenumber, s.r, s.size <= f.room, f.room - CASE WHEN s.size <= f.room THEN s.size ELSE 0 END FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.r = f.r + 1)
 SELECT l_orderkey, l_linenumber, included FROM f""")
def context_budget(spark, sf_dir):
    """Blocks that fit into a budget, one that doesn't being skipped."""
    blocks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("size"))
    return evidence.within_budget(blocks, "l_orderkey", "l_linenumber", "size", 60).select("l_orderkey", "l_linenumber", "included")


@query("""WITH l AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS l, CAST(1 + n_chars % 9 AS INTEGER) AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
 SELECT doc_id, CASE WHEN p <= len(l) THEN greatest(1, p - 2) END AS excerpt_start, CASE WHEN p <= len(l) THEN array_to_string(l[greatest(1, p - 2):least(len(l), p + 2)], chr(10)) END AS excerpt, p <= len(l) AS holds FROM l""")
def evidence_excerpts(spark, sf_dir):
    """The lines around a place, and whether they still stand there."""
    docs = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null")
    change = F.col("doc_id").cast("string").alias("change_id")
    files = docs.select(change, F.lit("head").alias("side"), F.lit("a.md").alias("path"), "text")
    places = docs.select(change, "doc_id", F.lit("head").alias("side"), F.lit("a.md").alias("path"), (1 + F.col("n_chars") % 9).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    none = diff_lines(places.where("false").select("change_id", F.lit("").alias("patch_text")))
    shown = evidence.excerpts(places, files, none)
    return evidence.rechecked(shown, files).select("doc_id", "excerpt_start", "excerpt", "holds")


@query("""WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS change_id, 'src/app/f' || l_suppkey % 3 || '.py' AS file, l_linenumber AS line, max(CASE WHEN l_quantity > 10 THEN l_partkey % 3 END) AS hits FROM lineitem GROUP BY ALL), k AS (SELECT * FROM a WHERE hits IS NOT NULL), m AS (SELECT change_id, file, line, line - row_number() OVER (PARTITION BY change_id, file ORDER BY line) AS g FROM k WHERE hits = 0),
 r AS (SELECT change_id, file, min(line) AS lo, max(line) AS hi, count(*) AS n FROM m GROUP BY change_id, file, g)
 SELECT change_id, 'CG-COV-001' AS rule_id, CASE WHEN sum(n) >= 3 THEN 'medium' ELSE 'low' END AS severity, file, 'not run: ' || string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END, ', ' ORDER BY lo) AS detail FROM r GROUP BY change_id, file
 UNION ALL SELECT change_id, 'CG-COV-002', 'low', file, 'not in the report' FROM a WHERE change_id IN (SELECT change_id FROM k) GROUP BY change_id, file HAVING count(hits) = 0""")
def coverage_rules(spark, sf_dir):
    """A7, A10, CG-COV: changed lines that never ran, as ranges, and changed files that a report lacks; read from lcov."""
    rows = table(spark, sf_dir, "lineitem")
    change, name = F.col("l_orderkey").cast("string").alias("change_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 3, F.lit(".py"))
    diff = rows.select(change, F.concat(F.lit("src/app/"), name).alias("path"), F.lit("add").alias("kind"), F.col("l_linenumber").alias("new_line"))
    record = F.concat(F.lit("SF:app/"), name, F.lit("\nDA:"), F.col("l_linenumber"), F.lit(","), F.col("l_partkey") % 3, F.lit("\nend_of_record"))
    reports = rows.where("l_quantity > 10").select(change, record.alias("r")).groupBy("change_id").agg(F.array_join(F.collect_list("r"), "\n").alias("text"))
    return coverage_gaps.coverage_findings(diff, kept(coverage_lines(reports), "coverage")).select("change_id", "rule_id", "severity", "file", "detail")


P, X = evaluation.PRIME, "(x * x + (c % 65536 + 1) * {0} + b * ({0} + 2)) % 2147483647"


@query(f"""WITH c AS (SELECT doc_id AS c, CAST(toxic = 1 AND quality = 0 AS INTEGER) AS tp, CAST(toxic <> 1 AND quality = 0 AS INTEGER) AS fp, CAST(toxic = 1 AND quality <> 0 AS INTEGER) AS fn FROM labels), a AS (SELECT *, (c % {P} * 48271 + b * 69621 + 1) % {P} AS x FROM c, range({evaluation.RESAMPLES}) t(b)),
 a1 AS (SELECT * REPLACE ({X.format(16807)} AS x) FROM a), a2 AS (SELECT * REPLACE ({X.format(39373)} AS x) FROM a1), a3 AS (SELECT * REPLACE ({X.format(69069)} AS x) FROM a2), d AS (SELECT *, {" + ".join(f"CAST(x > {t} AS INTEGER)" for t in evaluation.POISSON)} AS k FROM a3),
 s AS (SELECT b, CAST(sum(k * tp) AS DOUBLE) AS tp, CAST(sum(k * fp) AS DOUBLE) AS fp, CAST(sum(k * fn) AS DOUBLE) AS fn FROM d GROUP BY b), m AS (SELECT b, 'precision' AS metric, tp / nullif(tp + fp, 0) AS v FROM s UNION ALL SELECT b, 'recall', tp / nullif(tp + fn, 0) FROM s UNION ALL SELECT b, 'f1', 2 * tp / nullif(2 * tp + fp + fn, 0) FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v, b) - 1 AS r, count(*) OVER (PARTITION BY metric) AS n FROM m WHERE v IS NOT NULL) SELECT metric, round(min(v) FILTER (r = CAST(round_even(0.025 * (n - 1), 0) AS BIGINT)), 4) AS lo, round(min(v) FILTER (r = CAST(round_even(0.975 * (n - 1), 0) AS BIGINT)), 4) AS hi FROM r GROUP BY metric""")
def bootstrap_intervals(spark, sf_dir):
    """Intervals of precision, recall and f1 over 2,000 resamples, without numbering the cases."""
    one = lambda c: F.expr(c).cast("int")
    counts = table(spark, sf_dir, "labels").select("doc_id", one("toxic = 1 and quality = 0").alias("tp"), one("toxic <> 1 and quality = 0").alias("fp"), one("toxic = 1 and quality <> 0").alias("fn"))
    return evaluation.bootstrap(counts, "doc_id")


FINDINGS = """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS change_id, 'F-' || l_linenumber AS id, 'R' || l_linenumber AS rule_id, CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity, CASE WHEN l_linenumber % 2 = 0 THEN 'ai' ELSE 'heuristic' END AS kind, CASE WHEN l_linenumber % 5 = 0 THEN 'low' ELSE 'high' END AS confidence, CAST(l_linenumber AS INTEGER) AS line FROM lineitem"""


def found(spark, sf_dir):
    """Findings of an order: one a line number."""
    n = F.col("l_linenumber")
    severity = F.when(n % 3 == 0, "high").when(n % 3 == 1, "low").otherwise("medium")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.select(F.col("l_orderkey").cast("string").alias("change_id"), F.concat(F.lit("F-"), n).alias("id"), F.concat(F.lit("R"), n).alias("rule_id"), F.lit("x").alias("category"), F.when(n % 2 == 0, "ai").otherwise("heuristic").alias("kind"), severity.alias("severity"), F.when(n % 5 == 0, "low").otherwise("high").alias("confidence"), F.lit("a.py").alias("file"), n.cast("int").alias("start_line"), F.lit("a <b> `c`").alias("title"), F.lit(None).cast("string").alias("excerpt"))


@query(f"WITH f AS ({FINDINGS}) SELECT change_id, bool_or(severity = 'high' AND kind <> 'ai') AS fails, CASE WHEN bool_or(severity = 'high' AND kind <> 'ai') THEN 'high' WHEN bool_or(severity IN ('high', 'medium')) THEN 'elevated' ELSE 'routine' END AS priority FROM f GROUP BY change_id")
def report_gate(spark, sf_dir):
    """The gate over rules' findings, and a change's priority."""
    return report.gate(found(spark, sf_dir))


ORDERED = f"""WITH f AS ({FINDINGS}), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY change_id ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE kind WHEN 'ai' THEN 1 ELSE 0 END, CASE confidence WHEN 'low' THEN 1 ELSE 0 END, line, rule_id) AS INTEGER) AS ord FROM f)"""


@query(f"{ORDERED} SELECT change_id, id, ord FROM o")
def report_order(spark, sf_dir):
    """O1: findings by severity, kind, confidence and place."""
    return report.ordered(found(spark, sf_dir)).select("change_id", "id", F.col("ord").cast("int").alias("ord"))


@query(f"""{ORDERED} SELECT change_id, '{{"change_id":"' || change_id || '","findings":[' || string_agg('{{"id":"' || id || '","rule_id":"' || rule_id || '","category":"x","kind":"' || kind || '","severity":"' || severity || '","confidence":"' || confidence || '","location":{{"file":"a.py","start_line":' || line || '}},"title":"a <b> `c`"}}', ',' ORDER BY ord) || ']}}' AS json FROM o GROUP BY change_id""")
def report_json(spark, sf_dir):
    """K1: a report as JSON."""
    return report.to_json(found(spark, sf_dir))


@query(f"""{ORDERED} SELECT change_id, '# ' || count(*) || ' findings' || chr(10) || chr(10) || string_agg('### ' || ord || '. a &lt;b&gt; \\`c\\` (' || severity || ')' || chr(10) || '`a.py:' || line || '` · ' || rule_id, chr(10) || chr(10) ORDER BY ord) AS markdown FROM o GROUP BY change_id""")
def report_markdown(spark, sf_dir):
    """K2, K3: a report as Markdown, with titles escaped."""
    return report.to_markdown(found(spark, sf_dir))


@query(f"""{ORDERED} SELECT change_id, CAST(count(*) AS BIGINT) AS results, string_agg(rule_id, ',' ORDER BY ord) AS rules, string_agg(CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END, ',' ORDER BY ord) AS levels FROM o GROUP BY change_id""")
def report_sarif(spark, sf_dir):
    """K4: a report as SARIF, read back."""
    schema = "runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<struct<ruleId: string, ruleIndex: int, level: string>>>>"
    run = F.from_json("sarif", schema)["runs"][0]
    # read once a report, not once a result
    read = report.to_sarif(found(spark, sf_dir)).select("change_id", run.alias("run")).select("change_id", F.col("run.results").alias("r"), F.col("run.tool.driver.rules").alias("named"))
    named = F.transform("r", lambda r: F.col("named")[r["ruleIndex"]]["id"])
    return read.select("change_id", F.size("r").cast("long").alias("results"), F.array_join(named, ",").alias("rules"), F.array_join("r.level", ",").alias("levels"))


@query(f"SELECT {K} AS change_id, 'm.py' AS path, 'a' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'C' END || p_size || chr(10) AS text FROM part UNION ALL SELECT {K}, 'same.py', 'x' || p_partkey FROM part UNION ALL SELECT {K}, 'new.py', 'n' || chr(10) FROM part WHERE p_partkey % 3 = 0")
def whole_heads(spark, sf_dir):
    """Snapshots without their common folder, patched, with the files that the patch leaves alone."""
    base = of_parts(spark, sf_dir, ("base", "repo-1/m.py", "a\nb{s}\n"), ("base", "repo-1/same.py", "x{k}"), ("base", "repo-1/gone.py", "q\n"))
    patch = text("--- a/m.py\n+++ b/m.py\n@@ -1,2 +1,2 @@\n a\n-b{s}\n+", when("p_partkey % 2 = 0", "B", "C"), "{s}\n--- a/gone.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-q\n", when("p_partkey % 3 = 0", "--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,1 @@\n+n\n", ""))
    diff = kept(diff_lines(dealt(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("change_id"), patch.alias("patch_text"))), "head-diff")
    return workspace.whole_head(kept(workspace.aligned(base, diff).drop("side"), "head-base"), diff)


CALLED = ("# eval({s})\ny = 'eval(x)'\n", "z = eval(\n    x{k}\n)\n", "from os import system as run\nrun(c{k})\n", "import yaml as y\ny.load(f{k})\ny.load(f, Loader=y.SafeLoader)\n", "import time\nasync def f{k}():\n    time.sleep({s})\n", "def (\neval(x)\n")


@query(f"WITH r(m, rule_id, severity, line) AS (VALUES (1, 'CG-SEC-001', 'high', 1), (2, 'CG-SEC-003', 'high', 2), (3, 'CG-SEC-004', 'high', 2), (4, 'CG-CON-002', 'medium', 3), (5, 'CG-SEC-001', 'high', 2)) SELECT {K} AS change_id, rule_id, severity, CAST(line AS INTEGER) AS start_line FROM part JOIN r ON p_partkey % 6 = m")
def call_rules(spark, sf_dir):
    """CG-SEC-001 to 004, CG-CON-002: rules on parsed calls, by the names that imports give them; lines where files don't parse."""
    body = F.coalesce(*[when(f"p_partkey % 6 = {i}", t) for i, t in enumerate(CALLED)])
    files = of_parts(spark, sf_dir, ("head", "a.py", body))
    lines = F.filter(F.split("text", "\n"), lambda x, i: i < F.size(F.split("text", "\n")) - 1)
    patch = F.concat(F.lit("--- /dev/null\n+++ b/a.py\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"), F.lit("\n"))
    diff = kept(diff_lines(files.select("change_id", patch.alias("patch_text"))), "call-diff")
    return calls_of.security_findings(diff, kept(indexed(files), "call-index")).select("change_id", "rule_id", "severity", "start_line")


@query("""SELECT o_orderkey, sha256('{"max_output_tokens":' || o_orderkey || ',"model":"m' || o_custkey % 3 || '","prompt_id":"review","prompt_version":"1","provider":"p","schema":{"a":1},"schema_name":"s","seed":7,"system":"' || o_orderpriority || '","temperature":0.0,"user":"' || o_orderstatus || '"}') AS fingerprint, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || o_orderkey END AS text, CASE WHEN o_orderkey % 2 = 1 THEN 'replay_miss' END AS error FROM orders""")
def answers_replayed(spark, sf_dir):
    """Requests by the hash of their canonical JSON, and the recorded answer of each."""
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("p").alias("provider"), F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"), F.lit("review").alias("prompt_id"), F.lit("1").alias("prompt_version"), F.col("o_orderpriority").alias("system"), F.col("o_orderstatus").alias("user"),
        F.lit('{"a":1}').alias("schema"), F.lit("s").alias("schema_name"), F.col("o_orderkey").alias("max_output_tokens"), F.lit(0.0).alias("temperature"), F.lit(7).alias("seed"),
    )
    own = requests.where("o_orderkey % 2 = 0").withColumn("fingerprint", synthesis.fingerprint())
    recordings = own.select("fingerprint", F.concat(F.lit("a"), "o_orderkey").alias("text"), F.col("o_orderkey").alias("recorded_at"))
    return synthesis.replayed(requests, recordings).select("o_orderkey", "fingerprint", "text", "error")


@query(f"""WITH k AS (SELECT {K} AS change_id, p_partkey AS k, p_size AS s FROM part)
 SELECT change_id, 'rule' AS which, 'F-1' AS id, CAST(NULL AS DOUBLE) AS support, k % 4 = 0 AS backed FROM k UNION ALL SELECT change_id, 'ai', NULL, 1.0, false FROM k WHERE k % 4 = 1 UNION ALL SELECT change_id, 'ai', NULL, 0.5, false FROM k WHERE k % 4 = 2 UNION ALL SELECT change_id, 'rejected', 'unknown_evidence', NULL, false FROM k WHERE k % 4 = 3""")
def model_risks(spark, sf_dir):
    """ST9, ST10, J28, J29, X20: answers' risks, read from text around JSON, checked, agreed on by samples, and merged with findings."""
    risk = lambda category, e: text('{"title": "t{k}", "category": "', category, '", "severity": "high", "confidence": "low", "description": "d {s}", "evidence_ids": ["', e, '"]}')
    answer = lambda r: F.concat(F.lit('Sure:\n{"additional_risks": ['), r, F.lit("]}\nbye"))
    first = answer(risk(when("p_partkey % 4 = 0", "security", "concurrency"), when("p_partkey % 4 = 3", "E9", "E1")))
    second = answer(when("p_partkey % 4 = 2", "", risk(when("p_partkey % 4 = 0", "security", "concurrency"), "E1")))
    parts = table(spark, sf_dir, "part")
    change = F.col("p_partkey").cast("string").alias("change_id")
    answers = parts.select(change, F.posexplode(F.array(first, second)).alias("sample", "text"))
    findings = parts.select(change, F.lit("F-1").alias("id"), F.lit("security").alias("category"), F.lit("deterministic").alias("kind"), F.lit("a.py").alias("file"), (F.col("p_size") + 2).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    cited = parts.select(change, F.lit("E1").alias("id"), F.lit("a.py").alias("file"), F.col("p_size").cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit("x").alias("excerpt"))
    kept_findings, new, rejected = synthesis.synthesised(findings, cited, cited.select("change_id", F.col("file").alias("path")), answers, parts.select(change, F.lit(2).alias("samples")), tasks(parts, each=50_000))
    none = F.lit(None).cast("double").alias("support")
    out = kept_findings.select("change_id", F.lit("rule").alias("which"), "id", none, (F.size("corroborated_by") > 0).alias("backed"))
    out = out.unionByName(new.select("change_id", F.lit("ai").alias("which"), F.lit(None).cast("string").alias("id"), "support", F.lit(False).alias("backed")))
    return out.unionByName(rejected.select("change_id", F.lit("rejected").alias("which"), F.col("reason").alias("id"), none, F.lit(False).alias("backed")))


@query("""WITH c AS (SELECT p_partkey AS k, p_partkey % 5 AS m FROM part), p AS (SELECT 'baseline-keyword' AS system, k, m IN (0, 1) AS hit, m = 2 AS wrong FROM c UNION ALL SELECT 'rules', k, m = 0, false FROM c), n AS (SELECT system, count(*) FILTER (hit) AS tp, count(*) FILTER (wrong) AS fp, count(*) FILTER (k % 5 < 2 AND NOT hit) AS fn, count(*) FILTER (wrong) AS wrong_negatives FROM p GROUP BY system)
 SELECT system, tp, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 4) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4) AS recall, wrong_negatives FROM n""")
def systems_compared(spark, sf_dir):
    """The keyword baseline and the rules over the same labelled changes, one of five without a label but with a word."""
    line = F.coalesce(when("p_partkey % 5 = 0", "x = eval(y{k})"), when("p_partkey % 5 = 1", "z = pickle.loads(b)"), when("p_partkey % 5 = 2", "eval(c{k})"), text("plain {s}"))
    diff = diff_lines(patches(table(spark, sf_dir, "part"), F.col("p_partkey"), F.lit("a.py"), line))
    rules = line_findings(diff.where("content like 'x = %'")).withColumn("end_line", F.lit(None).cast("int"))
    cases = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("case_id"), (F.col("p_partkey") % 5 == 2).alias("negative"), F.lit("x").alias("category"))
    labels = table(spark, sf_dir, "part").where("p_partkey % 5 < 2").select(F.col("p_partkey").cast("string").alias("case_id"), F.lit("l").alias("label_id"), F.lit("security").alias("category"), F.lit("a.py").alias("file"), F.lit(1).alias("line_lo"), F.lit(1).alias("line_hi"))
    found = kept(baselines.keywords(diff).unionByName(baselines.of_findings(rules, "rules")), "predictions")
    return baselines.compared(found, labels, cases).select("system", "tp", "fp", "fn", "precision", "recall", "wrong_negatives")
