import random

import numpy as np
from pyspark.sql import functions as F

from patchloom.plans import evaluation, evidence, migrations, secrets
from patchloom.plans.line_rules import dependency_changes
from patchloom.plans.workspace import aligned, whole_head
from patchloom.sources.diff import diff_lines
from patchloom.sources.manifests import dependencies

FILES = "change_id string, side string, path string, text string"


def added(spark, files, change="c"):
    patch = "".join(f"--- /dev/null\n+++ b/{p}\n@@ -0,0 +1,{len(ls)} @@\n" + "".join(f"+{x}\n" for x in ls) for p, ls in files.items())
    return diff_lines(spark.createDataFrame([(change, patch)], "change_id string, patch_text string"))


def test_migrations_are_graded(spark):
    lines = {
        "db/migrations/1.sql": ["DROP TABLE t;", "truncate table x", "ALTER TABLE a DROP legacy_one", "ALTER TABLE a DROP CONSTRAINT c", "DELETE FROM a;", "DELETE FROM a WHERE b = 1", "alter table a rename column old_two to b", "ALTER COLUMN a TYPE int", "alter table a alter column b set not null", "-- drop table t", "SELECT 1"],
        "alembic/v.py": ["op.drop_table('t')", "op.drop_column('t', 'gone_three')", "op.alter_column('t', 'old_four', new_column_name='n')", "op.alter_column('t', 'five', nullable=False)", "migrations.RemoveField(model_name='m', name='gone_six')", "# op.drop_table('t')"],
        "app.py": ["x = 'DROP TABLE t'", "db.execute('DROP TABLE t')", "t.dropColumn('gone_seven')"],
    }
    got = [(r.path.split("/")[-1], r.line, r.operation, r.severity, r.column) for r in migrations.migrations(added(spark, lines)).collect()]
    assert sorted(got) == sorted([
        ("1.sql", 1, "DROP TABLE", "critical", None), ("1.sql", 2, "TRUNCATE", "critical", None), ("1.sql", 3, "DROP COLUMN", "high", None), ("1.sql", 5, "DELETE without WHERE", "high", None), ("1.sql", 7, "RENAME", "high", "old_two"),
        ("1.sql", 8, "column type change", "medium", None), ("1.sql", 9, "SET NOT NULL", "medium", None), ("v.py", 1, "op.drop_table", "critical", None), ("v.py", 2, "op.drop_column", "high", "gone_three"), ("v.py", 3, "column rename (op.alter_column)", "high", "old_four"),
        ("v.py", 4, "op.alter_column", "medium", None), ("v.py", 5, "migrations.RemoveField", "high", "gone_six"), ("app.py", 2, "DROP TABLE", "critical", None), ("app.py", 3, "knex dropColumn", "high", "gone_seven"),
    ])


def test_mentions_like_brute_force(spark):
    rng = random.Random(7)
    diff = added(spark, {"db/migrations/1.sql": ["ALTER TABLE t DROP COLUMN legacy_code;", "ALTER TABLE t DROP COLUMN name;", "ALTER TABLE t DROP COLUMN abc;", "ALTER TABLE t DROP COLUMN unused_one;"]})
    files = {f"src/f{k}.py": "\n".join(rng.choice(["x = legacy_code", "legacy_codes = 1", "row['legacy_code'] # legacy_code", "name = abc", ""]) for _ in range(rng.choice([0, 3, 12, 30]))) for k in range(9)}
    files |= {"notes.md": "legacy_code", "db/migrations/2.sql": "legacy_code", "schema/x.py": "legacy_code", "n.py": None}
    refs = []
    for path, text in sorted(files.items()):
        if path.endswith(".py") and text and not path.startswith("schema"):
            for n, line in enumerate(text.split("\n"), 1):
                if any(w == "legacy_code" for w in line.replace("'", " ").replace("[", " ").replace("]", " ").split()):
                    refs.append((path, n))
                    if len(refs) >= 20:
                        break
    table = spark.createDataFrame([("c", "head", p, t) for p, t in files.items()] + [("d", "head", "z.py", "legacy_code"), ("c", "base", "y.py", "legacy_code")], FILES)
    got = sorted((r.path, r.line) for r in migrations.mentions(migrations.migrations(diff), table).collect())
    assert len(refs) > 20 and got == refs
    two = migrations.migration_findings(diff, table).where("rule_id = 'CG-MIG-002'").collect()
    assert [(r.detail, r.start_line, r.confidence, r.n, len(r.evidence)) for r in two] == [("legacy_code", 1, "medium", len(refs), 6)]


def test_secrets_are_graded_and_hidden(spark):
    token, value = "ghp_" + "a1B2" * 9, "q7Zk2Lw9Xv4Tn8Rb3Mc6Yd1Hs5Jf0Pg"
    lines = {"app.py": [f"T = '{token}'", f'SERVICE_API_KEY = "{value}"', "API_KEY = 'aaaaaaaaaaaaaaaaaaaaaaaa'", "secret = 'your_secret_goes_here'", f"other = '{value}'", f"token = '{token}'"], "tests/test_a.py": [f"password: '{value}'", f"x = '{token}'"]}
    rows = secrets.secret_findings(added(spark, lines)).collect()
    assert {(r.file, r.start_line, r.kind, r.severity, r.confidence) for r in rows} == {
        ("app.py", 1, "provider", "critical", "high"), ("app.py", 2, "generic", "high", "medium"), ("app.py", 6, "provider", "critical", "high"), ("tests/test_a.py", 1, "generic", "medium", "low"), ("tests/test_a.py", 2, "provider", "critical", "high"),
    }
    assert len(rows) == 5 and not any(token in str(r) or value in str(r) for r in rows)
    texts = spark.createDataFrame([(x,) for ls in lines.values() for x in ls], "t string").select(secrets.redacted(F.col("t")).alias("t")).collect()
    assert not any(token in r.t for r in texts) and sum("****" in r.t for r in texts) == 5


TOML = '[project]\ndependencies = ["Flask[async]>=2 ; python_version > \'3\'", "same==1"]\n[project.optional-dependencies]\nx = ["extra_one~=1.4"]\n[dependency-groups]\ndev = ["tool (>=1)", {include-group = "x"}]\n[tool.poetry.dependencies]\npython = "^3"\nOld_Pin = "1.2.3"\nt = {version = "^2"}\n'


def test_manifests(spark):
    rows = [
        ("c", "head", "pyproject.toml", TOML), ("c", "head", "web/package.json", '{"dependencies": {"react": "^18.0.0", "@s/x": "1.2.3"}, "devDependencies": {"jest": "29"}, "name": "n"}'), ("c", "head", "requirements-dev.in", "a==1 # x\n-r other.txt\ngit+https://x\nb @ https://u\nA==2\n"),
        ("c", "head", "package.json", "broken"), ("d", "head", "pyproject.toml", "broken ["), ("d", "head", "requirements.txt", None), ("c", "head", "package-lock.json", '{"dependencies": {"z": "1"}}'),
    ]
    got = {(r.path, r.name): r.spec for r in dependencies(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {
        ("pyproject.toml", "flask"): ">=2", ("pyproject.toml", "same"): "==1", ("pyproject.toml", "extra-one"): "~=1.4", ("pyproject.toml", "tool"): ">=1", ("pyproject.toml", "old-pin"): "1.2.3", ("pyproject.toml", "t"): "^2",
        ("web/package.json", "react"): "^18.0.0", ("web/package.json", "@s/x"): "1.2.3", ("web/package.json", "jest"): "29", ("requirements-dev.in", "a"): "==2",
    }


def test_dependency_rules_of_all_manifests(spark):
    from patchloom.sources.code import indexed
    from patchloom.sources.python_code import part

    sides = {
        "pyproject.toml": ('[project]\ndependencies = ["one==1.0", "two==1.0", "gone"]\n', '[project]\ndependencies = ["one==2.0", "two>=1", "new"]\n'),
        "package.json": ('{"dependencies": {"react": "^17.1", "pin": "1.2.3", "@s/lost": "1", "idle": "1"}}', '{"dependencies": {"react": "^18.0", "pin": "^1.2.3", "add": "1"}}'),
    }
    files = spark.createDataFrame([("c", side, p, t) for p, texts in sides.items() for side, t in zip(("base", "head"), texts, strict=True)], FILES)
    code = spark.createDataFrame([("c", "head", "a.ts", 'import x from "@s/lost/deep";\nimport one from "idle-not";'), ("c", "head", "a.py", "import gone.sub\nimport idle\n")], FILES)
    got = {(r.rule_id, r.name): r.severity for r in dependency_changes(files, part(indexed(code), "imports")).collect()}
    assert got == {
        ("CG-DEP-001", "one"): "medium", ("CG-DEP-004", "two"): "low", ("CG-DEP-003", "gone"): "high", ("CG-DEP-002", "new"): "low",
        ("CG-DEP-001", "react"): "medium", ("CG-DEP-004", "pin"): "low", ("CG-DEP-003", "@s/lost"): "high", ("CG-DEP-003", "idle"): "low", ("CG-DEP-002", "add"): "low",
    }


def test_budget_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(0, 60)) for k in range(20) for i in range(rng.randint(1, 30))]
    want = {}
    left = {}
    for k, i, s in rows:
        room = left.setdefault(k, 100)
        want[k, i] = s <= room
        left[k] -= s if s <= room else 0
    got = evidence.within_budget(spark.createDataFrame(rows, "k int, i int, s int").repartition(3), "k", "i", "s", 100).collect()
    assert {(r.k, r.i): r.included for r in got} == want and any(not v for v in want.values())


PATCH = "--- a/m.py\n+++ b/m.py\n@@ -3,3 +3,4 @@ def f\n c\n-d\n+D\n+E\n e\n@@ -20,1 +21,1 @@\n-z\n+Z\n"


def test_excerpts_and_rechecks(spark):
    diff = diff_lines(spark.createDataFrame([("c", PATCH), ("d", PATCH)], "change_id string, patch_text string"))
    files = spark.createDataFrame([("c", "head", "m.py", "\n".join("abcDEfghij") + "\n"), ("c", "base", "m.py", "abc")], FILES)
    at = [("c", 1, "head", "m.py", 4, 4), ("c", 2, "head", "m.py", 10, 40), ("c", 3, "head", "m.py", 11, None), ("d", 4, "head", "m.py", 4, 5), ("d", 5, "base", "m.py", 5, None), ("d", 6, "head", "m.py", 12, None), ("d", 7, "head", "m.py", 21, None), ("d", 8, "head", "no.py", 1, 1)]
    places = spark.createDataFrame(at, "change_id string, id int, side string, path string, start_line int, end_line int")
    got = {r.id: (r.excerpt, r.excerpt_start) for r in evidence.excerpts(places, files, diff).collect()}
    assert got == {1: ("b\nc\nD\nE\nf", 2), 2: ("h\ni\nj", 8), 3: (None, None), 4: ("c\nD\nE\ne", 3), 5: ("c\nd\ne", 3), 6: (None, None), 7: ("Z", 21), 8: (None, None)}
    valid = {r.id for r in evidence.valid_ranges(places, files).collect()}
    assert valid == {1, 4, 5, 6, 7, 8}
    token = "ghp_" + "a1B2" * 9
    files = spark.createDataFrame([("c", "head", "a.py", f"x\nt = '{token}'\ny\n")], FILES)
    rows = [(1, "a.py", 1, 3, "x\nt = '****'\ny", 1, True), (2, "a.py", 1, None, "y", None, False), (3, "a.py", 4, 4, None, None, False), (4, None, 1, 1, "x", 1, True), (5, "b.py", 1, 1, None, None, False), (6, "a.py", None, None, "q", None, True), (7, "a.py", 3, 3, "y\nz", 3, False), (8, "a.py", 2, 2, f"t = '{token}'", 2, False), (9, "a.py", 3, 3, None, None, True)]
    cited = spark.createDataFrame([("c", i, "head", p, s, e, x, xs) for i, p, s, e, x, xs, _ in rows], "change_id string, id int, side string, path string, start_line int, end_line int, excerpt string, excerpt_start int")
    assert {r.id: r.holds for r in evidence.rechecked(cited, files).collect()} == {r[0]: r[-1] for r in rows}
    assert evidence.clipped_hunks(diff, 4).groupBy("change_id").count().collect()[0]["count"] == 4


def test_roots_and_heads(spark):
    diff = diff_lines(spark.createDataFrame([(c, PATCH + "--- a/old.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-q\n") for c in ("w", "p", "t")], "change_id string, patch_text string"))
    text = "\n".join([*"abcde", *"x" * 14, "z", ""])
    rows = [("w", "base", "repo/m.py", text), ("w", "base", "repo/old.py", "q\n"), ("w", "base", "repo/b/c.py", "c"), ("p", "base", "m.py", text), ("p", "base", "repo/m.py", ""), ("t", "base", "src/other.py", "")]
    got = aligned(spark.createDataFrame(rows, FILES), diff)
    assert {(r.change_id, r.path) for r in got.collect()} == {("w", "m.py"), ("w", "old.py"), ("w", "b/c.py"), ("p", "m.py"), ("p", "repo/m.py"), ("t", "src/other.py")}
    head = {r.path: r.text for r in whole_head(got.where("change_id = 'w'").drop("side"), diff.where("change_id = 'w'")).collect()}
    assert set(head) == {"m.py", "b/c.py"} and head["b/c.py"] == "c" and head["m.py"].startswith("a\nb\nc\nD\nE\ne\n") and head["m.py"].endswith("Z\n")


def test_bootstrap(spark):
    rng = random.Random(9)
    cases = [(k, *rng.choice([(1, 0, 0), (1, 1, 0), (0, 0, 1), (2, 0, 1), (0, 0, 0)])) for k in range(300)]
    counts = spark.createDataFrame(cases, "c int, tp int, fp int, fn int")
    got = {r.metric: (r.lo, r.hi) for r in evaluation.bootstrap(counts, "c").collect()}
    sums = [sum(c[j] for c in cases) for j in (1, 2, 3)]
    real = {"precision": [], "recall": [], "f1": []}
    for _ in range(2000):
        tp, fp, fn = (sum(c[j] for c in s) for s in [rng.choices(cases, k=len(cases))] for j in (1, 2, 3))
        for m, v in (("precision", tp / (tp + fp)), ("recall", tp / (tp + fn)), ("f1", 2 * tp / (2 * tp + fp + fn))):
            real[m].append(v)
    for m, vs in real.items():
        vs.sort()
        assert abs(got[m][0] - vs[50]) < 0.012 and abs(got[m][1] - vs[1949]) < 0.012, m
    assert got["precision"][0] < sums[0] / (sums[0] + sums[1]) < got["precision"][1]
    k = evaluation.draws(np.arange(20000), np.array([5, 1999]))
    assert abs(k.mean() - 1) < 0.03 and abs(k.var() - 1) < 0.06 and abs(np.corrcoef(k.T)[0, 1]) < 0.03
    assert evaluation.bootstrap(counts.where("false"), "c").count() == 0


def test_agreement_and_rejections(spark):
    results = spark.createDataFrame([("a", "x", "tp", "p1", "l1"), ("b", "x", "tp", "p2", "l2"), ("c", "x", "tp", "p3", "l3"), ("d", "x", "fn", None, "l4")], "case_id string, category string, outcome string, pred_id string, label_id string")
    found = spark.createDataFrame([("a", "p1", "high"), ("b", "p2", "critical"), ("c", "p3", "low")], "case_id string, pred_id string, severity string")
    labels = spark.createDataFrame([("a", "l1", "high"), ("b", "l2", "high"), ("c", "l3", "critical")], "case_id string, label_id string, severity string")
    r = evaluation.severity_agreement(results, found, labels).first()
    assert (r.n, r.exact, r.within_one) == (3, 0.3333, 0.6667)
    runs = results.withColumn("system", F.lit("rules")).unionByName(spark.createDataFrame([("d", "x", "tp", "p", "l4"), ("a", "x", "tp", "p", "l1")], results.schema).withColumn("system", F.lit("other")))
    assert [tuple(r) for r in evaluation.missed_by(runs, "rules").collect()] == [("d", "l4", ["other"])]
    claims = spark.createDataFrame([("a", "no_evidence"), ("b", None), ("c", "no_evidence")], "id string, reason string")
    assert [tuple(r) for r in evaluation.rejections(claims).collect()] == [("no_evidence", 2)]


def test_matching_of_long_chains_and_all_small_graphs():
    from itertools import permutations

    from patchloom.operators.matching import matched

    # p0 must give way along all of them
    chain = {f"p{k:05}": [f"l{k:05}", f"l{k + 1:05}"] for k in range(3000)} | {"q": ["l00000"]}
    assert len(matched(chain)) == 3001
    rng = random.Random(2)
    for _ in range(200):
        edges = [(p, x) for p in "abcd" for x in "wxyz" if rng.random() < 0.4]
        fits = {}
        for p, x in edges:
            fits.setdefault(p, []).append(x)
        got = matched(fits)
        assert len(set(got.values())) == len(got) and all(x in fits[p] for x, p in got.items())
        best = max(sum((p, x) in edges for p, x in zip("abcd", w, strict=True)) for w in permutations("wxyz"))
        assert len(got) == best


def test_rules_on_calls(spark):
    from patchloom.plans.call_rules import call_findings, security_findings
    from patchloom.sources.code import indexed

    texts = {
        "a.py": ["# eval(x)", "s = 'eval(x)'", "from os import system as run", "import yaml as y, pickle", "eval(", "    z", ")", "run(c)", "y.load(f)", "y.load(f, Loader=L)", "y.load(f, L)", "pickle.loads(b)", "import time, os", "async def f():", "    time.sleep(1)", "    def g():", "        time.sleep(2)", "time.sleep(3)", "os.system(q)"],
        "b.ts": ["import {exec as e, execSync} from 'node:child_process';", "import {exec} from './mine';", "exec(x); execSync('ls'); execSync(`ls ${x}`);", "e('a' + b);", "eval(x); new Function(y); // eval(z)", "setTimeout('go()', 1); setTimeout(go, 1);", "el.insertAdjacentHTML('a', b);", "document.write(x); re.exec(s);", "el.innerHTML = x;"],
        "broken.py": ["def (", "eval(x)"],
    }
    diff = added(spark, texts)
    index = indexed(spark.createDataFrame([("c", "head", p, "\n".join(ls) + "\n") for p, ls in texts.items()], FILES))
    got = {(r.rule_id, r.file, r.start_line, r.callee) for r in call_findings(index, diff).collect()}
    assert got == {
        ("CG-SEC-001", "a.py", 5, "eval"), ("CG-SEC-003", "a.py", 8, "run"), ("CG-SEC-004", "a.py", 9, "y.load"), ("CG-SEC-004", "a.py", 12, "pickle.loads"), ("CG-CON-002", "a.py", 15, "time.sleep"), ("CG-SEC-003", "a.py", 19, "os.system"),
        ("CG-SEC-003", "b.ts", 3, "execSync"), ("CG-SEC-003", "b.ts", 4, "e"), ("CG-SEC-001", "b.ts", 5, "eval"), ("CG-SEC-001", "b.ts", 5, "Function"), ("CG-SEC-001", "b.ts", 6, "setTimeout"), ("CG-SEC-002", "b.ts", 7, "el.insertAdjacentHTML"), ("CG-SEC-002", "b.ts", 8, "document.write"),
    }
    both = {(r.rule_id, r.file, r.start_line) for r in security_findings(diff, index).collect()}
    assert both == {(a, b, c) for a, b, c, _ in got} | {("CG-SEC-001", "broken.py", 2), ("CG-SEC-002", "b.ts", 9)}
    # only what the patch touches counts
    assert call_findings(index, diff.where("new_line <> 6 and new_line <> 5 and new_line <> 7")).where("file = 'a.py' and start_line = 5").count() == 0
    assert call_findings(index, diff.where("new_line = 6")).where("file = 'a.py' and start_line = 5").count() == 1


def test_stale_and_unmatched_reports(spark):
    from patchloom.plans.coverage_gaps import stale, unmatched

    files = spark.createDataFrame([("c", "src/a.py", "x = 1\n# note\n\ny = 2\n"), ("c", "src/b.py", "x = 1\ny = 2\n"), ("c", "src/n.py", None), ("d", "src/a.py", "x = 1\n")], "change_id string, path string, text string")
    rows = [("c", "a.py", 1), ("c", "a.py", 4), ("c", "a.py", 9), ("c", "b.py", 1), ("c", "b.py", 2), ("c", "b.py", 2), ("c", "other.py", 1), ("c", "n.py", 1), ("d", "a.py", 1)]
    coverage = spark.createDataFrame([(*r, 1) for r in rows], "change_id string, path string, line int, hits long")
    assert [(r.change_id, r.path, round(r.share, 3)) for r in stale(files, coverage).collect()] == [("c", "src/a.py", 0.333)]
    assert [tuple(r) for r in unmatched(files, coverage).collect()] == [("c", "other.py")]
    assert stale(files.where("false"), coverage).count() == 0
