"""What grows with the tables stays out of the driver, is dealt over all tasks, and is handed on in bounded pieces."""

import os

import pyarrow as pa
import pytest

from patchloom.operators.matching import maximum_matching
from patchloom.plans.report import to_sarif
from patchloom.queries import QUERIES
from patchloom.sources.coverage import coverage_lines
from patchloom.sources.diff import pieces
from patchloom.sources.python_code import parsed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["migration_rules", "whole_heads"])
def test_sides_that_grow_are_not_sent_to_the_driver(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("name", ["code_symbols"])
def test_files_of_a_small_table_are_parsed_by_all_tasks(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == 4


def test_equal_texts_side_by_side_are_parsed_once(spark):
    seen = []

    def parser(path):
        return lambda text: {"error": None, "error_line": len(text), "symbols": [], "imports": [], "calls": [], "identifiers": [{"name": str(len(seen)), "line": seen.append(text)}]}

    ways = {"py": parser("py"), "js": parser("js")}
    rows = [("c", "base", "a.py", "x"), ("c", "head", "a.py", "x"), ("c", "head", "a.js", "x"), ("c", "head", "n.py", None), (None, "head", "b.py", "yy")]
    files = spark.createDataFrame(rows, "change_id string, side string, path string, text string").coalesce(1)
    got = parsed(files, lambda path: ways[path[-2:]]).collect()
    assert [(r.change_id, r.side, r.path, r.error_line, r.identifiers[0].name) for r in got] == [("c", "base", "a.py", 1, "0"), ("c", "head", "a.py", 1, "0"), ("c", "head", "a.js", 1, "1"), ("c", "head", "n.py", 0, "2"), (None, "head", "b.py", 2, "3")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lcov_is_cut_within_its_row(spark):
    text = "DA:9,9\nSF:a.py\r\nDA:1,0\r\nDA:2,5 \nxDA:3,1\nend_of_record\nDA:4,1\nSF:b.py\nDA:1,2\nSF:\nDA:5,5\nSF:c.py\nend_of_record x\nDA:7,0\nDA:7,3"
    got = coverage_lines(spark.createDataFrame([("c", text + "\nend_of_record"), ("d", None)], "change_id string, text string"))
    assert sorted((r.path, r.line, r.hits) for r in got.collect()) == [("a.py", 1, 0), ("a.py", 2, 5), ("b.py", 1, 2), ("c.py", 7, 3)]
    assert "Window" not in plan_of(got)


def test_patches_go_on_in_pieces():
    patch = "--- a/a\n+++ b/a\n@@ -0,0 +1,5000 @@\n" + "+x\n" * 5000
    out = list(pieces(iter([pa.RecordBatch.from_pydict({"change_id": [str(k) for k in range(12)], "patch_text": [patch] * 12})])))
    assert sum(b.num_rows for b in out) == 60_000 and max(b.num_rows for b in out) <= 25_000


def test_sarif_is_put_together_by_one_shuffle_more(spark):
    rows = [("c", "1", "R2", "low", "b"), ("c", "2", "R1", "high", "a"), ("c", "3", "R2", "high", "c"), ("c", "3", "R2", "high", "c")]
    found = spark.createDataFrame(rows, "change_id string, id string, rule_id string, severity string, title string").selectExpr("*", "'ai' kind", "'low' confidence", "'f' file", "1 start_line")
    out = to_sarif(found)
    assert plan_of(out).count("Exchange") <= 2 and "Window" not in plan_of(out)
    sarif = out.first().sarif
    assert sarif.index('"id":"R1"') < sarif.index('"id":"R2"') and [p.split(",")[0] for p in sarif.split('"ruleIndex":')[1:]] == ["0", "1", "1"] and '"text":"c"}}' in sarif


def test_cases_are_matched_without_a_call_each(spark):
    rows = [(None if k == 7 else str(k), p, label) for k in range(40) for p, label in (("p1", "l1"), ("p1", "l2"), ("p2", "l1"), ("p3", "l3"))]
    out = maximum_matching(spark.createDataFrame(rows, "case_id string, pred_id string, label_id string"))
    assert "MapInArrow" in plan_of(out) and "FlatMapGroups" not in plan_of(out)
    got = {(r.case_id, r.pred_id, r.label_id) for r in out.collect()}
    assert got == {(None if k == 7 else str(k), p, label) for k in range(40) for p, label in (("p1", "l2"), ("p2", "l1"), ("p3", "l3"))}


def test_plain_bodies_need_no_tokenizer_and_similarity_no_table(monkeypatch):
    import difflib
    import tokenize

    from patchloom.plans.renames import similarity
    from patchloom.sources.python_code import normal

    odd = ["x = f'{a}'", "x = 1.5 + .5", "# c\ny = '''a\nb'''", "é = 1", "a = 1_0if b else 0x1F", "b'q' 'r'", "x = 'a\\'b'", "y = 'p' 'q'''\n"]
    assert [normal(t) for t in odd] == ["x = f' { a } '", "x = 1.5 + .5", "y = '''a\nb'''", "é = 1", "a = 1_0 if b else 0x1F", "b'q' 'r'", "x = 'a\\'b'", "y = 'p' 'q' ''"]
    monkeypatch.setattr(tokenize, "generate_tokens", None)
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert normal('def f(a, *b):\n    x = a[1:2] if a != 10 else "q  r"\n') == 'def f ( a , * b ) : x = a [ 1 : 2 ] if a != 10 else "q  r"'
    assert similarity("abcd", "bcde", 0.5) == 0.75 and similarity("ab", "zz") == 0.0


def dealt_by(df):
    """The numbers of tasks that a plan's shuffles deal rows over."""
    import re

    return {int(n) for n in re.findall(r"Exchange hashpartitioning\([^\n]*, (\d+)\), ", plan_of(df))}


def test_tasks_grow_with_rows(spark):
    from patchloom.sources.tables import tasks

    assert tasks(spark.range(100), each=10) == 10 and tasks(spark.range(100), spark.range(101), each=100) == 4


def test_lines_of_coverage_lie_over_as_many_tasks_as_asked(spark):
    from patchloom.plans.coverage_gaps import patch_coverage

    diff = spark.createDataFrame([("c", f"src/f{k % 3}.py", "add", k) for k in range(30)], "change_id string, path string, kind string, new_line int")
    seen = spark.createDataFrame([("c", f"f{k % 2}.py", k, k % 5) for k in range(30)] + [("c", "f0.py", 0, 4)], "change_id string, path string, line int, hits int")
    got = patch_coverage(diff, seen, 7)
    assert dealt_by(got) == {7}
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in patch_coverage(diff, seen).collect()]
    assert got.first().executable == 10


def test_claims_lie_over_as_many_tasks_as_asked(spark):
    from patchloom.plans.grounding import verified

    claims = spark.createDataFrame([("c", str(k), None, f"x{k // 2}", ["e"] if k else ["no"], 0, 1) for k in range(4)], "change_id string, claim_id string, target string, text string, evidence_ids array<string>, sample int, samples int")
    evidence = spark.createDataFrame([("c", "e", "a.py", 1, 1, "x")], "change_id string, id string, file string, start_line int, end_line int, excerpt string")
    got = verified(claims, evidence, evidence.selectExpr("change_id", "file path"), evidence.selectExpr("change_id", "id"), 7)
    assert dealt_by(got) == {7}
    assert sorted((r.claim_id, r.reason) for r in got.collect()) == [("0", "unknown_evidence"), ("1", "duplicate"), ("2", None), ("3", "duplicate")]


FILES = "change_id string, side string, path string, text string"


def test_calls_meet_all_that_they_may_mean_in_one_join(spark):
    from patchloom.plans.references import references, resolved_imports
    from patchloom.sources.code import indexed
    from patchloom.sources.tables import kept

    lib = "import json as shadow\nclass C:\n    def go_on(self):\n        self.end_it()\n        free()\n        shadow()\n    def end_it(self):\n        pass\ndef free():\n    pass\n"
    files = spark.createDataFrame([("c", "head", "m.py", lib), ("c", "head", "u.py", "import m\nfrom m import C as D, free\nD.end_it(1)\nm.free()\nfree()\nx.go_on()\n")], FILES)
    index = kept(indexed(files, "symbols", "imports", "calls"), "calls-once")
    got = references(index, kept(resolved_imports(index), "calls-once-imports"))
    assert plan_of(got).count("Generate explode(calls") == 1
    calls = sorted((r.path, r.line, r.target, r.symbol, r.resolution, r.drop_first) for r in got.where("kind = 'call'").collect())
    assert calls == [("m.py", 4, "m.py", "C.end_it", "resolved", True), ("m.py", 5, "m.py", "free", "resolved", False), ("u.py", 3, "m.py", "C.end_it", "resolved", False), ("u.py", 4, "m.py", "free", "resolved", False), ("u.py", 5, "m.py", "free", "resolved", False), ("u.py", 6, "m.py", "C.go_on", "name_only", True)]


def test_only_the_wanted_parts_of_an_index_are_handed_on(spark):
    from patchloom.sources.code import indexed

    got = indexed(spark.createDataFrame([("c", "head", "a.py", "import b\nc(d)\n")], FILES), "imports")
    assert got.columns == ["change_id", "side", "path", "imports"] and got.first().imports[0].module == "b"


def test_names_and_whole_numbers_need_no_unparser(monkeypatch):
    import ast

    from patchloom.sources.python_code import index

    monkeypatch.setattr(ast, "unparse", None)
    found = index("@d\ndef f(a: int, b=1) -> str:\n    return a\n")["symbols"][0]
    assert (found["decorators"], found["returns"], [(p["default"], p["annotation"]) for p in found["params"]]) == (["d"], "str", [(None, "int"), ("1", None)])


def test_scripts_are_found_by_the_few_paths_that_mean_them(spark):
    from patchloom.plans.references import names

    paths = ["web/d/index.tsx", "web/d.js", "a.ts.js", "index.ts", "B.TS", "pkg/m.py", "tests/m.py", "x/y/__init__.py", "z/y.py"]
    got = names(spark.createDataFrame([("c", p) for p in [*paths, "pkg/m.py"]], "change_id string, path string"))
    assert "Expand" not in plan_of(got)
    rows = {(r.key, r.target, r.tail) for r in got.collect()}
    assert {r for r in rows if r[0][0] == "@"} == {("@web/d/index.tsx", "web/d/index.tsx", 0), ("@web/d/index", "web/d/index.tsx", 2), ("@web/d", "web/d/index.tsx", 10), ("@web/d.js", "web/d.js", 0), ("@web/d", "web/d.js", 3), ("@a.ts.js", "a.ts.js", 0), ("@a.ts", "a.ts.js", 3), ("@index.ts", "index.ts", 0), ("@index", "index.ts", 1), ("@B.TS", "B.TS", 0)}
    assert {(k, t) for k, t, _ in rows if k[0] == "~"} == {("~m", "pkg/m.py"), ("~pkg/m", "pkg/m.py"), ("~tests/m", "tests/m.py"), ("~x/y", "x/y/__init__.py"), ("~z/y", "z/y.py")}


BEFORE = "class A:\n    def work_with(self, a, b=1):\n        return a\ndef f(a, b=1):\n    return a\ndef g(a):\n    return a\ndef lone(a, b=1) -> int:\n    return a\ndef old_name(x):\n    return [q for q in range(x) if q > 1]\ndef gone():\n    pass\n"
AFTER = "class A:\n    def work_with(self, a):\n        return a\ndef f(a):\n    return a\nasync def g(a):\n    return a\ndef lone(a, b=2) -> str:\n    return a\ndef new_name(x):\n    return [q for q in range(x) if q > 1]\n"
USE = "from m import f, g, old_name\nf(1, b=2)\ng(1)\nx.work_with(1, b=2)\nold_name(3)\n"
CONTRACT_FILES = [("c", s, p, t) for s, p, t in (("base", "m.py", BEFORE), ("head", "m.py", AFTER), ("base", "u.py", USE), ("head", "u.py", USE), ("base", "bad.py", "x = ("), ("head", "bad.py", "x = ("), ("base", "worse.py", ""), ("head", "worse.py", "x = ("))]


def test_changes_and_uses_meet_once_for_all_contract_rules(spark):
    from patchloom.plans.api_contract import CONTRACT, contract_findings
    from patchloom.sources.code import indexed

    got = contract_findings(indexed(spark.createDataFrame(CONTRACT_FILES, FILES).coalesce(1), *CONTRACT, once=True))
    plan = plan_of(got)
    assert plan.count("/references-") == 1 and plan.count("/named-changes-") <= 3
    assert sorted((r.rule_id, r.severity, r.confidence, r.file, r.symbol or "", *r.evidence) for r in got.collect()) == [
        ("CG-API-001", "high", "high", "m.py", "f", "u.py:2"), ("CG-API-001", "medium", "medium", "m.py", "A.work_with", "u.py:4"), ("CG-API-002", "critical", "high", "m.py", "old_name", "u.py:1", "u.py:5"), ("CG-API-004", "high", "high", "m.py", "g", "u.py:3"),
        ("CG-API-005", "medium", "medium", "m.py", "lone"), ("CG-API-006", "low", "medium", "m.py", "lone"), ("CG-API-007", "low", "medium", "m.py", "gone"), ("CG-SYN-001", "critical", "high", "worse.py", ""),
    ]


def test_a_file_left_as_it_is_is_one_row(spark):
    from patchloom.sources.code import indexed

    files = spark.createDataFrame(CONTRACT_FILES, FILES).coalesce(1)
    assert [(r.side, r.path) for r in indexed(files, "symbols", once=True).collect()] == [("base", "m.py"), ("head", "m.py"), ("both", "u.py"), ("both", "bad.py"), ("base", "worse.py"), ("head", "worse.py")]
    assert indexed(files, "symbols").where("side = 'both'").count() == 0


def test_symbols_are_compared_once_for_what_no_test_reaches(spark):
    from patchloom.plans.api_contract import CONTRACT
    from patchloom.plans.tests_mapping import untested
    from patchloom.sources.code import indexed
    from patchloom.sources.tables import kept

    lib = "def a():\n    return {0}\ndef _b():\n    return {0}\ndef _c():\n    return {0}\ndef d():\n    return _b(), {0}\ndef e():\n    return a()\n"
    test = "from lib import d, e\ndef test_it():\n    d()\n    e()\n"
    files = [("c", "base", "lib.py", lib.format(1)), ("c", "head", "lib.py", lib.format(2)), ("c", "base", "test_lib.py", test), ("c", "head", "test_lib.py", test)]
    got = untested(kept(indexed(spark.createDataFrame(files, FILES).coalesce(1), *CONTRACT, once=True), "compared-once"))
    assert plan_of(got).count("Generate explode(symbols") == 1
    assert sorted((r.symbol, r.severity) for r in got.collect()) == [("_c", "low"), ("a", "medium")]
