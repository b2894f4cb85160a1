import hashlib
import json

from pyspark.sql import functions as F

from patchloom.plans import baselines, synthesis
from patchloom.sources.diff import diff_lines


def test_fingerprints_like_the_standard_library(spark):
    schema = json.dumps({"b": [1], "a": {"z": True}}, sort_keys=True, separators=(",", ":"))
    rows = [("p", "m", "i", "v", 'say "ü" \\ \n', "user\ttext </x>", schema, "s", 4096, 0.0, 7), ("p", "m", "i", "v", "", "", "{}", "s", 1, 0.5, None)]
    names = "provider model prompt_id prompt_version system user schema schema_name max_output_tokens temperature seed".split()
    requests = spark.createDataFrame(rows, "provider string, model string, prompt_id string, prompt_version string, system string, user string, schema string, schema_name string, max_output_tokens int, temperature double, seed int")
    got = [r.f for r in requests.select(synthesis.fingerprint().alias("f")).collect()]
    want = [hashlib.sha256(json.dumps(dict(zip(names, r, strict=True)) | {"schema": json.loads(r[6])}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for r in rows]
    assert got == want
    recorded = spark.createDataFrame([(want[0], "old", "2024-01-01"), (want[0], "new", "2024-02-01"), ("x", "other", "2024-01-01")], "fingerprint string, text string, recorded_at string")
    assert {(r.text, r.error) for r in synthesis.replayed(requests, recorded).collect()} == {("new", None), (None, "replay_miss")}


def answer(*risks):
    return "Here it is:\n```json\n" + json.dumps({"finding_notes": [], "additional_risks": [dict(zip(("title", "category", "severity", "confidence", "description", "evidence_ids"), r, strict=True)) for r in risks], "overall_assessment": "fine"}) + "\n```\nDone."


def test_risks_are_checked_agreed_and_merged(spark):
    backing, alone, lonely = ("Unsafe call", "security", "high", "high", "See line 5", ["E1"]), ("Race", "concurrency", "medium", "low", "Two writers\x07 meet", ["E9", "E2", "E2"]), ("Odd", "logic_change", "low", "low", "perhaps", ["E2"])
    unknown, tested = ("Ghost", "security", "high", "high", "x", ["E7"]), ("Tests", "test_gap", "low", "low", "All tests passed.", ["E1"])
    answers = [("c", 0, answer(backing, alone, lonely, unknown, tested)), ("c", 1, answer(("Other words", "concurrency", "low", "low", "y", ["E2"]), ("Unsafe call", "security", "high", "high", "See line 5", ["E1"]))), ("c", 2, "no json {"), ("d", 0, "{}"), ("e", 0, None)]
    evidence = spark.createDataFrame([("c", "E1", "a.py", 5, 6, "x"), ("c", "E2", "b.py", 3, None, "y"), ("c", "E9", None, None, None, "z")], "change_id string, id string, file string, start_line int, end_line int, excerpt string")
    findings = spark.createDataFrame([("c", "F-1", "security", "deterministic", "a.py", 8, None), ("c", "F-0", "security", "deterministic", "a.py", 9, None), ("c", "F-2", "concurrency", "ai", "b.py", 3, None)], "change_id string, id string, category string, kind string, file string, start_line int, end_line int")
    paths = spark.createDataFrame([("c", "a.py"), ("c", "b.py")], "change_id string, path string")
    samples = spark.createDataFrame([("c", 3), ("d", 1), ("e", 1)], "change_id string, samples int")
    kept, new, rejected = synthesis.synthesised(findings, evidence, paths, spark.createDataFrame(answers, "change_id string, sample int, text string"), samples)
    assert {r.id: r.corroborated_by for r in kept.collect()} == {"F-1": ["ai"], "F-0": [], "F-2": []}
    assert [(r.rule_id, r.file, r.start_line, r.title, r.description, r.evidence_ids, r.support) for r in new.collect()] == [("AI-RISK", "b.py", 3, "Race", "Two writers meet", ["E9", "E2"], 0.667)]
    assert {(r.claim_id, r.reason) for r in rejected.collect()} == {("0-3", "unknown_evidence"), ("0-4", "claims_test_result")}
    cited = spark.createDataFrame([("c", ["E1"])], "change_id string, evidence_ids array<string>")
    assert [r.id for r in synthesis.pruned_evidence(evidence, cited).collect()] == ["E1"]


def test_lenient_answers_and_clips(spark):
    texts = ['{"overall_assessment": "a"}', 'x {"additional_risks": []} y', "{}", '{"other": 1}', "{broken", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", synthesis.parsed(F.col("t")).isNotNull().alias("ok")).collect()
    assert [r.ok for r in sorted(got)] == [True, True, False, False, False, False, False]
    row = spark.createDataFrame([("  a\x00b\n" + "c" * 20,)], "t string").select(synthesis.clip(F.col("t"), 10).alias("s"), synthesis.clip(F.col("t"), 99).alias("l")).first()
    assert row.s == "ab\n" + "c" * 6 + "…" and row.l == "ab\n" + "c" * 20


def test_systems_are_compared(spark):
    patch = "--- /dev/null\n+++ b/a.py\n@@ -0,0 +1,4 @@\n+x = eval(y)\n+plain\n+if a > b: pass\n+password = 'abc'\n--- /dev/null\n+++ b/package.json\n@@ -0,0 +1 @@\n+{}\n"
    diff = diff_lines(spark.createDataFrame([("c", patch), ("n", patch.replace("eval(y)", "y").replace(" > ", " "))], "change_id string, patch_text string"))
    words = baselines.keywords(diff)
    assert {(r.case_id, r.file, r.start_line, r.category) for r in words.collect()} == {("c", "a.py", 1, "security"), ("c", "a.py", 3, "logic_change"), ("c", "a.py", 4, "secret_exposure"), ("c", "package.json", 1, "dependency"), ("n", "a.py", 4, "secret_exposure"), ("n", "package.json", 1, "dependency")}
    rules = spark.createDataFrame([("c", "F-1", "security", "a.py", 1, None, "high")], "change_id string, id string, category string, file string, start_line int, end_line int, severity string")
    labels = spark.createDataFrame([("c", "l1", "security", "a.py", 1, 1), ("c", "l2", "test_gap", "a.py", 1, 1)], "case_id string, label_id string, category string, file string, line_lo int, line_hi int")
    cases = spark.createDataFrame([("c", False, "x"), ("n", True, "x")], "case_id string, negative boolean, category string")
    got = {r.system: (r.tp, r.fp, r.fn, r.precision, r.recall, r.wrong_negatives) for r in baselines.compared(words.unionByName(baselines.of_findings(rules, "rules")), labels, cases).collect()}
    assert got == {"baseline-keyword": (1, 5, 1, 0.1667, 0.5, 1), "rules": (1, 0, 1, 1.0, 0.5, 0)}


def test_changed_symbols_as_a_system(spark):
    from patchloom.plans.api_contract import symbol_changes
    from patchloom.sources.code import indexed

    files = [("c", "base", "a.py", "def f(a):\n    return 1\ndef g(a):\n    return 1\ndef gone(): pass\nX = 1\n"), ("c", "head", "a.py", "def f(a, b):\n    return 1\ndef g(a):\n    return 2\ndef new(): pass\nX = 2\n")]
    changes = symbol_changes(indexed(spark.createDataFrame(files, "change_id string, side string, path string, text string")))
    assert {(r.start_line, r.category) for r in baselines.changed_symbols(changes).collect()} == {(1, "breaking_change"), (3, "test_gap"), (5, "test_gap")}
