import json
import random

from patchloom.operators.patch_apply import head_files
from patchloom.plans import coverage_gaps as C
from patchloom.plans import evaluation as E
from patchloom.plans import report as R
from patchloom.plans.grounding import verified
from patchloom.sources.diff import diff_lines
from patchloom.streaming.limiter import admit, limited

FINDING = "change_id string, id string, rule_id string, category string, kind string, severity string, confidence string, file string, start_line int, title string, excerpt string"
FOUND = [("c", "F-2", "R2", "security", "deterministic", "low", "high", "b.py", 3, "low `one` <b>", "x = ```y```"), ("c", "F-1", "R1", "security", "deterministic", "critical", "high", "a.py", None, "first", None), ("c", "F-1", "R1", "security", "deterministic", "critical", "high", "a.py", None, "first", None), ("c", "F-3", "R2", "security", "ai", "low", "high", "b.py", 9, "last", "z"), ("d", "F-9", "R9", "x", "ai", "high", "low", "q", 1, "model's", None)]


def diffed(spark, patch):
    return diff_lines(spark.createDataFrame([("c", patch)], "change_id string, patch_text string"))


def test_reports(spark):
    f = spark.createDataFrame(FOUND, FINDING)
    sarif = {r.change_id: json.loads(r.sarif) for r in R.to_sarif(f).collect()}
    run = sarif["c"]["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R1", "R2"]
    assert [(r["ruleIndex"], r["level"], r["partialFingerprints"]["findingId"]) for r in run["results"]] == [(0, "error", "F-1"), (1, "note", "F-2"), (1, "note", "F-3")]
    assert [x["id"] for x in json.loads(R.to_json(f).where("change_id = 'c'").first().json)["findings"]] == ["F-1", "F-2", "F-3"]
    text = R.to_markdown(f, 2).where("change_id = 'c'").first().markdown
    assert "# 3 findings" in text and "…and 1 more" in text and "````\nx = ```y```\n````" in text and "&lt;b&gt;" in text and "last" not in text
    assert R.to_text(f).where("change_id = 'c'").first().text.split("\n")[0].startswith("critical R1")
    assert {(r.change_id, r.fails, r.priority) for r in R.gate(f).collect()} == {("c", True, "block"), ("d", False, "elevated")}
    cut = spark.createDataFrame([("ab\ncd\nef",), ("ab",), ("abcdefgh",)], "t string").select(R.comment(R.F.col("t"), 5).alias("x")).collect()
    assert [r.x for r in cut] == ["ab\n\n…cut", "ab", "abcde\n\n…cut"]


def test_patches_apply(spark):
    import difflib

    rng = random.Random(5)
    changes, base, want = [], [], {}
    for k in range(25):
        old = [f"line {rng.randrange(9)}" for _ in range(rng.randrange(1, 40))]
        new = [x for x in old if rng.random() > 0.1]
        for _ in range(3):
            new.insert(rng.randrange(len(new) + 1), f"new {rng.randrange(9)}")
        patch = "".join(difflib.unified_diff([x + "\n" for x in old], [x + "\n" for x in new], "a/f.py", "b/f.py", n=rng.randrange(4)))
        if patch:
            changes.append((f"c{k}", patch))
            base.append((f"c{k}", "f.py", "\n".join(old)))
            want[f"c{k}"] = "\n".join(new)
    changes += [("gone", "--- a/f.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n"), ("off", "--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@\n-zzz\n+y\n"), ("drift", "--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@\n-here\n+there\n"), ("none", "--- a/n.py\n+++ b/n.py\n@@ -1 +1 @@\n-a\n+b\n"), ("new", "--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+a\n")]
    base += [("gone", "f.py", "a"), ("off", "f.py", "x"), ("drift", "f.py", "x\n" * 50 + "here")]
    got = {r.change_id: r for r in head_files(spark.createDataFrame(base, "change_id string, path string, text string"), diff_lines(spark.createDataFrame(changes, "change_id string, patch_text string"))).collect()}
    assert {k: got[k].text for k in want} == want
    assert (got["gone"].text, got["gone"].error, got["off"].text, got["none"].error, got["new"].text) == (None, None, None, "no base text", "a\n")
    assert got["off"].error and got["drift"].text.endswith("there")


def test_coverage_gaps(spark):
    patch = "".join(f"--- a/{p}\n+++ b/{p}\n@@ -0,0 +1,4 @@\n" + "".join(f"+x{i}\n" for i in range(4)) for p in ("src/a.py", "src/b.py", "src/c.py", "x/d.py"))
    cov = [("c", "a.py", k, 0) for k in (1, 2, 3)] + [("c", "lib/src/b.py", 1, 1), ("c", "lib/src/b.py", 2, 0), ("c", "lib/src/b.py", 4, 0), ("c", "m/d.py", 1, 0), ("c", "n/d.py", 1, 0)]
    coverage = spark.createDataFrame(cov, "change_id string, path string, line int, hits long")
    symbols = spark.createDataFrame([("c", "src/b.py", "f", "function", 0, 1, 2)], "change_id string, path string, qualname string, kind string, ord int, start_line int, end_line int")
    got = {(r.rule_id, r.file, r.symbol, r.severity, r.detail) for r in C.coverage_findings(diffed(spark, patch), coverage, symbols).collect()}
    assert got == {("CG-COV-001", "src/a.py", None, "medium", "not run: 1–3"), ("CG-COV-001", "src/b.py", "f", "low", "not run: 2"), ("CG-COV-001", "src/b.py", None, "low", "not run: 4"), ("CG-COV-002", "src/c.py", None, "low", "not in the report"), ("CG-COV-002", "x/d.py", None, "low", "not in the report")}
    assert tuple(C.patch_coverage(diffed(spark, patch), coverage).first()) == ("c", 1, 6, 16.7)


def test_grounding(spark):
    claims = {
        "ok": ("F-1", "`price` in a.py changed at line 6, 50% of it", ["E1"]), "blank": ("F-1", "  ", ["E1"]), "bare": ("F-1", "x", []), "ghost": ("F-1", "x", ["E9"]), "lost": ("F-7", "x", ["E1"]),
        "nowhere": (None, "x", ["E2"]), "path": ("F-1", "see zz.py", ["E1"]), "line": ("F-1", "on line 40", ["E1"]), "number": ("F-1", "60% of it", ["E1"]), "tests": ("F-1", "the tests fail now", ["E1"]), "hedge": ("F-1", "the tests may fail now", ["E1"]),
        "symbol": ("F-1", "`other` is", ["E1"]), "again": ("F-1", "`price`  in a.py changed at line 6, 50% of it", ["E1"]), "null": ("F-1", None, None),
    }
    c = spark.createDataFrame([("c", f"{i:02}{n}", t, x, e, 0, 1) for i, (n, (t, x, e)) in enumerate(claims.items())], "change_id string, claim_id string, target string, text string, evidence_ids array<string>, sample int, samples int")
    e = spark.createDataFrame([("c", "E1", "src/a.py", 4, 6, "def price(): 50%"), ("c", "E2", None, None, None, "note")], "change_id string, id string, file string, start_line int, end_line int, excerpt string")
    got = {r.claim_id[2:]: r.reason for r in verified(c, e, spark.createDataFrame([("c", "src/a.py")], "change_id string, path string"), spark.createDataFrame([("c", "F-1")], "change_id string, id string")).collect()}
    assert got == {"ok": None, "blank": "empty_text", "bare": "no_evidence", "ghost": "unknown_evidence", "lost": "unknown_finding", "nowhere": "no_location", "path": "unknown_path", "line": "line_out_of_range", "number": "unsupported_number", "tests": "claims_test_result", "hedge": None, "symbol": "symbol_not_in_evidence", "again": "duplicate", "null": "empty_text"}


def test_evaluation(spark):
    pred = "case_id string, pred_id string, category string, file string, start_line int, end_line int"
    labels = spark.createDataFrame([("a", "l1", "x", "f", 10, 12), ("a", "l2", "x", "f", 30, 30), ("b", "l1", "y", "g", None, None)], "case_id string, label_id string, category string, file string, line_lo int, line_hi int")
    cases = spark.createDataFrame([("a", "dev", False), ("b", "holdout", False), ("n", "dev", True)], "case_id string, split string, negative boolean")
    now = E.outcomes(spark.createDataFrame([("a", "p1", "x", "f", 14, None), ("n", "p2", "x", "f", 1, None), ("b", "p3", "y", "g", 5, 5), ("n", "p4", "z", "f", 1, 1)], pred), labels, spark.createDataFrame([("n", "z", None, None, None)], "case_id string, category string, file string, line_lo int, line_hi int")).cache()
    assert sorted((r.case_id, r.outcome) for r in now.collect()) == [("a", "fn"), ("a", "tp"), ("b", "tp"), ("n", "fp")]
    s = {(r.grouping, r.value): (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in E.scores(now, cases, ("split",)).collect()}
    assert s == {("all", ""): (2, 1, 1, 0.6667, 0.6667, 0.6667), ("split", "dev"): (1, 1, 1, 0.5, 0.5, 0.5), ("split", "holdout"): (1, 0, 0, 1.0, 1.0, 1.0)}
    before = E.outcomes(spark.createDataFrame([("a", "p1", "x", "f", 14, None), ("a", "p9", "x", "f", 30, 30), ("b", "p3", "y", "g", 5, 5)], pred), labels)
    got = {(r.check, r.fails) for r in E.regressions(now, before, cases).collect()}
    assert got == {("lost_label", True), ("new_wrong", False), ("precision_drop", True), ("recall_drop", True), ("f1_drop", True), ("negative_rise", True)}
    assert E.regressions(now, now, cases).count() == 0


def test_limiter(spark, tmp_path):
    times = []
    assert [admit(times, t, 60, 2) for t in (0, 10, 20, 60, 61, 70)] == [True, True, False, True, False, True]
    folder = str(tmp_path / "hits")
    spark.createDataFrame([("u", k, f"2024-01-01 00:00:{k * 10:02}") for k in range(5)] + [("v", 9, "2024-01-01 00:00:01")], "identity string, hit_id long, t string").selectExpr("identity", "hit_id", "cast(t as timestamp) ts").coalesce(1).write.parquet(folder)
    q = limited(spark.readStream.schema("identity string, hit_id long, ts timestamp").parquet(folder), 3, 60).writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.hit_id: r.allowed for r in spark.table("limited").collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True}


def test_all_exports_are_written(spark, tmp_path):
    f = spark.createDataFrame(FOUND, FINDING)
    R.write(f, str(tmp_path / "out"))
    got = {(r.change_id, r.format): r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {(c, k) for c in "cd" for k in ("json", "sarif", "markdown", "text")}
    assert got["c", "json"] == R.to_json(f).where("change_id = 'c'").first().json and got["d", "text"].startswith("high")
    R.write(f.where("false"), str(tmp_path / "none"))
