import itertools
import random
from collections import Counter

from patchloom.operators import matching
from patchloom.sources.coverage import coverage_lines
from patchloom.sources.diff import diff_lines

PATCH = """diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -1,3 +1,3 @@ def f
 a = 1
-b = 2
+b = 3

diff --git a/old.py b/new.py
similarity index 100%
rename from old.py
rename to new.py
"""


def test_diff_lines(spark):
    cases = {"good": PATCH, "crlf": PATCH.replace("\n", "\r\n"), "up": PATCH.replace("app.py", "../x"), "short": PATCH.replace("-1,3", "-1,9"), "none": "hello", "null": None, "empty": "", "nul": "a\0b", "twice": PATCH + PATCH}
    rows = diff_lines(spark.createDataFrame(list(cases.items()), "change_id string, patch_text string")).collect()
    good = [(r.path, r.status, r.kind, r.content, r.old_line, r.new_line) for r in rows if r.change_id == "good"]
    assert good == [("app.py", "modified", "context", "a = 1", 1, 1), ("app.py", "modified", "del", "b = 2", 2, None), ("app.py", "modified", "add", "b = 3", None, 2), ("app.py", "modified", "context", "", 3, 3), ("new.py", "renamed", None, None, None, None)]
    assert [r[1:] for r in rows if r.change_id == "crlf"] == [r[1:] for r in rows if r.change_id == "good"]
    for bad in ("up", "short", "none", "null", "empty", "nul", "twice"):
        got = [r for r in rows if r.change_id == bad]
        assert got[-1].error, bad


def test_coverage(spark):
    reports = [("l", "SF:a.py\nDA:1,2\nDA:1,5\nDA:0,1\nend_of_record\nDA:9,9\n"), ("x", '<coverage><class filename="a.py"><line number="3" hits="0"/></class></coverage>'), ("d", '<!DOCTYPE x><class filename="a"><line number="1" hits="1"/></class>'), ("j", '{"files":{"b.py":{"executed_lines":[1],"missing_lines":[2]}}}'), ("n", None)]
    got = {tuple(r) for r in coverage_lines(spark.createDataFrame(reports, "change_id string, text string")).collect()}
    assert got == {("l", "a.py", 1, 5), ("x", "a.py", 3, 0), ("j", "b.py", 1, 1), ("j", "b.py", 2, 0)}


def test_matching_is_maximum(spark):
    rng = random.Random(3)
    pairs = [(f"c{c}", f"p{p}", f"l{x}") for c in range(6) for p in range(4) for x in range(4) if rng.random() < 0.4]
    got = [tuple(r) for r in matching.maximum_matching(spark.createDataFrame(pairs, "case_id string, pred_id string, label_id string")).collect()]
    assert set(got) <= set(pairs)
    for c in {p[0] for p in pairs}:
        own, fits = [g for g in got if g[0] == c], {p[1:] for p in pairs if p[0] == c}
        assert len({g[1] for g in own}) == len({g[2] for g in own}) == len(own)
        most = max(sum((f"p{p}", f"l{x}") in fits for p, x in enumerate(order)) for order in itertools.permutations(range(4)))
        assert len(own) == most


def test_greedy_dedup_is_not_transitive(spark):
    rows = [("c", "k", "f", "head", 1, "a", 1, 5), ("c", "k", "f", "head", 2, "b", 4, 9), ("c", "k", "f", "head", 3, "d", 8, 12)]
    got = matching.greedy_dedup(spark.createDataFrame(rows, "change_id string, category string, file string, side string, ord long, id string, lo long, hi long")).collect()
    assert {r.id: r.kept_id for r in got} == {"a": "a", "b": "a", "d": "d"}


def test_greedy_dedup_like_a_plain_loop(spark):
    rng = random.Random(5)
    span = lambda: None if rng.random() < 0.05 else rng.randint(1, 60)
    groups = [(f"c{k % 150}", None if k < 9 else "k", "f", f"s{k // 150}") for k in range(600)]
    # many small groups, one of many kept findings; empty ids, nulls, and spans that end before they start
    rows = [(*g, rng.choice([None, 1, 2, 3]), rng.choice(["", f"i{k}-{n}"]), lo, span() if rng.random() < 0.2 else lo and lo + rng.randint(0, 20)) for k, g in enumerate(groups) for n in range(rng.randint(1, 7)) for lo in [span()]]
    rows += [("c", "k", "f", "s", n, f"x{n}", lo, lo + rng.choice([0, 3, 400])) for n in range(2000) for lo in [rng.randint(0, 9000)]]
    schema = "change_id string, category string, file string, side string, ord long, id string, lo long, hi long"
    last = lambda x: (x is None, x or 0)
    want, kept = [], {}
    for r in sorted(rows, key=lambda r: (last(r[4]), r[5], last(r[6]), last(r[7]))):
        held = kept.setdefault(r[:4], [])
        hit = None if None in r[6:] else next((i for i, lo, hi in held if r[6] <= hi and lo <= r[7]), None)
        if hit is None:
            held += [] if None in r[6:] else [(r[5], r[6], r[7])]
            hit = r[5]
        want.append((*r, hit))
    got = matching.greedy_dedup(spark.createDataFrame(rows, schema).repartition(5))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    # a call into Python for each small group took its time
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert matching.greedy_dedup(spark.createDataFrame([], schema)).count() == 0


def test_stream_state(spark, tmp_path):
    from patchloom.streaming.events import current_state, hourly, read

    folder = str(tmp_path / "events")
    spark.createDataFrame([(1, "2024-01-01 00:00:00", 7, "view", 1.0), (2, "2024-01-01 00:10:00", 7, "error", 2.0), (3, "2024-01-01 03:00:00", 8, "click", 3.0)], "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value").write.parquet(folder)
    q = current_state(read(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.state, r.n_events) for r in spark.table("state").collect()} == {(7, "error", 2), (8, "click", 1)}
    q = hourly(read(spark, folder)).writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("hours").collect()) == 2


def test_cobertura_is_read_as_xml(spark):
    body = "<packages><package name='p'><classes><class name=\"c\" filename='a&amp;b.py' line-rate='1'><methods><method name='m'><lines><line number='9' hits='9'/></lines></method></methods><lines><line hits='2' number='1'/><line number=\"3\" branch='true' hits=\"0\"/><line number='x' hits='1'/></lines></class></classes></package></packages>"
    two = "SF:b.py\nDA:1,0\nend_of_record\n"
    reports = [("x", f"<?xml version='1.0'?>\n<coverage>{body}</coverage>"), ("l", "SF:a.py\nDA:1,2\nend_of_record\n"), ("l", two), ("b", "<class filename='z'><line number="), ("e", "<coverage/>")]
    got = {tuple(r) for r in coverage_lines(spark.createDataFrame(reports, "change_id string, text string")).collect()}
    assert got == {("x", "a&b.py", 1, 2), ("x", "a&b.py", 3, 0), ("l", "a.py", 1, 2), ("l", "b.py", 1, 0)}


def fields(spark, **patches):
    rows = diff_lines(spark.createDataFrame(list(patches.items()), "change_id string, patch_text string")).collect()
    return {k: [r for r in rows if r.change_id == k] for k in patches}


def test_headers_of_patches(spark):
    got = fields(
        spark,
        mode="diff --git a/run.sh b/run.sh\nold mode 100644\nnew mode 100755\n",
        binary="diff --git a/x y.png b/x y.png\nindex 1..2 100644\nBinary files a/x y.png and b/x y.png differ\n",
        packed="diff --git a/p.bin b/p.bin\nnew file mode 100644\nGIT binary patch\nliteral 3\nKcmZ\n\nliteral 0\ndiff --git a/z.py b/z.py\ndeleted file mode 100644\n--- a/z.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n",
        rename="diff --git a/a.py b/b.py\nsimilarity index 93%\nrename from a.py\nrename to b.py\n--- a/a.py\n+++ b/b.py\n@@ -1,1 +1,1 @@ def f\n-x\n+y\n",
        copy="diff --git a/a.py b/c.py\nsimilarity index 100%\ncopy from a.py\ncopy to c.py\n",
        quoted='diff --git "a/sp\\303\\244t.py" "b/sp\\303\\244t.py"\n--- "a/sp\\303\\244t.py"\n+++ "b/sp\\303\\244t.py"\n@@ -1 +1 @@\n-a\n+b\n',
        noprefix="diff --git src/a.py src/a.py\n--- src/a.py\n+++ src/a.py\n@@ -1 +1 @@\n-a\n+b\n",
        plain="--- old/src/a.py\t2024-01-01\n+++ new/src/a.py\t2024-01-02\n@@ -1 +1 @@\n-a\n+b\n--- /dev/null\n+++ new/b.py\n@@ -0,0 +1 @@\n+n\n",
        bare="--- a.py\n+++ a.py\n@@ -1 +1 @@\n-a\n+b\n--- old/b.py\n+++ new/b.py\n@@ -1 +1 @@\n-a\n+b\n",
        mail="From 0123456789abcdef Mon Sep 17\nSubject: [PATCH 1/2] Say it\n---\n a.py | 2 +-\n\ndiff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file\n-- \n2.40\n",
        more="--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-a\n+b\n+c\n",
        lone="diff --git a/a b/a\n--- a/a\n@@ -1 +1 @@\n",
        drive="--- a/C:/x\n+++ b/C:/x\n@@ -1 +1 @@\n-a\n+b\n",
    )
    one = {k: v[0] for k, v in got.items()}
    assert (one["mode"].path, one["mode"].old_mode, one["mode"].new_mode, one["mode"].kind) == ("run.sh", "100644", "100755", None)
    assert (one["binary"].path, one["binary"].is_binary) == ("x y.png", True)
    assert [(r.path, r.status, r.is_binary, r.kind) for r in got["packed"]] == [("p.bin", "added", True, None), ("z.py", "deleted", False, "del")]
    assert (one["rename"].old_path, one["rename"].path, one["rename"].status, one["rename"].similarity, one["rename"].section) == ("a.py", "b.py", "renamed", 93, "def f")
    assert (one["copy"].status, one["copy"].similarity) == ("copied", 100)
    assert {r.path for r in got["quoted"]} == {"spät.py"} and {r.path for r in got["noprefix"]} == {"src/a.py"}
    assert [(r.path, r.old_path, r.status) for r in got["plain"]] == [("src/a.py", "src/a.py", "modified")] * 2 + [("b.py", None, "added")]
    assert {r.path for r in got["bare"]} == {"a.py", "new/b.py"} and {r.format for r in got["bare"]} == {"unified"}
    assert [(r.kind, r.no_newline, r.format, r.subject) for r in got["mail"]] == [("del", True, "format-patch", "Say it"), ("add", True, "format-patch", "Say it")]
    assert all(one[k].error for k in ("more", "lone", "drive"))


def test_patches_of_git_give_its_head(spark, tmp_path):
    """Random trees by git itself: edits, renames, deletions, odd names, and last lines with and without their end."""
    import random
    import shutil
    import subprocess

    import pytest

    from patchloom.plans.workspace import whole_head

    if not shutil.which("git"):
        pytest.skip("no git")
    rng = random.Random(11)
    text = lambda: "\n".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))) + rng.choice(["", "\n"])
    trees = []
    for k in range(12):
        names = [f"d{k}/f{i}.py" for i in range(4)] + ["sp ace.py", "ümlaut.py", 'quo"te.py']
        base = {n: text() for n in names}
        head = {}
        for n, t in base.items():
            lines = t.split("\n")
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(lines))
                lines[at : at + rng.randint(0, 1)] = [rng.choice("xyz")] * rng.randint(0, 2) or ["w"]
            way = rng.random()
            if way < 0.1:
                continue
            head[n.replace("/f", "/moved") if way < 0.25 else n] = "\n".join(lines) if way > 0.4 else t + rng.choice(["", "", "end", "\n"])
        head["new.py"] = text()
        trees.append((base, {n: t for n, t in head.items() if t}))
    rows = []
    git = lambda d, *a: subprocess.run(["git", "-C", str(d), "-c", "user.name=t", "-c", "user.email=t@t", "-c", "core.autocrlf=false", *a], check=True, capture_output=True).stdout
    for k, (base, head) in enumerate(trees):
        d = tmp_path / str(k)
        d.mkdir()
        git(d, "init", "-q")
        for tree in (base, head):
            for f in d.glob("**/*.py"):
                f.unlink()
            for n, t in tree.items():
                (d / n).parent.mkdir(exist_ok=True)
                (d / n).write_bytes(t.encode())
            git(d, "add", "-A")
            git(d, "commit", "-qm", "x", "--allow-empty")
        rows.append((str(k), git(d, "diff", "-M", "HEAD~1", "HEAD").decode()))
    diff = diff_lines(spark.createDataFrame(rows, "change_id string, patch_text string")).cache()
    assert not diff.where("error is not null").collect() and diff.where("no_newline").count() > 5 and diff.where("status = 'renamed'").count() > 2
    base = spark.createDataFrame([(str(k), n, t) for k, (b, _) in enumerate(trees) for n, t in b.items()], "change_id string, path string, text string")
    got = {(r.change_id, r.path): r.text for r in whole_head(base, diff).collect()}
    assert got == {(str(k), n): t for k, (_, h) in enumerate(trees) for n, t in h.items()}
