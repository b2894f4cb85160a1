"""The change-analysis operators over the driver's tables, with their SQL: patches, code, coverage, claims and reports
are built from rows whose outcome SQL can state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators.patch_apply import head_files
from ..sources.archive import snapshot_files
from ..sources.code import indexed as of_known
from ..sources.diff import diff_lines
from ..sources.python_code import indexed, part
from ..sources.tables import dealt, kept, table, tasks
from . import coverage_gaps, evaluation, grounding, report
from .api_contract import CONTRACT, contract_findings
from .line_rules import dependency_changes, line_findings
from .registry import query


def patch_of(old: str, new: str, path: str = "doc.txt") -> str:
    """A patch of one hunk: all lines between the common first and last ones, with three lines around them."""
    a, b = old.split("\n"), new.split("\n")
    most = min(len(a), len(b))
    head = next((k for k in range(most) if a[k] != b[k]), most)
    tail = next((k for k in range(most - head) if a[-1 - k] != b[-1 - k]), most - head)
    lo, hi_a, hi_b = max(0, head - 3), min(len(a), len(a) - tail + 3), min(len(b), len(b) - tail + 3)
    body = [" " + x for x in a[lo:head]] + ["-" + x for x in a[head : len(a) - tail]] + ["+" + x for x in b[head : len(b) - tail]] + [" " + x for x in a[len(a) - tail : hi_a]]
    return "\n".join([f"--- a/{path}", f"+++ b/{path}", f"@@ -{lo + 1},{hi_a - lo} +{lo + 1},{hi_b - lo} @@", *body, ""])


@query("""WITH p AS (SELECT CAST(doc_id - doc_id % 2 AS BIGINT) AS pid, max(text) FILTER (doc_id % 2 = 0) AS base, max(text) FILTER (doc_id % 2 = 1) AS head FROM documents GROUP BY 1)
 SELECT pid, sha256(replace(replace(head, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS head_sha256 FROM p WHERE base IS NOT NULL AND head IS NOT NULL AND base <> head AND NOT contains(base || head, chr(0))""")
def patch_apply_roundtrip(spark, sf_dir):
    """A patch between two documents, read and applied to the first, gives the second."""
    line_ends = lambda c: F.regexp_replace(c, "\r\n?", "\n")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    side = lambda k, c: docs.where(F.col("doc_id") % 2 == k).groupBy((F.col("doc_id").cast("long") - k).alias("pid")).agg(line_ends(F.max("text")).alias(c))
    both = side(0, "base").join(side(1, "head"), "pid").where("base <> head and instr(concat(base, head), char(0)) = 0")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[k : k + 200] for whole in batches for k in range(0, len(whole), 200)):
            yield pd.DataFrame({"change_id": b["pid"].astype(str), "patch_text": [patch_of(x, y) for x, y in zip(b["base"], b["head"], strict=True)]})

    patches = both.mapInPandas(make, "change_id string, patch_text string")
    base = both.select(F.col("pid").cast("string").alias("change_id"), F.lit("doc.txt").alias("path"), F.col("base").alias("text"))
    return head_files(base, diff_lines(patches)).select(F.col("change_id").cast("long").alias("pid"), F.sha2(F.col("text").cast("binary"), 256).alias("head_sha256"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS change_id, CASE o_orderkey % 4 WHEN 0 THEN 'CG-SEC-001' WHEN 1 THEN 'CG-SEC-005' ELSE 'CG-DBG-001' END AS rule_id, 'a.py' AS file, 1 AS start_line FROM orders WHERE o_orderkey % 4 <> 3")
def line_rules(spark, sf_dir):
    """CG-SEC, DBG and the other line rules: one pass over the added lines of patches."""
    code = F.element_at(F.array(*map(F.lit, ("x = eval(y)", "get(u, verify=False)", "print(x)", "def evaluate(z): pass"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    patches = dealt(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").cast("string").alias("change_id"), F.concat(F.lit("--- /dev/null\n+++ b/a.py\n@@ -0,0 +1 @@\n+"), code, F.lit("\n")).alias("patch_text"))
    return line_findings(diff_lines(patches)).select("change_id", "rule_id", "file", "start_line")


def part_files(spark, sf_dir):
    """A module and its caller of every part, before and after: of each third key a parameter goes, of even ones its default changes."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("f"), k)
    lib = lambda args: F.concat(F.lit("def "), name, F.lit("("), args, F.lit("):\n    return a\n"))
    before = F.concat(F.lit("a, b="), size)
    after = F.when(k % 3 == 0, F.lit("a")).when(k % 2 == 0, F.concat(F.lit("a, b="), size + 1)).otherwise(before)
    use = F.concat(F.lit("from m.lib import "), name, F.lit("\n"), name, F.lit("(1, b=2)\n"))
    files = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(p).alias("path"), t.alias("text")) for s, p, t in (("base", "m/lib.py", lib(before)), ("head", "m/lib.py", lib(after)), ("base", "use.py", use), ("head", "use.py", use))])
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(k.cast("string").alias("change_id"), F.explode(files).alias("f")).select("change_id", "f.*")


@query("SELECT CAST(p_partkey AS VARCHAR) AS change_id, CASE WHEN p_partkey % 3 = 0 THEN 'CG-API-001' ELSE 'CG-API-005' END AS rule_id, 'm/lib.py' AS file, 'f' || p_partkey AS symbol, CASE WHEN p_partkey % 3 = 0 THEN 'use.py:2' ELSE '' END AS evidence FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def api_contract(spark, sf_dir):
    """J6, J9, J12, X11, X12, CG-API: callers that no longer fit a changed signature."""
    # every rule reads the index, so files are parsed once, by all cores; each then reads the columns that it needs
    index = kept(of_known(part_files(spark, sf_dir), *CONTRACT, once=True), "code-index")
    return contract_findings(index).select("change_id", "rule_id", "file", "symbol", F.array_join("evidence", ",").alias("evidence"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS change_id, 'f' || p_partkey AS qualname, 'function' AS kind, CASE WHEN side = 'head' AND p_partkey % 3 = 0 THEN 1 ELSE 2 END AS n_params, side FROM part, (VALUES ('base'), ('head')) s(side)")
def code_symbols(spark, sf_dir):
    """The Python index: symbols of files."""
    return part(indexed(part_files(spark, sf_dir)), "symbols").select("change_id", "qualname", "kind", F.size("params").alias("n_params"), "side")


@query("""WITH d AS (SELECT CAST(c_nationkey AS VARCHAR) AS change_id, 'p' || c_custkey AS name, '==' || c_custkey % 5 AS before, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '==' || c_custkey % 3 ELSE '>=' || c_custkey % 5 END END AS after FROM customer),
 r AS (SELECT change_id, name, before, after, CASE WHEN after IS NULL THEN 'CG-DEP-003' WHEN substr(before, 3) <> substr(after, 3) THEN 'CG-DEP-001' WHEN after LIKE '>=%' THEN 'CG-DEP-004' END AS rule_id FROM d) SELECT * FROM r WHERE rule_id IS NOT NULL""")
def dependency_rules(spark, sf_dir):
    """J22, X9, X10, CG-DEP: requirements before and after."""
    k = F.col("c_custkey")
    line = lambda mark, n: F.concat(F.lit("p"), k, F.lit(mark), k % n)
    after = F.when(k % 7 != 0, F.when(k % 2 == 0, line("==", 3)).otherwise(line(">=", 5)))
    listed = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("change_id")).agg(F.array_join(F.collect_list(line("==", 5)), "\n").alias("base"), F.array_join(F.collect_list(after), "\n").alias("head"))
    files = listed.select("change_id", F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base").alias("text")), F.struct(F.lit("head").alias("side"), F.col("head").alias("text")))).alias("f")).select("change_id", "f.side", F.lit("requirements.txt").alias("path"), "f.text")
    return dependency_changes(files).select("change_id", "name", "before", "after", "rule_id")


@query("""WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS change_id, l_suppkey % 3 AS f, l_linenumber AS line, max(l_partkey % 3) AS hits FROM lineitem WHERE l_quantity > 10 GROUP BY ALL)
 SELECT change_id, count(*) FILTER (hits > 0) AS covered, count(*) AS executable, round(count(*) FILTER (hits > 0) * 100.0 / count(*), 1) AS percent FROM a GROUP BY 1""")
def patch_coverage(spark, sf_dir):
    """Changed lines that a report knows, by the longest shared path suffix."""
    rows = table(spark, sf_dir, "lineitem")
    change, name = F.col("l_orderkey").cast("string").alias("change_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 3, F.lit(".py"))
    diff = rows.select(change, F.concat(F.lit("src/app/"), name).alias("path"), F.lit("add").alias("kind"), F.col("l_linenumber").alias("new_line"))
    seen = rows.where("l_quantity > 10").select(change, F.concat(F.lit("app/"), name).alias("path"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 3).alias("hits"))
    return coverage_gaps.patch_coverage(diff, seen, tasks(rows))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, CASE WHEN l_linenumber IS NULL THEN 'unknown_evidence' WHEN o_custkey % 8 NOT BETWEEN l_linenumber - 3 AND l_linenumber + 3 THEN 'line_out_of_range' END AS reason
 FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 4 + 1""")
def claims_verified(spark, sf_dir):
    """Claims against the evidence that they cite."""
    change = lambda c: F.col(c).cast("string").alias("change_id")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    claims = orders.select(change("o_orderkey"), F.col("o_orderkey").cast("string").alias("claim_id"), F.lit("F").alias("target"), F.concat(F.lit("see line "), F.col("o_custkey") % 8).alias("text"), F.array(F.concat(F.lit("E"), F.col("o_orderkey") % 4 + 1)).alias("evidence_ids"), F.lit(0).alias("sample"), F.lit(1).alias("samples"))
    evidence = lines.select(change("l_orderkey"), F.concat(F.lit("E"), F.col("l_linenumber")).alias("id"), F.lit("a.py").alias("file"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"), F.lit(None).cast("string").alias("excerpt"))
    return grounding.verified(claims, evidence, orders.select(change("o_orderkey"), F.lit("a.py").alias("path")), orders.select(change("o_orderkey"), F.lit("F").alias("id"))).select("claim_id", "reason")


@query("""WITH o AS (SELECT coalesce(lang, '') AS lang, CASE WHEN toxic = 1 AND quality = 0 THEN 'tp' WHEN quality = 0 THEN 'fp' WHEN toxic = 1 THEN 'fn' END AS o FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0),
 g AS (SELECT 'all' AS grouping, '' AS value, o FROM o UNION ALL SELECT 'lang', lang, o FROM o), n AS (SELECT grouping, value, count(*) FILTER (o = 'tp') AS tp, count(*) FILTER (o = 'fp') AS fp, count(*) FILTER (o = 'fn') AS fn FROM g GROUP BY 1, 2)
 SELECT *, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 4) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4) AS recall FROM n""")
def evaluation_scores(spark, sf_dir):
    """Predictions matched to labels one to one, and their scores by grouping."""
    cases = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")), "doc_id").select(F.col("doc_id").cast("string").alias("case_id"), "lang", "toxic", "quality")
    span = lambda *names: [F.lit(1).alias(n) for n in names]
    labels = cases.where("toxic = 1").select("case_id", F.lit("l").alias("label_id"), F.lit("x").alias("category"), F.lit("f").alias("file"), *span("line_lo", "line_hi"))
    found = cases.where("quality = 0").select("case_id", F.lit("p").alias("pred_id"), F.lit("x").alias("category"), F.lit("f").alias("file"), *span("start_line", "end_line"))
    return evaluation.scores(evaluation.outcomes(found, labels), cases.select("case_id", "lang"), ("lang",)).drop("f1")


@query("""WITH f AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS change_id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS s, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS r FROM lineitem)
 SELECT change_id, string_agg(rpad(s, 9, ' ') || rpad('R' || n, 12, ' ') || 'a.py:' || n || '  found', chr(10) ORDER BY r, n) AS text FROM f GROUP BY 1""")
def report_text(spark, sf_dir):
    """O1, K5: a change's findings in order, as text."""
    n = F.col("l_linenumber")
    severity = F.when(n % 3 == 0, "high").when(n % 3 == 1, "low").otherwise("medium")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("change_id"), F.concat(F.lit("F-"), n).alias("id"), F.concat(F.lit("R"), n).alias("rule_id"), F.lit("x").alias("category"), F.lit("heuristic").alias("kind"), severity.alias("severity"), F.lit("high").alias("confidence"), F.lit("a.py").alias("file"), n.alias("start_line"), F.lit("found").alias("title"), F.lit(None).cast("string").alias("excerpt"))
    return report.to_text(found)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS change_id, n_name || '.txt' AS path, r_name AS text FROM region JOIN nation ON n_regionkey = r_regionkey")
def archive_files(spark, sf_dir):
    """Text files of archives, without the folder that holds them all."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for b in batches:
            rows = []
            for r in b.itertuples():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for n in r.names:
                        z.writestr(f"top/{n}.txt", r.text)
                rows.append((r.change_id, "head", out.getvalue()))
            yield pd.DataFrame(rows, columns=["change_id", "side", "content"])

    names = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("names"))
    regions = table(spark, sf_dir, "region").join(names, "r_regionkey").select(F.col("r_regionkey").cast("string").alias("change_id"), F.col("r_name").alias("text"), "names")
    return snapshot_files(regions.mapInPandas(packed, "change_id string, side string, content binary")).select("change_id", "path", "text")
