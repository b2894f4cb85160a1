"""Rules on added lines: every rule is a condition of Catalyst's, all of them in one pass over the diff lines.

Graded rules have modules of their own: ``migrations`` for CG-MIG, ``secrets`` for random values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_id
from ..operators.relational import keep_best
from ..sources.manifests import dependencies, kind

PY, JS, ANY = r"(?i)\.pyi?$", r"(?i)\.[cm]?[jt]sx?$", r"."
TEST_PATH = r"(?i)(^|/)(test_[^/]*\.py|[^/]*_test\.py|conftest\.py|[^/]*\.(test|spec)\.[^/]*)$|(^|/)(tests?|__tests__|spec)/"


@dataclass(frozen=True)
class LineRule:
    id: str
    title: str
    category: str
    kind: str
    severity: str
    confidence: str
    paths: str
    pattern: str
    tests: bool | None = None  #: only in tests, only elsewhere, or both
    once: bool = False  #: one finding a file




def all_of(*words: str) -> str:
    """A pattern of lines that hold a word of every list, in any order."""
    return "^" + "".join(rf"(?=.*\b(?:{w})\b)" for w in words)


#: Lines that speak to a machine reader, by the words that come together in them: to set aside what it was told before,
#: to come to a verdict, or of its own prompt.
ASIDE, TOLD, BEFORE = "ignore|ignoring|disregard|forget|override|bypass|don't follow|do not follow", r"instructions?|prompts?|rules?|guidelines?|directions?|directives?", "previous|previously|prior|earlier|above|before|preceding|so far"
READER, DUTY, VERDICT = "ais?|llms?|bots?|models?|assistants?|agents?|chatbots?", "must|should|has to|have to|need to|needs to|are to", "approve|approved|accept|merge|pass|skip|ignore"
OVERRIDE = "(?i)" + "|".join((all_of(ASIDE, TOLD, BEFORE), all_of(READER, DUTY, VERDICT), all_of("system prompt")))

#: Identifiers, categories and severities. The patterns are this package's own.
RULES = (
    LineRule("CG-SEC-001", "Code is evaluated", "security", "deterministic", "high", "high", f"{PY}|{JS}", r"(?<![\w.])(eval|exec)\s*\(|\bnew\s+Function\s*\(|\bset(Timeout|Interval)\s*\(\s*['\"`]"),
    LineRule("CG-SEC-002", "Markup is written unescaped", "security", "deterministic", "high", "high", JS, r"\.insertAdjacentHTML\s*\(|\bdocument\.write(?:ln)?\s*\(|\.(?:inner|outer)HTML\s*=(?!=)\s*+(?!(['\"])[^'\"]*\1\s*;?\s*$)|dangerouslySetInnerHTML"),
    LineRule("CG-SEC-003", "A shell runs a command", "security", "deterministic", "high", "high", f"{PY}|{JS}", r"\bos\.(system|popen)\s*\(|\bshell\s*=\s*True\b|\bexec(Sync)?\s*\(\s*(`[^`]*\$\{|[^'\")]*\+)"),
    LineRule("CG-SEC-004", "Unsafe deserialisation", "security", "deterministic", "high", "high", PY, r"\byaml\.(unsafe_load(_all)?|load)\s*\((?!.*Safe)|\b(marshal|pickle)\.loads?\s*\(|\bjsonpickle\.decode\s*\("),
    LineRule("CG-SEC-005", "Certificates aren't checked", "security", "deterministic", "high", "high", PY, r"\bverify\s*=\s*False\b"),
    LineRule("CG-SEC-006", "SQL is put together from strings", "security", "deterministic", "high", "high", PY, r"\.(execute|executemany|raw)\s*\(\s*(f['\"]|['\"].*['\"]\s*(%|\+|\.format))"),
    LineRule("CG-SEC-010", "A secret in the source", "secret_exposure", "deterministic", "critical", "high", ANY, r"\b(gh[pousr]_[A-Za-z0-9]{36,}|AKIA[0-9A-Z]{16}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})\b|-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    LineRule("CG-SEC-011", "Values in an environment file", "security", "deterministic", "medium", "high", r"(?i)(^|/)\.env(?!.*\.(example|sample|template|dist)$)[^/]*$", r"^\s*(export\s+)?[A-Za-z_]\w*\s*=\s*\S", once=True),
    LineRule("CG-ERR-001", "An error is swallowed", "error_handling", "deterministic", "medium", "high", f"{PY}|{JS}", r"^\s*except\s*:|\bexcept\b[^:]*:\s*pass\b|\bcatch\s*(\([^)]*\))?\s*\{\s*\}"),
    LineRule("CG-CON-001", "An async callback isn't awaited", "concurrency", "deterministic", "medium", "high", JS, r"\.forEach\s*\(\s*async\b"),
    LineRule("CG-DBG-001", "Debug output", "debug_artifact", "deterministic", "low", "high", f"{PY}|{JS}", r"\bconsole\.(log|debug|info|trace)\s*\(|^\s*debugger\b|\bbreakpoint\s*\(\s*\)|\bpdb\.set_trace\s*\(|^\s*print\s*\(", tests=False),
    LineRule("CG-TYP-001", "Types aren't checked", "type_safety", "deterministic", "low", "high", f"{PY}|{JS}", r"@ts-(ignore|nocheck)\b|\bas\s+any\b|#\s*type:\s*ignore"),
    LineRule("CG-CFG-001", "A risky setting", "configuration", "heuristic", "medium", "medium", f"{PY}|{JS}", r"^\s*DEBUG\s*=\s*True\b|\bALLOWED_HOSTS\b.*['\"]\*['\"]|\b(allow_)?origins?\s*[=:]\s*\[?\s*['\"]\*['\"]|Access-Control-Allow-Origin['\"]\s*[,:]\s*['\"]\*"),
    LineRule("CG-TST-002", "A test is skipped", "test_integrity", "deterministic", "medium", "high", f"{PY}|{JS}", r"\b(it|test|describe)\.skip\s*\(|\bx(it|describe|test)\s*\(|@(pytest\.mark|unittest)\.(skip|skipif|xfail)|\bpytest\.skip\s*\(", tests=True),
    LineRule("CG-TST-003", "Only one test runs", "test_integrity", "deterministic", "high", "high", JS, r"\b(it|test|describe)\.only\s*\(|\bf(it|describe)\s*\(", tests=True),
    LineRule("CG-AIS-001", "Text addressed to a model", "prompt_injection", "deterministic", "medium", "high", ANY, OVERRIDE, once=True),
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
SECRET = next(r.pattern for r in RULES if r.id == "CG-SEC-010")


def redacted(text: Column) -> Column:
    """The text with four stars for every secret."""
    return F.regexp_replace(text, f"({SECRET})", "****")


def catalogue(df: DataFrame) -> DataFrame:
    """The rules as a table."""
    return df.sparkSession.createDataFrame([(r.id, r.title, r.category, r.kind, r.severity) for r in RULES], "rule_id string, title string, category string, kind string, severity string")


def line_findings(lines: DataFrame, rules: tuple[LineRule, ...] = RULES) -> DataFrame:
    """Diff lines to findings: change_id, id, rule_id, category, kind, severity, confidence, file, start_line, side, title, excerpt.

    A line gives one finding a rule, named by its match, so that two equal ones on a line are one. Null contents and
    paths match nothing. Excerpts never hold a secret. The scan explodes only lines that match; only rules that speak
    once a file shuffle, by that file.
    """
    added = lines.where("kind = 'add' and content is not null and path is not null")
    test = F.col("path").rlike(TEST_PATH)
    hits = []
    for r in rules:
        fits = F.col("path").rlike(r.paths) & F.col("content").rlike(r.pattern)
        if r.tests is not None:
            fits &= test if r.tests else ~test
        fields = {"rule_id": r.id, "category": r.category, "kind": r.kind, "severity": r.severity, "confidence": r.confidence, "title": r.title}
        hits.append(F.when(fits, F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], F.lit(r.once).alias("once"))))
    found = added.select("change_id", F.col("path").alias("file"), F.col("new_line").alias("start_line"), "content", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r"))
    flat = found.select("change_id", "file", "start_line", "content", "r.*")
    each = flat.where("not once").unionByName(keep_best(flat.where("once"), ["change_id", "file", "rule_id"], [F.col("start_line")]))
    return each.select(
        "change_id", finding_id(F.col("rule_id"), F.col("file"), F.col("start_line"), F.col("title")).alias("id"), "rule_id", "category", "kind", "severity", "confidence", "file", "start_line", F.lit("head").alias("side"), "title",
        F.substring(redacted(F.trim("content")), 1, 200).alias("excerpt"),
    )


def dependency_changes(files: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """CG-DEP-001 to 004: change_id, rule_id, file, name, before, after, severity. Removed ones still imported are high."""
    deps = dependencies(files)
    side = lambda s, c: deps.where(F.col("side") == s).select("change_id", F.col("path").alias("file"), "name", F.col("spec").alias(c))
    both = side("base", "before").join(side("head", "after"), ["change_id", "file", "name"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    major = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    # a bare version pins a package of package.json
    pinned = lambda c: F.col(c).rlike(r"^={2,3}\s*\d|^\d+(\.\d+){1,3}$")
    rule = (
        F.when(F.col("before").isNull(), "CG-DEP-002").when(F.col("after").isNull(), "CG-DEP-003")
        .when(major("before") != major("after"), "CG-DEP-001").when(pinned("before") & ~pinned("after"), "CG-DEP-004")
    )
    out = both.withColumn("rule_id", rule).where("rule_id is not null")
    if imports is None:
        used = F.lit(False)
    else:
        # a module's first part is a Python package; a script's package is its first part, or two under a scope
        script = F.col("path").rlike(JS)
        package = F.when(script, F.regexp_extract("module", r"^((?:@[^/]+/)?[^/]+)", 1)).otherwise(F.lower(F.regexp_replace(F.split("module", r"\.")[0], "_", "-")))
        known = imports.where("side = 'head' and level = 0").select("change_id", package.alias("name"), script.alias("script")).distinct().withColumn("used", F.lit(True))
        out = out.withColumn("script", kind(F.col("file")) == "npm").join(known, ["change_id", "name", "script"], "left").drop("script")
        used = F.coalesce("used", F.lit(False))
    severity = F.when(F.col("rule_id") == "CG-DEP-003", F.when(used, "high").otherwise("low")).when(F.col("rule_id") == "CG-DEP-001", "medium").otherwise("low")
    return out.select("change_id", "rule_id", "file", "name", "before", "after", severity.alias("severity"))
