"""Claims about a change, kept only if the evidence they cite bears them out: every check is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.archive import SUFFIXES
from ..sources.tables import spread

LINE = r"(?i)\blines?\s+(\d+)"
PERCENT = r"(\d+(?:\.\d+)?\s?%)"
#: What a claim says of runs that nobody made: their subjects, their outcomes, and words that leave the outcome open.
RUNS, OUTCOMES, OPEN = "tests?|suites?|ci|builds?", "pass|passes|passed|fail|fails|failed|succeeds?|succeeded|broke|breaks|green|red", "may|might|could|would|should|can|if|whether|unless|when|likely|perhaps"
#: How far from a cited range a line may be, and what share of samples has to agree (fixed values).
SLACK, AGREEMENT = 3, 0.5
#: What ends a word of a claim; a dot at a word's end is the sentence's.
BREAK = r"[\s`'\"()\[\]{}<>,;:!?]+"


def named_paths(text: Column) -> Column:
    """The words of a text that name a file: they end in the suffix of a text file, with something before it."""
    words = F.transform(F.split(text, BREAK), lambda w: F.rtrim(w, F.lit(".")))
    return F.array_distinct(F.filter(words, lambda w: (F.instr(w, "://") == 0) & F.concat(F.lit("."), F.lower(F.element_at(F.split(w, r"\."), -1))).isin(*sorted(SUFFIXES)) & w.rlike(r"[\w-]\.\w+$")))


def named_symbols(text: Column) -> Column:
    """The last part of each dotted name that stands alone between back-ticks, a call's brackets aside; paths aren't names."""
    quoted = F.filter(F.split(text, "`"), lambda x, i: i % 2 == 1)
    bare = F.transform(quoted, lambda x: F.regexp_replace(x, r"\(\)$", ""))
    names = F.filter(bare, lambda x: F.forall(F.split(x, r"\."), lambda part: part.rlike(r"^[^\W\d]\w*$")))
    return F.transform(F.array_except(names, named_paths(text)), lambda x: F.element_at(F.split(x, r"\."), -1))


def states_outcome(text: Column) -> Column:
    """Some sentence says how a run came out, and nothing in it leaves that open."""
    has = lambda s, words: s.rlike(rf"(?i)\b({words})\b")
    return F.exists(F.split(text, r"[.!?;](\s|$)|\n"), lambda s: has(s, RUNS) & has(s, OUTCOMES) & ~has(s, OPEN))


def verified(claims: DataFrame, evidence: DataFrame, paths: DataFrame, findings: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """claims with ``reason``: null if the claim stands, else the first check that fails.

    claims: change_id, claim_id, target (a finding, or null for a claim of its own), text, evidence_ids, sample, samples.
    evidence: change_id, id, file, start_line, end_line, excerpt. paths: change_id, path. findings: change_id, id.
    The checks, in order: empty_text, no_evidence, unknown_evidence, unknown_finding, no_location, unknown_path,
    line_out_of_range, unsupported_number, claims_test_result, symbol_not_in_evidence, low_agreement, duplicate. n_tasks is the number of tasks that all is dealt over; without one Spark's own counts hold.
    """
    by = lambda rows, *keys: spread(rows, n_tasks, *keys)
    text = F.coalesce(F.trim("text"), F.lit(""))
    ids = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    cited = (
        by(by(claims.select("change_id", "claim_id", F.explode_outer(ids).alias("id")), "change_id", "id").join(by(evidence, "change_id", "id").withColumn("known", F.lit(True)), ["change_id", "id"], "left"), "change_id", "claim_id").groupBy("change_id", "claim_id")
        .agg(
            F.count_if(F.col("id").isNotNull() & F.col("known").isNull()).alias("n_unknown"), F.bool_or(F.col("file").isNotNull()).alias("placed"),
            F.collect_list(F.when(F.col("start_line").isNotNull(), F.struct("start_line", F.coalesce("end_line", "start_line").alias("end_line")))).alias("spans"), F.array_join(F.sort_array(F.collect_list("excerpt")), "\n").alias("corpus"),
        )
    )
    every = by(paths.select("change_id", F.explode(F.array("path", F.element_at(F.split("path", "/"), -1))).alias("p")), "change_id", "p").distinct()
    said = claims.select("change_id", "claim_id", F.explode(named_paths(text)).alias("p"))
    stray = by(by(said, "change_id", "p").join(every, ["change_id", "p"], "left_anti").select("change_id", "claim_id"), "change_id", "claim_id").distinct().withColumn("stray", F.lit(True))
    aims = by(claims.where("target is not null").select("change_id", "claim_id", "target"), "change_id", "target")
    orphan = by(aims.join(by(findings.select("change_id", F.col("id").alias("target")), "change_id", "target"), ["change_id", "target"], "left_anti").select("change_id", "claim_id"), "change_id", "claim_id").withColumn("orphan", F.lit(True))
    all_of = by(claims, "change_id", "claim_id").join(cited, ["change_id", "claim_id"], "left").join(stray, ["change_id", "claim_id"], "left").join(orphan, ["change_id", "claim_id"], "left")
    corpus = F.coalesce("corpus", F.lit(""))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(LINE), 1), lambda n: n.try_cast("int"))
    off = F.exists(numbers, lambda n: ~F.exists("spans", lambda s: n.between(s["start_line"] - SLACK, s["end_line"] + SLACK)))
    percents = lambda c: F.transform(F.regexp_extract_all(c, F.lit(PERCENT), 1), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    words = F.regexp_extract_all(corpus, F.lit(r"([A-Za-z_]\w*)"), 1)
    normal = F.lower(F.regexp_replace(text, r"\s+", " "))
    # dealt by a column of its own: a target that is null in every row would be planned away
    of_text = Window.partitionBy("change_id", "target", "_h", normal)
    counted = by(all_of.withColumn("_h", F.xxhash64(normal)), "change_id", "_h").withColumn("agree", F.size(F.collect_set("sample").over(of_text))).withColumn("nth", F.row_number().over(of_text.orderBy("claim_id")))
    reason = F.coalesce(
        F.when(text == "", "empty_text"), F.when(F.size(ids) == 0, "no_evidence"), F.when(F.col("n_unknown") > 0, "unknown_evidence"), F.when(F.col("orphan"), "unknown_finding"),
        F.when(F.col("target").isNull() & ~F.coalesce("placed", F.lit(False)), "no_location"), F.when(F.col("stray"), "unknown_path"), F.when((F.size("spans") > 0) & off, "line_out_of_range"),
        F.when(F.size(F.array_except(percents(text), percents(corpus))) > 0, "unsupported_number"), F.when(states_outcome(text), "claims_test_result"),
        F.when(F.size(F.array_except(named_symbols(text), words)) > 0, "symbol_not_in_evidence"), F.when(F.col("agree") / F.greatest(F.coalesce("samples", F.lit(1)), F.lit(1)) < AGREEMENT, "low_agreement"), F.when(F.col("nth") > 1, "duplicate"),
    )
    return counted.select(*[F.col(c) for c in claims.columns], reason.alias("reason"))
