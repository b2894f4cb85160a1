"""A model's review of a change as tables: requests by their fingerprint, recorded answers, and the risks that they add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finding_id
from ..sources.tables import dealt, kept, spread
from .grounding import verified

#: What an answer may hold (fixed field names).
NOTE = "struct<finding_id: string, explanation: string, confidence: string, evidence_ids: array<string>>"
RISK = "struct<title: string, category: string, severity: string, confidence: string, description: string, evidence_ids: array<string>>"
ANSWER = f"finding_notes array<{NOTE}>, additional_risks array<{RISK}>, overall_assessment string"
#: Risks of an answer, lines by which a risk may miss a rule's finding, share of samples that agree, characters of texts (fixed values).
RISKS, SLACK, AGREEMENT, TITLE, TEXT = 8, 2, 0.5, 140, 1200


def clip(text: Column, most: int = TEXT) -> Column:
    """Without control characters but line ends and tabs, trimmed, and cut with an ellipsis."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f]", ""), r"^\s+|\s+$", "")
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.left(clean, F.lit(most - 1)), F.lit("…")))


def fingerprint(provider: str = "provider", model: str = "model", prompt_id: str = "prompt_id", prompt_version: str = "prompt_version") -> Column:
    """sha256 of a request as JSON with sorted keys and no blanks: the key of recordings and of a cache.

    The row has system, user, schema (JSON as text, keys sorted), schema_name, max_output_tokens, temperature and seed.
    """
    before = F.to_json(F.struct("max_output_tokens", F.col(model).alias("model"), F.col(prompt_id).alias("prompt_id"), F.col(prompt_version).alias("prompt_version"), F.col(provider).alias("provider")), {"ignoreNullFields": "false"})
    after = F.to_json(F.struct("schema_name", "seed", "system", "temperature", "user"), {"ignoreNullFields": "false"})
    body = F.concat(F.regexp_replace(before, r"\}$", ""), F.lit(',"schema":'), F.col("schema"), F.lit(","), F.regexp_replace(after, r"^\{", ""))
    return F.sha2(body.cast("binary"), 256)


def replayed(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    """requests with fingerprint, text and error: the latest recording (fingerprint, text, recorded_at) of each, or ``replay_miss``."""
    latest = recordings.groupBy("fingerprint").agg(F.max_by("text", "recorded_at").alias("text"))
    out = requests.withColumn("fingerprint", fingerprint()).join(latest, "fingerprint", "left")
    return out.withColumn("error", F.when(F.col("text").isNull(), "replay_miss"))


def parsed(text: Column) -> Column:
    """An answer's object, from its first brace to its last, whatever stands around it; null if that isn't JSON."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # a missing list is an empty one, but an object without any known field is no answer
    answer = F.from_json(body, ANSWER, {"mode": "PERMISSIVE"})
    return F.when((body != "") & (answer["finding_notes"].isNotNull() | answer["additional_risks"].isNotNull() | answer["overall_assessment"].isNotNull()), answer)


def risks(answers: DataFrame, most: int = RISKS) -> DataFrame:
    """answers (change_id, sample, text) to risks: change_id, sample, n, title, category, severity, confidence, description, evidence_ids."""
    listed = F.coalesce(parsed(F.col("text"))["additional_risks"], F.array().cast(f"array<{RISK}>"))
    return answers.select("change_id", "sample", F.posexplode(F.slice(listed, 1, most)).alias("n", "r")).select("change_id", "sample", "n", "r.*")


def supported(rows: DataFrame, samples: DataFrame, least: float = AGREEMENT, n_tasks: int | None = None) -> DataFrame:
    """Risks of sample 0 with support: the share of samples (change_id, samples) with a risk of the same category that cites
    one of its pieces of evidence. Those below ``least`` go. Risks meet through the evidence that both cite."""
    by = lambda rows, *keys: spread(rows, n_tasks, *keys)
    cited = by(rows.select("change_id", "sample", "n", "category", F.explode(F.array_distinct("evidence_ids")).alias("e")), "change_id", "category", "e")
    mine = cited.where("sample = 0").select("change_id", "n", "category", "e")
    agree = by(mine.join(cited.select("change_id", "category", "e", "sample").distinct(), ["change_id", "category", "e"]), "change_id", "n").groupBy("change_id", "n").agg(F.count_distinct("sample").alias("k"))
    share = F.col("k") / F.greatest(F.col("samples"), F.lit(1))
    met = by(by(rows.where("sample = 0"), "change_id", "n").join(agree, ["change_id", "n"]), "change_id")
    return met.join(by(samples, "change_id"), "change_id").withColumn("support", F.round(share, 3)).where(share >= least).drop("k", "samples", "sample")


def anchored(rows: DataFrame, evidence: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """Risks with file, start_line and end_line of the first evidence they cite that has a place; others go."""
    by = lambda rows, *keys: spread(rows, n_tasks, *keys)
    each = by(rows.select("change_id", "n", F.posexplode("evidence_ids").alias("k", "id")), "change_id", "id")
    placed = each.join(by(evidence.where("file is not null and start_line is not null").select("change_id", "id", "file", "start_line", F.coalesce("end_line", "start_line").alias("end_line")), "change_id", "id"), ["change_id", "id"])
    first = by(placed, "change_id", "n").groupBy("change_id", "n").agg(F.min_by(F.struct("file", "start_line", "end_line"), "k").alias("at"))
    return by(rows, "change_id", "n").join(first, ["change_id", "n"]).select(*rows.columns, "at.*")


def merged(findings: DataFrame, rows: DataFrame, n_tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings with corroborated_by, findings of kind ai): a risk that meets a rule's finding of its category and file within
    ``SLACK`` lines backs that finding, the first by id, instead of standing for itself; of equal ids one stays."""
    rules = findings.where("kind <> 'ai' and start_line is not null").select("change_id", "category", "file", F.col("id").alias("rule_finding"), F.col("start_line").alias("lo"), F.coalesce("end_line", "start_line").alias("hi"))
    by = lambda rows, *keys: spread(rows, n_tasks, *keys)
    met = by(rows, "change_id", "category", "file").join(by(rules, "change_id", "category", "file"), ["change_id", "category", "file"]).where((F.col("lo") <= F.col("end_line") + SLACK) & (F.col("start_line") <= F.col("hi") + SLACK))
    backs = by(met, "change_id", "n").groupBy("change_id", "n").agg(F.min("rule_finding").alias("id"))
    backed = by(backs.select("change_id", "id"), "change_id", "id").distinct().withColumn("backed", F.lit(True))
    out = by(findings, "change_id", "id").join(backed, ["change_id", "id"], "left").withColumn("corroborated_by", F.when(F.col("backed"), F.array(F.lit("ai"))).otherwise(F.array().cast("array<string>"))).drop("backed")
    alone = by(rows, "change_id", "n").join(backs.select("change_id", "n"), ["change_id", "n"], "left_anti")
    new = alone.select("change_id", finding_id(F.lit("AI-RISK"), F.col("file"), F.col("start_line"), F.col("title")).alias("id"), F.lit("AI-RISK").alias("rule_id"), "category", F.lit("ai").alias("kind"), "severity", "confidence", "file", "start_line", "end_line", clip(F.col("title"), TITLE).alias("title"), clip(F.col("description")).alias("description"), F.array_distinct("evidence_ids").alias("evidence_ids"), "support", "n")
    first = F.row_number().over(Window.partitionBy("change_id", "id").orderBy("n"))
    return out, by(new, "change_id", "id").withColumn("_r", first).where("_r = 1").drop("_r", "n")


def synthesised(findings: DataFrame, evidence: DataFrame, paths: DataFrame, answers: DataFrame, samples: DataFrame, n_tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, new findings, rejected claims): risks that stand the checks of ``grounding`` and the samples' agreement, merged.

    Every sample's risks are checked, so that one that fails doesn't lend support. n_tasks is the number of tasks that all is
    dealt over; without one Spark's own counts hold.
    """
    by = lambda rows, *keys: spread(rows, n_tasks, *keys)
    # answers are read once, by all tasks, and claims checked once: every step after them asks for both
    rows = kept(risks(dealt(answers, "change_id", n=n_tasks)), "risks")
    said = F.concat_ws(". ", "title", "description")
    claims = rows.select("change_id", F.concat_ws("-", F.col("sample").cast("string"), F.col("n").cast("string")).alias("claim_id"), F.lit(None).cast("string").alias("target"), said.alias("text"), "evidence_ids", "sample", F.lit(1).alias("samples"), "n")
    judged = kept(verified(claims, evidence, paths, findings.select("change_id", "id"), n_tasks), "judged-risks")
    # a later sample that says the same in the same words agrees
    at = ["change_id", "sample", "n"]
    good = by(rows, *at).join(by(judged.where("reason is null or (reason = 'duplicate' and sample > 0)").select(at), *at), at, "left_semi")
    told = kept(anchored(supported(good, samples, n_tasks=n_tasks), evidence, n_tasks), "anchored-risks")
    backed, new = merged(findings, told, n_tasks)
    return backed, new, judged.where("reason is not null and sample = 0").select("change_id", "claim_id", "reason")


def pruned_evidence(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence that some finding cites."""
    cited = findings.select("change_id", F.explode("evidence_ids").alias("id")).distinct()
    return evidence.join(cited, ["change_id", "id"], "left_semi")
