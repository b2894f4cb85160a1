"""Op 6: toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses and each clause's words are classed by small transducers: insult (learned word forms and
stems), threat, target, negation and reported speech (fixed word lists). A composed automaton reads the classes left to
right and ends in one of a few patterns, such as a plain, a targeted, a negated or a reported insult. A clause scores
its insult's learned weight and its pattern's learned weight; a text scores the logistic of the sum over its strongest
clauses. All weights are log odds counted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches

#: Word lists of the grammar in English, German, French and Spanish (fixed values).
TARGET = frozenset("you your yourself u he she they them du dich dir ihr euch sie er tu te toi vous il elle ils elles usted ustedes tú ellos ellas él".split())
NEGATION = frozenset("not never no isn't aren't wasn't don't doesn't nicht nie kein keine keinen pas jamais non sin nunca jamás".split())
REPORTED = frozenset("said says told called quoted wrote claimed according sagte sagt schrieb nannte zitierte dit disait écrit appelé selon dijo dice escribió llamó según".split())
THREAT = frozenset("kill hurt destroy murder shoot stab töten umbringen verletzen zerstören schlagen tuer frapper détruire blesser matar herir destruir golpear".split())
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")

#: The composed automaton: state and class of the next word give the next state. States name what was read so far, and
#: the last state of a clause is its pattern. Classes without an entry leave the state.
STEPS = {
    ("plain", "negation"): "negation", ("plain", "reported"): "reported", ("plain", "target"): "target",
    ("target", "negation"): "negation", ("target", "reported"): "reported", ("negation", "reported"): "reported", ("negation", "other"): "plain",
    ("plain", "insult"): "insult", ("target", "insult"): "targeted insult", ("negation", "insult"): "negated insult", ("reported", "insult"): "reported insult",
    ("insult", "target"): "targeted insult", ("negated insult", "insult"): "insult", ("reported insult", "insult"): "repeated insult", ("insult", "insult"): "repeated insult", ("targeted insult", "insult"): "repeated insult",
    ("plain", "threat"): "threat", ("threat", "target"): "targeted threat", ("target", "threat"): "targeted threat", ("negation", "threat"): "negated threat", ("reported", "threat"): "reported threat",
    ("threat", "insult"): "repeated insult", ("targeted threat", "insult"): "repeated insult", ("negated threat", "insult"): "insult", ("reported threat", "insult"): "reported insult",
    ("insult", "threat"): "repeated insult", ("targeted insult", "threat"): "repeated insult",
}
PATTERNS = ("insult", "targeted insult", "repeated insult", "negated insult", "reported insult", "threat", "targeted threat", "negated threat", "reported threat")
#: What a pattern weighs without evidence, in log odds (fixed values); labels move it.
PRIOR = {"insult": 0.0, "targeted insult": 0.5, "repeated insult": 1.0, "negated insult": -0.5, "reported insult": -0.5, "threat": 1.5, "targeted threat": 3.0, "negated threat": 0.0, "reported threat": 0.5}
STEMS = range(4, 7)
#: The log odds ratio that a form needs, and by how much the log likelihood ratio of its toxic rows must exceed what
#: the best of as many forms reaches by chance. A stem needs so many words, none of them with most of its rows.
LEAST_ODDS, MARGIN, STEM_WORDS = 4.0, 6.0, 5


def forms(word: str) -> list[str]:
    """A word and its stems, longest first; stems carry an asterisk."""
    return [word, *(f"{word[:n]}*" for n in reversed(STEMS) if len(word) > n)]


class Grammar:
    """insults: weight of each word form and stem; patterns: weight of each pattern; bias: log odds of a text without any."""

    def __init__(self, insults: dict[str, float], patterns: dict[str, float], bias: float):
        self.insults, self.patterns, self.bias = insults, patterns, bias
        self.first = frozenset(k[:4] for k in insults)

    def insult(self, word: str) -> float:
        if word[:4] not in self.first:
            return 0.0
        return max((self.insults.get(f, 0.0) for f in forms(word)), default=0.0)

    def clauses(self, text: str) -> Iterator[tuple[str, float]]:
        """Pattern and insult weight of each clause that has one. Clauses are read one by one, so memory stays bounded."""
        at = 0
        low = text.lower()
        while at <= len(low):
            m = CLAUSE.search(low, at)
            end = m.start() if m else len(low)
            words = WORD.findall(low, at, end)
            weights = [self.insult(w) for w in words]
            if any(weights) or not THREAT.isdisjoint(words):
                state, top = "plain", 0.0
                for w, x in zip(words, weights, strict=True):
                    kind = "insult" if x else "threat" if w in THREAT else "negation" if w in NEGATION else "reported" if w in REPORTED else "target" if w in TARGET else "other"
                    state, top = STEPS.get((state, kind), state), max(top, x)
                if state in self.patterns:
                    yield state, top
            at = m.end() if m else len(low) + 1

    def score(self, text: str | None) -> float:
        """0 to 1. Of the clauses the four strongest count, as many weak ones are no proof."""
        found = sorted((w + self.patterns[p] for p, w in self.clauses(text or "")), reverse=True)[:4]
        x = self.bias + sum(max(0.0, v) for v in found)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def family(text: str) -> tuple[int, ...]:
    """Two min-hashes of a text's long words, which near copies mostly share."""
    words = [w.encode() for w in set(WORD.findall(text.lower())) if len(w) > 7] or [text.encode()]
    return tuple(min(zlib.crc32(w, seed) for w in words) for seed in (1, 2))


def learn(rows: list[tuple[str, int]]) -> Grammar:
    """Weights from labelled texts: each form counts once a text, and near copies with the same label count once."""
    rows = [*{(family(text), y): (text, y) for text, y in rows}.values()]
    counts = (Counter(), Counter())
    n = [0, 0]
    for text, y in rows:
        n[y] += 1
        counts[y].update({f for w in set(WORD.findall(text.lower())) if len(w) > 2 for f in forms(w)})
    under: dict[str, list[int]] = {}
    for f, toxic in counts[1].items():
        if f[-1] != "*":
            for stem in forms(f)[1:]:
                under.setdefault(stem, []).append(toxic)
    fixed = TARGET | NEGATION | REPORTED | THREAT
    insults = {}
    rate = (n[1] + 1) / (n[0] + n[1] + 2)
    least = math.log(max(1, len(counts[1].keys() | counts[0].keys()))) + MARGIN
    for f, toxic in counts[1].items():
        clean = counts[0][f]
        if f[-1] == "*" and (len(under[f]) < STEM_WORDS or max(under[f]) * 2 > toxic):
            continue
        share = toxic / (toxic + clean)
        proof = toxic * math.log(share / rate) + (clean * math.log((1 - share) / (1 - rate)) if clean else 0.0)
        odds = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))
        if share > rate and proof >= least and odds >= LEAST_ODDS and f not in fixed:
            insults[f] = odds
    bias = math.log((n[1] + 1) / (n[0] + 1)) - 2.0
    grammar = Grammar(insults, dict(PRIOR), bias)
    seen = {p: [1.0, 1.0] for p in PATTERNS}
    for text, y in rows:
        for p in {p for p, _ in grammar.clauses(text)}:
            seen[p][y] += 1
    base = math.log((n[1] + 1) / (n[0] + 1))
    # half of an insult's evidence is the word's own, a threat's is all its pattern's; a pattern moves by it, within bounds
    share = {p: 1.0 if p.endswith("threat") else 0.5 for p in PATTERNS}
    patterns = {p: max(-4.0, min(4.0, PRIOR[p] + share[p] * (math.log(seen[p][1] / seen[p][0]) - base))) if sum(seen[p]) > 12 else PRIOR[p] for p in PATTERNS}
    return Grammar(insults, patterns, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Grammar:
    """Fitted on the whole texts of the ``sample`` labelled rows of least hash: a bounded sample, for learning only.

    Rows whose crc32 of doc_id as text leaves 1 by 3 are held out. Unlabelled rows and null texts teach nothing; without
    labels nothing is toxic. A doc_id with both labels counts as toxic.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").where("text is not null")
    rows = texts.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic")
    return learn([(r.text, r.toxic) for r in rows.toLocalIterator()])


def scores(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """docs' columns and tox_score, tox_predicted: a map over rows. Null and empty texts have the score of no clause."""
    weights = (grammar.insults, grammar.patterns, grammar.bias)
    kept = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(*weights)
        for b in batches:
            found = [g.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], names=[*b.schema.names, "tox_score", "tox_predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([*[f for f in kept.fields if f.name not in ("tox_score", "tox_predicted")]]).add("tox_score", DoubleType()).add("tox_predicted", IntegerType())
    return map_batches(docs.drop("tox_score", "tox_predicted"), run, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Null doc_ids aren't held out."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scores(thin, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))
