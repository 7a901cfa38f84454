"""Toxicity by a weighted grammar of clauses.

Words become symbols: insult (with a weight), threat, target, negation,
reported speech, quotation mark, other. Four small transducers read the symbols
of a clause and are composed into one deterministic machine:

* negation: after a negation, the next insult or threat within its reach is weakened
* reported speech: after a verb of saying, or inside quotation marks, insults and threats are weakened
* target: a person named in the clause strengthens the insults and threats that follow or precede it
* clause: sums the weights it is given; a threat counts only together with a target

So what is scored is a matched clause, not a word. A document's features are its
strongest clause, the sum over its clauses, the share of clauses that match,
and the same for plain (neither negated nor reported) matches; a logistic model
of them gives the score.

The insult lexicon is learned: words, and word beginnings of 4 to 6 letters
(for inflected forms), that mark toxic documents among labelled ones. Lexicon
and logistic model are fitted on a bounded, documented sample of the labelled
rows (``SAMPLE_PER_CLASS``); scoring covers every row and whole texts in one
narrow pass. The texts are the only input of a score.

Defined results: null text is empty; an empty text gets the score of a text in
which nothing matches; rows that repeat are scored each; without labelled rows
of both classes every score is 0. Labels repeated for a document count as their
largest; null labels are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BYTES, Memo, batches_of, ship_package, stored, text_or_empty

#: Labelled rows of each class that the lexicon and the model are fitted on, about (a hash of doc_id picks them).
SAMPLE_PER_CLASS = 4000
#: Toxic documents of the sample that must hold a lexicon entry: a count, and a share.
MIN_SUPPORT, MIN_SHARE = 4, 0.002
#: Least weight of an entry: lower bound (2 standard errors) of its log odds.
MIN_WEIGHT = 0.7
STEMS = (4, 5, 6)

# Function words of the grammar in the languages of the corpus.
NEGATIONS = "not no never neither nor nicht kein keine nie pas ne jamais ni nunca jamás".split()
REPORTING = "said says say wrote called quoted claims claimed told sagte sagt schrieb dit disait écrit appelé dijo dice escribió llamó".split()
TARGETS = "you your he she him her they them his their du dich dir er sie ihr ihn tu te toi vous lui elle ils tú usted él ella ellos te".split()
THREATS = "kill hurt destroy beat stab shoot töten schlagen tuer frapper détruire matar golpear destruir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]|[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")
REACH = 3  # words that a negation reaches over


class Transducer:
    """A deterministic transducer over (symbol, weight) pairs: ``step(state, symbol, weight) -> state, [(symbol, weight)]``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: ``other`` reads what this one writes."""
        def step(state, symbol, weight):
            mine, theirs = state
            mine, written = self.step(mine, symbol, weight)
            out: list = []
            for s, w in written:
                theirs, more = other.step(theirs, s, w)
                out += more
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)


def _negation(state: int, symbol: int, weight: float):
    if symbol == NEGATION:
        return REACH, []
    if state and symbol in (INSULT, THREAT):
        return 0, [(symbol, 0.25 * weight)]
    return max(0, state - 1), [(symbol, weight)]


def _reported(state: tuple[bool, bool], symbol: int, weight: float):
    quoted, told = state
    if symbol == QUOTE:
        return (not quoted, told), []
    if symbol == REPORT:
        return (quoted, True), []
    if symbol in (INSULT, THREAT) and (quoted or told):
        return state, [(symbol, 0.5 * weight)]
    return state, [(symbol, weight)]


def _target(state: tuple[bool, float], symbol: int, weight: float):
    named, open_weight = state
    if symbol == TARGET:  # what came before it in the clause gains as well
        return (True, 0.0), [(TARGET, 0.0), *([(INSULT, 0.5 * open_weight)] if open_weight else [])]
    if symbol in (INSULT, THREAT):
        return (named, open_weight if named else open_weight + weight), [(symbol, 1.5 * weight if named else weight)]
    return state, []


def _clause(state: tuple[float, float, bool], symbol: int, weight: float):
    insult, threat, named = state
    if symbol == INSULT:
        insult += weight
    elif symbol == THREAT:
        threat += weight
    elif symbol == TARGET:
        named = True
    state = (insult, threat, named)
    return state, [(OTHER, insult + (threat if named else 0.0))]


GRAMMAR = Transducer(0, _negation).then(Transducer((False, False), _reported)).then(Transducer((False, 0.0), _target)).then(
    Transducer((0.0, 0.0, False), _clause))


def clause_weight(symbols: list[tuple[int, float]]) -> float:
    """Weight of a clause given as (symbol, weight) pairs."""
    state, total = GRAMMAR.start, 0.0
    for symbol, weight in symbols:
        state, out = GRAMMAR.step(state, symbol, weight)
        if out:
            total = out[-1][1]
    return total


@dataclass(frozen=True)
class Model:
    words: dict  # lexicon word -> weight
    stems: dict  # lexicon word beginning -> weight
    coefficients: tuple  # of the features, the constant first; empty: no model


def symbols_of(words: dict, stems: dict) -> Memo:
    """Remembered (symbol, weight) of each lower-case token."""
    fixed = {w: (s, 2.0 if s == THREAT else 0.0) for s, ws in ((NEGATION, NEGATIONS), (REPORT, REPORTING), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}
    fixed |= {q: (QUOTE, 0.0) for q in "\"“”„«»"}

    def of(token: str) -> tuple[int, float]:
        if token in words:
            return INSULT, words[token]
        found = [stems[token[:k]] for k in STEMS if len(token) > k and token[:k] in stems]
        return (INSULT, max(found)) if found else fixed.get(token, (OTHER, 0.0))

    return Memo(of)


FEATURES = 4


def features(text: str, symbol: Memo) -> list[float]:
    """Of the matched clauses: strongest weight, log sum, log number, weight per clause of the text."""
    tokens = _TOKEN.findall(text.lower())
    found = list(map(symbol.__getitem__, tokens))
    if not any(s in (INSULT, THREAT) for s, _ in set(found)):
        return [0.0] * FEATURES
    weights, clause, clauses = [], [], 1
    for token, pair in zip(tokens, found, strict=True):
        if token[0] in ".!?;:\n":
            clauses += 1
            if any(s in (INSULT, THREAT) for s, _ in clause):
                weights.append(clause_weight(clause))
            clause = []
        else:
            clause.append(pair)
    if any(s in (INSULT, THREAT) for s, _ in clause):
        weights.append(clause_weight(clause))
    matched = [w for w in weights if w > 0]
    total = sum(matched)
    return [max(matched, default=0.0), math.log1p(total), math.log1p(len(matched)), total / clauses]


def marks(text: str) -> set[str]:
    """What a text can bring into the lexicon: its words, and word beginnings written with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def lexicon(toxic: int, clean: int, counts: list[tuple[str, int, int]]) -> tuple[dict, dict]:
    """Weights of words and of word beginnings from (mark, toxic documents, clean documents)."""
    words, stems = {}, {}
    for mark, a, b in counts:
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        weight = odds - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if weight >= MIN_WEIGHT:
            (stems if mark.endswith("*") else words)[mark.rstrip("*")] = round(weight, 6)
    return words, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple:
    """Newton steps with a ridge on a bounded sample."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        size = np.abs(step).max()
        w += step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return tuple(round(float(v), 9) for v in w)


def score_of(row: list[float], coefficients: tuple) -> float:
    if not coefficients:
        return 0.0
    z = coefficients[0] + sum(c * v for c, v in zip(coefficients[1:], row, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(toxic, text) of about ``per_class`` labelled training rows of each class, picked by a hash of doc_id."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = stored(usable.where(share < F.when(F.col("toxic") == 1, per_class / max(1, sizes.get(1, 0))).otherwise(per_class / max(1, sizes.get(0, 0)))), "toxic-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(texts.join(F.broadcast(picked), "doc_id").select("toxic", "text"), "toxic-texts")  # two classes of about per_class ids


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Lexicon and logistic model from labelled training rows."""
    ship_package(docs.sparkSession)
    sample = training_sample(docs, labels, per_class)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, {}, ())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flush():
            names = list(seen[0].keys() | seen[1].keys())
            out = [pa.array(names, pa.string()), *(pa.array([c[m] for m in names], pa.int64()) for c in (seen[1], seen[0]))]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(out, names=["mark", "toxic", "clean"])

        for batch in batches_of(batches, TEXT_BYTES):
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[label].update(marks(text))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield flush()
        yield flush()

    least = max(MIN_SUPPORT, int(MIN_SHARE * toxic))  # so at most (marks of a document) / MIN_SHARE entries
    counts = (sample.mapInArrow(count, "mark string, toxic long, clean long").groupBy("mark")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= least)
              .where(F.col("toxic") * clean > F.col("clean") * toxic * 2))
    words, stems = lexicon(toxic, clean, [tuple(r) for r in counts.collect()])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = symbols_of(words, stems)
        for batch in batches_of(batches, TEXT_BYTES):
            rows = [features(t, symbol) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(measure, "toxic int, x array<double>").toPandas().sort_values(["toxic"], kind="stable")
    x = np.array(sorted((y, *v) for y, v in zip(rows["toxic"], rows["x"], strict=True)))  # one order, whatever the partitions
    return Model(words, stems, fit_logistic(x[:, 1:], x[:, 0]))


def scored(docs: DataFrame, model: Model, column: str = "score", kept: tuple | None = None) -> DataFrame:
    """The ``kept`` columns of ``docs`` (all) and the toxicity of ``_text`` in ``column``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's marks / MIN_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        symbol = symbols_of(model.words, model.stems)
        for batch in batches_of(batches, TEXT_BYTES):
            scores = [score_of(features(t or "", symbol), model.coefficients) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, column])

    kept = kept or tuple(c for c in docs.columns if c != "_text")
    schema = docs.select(*kept, F.lit(0.0).alias(column)).schema
    return docs.select(*kept, "_text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("_text"))
    return scored(ids, fit(docs, labels), kept=("doc_id", "held_out")).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more, with its own columns."""
    return scored(docs.withColumn("_text", text_or_empty()), fit(docs, labels), "_toxicity").where("_toxicity < 0.5").drop("_toxicity")
