"""Soft-membership mixing: document rates that bring expected domain totals to target weights.

Only DataFrame functions. A classifier learned from a labelled table gives every
document a posterior over domains; rates r >= 0 are chosen so that for each
domain k the expected tokens sum(r * tokens * p[k]) match weight[k] * budget.

* Classifier: naive Bayes over marker words, fitted on at most ``FIT_ROWS``
  labelled documents (those first by a hash of doc_id; all, where there are
  fewer). The markers are the words of these documents whose document
  frequencies differ most between domains (``MARKERS``, a bound on the model).
  A document's evidence is the mean log likelihood of its markers, times
  ``EVIDENCE``, so long documents stay soft.
  Posteriors are rounded to ``GRID`` and renormalised.
* Rates: a step moves a rate by its posterior times one number per domain, and
  projects it onto its bound, so documents with equal posteriors keep equal
  rates: the table is summed once to one row per distinct posterior (its size is
  bounded by the grid), and every step is one aggregation of that table.
* With a given ``budget`` (tokens), rates are 0 or more and copies may be zero:
  projected gradient on sum_k (A_k - T_k)^2 / T_k from r = 1, its step size the
  inverse of the largest row sum of the scaled Gram matrix, which guarantees
  descent. Where ``STEPS`` of them do not reach ``TOLERANCE`` (the residual of a
  rare domain shrinks slowly), active-set steps take over: the domains'
  residuals go through the inverse Gram matrix of the rates above their bound.
* By default no document must go: rates are 1 or more, and the total is free.
  Active-set steps find the rates that meet the weights with the least change
  (token-weighted squares of r - 1). With certain memberships their total is the
  one at which the most over-represented domain is kept as it is; where no total
  can be met, the projected gradient goes as near to that one as it can.
* Targets that no rates can meet (a domain without weight whose documents must
  stay; a domain found only mixed with others) are reported by a warning that
  gives each domain's expected tokens and target; :func:`rates` returns them.

Copies are the rate's whole part, and one more for the documents whose hash
falls below its fraction, so totals hold in expectation and runs agree.

Defined results: null text is empty, an empty text has no tokens, the prior as
posterior and a rate all the same; rows that share a doc_id (null included) are
one document to the classifier and the rates; labelled rows without domain are
ignored; without any labelled row, or without tokens, all rates are 1. Domains
that no document belongs to are left out and the weights renormalised. Other
columns are ignored by the operator; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Most labelled documents that the classifier is fitted on.
FIT_ROWS = 20_000
MARKERS = 200
EVIDENCE = 12.0
GRID = 100
STEPS, TOLERANCE = 200, 1e-3
#: Most active-set steps; they end at TOLERANCE, as a rule after about ten, or where a rate beyond FARTHEST shows that no rates meet the targets.
ACTIVE_STEPS, FARTHEST = 60, 1e9


def _words() -> Column:
    """The words (cut at spaces, tabs and line ends, in lower case) of each text."""
    return F.array_remove(F.split(F.lower(F.translate(text_or_empty(), "\n\t", "  ")), " "), "")


def markers(labelled: DataFrame, count: int = MARKERS) -> tuple[list[str], list[tuple[str, list[float]]], list[float]]:
    """Domains in order, marker words with their log likelihoods by domain, and log priors of ``labelled`` (doc_id, text, domain)."""
    labelled = labelled.where("domain is not null")
    sizes = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}  # domains: the caller's few classes
    domains = sorted(sizes)
    if not domains:
        return [], [], []
    total = sum(sizes.values())
    words = labelled.select("domain", F.explode(_words()).alias("word"))
    seen = stored(words.groupBy("word").pivot("domain", domains).count().fillna(0), "marker-counts")  # read twice below
    sums = seen.agg(*[F.sum(F.col(f"`{d}`")).alias(f"n{i}") for i, d in enumerate(domains)]).first()
    sums = [max(1, sums[i] or 0) for i in range(len(domains))]
    rates = [(F.col(f"`{d}`") + 0.5) / F.lit(float(sums[i])) for i, d in enumerate(domains)]
    mean = sum(rates[1:], rates[0]) / F.lit(float(len(domains)))
    gain = sum(((r * F.log(r / mean)) for r in rates[1:]), rates[0] * F.log(rates[0] / mean))
    best = seen.withColumn("gain", F.round(gain, 12)).orderBy(F.desc("gain"), "word").limit(count).select("word", *[F.log(r) for r in rates]).collect()
    return domains, [(r[0], [float(x) for x in r[1:]]) for r in best], [math.log(sizes[d] / total) for d in domains]


def posteriors(docs: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, tokens, p: array of the domains' posteriors), one row per doc_id; and the domains."""
    spark = docs.sparkSession
    domains, words, priors = markers(labelled)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = lean.select("doc_id", _words().alias("words"))
    if not domains:
        return cut.groupBy("doc_id").agg(F.sum(F.size("words")).alias("tokens")).withColumn("p", F.array().cast("array<double>")), []
    k = range(len(domains))
    model = spark.createDataFrame([(w, *ls) for w, ls in words], "marker string, " + ", ".join(f"l{i} double" for i in k))
    # only markers become rows of their own (a set lookup within the text's row); a text without one keeps its row
    known = [w for w, _ in words]
    cut = cut.select("doc_id", F.size("words").alias("size"), F.posexplode_outer(F.filter("words", lambda w: w.isin(known))).alias("pos", "word"))
    tokens = F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("size")))  # of each text once
    every = (cut.join(F.broadcast(model), F.col("word") == F.col("marker"), "left")  # at most MARKERS rows
             .groupBy("doc_id").agg(tokens.alias("tokens"), F.count("marker").alias("hits"), *[F.sum(f"l{i}").alias(f"l{i}") for i in k]))
    logit = F.array(*[F.lit(priors[i]) + F.when(F.col("hits") > 0, F.least(F.col("hits").cast("double"), F.lit(EVIDENCE)) * F.col(f"l{i}") / F.col("hits")).otherwise(0.0) for i in k])
    every = every.withColumn("z", logit).withColumn("e", F.transform("z", lambda z: F.exp(z - F.array_max("z"))))
    every = every.withColumn("s", sum((F.col("e")[i] for i in k), F.lit(0.0)))
    every = every.withColumn("q", F.transform("e", lambda e: F.round(e / F.col("s") * GRID)))
    every = every.withColumn("s", sum((F.col("q")[i] for i in k), F.lit(0.0)))
    return every.select("doc_id", "tokens", F.transform("q", lambda q: q / F.col("s")).alias("p")), domains


def _moved(rate: Column, move: list[float], least: float) -> Column:
    """``rate`` moved by the posterior times ``move``, at least ``least``."""
    return F.greatest(F.lit(least), rate + sum((F.col("p")[i] * F.lit(float(x)) for i, x in enumerate(move)), F.lit(0.0)))


def _off(now: np.ndarray, target: np.ndarray, scale: np.ndarray) -> float:
    return float(np.abs((now - target) / scale).max())


def _active_set(cells: DataFrame, share: np.ndarray, weight: np.ndarray, target: np.ndarray | None, tolerance: float) -> np.ndarray | None:
    """The m for which rates max(least, 1 + p.m) meet ``target`` (least 0), or else any multiple of ``weight`` (least 1); None where there is none.

    The rates that meet it with the least token-weighted squares of r - 1 have
    this form. m minimises a convex function whose gradient is the domains'
    residuals: Newton steps, damped (as by Levenberg) until the function falls.
    """
    n, free = len(share), target is None
    least = 1.0 if free else 0.0
    held = np.flatnonzero(weight) if free else np.flatnonzero(share)  # nothing reduces a domain whose documents must stay
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def at(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The function, the expected totals and the Gram matrix of the rates above their bound."""
        z = sum((F.col("p")[i] * F.lit(float(x)) for i, x in enumerate(m)), F.lit(0.0))
        table = cells.withColumn("z", z).withColumn("r", F.greatest(F.lit(least), F.lit(1.0) + F.col("z")))
        above = F.when(F.col("z") + 1.0 >= least, F.col("tokens")).otherwise(0.0)
        row = table.agg(F.sum(F.col("tokens") * (F.col("z") * F.col("r") - (F.col("r") - 1.0) * (F.col("r") - 1.0) / 2.0)),
                        *[F.sum(F.col("tokens") * F.col("r") * F.col("p")[i]) for i in range(n)],
                        *[F.sum(above * F.col("p")[i] * F.col("p")[j]) for i, j in pairs]).first()
        gram = np.zeros((n, n))
        for (i, j), x in zip(pairs, row[n + 1:], strict=True):
            gram[i, j] = gram[j, i] = x
        return float(row[0]) - (0.0 if free else float(target @ m)), np.array(row[1:n + 1], dtype=float), gram

    m, damping = np.zeros(n), 1e-9
    value, now, gram = at(m)
    for _ in range(ACTIVE_STEPS):
        aim = now[held].sum() * weight if free else target
        if _off(now[held], aim[held], np.where(aim[held] > 0, aim[held], aim.sum() * 1e-3)) <= tolerance:
            return m
        if np.abs(m).max() > FARTHEST:
            return None
        h = gram[np.ix_(held, held)] + np.diag(damping * share[held])
        step = np.zeros(n)
        if free:  # now + h.step is a multiple of the weights, and the step keeps weight.m at 0
            w = weight[held]
            system = np.block([[h / share[held].sum(), -w[:, None]], [w[None, :], np.zeros((1, 1))]])
            step[held] = np.linalg.lstsq(system, np.append(-now[held] / share[held].sum(), 0.0), rcond=None)[0][:-1]
        else:
            step[held] = np.linalg.lstsq(h, (target - now)[held], rcond=None)[0]
        slope = float(((now if free else now - target) * step).sum())
        trial = at(m + step)
        if trial[0] <= value + 1e-4 * min(slope, 0.0) + 1e-12 * abs(value):
            m, (value, now, gram), damping = m + step, trial, max(damping / 16, 1e-9)
        else:
            damping = max(damping * 16, 1e-4)
    return None


def rates(table: DataFrame, domains: list[str], weights: Mapping[str, float], budget: float | None = None,
          steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(p, rate) of each distinct posterior of ``table`` (tokens, p), and {domain: (expected tokens, target)}."""
    k = range(len(domains))
    start = stored(table.groupBy("p").agg(F.sum("tokens").alias("tokens")).withColumn("rate", F.lit(1.0)), "cells")
    expected = [F.sum(F.col("tokens") * F.col("rate") * F.col("p")[i]) for i in k]
    sums = start.agg(*expected).first() if domains else []
    share = np.array([float(sums[i] or 0.0) for i in k])
    weight = np.array([float(weights.get(d, 0.0)) if share[i] > 0 else 0.0 for i, d in enumerate(domains)])
    if not weight.sum():
        return start.select("p", "rate"), {}
    weight = weight / weight.sum()
    least = 1.0 if budget is None else 0.0
    # where even free totals do not help: the closest to the total at which the most over-represented domain needs no down-sampling
    total = budget if budget is not None else max(share[i] / weight[i] for i in k if weight[i])
    target, moves, cells = total * weight, None, start
    scale = np.where(target > 0, target, total * 1e-3)  # a domain that should vanish
    if budget is None:
        moves = _active_set(start, share, weight, None, tolerance)
    if moves is None:
        size = 1.0 / max(max(share / scale), 1e-12)
        for step in range(steps):
            off = (np.array(cells.agg(*expected).first(), dtype=float) - target) / scale
            if max(abs(off)) <= tolerance:
                break
            cells = cells.withColumn("rate", _moved(F.col("rate"), list(-size * off), least))
            if step % 8 == 7:  # keeps the plan short
                cells = stored(cells, "cells")
        else:
            moves = None if budget is None else _active_set(start, share, weight, target, tolerance)
    if moves is not None:
        cells = start.withColumn("rate", _moved(F.lit(1.0), list(moves), least))
    cells = stored(cells, "cells")
    now = np.array(cells.agg(*expected).first(), dtype=float)
    if budget is None and moves is not None:
        target = now[weight > 0].sum() * weight
        scale = np.where(target > 0, target, target.sum() * 1e-3)
    totals = {d: (float(now[i]), float(target[i])) for i, d in enumerate(domains)}
    if _off(now, target, scale) > tolerance * 1.001:
        warnings.warn("mixing misses its targets: " + ", ".join(f"{d} {a:.0f} of {t:.0f} tokens" for d, (a, t) in totals.items()), stacklevel=2)
    return cells.select("p", "rate"), totals


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], budget: float | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id, tokens, p, rate, copies), one row per doc_id; and the domains of ``p``."""
    table, domains = posteriors(docs, labelled)
    table = stored(table, "posteriors")
    found, _ = rates(table, domains, weights, budget)
    out = table.join(found, "p")
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.withColumn("copies", F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")), domains


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as ``mixed`` (doc_id, copies) says, with its own columns."""
    columns = docs.columns
    counts = mixed.select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    joined = docs.join(counts, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).where("_copies > 0").select(*columns)


def labelled_domains(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, domain) of at most ``rows`` labelled documents: junk where quality is 0, else the language."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return lean.join(F.broadcast(marks), "doc_id").select("doc_id", "text", F.when(F.col("quality") == 0, F.lit("junk")).otherwise(F.col("lang")).alias("domain"))


#: Target weights of the registered query and of the pipeline.
WEIGHTS = {"en": 0.45, "de": 0.15, "fr": 0.15, "es": 0.15, "junk": 0.10}
