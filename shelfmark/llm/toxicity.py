"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade >= k) = sigmoid(w.x - cut_k): one weight vector for all thresholds, and ordered cuts. Grades of the fitting
sample: 0 for label 0; label 1 is spread over 1 to 3 by how many of the words that mark label 1 a text has (thirds of
the labelled-1 texts). The result is the expected severity, the sum of P(grade >= k).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import labelled_sample, lean, pick, slices
from shelfmark.session import read_table

GRADES = 3
#: Rows of each label that fitting uses at most, the longest text among them, the characters of a label's texts in all, and
#: the words that get a weight.
SAMPLE_PER_CLASS, SAMPLE_CHARS, SAMPLE_TOTAL, VOCABULARY = 4_000, 50_000, 20_000_000, 400
#: A text is toxic from this probability of grade 1 or more on.
CUT = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


@dataclass(frozen=True)
class OrdinalModel:
    """weights by word; cuts ascend."""

    weights: dict[str, float]
    cuts: tuple[float, ...]

    def at_least(self, text: str) -> list[float]:
        """P(grade >= k) for k from 1 on."""
        w = self.weights
        z = sum(w[word] * (1 + math.log(n)) for word, n in word_counts(text).items() if word in w)
        return [1 / (1 + math.exp(-max(-35.0, min(35.0, z - c)))) for c in self.cuts]


def _features(sample: list[Counter], y: np.ndarray, size: int) -> tuple[list[str], Counter]:
    """Words with the clearest difference between the labels (a signed root of chi-squared), and the marking ones."""
    seen = [Counter(), Counter()]
    for words, label in zip(sample, y.tolist(), strict=True):
        seen[label].update(words.keys())
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    score = {}
    for word in seen[0].keys() | seen[1].keys():
        a, b = seen[0][word] / n[0], seen[1][word] / n[1]
        if seen[0][word] + seen[1][word] >= 3:
            p = (seen[0][word] + seen[1][word]) / sum(n)
            score[word] = (b - a) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-12)
    chosen = sorted(score, key=lambda w: (-abs(score[w]), w))[:size]
    marks = Counter({w: 1 for w in chosen if score[w] >= 5 and seen[1][w] / n[1] >= 5 * seen[0][w] / n[0]})
    return chosen, marks


def fit_ordinal(sample: list[tuple[str, int]], counts: dict[int, int], size: int = VOCABULARY, rounds: int = 400, rate: float = 0.05, penalty: float = 3e-5) -> OrdinalModel:
    """Penalised maximum likelihood by Adam over the whole sample; classes are weighted to their share of all labels."""
    y = np.array([v for _, v in sample], int)
    if len(set(y.tolist())) < 2:
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return OrdinalModel({}, tuple(-math.log(share / (1 - share)) + k for k in range(GRADES)))
    words = [word_counts(t) for t, _ in sample]
    chosen, marks = _features(words, y, size)
    hits = np.array([sum(w[m] for m in marks.keys() & w.keys()) for w in words])
    thirds = np.quantile(hits[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (hits > thirds[0]) + (hits > thirds[1]), 0)
    index = {w: k for k, w in enumerate(chosen)}
    rows, cols, vals = [], [], []
    for k, w in enumerate(words):
        for word, n in w.items():
            if (c := index.get(word)) is not None:
                rows.append(k)
                cols.append(c)
                vals.append(1 + math.log(n))
    rows, cols, vals = np.array(rows, int), np.array(cols, int), np.array(vals)
    total = sum(counts.values())
    class_weight = np.array([counts[0] / total / np.mean(y == 0), counts[1] / total / np.mean(y == 1)])[y] / len(y)
    # Cuts stay in order as a first cut and positive gaps: theta = (w, cut_1, log gaps).
    theta = np.concatenate([np.zeros(len(chosen)), [1.0], np.zeros(GRADES - 1)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, gaps = theta[: len(chosen)], np.exp(theta[len(chosen) + 1 :])
        cuts = theta[len(chosen)] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(rows, vals * w[cols], len(y))
        at = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -35, 35)))
        upper = np.hstack([np.ones((len(y), 1)), at])  # P(grade >= g)
        lower = np.hstack([at, np.zeros((len(y), 1))])  # P(grade >= g + 1)
        own = np.arange(len(y))
        p = np.maximum(upper[own, grade] - lower[own, grade], 1e-12)
        slope_u, slope_l = (upper * (1 - upper))[own, grade], (lower * (1 - lower))[own, grade]
        grad_z = -class_weight * (slope_u - slope_l) / p
        grad_cut = np.zeros(GRADES)
        np.add.at(grad_cut, np.maximum(grade - 1, 0), np.where(grade > 0, class_weight * slope_u / p, 0))
        np.add.at(grad_cut, np.minimum(grade, GRADES - 1), np.where(grade < GRADES, -class_weight * slope_l / p, 0))
        grad = np.concatenate([np.bincount(cols, vals * grad_z[rows], len(chosen)) + penalty * w, [grad_cut.sum()], gaps * np.cumsum(grad_cut[::-1])[::-1][1:]])
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    cuts = theta[len(chosen)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(chosen) + 1 :]))])
    return OrdinalModel({w: float(theta[k]) for w, k in index.items() if abs(theta[k]) > 1e-6}, tuple(cuts.tolist()))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_chars: int = SAMPLE_CHARS, where=None) -> OrdinalModel:
    sample, counts = labelled_sample(docs, labels, "toxic", per_class, most_chars, SAMPLE_TOTAL, where)
    return fit_ordinal(sample, counts)


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per input row: doc_id, severity (0 to 3), grade, toxic (P(grade >= 1) of ``cut`` or more).

    grade counts the thresholds that are likelier passed than not. Null and empty texts have no features and get the
    severity of the cuts alone. Repeated rows are scored each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY words at most

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            passed = [shared.value.at_least(t or "") for t in batch.column(1).to_pylist()]
            found = [pa.array([sum(p) for p in passed], pa.float64()), pa.array([sum(x >= 0.5 for x in p) for p in passed], pa.int32()), pa.array([p[0] >= cut for p in passed], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], ["doc_id", "severity", "grade", "toxic"])

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that are not toxic (as severity has it), with all their columns, whatever they are called."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            yield batch.filter(pa.array([shared.value.at_least(t or "")[0] < cut for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return severity(docs, model).withColumn("severity", F.round("severity", 9))
