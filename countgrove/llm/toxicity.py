"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

Training documents are graded 0 (not toxic) to GRADES - 1: toxic ones by how much toxic
vocabulary they hold, cut into equal parts. The model has one weight per word, shared by all
grades, and one ordered threshold per step between grades:
P(grade >= k) = sigmoid(score - threshold_k). The result is the expected grade.

Features are words and the openings of words (four letters), which carry over to inflected and
compounded forms. The vocabulary are the features whose document counts differ most between
toxic and other documents of a bounded labelled sample; near-copies in the sample count once,
so that a copied document does not make its words look toxic. A document is scored over its
whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import written
from .common import append_batches, fields, held_out, map_batches, without_numerals

GRADES = 4
VOCABULARY = 1000
SAMPLE = 2000      # labelled documents of either kind, at most
SUPPORT = 5        # sample documents that a word of the vocabulary is in
MARKED = 2.0       # log odds ratio from which a feature counts as toxic vocabulary
EVIDENCE = 6.0     # log likelihood ratio from which a feature joins the vocabulary
OPENING = 4        # letters of an opening
STEPS = 300
RATE = 0.1
PENALTY = 2e-4

_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> Counter:
    """Counts of the lower-cased runs of letters and of their openings (`^` and OPENING letters)."""
    out: Counter = Counter()
    for word, n in Counter(_LETTERS.findall(without_numerals((text or "").lower()))).items():
        out[word] += n
        if len(word) > OPENING:
            out["^" + word[:OPENING]] += n
    return out


def copy_mark(text: str) -> int:
    """Smallest hash of the longer words (of the whole text without any): mostly equal in near-copies."""
    long = {w for w in _LETTERS.findall(without_numerals(text.lower())) if len(w) > 6}
    return min(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 1) for w in (long or {text})) >> 1


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class SeverityModel:
    place: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray    # rising, one per grade above 0

    def reach(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = 0.0
        for word, n in features_of(text).items():
            at = self.place.get(word)
            if at is not None:
                score += self.weights[at] * np.log1p(n)
        return _sigmoid(score - self.thresholds)


def fit(x: np.ndarray, grades: np.ndarray, steps: int = STEPS, penalty: float = PENALTY):
    """(weights, thresholds) of the penalised likelihood, by gradient steps of adaptive size."""
    n, width = x.shape
    cuts = GRADES - 1
    theta = np.zeros(width + cuts)     # weights, first threshold, logarithms of the steps up
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        rise = np.exp(theta[width + 1:])
        cut = theta[width] + np.concatenate(([0.0], np.cumsum(rise)))
        below = np.zeros((n, GRADES + 1))      # P(grade < k), k = 0 .. GRADES
        below[:, -1] = 1
        below[:, 1:-1] = _sigmoid(cut[None, :] - (x @ theta[:width])[:, None])
        low, high = below[rows, grades], below[rows, grades + 1]
        p = np.maximum(high - low, 1e-12)
        d_cut = np.zeros((n, GRADES + 1))
        d_cut[rows, grades + 1] += high * (1 - high) / p
        d_cut[rows, grades] -= low * (1 - low) / p
        d_cut = d_cut[:, 1:-1].sum(axis=0)
        grad = np.concatenate([x.T @ (high + low - 1), [d_cut.sum()],
                               [d_cut[k + 1:].sum() * rise[k] for k in range(cuts - 1)]]) / n
        grad[:width] -= penalty * theta[:width]
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta = theta + RATE * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return theta[:width], theta[width] + np.concatenate(([0.0], np.cumsum(np.exp(theta[width + 1:]))))


def grades_of(toxic: np.ndarray, burden: np.ndarray) -> np.ndarray:
    """0 for documents that are not toxic; 1.. for equal parts of the others by rising burden."""
    out = np.zeros(len(toxic), dtype=np.int64)
    at = np.nonzero(toxic)[0]
    if len(at):
        edges = np.quantile(burden[at], np.arange(1, GRADES - 1) / (GRADES - 1))
        out[at] = 1 + np.searchsorted(edges, burden[at], side="left")
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> SeverityModel:
    """Fits the model on at most `sample` toxic and `sample` other documents outside the held-out fold.

    The sample is the lowest hashes of the ids; a document labelled several times has the
    majority; NULL labels are ignored. Without documents of both kinds nothing is toxic.
    """
    known = (labels.select(id_col, label_col).dropna().filter(~held_out(id_col)).groupBy(id_col)
             .agg((F.avg(label_col) >= 0.5).alias("_toxic")))
    order = (F.xxhash64(id_col), id_col)
    chosen = (known.filter("_toxic").orderBy(*order).limit(sample)
              .unionByName(known.filter("not _toxic").orderBy(*order).limit(sample)))
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(
        F.broadcast(chosen.withColumnRenamed(id_col, "_id")), "_id")
    same = Window.partitionBy("_toxic", "_mark").orderBy(F.xxhash64("_id"), "_id", "_text")
    texts = written(append_batches(found, ["_text"], fields(("_mark", T.LongType())),
                                   lambda t: [[copy_mark(x) for x in t]])
                    .withColumn("_r", F.row_number().over(same)).filter("_r = 1").select("_toxic", "_text"), "sample")

    def count_features(toxic, text):
        counts = {True: Counter(), False: Counter()}
        for y, t in zip(toxic, text):
            counts[y].update(features_of(t).keys())
        every = list(counts[True].keys() | counts[False].keys())
        return every, [counts[True][w] for w in every], [counts[False][w] for w in every]

    totals = {r["_toxic"]: r["count"] for r in texts.groupBy("_toxic").count().collect()}
    n_toxic, n_other = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_other:
        return SeverityModel({}, np.zeros(0), np.full(GRADES - 1, 50.0))
    seen = map_batches(texts, ["_toxic", "_text"], fields(
        ("word", T.StringType()), ("a", T.LongType()), ("b", T.LongType())), count_features).groupBy("word").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") + F.col("b") >= SUPPORT)
    odds = (F.log((F.col("a") + 0.5) / (n_toxic - F.col("a") + 0.5))
            - F.log((F.col("b") + 0.5) / (n_other - F.col("b") + 0.5)))
    share = (F.col("a") + F.col("b")) / (n_toxic + n_other)
    ratio = sum(n * F.log((n + 0.5) / (whole * part + 0.5))     # likelihood ratio of the two counts
                for n, whole, part in ((F.col("a"), n_toxic, share), (F.col("b"), n_other, share),
                                       (n_toxic - F.col("a"), n_toxic, 1 - share),
                                       (n_other - F.col("b"), n_other, 1 - share)))
    top = seen.select("word", odds.alias("odds"), ratio.alias("ratio")).filter(
        F.col("ratio") >= EVIDENCE).orderBy(
        F.col("ratio").desc(), "word").limit(VOCABULARY).collect()
    place = {r["word"]: i for i, r in enumerate(top)}
    marked = np.array([r["odds"] >= MARKED for r in top], dtype=float)

    def count_known(toxic, text):
        rows: tuple = ([], [], [])
        for y, t in zip(toxic, text):
            own = {place[w]: n for w, n in features_of(t).items() if w in place}
            for column, value in zip(rows, (y, list(own), list(own.values()))):
                column.append(value)
        return rows

    got = map_batches(texts, ["_toxic", "_text"], fields(
        ("y", T.BooleanType()), ("at", T.ArrayType(T.IntegerType())), ("n", T.ArrayType(T.IntegerType()))),
        count_known).orderBy("y", "at", "n").collect()
    x = np.zeros((len(got), max(len(place), 1)))
    for row, r in zip(x, got):
        row[r["at"]] = np.log1p(r["n"])
    toxic = np.array([r["y"] for r in got], dtype=bool)
    weights, thresholds = fit(x, grades_of(toxic, x[:, :len(marked)] @ marked))
    return SeverityModel(place, weights, thresholds)


def severity(docs: DataFrame, model: SeverityModel, text_col: str = "text", severity_name: str = "severity",
             grade_name: str = "grade", toxic_name: str = "toxic") -> DataFrame:
    """All rows and columns of `docs` with the expected grade, the likeliest grade and a verdict.

    `severity` lies in 0..GRADES-1; `toxic` holds where a grade above 0 is likelier than not.
    NULL and empty texts have no words and get the model's grade for that; texts alone decide,
    so equal texts agree; repeated rows are scored each; an empty table gives no rows. The
    names must be free.
    """
    def work(texts):
        reach = np.array([model.reach(t) for t in texts])
        steps = np.concatenate([np.ones((len(reach), 1)), reach, np.zeros((len(reach), 1))], axis=1)
        return reach.sum(axis=1), (steps[:, :-1] - steps[:, 1:]).argmax(axis=1), reach[:, 0] >= 0.5

    return append_batches(docs, [text_col], fields(
        (severity_name, T.DoubleType()), (grade_name, T.IntegerType()), (toxic_name, T.BooleanType())), work)
