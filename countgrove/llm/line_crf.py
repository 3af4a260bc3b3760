"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from features of itself and of its two neighbours, with
weights for the change of label between lines. The quality of a document is the marginal
probability of `good` (forward-backward), averaged over its lines with their lengths as
weights. The field is fitted on a bounded sample of labelled documents, whose lines all take
the label of the document; every document is scored over all its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_batches, fields, held_out, map_batches, text_groups

SAMPLE = 2000    # labelled documents the field is fitted on, at most
STEPS = 150
RATE = 0.2
PENALTY = 1e-2
OWN = 13         # features of a line by itself
WIDTH = 3 * OWN + 1

# Characters counted as symbols and as marks of a sentence.
SYMBOLS = "#*$%&|<>@^~=_\\{}[]/+"
MARKS = ".,;:?'\"()-"

_SPACE, _LOWER, _UPPER, _DIGIT, _MARK, _SHOUT, _SYMBOL, _PIPE, _REST = range(9)


def _class_table() -> np.ndarray:
    table = np.full(0x10000, _LOWER, dtype=np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = (_SPACE if ch.isspace() else _UPPER if ch.isupper() else _LOWER if ch.isalpha()
                    else _DIGIT if ch.isdigit() else _REST)
    for chars, kind in ((SYMBOLS, _SYMBOL), (MARKS, _MARK), ("!", _SHOUT), ("|", _PIPE)):
        table[[ord(c) for c in chars]] = kind
    return table


_CLASSES = _class_table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths, lines per text) of all lines of the texts, in order.

    A text has one line more than it has newlines; an empty text is one empty line.
    """
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _CLASSES[np.minimum(points, 0xFFFF)]
    breaks = np.nonzero(points == 10)[0]
    starts = np.concatenate(([0], breaks + 1))
    ends = np.concatenate((breaks, [len(points)]))
    size = ends - starts
    per_text = np.array([t.count("\n") + 1 for t in texts])
    n = np.maximum(size, 1)

    def share_of(kind):
        total = np.concatenate(([0], np.cumsum(kinds == kind, dtype=np.int64)))
        return total[ends] - total[starts]

    count = {k: share_of(k) for k in (_LOWER, _UPPER, _DIGIT, _MARK, _SHOUT, _SYMBOL, _PIPE)}
    letters = np.maximum(count[_LOWER] + count[_UPPER], 1)
    words, line_of = [], []
    lines = joined.split("\n")
    for i, line in enumerate(lines):
        own = line.split()
        words += own
        line_of.append(len(own))
    n_words = np.array(line_of)
    line_of = np.repeat(np.arange(len(lines)), n_words)
    code = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, dtype=np.int64)
    pairs = np.unique(line_of.astype(np.int64) << 32 | code)
    distinct = np.bincount(pairs >> 32, minlength=len(lines))
    again = np.zeros(len(code), dtype=bool)
    again[1:] = (code[1:] == code[:-1]) & (line_of[1:] == line_of[:-1])
    stutter = np.bincount(line_of[again], minlength=len(lines))
    text_of = np.repeat(np.arange(len(texts)), per_text)
    line_code = pd.factorize(np.array(lines, dtype=object))[0]
    first = np.unique(text_of.astype(np.int64) << 32 | line_code, return_index=True)[1]
    repeated = np.ones(len(lines))
    repeated[first] = 0
    last = points[np.maximum(ends - 1, 0)] if len(points) else np.zeros(len(lines))
    stopped = np.isin(last, [ord(c) for c in ".!?"]) & (size > 0)
    m = np.maximum(n_words, 1)
    own = np.stack([
        np.log1p(size), np.log1p(n_words), np.minimum(size / m, 40), count[_SYMBOL] / n, count[_PIPE] / n,
        count[_SHOUT] / n, count[_MARK] / n, count[_DIGIT] / n, count[_UPPER] / letters, distinct / m,
        stutter / m, repeated * (n_words > 0), stopped.astype(float)], axis=1)
    return _with_neighbours(own, per_text), size, per_text


def _with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A constant, own features, and those of the line before and after (zero at the ends)."""
    first = np.cumsum(per_text) - per_text
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[first + per_text - 1] = 0
    return np.concatenate([np.ones((len(own), 1)), own, before, after], axis=1)


@dataclass
class LineField:
    """Fitted field: weights of the good state, change weights, and scaling of the features."""

    weights: np.ndarray
    change: np.ndarray      # (2, 2): from label, to label
    mean: np.ndarray
    spread: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Quality in 0..1 of every text."""
        texts = [t or "" for t in texts]
        out = np.zeros(len(texts))
        for a, b in text_groups(texts):
            x, size, per_text = line_features(texts[a:b])
            unary = ((x - self.mean) / self.spread) @ self.weights
            good = _marginals(unary, _Lattice(per_text), self.change)[0]
            weight = np.maximum(size, 1)
            at = np.cumsum(per_text) - per_text
            out[a:b] = np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)
        return np.clip(out, 0.0, 1.0)


class _Lattice:
    """Order of lines for the recursions: by position in the text, then by falling text length.

    Step t of a recursion is one slice, which holds line t of every text that has one.
    """

    def __init__(self, per_text: np.ndarray):
        order = np.argsort(-per_text, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        longest = int(per_text.max())
        self.live = np.searchsorted(-per_text[order], -np.arange(longest), side="left")
        self.begin = np.concatenate(([0], np.cumsum(self.live)))
        first = np.cumsum(per_text) - per_text
        step = np.arange(per_text.sum()) - np.repeat(first, per_text)
        self.place = self.begin[step] + np.repeat(rank, per_text)


def _marginals(unary: np.ndarray, lattice: _Lattice, change: np.ndarray):
    """P(good) of each line and the expected label changes summed over all texts.

    Messages are normalised at every step, so precision does not depend on the number of lines.
    """
    good = np.empty_like(unary)
    good[lattice.place] = unary
    f, b = np.zeros((2, len(unary))), np.zeros((2, len(unary)))
    live, begin = lattice.live, lattice.begin

    def put(message, at, n, zero, one):
        total = np.logaddexp(zero, one)
        message[0, at:at + n] = zero - total
        message[1, at:at + n] = one - total

    put(f, 0, live[0], np.zeros(live[0]), good[:live[0]])
    for t in range(1, len(live)):
        n, now, old = live[t], begin[t], begin[t - 1]
        f0, f1 = f[0, old:old + n], f[1, old:old + n]
        put(f, now, n, np.logaddexp(f0 + change[0, 0], f1 + change[1, 0]),
            np.logaddexp(f0 + change[0, 1], f1 + change[1, 1]) + good[now:now + n])
    for t in range(len(live) - 1, 0, -1):
        n, now, old = live[t], begin[t], begin[t - 1]
        b0, b1 = b[0, now:now + n], b[1, now:now + n] + good[now:now + n]
        put(b, old, n, np.logaddexp(b0 + change[0, 0], b1 + change[0, 1]),
            np.logaddexp(b0 + change[1, 0], b1 + change[1, 1]))
    now = np.arange(begin[1], len(unary))
    old = now - np.repeat(live[:-1], live[1:]) if len(now) else now
    joint = np.stack([f[i, old] + change[i, j] + b[j, now] + (good[now] if j else 0) for i in (0, 1) for j in (0, 1)])
    moves = np.exp(joint - np.logaddexp.reduce(joint, axis=0)).sum(axis=1).reshape(2, 2)
    return _sigmoid(f[1] + b[1] - f[0] - b[0])[lattice.place], moves


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(features: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = STEPS,
        penalty: float = PENALTY) -> LineField:
    """Maximum likelihood with a squared penalty, by full-batch gradient steps of adaptive size."""
    mean = features.mean(axis=0)
    spread = features.std(axis=0)
    mean[0], spread[spread < 1e-9] = 0.0, 1.0
    x = (features - mean) / spread
    truth = np.repeat(labels.astype(float), per_text)
    stays = np.zeros((2, 2))
    for y in (0, 1):
        stays[y, y] = (per_text[labels == y] - 1).sum()
    theta = np.zeros(x.shape[1] + 4)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    n = len(labels)
    lattice = _Lattice(per_text)
    for step in range(1, steps + 1):
        change = theta[-4:].reshape(2, 2)
        good, moves = _marginals(x @ theta[:-4], lattice, change)
        grad = np.concatenate([x.T @ (truth - good), (stays - moves).ravel()]) / n - penalty * theta
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta += RATE * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return LineField(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy(), mean, spread)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> LineField:
    """Fits the field on at most `sample` labelled documents outside the held-out fold.

    The sample is the lowest hashes of the ids, so reruns agree. A document labelled several
    times has the majority; NULL labels are ignored. Without any labelled document the field
    is neutral and scores 0.5.
    """
    chosen = (labels.select(id_col, label_col).dropna().filter(~held_out(id_col))
              .groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
              .orderBy(F.xxhash64(id_col), id_col).limit(sample))
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col)

    def work(truth, text):
        rows = [[], [], []]
        for y, t in zip(truth, text):
            x, _, per_text = line_features([t])
            rows[0].append(y)
            rows[1].append(int(per_text[0]))
            rows[2].append(x.astype(np.float32).tobytes())
        return rows

    got = map_batches(texts, ["_label", "_text"], fields(
        ("y", T.IntegerType()), ("n", T.IntegerType()), ("x", T.BinaryType())), work).orderBy(
        "y", F.xxhash64("x"), "x").collect()
    if not got:
        return LineField(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH))
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float32) for r in got]).reshape(-1, WIDTH)
    return fit(x.astype(float), np.array([r["n"] for r in got]), np.array([r["y"] for r in got]))


def score(docs: DataFrame, field: LineField, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of `docs` with the quality of the whole text in column `name`.

    NULL and empty texts are one empty line; texts alone decide, so equal texts score alike;
    repeated rows are scored each; an empty table gives no rows. `name` must be free.
    """
    return append_batches(docs, [text_col], fields((name, T.DoubleType())),
                          lambda texts: [field.score(texts)])
