"""Quality classifier: cumulative-link regression on graded ratings over hashed text features.

One weight vector scores a text; ordered thresholds cut the score into grades, so every grade learns from all ratings.
Features are hashed words and hashed word shapes, as shares of the text, with the shares of repeated and of distinct words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import text_or_empty

TRAIN_ROWS = 6_000  # rated texts that the weights are fitted on, at most
DIM = 1 << 14
STEPS, RATE, RIDGE = 250, 0.1, 1e-4
CACHE_ROWS = 600_000
LONG_WORD = 64  # longer tokens are read whole like any other, but not remembered
_RUN = re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """Letter cases, digits and signs of a token, runs written once: "Word!!" becomes "Aa!"."""
    flat = "".join("a" if c.islower() else "A" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return _RUN.sub(r"\1", flat)


def slots(token: str) -> tuple[int, int]:
    """Hashed features of a token: its shape and its lower-case form."""
    return 2 + xxhash.xxh32_intdigest(shape(token)) % (DIM // 4 - 2), DIM // 4 + xxhash.xxh32_intdigest(token.lower(), 1) % (DIM - DIM // 4)


class _Slots(dict):
    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= CACHE_ROWS:
            self.clear()
        out = slots(token)
        if len(token) <= LONG_WORD:
            self[token] = out
        return out


def _globals(tokens: list[str]) -> tuple[float, float]:
    """Shares of tokens that repeat the one before and that are distinct, the latter less what its length leads to expect."""
    n = len(tokens)
    return sum(map(str.__eq__, tokens, tokens[1:])) / n, len(set(tokens)) / n - min(1.0, 3 / n**0.3)


def vector(text: str, known: dict) -> tuple[np.ndarray, np.ndarray]:
    tokens = text.split()
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts: dict[int, float] = {}
    for token, k in Counter(tokens).items():
        for s in known[token]:
            counts[s] = counts.get(s, 0.0) + k / len(tokens)
    counts[0], counts[1] = _globals(tokens)
    return np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights, thresholds in order and the grades that they part."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, grades: list[float]) -> None:
        self.weights, self.cuts, self.grades = weights, cuts, grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade above each threshold), rows x thresholds."""
        return _sigmoid(scores[:, None] - self.cuts[None])


def fit(index: np.ndarray, value: np.ndarray, start: np.ndarray, grade: np.ndarray, grades: list[float]) -> Model:
    """Maximum likelihood of the cumulative-link model by Adam over all rows; row i holds start[i] to start[i + 1]."""
    k = len(grades) - 1
    lengths, rows = np.diff(start), np.repeat(np.arange(len(grade)), np.diff(start))
    share = np.array([(grade > j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    # Thresholds as a first one and positive gaps keep their order.
    theta = np.concatenate([np.zeros(DIM), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        cuts = theta[DIM] + np.concatenate([[0.0], np.cumsum(np.exp(theta[DIM + 1 :]))])
        score = np.bincount(rows, value * theta[index], minlength=len(grade)) if len(rows) else np.zeros(len(grade))
        up = np.where(grade > 0, _sigmoid(score - cuts[np.maximum(grade, 1) - 1]), 1.0)  # P(at least its grade)
        over = np.where(grade < k, _sigmoid(score - cuts[np.minimum(grade, k - 1)]), 0.0)  # P(above its grade)
        p = np.maximum(up - over, 1e-9)
        d_up, d_over = up * (1 - up) * (grade > 0), over * (1 - over) * (grade < k)
        d_score = (d_over - d_up) / p / len(grade)
        d_cut = np.bincount(np.maximum(grade, 1) - 1, d_up / p, k) - np.bincount(np.minimum(grade, k - 1), d_over / p, k)
        d_cut /= len(grade)
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(index, value * d_score[rows], DIM) + RIDGE * theta[:DIM], tail[:1], tail[1:] * np.exp(theta[DIM + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[DIM] + np.concatenate([[0.0], np.cumsum(np.exp(theta[DIM + 1 :]))])
    assert lengths.sum() == len(index)
    return Model(theta[:DIM].copy(), cuts, grades)


def fit_quality(docs: DataFrame, ratings: DataFrame, rating: str = "quality") -> Model | None:
    """Model from at most TRAIN_ROWS rated texts (those with the smallest hash of the identifier); None without any."""
    one = ratings.where(F.col(rating).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(rating).cast("double")).alias("y"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # bounded: safe to broadcast and to collect

    @F.pandas_udf("i binary, v binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        known = _Slots()
        got = [vector(t, known) for t in texts]
        return pd.DataFrame({"i": [i.tobytes() for i, _ in got], "v": [v.tobytes() for _, v in got]})

    train = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id")
    rows = train.select("doc_id", "y", run("text").alias("x")).select("doc_id", "y", "x.*").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (str(r["doc_id"]), r["i"], r["v"]))
    grades = sorted({r["y"] for r in rows})
    index = [np.frombuffer(r["i"], np.int32) for r in rows]
    value = [np.frombuffer(r["v"], np.float32) for r in rows]
    start = np.concatenate([[0], np.cumsum([len(i) for i in index])])
    grade = np.searchsorted(grades, [r["y"] for r in rows])
    if len(grades) == 1:
        return Model(np.zeros(DIM), np.zeros(0), grades)
    return fit(np.concatenate(index), np.concatenate(value).astype(float), start, grade, grades)


class _Weights(dict):
    """Token to the sum of its features' weights."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def __missing__(self, token: str) -> float:
        a, b = slots(token)
        out = float(self.weights[a] + self.weights[b])
        if len(self) >= CACHE_ROWS:
            self.clear()
        if len(token) <= LONG_WORD:
            self[token] = out
        return out

    def score(self, text: str) -> float:
        tokens = text.split()
        if not tokens:
            return 0.0
        a, b = _globals(tokens)
        return sum(map(self.__getitem__, tokens)) / len(tokens) + float(self.weights[0]) * a + float(self.weights[1]) * b


def quality_scores(docs: DataFrame, ratings: DataFrame, rating: str = "quality", keep_from: float = 0.5) -> DataFrame:
    """Expected grade and tail probability of every whole text.

    ``ratings`` (doc_id, rating) may hold any number of ordered grades. Returns one row per input row:
    ``(doc_id, expected_grade, tail_prob, kept)``: the mean of the grade's distribution, the probability of the highest
    grade, and whether that reaches ``keep_from``. Null texts count as empty and get the distribution of a score of
    zero. Without ratings, expected_grade and tail_prob are null and everything is kept; with a single grade they are
    that grade and 1. Ratings may be null or repeated (the largest counts). Extra columns are ignored; an empty table
    gives an empty result.
    """
    model = fit_quality(docs, ratings, rating)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_prob"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights

    @F.pandas_udf("expected_grade double, tail_prob double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        known, gaps = _Weights(m.weights), np.diff(m.grades)
        for texts in batches:
            tails = m.tails(np.array([known.score(t) for t in texts], np.float64).reshape(len(texts)))
            top = tails[:, -1] if tails.shape[1] else np.ones(len(texts))
            yield pd.DataFrame({"expected_grade": m.grades[0] + tails @ gaps, "tail_prob": top})

    out = rows.select("doc_id", run("text").alias("s")).select("doc_id", "s.*")
    return out.withColumn("kept", F.col("tail_prob") >= keep_from)
