"""Ordinal quality classifier: cumulative-link regression on hashed text (op7).

One weight vector over hashed words and a few binned traits of the text gives every text a score; ordered thresholds cut
the score into grades: P(grade >= k) = sigmoid(score - threshold k). All thresholds share the weights, so the tail
probabilities of a text fall with k, and their sum is its expected grade. A text is kept if P(grade >= `least`) reaches
`probability`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common

BITS = 18
TRAITS = 8
GRADED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())])


def _traits(data: bytes, n_words: int) -> np.ndarray:
    """Bins of a text's shape: words, word length, marks, digits, capitals, lines, repeated lines, non-ASCII."""
    x = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) if data else np.zeros(256, dtype=np.int64)
    n = max(len(data), 1)
    lines = data.split(b"\n")
    letters = x[65:91].sum() + x[97:123].sum() + x[128:].sum()
    marks = x[33:48].sum() + x[58:65].sum() + x[91:97].sum() + x[123:127].sum()
    values = (
        min(int(np.log2(n_words + 1)), 15),
        min(int(n / max(n_words, 1)), 15),
        min(int(60 * marks / n), 15),
        min(int(60 * x[48:58].sum() / n), 15),
        min(int(60 * x[65:91].sum() / max(letters, 1)), 15),
        min(int(np.log2(n / len(lines) + 1)), 15),
        int(15 * (1 - len(set(lines)) / len(lines))),
        min(int(60 * x[128:].sum() / n), 15),
    )
    return np.array([(1 << BITS) + 16 * k + v for k, v in enumerate(values)])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, value, number of entries of each text): hashed words by 1 / sqrt(n), and traits."""
    raw = [common.utf8(x) for x in texts]
    hashes, counts = common.word_hashes(raw, common.NO_WORD)
    column = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    value = np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)
    traits = np.concatenate([_traits(x, int(n)) for x, n in zip(raw, counts, strict=True)]) if raw else np.empty(0, dtype=np.int64)
    owner = np.concatenate((np.repeat(np.arange(len(raw)), counts), np.repeat(np.arange(len(raw)), TRAITS)))
    order = np.argsort(owner, kind="stable")
    return np.concatenate((column, traits))[order], np.concatenate((value, np.ones(len(traits))))[order], counts + TRAITS


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k) for each text and each grade but the lowest."""
        column, value, n = features(texts)
        score = np.add.reduceat(self.weights[column] * value, np.cumsum(n) - n) if len(n) else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def likelihood(state: np.ndarray, y: np.ndarray, column: np.ndarray, value: np.ndarray, n: np.ndarray, grades: int) -> tuple[float, np.ndarray]:
    """Mean log-likelihood of the grades y and its gradient. state: weights, first threshold, logs of the gaps between
    thresholds; column, value, n: features of all texts and how many each has."""
    k = grades - 1
    size = len(state) - k
    begin = np.cumsum(n) - n
    w, gaps = state[:size], np.exp(np.clip(state[size + 1 :], -8, 8))
    theta = state[size] + np.concatenate(([0.0], np.cumsum(gaps)))
    score = np.add.reduceat(w[column] * value, begin)
    tail = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30)))
    full = np.concatenate((np.ones((len(y), 1)), tail, np.zeros((len(y), 1))), axis=1)
    slope = np.concatenate((np.zeros((len(y), 1)), tail * (1 - tail), np.zeros((len(y), 1))), axis=1)
    row = np.arange(len(y))
    p = np.maximum(full[row, y] - full[row, y + 1], 1e-9)
    up, down = slope[row, y] / p, slope[row, y + 1] / p
    d_theta = np.zeros((len(y), k + 2))
    d_theta[row, y] -= up
    d_theta[row, y + 1] += down
    d_theta = d_theta[:, 1:-1].sum(axis=0) / len(y)
    d_weights = np.bincount(column, weights=np.repeat((up - down) / len(y), n) * value, minlength=size)
    return float(np.log(p).mean()), np.concatenate((d_weights, [d_theta.sum()], [d_theta[j:].sum() * gaps[j - 1] for j in range(1, k)]))


def train(texts: list[str | None], grades: list[int], rounds: int = 150, rate: float = 0.3, decay: float = 2e-4) -> Model:
    """Maximum likelihood of the cumulative logit model by Adam, thresholds kept in order by positive steps."""
    known = sorted(set(grades)) or [0]
    y = np.array([known.index(g) for g in grades])
    size = (1 << BITS) + 16 * TRAITS
    k = len(known) - 1
    if k < 1:
        return Model(np.zeros(size), np.zeros(0), known)
    column, value, n = features(texts)
    share = np.array([(y >= j).mean() for j in range(1, k + 1)])
    start = -np.log(share / (1 - share))
    # thresholds = first, first + exp(gaps) summed
    state = np.concatenate((np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))))
    m, v = np.zeros_like(state), np.zeros_like(state)
    for t in range(1, rounds + 1):
        gradient = likelihood(state, y, column, value, n, k + 1)[1]
        gradient[:size] -= decay * state[:size]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        state = state + rate / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        state[:size] *= 1 - 1e-3
    gaps = np.exp(np.clip(state[size + 1 :], -8, 8))
    return Model(state[:size].astype(np.float32), state[size] + np.concatenate(([0.0], np.cumsum(gaps))), known)


def rated(docs: DataFrame, ratings: DataFrame, folds: int, held_out: int, most_rows: int, most_chars: int) -> list[tuple[str | None, int]]:
    """(text, grade) of at most `most_rows` rated rows and `most_chars` characters outside the held-out fold, in hash order.

    Ids are chosen first, then lengths are read, then the rows up to the limit: a repeated doc_id counts for each row.
    """
    known = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade", F.xxhash64("doc_id", "text").alias("hash"))
    sizes = rows.select("hash", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy("hash", "doc_id").limit(most_rows).collect()
    total, keep = 0, set()
    for h, doc, n in sizes:
        if total + n <= most_chars:
            total += n
            keep.add((doc, h))
    wanted = docs.sparkSession.createDataFrame(sorted(keep), "doc_id long, hash long")
    found = rows.join(F.broadcast(wanted), ["doc_id", "hash"]).orderBy("hash", "doc_id").limit(len(sizes))
    return [(r.text, r.grade) for r in found.collect()]


def quality(
    docs: DataFrame, ratings: DataFrame, least: int, probability: float = 0.5, folds: int = 5, held_out: int = 0, most_rows: int = 4_000, most_chars: int = 12_000_000
) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability of grade `least` or more, and kept, for every row of `docs`.

    ratings: (doc_id, grade int), any number of ordered grades. The model learns from at most `most_rows` rated rows and
    `most_chars` characters outside the held-out fold (crc32 of doc_id as text mod `folds`); of several ratings of a doc_id the best counts.
    With fewer than two grades all texts get the one grade (0 without any) and are kept. Null and empty texts are scored
    by their traits alone, equal rows alike, a null doc_id stays null and counts as held out, other columns are not
    read, and an empty table gives no rows.
    """
    rows = rated(docs, ratings, folds, held_out, most_rows, most_chars)
    model = train([text for text, _ in rows], [grade for _, grade in rows])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        steps = np.diff(np.array(model.grades, dtype=float))
        at = next((i for i, g in enumerate(model.grades[1:]) if g >= least), len(model.grades) - 2)
        for part in common.rows(batches):
            tails = model.tails(part["text"])
            expected = model.grades[0] + (tails * steps).sum(axis=1)
            tail = tails[:, at] if tails.shape[1] else np.ones(len(tails))
            yield common.table(GRADED, {"doc_id": part["doc_id"], "held_out": part["held_out"], "expected_grade": expected, "tail_probability": tail, "kept": tail >= probability})

    fold: Column = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(True))
    return docs.select("doc_id", "text", fold.alias("held_out")).mapInArrow(grade, "doc_id long, held_out boolean, expected_grade double, tail_probability double, kept boolean")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good and clean; a good one of unknown toxicity has none. Kept: grade 1 or better is
    the likelier."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    ratings = common.read(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    return quality(common.read(spark, sf_dir, "documents"), ratings, least=1)
