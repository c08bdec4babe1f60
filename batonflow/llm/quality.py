"""Quality scores by positive-unlabelled learning.

Trusted positives are labelled texts of good quality, the unlabelled are texts of
the corpus as it comes. A logistic scorer minimises the non-negative unbiased
risk: the positives' risk times the class prior, plus the unlabelled texts' risk of
being called positive less the positives' share of it, which is held at zero from
below. The class prior is estimated from the tails of both. Means, scales, tails and
every step of the descent are sums over all documents, one pass each over a staged
table of features; of labelled texts a bounded sample is on the driver.

Features are of the text alone: shares of byte classes and of pairs of them, and
how words and lines repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from batonflow.llm.text import bounds, in_batches, slices, word_hashes
from batonflow.staging import stage

#: Bound of the sample of trusted positives, the ones least by hash. Unlabelled texts are all documents.
MOST_POSITIVE = 6_000
#: Steps of the descent, each over all documents, and of the two that the class prior is estimated from; its rate and penalty.
#: Chosen on five folds of the labels that are not held out.
STEPS, PRIOR_STEPS, RATE, DECAY = 30, 15, 0.05, 1e-3
#: Positives and texts that each half must have for a class prior to be estimated; with fewer nothing is learnt.
LEAST = 20
#: Groups that sums of tasks are added up in, before the driver adds these.
GROUPS, MOST_TASKS = 16, 64
THRESHOLD = 0.3

# Byte classes: space, newline, lower, upper, digit, end of sentence, other ordinary marks, !, |, other ASCII signs, UTF-8.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 0, 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[[ord(c) for c in ".?"]], _CLASS[[ord(c) for c in ",;:'\"()-"]] = 5, 6
_CLASS[ord("!")], _CLASS[ord("|")], _CLASS[128:] = 7, 8, 10
_N = 11
FEATURES = _N * _N + _N + 14


def features(data: np.ndarray) -> np.ndarray:
    """Of one text's bytes; an empty text has zeros."""
    out = np.zeros(FEATURES, np.float32)
    if not len(data):
        return out
    kind = _CLASS[data]
    shares = np.bincount(kind, minlength=_N) / len(data)
    out[:_N] = np.sqrt(shares)
    if len(data) > 1:
        pairs = np.bincount(kind[:-1].astype(np.int64) * _N + kind[1:], minlength=_N * _N) / (len(data) - 1)
        out[_N : _N + _N * _N] = np.sqrt(pairs)
    starts, ends = bounds(data)
    own = out[_N + _N * _N :]
    own[0] = np.log1p(len(data)) / 10
    n = len(starts)
    if n:
        words = word_hashes(data, starts, ends)
        long = ends - starts
        _, times = np.unique(words, return_counts=True)
        first, last = kind[starts], kind[ends - 1]
        own[1:8] = np.log1p(n) / 8, long.mean() / 10, long.std() / 10, len(times) / n, times.max() / n, np.sqrt(np.sum((times / n) ** 2)), (first == 3).mean()
        own[8] = (last == 5).mean()
        own[9] = (last >= 7).mean() - (last == 10).mean()
        own[10] = (words[1:] == words[:-1]).mean() if n > 1 else 0
        own[11] = (words[16:] == words[:-16]).mean() if n > 16 else 0
        both = words[1:] ^ (words[:-1] * np.uint64(3))
        own[12] = len(np.unique(both)) / max(1, n - 1)
        # Stretches of shouting or signs inside an otherwise clean text: the worst tenth.
        odd = (first == 3) & (last != 2) & (last != 10) | (last >= 7) & (last != 10)
        tenth = np.array_split(odd, min(10, n))
        own[13] = max(x.mean() for x in tenth)
    return out


def _columns(batches):
    for batch in batches:
        found = [features(x).tobytes() for x in slices(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], names=["doc_id", "features"])


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of features."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float32).reshape(-1, FEATURES)


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def estimate_prior(p: np.ndarray, u: np.ndarray, n_p: float, n_u: float) -> float:
    """The class prior from held-out scores: the least ratio of tail shares, of unlabelled texts `u` and of positives `p`.

    In a pure top bin, the unlabelled texts' share is the prior times the positives'
    share; anywhere else it is more. The confidence margin keeps small bins out.
    """
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    best = int(((u + margin) / p).argmin())
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


#: A sum over all unlabelled texts: of part(their features, which half each is in).
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    # Without BLAS, as this also runs on the driver, where its threads may block.
    return 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", x, w[:-1]) + w[-1], -60, 60)))


def _pull(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of texts as negatives: their number, loss and gradient, summed; the last component is the bias's."""
    g = _logistic(x, w)
    return np.concatenate([[len(x), -np.log1p(-np.minimum(g, 1 - 1e-9)).sum()], np.einsum("ij,i->j", x, g), [g.sum()]])


def _descend(positives: list[np.ndarray], sides: list[bool | None], prior: float, steps: int, scaled, total: Total) -> list[np.ndarray]:
    """Weights that minimise the non-negative risk, logistic loss, by Adam on its whole gradient; several descents share each pass.

    `sides`: the half of the unlabelled texts that each is of, null for all.
    """
    d = positives[0].shape[1] + 1
    w, m, v = ([np.zeros(d) for _ in sides] for _ in range(3))
    for t in range(1, steps + 1):
        now = list(w)

        def part(x, half, now=now):
            z = scaled(x)
            return np.concatenate([_pull(z if side is None else z[half == side], own) for side, own in zip(sides, now, strict=True)])

        sums = total(part).reshape(len(sides), -1)
        for i, xp in enumerate(positives):
            own, n = _pull(xp, w[i]), max(1.0, sums[i][0])
            # Negative part: unlabelled as negative, less the positives' share of that.
            negative = sums[i][1:] / n - prior * own[1:] / len(xp)
            as_positive = prior * (own[2:] - np.append(xp.sum(axis=0), len(xp))) / len(xp)
            grad = (as_positive + negative[1:] if negative[0] >= 0 else -negative[1:]) + DECAY * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.99 * v[i] + 0.01 * grad * grad
            rate = RATE * 0.5 * (1 + np.cos(np.pi * (t - 1) / steps))
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return w


def _fit(xp: np.ndarray, half_p: np.ndarray, total: Total) -> Scorer:
    """From positives, which half each is in, and sums over all unlabelled texts."""
    d = FEATURES
    sums = total(lambda x, half: np.concatenate([[len(x), half.sum()], x.sum(axis=0, dtype=np.float64), np.square(x, dtype=np.float64).sum(axis=0)]))
    n = sums[0]
    if min(half_p.sum(), (~half_p).sum(), sums[1], n - sums[1]) < LEAST:
        return Scorer(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 0.5)
    mean = sums[2 : d + 2] / n
    scale = np.sqrt(np.maximum(sums[d + 2 :] / n - mean**2, 0)) + 1e-3
    scaled = lambda x: np.clip((x - mean) / scale, -8, 8)
    xp = scaled(xp)
    # Prior: a scorer of each half, tails of all texts of the other one; the mean of both.
    sides = [True, False]
    halves = [xp[half_p == side] for side in sides]
    w = _descend(halves, sides, 0.5, PRIOR_STEPS, scaled, total)
    level = lambda x, own: np.einsum("ij,j->i", x, own[:-1]) + own[-1]
    at = [level(halves[1 - i], w[i]) for i in range(2)]
    grids = [np.quantile(x, np.linspace(0, 0.9, 60)) for x in at]

    def above(x, half):
        z = scaled(x)
        return np.concatenate([[*(level(z[half != side], own) >= grid[:, None]).sum(axis=1), (half != side).sum()] for side, own, grid in zip(sides, w, grids, strict=True)])

    tails = total(above).reshape(2, -1)
    found = [estimate_prior((at[i] >= grids[i][:, None]).mean(axis=1), tails[i][:-1] / tails[i][-1], len(at[i]), tails[i][-1]) for i in range(2)]
    prior = float(np.mean(found))
    weight = _descend([xp], [None], prior, STEPS, scaled, total)[0]
    return Scorer(mean, scale, weight[:-1], float(weight[-1]), prior)


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> Scorer:
    """From features in memory. With fewer than LEAST positives or texts in a half the scorer says 0.5 everywhere."""
    rng = np.random.default_rng(seed)
    cut_p, cut_u = rng.random(len(positive)) < 0.5, rng.random(len(unlabelled)) < 0.5
    return _fit(positive, cut_p, lambda part: part(unlabelled, cut_u))


def held_out(key) -> "F.Column":
    """Rows whose label is never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0, F.lit(False))


def featured(docs: DataFrame) -> DataFrame:
    """A staged table of (doc_id, features), one row for each row of `docs`."""
    made = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_columns, "doc_id long, features binary")
    return stage(made, "features")


def _summed(rows: DataFrame, part, half=None, tasks: int | None = None) -> np.ndarray:
    """The sum of part(features) over all rows: batches in a task, tasks in GROUPS, groups on the driver; the same order each time.

    With a column `half` it is of part(features, half). Where `rows` are known to be few
    `tasks`, up to MOST_TASKS, the driver adds these without groups.
    """
    of = (lambda x, h: part(x)) if half is None else part
    none = np.empty((0, FEATURES), np.float32), np.empty(0, bool)

    def of_task(batches):
        found = of(*none)
        for batch in batches:
            found = found + of(_matrix(batch["features"]), batch["half"].to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([found.astype(np.float64).tobytes()], pa.binary())], names=["task", "sums"])

    def of_group(batches):
        found, first = 0.0, None
        for batch in batches:
            for task, sums in zip(batch["task"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                first, found = task if first is None else first, found + np.frombuffer(sums)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["task", "sums"])

    schema = "task int, sums binary"
    found = rows.select("features", (F.lit(False) if half is None else half).alias("half")).mapInArrow(of_task, schema)
    if tasks is None or tasks > MOST_TASKS:
        found = found.repartition(GROUPS, "task").sortWithinPartitions("task").mapInArrow(of_group, schema)
    groups = found.collect()
    found = of(*none).astype(np.float64)
    for row in sorted(groups, key=lambda r: r.task):
        found = found + np.frombuffer(row.sums)
    return found


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE) -> Scorer:
    """Fitted on the documents as unlabelled texts, and on positives among them (quality 1, not held out)."""
    return train_on(featured(docs), labels, most_positive)


def train_on(rows: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE) -> Scorer:
    """As train(), from a table of featured(). Of the rows of one sampled id the one with the least features is taken.

    Positives are sampled among the labelled ids that are there, the ones least by hash:
    the same whatever the partitions.
    """
    # Halves are told by the id, so that a positive and its own unlabelled row are in the same one.
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == 1
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    good = good.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most_positive)
    # At most most_positive ids are broadcast, and as many rows of features come to the driver.
    picked = rows.join(F.broadcast(good), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features")).withColumn("half", half).toPandas()
    picked = picked.sort_values("doc_id", ignore_index=True)
    x = np.frombuffer(b"".join(picked["features"]), np.float32).reshape(-1, FEATURES)
    tasks = rows.rdd.getNumPartitions()  # of the plan alone: nothing is run
    return _fit(x, picked["half"].to_numpy(bool), lambda part: _summed(rows, part, F.coalesce(half, F.lit(False)), tasks))


def _scored(docs: DataFrame, scorer: Scorer, column: str, of: Callable, given: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def scores(values: pd.Series) -> pd.Series:
        x = np.empty((len(values), FEATURES), np.float32)
        for i, value in enumerate(values):
            x[i] = of(value)
        return pd.Series(shared.value(x))

    return docs.withColumn(column, scores(F.col(given)))


def score(docs: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of `text` in `column` (replaced if it exists). Null text is read as empty."""
    return _scored(in_batches(docs), scorer, column, lambda text: features(np.frombuffer((text or "").encode(), np.uint8)), "text")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted.

    Labels only say which texts are trusted; a score is a function of the text.
    Null and empty texts get the score of no text. Repeated rows get equal scores,
    a null id is never held out. Empty tables give an empty result. Labels of
    documents that aren't there are passed over. With fewer than LEAST positives or
    texts in either half of the table, which the class prior is estimated from, the
    score is 0.5 everywhere.
    """
    rows = featured(docs)
    scored = _scored(rows, train_on(rows, labels), "score", lambda kept: np.frombuffer(kept, np.float32), "features")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
