"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Features of a text are its words, the marks that end them with the word's letter case, and pairs of neighbouring words (one
feature for any word that follows itself), hashed into 2**BITS weights; each counts its occurrences over the square root of the number of words. Training takes a
bounded sample of labelled documents (``most``, in the order of a hash of the id), deals it into a fixed number of
shards that each run FTRL-proximal updates in one task, and averages the shards' weights between rounds, so neither a
task nor the driver ever holds more than the bounded sample and the bounded weights.

Nulls and edge cases: a null or blank text has no features and scores the bias; labels that are null or have no document
are not learnt from; without any labels every score is 0.5; a very long text is read whole, in a slice of its own; equal texts
have equal scores; an empty table stays empty; other columns of the input are kept by ``score`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.common import cut, prepare, release, slices, tidy

BITS = 18
_SHIFT = np.uint64(64 - BITS)
_REPEATED = np.uint64(1)


def _per_word(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct word: the slots of its letters and of its end marks, and a hash for pairs."""
    core = pc.utf8_rtrim(names, words.MARKS)
    sizes = np.asarray(pc.utf8_length(core))
    shape = np.where(np.asarray(pc.utf8_is_upper(core)) & (sizes > 1), "U", np.where(np.asarray(pc.utf8_is_title(core)), "T", "L"))
    shape = np.where(sizes == 0, "M", shape).tolist()
    marks = pa.array([c + n[k:] for c, n, k in zip(shape, names.to_pylist(), sizes.tolist())], pa.large_string())
    h = words.hashed(pc.utf8_lower(core), "word")
    return h >> _SHIFT, words.hashed(marks, "mark") >> _SHIFT, words.hashed(marks, "pair") ^ h


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, starts, and the slots: per distinct word its two, per word position that of the pair with the word before."""
    codes, starts, names = words.split(texts)
    own, mark, pair = _per_word(names)
    h = pair[codes]
    pairs = np.zeros(len(codes), np.uint64)
    pairs[1:] = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> _SHIFT
    # A word after itself is one n-gram, whatever the word.
    pairs[1:][codes[1:] == codes[:-1]] = _REPEATED
    firsts = starts[:-1][starts[:-1] < starts[1:]]
    pairs[firsts] = (h[firsts] * np.uint64(0xC2B2AE3D27D4EB4F)) >> _SHIFT
    return codes, starts, own.astype(np.int64), mark.astype(np.int64), pairs.astype(np.int64)


def raw_scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of each text: the sparse dot product of its features and the weights."""
    codes, starts, own, mark, pairs = features(texts)
    per_word = weights[own] + weights[mark]
    n = np.maximum(np.diff(starts), 1)
    return bias + words.totals(per_word[codes] + weights[pairs], starts) / np.sqrt(n)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last slot is the bias."""

    def __init__(self, weights: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.n = np.where(weights != 0, 1.0, 0.0)
        # z such that the closed form gives the weights back
        self.z = -weights * ((beta + np.sqrt(self.n)) / alpha + l2) - np.sign(weights) * l1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


def train_shard(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, seed: int) -> np.ndarray:
    """Weights after one pass over the shard's documents in a seeded order."""
    learner = Ftrl(weights)
    rows = []
    for k, part in enumerate(slices(texts)):
        codes, starts, own, mark, pairs = features(part)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            at, count = np.unique(np.concatenate([own[codes[a:b]], mark[codes[a:b]], pairs[a:b]]), return_counts=True)
            rows.append((np.append(at, len(weights) - 1), np.append(count / np.sqrt(max(b - a, 1)), 1.0)))
    for i in np.random.default_rng(seed).permutation(len(rows)):
        learner.update(*rows[i], labels[i])
    return learner.weights(np.arange(len(weights)))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of at most ``most`` labelled documents, by a hash of the id; the sample is small by its bound."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")


def fit(learn: DataFrame, shards: int = 8, rounds: int = 3, seed: int = 11, shard_rows: int = 200) -> np.ndarray:
    """Weights and, last, the bias, from the rows of ``sample``; small samples take fewer than ``shards`` shards.

    In each round every shard is passed over once from the weights of the round before, and the shards' weights are averaged; the
    learner's sums of squared gradients start afresh with each round.
    """
    spark = learn.sparkSession
    prepare(spark)
    learn = cut(learn, "labelled")
    shards = max(1, min(shards, -(-learn.count() // shard_rows)))
    dealt = learn.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    weights = np.zeros((1 << BITS) + 1)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def work(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("id", "ascending")])
            found = train_shard(rows["text"].combine_chunks(), rows["label"].to_numpy(), shared.value, seed * 1000 + k * 100 + key[0].as_py())
            release()
            at = np.flatnonzero(found)
            return pa.table({"slot": at, "weight": found[at]})

        parts = dealt.groupBy("shard").applyInArrow(work, "slot long, weight double")
        mean = parts.groupBy("slot").agg((F.sum("weight") / F.lit(shards)).alias("weight")).toPandas()
        weights = np.zeros_like(weights)
        weights[mean.slot.to_numpy(np.int64)] = mean.weight.to_numpy()
        shared.unpersist()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``out``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shared.value
        for batch in tidy(batches):
            found = [raw_scores(part, held[:-1], held[-1]) for part in slices(batch)]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(found), -35, 35))) if found else [], pa.float64())

    return docs.withColumn(out, of.asNondeterministic()(F.col(text)))
