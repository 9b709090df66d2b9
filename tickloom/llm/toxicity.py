"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are tagged clean or toxic. Only documents are labelled, so the words to learn from are labelled first: a word of a
toxic document is toxic where it, or its beginning, is met in several toxic documents and hardly in any clean one. The
field's emissions are hashed weights of a word, its beginnings and its neighbours; its transitions are learnt as well.
Shards of a bounded sample run AdaGrad on the conditional likelihood, each in one task, and their weights are averaged
between rounds. Forward and backward passes run over all words of a batch at once: texts are cut into runs, the runs'
transfer matrices are multiplied up, chained per text and expanded again, which is exact at any length. A document's score is
a calibrated function of the toxic words that its marginals expect; its spans are the words more likely toxic than not.

Nulls and edge cases: a null or blank text has no words, no spans and the lowest score of the calibration; labels that are
null or without document are not learnt from; where one class is missing every score is 0; a very long text is read whole, in a
slice of its own; equal texts have equal scores; an empty table stays empty; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.common import cut, prepare, release, slices, tidy

BITS, RUN = 18, 64
_SHIFT = np.uint64(64 - BITS)
BEGINNINGS = (4, 5, 6)
SPANS = "array<struct<start:int,end:int>>"


@dataclass
class Model:
    """Weights of hashed features (the last is the bias), log transitions from state to state, and the calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.append(np.zeros(1 << BITS), -3.0))
    moves: np.ndarray = field(default_factory=lambda: np.array([[0.0, -2.0], [0.0, -1.0]]))
    slope: float = 0.0
    offset: float = -35.0


def word_hashes(names: pa.Array) -> np.ndarray:
    """Hashes of each distinct word and of its beginnings, one row each; zero where a word is too short for one."""
    core = pc.utf8_lower(pc.utf8_trim(names, words.MARKS))
    sizes = np.asarray(pc.utf8_length(core))
    rows = [words.hashed(core, "word")]
    for k in BEGINNINGS:
        rows.append(np.where(sizes >= k, words.hashed(pc.utf8_slice_codeunits(core, 0, k), f"begins{k}"), np.uint64(0)))
    return np.array(rows).reshape(len(rows), len(names))


def emissions(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of toxic at each word, the first word of each text, and the slots of the features (6 rows)."""
    codes, starts, names = words.split(texts)
    hashes = word_hashes(names)
    own = (hashes >> _SHIFT).astype(np.int64)
    own[hashes == 0] = -1  # the slot of the bias counts once; see below
    seen = own[:, codes]
    before = np.full(len(codes), -1)
    after = np.full(len(codes), -1)
    if len(codes):
        left = ((hashes[0] * np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT).astype(np.int64)[codes]
        right = ((hashes[0] * np.uint64(0xC2B2AE3D27D4EB4F)) >> _SHIFT).astype(np.int64)[codes]
        before[1:], after[:-1] = left[:-1], right[1:]
        bounds = starts[(starts > 0) & (starts < len(codes))]
        before[bounds], after[bounds - 1] = -1, -1
    slots = np.vstack([seen, before[None], after[None]]) if len(codes) else np.zeros((6, 0), np.int64)
    values = np.where(slots >= 0, model.weights[slots], 0.0)
    return values.sum(0) + model.weights[-1], starts, slots


def log_odds_of(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and starts as from ``emissions``, with the features of a distinct word summed once and no slots kept."""
    codes, starts, names = words.split(texts)
    hashes = word_hashes(names)
    weights = model.weights
    own = np.where(hashes == 0, 0.0, weights[(hashes >> _SHIFT).astype(np.int64)]).sum(0)
    out = own[codes] + weights[-1]
    if len(codes):
        before = weights[((hashes[0] * np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT).astype(np.int64)][codes[:-1]]
        after = weights[((hashes[0] * np.uint64(0xC2B2AE3D27D4EB4F)) >> _SHIFT).astype(np.int64)][codes[1:]]
        bounds = starts[(starts > 0) & (starts < len(codes))]
        before[bounds - 1], after[bounds - 1] = 0.0, 0.0
        out[1:] += before
        out[:-1] += after
    return out, starts


def _chain(x: np.ndarray, starts: np.ndarray, m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """v1/v0 at every word, where v = (v before) m diag(1, x) and, at the first word of a text, v = first diag(1, x)."""
    n = np.diff(starts)
    runs = -(-n // RUN)
    total = int(runs.sum())
    if not total:
        return np.zeros(0)
    text_of = np.repeat(np.arange(len(n)), runs)
    base = np.cumsum(runs) - runs
    number = np.arange(total) - base[text_of]
    begin = starts[:-1][text_of] + number * RUN
    size = np.minimum(RUN, n[text_of] - number * RUN)
    opens = number == 0

    def steps():
        for k in range(RUN):
            live = size > k
            if not live.any():
                return
            at = np.where(live, begin + k, 0)
            own = opens if k == 0 else None
            yield k, live, at, np.where(live, x[at], 1.0), own

    def advance(v0, v1, y, own):
        w0, w1 = v0 * m[0, 0] + v1 * m[1, 0], v0 * m[0, 1] + v1 * m[1, 1]
        if own is not None:
            w0, w1 = np.where(own, v0, w0), np.where(own, v1, w1)
        return w0, w1 * y

    top0, top1, low0, low1 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for _, live, _, y, own in steps():
        a0, a1 = advance(top0, top1, y, own)
        b0, b1 = advance(low0, low1, y, own)
        scale = a0 + a1 + b0 + b1
        top0, top1, low0, low1 = (np.where(live, new / scale, old) for new, old in ((a0, top0), (a1, top1), (b0, low0), (b1, low1)))
    into0, into1 = np.full(total, first[0]), np.full(total, first[1])
    for k in range(1, int(runs.max())):
        here = base[runs > k] + k
        u0, u1 = into0[here - 1], into1[here - 1]
        w0, w1 = u0 * top0[here - 1] + u1 * low0[here - 1], u0 * top1[here - 1] + u1 * low1[here - 1]
        into0[here], into1[here] = w0 / (w0 + w1), w1 / (w0 + w1)
    out = np.zeros(len(x))
    v0, v1 = into0, into1
    for _, live, at, y, own in steps():
        w0, w1 = advance(v0, v1, y, own)
        scale = w0 + w1
        v0, v1 = np.where(live, w0 / scale, v0), np.where(live, w1 / scale, v1)
        out[at[live]] = v1[live] / np.maximum(v0[live], 1e-300)
    return out


def marginals(log_odds: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of toxic at every word, and the two passes' ratios (for the gradient of the transitions)."""
    x = np.exp(np.clip(log_odds, -30, 30))
    m = np.exp(moves)
    ahead = _chain(x, starts, m, np.array([m[0, 0], m[0, 1]]))
    flipped = len(x) - starts[::-1]
    behind = _chain(x[::-1], flipped, m.T, np.array([1.0, 1.0]))[::-1]
    odds = ahead * behind / x
    return odds / (1 + odds), ahead, behind


def expected_toxic(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected toxic words of each text (each by its own odds, so that doubts hardly add up), the words' marginals, and the
    first word of each text."""
    log_odds, starts = log_odds_of(texts, model)
    p, _, _ = marginals(log_odds, starts, model.moves)
    return words.totals(p * p, starts), p, starts


def document_scores(expected: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.offset + model.slope * np.log(expected + 1e-3), -35, 35)))


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Offsets of the runs of words that are more likely toxic than not."""
    found: list[dict] = []
    toxic = (p > 0.5).tolist()
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if k < len(toxic) and toxic[k]:
            if k and toxic[k - 1] and found:
                found[-1]["end"] = m.end()
            else:
                found.append({"start": m.start(), "end": m.end()})
    return found


def lexicon(learn: DataFrame, least: int = 3, purity: float = 0.9) -> np.ndarray:
    """Hashes of words and beginnings that ``least`` toxic documents hold, and clean ones at a rate of 1 - purity at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for k, text in enumerate(batch.column(0)):
                if text.is_valid:
                    _, _, names = words.split(pa.array([text.as_py()]))
                    seen = np.unique(word_hashes(names))
                    seen = seen[seen != 0].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(np.full(len(seen), batch.column(1)[k].as_py()))], names=["h", "label"])

    counts = learn.select("text", "label").mapInArrow(work, "h long, label double").groupBy("h").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    totals = learn.agg(F.sum("label"), F.count("*")).first()
    toxic, every = totals[0] or 0, totals[1]
    rate = (F.col("toxic") / F.lit(max(toxic, 1))) / (F.col("toxic") / F.lit(max(toxic, 1)) + (F.col("n") - F.col("toxic") + 0.05) / F.lit(max(every - toxic, 1)))
    often = counts.where((F.col("toxic") >= least) & (rate >= purity)).select("h").toPandas().h.to_numpy(np.int64)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for text in batch.column(0):
                codes, _, names = words.split(pa.array([text.as_py()]))
                if len(codes):
                    hashes = word_hashes(names).view(np.int64)
                    left = np.concatenate([[0], hashes[0][codes[:-1]]])
                    kind, at = np.nonzero(np.isin(hashes, often)[:, codes])
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[kind, codes[at]]), pa.array(left[at])], names=["h", "before"])

    # Words that near copies of one toxic text share stand behind the same word each time; insults do not.
    around = learn.where("label > 0").select("text").mapInArrow(contexts, "h long, before long")
    varied = around.groupBy("h").agg(F.countDistinct("before").alias("n")).where(F.col("n") >= least)
    return varied.select("h").toPandas().h.to_numpy(np.int64)


def train_shard(texts: pa.Array, labels: np.ndarray, known: np.ndarray, model: Model, seed: int, rate: float = 0.5, batch: int = 32) -> Model:
    """The model after one AdaGrad pass over the shard, in a seeded order."""
    weights, moves = model.weights.copy(), model.moves.copy()
    squares, move_squares = np.full(len(weights), 1e-2), np.full((2, 2), 1e-2)
    order = np.random.default_rng(seed).permutation(len(texts))
    for k in range(0, len(order), batch):
        pick = order[k : k + batch]
        part, toxic = texts.take(pa.array(pick)), labels[pick]
        codes, starts, names = words.split(part)
        if not len(codes):
            continue
        marked = np.isin(word_hashes(names).view(np.int64), known).any(0)[codes]
        y = (marked & (np.repeat(toxic, np.diff(starts)) > 0)).astype(float)
        log_odds, starts, slots = emissions(part, Model(weights, moves))
        p, ahead, behind = marginals(log_odds, starts, moves)
        gap = p - y
        g = np.bincount(np.where(slots >= 0, slots, len(weights) - 1).ravel(), weights=np.where(slots >= 0, gap, 0.0).ravel(), minlength=len(weights))
        g[-1] += gap.sum()
        g /= len(pick)
        at = np.flatnonzero(g)
        squares[at] += g[at] ** 2
        weights[at] -= rate * g[at] / np.sqrt(squares[at]) * 0.5
        inner = np.ones(len(codes), bool)
        inner[starts[:-1][np.diff(starts) > 0]] = False
        two = np.flatnonzero(inner)
        m = np.exp(moves)
        joint = np.array([[m[0, 0] * np.ones(len(two)), m[0, 1] * behind[two]], [ahead[two - 1] * m[1, 0], ahead[two - 1] * m[1, 1] * behind[two]]])
        joint /= joint.sum((0, 1))
        now, past = y[two].astype(int), y[two - 1].astype(int)
        held = np.array([[((past == a) & (now == b)).sum() for b in (0, 1)] for a in (0, 1)])
        move_g = (joint.sum(2) - held) / len(pick)
        move_squares += move_g**2
        moves -= 0.1 * move_g / np.sqrt(move_squares)
    return Model(weights, moves - moves[0, 0])


def fit(learn: DataFrame, shards: int = 8, rounds: int = 3, seed: int = 13, shard_rows: int = 1500) -> Model:
    """A model from (id, text, label) rows of a bounded sample; small samples take fewer than ``shards`` shards."""
    spark = learn.sparkSession
    prepare(spark)
    learn = cut(learn.where("text is not null"), "labelled")
    model = Model()
    known = lexicon(learn)
    if not len(known):
        return model
    shards = min(shards, -(-learn.count() // shard_rows))
    dealt = learn.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((model, known))

        def work(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("id", "ascending")])
            now, marks = shared.value
            found = train_shard(rows["text"].combine_chunks(), rows["label"].to_numpy(), marks, now, seed * 1000 + 100 * k + key[0].as_py())
            release()
            flat = np.concatenate([found.weights, found.moves.ravel()])
            at = np.flatnonzero(flat)
            return pa.table({"slot": at, "weight": flat[at]})

        parts = dealt.groupBy("shard").applyInArrow(work, "slot long, weight double")
        mean = parts.groupBy("slot").agg((F.sum("weight") / F.lit(shards)).alias("weight")).toPandas()
        flat = np.zeros(len(model.weights) + 4)
        flat[mean.slot.to_numpy(np.int64)] = mean.weight.to_numpy()
        model = Model(flat[:-4], flat[-4:].reshape(2, 2))
        shared.unpersist()
    shared = spark.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            found = [expected_toxic(part, shared.value)[0] for part in slices(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.float64()), batch.column(1)], names=["expected", "label"])

    seen = learn.select("text", "label").mapInArrow(expect, "expected double, label double").toPandas()
    model.slope, model.offset = calibrate(seen)
    return model


def calibrate(seen: pd.DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the log of the expected toxic words, by damped Newton steps."""
    x = np.column_stack([np.log(seen.expected.to_numpy() + 1e-3), np.ones(len(seen))])
    y = seen.label.to_numpy()
    w = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(2)
        w -= 0.7 * np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity in column ``out``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            found = [document_scores(expected_toxic(part, shared.value)[0], shared.value) for part in slices(batch)]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    return docs.withColumn(out, of.asNondeterministic()(F.col(text)))


def tag(docs: DataFrame, model: Model, text: str = "text", out: str = "toxic_spans") -> DataFrame:
    """``docs`` with the offending offsets (in characters) in column ``out``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SPANS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in tidy(batches):
            rows: list = []
            for part in slices(batch):
                _, p, starts = expected_toxic(part, shared.value)
                for value, a, b in zip(part, starts[:-1].tolist(), starts[1:].tolist()):
                    rows.append(spans_of(value.as_py(), p[a:b]) if b > a and p[a:b].max() > 0.5 else [])
            yield pa.array(rows, kind)

    return docs.withColumn(out, of.asNondeterministic()(F.col(text)))
