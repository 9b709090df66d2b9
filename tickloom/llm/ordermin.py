"""Order MinHash: fingerprints of whole texts whose likeness follows edit distance, and each document against its neighbour.

A text's k-mers are its runs of ``length`` code points, each with a number that tells how many equal ones came before it. Of
each of ``slots`` permutations of all numbered k-mers the ``each`` smallest are taken, put back in the order in which they
stand in the text, and hashed as one tuple. Two texts' likeness is the share of slots with equal hashes: a slot agrees if
both texts hold the same chosen k-mers in the same order, so moved passages count as well as changed ones.

A permutation multiplies a 32-bit hash of the numbered k-mer by an odd number. Its smallest values are sought below a bound
under which some ``EXPECTED`` are likely, and among all values where these are fewer than ``each``; which is done does not
change what is found.

Documents are range-partitioned by descending doc_id, and a task follows its documents in order, holding one document and
the one after it. The last document of a task meets the first one of the next task (the last of all: the first of all) in a
join of one row a task. So no task or group holds more than a batch of texts.

Nulls and edge cases: a null text is empty; the empty text has no k-mer, and a text shorter than ``length`` is one k-mer by itself;
with fewer than ``each`` k-mers a slot hashes all there are; null doc_ids come last; rows that repeat a doc_id are documents of their
own, in the order of a hash of their texts; a single document is its own next one; a very long text is taken whole, with some
60 bytes of memory a code point; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, prepare, tidy

#: Values below the bound that are expected in each permutation, and places of a text that are permuted at once.
EXPECTED, AT_ONCE = 16, 8192
_BASE, _STEP = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sketch:
    """slots: tuples of a fingerprint. each: k-mers of a tuple. length: code points of a k-mer."""

    slots: int = 64
    each: int = 2
    length: int = 5
    seed: int = 7

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2**31, self.slots, np.uint32) * np.uint32(2) + np.uint32(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value, its bits well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered_kmers(points: np.ndarray, length: int) -> np.ndarray:
    """A hash of each k-mer of the code points together with its number, in the order of the text."""
    n = max(len(points) - length + 1, min(len(points), 1))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(min(length, len(points))):
        h = h * _BASE + points[j : j + n]
    h = mixed(h)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    # The place in the low bits makes every key another one, and equal k-mers stand in the order of the text.
    keys = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
    fresh = np.ones(n, bool)
    fresh[1:] = (keys[1:] >> bits) != (keys[:-1] >> bits)
    number = np.empty(n, np.uint64)
    first = np.flatnonzero(fresh)
    number[(keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return mixed(h + number * _STEP)


def smallest(short: np.ndarray, multipliers: np.ndarray, each: int) -> np.ndarray:
    """Places of the ``each`` smallest values of each permutation, (slots, each), in the order of the text; the earlier place first among equals."""
    n, slots = len(short), len(multipliers)
    each = min(each, n)
    bound = 2**32 - 1 if n <= 4 * EXPECTED else int(2**32 * EXPECTED / n)
    slot, place, value = [], [], []
    for a in range(0, n, AT_ONCE):
        part = multipliers[:, None] * short[None, a : a + AT_ONCE]
        found = np.flatnonzero(part.ravel() <= np.uint32(bound))
        slot.append(found // part.shape[1])
        place.append(found % part.shape[1] + a)
        value.append(part.ravel()[found])
    slot, place, value = (np.concatenate(x) for x in (slot, place, value))
    order = np.argsort(slot.astype(np.uint64) << np.uint64(32) | value, kind="stable")
    counts = np.bincount(slot, minlength=slots)
    firsts = np.cumsum(counts) - counts
    if counts.min() >= each:
        return np.sort(place[order][firsts[:, None] + np.arange(each)], axis=1)
    out = np.empty((slots, each), np.int64)
    for s in range(slots):
        if counts[s] >= each:
            out[s] = place[order[firsts[s] : firsts[s] + each]]
        else:
            out[s] = np.argsort(multipliers[s] * short, kind="stable")[:each]
    return np.sort(out, axis=1)


def fingerprint(text: str, sketch: Sketch, multipliers: np.ndarray) -> np.ndarray:
    """The hashes of the text's tuples, 32 bits each."""
    kmers = numbered_kmers(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), sketch.length)
    if not len(kmers):
        return np.zeros(sketch.slots, np.uint32)
    chosen = kmers[smallest((kmers >> np.uint64(32)).astype(np.uint32), multipliers, sketch.each)]
    total = np.zeros(sketch.slots, np.uint64)
    for j in range(chosen.shape[1]):
        total = mixed(total * _BASE + chosen[:, j])
    return (total >> np.uint64(32)).astype(np.uint32)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float((one == other).mean())


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many of the one that follows."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [part.split()[0] for part in _FIELDS.split(", ")] + ["part", "role", "text"]
#: What a row of the first pass is: a document's result, the first document of its task, or the last one, whose next is in another task.
DONE, HEAD, TAIL = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=_NAMES)


def compared(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and its likeness to the edited text and to the next document."""
    prepare(docs.sparkSession)

    def result(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray, multipliers: np.ndarray) -> tuple:
        changed = edited(text, following)
        after = own if changed == text else fingerprint(changed, sketch, multipliers)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        return doc_id, len(text), digest, own.astype(">u4").tobytes(), after.astype(">u4").tobytes(), likeness(own, after), likeness(own, other)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, part, last = sketch.multipliers(), TaskContext.get().partitionId(), None
        for batch in tidy(batches):
            rows = []
            for doc_id, content in zip(batch.column(0), batch.column(1)):
                text = content.as_py() or ""
                own = fingerprint(text, sketch, multipliers)
                if last is None:
                    rows.append((None, None, None, own.astype(">u4").tobytes(), None, None, None, part, HEAD, text))
                else:
                    rows.append((*result(*last, text, own, multipliers), part, DONE, None))
                last = doc_id.as_py(), text, own
            if rows:
                yield _batch(rows)
        if last is not None:
            yield _batch([(last[0], len(last[1]), None, last[2].astype(">u4").tobytes(), None, None, None, part, TAIL, last[1])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = sketch.multipliers()
        for batch in tidy(batches):
            rows = []
            for doc_id, text, own, following, other in zip(*(column.to_pylist() for column in batch.columns)):
                own, other = (np.frombuffer(x, ">u4").astype(np.uint32) for x in (own, other))
                rows.append((*result(doc_id, text, own, following, other, multipliers), 0, DONE, None))
            if rows:
                yield _batch(rows)

    every = f"{_FIELDS}, part int, role int, text string"
    # Of rows that share a doc_id, or have none, a hash of the text says the order, and over which tasks they are spread.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(F.desc("doc_id"), "h").sortWithinPartitions(F.desc("doc_id"), "h", "text").select("doc_id", "text")
    found = cut(ordered.mapInArrow(work, every), "order-minhash")
    heads = found.where(F.col("role") == HEAD).select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # One row a task meets in this window.
    line = Window.orderBy("after")
    chain = heads.select("after").select(F.col("after").alias("part"), F.coalesce(F.lead("after").over(line), F.min("after").over(Window.partitionBy())).alias("after"))
    tails = found.where(F.col("role") == TAIL).select("part", "doc_id", "text", "fingerprint").join(chain, "part").join(heads, "after")
    closed = tails.select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(finish, every)
    return found.where(F.col("role") == DONE).unionByName(closed).drop("part", "role", "text")
