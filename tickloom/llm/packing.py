"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most ``capacity`` ids; a piece of exactly that length is a sequence of its own. The
others are dealt evenly into instances of bounded size, whatever their documents' keys are. Each instance is evolved on
several islands: a first generation of the best fit in falling order, which often reaches the bound of the total length, and best
fits in random orders; where the bound is missed, crossovers inject whole well-filled bins of one parent into another, remove
the bins that hold the injected documents a second time and best-fit what that displaced, until no packing can have fewer bins
or the generations are over.
Between epochs the elite of each island migrates to the next one; every epoch is a Spark job over (instance, island)
groups. Bins that stay badly filled are dissolved and dealt anew into fewer instances, until one instance is left.

Nulls and edge cases: a null or empty text is a document of the end id alone; a null doc_id is carried along; repeated
rows are packed each for itself; a very long text is encoded whole, in a slice of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.store import dealt
from tickloom.llm import tokens
from tickloom.llm.common import cut, prepare, slices, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut only where they exceed ``capacity``."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in tidy(batches, keep=vocabulary):
            at = 0
            for part in slices(batch.column(1), tokens.SLICE_BYTES):
                doc_ids = batch.column(0).slice(at, len(part)).to_pylist()
                at += len(part)
                ids, counts = encoder.encode(part)
                rows: list[tuple] = []
                stop = 0
                for doc_id, n in zip(doc_ids, counts.tolist()):
                    own = np.append(ids[stop : stop + n], end_id)
                    stop += n
                    for k, start in enumerate(range(0, len(own), capacity)):
                        held = own[start : start + capacity]
                        rows.append((doc_id, k, start, len(held), tokens.crc(held)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES)


class Bins:
    """Free space of open bins, with the tightest bin that takes a piece found in constant time."""

    def __init__(self, capacity: int):
        self.capacity, self.by_free, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def put(self, bin_id: int, free: int) -> None:
        self.by_free[free].append(bin_id)
        self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least free space of at least ``size``, and that space; it leaves the pool."""
        fits = self.mask >> size
        if not fits:
            return None
        free = size + (fits & -fits).bit_length() - 1
        held = self.by_free[free]
        found = held.pop()
        if not held:
            self.mask ^= 1 << free
        return found, free


def best_fit(lengths: np.ndarray, order: np.ndarray, packed: np.ndarray, capacity: int) -> np.ndarray:
    """Complete a packing (bin of each piece, -1 where none) by best fit in the given order of the loose pieces."""
    packed = packed.copy()
    held = packed >= 0
    names, packed[held] = np.unique(packed[held], return_inverse=True)
    fill = np.bincount(packed[held], weights=lengths[held], minlength=len(names)).astype(np.int64)
    pool, opened = Bins(capacity), len(names)
    for b, f in enumerate(fill.tolist()):
        if f < capacity:
            pool.put(b, capacity - f)
    sizes = lengths.tolist()
    for i in order.tolist():
        size = sizes[i]
        found = pool.take(size)
        if found is None:
            found, opened = (opened, capacity), opened + 1
        packed[i] = found[0]
        if found[1] > size:
            pool.put(found[0], found[1] - size)
    return packed


def quality(lengths: np.ndarray, packed: np.ndarray, capacity: int) -> tuple[int, float]:
    """To be maximised: fewer bins first, then fuller ones."""
    fill = np.bincount(packed, weights=lengths)
    return -len(fill), float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """A child of ``a`` that takes over whole bins of ``b``, the well-filled ones likeliest.

    Bins of ``a`` that hold an injected piece a second time go, and so do those filled worse than a share drawn each time; what
    both displace is best-fitted, the longest first.
    """
    fill = np.bincount(b, weights=lengths)
    chance = (fill / capacity) ** 32 * rng.uniform(0.3, 0.9)
    moved = (np.random.default_rng(rng.getrandbits(32)).random(len(fill)) < chance)[b]
    gone = np.bincount(a, weights=lengths) < capacity * rng.uniform(0.97, 1.0)
    gone[a[moved]] = True
    child = np.where(moved, a.max() + 1 + b, np.where(gone[a], -1, a))
    loose = np.flatnonzero(child < 0)
    return best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], child, capacity)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int = 4, generations: int = 12) -> tuple[np.ndarray, int]:
    """The best packing that crossovers breed from ``elites`` and from best fits of the pieces in falling and in random orders, and the number of crossovers.

    Stops at the bound of the total length.
    """
    rng = random.Random(seed)
    least = -(-int(lengths.sum()) // capacity)
    loose = np.full(len(lengths), -1)
    people = [*elites, best_fit(lengths, np.argsort(-lengths, kind="stable"), loose, capacity)]
    done = any(p.max(initial=-1) + 1 <= least for p in people)
    while len(people) < population and not done:
        order = np.random.default_rng(rng.getrandbits(32)).permutation(len(lengths))
        people.append(best_fit(lengths, order, loose, capacity))
    scored = sorted(((quality(lengths, p, capacity), -k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    bred = 0
    while bred < generations and len(scored) > 1 and -scored[0][0][0] > least:
        i, j = sorted(rng.sample(range(len(scored)), 2))
        child = crossover(lengths, scored[i][2], scored[j][2], capacity, rng)
        bred += 1
        scored = sorted([*scored, (quality(lengths, child, capacity), -population - bred, child)], key=lambda x: x[:2], reverse=True)[:population]
    return scored[0][2], bred


_STATE = "rid long, length long, instance long, island int, bin long, bins long, fullness double, crossovers int"


def _epoch(items: DataFrame, capacity: int, seed: int, epoch: int) -> DataFrame:
    """One epoch of every (instance, island) group; ``items`` has the elites' bins under their source in ``origin``."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["origin", "rid"], kind="stable")
        own = rows[rows.origin == rows.origin.min()]
        lengths = own.length.to_numpy(np.int64)
        elites = []
        for _, each in rows[rows.origin >= 0].groupby("origin"):
            elites.append(np.unique(each.bin.to_numpy(), return_inverse=True)[1])
        packed, bred = evolve(lengths, elites, capacity, seed=seed * 7919 + int(key[0]) * 31 + int(key[1]) * 7 + epoch)
        bins, fullness = quality(lengths, packed, capacity)
        return pd.DataFrame({"rid": own.rid.to_numpy(), "length": lengths, "instance": key[0], "island": key[1], "bin": packed, "bins": -bins, "fullness": fullness, "crossovers": bred})

    return dealt(items, "instance", "island", each=1).groupBy("instance", "island").applyInPandas(work, _STATE)


def pack_instances(items: DataFrame, count: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(rid, length, instance, bin): the packing of each of ``count`` instances by its best island; crossovers, those of its last epoch."""
    spread = items.select("rid", "length", F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(count)).alias("instance"))
    state = spread.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).withColumn("bin", F.lit(-1).cast("long")).withColumn("origin", F.lit(-1))
    for epoch in range(epochs):
        grown = cut(_epoch(state, capacity, seed, epoch), "islands")
        stay = grown.select("rid", "length", "instance", "island", "bin", F.lit(0).alias("origin"))
        guests = grown.select("rid", "length", "instance", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "bin", F.lit(1).alias("origin"))
        state = stay.unionByName(guests) if islands > 1 else stay
    best = grown.groupBy("instance").agg(F.min(F.struct("bins", -F.col("fullness"), "island")).alias("best")).select("instance", F.col("best.island").alias("island"))
    return grown.join(best, ["instance", "island"], "left_semi").select("rid", "length", "instance", "bin", "crossovers")


def pack(cut_pieces: DataFrame, capacity: int = 4096, each: int = 4096, islands: int = 2, epochs: int = 2, seed: int = 17, full_enough: float = 0.985) -> DataFrame:
    """``cut_pieces`` (from ``pieces``) with sequence_id and offset; sequences of at most ``capacity`` ids, without gaps.

    each: pieces of an instance. full_enough: bins below that share are dissolved and packed again across instances.
    """
    rows = cut(cut_pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    whole = rows.where(F.col("length") >= capacity).select("rid", F.lit(0).alias("level"), F.lit(0).cast("long").alias("instance"), F.col("rid").alias("bin"))
    loose, placed, level = rows.where(F.col("length") < capacity).select("rid", "length"), whole, 0
    left = loose.count()
    while left:
        level += 1
        count = -(-left // each)
        packed = cut(pack_instances(loose, count, capacity, islands, epochs, seed + level), "packed")
        if count == 1:
            done, left = packed, 0
        else:
            low = packed.groupBy("instance", "bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < int(capacity * full_enough)).select("instance", "bin")
            done = packed.join(low, ["instance", "bin"], "left_anti")
            loose = cut(packed.join(low, ["instance", "bin"], "left_semi").select("rid", "length"), "loose")
            again = loose.count()
            if again > left // 2:  # nothing is gained from dealing anew: keep what is packed
                done, left = packed, 0
            else:
                left = again
        placed = placed.unionByName(done.select("rid", F.lit(level).alias("level"), "instance", F.col("bin").cast("long").alias("bin")))
    # Whole pieces are numbered below zero, bins by their place: no two sequences can share a number.
    sequence = F.when(F.col("level") == 0, -1 - F.col("bin")).otherwise((F.col("instance") * (1 << 20) + F.col("bin")) * 32 + F.col("level"))
    numbered = rows.join(placed, "rid").withColumn("sequence_id", sequence)
    within = F.sum("length").over(_order()) - F.col("length")
    return numbered.withColumn("offset", within).select(*cut_pieces.columns, "sequence_id", "offset")


def _order():
    # A sequence has at most ``capacity`` pieces, so no window partition grows with the data.
    return Window.partitionBy("level", "instance", "bin").orderBy("rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
