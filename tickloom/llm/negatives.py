"""Hard negatives by exact integer inner products, scored with anchors' subset-sum tables (the method of the Four Russians).

Components become floor(scale * x). A candidate is held as bit planes in two's complement: of each plane and each group of
eight dimensions one byte, bit j of which is that plane's bit of the group's dimension j. An anchor has for each group a
table of the sums of its own components over all 256 subsets of the group's dimensions. A plane's part of the inner
product is then one look-up a group; planes are joined from the highest (which counts negatively) down, doubling the sum
so far at each. No look-up is approximate, so scores are the full inner products.

Candidates lie in blocks of ``block`` rows and anchors in blocks of ``anchors_each``; every pair of a block of anchors and a
block of candidates is a group of its own, whatever labels its rows have. A first pass keeps the best ``positives`` rows of
the anchor's label in each pair of blocks, and then in all; they bound what a negative may score, and a second pass keeps
the best ``negatives`` rows within each bound. Nothing is sampled, and a group's size is bounded by the two parameters.

Nulls and edge cases: rows without vec_id, label or vector, or with a null or non-finite component, take no part, nor do vectors
whose length differs from the commonest one (the shorter among equally common ones), or that hold a component beyond
``LARGEST`` after scaling, as their scores need not fit 64 bits; rows that repeat a vec_id count once, as the one with the smallest
vector and label; zero vectors take part; ties go to the smaller vec_id; an anchor without another row of its label, or a
positive without a negative in its range, has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, prepare

#: Scaled components of at most this size, in vectors of up to 8,192 dimensions, have inner products of less than 2**57, a hundredth of what 64 bits hold.
LARGEST = 2**22
#: Scores that a task holds at once while it looks them up.
CELLS = 1 << 21
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, label: Column | str = "label", scale: float = 256.0, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, label, c) of the rows that take part, c the scaled components as integers."""
    label = F.col(label) if isinstance(label, str) else label
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(column).cast("array<double>").alias("v"))
    good = named.where("vec_id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    small = good.where(F.forall("v", lambda x: F.abs(x * F.lit(float(scale))) < LARGEST))
    scaled = small.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("c"))
    sizes = scaled.groupBy(F.size("c").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return scaled.where(F.size("c") == (sizes.n if sizes else 0)).groupBy("vec_id").agg(F.min(F.struct("c", "label")).alias("s")).select("vec_id", "s.label", "s.c")


def packed(values: np.ndarray, planes: int) -> np.ndarray:
    """Bytes of each row's bit planes, (rows, planes, groups), lowest plane first; ``values`` are signed and need ``planes`` bits with the sign."""
    rows, dims = values.shape
    groups = -(-dims // 8)
    full = np.zeros((rows, groups * 8), np.int64)
    full[:, :dims] = values
    bits = (full[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """For each group of eight dimensions the sums over its subsets, (groups, 256, anchors)."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    full = np.zeros((n, groups * 8), np.int64)
    full[:, :dims] = anchors
    parts = full.reshape(n, groups, 8).transpose(1, 2, 0)
    out = np.zeros((groups, 256, n), np.int64)
    for j in range(8):  # the subsets with dimension j as their highest follow from those below
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + parts[:, j, None]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) from ``subset_sums`` of the anchors and ``packed`` candidates."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    part = np.empty_like(total)
    for p in reversed(range(planes.shape[1])):
        if p == planes.shape[1] - 1:
            for g in range(len(tables)):
                total -= np.take(tables[g], planes[:, p, g], axis=0, out=part, mode="clip")
            continue
        total += total
        for g in range(len(tables)):
            total += np.take(tables[g], planes[:, p, g], axis=0, out=part, mode="clip")
    return total


def _first(owner: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each owner, in order; the smaller vec first among equals."""
    order = np.lexsort((vec, -score, owner))
    own = owner[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[rank < k]


def best_positives(score: np.ndarray, labels: np.ndarray, ids: np.ndarray, anchor_labels: np.ndarray, anchor_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, candidate) places of the ``k`` best other candidates of each anchor's label among these."""
    same = (labels[:, None] == anchor_labels[None, :]) & (ids[:, None] != anchor_ids[None, :])
    least = np.iinfo(score.dtype).min
    held = np.where(same, score, least)
    if len(ids) > k:
        same &= held >= np.partition(held, len(ids) - k, axis=0)[len(ids) - k]
    rows, anchors = np.nonzero(same)
    keep = _first(anchors, held[rows, anchors].astype(np.int64), ids[rows], k)
    return anchors[keep], rows[keep]


def best_negatives(score: np.ndarray, labels: np.ndarray, ids: np.ndarray, anchor_labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, positive, candidate) places of the ``k`` best candidates of another label with low <= score <= high; bounds are (anchors, positives)."""
    some = (score >= low.min(axis=1)) & (score <= high.max(axis=1)) & (labels[:, None] != anchor_labels[None, :])
    rows, anchors = np.nonzero(some)
    value = score[rows, anchors].astype(np.int64)
    found = []
    for j in range(low.shape[1]):
        fits = np.flatnonzero((value >= low[anchors, j]) & (value <= high[anchors, j]))
        keep = fits[_first(anchors[fits], value[fits], ids[rows[fits]], k)]
        found.append((anchors[keep], np.full(len(keep), j), rows[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 4096, anchors_each: int = 1024) -> DataFrame:
    """The first ``negatives`` rows of another label for each anchor and each of its first ``positives`` rows of its own label.

    vectors: as from ``usable``. anchors: which of them are anchors. A negative's score lies between ``low`` and ``high`` per cent
    of the positive's, both included.
    """
    spark = vectors.sparkSession
    prepare(spark)
    known = vectors.agg(
        F.count("*").alias("n"),
        F.count_if(anchors).alias("anchors"),
        F.max(F.size("c")).alias("dims"),
        F.max(F.array_max(F.transform("c", lambda x: F.abs(x)))).alias("most"),
    ).first()
    if not known.anchors or not known.dims:
        return spark.createDataFrame([], RESULT)
    planes, groups = int(known.most).bit_length() + 1, -(-known.dims // 8)
    kind = np.int32 if known.dims * known.most**2 * 2 < 2**31 else np.int64
    blocks, asking = -(-known.n // block), -(-known.anchors // anchors_each)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = packed(_matrix(batch.column(2)), planes).reshape(batch.num_rows, -1)
                sizes = np.arange(batch.num_rows + 1, dtype=np.int32) * rows.shape[1]
                data = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(sizes), pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, batch.column(3)], names=["vec_id", "label", "planes", "block"])

    # Ids are spread over blocks by a hash, so blocks are about even whatever the ids are.
    spread = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    candidates = cut(spread.mapInArrow(pack, "vec_id long, label long, planes binary, block long"), "planes")
    asked = vectors.where(anchors).withColumn("asking", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asking)))

    def tables(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return right["vec_id"].to_numpy(), right["label"].to_numpy(), subset_sums(_matrix(right["c"])).astype(kind)

    def scored(left: pa.Table, sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, labels and scores of the candidates, some at a time."""
        data = np.frombuffer(b"".join(left["planes"].to_pylist()), np.uint8).reshape(left.num_rows, planes, groups)
        ids, labels = left["vec_id"].to_numpy(), left["label"].to_numpy()
        each = max(256, CELLS // max(1, sums.shape[2]))
        for a in range(0, len(ids), each):
            yield ids[a : a + each], labels[a : a + each], scores(sums, data[a : a + each])

    def first(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own, own_label, found = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if left.num_rows and right.num_rows:
            own, own_label, sums = tables(right)
            for ids, labels, score in scored(left, sums):
                a, c = best_positives(score, labels, ids, own_label, own, positives)
                found.append((own[a], ids[c], score[c, a].astype(np.int64)))
        anchor, vec, value = (np.concatenate(x) for x in zip(*found)) if found else (own, own, own)
        keep = _first(anchor, value, vec, positives)
        return pa.table({"anchor_id": anchor[keep], "positive_id": vec[keep], "positive_score": value[keep]})

    def second(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        nothing = np.zeros(0, np.int64)
        own, found = nothing, []
        if left.num_rows and right.num_rows:
            own, own_label, sums = tables(right)
            lists = right["bounds"].combine_chunks()
            ends = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
            flat = np.asarray(lists.flatten())
            lo, hi = np.zeros((len(own), positives), np.int64), np.full((len(own), positives), -1, np.int64)
            row = np.repeat(np.arange(len(own)), np.diff(ends))
            place = np.arange(len(flat)) - ends[row]
            lo[row, place] = -((-low * flat) // 100)
            hi[row, place] = (high * flat) // 100
            for ids, labels, score in scored(left, sums):
                a, j, c = best_negatives(score, labels, ids, own_label, lo, hi, negatives)
                found.append((a * positives + j, ids[c], score[c, a].astype(np.int64)))
        pair, vec, value = (np.concatenate(x) for x in zip(*found)) if found else (nothing, nothing, nothing)
        keep = _first(pair, value, vec, negatives)
        pair = pair[keep]
        return pa.table({"anchor_id": own[pair // positives], "place": pair % positives + 1, "negative_id": vec[keep], "negative_score": value[keep]})

    def paired(asked: DataFrame, work, schema: str) -> DataFrame:
        """``work`` on every block of candidates with every block of anchors."""
        left = candidates.withColumn("asking", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asking - 1).cast("long"))))
        right = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        parts = max(4 * spark.sparkContext.defaultParallelism, -(-blocks * asking // 4))  # a number of their own keeps blocks from being merged
        sides = [side.repartition(min(parts, blocks * asking * 2), "asking", "block").groupBy("asking", "block") for side in (left, right)]
        return sides[0].cogroup(sides[1]).applyInArrow(work, schema)

    def top(found: DataFrame, by: list[str], score: str, vec: str, k: int, name: str) -> DataFrame:
        ordered = found.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), vec)))
        return ordered.where(F.col(name) <= k)

    near = paired(asked, first, "anchor_id long, positive_id long, positive_score long")
    near = cut(top(near, ["anchor_id"], "positive_score", "positive_id", positives, "place").withColumn("place", F.col("place").cast("long")), "positives")
    bounds = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x.positive_score).alias("bounds"))
    bounded = asked.join(bounds, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    far = paired(bounded, second, "anchor_id long, place long, negative_id long, negative_score long")
    hard = top(far, ["anchor_id", "place"], "negative_score", "negative_id", negatives, "rank")
    return hard.join(near, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql(anchor_every: int = 50) -> str:
    """DuckDB SQL for the registered query's rows."""
    return f"""
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.c, b.c)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % {anchor_every} = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
