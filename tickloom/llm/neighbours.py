"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Vectors are dealt into bands of norms within a factor of two, scaled by the largest norm of their band and given one more
component that makes their norm 1, queries are normalised, so that Euclidean order within a band is the order of inner
products; every band is searched. A table hashes a vector to the cells of K Gaussian projections of
width ``width``; a query visits its own bucket and then perturbed ones, in the order of the summed squared distances to
the cell borders that they cross (their estimated success). Candidates of all tables are reranked by inner products in
double precision on the original vectors.

Projections, width and probes are fitted: a bounded sample of queries (``FIT_QUERIES``) is answered exactly over all
vectors, and of all settings that find ``recall`` of these neighbours the one that makes a query cheapest is taken, as
a bounded sample of vectors (``FIT_VECTORS``) tells how many a query meets. More vectors thus get smaller buckets. Where vectors are spread
so evenly that no setting is cheap, most of them are visited.

Buckets are dealt into shards of about ``shard_rows`` vectors; a bucket with more is split over several shards, all of
which its queries visit, so that a common vector or dense cluster never lands in one task whole. Queries are dealt into blocks
of about ``queries_each``, and each block meets each shard in a group of its own, so a group's size is bounded on both sides. A
group answers each of its queries with ``k`` candidates at most, which loses nothing of the final ``k``.

Where no setting finds ``recall`` of the sampled queries' neighbours, all queries are answered exactly, block by block.

Nulls and edge cases: vectors that are null, zero, hold a null or non-finite component or differ from the commonest
length take no part, nor do rows without vec_id; rows that repeat a vec_id count once; ties go to the smaller vec_id; queries with
fewer than ``k`` candidates are held against all vectors, a block of queries and one of vectors at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, prepare


@dataclass(frozen=True)
class Tables:
    """The hash functions, made anew from the seed wherever they are needed."""

    dims: int
    scales: tuple[float, ...]
    tables: int = 5
    projections: int = 4
    width: float = 1.2
    probes: int = 60
    seed: int = 23

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.dims + 1, self.tables * self.projections)), rng.uniform(0, self.width, self.tables * self.projections)

    def bands(self, vectors: np.ndarray) -> np.ndarray:
        """The band of each vector: the first of the ascending scales that its norm does not exceed."""
        found = np.searchsorted(np.array(self.scales), np.linalg.norm(vectors, axis=1) * (1 - 1e-9))
        return np.minimum(found, len(self.scales) - 1)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Names of the bucket of each vector in each table, (rows, tables)."""
        return names(np.floor(self.project(vectors, False)), self.bands(vectors)[:, None] * self.tables + np.arange(self.tables))

    def lifted(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Points on the unit sphere whose distances from a query are in the order of inner products, within a band."""
        norms = np.linalg.norm(vectors, axis=1)
        if queries:
            return np.column_stack([vectors / norms[:, None], np.zeros(len(vectors))])
        scale = np.array(self.scales)[self.bands(vectors)]
        return np.column_stack([vectors / scale[:, None], np.sqrt(np.maximum(0, 1 - (norms / scale) ** 2))])

    def project(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Positions on each projection in cells, (rows, tables, projections)."""
        gauss, shift = self.functions()
        return ((self.lifted(vectors, queries) @ gauss + shift) / self.width).reshape(len(vectors), self.tables, self.projections)

    def asked(self, queries: np.ndarray) -> np.ndarray:
        """Names of the buckets that each query visits, of all tables and bands, (rows, visits)."""
        at = self.project(queries, True)
        cells = np.floor(at)
        flat = (at - cells).reshape(-1, self.projections)
        moved = cells.astype(np.int64).reshape(-1, 1, self.projections) + perturbations(flat, self.probes)
        moved = moved.reshape(len(queries), self.tables, -1, self.projections)
        table = np.arange(self.tables)[None, :, None]
        return np.stack([names(moved, band * self.tables + table) for band in range(len(self.scales))], axis=1).reshape(len(queries), -1)


def names(cells: np.ndarray, table: np.ndarray | int) -> np.ndarray:
    """One 64-bit name for the cells of a bucket (last axis) and its table."""
    name = np.full(cells.shape[:-1], 0, np.uint64) + np.asarray(table, np.uint64) + np.uint64(1)
    for j in range(cells.shape[-1]):
        name = (name ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


#: Perturbations among which a query's likeliest are sought; where they do not suffice, the search is exact.
MOST_PROBES = 2000


@functools.lru_cache(maxsize=32)
def template(projections: int, most: int) -> np.ndarray:
    """The ``most`` sets of border crossings that are likeliest for a query anywhere in its cell, a row of 0 and 1 each; the first crosses none.

    Columns are the 2K borders from the nearest to the farthest; a border and its opposite have mirrored places and are never
    crossed together. Rows follow the expected squared distances of such ordered borders.
    """
    k = projections
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far = 1 - j / (k + 1) + near
    cost = np.concatenate([near, far[::-1]])
    sets: list[tuple[int, ...]] = [()]
    heap = [(float(cost[0]), (0,))]
    while heap and len(sets) < most:
        total, chosen = heapq.heappop(heap)
        if not any(2 * k - 1 - c in chosen for c in chosen):
            sets.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
    out = np.zeros((len(sets), 2 * k))
    for row, chosen in enumerate(sets):
        out[row, list(chosen)] = 1
    return out


def borders(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to the 2K borders of each row's cell, ascending, and which they are: i for the lower, K + i for the upper one of projection i."""
    squares = np.concatenate([inside**2, (1 - inside) ** 2], axis=-1)
    order = np.argsort(squares, axis=-1, kind="stable")
    return np.take_along_axis(squares, order, -1), order


def perturbations(inside: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` moves of each query's cell, likeliest first: (rows, moves, K) of -1, 0 and 1; the first moves nothing.

    inside: where the query lies in its cell on each projection, from 0 to 1, a row each.
    """
    rows, k = inside.shape
    sets = template(k, min(3**k, max(2 * most, 64)))
    squares, order = borders(inside)
    cost = squares @ sets.T
    most = min(most, len(sets))
    pick = np.argsort(cost, axis=1, kind="stable")[:, :most]
    crossed = sets[pick].astype(bool)
    sign = np.where(order < k, -1, 1)
    moves = np.zeros((rows, most, k), np.int64)
    r, m, c = np.nonzero(crossed)
    moves[r, m, order[r, c] % k] = sign[r, c]
    return moves


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as array<double>."""
    good = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("v") == (sizes.n if sizes else 0))
    return good.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _shard_of(bucket: np.ndarray, part: np.ndarray, base: int) -> np.ndarray:
    return ((bucket.view(np.uint64) ^ (part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) % np.uint64(base)).astype(np.int64)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each query, the smaller vec_id first among equals; a pair counts once."""
    order = np.lexsort((vec, -score, query))
    q, v = query[order], vec[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    order, q = order[fresh], q[fresh]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


#: Queries that are answered exactly to fit the tables, and vectors that tell the size of buckets.
FIT_QUERIES, FIT_VECTORS = 100, 4000
#: Settings that are compared: projections, and widths by the median distance of the k-th neighbours.
FIT_PROJECTIONS, FIT_WIDTHS = (2, 4, 6, 8, 10, 12, 16), (1.0, 1.5, 2.5, 4.0)
#: What a probe costs, in scored vectors.
PROBE_COST = 5.0


@dataclass(frozen=True)
class Fit:
    """Fitted tables, the share of the exact neighbours that they find, and the share of all vectors that a query meets, repeats included."""

    hashing: Tables
    recall: float
    visited: float


def exact_neighbours(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of ``queries`` and vector of each one's ``k`` nearest, from one pass over all vectors; for few queries."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, queries))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shared.value
        # The task's best so far: k for each query at most.
        q, vec, score, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, asked.shape[1]))
        for batch in batches:
            if batch.num_rows:
                ids_, v = np.asarray(batch.column(0)), _matrix(batch.column(1))
                scores = np.einsum("qd,nd->qn", asked, v)
                scores[own[:, None] == ids_[None, :]] = -np.inf
                edge = np.partition(scores, max(0, len(ids_) - k), axis=1)[:, max(0, len(ids_) - k)]
                more, at = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
                q, vec, score, held = np.concatenate([q, more]), np.concatenate([vec, ids_[at]]), np.concatenate([score, scores[more, at]]), np.concatenate([held, v[at]])
                keep = _best(q, vec, score, k)
                q, vec, score, held = q[keep], vec[keep], score[keep], held[keep]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(vec), pa.array(score), pa.array(list(held), pa.list_(pa.float64()))], names=["query", "vec_id", "score", "v"])

    near = vectors.mapInArrow(work, "query long, vec_id long, score double, v array<double>")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)
    rows = best.select("query", "v").collect()  # FIT_QUERIES x k vectors at most
    return np.array([r.query for r in rows], np.int64), np.array([r.v for r in rows], float).reshape(len(rows), queries.shape[1])


def fit(vectors: DataFrame, n: int, dims: int, scales: tuple[float, ...], k: int, tables: int, recall: float) -> Fit:
    """The cheapest tables that find ``recall`` of the sampled queries' exact neighbours; those that find most where none do."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_VECTORS).collect()
    ids, sample = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows], float)
    asked = sample[:FIT_QUERIES]
    whose, near = exact_neighbours(vectors, ids[:FIT_QUERIES], asked, k)
    if not len(near):
        return Fit(Tables(dims, scales, tables), 1.0, 1.0)
    plain = Tables(dims, scales, tables)
    kth = np.linalg.norm(plain.lifted(near, False) - plain.lifted(asked, True)[whose], axis=1)
    reach = max(float(np.median(kth)), 1e-6)
    found: list[tuple[bool, float, Fit]] = []
    for projections in FIT_PROJECTIONS:
        for times in FIT_WIDTHS:
            hashing = Tables(dims, scales, tables, projections, times * reach)
            at, there = hashing.project(asked, True), np.floor(hashing.project(near, False))
            cells = np.floor(at)
            sets = template(projections, min(3**projections, MOST_PROBES))
            squares, _ = borders((at - cells).reshape(-1, projections))
            costs = np.sort(squares @ sets.T, axis=1).reshape(len(asked), tables, -1)
            inside, step = (at - cells)[whose], there - cells[whose]
            need = (np.where(step < 0, inside**2, 0) + np.where(step > 0, (1 - inside) ** 2, 0)).sum(-1)
            rank = np.full(need.shape, np.iinfo(np.int64).max)
            ok = (np.abs(step) <= 1).all(-1) & (need <= costs[whose, :, -1])
            for i, t in zip(*np.nonzero(ok)):
                rank[i, t] = np.searchsorted(costs[whose[i], t], need[i, t] + 1e-12, side="right")
            best = np.sort(rank.min(axis=1))
            wanted = best[min(len(best) - 1, int(np.ceil(recall * len(best))) - 1)]
            probes = int(min(max(wanted, 1), MOST_PROBES, 3**projections))
            hashing = dataclasses.replace(hashing, probes=probes)
            reached = float((best <= probes).mean())
            if reached < recall:
                found.append((True, -reached, Fit(hashing, reached, 1.0)))
                continue
            asking, target = np.sort(hashing.asked(asked), axis=1), hashing.buckets(near)
            met_near = [np.isin(target[whose == q], asking[q]).any(axis=1) for q in range(len(asked))]
            reached = float(np.concatenate(met_near).mean())
            held, many = np.unique(hashing.buckets(sample), return_counts=True)
            asking = asking[:30]
            where = np.minimum(np.searchsorted(held, asking.ravel()), len(held) - 1)
            met = float(np.where(held[where] == asking.ravel(), many[where], 0).sum() / min(30, len(asked)) / len(sample))
            found.append((reached < recall, met * n + PROBE_COST * tables * probes if reached >= recall else -reached, Fit(hashing, reached, met)))
    return min(found, key=lambda x: x[:2])[2]


def extent(vectors: DataFrame) -> tuple[Row, tuple[float, ...]]:
    """Number, largest norm and length of the vectors, and the scales of their bands."""
    norm = F.expr("least(greatest(sqrt(aggregate(v, 0d, (s, x) -> s + x * x)), 1e-300D), 1e300D)")
    known = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("v")).alias("dims")).first()
    # Counted from the longest vector, so that equal norms are one band whatever their rounding; a double allows some 2,000 bands.
    banded = vectors.select(norm.alias("norm")).groupBy(F.floor(F.log2(F.lit(known.norm or 1.0)) - F.log2("norm") + 1e-9).alias("band")).agg(F.max("norm").alias("scale"))
    return known, tuple(sorted(r.scale for r in banded.collect()))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, tables: int = 5, shard_rows: int = 20_000, queries_each: int = 4096, fitted: Fit | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found; both inputs are (vec_id, v) as from ``usable``."""
    spark = vectors.sparkSession
    prepare(spark)
    known, scales = extent(vectors)
    if not known.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = fitted or fit(vectors, known.n, known.dims, scales, k, tables, recall)
    hashing, tables = fitted.hashing, fitted.hashing.tables
    parts = max(1, -(-queries.count() // queries_each))
    base = max(1, -(-tables * known.n // shard_rows))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = hashing.buckets(_matrix(batch.column(0)))
            buckets, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(n)], names=["bucket", "n"])

    # At most one bucket in ``shard_rows`` hashed rows can be listed here.
    crowded = vectors.select("v").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > shard_rows).toPandas()
    splits = spark.sparkContext.broadcast(dict(zip(crowded.bucket.tolist(), (-(-crowded.n // shard_rows)).tolist())))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = splits.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            bucket = hashing.buckets(_matrix(batch.column(1)))
            part = np.array([[i % parts.get(b, 1) for b in row] for i, row in zip(ids.tolist(), bucket.tolist())], np.int64).reshape(bucket.shape)
            shard = _shard_of(bucket, part, base)
            rows = np.repeat(np.arange(len(ids)), tables)
            yield pa.RecordBatch.from_arrays([pa.array(shard.ravel()), pa.array(bucket.ravel()), pa.array(ids[rows]), batch.column(1).take(pa.array(rows))], names=["shard", "bucket", "vec_id", "v"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = splits.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            shards, lists, rows = [], [], []
            for first in range(0, len(ids), 50):
                visited = hashing.asked(_matrix(batch.column(1).slice(first, 50)))
                if parts:
                    spread = [np.concatenate([np.repeat(np.array([b]), parts.get(b, 1)) for b in row]) for row in visited.tolist()]
                    part = [np.concatenate([np.arange(parts.get(b, 1)) for b in row]) for row in visited.tolist()]
                else:
                    spread, part = list(visited), [np.zeros(len(v), np.int64) for v in visited]
                for r, (buckets, p) in enumerate(zip(spread, part), first):
                    s = _shard_of(buckets, p, base)
                    order = np.lexsort((buckets, s))
                    s, buckets = s[order], buckets[order]
                    own = np.flatnonzero(np.diff(s, prepend=-1))
                    for found in np.split(buckets, own[1:]):
                        lists.append(np.unique(found))
                    shards += s[own].tolist()
                    rows += [r] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(ids[rows] if rows else [], pa.int64()), batch.column(1).take(pa.array(rows, pa.int64()))],
                names=["shard", "buckets", "query_id", "v"],
            )

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        ids, v = left["vec_id"].to_numpy(), _matrix(left["v"])
        q_ids, q = right["query_id"].to_numpy(), _matrix(right["v"])
        bucket = left["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        held, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        lists = right["buckets"].combine_chunks()
        wanted = np.asarray(lists.flatten())
        asker = np.repeat(np.arange(len(q_ids)), np.diff(np.asarray(lists.offsets)))
        by = np.argsort(wanted, kind="stable")
        wanted, asker = wanted[by], asker[by]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b, s, e in zip(held.tolist(), starts.tolist(), ends.tolist()):
            who = asker[np.searchsorted(wanted, b) : np.searchsorted(wanted, b, side="right")]
            rows = order[s:e]
            for c in range(0, len(who), max(1, 2_000_000 // max(1, len(rows)))):
                some = who[c : c + max(1, 2_000_000 // max(1, len(rows)))]
                scores = np.einsum("qd,nd->qn", q[some], v[rows])
                scores[q_ids[some][:, None] == ids[rows][None, :]] = -np.inf
                if len(rows) > k:
                    edge = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
                    a, n = np.nonzero(scores >= edge[:, None])
                else:
                    a, n = np.nonzero(np.isfinite(scores))
                ok = np.isfinite(scores[a, n])
                found.append((some[a[ok]], ids[rows[n[ok]]], scores[a[ok], n[ok]]))
            if sum(len(f[0]) for f in found) > 4_000_000:
                found = [_pick(found, k)]
        who, vec, score = _pick(found, k) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": q_ids[who], "vec_id": vec, "score": score}, schema=pa.schema(list(out.items())))

    left = vectors.mapInArrow(dealt, "shard long, bucket long, vec_id long, v array<double>")
    right = queries.mapInArrow(asked, "shard long, buckets array<long>, query_id long, v array<double>")

    def ranked(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))) if parts > 1 else left.withColumn("part", F.lit(0).cast("long"))
        right = right.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        best = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(answer, "query_id long, vec_id long, score double")
        merged = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        places = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return places.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # Vectors and queries by blocks, each pair of which meets once.
    blocks = max(1, -(-known.n // shard_rows))
    every = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("shard"), F.lit(0).cast("long").alias("bucket"), "vec_id", "v")

    def exactly(few: DataFrame) -> DataFrame:
        asking = few.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("shard"), F.array(F.lit(0).cast("long")).alias("buckets"), "query_id", "v")
        return ranked(every, asking)

    if fitted.recall < recall:
        return exactly(queries.withColumnRenamed("vec_id", "query_id"))
    found = cut(ranked(left, right), "neighbours")
    full = found.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= min(k, known.n)).select("query_id")
    short = cut(queries.select(F.col("vec_id").alias("query_id"), "v").join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(exactly(short))


def _pick(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    query, vec, score = (np.concatenate(x) for x in zip(*found))
    keep = _best(query, vec, score, k)
    return query[keep], vec[keep], score[keep]
