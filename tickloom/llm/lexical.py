"""Ranked lexical search over an inverted index in shards, by Block-Max MaxScore.

**Index.** A task turns its documents into shards of about ``postings`` postings, so texts are never shuffled. A row of the index
is one block of at most ``BLOCK`` postings of one term in one shard: the first and last document, the number of postings, and
their documents, frequencies and document lengths as variable-length integers. With it stand the block's best pairs of
frequency and length, those that no other pair of the block beats in both: whatever the corpus grows to, the block's largest
score follows from them without decompression. One more row a shard, of the empty term, names its documents.

**Search.** Items are dealt into blocks of about ``together``; each block of items meets each shard in one group, as the rows of the
index for its terms, which also say which items ask for them. For an item, lists are ordered by their largest score. Lists
whose scores together cannot reach the k-th best score so far are not essential: candidates come from the essential ones alone,
a range of documents at a time, and are then held against the others from the largest down. A candidate goes as soon as its
score so far, the maximum of the block that it would lie in, and what smaller lists can add do not reach the k-th best; only blocks
with candidates left are decompressed. The best ``k`` of all shards are merged.

Nulls and edge cases: a null or empty text has no term, is no result and counts only as a document without terms; documents without
doc_id are ranked like others, after those with one among equal scores; rows that repeat a doc_id are documents of their
own; rows that repeat an item_id count once, as the one with the smallest text; an item without a term that some document holds
has no rows; a very long text is split as it is read, and its terms counted as a whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, partitions_for, prepare, tidy

#: Postings of a block.
BLOCK = 128
#: Documents of a shard at most; bytes of a text that are split into terms at once; documents that an item looks at first and then at once.
SHARD_DOCS, PART, FIRST, RANGE = 65_536, 1 << 20, 512, 4096
#: What a byte becomes: A-Z small, other letters, digits and all bytes of further characters themselves, the rest a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "shard long, term string, block int, first int, last int, n int, tops array<int>, data binary, docs long, length long"


def terms(text: bytes | None) -> Counter:
    """How often each term stands in a text."""
    out: Counter = Counter()
    folded, at = (text or b"").translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end + 1
    return out


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of less than 2**31 as bytes of seven bits each, the lowest first and all but the last with the high bit; and where each begins, and the end."""
    sizes = 1 + sum((values >= 1 << 7 * k).astype(np.int8) for k in range(1, 5))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        out[ends[some] + k] = (values[some] >> 7 * k) & 127 | np.where(sizes[some] > k + 1, 128, 0)
    return out, ends


def from_bytes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    if len(last) == len(raw):
        return raw.astype(np.int64)
    shift = (np.arange(len(raw)) - np.repeat(starts, last - starts + 1)) * 7
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


def best_pairs(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the postings that no other of their block beats by as high a frequency and as small a length, by block; block is ascending."""
    order = np.lexsort((length, -tf, block))
    # Later blocks take ever smaller values, so that the running minimum starts anew with each.
    value = length[order].astype(np.int64) - block[order].astype(np.int64) * (int(length.max(initial=0)) + 1)
    least = np.minimum.accumulate(value)
    keep = np.ones(len(order), bool)
    keep[1:] = value[1:] < least[:-1]
    return order[keep]


class _Shard:
    """Documents that a task has read and not yet written."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.lengths: list[int] = []
        self.postings = 0

    def add(self, doc_id: int | None, found: Counter) -> None:
        codes = self.codes
        code = np.fromiter((codes.setdefault(t, len(codes)) for t in found), np.int32, len(found))
        tf = np.fromiter(found.values(), np.int32, len(found))
        self.ids.append(doc_id)
        self.parts.append((code, tf))
        self.lengths.append(int(tf.sum(dtype=np.int64)))
        self.postings += len(code)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        has = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, ~has))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        lengths = np.array(self.lengths, np.int64)
        kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int64()]
        names = [part.split()[0] for part in INDEX.split(", ")]
        who = ids[order].astype("<i8").tobytes() + has[order].astype(np.uint8).tobytes()
        head = [shard, "", 0, 0, len(ids) - 1, len(ids), [], who, int((lengths > 0).sum()), int(lengths.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(head, kinds)], names=names)
        if not self.postings:
            return
        sizes = [len(c) for c, _ in self.parts]
        doc = np.repeat(place, sizes)
        code, tf = (np.concatenate(x) for x in zip(*self.parts))
        length = np.repeat(lengths, sizes)
        by = np.argsort(code.astype(np.int64) << 32 | doc)
        code, tf, doc, length = code[by], tf[by], doc[by].astype(np.int32), np.minimum(length[by], 2**31 - 1).astype(np.int32)
        start = np.concatenate([[True], code[1:] != code[:-1]])
        first = np.flatnonzero(start)
        within = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        opens = within % BLOCK == 0
        block, at = np.cumsum(opens) - 1, np.flatnonzero(opens)
        ends = np.append(at[1:], len(code))
        step = np.diff(doc, prepend=0)
        step[at] = 0
        inside, count = np.arange(len(code)) - at[block], (ends - at)[block]
        values = np.empty(3 * len(code), np.int32)
        for k, part in enumerate((step, tf, length)):
            values[3 * at[block] + k * count + inside] = part
        data, offsets = to_bytes(values)
        offsets = offsets[np.append(3 * at, len(values))]
        top = best_pairs(block, tf, length)
        pairs = np.column_stack([tf[top], length[top]]).ravel()
        many = np.concatenate([[0], np.cumsum(np.bincount(block[top], minlength=len(at)))]) * 2
        names_of = pa.array(list(self.codes), pa.binary()).cast(pa.string())
        columns = [
            pa.array(np.full(len(at), shard)),
            names_of.take(pa.array(code[at])),
            pa.array((within[at] // BLOCK).astype(np.int32)),
            pa.array(doc[at]),
            pa.array(doc[ends - 1]),
            pa.array((ends - at).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), pa.array(pairs.astype(np.int32))),
            pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]),
            pa.nulls(len(at), pa.int64()),
            pa.nulls(len(at), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def index(docs: DataFrame, postings: int = 2_000_000) -> DataFrame:
    """The index of doc_id and text; write it to search it more than once, as ``search`` does with what it needs of it."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 24, _Shard()
        for batch in tidy(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, terms(text.as_buffer().to_pybytes() if text.is_valid else None))
                if shard.postings >= postings or len(shard.ids) >= SHARD_DOCS:
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(work, INDEX)


class Lists:
    """The lists of one shard: of each term its blocks, their largest scores, and what has been decompressed."""

    def __init__(self, weights: list[int], rows: list[list[tuple]], documents: int, total: int):
        """rows: of each term (first, last, tops, data) of its blocks in order."""
        self.documents, self.total, self.weights = documents, total, weights
        self.first = [np.array([r[0] for r in blocks]) for blocks in rows]
        self.last = [np.array([r[1] for r in blocks]) for blocks in rows]
        self.data = [[r[3] for r in blocks] for blocks in rows]
        self.tops = []
        for w, blocks in zip(weights, rows):
            pairs = np.concatenate([np.asarray(r[2], np.int64) for r in blocks]).reshape(-1, 2)
            starts = np.cumsum([0] + [len(r[2]) // 2 for r in blocks[:-1]])
            self.tops.append(np.maximum.reduceat(self.scores(w, pairs[:, 0], pairs[:, 1]), starts))
        self.most = np.array([t.max() for t in self.tops], np.int64)
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def scores(self, weight: int, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term adds to documents of these lengths that hold it so often."""
        m = 100 - 25 + (25 * length * self.documents) // self.total
        return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))

    def block(self, term: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block."""
        found = self.held.get((term, b))
        if found is None:
            step, tf, length = from_bytes(self.data[term][b]).reshape(3, -1)
            found = self.held[term, b] = self.first[term][b] + np.cumsum(step), self.scores(self.weights[term], tf, length)
        return found

    def best(self, asked: list[int], times: list[int], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents for a query of these terms, best first, smaller places first among equals."""
        times = np.array(times, np.int64)
        most = self.most[asked] * times
        order = np.argsort(most, kind="stable")
        asked, times, below = [asked[i] for i in order], times[order], np.concatenate([[0], np.cumsum(most[order])])
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        lo, span = 0, FIRST
        while lo < size:
            essential = int(np.searchsorted(below[1:], least))  # lists before it do not reach ``least`` together
            if essential == len(asked):
                break
            hi = min(size, lo + span)
            total = np.zeros(hi - lo, np.int64)
            for i in range(essential, len(asked)):
                t = asked[i]
                for b in range(int(np.searchsorted(self.last[t], lo)), int(np.searchsorted(self.first[t], hi))):
                    d, s = self.block(t, b)
                    if d[0] < lo or d[-1] >= hi:
                        some = slice(*np.searchsorted(d, (lo, hi)))
                        d, s = d[some], s[some]
                    total[d - lo] += s * times[i]
            left = np.flatnonzero(total)
            so_far, left = total[left], left + lo
            for i in range(essential - 1, -1, -1):
                keep = so_far + below[i + 1] >= least
                left, so_far = left[keep], so_far[keep]
                if not len(left):
                    break
                t = asked[i]
                b = np.searchsorted(self.last[t], left)
                there = np.minimum(b, len(self.last[t]) - 1)
                inside = (b < len(self.last[t])) & (self.first[t][there] <= left)
                keep = so_far + np.where(inside, self.tops[t][there], 0) * times[i] + below[i] >= least
                left, so_far, there, inside = left[keep], so_far[keep], there[keep], inside[keep]
                for j in np.unique(there[inside]).tolist():
                    mine = np.flatnonzero(inside & (there == j))
                    d, s = self.block(t, j)
                    at = np.minimum(np.searchsorted(d, left[mine]), len(d) - 1)
                    hit = d[at] == left[mine]
                    so_far[mine[hit]] += s[at[hit]] * times[i]
            keep = so_far >= least
            docs, scores = np.concatenate([docs, left[keep]]), np.concatenate([scores, so_far[keep]])
            first = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[first], scores[first]
            least = max(least, int(scores[-1])) if len(scores) == k else least
            lo, span = hi, RANGE
        return docs, scores


def search(table: DataFrame, items: DataFrame, k: int = 20, together: int = 128) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of an ``index`` for each item (item_id, text)."""
    spark = table.sparkSession
    prepare(spark)
    known = table.where("term = ''").agg(F.count("*").alias("shards"), F.sum("docs").alias("n"), F.sum("length").alias("l")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not known.n:
        return empty
    single = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").cast("binary").alias("text"))
    dealt = max(1, -(-items.count() // together))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                found = terms(text.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.int64()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["item_id", "term", "times"])

    asked = cut(single.mapInArrow(words, "item_id long, term string, times long"), "asked")
    met = cut(table.where("term <> ''").join(asked.select("term").distinct(), "term", "left_semi").drop("docs", "length"), "lists")
    held = met.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * known.n + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(held.select("term", weight.alias("weight")), "term").withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(dealt)))
    # At most the items of one block are in a list here.
    wanted = weighed.groupBy("term", "part", "weight").agg(F.collect_list(F.struct("item_id", "times")).alias("by"))
    lists = met.join(wanted, "term").withColumn("by", F.when(F.col("block") == 0, F.col("by")))
    # The documents of a shard go to each block of items without a join: all shards have the empty term.
    names = table.where("term = ''").drop("docs", "length").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dealt - 1).cast("long"))))
    rows = lists.unionByName(names, allowMissingColumns=True)
    n, length = int(known.n), int(known.l)

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        held = group.select(["term", "block", "first", "last", "tops", "data", "weight", "by"]).sort_by([("term", "ascending"), ("block", "ascending")]).to_pylist()
        of: dict[str, int] = {}
        weights: list[int] = []
        blocks: list[list[tuple]] = []
        queries: dict[int | None, tuple[list[int], list[int]]] = {}
        ids, has = np.zeros(0, np.int64), np.zeros(0, bool)
        for r in held:
            if r["term"] == "":
                size = r["last"] + 1
                ids, has = np.frombuffer(r["data"], "<i8", size), np.frombuffer(r["data"], np.uint8, size, 8 * size).astype(bool)
                continue
            if r["term"] not in of:
                of[r["term"]] = len(weights)
                weights.append(r["weight"])
                blocks.append([])
            blocks[of[r["term"]]].append((r["first"], r["last"], r["tops"], r["data"]))
            for one in r["by"] or ():
                terms_of, times = queries.setdefault(one["item_id"], ([], []))
                terms_of.append(of[r["term"]])
                times.append(one["times"])
        lists = Lists(weights, blocks, n, length)
        out: list[tuple[int | None, np.ndarray, np.ndarray]] = [(item, *lists.best(a, t, len(ids), k)) for item, (a, t) in queries.items()]
        place = np.concatenate([d for _, d, _ in out]) if out else np.zeros(0, np.int64)
        who = [item for item, d, _ in out for _ in range(len(d))]
        score = np.concatenate([s for *_, s in out]) if out else place
        return pa.table({"item_id": pa.array(who, pa.int64()), "doc_id": pa.array(ids[place], pa.int64(), mask=~has[place]), "score": pa.array(score, pa.int64())})

    # A number of partitions of their own keeps groups from being merged.
    parts = max(4 * spark.sparkContext.defaultParallelism, partitions_for(known.shards * dealt, 4))
    found = rows.repartition(min(parts, 2 * known.shards * dealt), "shard", "part").groupBy("shard", "part").applyInArrow(answer, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL for the registered query's rows.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
           FROM documents),
     q AS (SELECT item_id, term, count(*) AS times
           FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
           GROUP BY ALL),
     c AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
     p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
     f AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n),
     s AS (SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(terms) * n) // l))))::BIGINT AS score
           FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), c GROUP BY item_id, doc_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""
