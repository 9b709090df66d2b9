"""Token-id files: documents as ids, range-coded in checksummed blocks, in ascending order of doc_id.

Documents are range-partitioned by id and sorted within partitions; each task encodes its texts, appends the end id and
writes segments of whole documents (see ``coder`` for their bytes). Spark's text writer commits the files, one segment a
record, so a lost executor costs its tasks and leaves no half-written file; records are separated by one line feed. The
reader decodes each file, checks every block's checksum and places documents by the totals of the segments before them.

Nulls and edge cases: a null or empty text is the end id alone; null doc_ids sort first; rows that repeat a doc_id are
documents of their own, next to each other, in the order of a hash of their texts; a very long text is encoded whole, and its segment
grows by it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import coder, tokens
from tickloom.llm.common import gathered, partitions_for, prepare, slices, tidy

#: Ids at which a segment ends, after the document that reaches them; a file holds SEGMENTS of them at most.
SEGMENT_IDS, SEGMENTS = 6_000_000, 5


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, vocabulary_size: int, docs_each: int = 4096) -> None:
    """Write doc_id and text as token-id files under ``path``."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, segment = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = coder.pack_segment(shard, segment, doc_ids, np.concatenate(counts), np.concatenate(held), vocabulary_size)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in gathered(tidy(batches, keep=vocabulary), tokens.SLICE_BYTES):
            at = 0
            for part in slices(batch.column(1), tokens.SLICE_BYTES):
                ids, n = encoder.encode(part)
                ends = np.cumsum(n)
                doc_ids += batch.column(0).slice(at, len(part)).to_pylist()
                at += len(part)
                held.append(np.insert(ids, ends, end_id).astype(np.uint32))
                counts.append(n + 1)
                size += len(ids) + len(n)
                if size >= SEGMENT_IDS:
                    yield flush()
                    segment += 1
                    doc_ids, held, counts, size = [], [], [], 0
        if doc_ids:
            yield flush()

    parts = partitions_for(docs.count(), docs_each)
    # Of rows that share a doc_id, or have none, a hash of the text says the order, and over which tasks they are spread.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    records = ordered.mapInArrow(work, "data binary")
    records.select(F.col("data").cast("string")).write.option("maxRecordsPerFile", SEGMENTS).option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str, vocabulary_size: int, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    prepare(spark)
    kinds = "shard long, segment long, within long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for content in batch.column(0):
                data, at = content.as_py(), 0
                while at < len(data):
                    shard, segment, doc_ids, counts, ids, at = coder.read_segment(data, at, vocabulary_size)
                    if data[at : at + 1] != b"\n":
                        raise ValueError(f"segment {segment} of shard {shard} is not ended")
                    at += 1
                    starts = np.cumsum(counts) - counts
                    cut = [ids[a : a + n] for a, n in zip(starts.tolist(), counts.tolist())]
                    n = len(doc_ids)
                    columns = [pa.array(np.full(n, shard)), pa.array(np.full(n, segment)), pa.array(starts), pa.array(doc_ids, pa.int64()), pa.array(counts), pa.array([tokens.crc(c) for c in cut], pa.int64())]
                    if with_ids:
                        columns.append(pa.array(cut, pa.list_(pa.int32())))
                    names = ["shard", "segment", "within", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, kinds)


def placed(rows: DataFrame) -> DataFrame:
    """Documents from ``read`` with start, the ids of all documents before them."""
    segments = rows.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("ids"))
    shards = segments.groupBy("shard").agg(F.sum("ids").alias("ids"))
    # One row a shard meets in this window, and shards grow with the executors' work, not with documents.
    before = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shards_before"))
    inside = segments.select("shard", "segment", (F.sum("ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("ids")).alias("segments_before"))
    offsets = inside.join(before, "shard").select("shard", "segment", (F.col("shards_before") + F.col("segments_before")).alias("before"))
    return rows.join(offsets, ["shard", "segment"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "shard", "segment")
