"""WARC archives of pages and the merge of their capture index.

Writing: pages with equal payloads are known by SHA-1; the one with the largest page_id is stored as a response, the
others as revisits that name it and carry no payload. Each record is a gzip member of its own, so that whoever has the
offset and length of a capture fetches it alone (``fetch``). Members are written by Spark's text writer, so files are committed
as any Spark output is; what it puts between its rows is the empty gzip member. Reading unpacks archives record by record,
recomputes each response's digest and keeps one locally sorted run of captures per archive. The index
merge deals the runs by ranges of (URL key, timestamp, page_id) and merges the runs of each range by a loser tree, so
that the partitions in order are one globally ordered capture history, however many captures one URL has.

Nulls and edge cases: a null payload is empty; a null url has no target header and an empty URL key; a null page_id
never wins over another, and where all are null every record is a response; rows that repeat the winning page_id are
responses each; white space and control characters in a url are percent-encoded; a very long payload is one record, held
whole by one task; an empty table gives no captures; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import partitions_for, prepare

END = b"\r\n\r\n"
#: The gzip member that holds nothing; without a time, as all members here, so that equal records are equal bytes.
NOTHING = gzip.compress(b"", mtime=0)
#: Bytes of an archive that are unpacked at once.
PIECE = 1 << 16
#: Bytes at which records are handed to the writer, and such hand-overs of one archive file.
CHUNK, CHUNKS = 4 << 20, 4
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
CAPTURES = "url_key string, captured string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, at long, length long"
ORDER = ["url_key", "captured", "page_id"]


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-cased, without scheme, port 80 or 443, ``www.`` and fragment."""
    rest = (url or "").partition("#")[0].lower()
    rest = rest.partition("://")[2] if "://" in rest else rest
    cut = min((k for k in map(rest.find, "/?") if k >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = host.removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (path or "/") if host else ""


def _header(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, winner: int | None, captured: str) -> bytes:
    """One record without the blank lines that end it. ``winner`` is the page whose payload a revisit refers to."""
    revisit = winner is not None and page_id != winner
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {captured}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{winner}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record; raises where the archive is damaged."""
    at = 0
    while at < len(data):
        head = data.find(END, at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record starts at byte {at}")
        lines = data[at:head].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = head + len(END)
        end = start + int(headers["Content-Length"])
        if data[end : end + len(END)] != END:
            raise ValueError(f"the WARC record at byte {at} is not ended")
        yield at, end + len(END) - at, headers, data[start:end]
        at = end + len(END)


def write(pages: DataFrame, path: str, payload: str = "html") -> None:
    """Write page_id, url and ``payload`` as WARC files under ``path``."""
    spark = pages.sparkSession
    prepare(spark)
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("body"))
    held = held.withColumn("sha1", F.sha1("body"))
    # One short row for each payload that several pages share; one that very many share is a skewed join that Spark splits.
    winners = held.groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count("*").alias("pages")).where("pages > 1").select("sha1", "winner")
    joined = held.join(winners, "sha1", "left").select("page_id", "url", "body", "winner")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, body, winner in zip(*(batch.column(k) for k in range(4))):
                page_id, data = page_id.as_py(), body.as_py()
                captured = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                waiting.append(gzip.compress(record(page_id, url.as_py(), data, base32_sha1(data), winner.as_py(), captured) + END, 6, mtime=0))
                size += len(waiting[-1])
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(waiting)], pa.binary())], names=["data"])
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(waiting)], pa.binary())], names=["data"])

    records = joined.mapInArrow(work, "data binary").select(F.col("data").cast("string"))
    # Rows are written as the bytes they are; the encoding is that of the separator.
    records.write.option("maxRecordsPerFile", CHUNKS).option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that holds something."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpacker, parts, fed = zlib.decompressobj(wbits=31), [], at
        while not unpacker.eof:
            if fed >= len(data):
                raise ValueError(f"the gzip member at byte {at} is not ended")
            parts.append(unpacker.decompress(view[fed : fed + PIECE]))
            fed = min(len(data), fed + PIECE)
        end = fed - len(unpacker.unused_data)
        content = b"".join(parts)
        if content:
            yield at, end - at, content
        at = end


def fetch(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the one record whose bytes these are: ``length`` bytes of the archive from ``at`` on, as the index says."""
    ((_, _, headers, block),) = parse(gzip.decompress(data))
    return headers, block


def _records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset and length in the archive, headers and block of each record."""
    for at, length, content in members(data):
        for _, _, headers, block in parse(content):
            yield at, length, headers, block


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, each archive's in one sorted run."""
    prepare(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for at, length, headers, block in _records(content.as_py()):
                    http, _, body = block.partition(END)
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and base32_sha1(body) != digest:
                        raise ValueError(f"the payload at byte {at} of {name} does not have its digest")
                    size = len(body) if headers["WARC-Type"] == "response" else int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    refers = headers.get("WARC-Refers-To")
                    stamp = "".join(c for c in headers["WARC-Date"] if c.isdigit())
                    rows.append((url_key(headers.get("WARC-Target-URI")), stamp, _page(headers["WARC-Record-ID"]), headers["WARC-Type"], digest, size, _page(refers) if refers else None, name.as_py().rpartition("/")[2], at, length))
                rows.sort(key=_key)
                columns = list(zip(*rows)) or [()] * 10
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in CAPTURES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, CAPTURES)


def _key(row: tuple) -> tuple:
    return row[0].encode(), row[1], -1 if row[2] is None else row[2]


def merge_runs(keys: list, starts: list[int]) -> Iterator[int]:
    """Positions of ``keys`` in sorted order. ``starts`` says where each sorted run begins; a loser tree picks the least head.

    Inner node i holds the loser of the match between the winners below it; replacing the overall winner replays only
    the matches on its way up. Of equal heads the earlier run wins.
    """
    k = len(starts)
    heads, ends = list(starts), [*starts[1:], len(keys)]

    def beats(a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; a finished run loses."""
        if heads[a] >= ends[a] or heads[b] >= ends[b]:
            return heads[a] < ends[a] or (heads[b] >= ends[b] and a < b)
        x, y = keys[heads[a]], keys[heads[b]]
        return x < y or (x == y and a < b)

    losers = [0] * k
    winners = [0] * k + list(range(k))  # node i has the children 2i and 2i+1, leaves are k to 2k-1
    for i in range(k - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        winners[i], losers[i] = (a, b) if beats(a, b) else (b, a)
    champion = winners[1] if k > 1 else 0
    for _ in range(len(keys)):
        yield heads[champion]
        heads[champion] += 1
        i = (champion + k) // 2
        while i:
            if beats(losers[i], champion):
                losers[i], champion = champion, losers[i]
            i //= 2


def merge_index(captures: DataFrame, each: int = 100_000) -> DataFrame:
    """``captures`` (from ``read``) in global order of URL key, timestamp and page_id, as the order of its partitions."""
    parts = partitions_for(captures.count(), each)
    ranged = captures.repartitionByRange(parts, *ORDER)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = [_key(row) for row in zip(*(rows[c].to_pylist() for c in ORDER))]
        # Pieces of runs arrive whole but in any order: wherever the key falls, another one begins.
        starts = [0, *(k for k in range(1, len(keys)) if keys[k] < keys[k - 1])]
        yield from rows.take(pa.array(list(merge_runs(keys, starts)), pa.int64())).to_batches(max_chunksize=10_000)

    return ranged.mapInArrow(work, captures.schema)
