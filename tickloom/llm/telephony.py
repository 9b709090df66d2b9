"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded to 16-bit PCM and resampled.

The companded codes are expanded by lookup tables of 256 entries, built from the codes' rule. ADPCM blocks are decoded
with numpy across blocks: every block of a batch advances by one sample per step, so the steps are those of one
block however much audio there is. PCM is resampled by a windowed-sinc filter for each phase of the ratio.
Stored audio is a container with its resampled PCM in a lossless form, in one table; the reader decodes the container again and
raises where the stored PCM is another.

Nulls and edge cases: null bytes are stored as null and decode to null; empty audio is a container without samples and
decodes to no samples; a truncated last ADPCM block is decoded as far as its bytes go by padding it with zeros; an unknown or damaged container
raises; other columns are kept as they are. Audio is worked on whole, in a slice of its own where it is long, as long as its PCM (up to
eight bytes for one of ADPCM at twice its rate) stays below Arrow's 2 GiB for a value.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import prepare, slices, tidy

# Format tags of the container, by the registry of wave formats.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}
NAMES = {tag: name for name, tag in TAGS.items()}
# The step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
        494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
        10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
BLOCK = 64


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, part = code & 15, code >> 4 & 7
    size = np.where(part == 0, (step << 4) + 8, ((step << 4) + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}


def expand(codes: np.ndarray, codec: str) -> np.ndarray:
    """16-bit samples of companded bytes."""
    return TABLES[codec].take(codes)


def compress(samples: np.ndarray, codec: str) -> np.ndarray:
    """The byte whose expansion is nearest to each sample (of equally near ones, that of the smaller expansion)."""
    table = TABLES[codec].astype(np.int32)
    order = np.argsort(table, kind="stable")
    levels = table[order]
    right = np.clip(np.searchsorted(levels, samples), 1, 255)
    left = right - 1
    nearer = np.where(np.abs(samples - levels[left]) <= np.abs(levels[right] - samples), left, right)
    return order[nearer].astype(np.uint8)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, one row each: a 4-byte head (sample, step index, 0), then two codes a byte."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0], now = head, head
    for k, code in enumerate(codes):
        step, size = STEPS.take(index), code & 7
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        now = np.clip(now + np.where(code & 8, -change, change), -32768, 32767)
        out[k + 1] = now
        index = np.clip(index + INDEX_MOVES.take(size), 0, len(STEPS) - 1)
    return np.ascontiguousarray(out.T)


def wav(codec: str, data: bytes, rate: int = 8000) -> bytes:
    """A mono RIFF/WAVE container around the codec's bytes."""
    bits, align = (4, BLOCK) if codec == "ima_adpcm" else (16, 2) if codec == "pcm" else (8, 1)
    per_block = 2 * (BLOCK - 4) + 1
    speed = rate * BLOCK // per_block if codec == "ima_adpcm" else rate * align
    extra = struct.pack("<HH", 2, per_block) if codec == "ima_adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, speed, align, bits) + extra
    pad = b"\0" * (len(data) % 2)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data of a container; chunks that are not needed are stepped over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE container")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if form is None or form[0] not in NAMES or at + 8 + size > len(media):
                break
            return NAMES[form[0]], form[2], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("the container has no known format or is cut short")


#: Zero crossings of the resampling filter on each side, and its cut-off by the smaller of the two limits of Nyquist.
CROSSINGS, CUTOFF = 24, 0.92
#: Resampled samples of a phase that are worked on at once.
PART = 1 << 16


def filters(up: int, down: int) -> np.ndarray:
    """Hann-windowed sinc taps, a row for each of the ``up`` phases; their reach grows with the ratio, so that the stop band stays as deep."""
    wide = max(up, down) / up
    half = int(np.ceil(CROSSINGS * wide))
    taps = np.arange(-half + 1, half + 1)
    rows = []
    for phase in range(up):
        x = taps - phase / up
        row = np.sinc(x * CUTOFF / wide) * np.cos(np.pi * np.clip(x / half, -1, 1) / 2) ** 2
        rows.append(row / row.sum())
    return np.array(rows, np.float32)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples of ``rate`` a second as those of ``to`` a second; silence is assumed beyond the ends."""
    if rate == to or not len(pcm):
        return pcm
    up, down = to // np.gcd(rate, to), rate // np.gcd(rate, to)
    count = -(-len(pcm) * up // down)
    table = filters(up, down)
    half = table.shape[1] // 2
    padded = np.zeros(len(pcm) + 2 * half, np.float32)
    padded[half - 1 : half - 1 + len(pcm)] = pcm
    out = np.empty(count, "<i2")
    for k in range(up):  # outputs of one phase are a strided convolution
        at, phase = divmod(k * down, up)
        for start in range(k, count, up * PART):
            first = at + (start - k) // up * down
            n = len(out[start : start + up * PART : up])
            acc = np.zeros(n, np.float32)
            for j, tap in enumerate(table[phase]):
                acc += tap * padded[first + j :: down][:n]
            out[start : start + up * PART : up] = np.clip(np.rint(acc), -32768, 32767)
    return out


def decode_many(parts: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM of many (codec, data) pairs; ADPCM blocks of all of them are decoded together."""
    blocks, counts = [], []
    for codec, data in parts:
        if codec == "ima_adpcm":
            data += b"\0" * (-len(data) % BLOCK)
            blocks.append(np.frombuffer(data, np.uint8))
            counts.append(len(data) // BLOCK)
    found = decode_adpcm(np.concatenate(blocks).reshape(-1, BLOCK)) if sum(counts) else np.zeros((0, 2 * (BLOCK - 4) + 1), np.int16)
    ends = iter(np.cumsum(counts).tolist())
    sizes = iter(counts)
    out = []
    for codec, data in parts:
        if codec == "ima_adpcm":
            end = next(ends)
            out.append(found[end - next(sizes) : end].reshape(-1))
        elif codec == "pcm":
            out.append(np.frombuffer(data, "<i2"))
        else:
            out.append(expand(np.frombuffer(data, np.uint8), codec))
    return out


def codec_of(data: bytes) -> str:
    """A codec by the bytes themselves, so that equal audio is stored alike."""
    return ("mulaw", "alaw", "ima_adpcm")[zlib.crc32(data) % 3]


#: Samples a second of each codec's audio: the telephone rate.
RATES = {"mulaw": 8000, "alaw": 8000, "ima_adpcm": 8000}
#: Samples a second of the PCM that an operator makes unless told otherwise.
STORED = 8000
#: Samples a second of the PCM that the registered query stores: not the rate of any codec, so all audio is resampled.
WIDE = 16000


def store_payloads(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with the UTF-8 bytes of ``text`` (null: none), zero-padded to whole ADPCM blocks, as a WAV in ``out``."""
    prepare(docs.sparkSession)

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            rows = []
            for value in pc.fill_null(batch.cast(pa.large_string()), "").cast(pa.large_binary()):
                data = value.as_py()
                data += b"\0" * (-len(data) % BLOCK if data else BLOCK)
                rows.append(wav(codec_of(data), data, RATES[codec_of(data)]))
            yield pa.array(rows, pa.binary())

    return docs.withColumn(out, of(F.col(text)))


READ = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,codec:string,pcm:binary>"


def describe(pcm: np.ndarray, codec: str) -> str:
    """Codec, samples, root mean square, peak and zero crossings of PCM, and the hash of its bytes."""
    wide = pcm.astype(np.float64)
    crossings = int(np.count_nonzero(np.signbit(wide[1:]) != np.signbit(wide[:-1])))
    power = float(np.sqrt(np.mean(wide * wide))) if len(wide) else 0.0
    return f"{codec}:{len(pcm)}:{power:.3f}:{int(np.abs(wide).max(initial=0))}:{crossings}:{hashlib.sha256(np.ascontiguousarray(pcm, '<i2').data).hexdigest()[:16]}"


def _opened(whole: list[bytes | None], rate: int) -> Iterator[tuple | None]:
    """Of each container: its bytes, codec, data, and the PCM resampled to ``rate``; None for null."""
    held = [unwav(v) if v is not None else None for v in whole]
    found = iter(decode_many([(c, d) for c, _, d in filter(None, held)]))
    for v, h in zip(whole, held):
        yield (v, h[0], h[2], np.ascontiguousarray(resample(next(found), h[1], rate), "<i2")) if h is not None else None


def _digests(media: bytes, codec: str, data: bytes, pcm: bytes) -> tuple:
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), codec, pcm


def _structs(rows: list[tuple | None], names: list[str], kinds: list[pa.DataType]) -> pa.StructArray:
    columns = list(zip(*(r if r is not None else (None,) * len(names) for r in rows))) or [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_READ = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "pcm"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def decode(media: DataFrame, column: str = "media", out: str = "d", rate: int = STORED) -> DataFrame:
    """``media`` with what its containers hold: digests of the payload and of the container, and the PCM resampled from the container's rate to ``rate``, little-endian 16-bit."""
    prepare(media.sparkSession)

    @F.arrow_udf(READ)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            for part in slices(batch.cast(pa.large_binary())):
                yield _structs([_digests(*x[:3], x[3].tobytes()) if x else None for x in _opened([v.as_py() for v in part], rate)], *_READ)

    return media.withColumn(out, of.asNondeterministic()(F.col(column)))


def _places(palette: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    out[palette.view(np.uint16)] = np.arange(len(palette))
    return out


_PLACES = {codec: _places(table) for codec, table in TABLES.items()}


def shrink(pcm: np.ndarray, codec: str) -> tuple[bytes, bytes, bytes]:
    """PCM in a lossless form that compresses well: a palette and a byte a sample where the law's 256 levels are all that it has, else its high and its low bytes."""
    pcm = np.ascontiguousarray(pcm, "<i2")
    if codec in TABLES:
        places = _PLACES[codec].take(pcm.view(np.uint16))
        if np.array_equal(TABLES[codec].take(places), pcm):
            return struct.pack("<H", 256) + TABLES[codec].astype("<i2").tobytes() + places.tobytes(), b"", b""
    sides = pcm.view(np.uint8)
    return struct.pack("<H", 0), sides[1::2].tobytes(), sides[0::2].tobytes()


def grow(head: bytes, high: bytes, low: bytes) -> np.ndarray:
    """The PCM that ``shrink`` was given; needs no codec."""
    levels = struct.unpack_from("<H", head)[0]
    if levels:
        return np.frombuffer(head, "<i2", levels, 2).take(np.frombuffer(head, np.uint8, offset=2 + 2 * levels))
    out = np.empty((len(low), 2), np.uint8)
    out[:, 0], out[:, 1] = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
    return out.reshape(-1).view("<i2")


#: The Parquet writer's options for stored audio: pages of several MB, so that a window of zstd spans many documents, in row groups that a reader can hold.
PAGES = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(8 << 20), "parquet.compression.codec.zstd.level": "9", "parquet.enable.dictionary": "false"}
FORM = "struct<audio:binary,size:bigint,high:binary,low:binary>"


def with_pcm(media: DataFrame, column: str = "media", out: str = "a", rate: int = STORED) -> DataFrame:
    """``media`` with what is stored of each container: ``audio``, its ``size`` bytes and behind them the head of its resampled PCM, and the ``high`` and ``low`` bytes of PCM that has no palette.

    A law's PCM of its own rate has the law's levels as palette, so its places repeat bytes of the container next to them, and compression finds that.
    """
    prepare(media.sparkSession)

    @F.arrow_udf(FORM)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            for part in slices(batch.cast(pa.large_binary())):
                rows: list[tuple | None] = []
                for x in _opened([v.as_py() for v in part], rate):
                    head, high, low = shrink(x[3], x[1]) if x else (b"", b"", b"")
                    rows.append((x[0] + head, len(x[0]), high, low) if x else None)
                yield _structs(rows, ["audio", "size", "high", "low"], [pa.binary(), pa.int64(), pa.binary(), pa.binary()])

    return media.withColumn(out, of.asNondeterministic()(F.col(column)))


def read_back(stored: DataFrame, out: str = "d", rate: int = STORED) -> DataFrame:
    """``stored``, with columns audio, size, high and low, with what ``decode`` says of its containers and the stored PCM; raises where that is not what the stored container decodes to."""
    prepare(stored.sparkSession)

    @F.arrow_udf(READ)
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for audio, size, high, low in tidy(batches):
            done = 0
            for part in slices(audio.cast(pa.large_binary())):
                rows: list[tuple | None] = []
                whole = [v.as_py() for v in part]
                ends = size.slice(done, len(whole)).to_pylist()
                media = [v[:n] if v is not None else None for v, n in zip(whole, ends)]
                for at, (x, v, n) in enumerate(zip(_opened(media, rate), whole, ends), done):
                    if x is None:
                        rows.append(None)
                        continue
                    pcm = grow(v[n:], high[at].as_py(), low[at].as_py())
                    if not np.array_equal(pcm, x[3]):
                        raise ValueError("the stored PCM is not that of the stored container")
                    rows.append(_digests(*x[:3], pcm.tobytes()))
                done += len(whole)
                yield _structs(rows, *_READ)

    return stored.withColumn(out, of.asNondeterministic()(F.col("audio"), F.col("size"), F.col("high"), F.col("low")))


def features(stored: DataFrame, codec: str = "codec", pcm: str = "pcm", out: str = "feature") -> DataFrame:
    """``stored`` with a description of its PCM; null where there is none."""
    prepare(stored.sparkSession)

    @F.arrow_udf("string")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for codecs, samples in tidy(batches):
            yield pa.array([describe(np.frombuffer(x.as_buffer(), "<i2"), c.as_py()) if x.is_valid else None for c, x in zip(codecs, samples)], pa.string())

    return stored.withColumn(out, of(F.col(codec), F.col(pcm)))
