import hashlib
import os
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from tickloom.functions import store
from tickloom.llm import queries
from tickloom.llm import telephony as T

TABLES = "/root/testdata/sf0.01"


def one_block(data):
    """IMA ADPCM of one block, a sample at a time."""
    now, index = int.from_bytes(data[:2], "little", signed=True), min(data[2], 88)
    out = [now]
    for byte in data[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(T.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + ((step >> 1) if code & 2 else 0) + ((step >> 2) if code & 1 else 0)
            now = max(-32768, min(32767, now - change if code & 8 else now + change))
            index = max(0, min(88, index + int(T.INDEX_MOVES[code & 7])))
            out.append(now)
    return out


def test_adpcm_across_blocks_equals_one_at_a_time():
    data = np.random.default_rng(0).integers(0, 256, (50, 64), dtype=np.uint8)
    assert T.decode_adpcm(data).tolist() == [one_block(bytes(row)) for row in data]


@pytest.mark.parametrize("codec", ["mulaw", "alaw"])
def test_tables(codec):
    table = T.TABLES[codec].astype(int)
    # known corners of the two laws
    corners = {"mulaw": {0x00: -32124, 0x80: 32124, 0x7F: 0, 0xFF: 0}, "alaw": {0x55: -8, 0xD5: 8, 0x2A: -32256, 0xAA: 32256}}[codec]
    assert {k: table[k] for k in corners} == corners
    assert (T.expand(T.compress(table, codec), codec) == table).all()


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima_adpcm", "pcm"])
@pytest.mark.parametrize("size", [0, 1, 64, 65, 1000])
def test_containers_are_lossless(codec, size):
    data = random.Random(size).randbytes(size)
    assert T.unwav(T.wav(codec, data)) == (codec, 8000, data)


def test_damaged_containers_raise():
    for bad in (b"", b"RIFF", T.wav("alaw", b"abc")[:-2], b"x" * 60):
        with pytest.raises(ValueError):
            T.unwav(bad)


def tone(rate, hertz, samples=8000):
    return (8000 * np.sin(2 * np.pi * hertz * np.arange(samples) / rate)).astype(np.int16)


def test_resampling_keeps_a_tone():
    for rate, to in ((8000, 16000), (8000, 12000), (16000, 8000), (8000, 44100), (8000, 2000)):
        out = T.resample(tone(rate, 300), rate, to)
        assert len(out) == -(-8000 * to // rate)
        want = 8000 * np.sin(2 * np.pi * 300 * np.arange(len(out)) / to)
        assert np.abs(out - want)[len(out) // 8 : -len(out) // 8].max() < 100


@pytest.mark.parametrize("rate, to", [(16000, 8000), (44100, 8000), (8000, 2000)])
def test_tones_above_the_new_limit_are_gone(rate, to):
    for times in (1.1, 1.3, 1.6, 1.9):
        out = T.resample(tone(rate, times * to / 2, 40000), rate, to)
        assert np.abs(out[len(out) // 8 : -len(out) // 8].astype(float)).max() < 80  # 40 dB below 8000
    kept = T.resample(tone(rate, 0.8 * to / 2, 40000), rate, to)[500:-500]
    assert 7900 < np.sqrt(2 * np.mean(kept.astype(float) ** 2)) < 8100


def test_payloads_are_read_back(spark):
    texts = ["", None, "é", "x" * 64, "x" * 65, "same", "same", "long " * 40000]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, f string")
    read = T.decode(T.store_payloads(docs), out="g")
    out = {r.doc_id: r for r in read.collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data += b"\0" * (-len(data) % 64 if data else 64)
        g = out[i].g
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(out[i].media), hashlib.sha256(out[i].media).hexdigest())
    assert out[5].g == out[6].g
    for i in range(len(texts)):
        codec, rate, data = T.unwav(out[i].media)
        assert rate == T.RATES[codec]
        assert out[i].g.codec == codec and out[i].g.pcm == T.resample(T.decode_many([(codec, data)])[0], rate, 8000).tobytes()
    told = {r.doc_id: r.feature for r in T.features(read.select("doc_id", "g.*")).collect()}
    assert told == {i: T.describe(np.frombuffer(out[i].g.pcm, "<i2"), out[i].g.codec) for i in out}
    twice = T.decode(T.store_payloads(docs.where("doc_id = 7")), rate=16000).first().d.pcm
    assert twice == T.resample(T.decode_many([(codec, data)])[0], rate, 16000).tobytes()
    gone = T.decode(spark.createDataFrame([(1, None)], "doc_id long, media binary")).select("d.*")
    assert gone.first().pcm is None and T.features(gone).first().feature is None
    assert T.features(T.decode(T.store_payloads(docs.where("false"))).select("d.*")).collect() == []


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima_adpcm"])
def test_pcm_comes_back_from_its_stored_form(codec):
    rng = np.random.default_rng(1)
    for size in (0, 1, 64, 1001):
        for pcm in (T.expand(rng.integers(0, 256, size), "alaw"), T.expand(rng.integers(0, 256, size), "mulaw"), rng.integers(-32768, 32768, size).astype("<i2")):
            assert T.grow(*T.shrink(pcm, codec)).tolist() == pcm.tolist()
    assert T.shrink(T.expand(np.arange(256), "alaw"), "alaw")[0][514:] == bytes(range(256))


def test_stored_audio_is_read_back_and_checked(spark):
    texts = ["", None, "é", "x" * 64, "x" * 65, "\x7f", "long " * 40000] + [f"text {i}" for i in range(40)]
    media = T.store_payloads(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("text")
    media = media.union(spark.createDataFrame([(99, None)], "doc_id long, media binary"))
    for rate in (8000, 16000):
        want = {r.doc_id: r.d for r in T.decode(media, rate=rate).collect()}
        stored = T.with_pcm(media, rate=rate).select("doc_id", "a.*")
        assert {r.doc_id: r.d for r in T.read_back(stored, rate=rate).collect()} == {k: v if k != 99 else want[99] for k, v in want.items()}
    assert T.read_back(T.with_pcm(media.where("false")).select("a.*")).collect() == []
    rows = T.with_pcm(media).select("doc_id", "a.*").where("length(low) > 0").limit(1).collect()
    other = [(r.doc_id, bytes(r.audio), r.size, bytes(r.high), bytes(r.low[:-1]) + bytes([r.low[-1] ^ 1])) for r in rows]
    with pytest.raises(Exception, match="not that of the stored container"):
        T.read_back(spark.createDataFrame(other, "doc_id long, audio binary, size long, high binary, low binary")).collect()


def test_containers_whose_size_is_unknown_or_that_bytes_follow(spark):
    whole = T.wav("mulaw", bytes(range(64)), 8000)
    odd = [whole[:4] + b"\xff" * 4 + whole[8:], whole[:4] + bytes(4) + whole[8:], whole + b"more"]
    media = spark.createDataFrame(list(enumerate(odd)), "doc_id long, media binary")
    want = {r.doc_id: r.d for r in T.decode(media).collect()}
    assert {r.doc_id: r.d for r in T.read_back(T.with_pcm(media).select("doc_id", "a.*")).collect()} == want


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
def test_the_query_stores_all_audio_within_its_disk(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(queries, "cut", lambda df, name, **options: kept.append(store.cut(df, name, **options)) or kept[-1])
    rows = queries.op3_telephony(spark, TABLES).count()
    files = [Path(f.removeprefix("file:").replace("///", "/")) for df in kept for f in df.inputFiles()]
    assert sum(f.stat().st_size for f in files) < 1.5 * os.path.getsize(f"{TABLES}/documents.parquet")
    # container and PCM of every document can be read from there, the PCM without a codec
    stored = [r for df in kept for r in df.collect()]
    assert len(stored) == rows
    for r in stored[:200]:
        codec, rate, data = T.unwav(bytes(r.audio[: r.size]))
        assert len(data) == max(64, -(-r.n_bytes // 64) * 64)
        assert T.grow(bytes(r.audio[r.size :]), bytes(r.high), bytes(r.low)).tolist() == T.resample(T.decode_many([(codec, data)])[0], rate, 8000).tolist()


def test_the_query_resamples_the_audio_of_every_codec(spark, monkeypatch, tmp_path):
    kept = []
    monkeypatch.setattr(queries, "cut", lambda df, name, **options: kept.append(store.cut(df, name, **options)) or kept[-1])
    texts = [None, "", "long " * 4000] + [f"text {i}" for i in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    told = {r.doc_id: r.feature for r in queries.op3_telephony(spark, f"file://{tmp_path}").collect()}
    stored = {r.doc_id: r for df in kept for r in df.collect()}
    assert stored.keys() == told.keys() == set(range(len(texts)))
    codecs = set()
    for k, r in stored.items():
        codec, rate, data = T.unwav(bytes(r.audio[: r.size]))
        own = T.decode_many([(codec, data)])[0]
        pcm = T.grow(bytes(r.audio[r.size :]), bytes(r.high), bytes(r.low))
        assert rate == 8000 and len(pcm) == 2 * len(own)
        assert pcm.tolist() == T.resample(own, 8000, 16000).tolist() and told[k] == T.describe(pcm, codec)
        codecs.add(codec)
    assert codecs == {"mulaw", "alaw", "ima_adpcm"}
