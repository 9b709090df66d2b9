import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tickloom.llm import coder, tokenbin  # noqa: E402

VOCABULARY, IDS = public_tokenizers.path("byte_bpe_50k.json"), 50257


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 5000])
@pytest.mark.parametrize("kind", ["random", "same", "text-like", "extremes"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"random": rng.integers(0, IDS, n), "same": np.full(n, IDS - 1), "text-like": rng.zipf(1.3, n) % IDS, "extremes": rng.choice([0, IDS - 1], n)}[kind]
    assert (coder.decode_blocks(coder.encode_blocks(ids, IDS), n, IDS) == ids).all()


@pytest.mark.parametrize("kind", ["random", "skewed", "runs"])
def test_many_short_blocks_round_trip(kind):
    rng = np.random.default_rng(7)
    ids = {"random": rng.integers(0, IDS, 200_001), "skewed": rng.zipf(1.2, 200_001) % IDS, "runs": np.repeat(rng.integers(0, 9, 20_001), 10)}[kind]
    for block in (1, 16, 200):
        assert (coder.decode_blocks(coder.encode_blocks(ids, IDS, block), len(ids), IDS, block) == ids).all()


def test_repetition_is_learnt():
    ids = np.tile(np.arange(40) * 997 % IDS, 200)
    assert sum(map(len, coder.encode_blocks(ids, IDS))) < len(ids) * 0.7


def test_damage_is_noticed():
    ids = np.arange(3000) % 70
    data = bytearray(coder.pack_segment(0, 0, [1], np.array([3000]), ids, IDS))
    data[-200] ^= 0x55
    with pytest.raises(ValueError):
        coder.read_segment(bytes(data), 0, IDS)


def test_files_give_back_every_document_in_order(spark, tmp_path):
    rng = random.Random(2)
    texts = ["", None, "one", "x" * 5000] + [" ".join(rng.choice(["alpha", "Beta", "ga!"]) for _ in range(rng.randrange(900))) for _ in range(150)]
    rows = [(i * 3, t, "s", 1) for i, t in enumerate(texts)] + [(None, "no id", "s", 1), (9, "again", "s", 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, segment int")
    path = f"file://{tmp_path}/ids"
    tokenbin.write(docs, path, VOCABULARY, end_id=0, vocabulary_size=IDS, docs_each=40)
    out = tokenbin.placed(tokenbin.read(spark, path, IDS, with_ids=True)).orderBy("start").collect()
    plain = Tokenizer.from_file(VOCABULARY)
    want = sorted((-1 if i is None else i, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in out) == want
    assert [-1 if r.doc_id is None else r.doc_id for r in out] == [i for i, _ in want]
    start = 0
    for r in out:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokenbin.write(docs, f"file://{tmp_path}/none", VOCABULARY, 0, IDS)
    assert tokenbin.placed(tokenbin.read(spark, f"file://{tmp_path}/none", IDS)).count() == 0
