import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tickloom.llm import common, tokens  # noqa: E402

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["the", "Don't", "naïve", "x=1;", " ", " ", "日本語", "ß", "\t", "\n\n", "  ", " ", "...", "a.b", "é", "😀", "1234", "A-Z", "<|endoftext|>", "<|start", "'s", "_y", "\x00", "\x1c"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", None, "word " * 5000]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("alone", [False, True])
def test_ids_are_the_librarys(name, alone):
    path = public_tokenizers.path(name)
    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    assert encoder.between is not None
    if alone:  # as for a vocabulary without a special token
        encoder.between = None
    for seed in range(3):
        given = texts(seed, 700)
        ids, counts = encoder.encode(pa.array(given))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in given]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_a_failed_batch_leaves_nothing_behind(monkeypatch):
    path = public_tokenizers.path(FILES[0])
    encoder = tokens.Encoder(path)
    first = pa.array(["some words here"])
    want = encoder.encode(first)[0].tolist()
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(encoder, "_library", lambda chunks: (_ for _ in ()).throw(RuntimeError()))
        encoder.encode(pa.array(["other words there"]))
    assert encoder.encode(first)[0].tolist() == want
    assert encoder.encode(pa.array(["other words there"]))[0].tolist() == Tokenizer.from_file(path).encode("other words there", add_special_tokens=False).ids


def asked(encoder, monkeypatch):
    """The chunks that the encoder gives to the library from here on."""
    given, library = [], encoder._library
    monkeypatch.setattr(encoder, "_library", lambda chunks: (given.extend(chunks), library(chunks))[1])
    return given


@pytest.mark.parametrize("name", FILES)
def test_marks_are_cut_from_latin_letters(name, monkeypatch):
    path = public_tokenizers.path(name)
    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    given = asked(encoder, monkeypatch)
    text = "été### été!! été d'été's ×÷#3×### ß-ß Ÿ## Ā##"
    assert encoder.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert " été".encode() in given and b"###" in given and " été###".encode() not in given


def test_chunks_met_first_are_kept(monkeypatch):
    path = public_tokenizers.path(FILES[0])
    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 8)
    texts = [" " + " ".join(f"w{chr(97 + k)}{chr(97 + i)}" for i in range(6)) for k in range(9)] + [" naïve ", "\n\n", " é", " 12é3", "a  b"]
    given = asked(encoder, monkeypatch)
    for text in [*texts, *texts]:
        assert encoder.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= 8 + 6 and given.count(b" waa") == 1
    monkeypatch.setattr(tokens, "MOST_BYTES", 0)
    assert encoder.encode(pa.array([texts[0]]))[0].tolist() == plain.encode(texts[0], add_special_tokens=False).ids


def test_plain_words_go_straight_to_the_model():
    path = public_tokenizers.path(FILES[0])
    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    text = "".join(" " * rng.randrange(1, 2) + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(3000))
    want = plain.encode(text, add_special_tokens=False).ids
    encoder.tokenizer = None
    assert encoder.encode(pa.array([text]))[0].tolist() == want


@pytest.mark.parametrize("most", [1, 300, 1 << 20])
def test_batches_are_gathered_whole(most):
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(k, k + n)), "text": [None if i % 5 == 0 else "x" * i for i in range(n)]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) for k, n in ((0, 10), (10, 0), (10, 30), (40, 1))]
    out = list(common.gathered(iter(batches), most))
    assert [r for b in out for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    assert len(out) == {1: 3, 300: 2, 1 << 20: 1}[most]
