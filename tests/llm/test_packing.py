import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tickloom.llm import packing, tokens  # noqa: E402

ODD = ["", None, "  two  spaces\n\n x", "nb  sp   x", "a   b", "it's don't <|endoftext|> x.y", "É É ́x", "\x1c a \x1f  b", "tab\t\tx \n", " ", "x" * 900, "日本 語　 t", "A,'s B...c d!!? ». E", "don't! I'LL; we've", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|>y", "<|ENDOFTEXT|> z", "a\x01b \x01", "ends in spaces \n\n", "\n\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_equal_the_librarys(name):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "Be", " ", "  ", "\n", ".", "'s", "é", " ", "7", "%", "-"]) for _ in range(40)) for _ in range(400)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    encoder = tokens.Encoder(public_tokenizers.path(name))
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for text, end, n in zip(texts, ends, counts):
            assert ids[end - n : end].tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)
        assert int(ends[-1]) == len(ids)


def test_child_keeps_every_piece_and_no_bin_overflows():
    rng = random.Random(1)
    lengths = np.array([rng.randrange(1, 4096) for _ in range(500)])
    a = packing.best_fit(lengths, np.argsort(-lengths), np.full(500, -1), 4096)
    b = packing.best_fit(lengths, np.arange(500), np.full(500, -1), 4096)
    child = packing.crossover(lengths, a, b, 4096, rng)
    assert len(child) == 500 and child.min() == 0
    assert np.bincount(child, weights=lengths).max() <= 4096 and (np.bincount(child) > 0).all()
    best, _ = packing.evolve(lengths, [b], 4096, seed=2)
    assert best.max() <= b.max() and np.bincount(best, weights=lengths).max() <= 4096


def triplets(seed, count=20, capacity=4096):
    """Pieces that fit into ``count`` bins without any gap, three to a bin."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1300, 1500, count), rng.integers(1100, 1400, count)
    return np.concatenate([a, b, capacity - a - b])


def test_crossovers_find_what_best_fit_does_not():
    better = 0
    for seed in range(6):
        lengths = triplets(seed)
        plainly = packing.best_fit(lengths, np.argsort(-lengths), np.full(len(lengths), -1), 4096).max() + 1
        packed, bred = packing.evolve(lengths, [], 4096, seed, population=6, generations=60)
        assert bred > 0 and 20 <= packed.max() + 1 <= plainly
        better += packed.max() + 1 < plainly
    assert better >= 4


def test_small_instances_are_packed_as_well_as_can_be():
    rng = random.Random(7)

    def fewest(sizes, bins):
        """Whether the sizes fit into so many bins of 10, by trying all ways."""
        if not sizes:
            return True
        tried = set()
        for k, free in enumerate(bins):
            if free >= sizes[0] and free not in tried:
                tried.add(free)
                if fewest(sizes[1:], [*bins[:k], free - sizes[0], *bins[k + 1 :]]):
                    return True
        return False

    for case in range(25):
        sizes = sorted((rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))), reverse=True)
        best = next(n for n in range(1, 13) if fewest(sizes, [10] * n))
        packed, _ = packing.evolve(np.array(sizes), [], 10, case, generations=40)
        assert packed.max() + 1 == best, sizes


def test_the_packing_comes_from_crossovers_where_the_bound_is_missed(spark):
    rng = np.random.default_rng(3)
    lengths = np.minimum(4095, rng.lognormal(6.3, 1, 3000).astype(int) + 1)
    items = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "rid long, length long")
    grown = packing.pack_instances(items, 2, 4096, islands=2, epochs=1, seed=1).toPandas()
    assert sorted(grown.rid) == list(range(3000)) and grown.crossovers.max() > 0
    for _, own in grown.groupby("instance"):
        assert own.crossovers.iloc[0] > 0 or own.bin.nunique() == -(-int(own.length.sum()) // 4096)
    fill = grown.groupby(["instance", "bin"]).length.sum()
    assert fill.max() <= 4096 and len(fill) <= -(-int(lengths.sum()) // 4096) + 2


def test_every_piece_is_placed_without_gaps(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(rng.choice([0, 3, 700, 2500, 9000])))) for i in range(120)]
    rows += [(None, "x"), (7, rows[7][1]), (8, None)]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, length int, sequence_id int")
    cut_up = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    out = packing.pack(cut_up, each=60).toPandas()
    want = cut_up.toPandas()
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, out[keys].values.tolist())) == sorted(map(str, want[keys].values.tolist()))
    for _, seq in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert seq.length.sum() <= 4096
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = dict(rows)[5]
    ids = plain.encode(text, add_special_tokens=False).ids + [1]
    mine = out[out.doc_id == 5].sort_values("start")
    assert [tokens.crc(np.array(ids[k : k + 4096])) for k in range(0, len(ids), 4096)] == mine.ids_crc32.tolist()
    lengths = want.length.to_numpy()
    plainly = packing.best_fit(lengths, np.argsort(-lengths), np.full(len(lengths), -1), 4096)
    assert out.sequence_id.nunique() <= plainly.max() + 1 + 3  # three instances of 60 pieces


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1)).count() == 0
