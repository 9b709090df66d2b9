import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total if total else 0
            score = 0
            for t in plain_terms(text):
                df = sum(t in d for _, d in held)
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("text", [None, "", "  .,", "Éa1_b ÉA1-É\x00x\x7fY", "日本 語A", "w" * 50])
def test_terms(text):
    assert {k.decode(): v for k, v in lexical.terms(text.encode() if text else None).items()} == Counter(plain_terms(text))


def test_terms_of_a_text_that_is_split_as_it_is_read(monkeypatch):
    monkeypatch.setattr(lexical, "PART", 5)
    text = "one two,three  four " * 9 + "abcdefghijklm"
    assert {k.decode(): v for k, v in lexical.terms(text.encode()).items()} == Counter(plain_terms(text))


def test_numbers_as_bytes():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in (1, 7, 8, 14, 21, 28, 31)] + [[0, 127, 128, 2**31 - 1]]).astype(np.int32)
    data, at = lexical.to_bytes(values)
    assert (lexical.from_bytes(data.tobytes()) == values).all() and at[-1] == len(data)


def test_best_pairs_bound_every_posting():
    rng = np.random.default_rng(2)
    block = np.sort(rng.integers(0, 9, 400))
    block = np.unique(block, return_inverse=True)[1]
    tf, length = rng.integers(1, 6, 400), rng.integers(1, 40, 400)
    best = lexical.best_pairs(block, tf, length)
    for b in range(block.max() + 1):
        own, top = np.flatnonzero(block == b), best[block[best] == b]
        assert len(top) and all(((tf[top] >= tf[i]) & (length[top] <= length[i])).any() for i in own)
        assert not any((tf[top] >= tf[i]).sum() > 1 and ((tf[top] >= tf[i]) & (length[top] <= length[i])).sum() > 1 for i in top)


def made(rng, docs):
    common, rare = [f"c{i}" for i in range(12)], [f"R{i}é" for i in range(300)]
    rows = []
    for i in range(docs):
        words = rng.choices(common, k=rng.randrange(0, 25)) + rng.choices(rare, k=rng.randrange(0, 6))
        rng.shuffle(words)
        rows.append((i * 3, " ".join(words)))
    return rows, [(j, " ".join(rng.choices(common, k=3) + rng.choices(rare, k=rng.randrange(0, 4)))) for j in range(25)]


@pytest.mark.parametrize("block, first, span, postings, together", [(128, 512, 4096, 2_000_000, 128), (4, 8, 16, 900, 7)])
def test_search_equals_scoring_every_document(spark, monkeypatch, block, first, span, postings, together):
    for name, value in (("BLOCK", block), ("FIRST", first), ("RANGE", span)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(9)
    docs, items = made(rng, 400)
    docs += [(None, docs[5][1]), (None, None), (15, docs[7][1]), (15, docs[7][1]), (2000, ""), (2001, "c1 " * 5000)]
    items += [(90, None), (91, "nowhere"), (92, "c1 c1 c1 r7é"), (None, "c2 r8É r9é")]
    rng.shuffle(docs)
    table = spark.createDataFrame([(t, i, 5) for i, t in docs], "text string, doc_id long, shard int").repartition(3)
    asked = spark.createDataFrame([(t, i, "x") for i, t in items] + [("c2", 92, "y")], "text string, item_id long, term string")
    items = [(i, min(t, "c2") if i == 92 else t) for i, t in items]
    index = spark.createDataFrame(lexical.index(table, postings).collect(), lexical.INDEX)
    got = sorted(map(tuple, lexical.search(index, asked, 20, together).collect()), key=str)
    assert got == plain(docs, items, 20)


def test_lists_that_cannot_matter_are_not_decompressed():
    rng = random.Random(3)
    shard = lexical._Shard()
    for i in range(6000):
        shard.add(i, lexical.terms(b" ".join([b"often"] * rng.randrange(0, 2) + [b"filler"] * 10 + ([b"seldom"] * 3 if i % (90 if i < 500 else 1500) == 0 else []))))
    rows = [r for batch in shard.rows(0) for r in batch.to_pylist() if r["term"] in ("often", "seldom")]
    blocks = {t: [(r["first"], r["last"], r["tops"], r["data"]) for r in rows if r["term"] == t] for t in ("often", "seldom")}
    lists = lexical.Lists([500, 4000], [blocks["often"], blocks["seldom"]], 6000, 60_000)
    docs, scores = lists.best([0, 1], [1, 1], 6000, 5)
    assert len(docs) == 5 and len([1 for t, _ in lists.held if t == 0]) < len(blocks["often"]) / 2
    every = Counter()
    for t in (0, 1):
        for b in range(len(lists.data[t])):
            every.update(dict(zip(*(x.tolist() for x in lists.block(t, b)))))
    assert list(zip(docs.tolist(), scores.tolist())) == sorted(every.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.index(docs), items).collect() == []
    assert lexical.search(lexical.index(items.withColumnRenamed("item_id", "doc_id")), items.limit(0)).collect() == []
