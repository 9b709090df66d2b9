import hashlib
import os
import random

import numpy as np
import pytest

from tickloom.llm import ordermin, queries

TABLES = "/root/testdata/sf0.001"
SKETCH = ordermin.Sketch()
MASK = 2**64 - 1


def plain_mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_fingerprint(text, sketch=SKETCH):
    """One k-mer and one permutation after the other."""
    kmers = [text[i : i + sketch.length] for i in range(len(text) - sketch.length + 1)] or ([text] if text else [])
    seen, hashes = {}, []
    for kmer in kmers:
        h = 0
        for c in kmer:
            h = (h * 0x100000001B3 + ord(c)) & MASK
        number = seen[kmer] = seen.get(kmer, -1) + 1
        hashes.append(plain_mixed((plain_mixed(h) + number * 0x9E3779B97F4A7C15) & MASK))
    out = []
    for m in sketch.multipliers().tolist():
        chosen = sorted(sorted(range(len(hashes)), key=lambda i: ((hashes[i] >> 32) * m % 2**32, i))[: sketch.each])
        total = 0
        for i in chosen:
            total = plain_mixed((total * 0x100000001B3 + hashes[i]) & MASK)
        out.append(total >> 32)
    return out


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdeñé😀") for _ in range(rng.randrange(1, 9))) for _ in range(words))


@pytest.mark.parametrize("text", ["", "a", "abcd", "abcde", "abcdef", "a" * 500, "ab ab ab " * 40, "é😀ñ" * 7, prose(random.Random(3), 400), prose(random.Random(4), 12) * 300])
def test_fingerprint_agrees_with_one_permutation_after_the_other(text):
    assert ordermin.fingerprint(text, SKETCH, SKETCH.multipliers()).tolist() == plain_fingerprint(text)


def test_too_few_values_below_the_bound_change_nothing(monkeypatch):
    text = prose(random.Random(8), 300)
    monkeypatch.setattr(ordermin, "EXPECTED", 1)
    assert ordermin.fingerprint(text, SKETCH, SKETCH.multipliers()).tolist() == plain_fingerprint(text)


def test_likeness_falls_with_edits_and_with_moved_passages():
    rng, m = random.Random(5), SKETCH.multipliers()
    text = prose(rng, 600)
    own = ordermin.fingerprint(text, SKETCH, m)

    def near(other):
        return ordermin.likeness(own, ordermin.fingerprint(other, SKETCH, m))

    few = text[:900] + "X" + text[901:2000] + "Y" + text[2000:]
    half = len(text) // 2
    assert near(text) == 1 and near(few) > 0.8 > near(ordermin.edited(text, prose(rng, 600))) > 0.1 > near(prose(rng, 600))
    assert near(text[half:] + text[:half]) < 0.75  # the same k-mers but for those at the cut, in another order


def expected(rows, fingerprint=plain_fingerprint):
    """rows: (doc_id, text) in descending order."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        prints = [np.array(fingerprint(x)) for x in (text, changed, following)]
        hexes = ["".join(f"{v:08x}" for v in p) for p in prints]
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), hexes[0], hexes[1], (prints[0] == prints[1]).mean(), (prints[0] == prints[2]).mean()))
    return sorted(out, key=str)


def rows_of(spark, monkeypatch, frame):
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    return sorted(map(tuple, queries.op12_order_minhash(spark, "").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_rows_equal_a_plain_walk_over_all_documents(spark, monkeypatch, adaptive):
    rng = random.Random(6)
    rows = [(i * 3 - 20, rng.choice([None, "", prose(rng, rng.randrange(1, 60))])) for i in range(40)]
    frame = spark.createDataFrame([(t, i, "x", 1) for i, t in rng.sample(rows, 40)], "text string, doc_id long, part string, role int")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        assert rows_of(spark, monkeypatch, frame) == expected(rows[::-1])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_edge_tables(spark, monkeypatch):
    schema = "doc_id long, text string"
    assert rows_of(spark, monkeypatch, spark.createDataFrame([], schema)) == []
    assert rows_of(spark, monkeypatch, spark.createDataFrame([(5, "one only")], schema)) == expected([(5, "one only")])
    same = [(7, "twice the same"), (7, "twice the same"), (None, None)]
    assert rows_of(spark, monkeypatch, spark.createDataFrame(same, schema)) == expected(same)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
def test_registered_query(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    got = queries.op12_order_minhash(spark, TABLES).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(next(d.text for d in docs if d.doc_id == r.doc_id), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(got) == len(docs)
    m = SKETCH.multipliers()
    want = {r[0]: r for r in expected([(r.doc_id, r.text) for r in docs], lambda text: ordermin.fingerprint(text, SKETCH, m))}
    assert {r.doc_id: (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want
