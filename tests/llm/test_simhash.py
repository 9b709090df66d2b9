import itertools
import random

import pytest
import xxhash

from tickloom.llm import simhash


def plain_fingerprint(text, width=3):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (id, fingerprint) pairs; all pairs compared."""
    ids = [i for i, _ in prints]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(prints)), 2):
        if (prints[x][1] ^ prints[y][1]).bit_count() <= 2:
            root[find(y)] = find(x)
    groups = {}
    for x in range(len(prints)):
        groups.setdefault(find(x), []).append(ids[x])
    return [min((i for i in groups[find(x)] if i is not None), default=None) for x in range(len(prints))]


@pytest.mark.parametrize("text", ["", None, "one", "One two", "a b c d", "É a  b\tc\nd " * 400, "x y z " * 30000])
def test_fingerprint_agrees_with_a_bit_by_bit_count(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_links_connect_exactly_what_all_pairs_connect(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(rng.randrange(6)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            values.add(base)
    values |= {0, 1, 3, 2**64 - 1, 2**63}
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(values)]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    mask = 2**64 - 1
    got = [roots.get(v, v) for v in signed]
    want = plain_components([(v, v & mask) for v in signed])
    assert got == want


def test_documents_with_nulls_ties_repeats_and_clashing_columns(spark):
    texts = ["", None, "   ", "a b c d e f", "A B C D E F", "a b c d e f", "q", "q", "w " * 50]
    rows = [(i, t, 7, 8) for i, t in enumerate(texts)] + [(None, "q", 7, 8), (3, "a b c d e f", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id long")
    out = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = [(i, f, c) for (i, f), c in zip(prints, plain_components(prints))]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_a_long_chain_settles(spark):
    edges = spark.range(300).selectExpr("id + 1 as fp", "id as hub")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_similar_texts_are_one_group_and_others_stay(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(900)]
    rows, group = [], []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(150, 400))]
        rows.append((len(rows), " ".join(base)))
        group.append(g)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
            group.append(g)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    first = {g: group.index(g) for g in set(group)}
    assert kept >= set(first.values())
    assert len(kept) <= len(first) + 0.06 * (len(rows) - len(first))


def test_sketches_give_exact_similarity_of_short_texts():
    import numpy as np

    a, b = np.array([1, 2, 3, 9], ">u8"), np.array([2, 3, 9, 11], ">u8")
    assert simhash.similarity(a.tobytes(), b.tobytes()) == 3 / 5 and simhash.similarity(b"", b"") == 1.0


def plain_groups(texts):
    """Groups over 2 bits or an exact similarity of 0.8 of five-word shingles; all pairs compared."""
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]
    prints, root = [plain_fingerprint(t, 5) for t in texts], list(range(len(texts)))
    near = []
    for x, y in itertools.combinations(range(len(texts)), 2):
        both = len(sets[x] & sets[y])
        if 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both):
            near.append(both / (len(sets[x]) + len(sets[y]) - both))
        elif (prints[x] ^ prints[y]).bit_count() > 2:
            continue
        a, b = root[x], root[y]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root), near


def test_pairs_just_above_and_below_the_similarity_are_told_apart(spark):
    rng = random.Random(3)
    texts = []
    for g in range(60):
        base = [f"{g}w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))]
        end = round(len(base) * rng.choice([0.76, 0.78, 0.79, 0.81, 0.82, 0.84, 0.86]))
        texts += [" ".join(base), " ".join(base[:end])]
    want, near = plain_groups(texts)
    assert sum(s < 0.86 for s in near) > 15 and len(near) < 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == want


def test_no_text_hides_copies_that_share_its_passage(spark, monkeypatch):
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for g in range(50):
        base = [f"{g}v{k}" for k in range(rng.randrange(10, 120))] + passage
        texts += [" ".join(base[: round(len(base) * cut)]) for cut in (1, 0.9, 0.82)]
    want, _ = plain_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == want
    monkeypatch.setattr(simhash, "PAIRS_EACH", 0, raising=False)  # hubs in rounds, then the rest
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == want


def test_similarity_counts_whole_sets():
    import numpy as np

    a, b = np.arange(1000, dtype=">u8"), np.arange(115, 1115, dtype=">u8")
    assert simhash.similarity(a.tobytes(), b.tobytes()) == 885 / 1115


def test_texts_below_the_similarity_are_not_dropped(spark):
    rng = random.Random(2)
    texts = []
    for g in range(60):
        base = [f"{g}w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(base), " ".join(base[: rng.choice([305, 310, 315])])]
    want, near = plain_groups(texts)
    assert not near
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == want


def test_of_a_group_of_edited_copies_few_pairs_are_held_against_whole_sets(spark):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(f"{g}x{k}" if rng.random() < 0.035 else w for k, w in enumerate(base)) for g in range(80)]
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(146)) for t in texts]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(80), 2)}
    want = {pair for pair, s in alike.items() if s >= 0.8}
    assert want and len(want) < 300
    keyed = simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), 5).selectExpr("key", "size(shingles) n", "odd")
    pairs = keyed.crossJoin(keyed.selectExpr("key other", "n other_n", "odd other_odd")).where("key < other")
    # all 3,160 have as many shingles but for a few
    assert pairs.where("least(n, other_n) * 5L >= greatest(n, other_n) * 4L").count() == len(alike)
    left = {(r.key, r.other) for r in pairs.where(simhash._may_be_similar()).collect()}
    assert want <= left and len(left) < len(want) + 0.03 * len(alike)


def test_parities_differ_in_no_more_bits_than_texts_in_shingles():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 700, 9000):
        common, one, two = (rng.integers(-(2**63), 2**63, k) for k in (n, n // 5, n // 9))
        a, b = simhash.parities(np.concatenate([common, one])), simhash.parities(np.concatenate([common, two]))
        assert len(a) * 64 == simhash.PARITIES and np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(one) + len(two)
