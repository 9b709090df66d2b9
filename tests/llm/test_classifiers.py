import itertools
import random

import numpy as np
import pyarrow as pa

from tickloom.llm import quality, toxicity, words


def corpus(n, seed=1):
    """Documents of made-up words; junk repeats marks, toxic ones hold words with a telling beginning."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        junk, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), "zagg" + rng.choice(vocabulary))
        if junk:
            text = [w + "%%%" for w in text]
        rows.append((i, " ".join(text), "en", 1.0))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, "", "en", 0.0), (n + 1, None, "en", 0.0), (n + 2, "w " * 40000, "en", 0.0)]
    labels += [(n + 9, 1, 1), (n, None, None)]
    return rows, labels


def test_marginals_agree_with_a_sum_over_all_paths():
    rng = np.random.default_rng(0)
    moves = rng.normal(size=(2, 2))
    lengths = [0, 1, 2, 9, 0, 5]
    log_odds = rng.normal(size=sum(lengths)) * 2
    starts = np.concatenate([[0], np.cumsum(lengths)])
    p, _, _ = toxicity.marginals(log_odds, starts, moves)
    for a, b in zip(starts[:-1], starts[1:]):
        if a == b:
            continue
        weights = {}
        for path in itertools.product((0, 1), repeat=b - a):
            total = moves[0, path[0]] + sum(moves[x, y] for x, y in zip(path, path[1:]))
            weights[path] = np.exp(total + sum(log_odds[a + k] for k, s in enumerate(path) if s))
        for k in range(b - a):
            want = sum(w for path, w in weights.items() if path[k]) / sum(weights.values())
            assert abs(p[a + k] - want) < 1e-9


def test_marginals_of_long_texts_do_not_depend_on_the_runs(monkeypatch):
    rng = np.random.default_rng(1)
    log_odds, starts, moves = rng.normal(size=1000) * 3, np.array([0, 700, 700, 1000]), rng.normal(size=(2, 2))
    whole, _, _ = toxicity.marginals(log_odds, starts, moves)
    monkeypatch.setattr(toxicity, "RUN", 7)
    cut, _, _ = toxicity.marginals(log_odds, starts, moves)
    assert np.allclose(whole, cut, atol=1e-12)


def test_log_odds_without_slots_are_the_same():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=(1 << toxicity.BITS) + 1), np.zeros((2, 2)))
    texts = pa.array(["", "one Two, three-four! one", None, "x", "idiot idiot Wordlonger"])
    want, starts, _ = toxicity.emissions(texts, model)
    got, same = toxicity.log_odds_of(texts, model)
    assert np.allclose(want, got) and (starts == same).all()


def test_words_of_blank_and_null_texts():
    codes, starts, names = words.split(pa.array(["a b a", None, "", "  ", " b\n c "]))
    assert starts.tolist() == [0, 3, 3, 3, 3, 5]
    assert [names[c].as_py() for c in codes] == ["a", "b", "a", "b", "c"]


def test_ftrl_keeps_given_weights_until_it_learns():
    weights = np.array([0.0, 0.4, -1.2, 0.05])
    assert np.allclose(quality.Ftrl(weights).weights(np.arange(4)), weights)


def test_sparse_scores_equal_a_plain_sum():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=1 << quality.BITS)
    texts = ["One two two, THREE!!", "", None, "x"]
    got = quality.raw_scores(pa.array(texts), weights, 0.5)
    for text, value in zip(texts, got):
        codes, starts, own, mark, pairs = quality.features(pa.array([text]))
        plain = 0.5 + sum(weights[own[c]] + weights[mark[c]] + weights[p] for c, p in zip(codes, pairs)) / max(len(codes), 1) ** 0.5
        assert abs(plain - value) < 1e-9


def test_quality_learns_held_out_documents(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = quality.fit(quality.sample(docs, marks.where("doc_id < 400"), "quality", 300), shards=2)
    scored = quality.score(docs, weights, out="p").collect()
    assert len(scored) == len(rows) and scored[0].asDict().keys() == {"doc_id", "text", "lang", "score", "p"}
    truth = {i: q for i, q, _ in labels if i >= 400 and q is not None}
    right = [(r.p >= 0.3) == (truth[r.doc_id] == 1) for r in scored if r.doc_id in truth]
    assert len(right) == 200 and np.mean(right) > 0.95
    assert all(0 <= r.p <= 1 for r in scored)


def test_toxicity_learns_held_out_documents_and_their_spans(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(quality.sample(docs, marks.where("doc_id < 400"), "toxic", 400))
    out = toxicity.tag(toxicity.score(docs, model, out="p"), model).collect()
    truth = {i: t for i, _, t in labels if i >= 400 and t is not None}
    right = [(r.p >= 0.3) == (truth[r.doc_id] == 1) for r in out if r.doc_id in truth]
    assert len(right) == 200 and np.mean(right) > 0.97
    found = [r.text[s.start : s.end] for r in out if r.doc_id >= 400 and r.text for s in r.toxic_spans]
    assert found and np.mean(["zagg" in f for f in found]) > 0.9
    assert all(r.p < 0.3 and not r.toxic_spans for r in out if not r.text)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(quality.sample(docs, none, "quality", 10))).first().score == 0.5
    assert toxicity.score(docs, toxicity.fit(quality.sample(docs, none, "toxic", 10))).first().score < 1e-6
    assert quality.score(docs.limit(0), np.zeros((1 << quality.BITS) + 1)).count() == 0
