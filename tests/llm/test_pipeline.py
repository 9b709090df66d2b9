import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tickloom.llm import packing, simhash  # noqa: E402
from tickloom.llm.common import cut  # noqa: E402
from tickloom.llm.queries import vocabulary  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_fingerprint  # noqa: E402


def tables(path, spark):
    rng = random.Random(0)
    vocabulary_ = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(240):
        words = [rng.choice(vocabulary_) for _ in range(rng.randrange(20, 200))]
        junk, toxic = i % 6 == 0, i % 7 == 3
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "zagg" + rng.choice(vocabulary_))
        text = " ".join(w + "%%%" for w in words) if junk else " ".join(words)
        docs.append((i, text, rng.choice(["en", "de"]), f"src{i % 4}", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    for k, of in enumerate((1, 1, 2, 4)):
        docs.append((900 + k, *docs[of][1:]))
    docs.append((950, None, None, None, 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, labels


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs, labels = tables(path, spark)
    truth = {i: (q, t) for i, q, t in labels}
    frame = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = cut(stage(spark, frame, path), "test")
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in frame.collect()}
        assert kept[name].items() <= {r.doc_id: r.text for r in before.collect()}.items()
    good = {i for i, (q, _) in truth.items() if q == 1}
    assert len(good - kept["quality"].keys()) <= 2 and not {i for i, (q, _) in truth.items() if q == 0} & kept["quality"].keys()
    clean = {i for i in good if truth[i][1] == 0}
    assert len(clean - kept["toxicity"].keys()) <= 2 and len({i for i in good if truth[i][1] == 1} & kept["toxicity"].keys()) <= 2
    rows = sorted(kept["toxicity"].items())
    groups = plain_components([(i, plain_fingerprint(t, 5)) for i, t in rows])
    assert kept["near duplicates"].keys() == set(groups)
    assert 0.85 < sum(len(t.split()) for t in kept["mixing"].values() if t) / sum(len(t.split()) for t in kept["near duplicates"].values() if t) <= 0.9
    out = corpus_pipeline.STAGES[-1][1](spark, frame, path).collect()
    want = packing.pieces(frame, vocabulary("word_bpe_49k.json"), end_id=1).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in want)


def test_representatives_of_repeats_and_nulls(spark):
    rows = [(3, "a b c d e f", 1), (3, "a b c d e f", 1), (2, "A b c d e f", 2), (None, "a b c d e f", 3), (None, None, 4), (None, None, 4), (9, "other text", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = simhash.representatives(docs)
    assert out.columns == ["doc_id", "text", "fp"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(2, "A b c d e f"), (9, "other text"), (None, None)], key=str)


def test_columns_of_any_name_pass_the_stages(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs, _ = tables(path, spark)
    odd = ["row", "h", "score", "copies", "epoch", "__score", "__text", "id", "label", "fp", "key"]
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for k, name in enumerate(odd):
        frame = frame.withColumn(name, frame.doc_id * 100 + k)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = cut(stage(spark, frame, path), "test")
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", *odd]
    rows = frame.collect()
    assert rows and all(r[name] == r.doc_id * 100 + k for r in rows for k, name in enumerate(odd))


def test_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
