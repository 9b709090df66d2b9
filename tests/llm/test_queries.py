"""The corpus queries with SQL against DuckDB, and op1's recall against brute force, over the smallest tables."""

import hashlib
import os
import zlib

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")

from tickloom.llm import queries  # noqa: E402

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{table}'")
    frame = queries.QUERIES[name](spark, TABLES)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(str([dict(zip(columns, r))[c] for c in sorted(columns)]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in sorted(columns)]) for r in frame.collect()) == want


def test_recall_of_the_registered_search(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids.tolist()], float)
    found = {}
    for r in queries.op1_neighbours(spark, TABLES).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    hits = []
    for q in asked:
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        hits.append(len(found[ids[q]] & set(ids[np.argsort(-scores)[:20]].tolist())) / 20)
    assert len(found) == len(asked) and np.mean(hits) >= 0.9


def whole(name):
    return duckdb.sql(f"SELECT * FROM '{TABLES}/{name}.parquet'").df()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary(name))


def test_telephony_query(spark):
    texts = {r.doc_id: r.text for r in whole("documents").itertuples()}
    rows = queries.op3_telephony(spark, TABLES).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    alike = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert alike.setdefault(data, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


@pytest.mark.parametrize("name, label, of, out", [("op5_toxicity", "toxic", 4, 2), ("op6_quality", "quality", 5, 0)])
def test_classifier_queries_never_see_the_held_out_labels(spark, tmp_path, name, label, of, out):
    fold = {i: zlib.crc32(str(i).encode()) % of == out for i in whole("documents").doc_id}
    first = {r.doc_id: r for r in queries.QUERIES[name](spark, TABLES).collect()}
    assert first.keys() == fold.keys()
    for i, r in first.items():
        assert r.held_out == fold[i] and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = whole("labels")
    labels[label] = [1 - v if fold[i] else v for i, v in zip(labels.doc_id, labels[label])]
    labels.to_parquet(tmp_path / "labels.parquet")
    os.symlink(f"{TABLES}/documents.parquet", tmp_path / "documents.parquet")
    again = {r.doc_id: r.score for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in first.items())


def test_simhash_query(spark):
    from tests.llm.test_simhash import plain_components, plain_fingerprint

    docs = whole("documents")
    prints = [(int(i), plain_fingerprint(t, 3)) for i, t in zip(docs.doc_id, docs.text)]
    want = dict(zip((i for i, _ in prints), plain_components(prints)))
    rows = queries.op7_simhash(spark, TABLES).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{fp:016x}" for i, fp in prints}
    assert {r.doc_id: r.component_id for r in rows} == want


def test_packing_query(spark):
    plain, docs = library("word_bpe_49k.json"), whole("documents")
    want, total = {}, 0
    for i, t in zip(docs.doc_id, docs.text):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[int(i), k // 4096] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    out = queries.op9_packing(spark, TABLES).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want and len(out) == len(want)
    for _, seq in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert seq.length.sum() <= 4096 and seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist()
    assert out.sequence_id.nunique() == -(-total // 4096)


def test_token_file_query(spark):
    plain, docs = library("byte_bpe_50k.json"), whole("documents").sort_values("doc_id")
    start, rows = 0, {r.doc_id: r for r in queries.op10_token_files(spark, TABLES).collect()}
    assert len(rows) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        r = rows[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline_query(spark):
    plain, texts = library("word_bpe_49k.json"), dict(zip(whole("documents").doc_id, whole("documents").text))
    out = queries.pipeline(spark, TABLES).toPandas()
    assert 20 < out.doc_id.nunique() < len(texts)
    for i, parts in out.sort_values("piece").groupby("doc_id"):
        ids = plain.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert parts.ids_crc32.tolist() == [zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()) for k in range(0, len(ids), 4096)]
    assert out.groupby("sequence_id").length.sum().max() <= 4096


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name, label, of, out, least, where", [("op5_toxicity", "toxic", 4, 2, 0.9, "sf0.1"), ("op6_quality", "quality", 5, 0, 0.95, "sf0.01")])
def test_classifier_queries_tell_held_out_documents_apart(spark, name, label, of, out, least, where):
    """The registered query's scores of labelled documents that it has not learnt from: area under the curve over all pairs."""
    where = f"/root/testdata/{where}"
    scores = {r.doc_id: r.score for r in queries.QUERIES[name](spark, where).collect() if r.held_out}
    labels = duckdb.sql(f"SELECT doc_id, {label} AS y FROM '{where}/labels.parquet' WHERE {label} IS NOT NULL").fetchall()
    held = [(scores[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % of == out]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(held) >= 60 and min(len(good), len(bad)) >= 5 and area >= least, (len(good), len(bad), area)
