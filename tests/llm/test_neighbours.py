import itertools

import numpy as np

from tickloom.llm import neighbours as N


def exact(ids, vectors, k):
    out = {}
    for i, q in zip(ids, vectors):
        if i % 20:
            continue
        scored = sorted(((-float(np.dot(q, v)), j) for j, v in zip(ids, vectors) if j != i))
        out[i] = [j for _, j in scored[:k]]
    return out


def test_perturbations_come_in_order_of_their_cost():
    inside = np.array([0.1, 0.75, 0.4])
    got = N.perturbations(np.array([[0.5, 0.5, 0.5], inside]), 27)[1]

    def cost(move):
        return sum((f if m < 0 else 1 - f) ** 2 for f, m in zip(inside, move) if m)

    every = sorted(itertools.product((-1, 0, 1), repeat=3), key=cost)
    assert len({tuple(m) for m in got.tolist()}) == 27
    assert np.allclose([cost(m) for m in got], [cost(m) for m in every])


def test_search_finds_most_and_scores_exactly(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    vectors = np.float32(centres[rng.integers(0, 30, 800)] + 0.4 * rng.normal(size=(800, 24))).astype(float) * rng.uniform(0.5, 2, (800, 1))
    vectors = np.float32(vectors).astype(float)
    vectors[100:140] = vectors[0]  # a common vector
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    usable = N.usable(frame)
    rows = N.search(usable, usable.where("vec_id % 20 = 0"), k=10, shard_rows=200).collect()
    want = exact(range(800), vectors, 10)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(np.dot(vectors[r.query_id], vectors[r.vec_id]))) < 1e-9
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert got[0] == want[0] and got[120] == want[120]  # ties go to the smaller id
    assert all(r.rank >= 1 for r in rows)


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (20, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    usable = N.usable(frame)
    assert sorted(r.vec_id for r in usable.collect()) == [0, 1, 20]
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in N.search(usable, usable.where("vec_id % 20 = 0")).collect()}
    assert found == {(0, 1): (20, 2.0), (0, 2): (1, 0.5), (20, 1): (0, 2.0), (20, 2): (1, 1.0)}


def test_no_vectors(spark):
    usable = N.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert N.search(usable, usable).collect() == []


def test_one_long_vector_hides_nothing(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(6000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[1] *= 30
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    usable = N.usable(frame)
    got = {}
    for r in N.search(usable, usable.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(range(6000), vectors, 20)
    assert got.keys() == want.keys() and {len(v) for v in got.values()} == {20}
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.95


def test_queries_short_of_candidates_are_held_against_all_vectors(spark):
    vectors = np.random.default_rng(8).normal(size=(300, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    usable = N.usable(frame)
    narrow = N.Tables(64, N.extent(usable)[1], width=0.2, probes=1)
    rows = N.search(usable, usable.where("vec_id % 20 = 0"), shard_rows=100, fitted=N.Fit(narrow, 1.0, 0.0)).collect()
    got = {q: [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in rows}}
    assert got == exact(range(300), vectors, 20)


def test_blocks_of_queries_find_the_same_and_a_recall_out_of_reach_is_answered_exactly(spark):
    vectors = np.random.default_rng(10).normal(size=(700, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    usable = N.usable(frame)
    asked, scales = usable.where("vec_id % 20 = 0"), N.extent(usable)[1]
    wide = N.Tables(16, scales, width=4.0, probes=30)
    one, many = (sorted(map(tuple, N.search(usable, asked, shard_rows=150, queries_each=each, fitted=N.Fit(wide, 1.0, 0.5)).collect())) for each in (4096, 6))
    assert one == many and len(one) == 35 * 20
    rows = N.search(usable, asked, shard_rows=150, queries_each=6, fitted=N.Fit(N.Tables(16, scales, width=0.2, probes=1), 0.5, 1.0)).collect()
    got = {q: [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in rows}}
    assert got == exact(range(700), vectors, 20)


def test_the_sampled_queries_are_answered_exactly_from_many_batches(spark):
    vectors = np.random.default_rng(11).normal(size=(500, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        usable = N.usable(frame)
        whose, near = N.exact_neighbours(usable, np.arange(0, 500, 50), vectors[::50], 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = exact(range(500), vectors, 20)
    for q in range(10):
        assert sorted(map(tuple, near[whose == q])) == sorted(map(tuple, vectors[want[50 * q]])) if 50 * q in want else True


def test_clustered_vectors_are_found_without_visiting_most(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(100, 32))
    vectors = centres[np.arange(6000) % 100] + 0.15 * rng.normal(size=(6000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    usable = N.usable(frame)
    known, scales = N.extent(usable)
    fitted = N.fit(usable, known.n, known.dims, scales, k=20, tables=5, recall=0.97)
    assert fitted.recall >= 0.97 and fitted.visited < 0.5
    got = {}
    for r in N.search(usable, usable.where("vec_id % 20 = 0"), fitted=fitted).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(range(6000), vectors, 20)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9
