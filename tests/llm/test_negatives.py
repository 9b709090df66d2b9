import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import negatives


@pytest.mark.parametrize("dims, most", [(1, 1), (8, 130), (13, 7), (64, 300), (20, 2**22)])
def test_looked_up_scores_are_the_inner_products(dims, most):
    rng = np.random.default_rng(dims)
    anchors, rows = rng.integers(-most, most + 1, (5, dims)), rng.integers(-most, most + 1, (40, dims))
    rows[0], rows[1] = most, -most
    got = negatives.scores(negatives.subset_sums(anchors), negatives.packed(rows, int(most).bit_length() + 1))
    assert (got == rows @ anchors.T).all()


def plain(rows, anchor_every):
    """rows: (vec_id, label, scaled components)."""
    out = []
    for a, label, own in rows:
        if a % anchor_every:
            continue
        scored = sorted(((-int(np.dot(own, c)), i, other) for i, other, c in rows if i != a))
        for p in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and -50 * p[0] <= -100 * s[0] <= -95 * p[0]][:3]
            out += [(a, p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block, each", [(4096, 1024), (7, 3)])
def test_mined_rows_equal_a_plain_search(spark, block, each):
    rng = random.Random(4)
    table = [(i, rng.choice([0, 1, 1, 1, 2]), [rng.choice([-1.0, 0.5, 0.25, 0.75, 1.0, 0.003]) for _ in range(11)]) for i in range(120)]
    table += [(200 + i, 1, table[3][2]) for i in range(20)] + [(300 + i, 2, [0.0] * 11) for i in range(3)]
    frame = spark.createDataFrame(table, "vec_id long, label int, embedding array<double>")
    want = plain([(i, k, np.floor(256 * np.array(v)).astype(int)) for i, k, v in table], 10)
    got = negatives.mine(negatives.usable(frame), F.col("vec_id") % 10 == 0, block=block, anchors_each=each).collect()
    assert len(want) > 50 and sorted(map(tuple, got)) == want


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(10, 1, [1.0, 0.0], "x"), (11, 1, [1.0, 0.0], "x"), (12, 2, [0.8, 0.0], "x"), (12, 2, [0.8, 0.0], "y"), (13, 2, [0.5, nan], "x"), (14, 2, [0.7, None], "x")]
    rows += [(15, 2, [0.7, inf], "x"), (16, None, [0.7, 0.0], "x"), (None, 2, [0.7, 0.0], "x"), (17, 2, None, None), (18, 2, [0.7], None), (19, 2, [1e30, 0.0], None), (20, 3, [-1.0, 0.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, block string")
    got = negatives.mine(negatives.usable(frame), F.col("vec_id") % 10 == 0).collect()
    assert list(map(tuple, got)) == [(10, 11, 1, 12, 65536, 256 * 204)]
    empty = negatives.mine(negatives.usable(frame.limit(0)), F.col("vec_id") % 10 == 0)
    assert empty.collect() == [] and empty.columns == [c.split()[0] for c in negatives.RESULT.split(", ")]
