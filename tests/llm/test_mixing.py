import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing


def rows(seed=0, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "src0" if i % 3 == 0 else rng.choice(["src1", "src2", "src5", "odd", None])
        out.append((i, "w " * rng.randrange(40), rng.choice(["en", "en", "de", "xx", None]), source))
    out += [(None, "the same again", "en", "src0")] * 45 + [(7, "", "en", "src1")] * 3 + [(None, f"other {i % 3}", "de", "src0") for i in range(20)]
    return [*out, (n, None, "en", "src0"), (n + 1, "", "en", "src0"), (None, "a b", "en", "src1"), (5, out[5][1], out[5][2], out[5][3]), (n + 2, "long " * 30000, "de", "src2")]


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(fraction=0.2, max_epochs=1, slice_rows=7), mixing.Mix(fraction=1.9, max_epochs=2), mixing.Mix(fraction=1.5, max_epochs=4, seed=9, slice_rows=20)])
def test_choice_equals_sql(spark, mix):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, lang string, source string, copies int, budget int")
    got = [tuple(r) for r in mixing.select(docs, mix).select("doc_id", "domain", "lang", "source", "n_tokens", "copies").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", data)
    assert sorted(got, key=str) == sorted(con.execute(mixing.sql(mix)).fetchall(), key=str)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 100, 1), ("web", "en", "b", 10, 1), ("web", "de", "c", 1000, 1), ("reference", "en", "d", 1000, 1)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    mix = mixing.Mix(fraction=0.1, max_epochs=1, domains={"web": 0.5, "reference": 0.5}, languages={"en": 0.5, "de": 0.5})
    given = {r.source: r.budget for r in mixing.budgets(frame, mix).collect()}
    # 211 tokens: 105.5 a domain; of web's, en and de are due 52.75 each; b has 10, so a gets 42.75
    assert given == {"a": 42, "b": 10, "c": 52, "d": 105}
    more = mixing.Mix(fraction=0.5, max_epochs=1, domains={"web": 0.5, "reference": 0.5}, languages={"en": 0.5, "de": 0.5})
    given = {r.source: r.budget for r in mixing.budgets(frame, more).collect()}
    # web is due 527.5: en has only 110, its shortage goes to de within web
    assert given == {"a": 100, "b": 10, "c": 417, "d": 527}


def test_rows_are_repeated_by_epochs_and_columns_kept(spark):
    docs = spark.createDataFrame([(i, f"a b c {i % 4}", "en", "src0", i) for i in range(30)] + [(None, None, None, None, 0)], "doc_id long, text string, lang string, source string, c int")
    out = mixing.mixed(docs, mixing.Mix(fraction=1.5, max_epochs=2))
    assert out.columns == docs.columns
    chosen = {r.doc_id: r.copies for r in mixing.select(docs, mixing.Mix(fraction=1.5, max_epochs=2)).collect()}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == chosen and max(chosen.values()) == 2


def test_rows_that_differ_in_other_columns_are_taken_each(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "src0", 1), (1, "a b", "de", "src3", 1), (1, "a b", "en", "src0", 2), (1, "a b", "en", "src0", 2), (2, "c d", "en", "src1", None), (None, "e f", None, None, None)], "doc_id long, text string, lang string, source string, `k.x` int")
    for epochs in (1, 2):
        out = mixing.mixed(docs, mixing.Mix(fraction=float(epochs), max_epochs=epochs))
        assert sorted(map(str, out.collect())) == sorted(map(str, epochs * docs.collect()))
    with pytest.raises(ValueError, match="slice"):
        mixing.select(docs.withColumn("slice", F.lit(1)), mixing.Mix(), keep=["slice"])


def test_rows_that_differ_in_where_a_null_stands_are_taken_each(spark):
    kinds = "doc_id long, text string, lang string, source string, x string, y string, a array<int>, m map<string,int>"
    rest = [1], {"k": 1}
    rows = [(1, "a b", "en", None, "v", None, *rest), (1, "a b", "en", None, None, "v", *rest), (1, "a b", "en", "src0", None, None, [1, None], None), (1, "a b", "en", "src0", None, None, [None, 1], None)]
    rows += [(2, "c", "de", "src1", "v", "v", [], {"k": None}), (2, "c", "de", "src1", "v", "v", [], {"l": None}), (3, "d", None, "en", None, None, None, None), (3, "d", "en", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, kinds)
    out = mixing.mixed(docs, mixing.Mix(fraction=1.0, max_epochs=1))
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.select(docs, mixing.Mix()).collect() == [] and mixing.mixed(docs, mixing.Mix()).collect() == []
