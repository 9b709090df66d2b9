import gzip
import random

import duckdb
import pytest

from tickloom.llm import queries, warc


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree_merges_any_runs(seed):
    rng = random.Random(seed)
    keys, starts = [], []
    for _ in range(rng.choice([1, 2, 3, 7, 16])):
        starts.append(len(keys))
        keys += sorted(rng.randrange(20) for _ in range(rng.randrange(0, 30)))
    got = list(warc.merge_runs(keys, starts))
    assert got == sorted(range(len(keys)), key=lambda i: (keys[i], i))


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://WWW.Example.com/A?b=C#d", "com,example)/a?b=c"),
        ("http://blog.example.org:80", "org,example,blog)/"),
        ("http://x?q", "x)?q"),
        ("", ""),
        (None, ""),
        ("nowhere", "nowhere)/"),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_records_are_parsed_back_and_damage_is_noticed():
    payload = b"a\r\n\r\nb"
    data = warc.record(5, "http://x/ y\n", payload, warc.base32_sha1(payload), 5, "2024-01-01T00:00:05Z") + warc.END
    data += warc.record(4, None, payload, warc.base32_sha1(payload), 5, "2024-01-01T00:00:04Z") + warc.END
    (_, n, first, block), (at, _, second, rest) = warc.parse(data)
    assert first["WARC-Type"] == "response" and block.endswith(payload) and first["WARC-Target-URI"] == "http://x/%20y%0A"
    assert at == n and second["WARC-Refers-To"] == "<urn:page:5>" and payload not in rest
    with pytest.raises(ValueError):
        list(warc.parse(data[:-1]))


def test_archives_hold_every_page_in_global_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 2000)
    rng = random.Random(7)
    rows = [(i, f"http://h{rng.randrange(4)}.example.com/{rng.randrange(5)}", rng.choice(["<p>same", "<p>\r\n\r\n é", None, f"<p>{i}" * 50])) for i in range(300)]
    rows += [(None, "http://h1.example.com/1", "<p>same"), (None, None, "only null"), (7, "http://h2.example.com/x", rows[7][2]), (400, "http://a/", "z" * 300000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string").repartition(5)
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    out = warc.merge_index(warc.read(spark, path), each=50).collect()
    keys = [(r.url_key.encode(), r.captured, -1 if r.page_id is None else r.page_id) for r in out]
    assert keys == sorted(keys) and len(out) == len(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.execute(queries.WARC_SQL).fetchall()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_capture_is_fetched_by_its_index_entry(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 100)
    rows = [(i, f"http://h.example.com/{i}", f"<p>{i % 7} é" * (i + 1)) for i in range(60)] + [(60, "http://h.example.com/60", None)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), f"file://{tmp_path}/w")
    captures = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r.page_id for r in captures) == list(range(61)) and len({(r.archive, r.at) for r in captures}) == 61
    for r in captures:
        with open(tmp_path / "w" / r.archive, "rb") as archive:
            archive.seek(r.at)
            headers, block = warc.fetch(archive.read(r.length))
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and headers["WARC-Target-URI"] == f"http://h.example.com/{r.page_id}"
        payload = block.partition(warc.END)[2]
        assert payload == ((rows[r.page_id][2] or "").encode() if r.record_type == "response" else b"")
    whole = next((tmp_path / "w").glob("part*")).read_bytes()
    assert len(list(warc.parse(gzip.decompress(whole)))) == len(list(warc.members(whole)))  # any reader of gzip reads it
    with pytest.raises(ValueError):
        list(warc.members(whole[:-3]))


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.merge_index(warc.read(spark, f"file://{tmp_path}/none")).count() == 0
