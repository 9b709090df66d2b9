import random

import duckdb
import pytest

from tickloom.llm import hosts
from tickloom.llm.queries import RULES


def sql_rows(data, rules, **kw):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", data)
    return sorted(con.execute(hosts.sql(rules, **kw)).fetchall(), key=str)


def linked_pages(seed, n=200):
    rng = random.Random(seed)
    names = ["hub.example.com"] + [f"{a}.example.{t}" for a in "abcdef" for t in ("com", "net", "org")]
    out = []
    for i in range(n):
        host = names[0] if i % 3 == 0 else rng.choice(names)
        path = rng.choice(["/en/", "/de/", "/es/", "/fr/"]) + rng.choice(["7", "8", ""])
        links = "".join(f'<a class=x href="{rng.choice(["http:", "https:", ""])}//{rng.choice(names).upper()}/p?q">t</a>' for _ in range(rng.randrange(4)))
        out.append((i, f"https://{host}{path}?a=b#c", f"<p>{links}<a href='/own'>"))
    return [*out, (n, None, None), (n + 1, "no scheme/en/", "<a href=//hub.example.com>"), (n + 2, "http://", ""), (n + 3, "x://Host.Example.COM/en/7/ok", None), (3, *out[3][1:]), (None, *out[4][1:])]


@pytest.mark.parametrize("seed", [0, 1])
def test_verdicts_equal_sql(spark, seed):
    data = linked_pages(seed)
    pages = spark.createDataFrame([(*r, "x", 1.0) for r in data], "page_id long, url string, html string, host string, trust double")
    got = sorted((tuple(r) for r in hosts.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sql_rows(data, RULES)
    assert {v for *_, v in got} == {"allow", "block"}


def test_longest_rule_wins_and_hosts_are_whole_labels(spark):
    urls = ["http://example.com/en/7", "http://a.example.com/en/71/x", "http://badexample.com/en/7", "http://com/en/", "http://x.net/de/8", "http://example.net/de/8#f", "http://example.net/DE/8", "http://a.b.org/es/"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r.rule for r in hosts.judge(pages, RULES).collect()}
    assert [got[i] for i in range(8)] == ["example.com/en/7", "example.com/en/7", "com/en/", "com/en/", "net/de/", "example.net/de/8", None, "org/es/"]


def test_distrust_flows_to_those_who_link_to_blocked_hosts(spark):
    edges = spark.createDataFrame([("farm", "bad", 5), ("good", "fine", 1), ("fine", "good", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("bad", 0.0, 1.0), ("good", 1.0, 0.0)], "host string, trusted double, blocked double")
    ranks = {r.host: (r.trust, r.distrust) for r in hosts.propagate(edges, seeds, rounds=30).collect()}
    assert ranks["farm"][1] > 0.1 and ranks["farm"][0] == 0
    assert ranks["fine"][0] > 0.1 and ranks["fine"][1] == 0
    assert abs(ranks["good"][0] - 0.15 / (1 - 0.85**2)) < 1e-2


def test_no_pages(spark):
    assert hosts.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).collect() == []
