"""What the trees learn, on hosts they have not seen; the bound of their sample."""

import random

import pytest

from voxlake.llm import url_filter


def pages(spark, n=4000, hosts=120):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ka", "to", "li", "ren", "mo", "sa"]) for _ in range(rng.randint(2, 4)))
    names = []
    for k in range(hosts):
        bad = k % 6 == 0
        name = f"{rng.choice(['casino', 'cheap-pills', 'spam', 'free-bets', 'ads'])}-{word()}{rng.randrange(999)}" if bad else word()
        names.append((f"{name}.{rng.choice(['org', 'net', 'info'])}", bad))
    rows = []
    for k in range(n):
        host, bad = rng.choice(names)
        query = f"?aff={rng.randrange(10**8)}&cid={rng.randrange(10**8)}" if bad else rng.choice(["", "", "?page=2"])
        rows.append((k, f"http://{host}/{rng.choice(['en', 'de', 'es'])}/{word()}/{rng.randrange(999)}{query}", bad))
    return spark.createDataFrame(rows, "page_id long, url string, bad boolean")


def test_trees_on_hosts_not_learned_from(spark):
    df = pages(spark)
    rows = url_filter.cross_scored(df).collect()
    named = [r for r in rows if r.stratum == 0]
    blocked = [r for r in rows if r.p_block >= url_filter.BLOCK_AT]
    assert sum(r.p_block >= url_filter.BLOCK_AT for r in named) >= 0.9 * len(named) > 0
    assert sum(r.stratum == 0 for r in blocked) >= 0.95 * len(blocked)
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    free = [(r.bad, got[r.page_id].verdict == "block") for r in df.collect() if got[r.page_id].rule is None]
    assert sum(a and b for a, b in free) >= 0.95 * sum(a for a, _ in free)
    assert sum(b and not a for a, b in free) <= 0.02 * sum(not a for a, _ in free)


def test_sample_is_bounded_with_repeated_urls(spark):
    df = pages(spark, 600)
    copies = spark.range(20_000).selectExpr("id + 1000 as page_id", "'http://repeated.org/en/1' as url")
    sample = url_filter.cross_scored(df.select("page_id", "url").unionByName(copies), fit_rows=1000)
    n = sample.count()
    assert 250 < n <= 1000
    assert sample.selectExpr("sum(if(host = 'repeated.org', weight, 0))").first()[0] > 0.8 * 20_000 * url_filter.PRESUMED


@pytest.mark.parametrize("rows,want", [([], [0.0]), ([(0, 1.0, 9.0), (1, 0.0, 9.0), (3, 9.0, 9.0)], [1 / 19, 1 / 19, 1 / 19, 0.9])])
def test_isotonic(rows, want):
    assert url_filter._isotonic(rows)[: len(want)] == pytest.approx(want)


def test_odd_pages(spark):
    rows = [(1, None), (1, None), (None, "http://casino.net/x"), (2, "http://" + "a" * 70_000 + ".org/" + "b/" * 50_000), (3, ""), (4, "http:///en/"), (5, "http://ok.com/")]
    df = spark.createDataFrame([(a, b, "x", 0.5, 1) for a, b in rows], "page_id long, url string, suffix string, p double, `a.b` int")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == 7 and all(r.verdict in ("allow", "block") for r in got)
    assert url_filter.judge_urls(df.filter("page_id = 3")).first().verdict == "allow" and url_filter.judge_urls(df.filter("false")).count() == 0
