import duckdb
import pytest

from leadloom.llm import url_filter as uf

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q", "http://example.com/en/", "https://com/en/", "http://xcom/en/", "http://b.net/de/1#f", "http://example.net/de/8", "http://c.org/es/", "http://c.org/ES/", "http://x.example.com:80/en/7", "http://www.ads.com/x", "http://shop.com/cart/add?x", "http://a\nb.com/en/", "ftp://q://z.com/en/", "http://a.com?x=/en/"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [n for n, _ in uf.HOST_RULES if (host == (h := n.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + n.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def test_rules_match_brute_force(spark):
    df = spark.createDataFrame([(u,) for u in URLS + URLS[:3]], "url string")
    rows = uf.judge_urls(df, uf.production_rules()).collect()
    assert len(rows) == len(set(URLS))
    verdicts = dict(uf.HOST_RULES)
    for r in rows:
        assert (r.host, r.path, r.rule) == brute(r.url), r
        if r.rule:
            assert r.verdict == verdicts[r.rule]
    by = {r.url: r for r in rows}
    assert by["http://www.ads.com/x"].verdict == "block" and by["http://shop.com/cart/add?x"].pattern_rule == "cart"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    want = sorted(con.sql("SELECT page_id, host, path, rule, verdict, pattern_rule FROM (" + uf.OP3_SQL + ")").fetchall(), key=str)
    assert sorted(map(tuple, uf.op3_url_filter(spark, f"/root/testdata/{sf}").collect()), key=str) == want


def test_rules_need_a_literal(spark):
    with pytest.raises(ValueError):
        uf.index_rules(spark, [uf.pattern_rule("x", "block", ".*")])
    empty = spark.createDataFrame([], "url string")
    assert uf.judge_urls(empty, uf.production_rules()).count() == 0
