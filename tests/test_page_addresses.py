import re

from leadloom.plans import more_queries

SF = "/root/testdata/sf0.01"


def test_page_addresses_match_a_search_of_the_unchanged_pages(spark):
    """The pages hold addresses in visible text only, so tags, scripts and styles are cut and the rest is searched."""
    want = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        text = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1>|<[^>]*>", " ", r.html or "")
        found = [e.lower() for e in dict.fromkeys(re.findall(r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}", text))]
        want += [(r.page_id, i, e) for i, e in enumerate(found)] or [(r.page_id, None, None)]
    got = [tuple(r) for r in more_queries.page_addresses(spark, SF).select("page_id", "position", "email").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(e is not None for _, _, e in got) == 3
