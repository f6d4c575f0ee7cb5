from leadloom.sources import boards

PAGES = "site string, query string, page_no int, url string, html string, ok boolean, error string, status int"
ROWS = "site string, query string, page_no int, position int, external_id string, application_url string, title string"


def walk(spark, pages, rows):
    return boards.page_walk(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rows, ROWS), 3, 1000)


def test_no_side_of_the_walk_goes_through_the_driver(spark):
    """A source's rows can be many more than the planner takes them for, so no join may be a broadcast."""
    pages = [("talent_com", "q", p, "u", "<p>", True, None, None) for p in (1, 2)]
    for df in walk(spark, pages, [("talent_com", "q", 1, 0, "a", "", "t")]):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_repeats_and_failures_are_counted_by_page(spark):
    page = lambda q, p, ok=True, error=None: ("talent_com", q, p, "u", "<p>", ok, error, None)
    row = lambda q, p, i, x: ("talent_com", q, p, i, x, "", f"{q}{p}{i}")
    pages = [page("a", 1), page("a", 1), page("a", 2), page("a", 3), page("b", 1), page("b", 2, False, "robots"), page("c", 1)]
    rows = [row("a", 1, 0, "x"), row("a", 1, 1, "y"), row("a", 2, 0, "x"), row("a", 2, 1, "z"), row("a", 3, 0, "x"), row("b", 1, 0, "z"), row("b", 1, 1, "w"), row("b", 2, 0, "v")]
    accepted, out = walk(spark, pages, rows)
    assert sorted(r.title for r in accepted.collect()) == ["a10", "a11", "a21", "b11"]
    got = {r.query: (r.stop_reason, r.error_type, r.pages, r.jobs_returned, r.jobs_accepted, r.duplicates) for r in out.collect()}
    assert got == {"a": ("SOURCE_EXHAUSTED", None, 3, 5, 3, 2), "b": ("ROBOTS_RESTRICTED", None, 2, 2, 1, 1), "c": ("ERROR", "PARSE_FAILED", 1, 0, 0, 0)}
