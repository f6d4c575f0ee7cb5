import datetime as dt

from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.sources import html, registry

PAGE = """<html><head><script type="application/ld+json">{"@graph": [{"@type": ["Thing", "JobPosting"], "title": "Welder &amp; Fitter", "datePosted": "2026-05-30", "url": "https://x.com/1",
 "hiringOrganization": {"@type": "Organization", "name": "Acme", "sameAs": "https://acme.com"}, "jobLocation": [{"address": {"addressLocality": "Toledo", "addressRegion": "OH", "addressCountry": "US"}}],
 "identifier": {"value": "w-1"}, "description": "<p>Weld<br>things</p>"}, {"@type": "Person", "name": "Carl Chief", "jobTitle": "CEO", "email": "mailto:Carl@acme.com"}]}</script>
 <script type="application/ld+json">{broken</script></head><body><table><tr><th>Name</th></tr><tr><td>Tadd Schwarz</td><td>COO</td><td><a href="mailto:tadd%40acme.com">m</a></td></tr><tr><td>No Mail</td><td>CFO</td></tr></table>
 <div class="vcard"><span class="fn">Pat Plant</span><span class="title">Plant Manager</span></div>
 <div><h3>Ann Avery</h3><p>HR Director</p></div><p>jane [at] acme [dot] com</p><p>celebration. Learn more</p><img src="logo@2x.png"></body></html>"""


def test_postings_and_people():
    (one,) = html.postings(PAGE)
    assert one == {"external_id": "w-1", "title": "Welder & Fitter", "company_name": "Acme", "company_website": "https://acme.com", "location": "Toledo, OH, US", "posted_at": "2026-05-30", "employment_type": None, "description": "Weld things", "application_url": "https://x.com/1"}
    people = {p["name"]: p for p in html.contacts(PAGE)}
    assert {n: p["priority"] for n, p in people.items()} == {"Carl Chief": 1, "Tadd Schwarz": 2, "Pat Plant": 4, "Ann Avery": 3}
    assert people["Carl Chief"]["email"] == "carl@acme.com" and people["Tadd Schwarz"]["email"] == "tadd@acme.com"
    assert "Ann Avery" not in {p["name"] for p in html.contacts(PAGE, people_page=False)}
    assert html.emails(PAGE) == ["tadd@acme.com", "jane@acme.com"]
    for bad in (None, "", "<", "<a href=", "<div><p>x", "\x00"):
        assert html.postings(bad) == [] and html.contacts(bad) == [] and html.emails(bad) == []


def test_page_tables(spark):
    pages = spark.createDataFrame([("u1", PAGE), ("u2", None), ("u3", "")], "url string, html string")
    assert html.postings_of_pages(pages).count() == 1
    assert html.contacts_of_pages(pages).count() == 4
    assert [r.email for r in html.emails_of_pages(pages).orderBy("position").collect()] == ["tadd@acme.com", "jane@acme.com"]


def test_slice(spark, tmp_path):
    rows = [("1", "2026-09-14T00:00:00+00:00", "US"), ("2", "2026-08-07T00:00:00+00:00", "US"), ("3", None, "US"), ("4", "2026-09-14T00:00:00+00:00", "DE"), ("5", "2026-09-01T22:00:00-04:00", "US"), ("6", "09/15/2026", "US"), ("7", "2026-09-10T10:11:09.378+00:00", "US")]
    path = str(tmp_path / "slice")
    spark.createDataFrame([(i, i, "u", None, "Welder", "Acme", "lever", "Toledo, OH", c, None, None, None, p) for i, p, c in rows], schemas.ATS_SLICE).write.parquet(path)
    now = F.lit(dt.datetime(2026, 9, 16))
    assert sorted(r.global_id for r in registry.ats_slice(spark, path, now).collect()) == ["1", "3", "5", "6", "7"]
    assert registry.ats_slice(spark, path, now, title="weld", state="OH").count() == 5 and registry.ats_slice(spark, path, now, state="TX").count() == 0
    raw = registry.ats_to_raw(registry.ats_slice(spark, path, now), "lever")
    books = registry.Registry(disabled={"gone"})
    books.register("lever", lambda s: raw)
    books.register("indeed", lambda s: raw.withColumn("title", F.lit(None).cast("string")))
    good, bad = books.run(spark)
    assert good.count() == 5 and bad.count() == 5 and books.unknown_disabled() == ["gone"]


def test_aliases_and_pages(spark):
    df = spark.createDataFrame([("indeed", "", "A", "https://j"), (None, "B", None, None)], "site string, company_name string, company string, job_url string")
    rows = registry.coalesce_aliases(df, registry.ALIASES).collect()
    assert (rows[0].source_site, rows[0].company_name, rows[0].application_url, rows[0].title) == ("indeed", "A", "https://j", None) and rows[1].company_name == "B"
    pages = spark.createDataFrame([("<p>fine " + "x" * 600, 200, "Home"), ("<p>please solve the CAPTCHA", 200, "x"), ("<p>hi", 200, "Just a moment..."), ('{"captcha": 1}', 200, None), ("<p>x", 403, None), ("<p>Over 1,200 applicants", None, None)], "html string, status int, title string")
    assert [r[0] for r in pages.select(registry.blocked_page(F.col("html"), F.col("status"), F.col("title"))).collect()] == [False, True, True, False, True, False]
    assert [r[0] for r in pages.select(registry.applicant_count(F.col("html"))).collect()][-1] == 1200
