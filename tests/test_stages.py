"""The stages after qualification: golden cases, brute force and a run from postings to leads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadloom.functions import email, pages, size, text
from leadloom.operators import enrichment, people, projections, tables
from leadloom.plans.engine import RECORDED, Engine, Recorded
from leadloom.scratch import Scratch
from leadloom.sources import html, registry, slices
from leadloom.streaming import incremental
from leadloom.vocab import Settings
from tests.test_operators import NOW, frame, job


def now():
    return F.lit(NOW)


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("line", ["Our Leadership", "Meet The Team", "Brown Construction Services", "President of Maintenance", "Contact Us", "12 Monkeys", "email us"])
def test_headings_are_nobody(line):
    assert html.contacts(f"<div><h3>{line}</h3><p>General Manager</p></div>") == []


def test_people_of_pages():
    cases = {
        "<p>Andy Dupuy - CEO & President</p>": ("Andy Dupuy", 1), "<p>Fred McManus, COO</p>": ("Fred McManus", 2), "<p>Jane Smith<br>HR Director</p>": ("Jane Smith", 3), "<div><b>Bo Ray</b><span>Owner</span></div>": ("Bo Ray", 1),
        '<li><a href="https://www.linkedin.com/in/x">Ann Lee</a> - Plant Manager</li>': ("Ann Lee", 4), '<p><a href="mailto:j.doe@x.com">Jane Doe, COO</a></p>': ("Jane Doe", 2),
    }
    for page, (name, tier) in cases.items():
        assert [(p["name"], p["priority"]) for p in html.contacts(page) if p["priority"]] == [(name, tier)], page
    assert html.contacts("<p>Great Benefits</p><p>General Manager</p>") == []
    assert html.contacts("<title>404 not found</title><p>Jane Smith, COO</p>") == []
    assert html.contacts("<p>Jane Smith</p><p>Please contact our CEO today.</p>") == []
    (row,) = html.contacts('<table><tr><td>Cynthia Slezak</td><td>CEO</td><td>136</td><td>info@acme.com</td></tr></table>')
    assert row["email"] is None and row["priority"] == 1
    began = dt.datetime.now()
    html.contacts("<div>" + '<a href="mailto:a@b.com">a</a>' * 20_000 + "</div>")
    assert (dt.datetime.now() - began).total_seconds() < 20


def test_images_are_no_addresses(spark):
    rows = one(spark, [("logo@2x.jpeg a@b.com",), ("mailto:%E2%80%9C@jackmorton.com x%2Eyz%40acme.com",), (r"fcdi\-hr@fujifilm.com",), ("100% of a@b.co + c+d@e.com %zz",)], "x string")
    assert [r[0] for r in rows.select(email.extract_emails(F.col("x"))).collect()] == [["a@b.com"], ["x.yz@acme.com"], ["fcdi-hr@fujifilm.com"], ["a@b.co", "c+d@e.com"]]
    assert html.emails('<img src="logo@2x.jpeg"><a href="mailto:a%40b.com">x</a> big@logo.jpeg') == ["a@b.com"]


def test_access_walls(spark):
    body = "<p>" + "word " * 300
    cases = [
        (body, 200, False, False), (body, 407, False, True), (body, 503, False, True), ("", 200, False, True), ("  \n", None, True, True), ("<p>short", 200, False, True), ("<p>short", 200, True, False),
        ("<title>Just a moment...</title>" + body, 200, True, True), ("<title>Access Denied</title>" + body, 200, True, True), (body + " captcha blocked", 200, False, False), ("<p>captcha " + "word " * 150, 200, False, True),
        ('{"captcha": 1}', 200, False, False), ("<html><body><sitemapindex>", 200, False, False), ("<script>" + "x" * 900 + "</script>", 200, False, True), ("<noscript>enable javascript</noscript>" + body, 200, False, False), (body + '<div class="g-recaptcha">', 200, True, True),
    ]
    rows = one(spark, [(i, h, s, r) for i, (h, s, r, _) in enumerate(cases)], "i int, html string, status int, rendered boolean")
    got = {r.i: r.b for r in rows.select("i", registry.access_wall(F.col("html"), F.col("status"), F.col("rendered")).alias("b")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}


def test_lead_status_cases(spark):
    p = lambda kind, status, mail="a@b.com": (mail, kind, status)
    cases = [
        ([p("PERSONAL", "VALID")], "READY"), ([p("ROLE", "VALID")], "NO_VERIFIED_POC_EMAIL"), ([p("PERSONAL", None)], "PENDING_VERIFICATION"), ([p("PERSONAL", "UNKNOWN")], "PENDING_VERIFICATION"), ([p("PERSONAL", "PENDING"), p("PERSONAL", "VALID")], "READY"),
        ([p("PERSONAL", "INVALID"), p("PERSONAL", "RISKY")], "NO_VERIFIED_POC_EMAIL"), ([p("DOMAIN_MISMATCH", "VALID")], "NO_VERIFIED_POC_EMAIL"), ([], "NO_VERIFIED_POC_EMAIL"), (None, "NO_VERIFIED_POC_EMAIL"), ([p("PERSONAL", "VALID", None)], "NO_VERIFIED_POC_EMAIL"),
    ]
    rows = one(spark, cases, "pocs array<struct<email:string,email_class:string,verification_status:string>>, want string")
    assert rows.where(tables.lead_status(F.col("pocs")) != F.col("want")).count() == 0


def brute_verify(rows, cache, answers, limit, days=30):
    """The verifier's rule, one contact after the other."""
    calls, stopped, known, out = 0, None, {}, []
    for seq, mail, kind in rows:
        mail = (mail or "").strip().lower()
        if not mail:
            out.append((seq, None, None))
            continue
        if kind not in ("PERSONAL", "ROLE"):
            out.append((seq, "SKIPPED", f"EMAIL_CLASS:{kind}"))
            continue
        if mail in known:
            out.append((seq, *known[mail]))
            continue
        hit = cache.get(mail)
        if hit and hit[0] in ("VALID", "INVALID", "RISKY") and hit[1] <= days:
            known[mail] = (hit[0], None)
        elif stopped:
            out.append((seq, "PENDING", stopped))
            continue
        elif calls >= limit:
            out.append((seq, "PENDING", "BUDGET_EXHAUSTED"))
            continue
        else:
            calls += 1
            code, said = answers.get(mail, (0, None))
            status, reason = {429: ("PENDING", "PROVIDER_RATE_LIMITED"), 401: ("PENDING", "PROVIDER_UNAVAILABLE"), 500: ("PENDING", "PROVIDER_ERROR:HTTP_STATUS"), 0: ("PENDING", "PROVIDER_ERROR:NO_ANSWER")}.get(code) or {"valid": ("VALID", None), "abuse": ("RISKY", None), "unknown": ("UNKNOWN", None)}.get(said, ("PENDING", f"UNRECOGNIZED_STATUS:{said}"))
            if reason in ("PROVIDER_RATE_LIMITED", "PROVIDER_UNAVAILABLE"):
                stopped = reason
            if status == "PENDING":
                out.append((seq, status, reason))
                continue
            known[mail] = (status, None)
        out.append((seq, *known[mail]))
    return out


def test_verification_equals_one_after_the_other(spark):
    rng = random.Random(3)
    for _ in range(6):
        mails = [f"m{i}@x.com" for i in range(12)]
        rows = [(i, rng.choice([*mails, " ", None]), rng.choice(["PERSONAL", "PERSONAL", "ROLE", "DOMAIN_MISMATCH"])) for i in range(30)]
        kinds = {m: rng.choice(["PERSONAL", "ROLE", "PORTAL_GENERATED"]) for m in mails}
        rows = [(i, m, kinds.get(m, "PERSONAL")) for i, m, _ in rows]
        cache = {m: (rng.choice(["VALID", "RISKY", "UNKNOWN"]), rng.choice([5, 40])) for m in mails if rng.random() < 0.3}
        answers = {m: rng.choice([(200, "valid"), (200, "abuse"), (200, "unknown"), (200, "odd"), (500, None), (429, None)] if rng.random() < 0.3 else [(200, "valid"), (200, "odd")]) for m in mails if rng.random() < 0.9}
        limit = rng.choice([3, 8, 50])
        want = brute_verify(rows, cache, answers, limit)
        df = one(spark, [(i, "c", m, k) for i, m, k in rows], "seq long, company_id string, email string, email_class string")
        stored = one(spark, [(m, s, NOW - dt.timedelta(days=d)) for m, (s, d) in cache.items()], "email string, status string, checked_at timestamp")
        said = one(spark, [(m, c, False, None, s) for m, (c, s) in answers.items()], RECORDED["answers"])
        got = people.verify(df, stored, said, now(), Settings(verification_max_per_run=limit)).orderBy("seq").collect()
        assert [(r.seq, r.status, r.reason) for r in got] == want
    off = people.verify(df, stored.limit(0), said, now(), Settings(verification_enabled=False)).where("status = 'PENDING'")
    assert {r.reason for r in off.collect()} == {"DISABLED"}


COMPANY = [("c1", 1, "acme.com"), ("c2", 2, "bolt.com"), ("c3", 3, "cog.com")]


def run_waterfall(spark, contacts, outcomes, provided, providers=None, companies=COMPANY, calls=None, **settings):
    empty = lambda c: (None,) * (len(c.split(", ")))  # noqa: E731, F841
    out = enrichment.waterfall(
        one(spark, companies, "company_id string, seq int, domain string"), one(spark, contacts, enrichment.CONTACT), one(spark, outcomes, enrichment.OUTCOMES), one(spark, provided, enrichment.PROVIDED),
        providers or [enrichment.Provider("ZOOMINFO"), enrichment.Provider("APOLLO"), enrichment.Provider("APIFY", 5, None)], now(), Scratch(spark, "waterfall"), Settings(**settings),
        None if calls is None else one(spark, calls, "company_id string, provider string, created_at timestamp"),
    )
    contacts, attempts, mails = (df.collect() for df in out)
    return contacts, {(r.company_id, r.provider): r for r in attempts}, mails


def person(c, i, name, title="CEO", mail=None, tier=1, source="COMPANY_WEBSITE"):
    return (c, i, f"{c}-{i}", name, title, tier, mail, None, 1.0, source, "PUBLIC")


def told(c, provider, status="PROVIDER_SUCCESS", reason=None, stop=None):
    return (c, provider, status, reason, "DOMAIN", "77", 2, 1.0, True, stop)


def given(c, provider, seq, name, title="CEO", mail=None, pid="p1", link=None):
    return (c, provider, seq, name, title, mail, link, pid, "x", "u")


def test_nothing_missing_asks_nobody(spark):
    have = [person("c1", i, f"Ann Lee{chr(97 + i)}", mail=f"a{i}@acme.com") for i in range(3)]
    _, tried, _ = run_waterfall(spark, have, [told("c1", "ZOOMINFO")], [], companies=COMPANY[:1])
    assert {k[1]: (r.called, r.status, r.reason) for k, r in tried.items()} == {p: (False, "NOT_CALLED", "NOTHING_MISSING") for p in ("ZOOMINFO", "APOLLO", "APIFY")}


def test_fallbacks_and_merging(spark):
    have = [person("c1", 1, "Ann Lee", mail="info@acme.com"), person("c2", 1, "Bob Ray", "COO", "bob.ray@bolt.com", 2), person("c3", 1, "Cy Fox")]
    outcomes = [told("c1", "ZOOMINFO"), told("c2", "ZOOMINFO", "PROVIDER_NO_MATCH", "AMBIGUOUS"), told("c3", "ZOOMINFO"), told("c1", "APOLLO"), told("c2", "APOLLO"), told("c3", "APOLLO")]
    provided = [
        given("c1", "ZOOMINFO", 1, "Ann M. Lee", mail="ann.lee@acme.com", link="https://l/in/ann"), given("c1", "ZOOMINFO", 2, "Zed Poe", "Welder", "zed@acme.com", "p2"), given("c1", "ZOOMINFO", 3, "Flo Roy", "HR Manager", "flo@acme.com", "p3"),
        given("c2", "APOLLO", 1, "Bob Ray", mail="bob@gmail.com"), given("c3", "ZOOMINFO", 1, "Cy Fox"), given("c3", "APOLLO", 1, "Cy Fox", mail="cy@cog.com"),
    ]
    rows, tried, mails = run_waterfall(spark, have, outcomes, provided)
    people_ = {(r.company_id, r.name): r for r in rows}
    ann, flo, bob, cy = (people_[k] for k in (("c1", "Ann Lee"), ("c1", "Flo Roy"), ("c2", "Bob Ray"), ("c3", "Cy Fox")))
    assert (ann.email, ann.replaced_email, ann.profile_url, ann.origin) == ("ann.lee@acme.com", "info@acme.com", "https://l/in/ann", "PUBLIC+ZOOMINFO")
    assert (flo.origin, flo.title_priority, flo.contact_id) == ("ZOOMINFO", 3, None) and ("c1", "Zed Poe") not in people_
    assert bob.email == "bob.ray@bolt.com" and bob.replaced_email is None and bob.origin == "PUBLIC+APOLLO"  # a weaker address never replaces
    assert cy.email == "cy@cog.com" and cy.origin == "PUBLIC+ZOOMINFO+APOLLO" and cy.fields["email"].provider == "APOLLO"
    assert tried["c1", "ZOOMINFO"].status == "PROVIDER_SUCCESS" and tried["c1", "APOLLO"].reason == "ZOOMINFO PROVIDER_SUCCESS"
    assert tried["c1", "ZOOMINFO"].contacts_added == 1 and tried["c1", "ZOOMINFO"].contacts_upgraded == 1
    assert tried["c1", "ZOOMINFO"].fields_supplied == ["Ann Lee:email", "Ann Lee:profile_url", "Flo Roy:email", "Flo Roy:name", "Flo Roy:title"]
    assert tried["c2", "APOLLO"].fallback_reason == "ZOOMINFO PROVIDER_NO_MATCH: AMBIGUOUS" and tried["c2", "APOLLO"].need_full
    assert (tried["c3", "ZOOMINFO"].status, tried["c3", "ZOOMINFO"].reason) == ("PROVIDER_PARTIAL", "EMAIL_MISSING")
    assert tried["c3", "APOLLO"].fallback_reason == "ZOOMINFO PROVIDER_PARTIAL: no PERSONAL email for Cy Fox" and not tried["c3", "APOLLO"].need_full
    assert tried["c3", "APIFY"].status == "NOT_CALLED" and sorted(m.email for m in mails) == ["ann.lee@acme.com", "bob@gmail.com", "cy@cog.com", "flo@acme.com"]  # an address of somebody who isn't taken is not either


def test_budgets_refusals_and_caches(spark):
    have = [person(c, 1, "Ann Lee") for c, _, _ in COMPANY]
    outcomes = [told(c, "ZOOMINFO") for c, _, _ in COMPANY]
    one_ = [enrichment.Provider("ZOOMINFO", 1)]
    _, tried, _ = run_waterfall(spark, have, outcomes, [], one_)
    assert [tried[c, "ZOOMINFO"].reason for c, _, _ in COMPANY][1:] == ["COMPANY_BUDGET_EXHAUSTED"] * 2 and [tried[c, "ZOOMINFO"].called for c, _, _ in COMPANY] == [True, False, False]
    refused = [told("c1", "ZOOMINFO"), told("c2", "ZOOMINFO", "PROVIDER_RATE_LIMITED", "slow down", "PROVIDER_RATE_LIMITED"), told("c3", "ZOOMINFO")]
    _, tried, _ = run_waterfall(spark, have, refused, [], [enrichment.Provider("ZOOMINFO")])
    assert tried["c2", "ZOOMINFO"].status == "PROVIDER_RATE_LIMITED" and tried["c3", "ZOOMINFO"].reason == "DISABLED_FOR_RUN_AFTER_PROVIDER_RATE_LIMITED" and tried["c3", "ZOOMINFO"].credits == 0
    calls = [("c1", "ZOOMINFO", NOW - dt.timedelta(days=10)), ("c2", "ZOOMINFO", NOW - dt.timedelta(days=100))]
    _, tried, _ = run_waterfall(spark, have, outcomes, [given("c1", "ZOOMINFO", 1, "Ann Lee", mail="ann@acme.com")], one_, calls=calls)
    assert (tried["c1", "ZOOMINFO"].reason, tried["c1", "ZOOMINFO"].called) == ("CACHED", False) and tried["c2", "ZOOMINFO"].called and not tried["c3", "ZOOMINFO"].called
    _, tried, _ = run_waterfall(spark, have, outcomes, [], [enrichment.Provider("ZOOMINFO", configured=False)])
    assert {r.reason for r in tried.values()} == {"NOT_CONFIGURED"}


LEADERSHIP = '<html><head><title>Leadership</title></head><body><div><h3>Ann Lee</h3><p>CEO</p><a href="mailto:ann.lee@acme-mfg.com">mail</a></div><div><h3>Bob Ray</h3><p>Plant Manager</p></div><p>jobs@acme-mfg.com</p></body></html>'


def test_from_postings_to_leads(spark):
    site = "https://www.acme-mfg.com"
    jobs = [
        job(0, days=1, company_employee_count="51 to 200", company_industry="Manufacturing", company_website=site, description="Rapidly growing; write to pat.doe@acme-mfg.com."),
        job(1, "Acme Manufacturing LLC", "Welder", 2, company_employee_count="51 to 200", company_industry="Manufacturing", company_website=site),
        job(3, "Bolt Staffing Group", "Recruiter", 1, company_website="https://boltstaffing.com"),
        job(4, "Cog Industrial", "Welder", 2, company_industry="Manufacturing"),
    ]
    engine = Engine(spark)
    run = engine.run(frame(spark, jobs), now())
    key = {r.company_name_normalized: r.dedup_key for r in run.stages["qualified"].select("company_name_normalized", "dedup_key").collect()}
    cid = {r.company_name_normalized: r.id for r in run.stages["qualified"].select("company_name_normalized", projections.company_id(F.col("domain"), F.col("identity_key"), F.col("company_name_normalized")).alias("id")).collect()}
    acme = cid["acme manufacturing"]
    recorded = Recorded(
        pages=one(spark, [("https://www.acme-mfg.com/leadership", LEADERSHIP), ("https://www.acme-mfg.com", "<p>home</p>")], RECORDED["pages"]),
        candidates=one(spark, [(key["cog industrial"], 1, "cogindustrial.com", "Cog", "Cog Industrial makes cogs in Columbus, Ohio")], RECORDED["candidates"]),
        outcomes=one(spark, [told(acme, "ZOOMINFO")], RECORDED["outcomes"]), provided=one(spark, [given(acme, "ZOOMINFO", 1, "Bob Ray", "Plant Manager", "bob.ray@acme-mfg.com")], RECORDED["provided"]),
        answers=one(spark, [("ann.lee@acme-mfg.com", 200, False, None, "valid"), ("bob.ray@acme-mfg.com", 200, False, None, "invalid")], RECORDED["answers"]),
    )
    done = engine.complete(run, now(), recorded)
    final = {r.display_name: r for r in done.stages["final"].collect()}
    lead = next(r for n, r in final.items() if n.startswith("Acme"))
    assert lead.lead_status == "READY" and [(p.name, p.email, p.verification_status) for p in lead.pocs] == [("Ann Lee", "ann.lee@acme-mfg.com", "VALID"), ("Bob Ray", "bob.ray@acme-mfg.com", "INVALID")]
    assert {e.email for e in lead.emails} == {"ann.lee@acme-mfg.com", "bob.ray@acme-mfg.com", "jobs@acme-mfg.com", "pat.doe@acme-mfg.com"} and len(lead.jobs) == 2
    assert [(e.provider, e.status) for e in lead.enrichment] == [("ZOOMINFO", "PROVIDER_SUCCESS"), ("APOLLO", "NOT_CALLED"), ("APIFY", "NOT_CALLED")]
    bolt = final["Bolt Staffing Group"]
    assert bolt.qualification_status == "REJECTED" and bolt.pocs is None and bolt.lead_status == "NO_VERIFIED_POC_EMAIL"
    rows = {r.normalized_name: r for r in done.stages["companies"].collect()}
    assert rows["cog industrial"].domain == "cogindustrial.com" and rows["cog industrial"].normalized_domain == "NO_DOMAIN" and rows["cog industrial"].domain_confidence == "HIGH"
    assert {r.company_id for r in done.stages["contacts"].collect()} == {acme}
    assert {r.outcome for r in done.stages["reasons"].where(F.col("company_id") == cid["bolt staffing group"]).collect()} == {"REJECTED", "NEEDS_REVIEW"}
    assert '"LEADS":{"NO_VERIFIED_POC_EMAIL":0,"PENDING_VERIFICATION":0,"READY":1}' in engine.report(done).first().report
    assert engine.company_emails(done, acme).count() == 4
    csv = tables.export_rows(done.stages["final"]).where("display_name like 'Acme%'").orderBy("poc_rank").collect()
    assert [r.poc_name for r in csv] == ["Ann Lee", "Bob Ray"]
    rows = {r.contact_name: r for r in tables.csv_rows(done.stages["final"].where("display_name like 'Acme%'")).collect()}
    assert len(tables.CSV_COLUMNS) == 34 and list(rows["Ann Lee"].asDict()) == tables.CSV_COLUMNS
    assert (rows["Ann Lee"].employee_size_min, rows["Ann Lee"].job_titles, rows["Ann Lee"].contact_evidence_urls) == ("51", "Plant Manager; Welder", "https://www.acme-mfg.com/leadership")
    assert "ann.lee@acme-mfg.com (PERSONAL)" in rows["Ann Lee"].company_emails and rows["Bob Ray"].contact_origin == "PUBLIC+ZOOMINFO"


def test_tables_survive_runs(spark, tmp_path):
    engine, base = Engine(spark), str(tmp_path / "store")
    run = engine.run(frame(spark, [job(0, company_website="https://www.acme-mfg.com"), job(1, "Bolt Staffing Group")]), now())
    done = engine.complete(run, now())
    assert engine.persist(done, base, dry_run=True)["companies"] == 2 and not engine.health(base)["companies"]
    for _ in range(2):
        engine.persist(done, base)
    assert engine.stored(base, "companies").count() == 2 and engine.stored(base, "jobs").count() == 2 and engine.health(base)["evidence"]
    assert engine.stored(base, "companies").where("normalized_name = 'acme manufacturing'").first().domain == "acme-mfg.com"


def test_functions_in_sql(spark):
    from leadloom.functions.registry import register_all

    assert "fold_exact" in register_all(spark)
    assert spark.sql("SELECT fold_exact('M&uuml;ller ﬁ'), extract_employee_size('a team of 12').min").first()[:] == ("Muller fi", 12)


def test_stored_selects(spark):
    rows = one(spark, [(1, "a", 2.0), (2, None, None), (3, "a", 1.0)], "k int, s string, v double")
    assert [r.k for r in tables.select(rows, order_by="v").collect()] == [2, 1, 3] and [r.k for r in tables.select(rows, ["k"], {"s": None}).collect()] == [2]
    assert tables.select(rows, filters={"nope": 1}).count() == 0
    with pytest.raises(ValueError):
        tables.select(rows, ["nope"], strict=True)


def test_links_equal_a_plain_parsers(spark):
    from html.parser import HTMLParser

    from leadloom.plans.stage_queries import page_links

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            href = (dict(attrs).get("href") or "").strip()
            if tag == "a" and href and not href.lower().startswith(("mailto:", "tel:", "#", "javascript:")):
                self.found.append(href)

    want = []
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        reader = Reader()
        reader.feed(r.html or "")
        want += [(r.page_id, i, link) for i, link in enumerate(reader.found)]
    assert sorted(map(tuple, page_links(spark, "/root/testdata/sf0.001").collect())) == sorted(want) and want


def test_slices(spark, tmp_path):
    with pytest.raises(ValueError):
        slices.resolve_slices(None)
    assert slices.resolve_slices(None, Settings(full_snapshot=True)) == [None] and slices.resolve_slices("lever") == ["lever"] and slices.resolve_slices(["a", "b"]) == ["a", "b"]
    base, manifest = str(tmp_path / "s"), {"sha256": "a" * 64, "rows": 3}
    spark.range(3).write.parquet(f"{base}/lever/{'a' * 16}")
    spark.range(4).write.parquet(f"{base}/lever/{'b' * 16}")
    assert slices.checked_slice(spark, base, "lever", manifest).endswith("a" * 16)
    with pytest.raises(ValueError):
        slices.checked_slice(spark, base, "lever", {"sha256": "b" * 64, "rows": 3})
    assert slices.drop_old_versions(spark, base, "lever", manifest) == ["b" * 16]
    cache = slices.SliceCache()
    frames = [cache.get(("lever", 1), lambda: spark.range(3)) for _ in range(3)]
    assert (cache.loads, cache.hits) == (1, 2) and frames[0] is frames[2]
    cache.clear()


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    base = str(tmp_path / "t")
    upsert = incremental.partitioned_sink(spark, base, ["k"], 8)
    first = one(spark, [(i, f"a{i}") for i in range(40)], "k int, v string")
    upsert(first, 0)
    for _ in range(2):
        upsert(one(spark, [(3, None), (100, "new")], "k int, v string"), 1)
    upsert(one(spark, [(3, "later")], "k int, v string"), 2)
    rows = {r.k: r.v for r in incremental.read_partitioned(spark, base, "k int, v string").collect()}
    assert len(rows) == 41 and rows[3] == "later" and rows[100] == "new" and rows[7] == "a7"
    assert len([v for _, v in incremental._versions(spark, base) if v == 1]) <= 2
    assert incremental.compact(spark, base) > 0 and incremental.read_partitioned(spark, base, "k int, v string").count() == 41


def test_a_streams_memory_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    base = dt.datetime(2026, 6, 1)
    rows = sorted({(rng.choice("ab"), base + dt.timedelta(hours=rng.randrange(200))) for _ in range(60)})
    one(spark, rows, "k string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in"))
    incremental.run_available(incremental.remember(stream, "k", "at", 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    want, last = set(), {}
    for k, at in sorted(rows, key=lambda r: r[1]):
        known = k in last and at - last[k] <= dt.timedelta(days=1)
        want.add((k, at, known))
        if not known:
            last[k] = at
    assert {(r.k, r["at"], r.known) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_sizes_keep_their_words(spark):
    rows = one(spark, [("Founded 1980. We employ over 85 people in Ohio.",), ("revenue of $5 million, 500 employees",), (None,)], "x string").select(size.size_evidence(F.col("x")).alias("e")).select("e.*")
    assert [tuple(r) for r in rows.collect()] == [(85, None, "over 85 people"), (None, None, None), (None, None, None)]


def test_names_without_a_mask_are_never_the_same(spark):
    rows = one(spark, [("Ann", "Huston", "Ann Huston"), ("Ann", "Hu***n", "Ann Huston"), (None, "Hu***n", "Ann Huston")], "f string, l string, n string")
    assert [r[0] for r in rows.select(pages.obfuscated_same(F.col("f"), F.col("l"), F.col("n"))).collect()] == [False, True, False]
    assert [r[0] for r in rows.select(text.person_key(F.col("n"))).collect()] == ["ann huston"] * 3
