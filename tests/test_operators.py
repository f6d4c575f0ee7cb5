import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.operators import dedupe, identity, normalize, qualify, tables
from leadloom.plans.engine import Engine
from leadloom.scratch import Scratch
from leadloom.vocab import Settings

NOW = dt.datetime(2026, 6, 1, 12)
FIELDS = [f.split(" ")[0] for f in schemas.RAW_JOB.split(", ")]


def job(ord_, company="Acme Manufacturing Inc.", title="Plant Manager", days=1.0, **more):
    base = {"ord": ord_, "source_type": "JOB_BOARD", "source_priority": 2, "source_site": "indeed", "external_id": f"id-{ord_}", "title": title, "company_name": company, "location": "Columbus, OH", "description": "", "posted_at": NOW - dt.timedelta(days=days), "application_url": f"https://www.indeed.com/viewjob?jk={ord_}", "search_industry": "Manufacturing", "observed_emails": [], "raw": {}}
    return base | more


def frame(spark, jobs):
    return spark.createDataFrame([[j.get(f) for f in FIELDS] for j in jobs], schemas.RAW_JOB)


def now():
    return F.lit(NOW)


def test_end_to_end_universe(spark):
    site = "https://www.acme-mfg.com"
    jobs = [
        job(0, days=1, company_employee_count="51 to 200", company_industry="Manufacturing", company_website=site, company_url="https://www.indeed.com/cmp/Acme", description="Rapidly growing; new facility opening this year.", applicant_count=8),
        job(1, "Acme Manufacturing LLC", "Welder", 2, company_employee_count="51 to 200", company_industry="Manufacturing", company_website=site),
        job(2, "Acme Manufacturing", "Machinist", 3, source_site="zip_recruiter"),
        job(3, "Bolt Staffing Group", "Recruiter", 1, company_website="https://boltstaffing.com"),
        job(4, "Cog Industrial", "Welder", 30, company_website="https://cogindustrial.com"),
        job(5, "Tiny Shop", "Machinist", 2, company_employee_count="1 to 9", company_industry="Manufacturing", company_website="https://tinyshop.com"),
        job(6, "Mega Industrial", "Plant Manager", 1, company_employee_count="5,000 to 10,000", company_industry="Manufacturing", company_website="https://megaindustrial.com"),
    ]
    for _ in range(2):  # a rerun gives the same
        run = Engine(spark).run(frame(spark, jobs), now())
        rows = {r.company_name_normalized: r for r in run.stages["qualified"].collect()}
        assert run.stages["fresh"].count() == 6 and len(rows) == 4
        assert [r.freshness_reason for r in run.stale.collect()] == ["STALE"]
        acme = rows["acme manufacturing"]
        assert acme.status == "QUALIFIED" and acme.size_label == "51-200" and acme.size_source == "JOB_BOARD" and acme.hiring_intensity == 3 and acme.domain == "acme-mfg.com" and acme.source_sites == ["indeed", "zip_recruiter"]
        assert rows["bolt staffing group"].reasons == ["STAFFING_AGENCY"] and "INDUSTRY_UNKNOWN" in rows["bolt staffing group"].review_flags
        assert "EMPLOYEE_SIZE_BELOW_MIN" in rows["tiny shop"].reasons and "EMPLOYEE_SIZE_ABOVE_MAX" in rows["mega industrial"].reasons
    assert run.metrics()["fresh"] == 6
    with pytest.raises(ValueError):
        Engine(spark).run(frame(spark, jobs), now(), stop_at="never")


def kept(spark, jobs):
    rows, lost = dedupe.dedupe(normalize.normalize(frame(spark, jobs)), Scratch(spark, "dedupe"))
    return {r.ord: r for r in rows.collect()}, {(r.dup_ord, r.kept_ord, r.reason) for r in lost.collect()}


def test_dedupe_scenarios(spark):
    rows, lost = kept(spark, [job(0, external_id="x", posted_at=None), job(1, external_id="x")])
    assert set(rows) == {1} and lost == {(0, 1, "SAME_SOURCE_ID")}
    pair = [job(0, "Acme Mfg Inc.", "Welder", location="Toledo, OH"), job(1, "ACME MFG", "Welder", location="Toledo, Ohio, United States", source_site="talent_com")]
    rows, lost = kept(spark, pair)
    assert len(rows) == 1 and next(iter(rows.values())).cross_posted_on == ["indeed", "talent_com"] and len(lost) == 1
    remote = [job(i, "Acme", "Welder", location="Remote", source_site=s) for i, s in enumerate(("indeed", "talent_com"))]
    assert len(kept(spark, remote)[0]) == 2
    two = [job(0, "Acme", "Welder", company_website="https://a.com"), job(1, "Acme", "Welder", company_website="https://b.com", source_site="talent_com")]
    assert len(kept(spark, two)[0]) == 2
    assert len(kept(spark, [job(0, title="Welder"), job(1, title="Machinist", source_site="talent_com")])[0]) == 2


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["Acme", "Bolt"]), st.sampled_from(["1", "2", None]), st.sampled_from(["https://a.com", "https://b.com", None]), st.booleans()), max_size=14))
def test_dedupe_keeps_or_records_every_row(spark, rows):
    jobs = [job(i, company, "Welder", source_site=site, external_id=eid, company_website=web, posted_at=NOW if dated else None) for i, (site, company, eid, web, dated) in enumerate(rows)]
    left, lost = kept(spark, jobs)
    assert sorted([*left, *(d for d, _, _ in lost)]) == list(range(len(jobs)))
    again, more = kept(spark, [jobs[i] for i in sorted(left)])
    assert set(again) == set(left) and not more


def companies(spark, jobs):
    rows = normalize.freshen(normalize.normalize(frame(spark, jobs)), now())
    named, conflicts = identity.identify(rows, Scratch(spark, "identity"))
    return identity.companies(named).collect(), conflicts.first().n


def test_identity_scenarios(spark):
    out, _ = companies(spark, [job(i, n) for i, n in enumerate(("Acme Inc", "Acme LLC", "Acme"))])
    assert [c.hiring_intensity for c in out] == [3]
    out, _ = companies(spark, [job(0, "Acme", company_website="https://acme-mfg.com"), job(1, "Acme West", location="Austin, TX", company_website="https://acme-mfg.com")])
    assert len(out) == 1 and out[0].identity_basis == "DOMAIN" and out[0].identity_key == "domain:acme-mfg.com"
    out, _ = companies(spark, [job(i, n, application_url="https://acme-jobs.com/x", location=None) for i, n in enumerate(("Acme", "Acme", "Bolt"))])
    assert sorted((c.company_name_normalized, c.hiring_intensity, c.identity_basis) for c in out) == [("acme", 2, "EMPLOYER_URL"), ("bolt", 1, "EMPLOYER_URL")]
    out, _ = companies(spark, [job(i, "Rumpke", location=p, company_url="https://www.indeed.com/cmp/Rumpke-Waste-&-Recycling") for i, p in enumerate(("Toledo, OH", "Austin, TX"))])
    assert [c.identity_key for c in out] == ["source:indeed:rumpke-waste-&-recycling"] and out[0].identity_basis == "SOURCE_ID"
    out, _ = companies(spark, [job(0, "Summit Construction", location="Denver, CO"), job(1, "Summit Construction", location="Miami, FL")])
    assert sorted(c.identity_key for c in out) == ["name:summit construction|co", "name:summit construction|fl"]
    out, _ = companies(spark, [job(0, "Summit", location="Remote"), job(1, "Summit", location="Remote"), job(2, "Summit", location="Denver, CO")])
    assert sorted(c.identity_ambiguous for c in out) == [False, True, True]
    out, _ = companies(spark, [job(0, "Lone", location="Remote")])
    assert not out[0].identity_ambiguous and out[0].identity_basis == "NAME_ONLY"
    out, n = companies(spark, [job(0, "Acme", company_website="https://a.com"), job(1, "Acme", company_website="https://b.com"), job(2, "Acme")])
    assert len(out) == 3 and n == 1
    link = "https://www.linkedin.com/company/acme"
    out, n = companies(spark, [job(0, "Acme", company_website="https://a.com", company_url=link), job(1, "Bolt", company_website="https://b.com", company_url=link)])
    assert len(out) == 2 and n >= 1


def whole(jobs):
    """The sequential rule over all postings at once, without blocks or nodes."""
    domain = {str(j["ord"]): j["domain"] for j in jobs}
    parent = {k: k for k in domain}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    def groups(keys):
        found = {}
        for j in jobs:
            for key in keys(j):
                found.setdefault(key, []).append(str(j["ord"]))
        return [m for _, m in sorted(found.items()) if len(m) > 1]

    def join(roots):
        for other in roots[1:]:
            a, b = find(roots[0]), find(other)
            if a != b:
                parent[b] = a
                domain[a] = domain[a] or domain[b]

    for m in groups(lambda j: ([("d", j["domain"])] if j["domain"] and j["web"] else []) + ([("n", j["domain"], j["name"])] if j["domain"] else [])):
        join(m)
    for keys in (lambda j: [("s", s) for s in j["ids"]], lambda j: [("n", j["name"], j["state"])] if j["state"] else []):
        for m in groups(keys):
            roots = sorted({find(k) for k in m})
            if len({domain[r] for r in roots if domain[r]}) > 1:
                roots = [r for r in roots if not domain[r]]
            if roots:
                join(roots)
    out = {}
    for k in parent:
        out.setdefault(find(k), set()).add(int(k))
    return sorted(map(sorted, out.values()))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "", "a.com", "b.com"]), st.booleans(), st.sampled_from("xyz"), st.sampled_from([None, "OH", "TX"]), st.sets(st.sampled_from(["l:1", "l:2", "i:1"]), max_size=2)), min_size=1, max_size=12))
def test_blocks_equal_the_whole(spark, rows):
    jobs = [{"ord": i, "domain": d, "web": w, "name": n, "state": s, "ids": sorted(ids)} for i, (d, w, n, s, ids) in enumerate(rows)]
    df = spark.createDataFrame([(j["ord"], j["domain"], "COMPANY_WEBSITE" if j["web"] else "APPLICATION_URL", j["name"], j["state"], j["ids"]) for j in jobs], "ord long, domain string, domain_source string, company_name_normalized string, state string, source_ids array<string>")
    got = {}
    for r in identity.identify(df, Scratch(spark, "identity"))[0].collect():
        got.setdefault(r.company, set()).add(r.ord)
    assert sorted(map(sorted, got.values())) == whole(jobs)


def test_internal_ta(spark):
    for reject, review, cases in ((4, 2, {(4, False): "MATURE", (3, False): "POSSIBLE", (2, True): "MATURE", (1, True): "NONE"}), (6, 3, {(4, False): "POSSIBLE", (2, True): "NONE", (6, False): "MATURE"})):
        s = Settings(ta_reject_threshold=reject, ta_review_threshold=review)
        df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "n int, senior boolean, want string")
        assert df.where(qualify.ta_verdict(F.col("n"), F.col("senior"), s) != F.col("want")).count() == 0


def test_schema_problems(spark):
    rows = [job(0), job(1, title=None), job(2, application_url=None), job(3, source_site="glassdoor"), job(4, source_type="SCRAPED"), job(5, company_name=None, posted_at=None)]
    got = [r[0] for r in frame(spark, rows).orderBy("ord").select(normalize.schema_problems(F.lit("indeed"))).collect()]
    assert got == [[], ["MISSING_TITLE"], ["MISSING_APPLICATION_URL"], ["SOURCE_SITE_MISMATCH"], ["UNKNOWN_SOURCE_TYPE"], []]


def test_merge_keeps_known_facts(spark):
    old = spark.createDataFrame([Row(k=1, a="x", b=True), Row(k=2, a="y", b=None), Row(k=None, a="n", b=None)], "k int, a string, b boolean")
    new = spark.createDataFrame([(1, None, False, 1), (3, "z", None, 1), (None, "m", None, 1), (1, "", None, 0)], "k int, a string, b boolean, ord int")
    got = sorted(map(tuple, tables.merge_non_null(old, new, ["k"]).collect()), key=str)
    assert got == sorted([(1, "x", False), (2, "y", None), (3, "z", None), (None, "m", None)], key=str)


def test_plans(spark, tmp_path):
    path = str(tmp_path / "slice")
    spark.createDataFrame([], schemas.ATS_SLICE).write.parquet(path)
    from leadloom.sources.registry import ats_slice

    plan = ats_slice(spark, path, now(), title="welder")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(country_iso,US)" in plan
