"""Queries over the stages after qualification, stored rows, pages and taxonomy; importing this registers them.

Inputs are arithmetic over the driver's tables in text that Spark SQL and DuckDB both run; each SQL states its rule anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import email, pages, url
from leadloom.operators import coverage, discovery, enrichment, identity, matching, people, projections, tables, taxonomy
from leadloom.plans.postings import CTES, lit, normalized, spread, sql_host, table
from leadloom.plans.queries import _LEADS, SQL_PEOPLE, contacts, domains, leads, now, query
from leadloom.scratch import Scratch

def given(spark, sf: str, sql: str, name: str) -> DataFrame:
    """The rows of an input's SQL, which ends where the table's name belongs."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}") + "{t}", t=table(spark, sf, name))


def pick(key: str, values: list) -> str:
    """CASE over a key modulo the number of values."""
    shown = lambda v: "NULL" if v is None else lit(v) if isinstance(v, str) else str(v)
    return f"CASE CAST({key} % {len(values)} AS INT) " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


# --- page addresses -------------------------------------------------------------------------------------------------

URLS = [
    "https://acme.com/about/leadership", "https://acme.com/", "https://acme.com/blog/team-news", "https://acme.com/our-team.html", "https://acme.com/Who-We-Are", "https://acme.com/contact?x=/team", "https://acme.com/jobs/manager",
    "https://acme.com/sitemap.xml", "https://www.indeed.com/cmp/x", "https://boards.greenhouse.io/acme", "http://user:pw@acme.com/", "ftp://acme.com/x", "http://localhost:8080/", "http://10.1.2.3/x", "http://172.20.1.1/", "http://8.8.8.8/", "http://[::1]/",
    "http://metadata.google.internal/", "http://printer.local/", "", None, "no scheme", "http://169.254.169.254/latest", "https://acme.com/people-and-culture", "http://[2600::1]/", "http://172.32.1.1/",
]
_PEOPLE_AT = [0, 3, 4, 23]
_LISTING_AT = [2, 6, 7]
_CONTACT_AT = [0, 3, 4, 5, 23]
_REFUSED = {10: "CREDENTIALS", 11: "SCHEME", 12: "INTERNAL_HOST", 13: "NON_PUBLIC_ADDRESS", 14: "NON_PUBLIC_ADDRESS", 16: "NON_PUBLIC_ADDRESS", 17: "INTERNAL_HOST", 18: "INTERNAL_HOST", 19: "EMPTY", 20: "EMPTY", 21: "SCHEME", 22: "NON_PUBLIC_ADDRESS"}
_N = len(URLS)
_URL_ROWS = f"SELECT o_orderkey, {pick('o_orderkey', URLS)} AS url FROM "


@query("page_kinds", f"SELECT o_orderkey, k IN {tuple(_PEOPLE_AT)} AS people, k IN {tuple(_LISTING_AT)} AS listing, k IN {tuple(_CONTACT_AT)} AS reaches FROM (SELECT o_orderkey, o_orderkey % {_N} AS k FROM orders)")
def page_kinds(spark, sf):
    u = F.col("url")
    return given(spark, sf, _URL_ROWS, "orders").select("o_orderkey", pages.is_people_page(u).alias("people"), pages.is_listing_page(u).alias("listing"), pages.names_contacts(u).alias("reaches"))


@query("url_refused", f"SELECT o_orderkey, {pick('o_orderkey', [_REFUSED.get(i) for i in range(_N)])} AS refused FROM orders")
def url_refused(spark, sf):
    return given(spark, sf, _URL_ROWS, "orders").select("o_orderkey", pages.url_refused(F.col("url")).alias("refused"))


@query("page_url_safety", f"SELECT page_id, regexp_matches(url, '^https?://[^/@]+') AND NOT regexp_matches({sql_host('url')}, '^(10|127)\\.') AS safe, CASE WHEN {' OR '.join(f'contains({sql_host("url")}, {lit(h)})' for h in vocab.BOARD_HOSTS)} THEN 'JOB_BOARD' WHEN {' OR '.join(f'contains({sql_host("url")}, {lit(h)})' for h in vocab.ATS_HOSTS)} THEN 'ATS' ELSE 'COMPANY_WEBSITE' END AS source_type FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.-]+\\.[a-z]+(/|$)')")
def page_url_safety(spark, sf):
    """Every page's own address; those without an ordinary host are left to url_refused."""
    u = F.col("url")
    rows = table(spark, sf, "pages").where(u.rlike(r"^https?://[a-z0-9.-]+\.[a-z]+(/|$)"))
    return rows.select("page_id", pages.is_safe_url(u).alias("safe"), pages.source_of_url(u)["source_type"].alias("source_type"))


@query("source_of_url", f"SELECT o_orderkey, {pick('o_orderkey', ['JOB_BOARD' if i == 8 else 'ATS' if i == 9 else 'COMPANY_WEBSITE' for i in range(_N)])} AS source_type, CAST({pick('o_orderkey', [2 if i == 8 else 1 if i == 9 else 3 for i in range(_N)])} AS INTEGER) AS source_priority FROM orders")
def source_of_url(spark, sf):
    return given(spark, sf, _URL_ROWS, "orders").select("o_orderkey", pages.source_of_url(F.col("url")).alias("s")).select("o_orderkey", "s.source_type", "s.source_priority")


_HOSTS = "SELECT c_custkey, " + pick("c_custkey", ["careers.acme.com", "mail.acme.com", "team.acme.com", "acme.com", "hr.eu.acme.com", "jobs.other.com", "about.acme.com"]) + " AS host FROM "


@query("subdomain_rank", "SELECT c_custkey, CAST(" + pick("c_custkey", [0, None, 1, None, 0, None, 1]) + " AS INTEGER) AS rank FROM customer")
def subdomain_rank(spark, sf):
    return given(spark, sf, _HOSTS, "customer").select("c_custkey", pages.subdomain_rank(F.col("host"), F.lit("acme.com")).alias("rank"))


_STAMPS = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 7 = 1 THEN NULL ELSE CAST(1780000000000 + o_orderkey * 1000 AS STRING) END AS ms, " + pick("o_orderkey", ["Posted Sep 12", "jun 2", "May 31", "feb 30", "today", "Jun. 3", "December 1st"]) + " AS stamp FROM "


@query("page_stamps", f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 1 THEN (1780000000000 + o_orderkey * 1000) // 1000 END AS seconds, {pick('o_orderkey', ['2025-09-12', '2026-06-02', '2026-05-31', None, None, '2026-06-03', None])} AS day FROM orders")
def page_stamps(spark, sf):
    rows = given(spark, sf, _STAMPS, "orders")
    return rows.select("o_orderkey", F.unix_seconds(pages.epoch_millis(F.col("ms"))).alias("seconds"), F.date_format(pages.month_day(F.col("stamp"), now()), "yyyy-MM-dd").alias("day"))


_MASKED = "SELECT c_custkey, " + pick("c_custkey", ["Ann", "ann", "Bob", "Ann", None, "Ann"]) + " AS first, " + pick("c_custkey", ["Hu***n", "hus****", "Hu***n", "Huston", "H*n", "Li*"]) + " AS last, 'Ann B. Huston' AS name, " + pick("c_custkey", ["  - Ann | ", "a  b", "", None, "·x·"]) + " AS raw FROM "


@query("masked_names", "SELECT c_custkey, c_custkey % 6 IN (0, 1) AS same, " + pick("c_custkey", ["Ann", "a b", None, None, "x"]) + " AS clean FROM customer")
def masked_names(spark, sf):
    return given(spark, sf, _MASKED, "customer").select("c_custkey", pages.obfuscated_same(F.col("first"), F.col("last"), F.col("name")).alias("same"), pages.clean_text(F.col("raw")).alias("clean"))


@query("visit_keys", "SELECT o_orderkey, " + pick("o_orderkey", ["acme.com/leadership", "acme.com/leadership", "acme.com", "acme.com/a?q=1"]) + " AS key FROM orders")
def visit_keys(spark, sf):
    rows = given(spark, sf, "SELECT o_orderkey, " + pick("o_orderkey", ["https://www.Acme.com/leadership/", "http://acme.com/Leadership", "https://acme.com/", "https://acme.com/a/?q=1#top"]) + " AS url FROM ", "orders")
    return rows.select("o_orderkey", url.visit_key(F.col("url")).alias("key"))


# --- people and addresses -------------------------------------------------------------------------------------------

_METHODS = ["STRUCTURED", "MICROFORMAT", "TABLE", "BLOCK", "MAILTO", "TEXT", "LINKEDIN"]
_SIGHTED = f"SELECT o_orderkey, {pick('o_orderkey', _METHODS)} AS method, o_orderkey % 2 = 0 AS titled, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 5 AS INT) END AS tier, o_orderkey % 3 = 0 AS mailed, CAST(o_orderkey % 4 + 1 AS INT) AS wanted, CAST(o_orderkey % 3 + 1 AS INT) AS stage FROM "
_POINTS = pick("o_orderkey", [30, 25, 25, 20, 20, 10, 0])
_CONF = f"least(100, 30 + {_POINTS} + CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN o_orderkey % 5 > 0 THEN 20 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END)"


@query("contact_scores", f"""SELECT o_orderkey, CAST({_CONF} AS DOUBLE) / 100 AS confidence, CASE WHEN o_orderkey % 5 > 0 THEN CAST(round((5 - o_orderkey % 5) * 20 + CASE WHEN o_orderkey % 5 = o_orderkey % 4 + 1 THEN 10 WHEN abs(o_orderkey % 5 - (o_orderkey % 4 + 1)) = 1 THEN 5 ELSE 0 END
  + {_CONF} * 0.08 + CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 0 END - 1.5 * (o_orderkey % 3 + 1), 2) AS DOUBLE) END AS score FROM orders""")
def contact_scores(spark, sf):
    rows = given(spark, sf, _SIGHTED, "orders").withColumn("confidence", people.contact_confidence(F.col("method"), F.col("titled"), F.col("tier"), F.col("mailed")))
    return rows.select("o_orderkey", "confidence", people.contact_score(F.col("tier"), F.col("wanted"), F.col("confidence"), F.col("mailed"), F.col("stage")).cast("double").alias("score"))


_TOLD = "SELECT o_orderkey, CAST(" + pick("o_orderkey", [200, 200, 200, 401, 429, 500, 200, None]) + " AS INT) AS code, o_orderkey % 16 = 7 AS timed_out, " + pick("o_orderkey", [None, None, None, None, None, None, "out of credits", None]) + " AS error, " + pick("o_orderkey", ["valid", "Catch-All", "new word", None, None, None, None, None]) + " AS said FROM "


@query("verifier_answers", "SELECT o_orderkey, " + pick("o_orderkey", ["VALID", "RISKY", "PENDING", "PENDING", "PENDING", "PENDING", "PENDING", "PENDING"]) + " AS status, CASE WHEN o_orderkey % 16 = 7 THEN 'PROVIDER_TIMEOUT' ELSE " + pick("o_orderkey", [None, None, "UNRECOGNIZED_STATUS:new word", "PROVIDER_UNAVAILABLE", "PROVIDER_RATE_LIMITED", "PROVIDER_ERROR:HTTP_STATUS", "PROVIDER_UNAVAILABLE", "PROVIDER_ERROR:NO_ANSWER"]) + " END AS reason, o_orderkey % 8 < 2 AS billable FROM orders")
def verifier_answers(spark, sf):
    return given(spark, sf, _TOLD, "orders").select("o_orderkey", email.verifier_answer(F.col("code"), F.col("timed_out"), F.col("error"), F.col("said")).alias("a")).select("o_orderkey", "a.*")


@query("lead_status_counts", "SELECT s AS lead_status, (SELECT count(*) FROM customer WHERE c_custkey % 3 = k) AS leads FROM (VALUES ('READY', 0), ('PENDING_VERIFICATION', 1), ('NO_VERIFIED_POC_EMAIL', 7)) v(s, k)")
def lead_status_counts(spark, sf):
    rows = given(spark, sf, "SELECT CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'READY' WHEN 1 THEN 'PENDING_VERIFICATION' END AS lead_status FROM ", "customer")
    return tables.lead_status_counts(rows.where("lead_status is not null"))


_POSTED = "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, o_orderkey AS ord, array('Jobs@c' || CAST(o_custkey AS STRING) || '.com', 'x' || CAST(o_orderkey % 3 AS STRING) || '@gmail.com') AS emails FROM "


@query("company_emails", f"""{SQL_PEOPLE}, seen AS (SELECT company_id, -1 AS a, ord AS b, 0 AS c, lower(trim(email)) AS email, name FROM p WHERE email IS NOT NULL
  UNION ALL SELECT 'co-' || o_custkey, 0, o_orderkey, 0, 'jobs@c' || o_custkey || '.com', NULL FROM orders UNION ALL SELECT 'co-' || o_custkey, 0, o_orderkey, 1, 'x' || (o_orderkey % 3) || '@gmail.com', NULL FROM orders
  UNION ALL SELECT 'co-' || o_custkey, 1, min(o_orderkey % 7), 0, 'page@c' || o_custkey || '.com', NULL FROM orders GROUP BY o_custkey),
firsts AS (SELECT *, row_number() OVER (PARTITION BY company_id, email ORDER BY a, b, c) AS k FROM seen)
SELECT company_id, email FROM firsts WHERE k = 1 AND regexp_matches(email, '^[a-z0-9]')""")
def company_emails(spark, sf):
    """Addresses of people, postings and pages, each once a company."""
    pages_ = given(spark, sf, "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, o_orderkey % 7 AS page_no, 0 AS position, 'Page@c' || CAST(o_custkey AS STRING) || '.com' AS email, '' AS url, 3 AS stage FROM ", "orders")
    people_ = contacts(spark, sf).select("company_id", "ord", "email", "name", "title")
    return discovery.company_emails(people_, given(spark, sf, _POSTED, "orders"), discovery.email_ledger(pages_), domains(spark, sf)).select("company_id", "email")


# --- stored rows ----------------------------------------------------------------------------------------------------


@query("discarded_rows", CTES + " SELECT ord, 'NORMALIZE' AS stage, screen_reason AS reason, 'NORMALIZE:' || screen_reason AS counter FROM norm WHERE screen_reason IS NOT NULL")
def discarded_rows(spark, sf):
    return projections.discarded_rows(normalized(spark, sf), "NORMALIZE", "screen_reason").select("ord", "stage", "reason", "counter")


_JUDGED = (
    "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, 'k' || CAST(c_custkey AS STRING) AS dedup_key, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE lower(c_name) END AS company_name_normalized, "
    "CASE WHEN c_custkey % 2 = 0 THEN 'c' || CAST(c_custkey AS STRING) || '.com' ELSE '' END AS domain, 'DOMAIN' AS identity_basis, 'id' || CAST(c_custkey AS STRING) AS identity_key, c_name AS company_name, 'Toledo, OH' AS location, "
    + pick("c_custkey", ["QUALIFIED", "NEEDS_REVIEW", "REJECTED"])
    + " AS status, c_acctbal AS score, CASE WHEN c_custkey % 3 = 2 THEN array('STAFFING_AGENCY') ELSE CAST(array() AS array<string>) END AS reasons, CASE WHEN c_custkey % 3 = 1 THEN array('INDUSTRY_UNKNOWN', 'POSSIBLE_INTERNAL_TA') ELSE CAST(array() AS array<string>) END AS review_flags, "
    "c_custkey % 7 + 1 AS hiring_intensity, CAST(c_custkey % 30 AS INT) AS min_applicant_count, 2 AS source_priority, CAST(NULL AS STRING) AS company_industry, CAST(NULL AS STRING) AS client_industry, 'UNKNOWN' AS industry_state, CAST(c_custkey % 300 AS BIGINT) AS size_min, CASE WHEN c_custkey % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(c_custkey % 300 + 10 * (c_custkey % 2) AS BIGINT) END AS size_max, "
    "'JOB_BOARD' AS size_source, c_custkey % 6 AS ta_role_count, CASE WHEN c_custkey % 6 > 3 THEN 'MATURE' ELSE 'NONE' END AS ta_verdict, CASE WHEN c_custkey % 3 = 2 THEN 'NAME:staffing' END AS agency_evidence, array('indeed') AS source_sites, CAST(array() AS array<string>) AS source_ids, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'https://www.c' || CAST(c_custkey AS STRING) || '.com/x' END AS company_website, CAST(c_custkey % 20 AS DOUBLE) AS min_age_days FROM "
)
_FOUND = "SELECT 'k' || CAST(c_custkey AS STRING) AS dedup_key, 'found' || CAST(c_custkey AS STRING) || '.com' AS domain, 'HIGH' AS confidence, 'SEARCH' AS source, 'https://e' AS evidence_url, " + pick("c_custkey", ["ACCEPTED", "REVIEW", "UNRESOLVED", "ACCEPTED"]) + " AS decision FROM "


def _companies(spark, sf):
    found = given(spark, sf, _FOUND, "customer").where("cast(substring(dedup_key, 2) as long) % 2 = 1")
    return projections.company_rows(given(spark, sf, _JUDGED, "customer"), found, now())


@query("company_rows", """SELECT 'co-' || c AS company_id, CASE WHEN c % 9 = 0 THEN 'NO_NAME' ELSE lower(c_name) END AS normalized_name, CASE WHEN c % 2 = 0 THEN 'c' || c || '.com' ELSE 'NO_DOMAIN' END AS normalized_domain,
  CASE WHEN c % 2 = 0 THEN 'c' || c || '.com' WHEN c % 4 = 3 THEN 'found' || c || '.com' END AS domain, CASE WHEN c % 4 = 3 THEN 'HIGH' END AS domain_confidence, CASE WHEN c % 4 = 3 THEN 'SEARCH' END AS domain_source,
  CASE c % 3 WHEN 0 THEN 'QUALIFIED' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'REJECTED' END AS qualification_status, c % 6 AS internal_ta_size, CASE WHEN c % 6 > 3 THEN 'MATURE' ELSE 'OK' END AS internal_ta_verdict, c % 3 = 2 AS is_staffing_agency, c % 3 <> 2 AS is_direct_employer
  FROM (SELECT c_custkey AS c, c_name FROM customer)""")
def company_rows(spark, sf):
    return _companies(spark, sf).select("company_id", "normalized_name", "normalized_domain", "domain", "domain_confidence", "domain_source", "qualification_status", "internal_ta_size", "internal_ta_verdict", "is_staffing_agency", "is_direct_employer")


@query("qualification_reason_rows", "SELECT 'co-' || c_custkey AS company_id, CAST(i AS INTEGER) AS position, CASE WHEN c_custkey % 3 = 2 THEN 'STAFFING_AGENCY' WHEN i = 0 THEN 'INDUSTRY_UNKNOWN' ELSE 'POSSIBLE_INTERNAL_TA' END AS reason, CASE WHEN c_custkey % 3 = 2 THEN 'REJECTED' ELSE 'NEEDS_REVIEW' END AS outcome FROM customer, range(2) r(i) WHERE c_custkey % 3 = 1 OR (c_custkey % 3 = 2 AND i = 0)")
def qualification_reason_rows(spark, sf):
    return projections.reason_rows(given(spark, sf, _JUDGED, "customer")).select("company_id", "position", "reason", "outcome")


_IDENTIFIED = (
    "SELECT o_orderkey AS ord, 'c' || CAST(o_custkey AS STRING) AS company, " + pick("o_orderkey", ["j1", "", None]) + " AS external_id, 'Welder' AS title, 'welder' AS title_normalized, 'Toledo, OH' AS location, 'toledo, oh' AS location_key, 'OH' AS state, "
    "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'text' END AS description, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS posting_date, CAST(o_orderdate AS TIMESTAMP) AS posted_at, 'DAY' AS date_precision, CAST(o_orderkey % 100 AS DOUBLE) / 7 AS age_days, "
    "'https://a/' || CAST(o_orderkey AS STRING) AS application_url, CASE WHEN o_orderkey % 6 > 0 THEN 'https://a/' || CAST(o_orderkey AS STRING) END AS evidence_url, true AS fresh_keep, CAST(NULL AS STRING) AS freshness_reason, 3 AS applicant_count, 'JOB_BOARD' AS source_type, "
    + pick("o_orderkey", ["indeed", "linkedin"])
    + " AS source_site, 2 AS source_priority, CAST(NULL AS STRING) AS ats_platform FROM "
)


def _jobs(spark, sf):
    ids = given(spark, sf, "SELECT 'c' || CAST(c_custkey AS STRING) AS company, 'co-' || CAST(c_custkey AS STRING) AS company_id FROM ", "customer")
    return projections.job_rows(given(spark, sf, _IDENTIFIED, "orders"), ids, now())


@query("job_rows", "SELECT 'co-' || o_custkey AS company_id, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'j1' ELSE 'https://a/' || o_orderkey END AS external_id, CASE WHEN o_orderkey % 4 > 0 THEN 'text' END AS description, round((o_orderkey % 100) / 7, 3) AS age_days FROM orders")
def job_rows(spark, sf):
    return _jobs(spark, sf).select("company_id", "ord", "external_id", "description", "age_days")


@query("posting_evidence", "SELECT 'posting_date' AS key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS value, CASE WHEN o_orderkey % 6 > 0 THEN 'https://a/' || o_orderkey END AS url, count(*) AS n FROM orders WHERE o_orderkey % 5 > 0 GROUP BY ALL")
def posting_evidence(spark, sf):
    return projections.posting_evidence(_jobs(spark, sf)).groupBy("key", "value", "url").agg(F.count("*").alias("n"))


@query("size_evidence_rows", "SELECT 'co-' || c_custkey AS record_id, (c_custkey % 300) || '-' || CASE WHEN c_custkey % 4 = 0 THEN 'None' ELSE (c_custkey % 300 + 10 * (c_custkey % 2))::VARCHAR END AS value, 3 AS source_priority FROM customer WHERE c_custkey % 2 = 0")
def size_evidence_rows(spark, sf):
    rows = given(spark, sf, _JUDGED, "customer").select("company_id", F.col("size_min").alias("min"), F.col("size_max").alias("max"), F.lit("PUBLIC_WEB").alias("source"), F.when(F.substring("company_id", 4, 20).cast("long") % 2 == 0, F.lit("https://u")).alias("url"))
    return projections.size_evidence_rows(rows).select("record_id", "value", "source_priority")


@query("persistent_runs", "SELECT c.company_id, h.n AS persistent_hiring_runs FROM (SELECT 'co-' || c_custkey AS company_id, c_custkey FROM customer) c LEFT JOIN (SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY 1) h ON h.o_custkey = c.c_custkey")
def persistent_runs(spark, sf):
    days = given(spark, sf, "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, CAST(o_orderdate AS DATE) AS observed_on, o_orderkey AS hiring_intensity FROM ", "orders")
    history = projections.history_rows(days.drop("observed_on"), F.lit(None).cast("date")).limit(0).unionByName(days.select("company_id", "observed_on", F.col("hiring_intensity").alias("open_jobs"), F.col("hiring_intensity").alias("fresh_jobs")))
    companies = given(spark, sf, "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id FROM ", "customer")
    return projections.persistent_runs(companies, history)


@query("lead_rows", """WITH j AS (SELECT o_custkey, count(*) AS n, round(min(round((o_orderkey % 100) / 7, 3)), 3) AS freshest, arg_min('https://a/' || o_orderkey, o_orderkey) FILTER (o_orderkey % 6 > 0) AS url FROM orders GROUP BY 1)
SELECT 'co-' || c AS company_id, CASE WHEN c % 5 = 0 THEN 'https://www.c' || c || '.com/x' WHEN c % 2 = 0 THEN 'https://c' || c || '.com' WHEN c % 4 = 3 THEN 'https://found' || c || '.com' END AS website, j.n AS job_count, freshest AS freshest_job_age_days, j.url AS evidence_url,
  CASE WHEN c % 4 = 0 THEN (c % 300) || '+' WHEN c % 2 = 0 THEN (c % 300)::VARCHAR ELSE (c % 300) || '-' || (c % 300 + 10) END AS employee_size FROM (SELECT c_custkey AS c FROM customer) LEFT JOIN j ON j.o_custkey = c WHERE c % 3 <> 2""")
def lead_rows(spark, sf):
    return projections.lead_rows(_companies(spark, sf), _jobs(spark, sf)).select("company_id", "website", "job_count", "freshest_job_age_days", "evidence_url", "employee_size")


_SELECTED = "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, 'Pat Doe' AS name, CASE WHEN o_orderkey % 5 > 0 THEN 'CEO' END AS title, 1 AS title_priority, CAST(NULL AS STRING) AS email, 1.5D AS rank_score, 3 AS discovery_stage, CAST(NULL AS STRING) AS profile_url, 'COMPANY_WEBSITE' AS source_type, 3 AS source_priority, " + pick("o_orderkey", ["https://User@www.Acme.com:80/x", "https://acme.com", None]) + " AS url, 'table' AS extraction FROM "


@query("contact_rows", "SELECT 'co-' || o_custkey AS company_id, " + pick("o_orderkey", ["www.acme.com", "acme.com", None]) + " AS source, 'PUBLIC' AS origin, CASE WHEN o_orderkey % 5 > 0 THEN 'Pat Doe | CEO' ELSE 'Pat Doe | None' END AS evidence FROM orders")
def contact_rows(spark, sf):
    rows = projections.contact_rows(given(spark, sf, _SELECTED, "orders"))
    return rows.select("company_id", "source", "origin", F.concat("name", F.lit(" | "), F.coalesce("title", F.lit("None"))).alias("evidence"))


@query("contact_evidence", "SELECT value, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 > 0 THEN 'Pat Doe | CEO' ELSE 'Pat Doe | None' END AS value FROM orders) GROUP BY 1")
def contact_evidence(spark, sf):
    return projections.contact_evidence(projections.contact_rows(given(spark, sf, _SELECTED, "orders"))).groupBy("value").agg(F.count("*").alias("n"))


@query("email_evidence", "SELECT 'co-' || o_custkey AS record_id, 'a' || o_orderkey || '@x.com' AS value, CASE WHEN o_orderkey % 3 = 1 THEN 4 ELSE 3 END AS source_priority, '{\"email_type\":\"ROLE\"}' AS raw_payload FROM orders")
def email_evidence(spark, sf):
    rows = given(spark, sf, "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, 'a' || CAST(o_orderkey AS STRING) || '@x.com' AS email, 'ROLE' AS email_class, '' AS evidence_url, CASE WHEN o_orderkey % 3 = 1 THEN 'ZOOMINFO' ELSE 'PUBLIC_WEB' END AS source_type FROM ", "orders")
    return projections.email_evidence(rows).select("record_id", "value", "source_priority", "raw_payload")


_FIELDS = "SELECT CAST(c_custkey AS STRING) AS contact_id, CASE WHEN c_custkey % 2 = 0 THEN map('email', named_struct('provider', 'APOLLO', 'value', 'a@b.c', 'evidence_url', 'u')) END AS old, CASE WHEN c_custkey % 3 = 0 THEN map('email', named_struct('provider', 'ZOOMINFO', 'value', 'z@b.c', 'evidence_url', 'v'), 'title', named_struct('provider', 'ZOOMINFO', 'value', 'CEO', 'evidence_url', 'v')) END AS new FROM "


@query("provenance_evidence", """SELECT CAST(c_custkey AS VARCHAR) AS record_id, key, value FROM customer, (VALUES (0, 'apollo_email', 'a@b.c'), (1, 'zoominfo_email', 'z@b.c'), (2, 'zoominfo_title', 'CEO')) v(k, key, value)
  WHERE (k = 0 AND c_custkey % 2 = 0 AND c_custkey % 3 > 0) OR (k > 0 AND c_custkey % 3 = 0)""")
def provenance_evidence(spark, sf):
    rows = given(spark, sf, _FIELDS, "customer").select("contact_id", projections.merge_provenance(F.col("old"), F.col("new")).alias("fields"))
    return projections.provenance_evidence(rows.where("fields is not null")).select("record_id", "key", "value")


@query("strip_nulls", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE 'a' END AS keys FROM customer")
def strip_nulls(spark, sf):
    rows = given(spark, sf, "SELECT c_custkey, map('a', 'x', 'b', CASE WHEN c_custkey % 2 = 0 THEN '' END) AS m FROM ", "customer")
    return rows.select("c_custkey", F.array_join(F.array_sort(F.map_keys(projections.strip_nulls(F.col("m")))), ",").alias("keys"))


@query("kept_with_duplicates", """WITH k AS (SELECT o_custkey AS kept, count(*) FILTER (o_orderkey <> f) AS n, arg_min(o_orderkey, o_orderkey) FILTER (o_orderkey <> f) AS first_dup FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders) GROUP BY 1)
SELECT (SELECT min(o_orderkey) FROM orders o WHERE o.o_custkey = kept) AS ord, n AS n_duplicates, CASE WHEN first_dup IS NOT NULL THEN 'x' || first_dup END AS first_id FROM k""")
def kept_with_duplicates(spark, sf):
    rows = given(spark, sf, "SELECT o_orderkey AS ord, o_custkey, 'indeed' AS source_site, 'x' || CAST(o_orderkey AS STRING) AS external_id, '' AS application_url FROM ", "orders")
    firsts = rows.groupBy("o_custkey").agg(F.min("ord").alias("kept_ord"))
    lost = rows.join(firsts, "o_custkey").where("ord <> kept_ord").select(F.col("ord").alias("dup_ord"), "kept_ord", F.lit("SAME_SOURCE_ID").alias("reason"))
    out = projections.with_duplicates(firsts.select(F.col("kept_ord").alias("ord")), lost, rows)
    return out.select("ord", "n_duplicates", F.get("duplicates", F.lit(0))["external_id"].alias("first_id"))


@query("run_report", "SELECT '{\"A\":{\"x\":' || (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) || ',\"y\":' || (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1) || '}}' AS report")
def run_report(spark, sf):
    rows = given(spark, sf, "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'y' END AS reason FROM ", "customer").groupBy("reason").agg(F.count("*").alias("n"))
    return projections.report({"A": rows})


@query("csv_rows", _LEADS + """, j AS (SELECT company_id, list_sort(list_distinct(list(title ORDER BY ord)[:50])) AS titles, count(*) AS n FROM p GROUP BY 1)
SELECT s.company_id, lead_status, array_to_string(j.titles, '; ') AS job_titles, poc_rank::VARCHAR AS poc_rank, name AS contact_name, tier::VARCHAR AS contact_priority, source_type AS contact_source_type, verification_status FROM s LEFT JOIN q USING (company_id) LEFT JOIN j USING (company_id)""")
def csv_rows(spark, sf):
    """The export over every company; a company has at most fifty jobs here, so titles are all of them."""
    rows = tables.csv_rows(leads(spark, sf).withColumn("website", F.col("company_id")))
    return rows.select(F.col("website").alias("company_id"), "lead_status", "job_titles", "poc_rank", "contact_name", "contact_priority", "contact_source_type", "verification_status")


@query("audit_rows", "SELECT 'LEADS' AS stage, o_orderstatus AS event, count(*) AS n FROM orders GROUP BY ALL")
def audit_rows(spark, sf):
    return projections.audit_rows(table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), "LEADS", now()).select("stage", "event", "n")


# --- taxonomy -------------------------------------------------------------------------------------------------------

_TERMS = ["Order Picker", "Packers and Packagers, Hand", "Aerospace Engineers", "All Other Workers", "Bus", "Glass Cutter", "Press/Brake Operator", "one two three four five", "Waitress", "Miscellaneous Clerk", None, "Campus Chemist Analysis"]
_FIT = [0, 5, 8, 11]
_RAW_TITLES = ["Machinist (CNC)", "Manager", "Welder 2", "  Plant   Manager - ", "a b c d e f", "Tool & Die Maker*", None, "Cat"]
_CLEANED = ["Machinist", None, None, "Plant Manager", None, "Tool & Die Maker", None, None]


@query("searchable_terms", f"SELECT p_partkey, k IN {tuple(_FIT)} AS fit, {pick('p_partkey', _CLEANED)} AS clean, CASE p_partkey % 3 WHEN 0 THEN '53-0000' ELSE '' END AS major FROM (SELECT p_partkey, p_partkey % {len(_TERMS)} AS k FROM part)")
def searchable_terms(spark, sf):
    rows = given(spark, sf, f"SELECT p_partkey, {pick('p_partkey', _TERMS)} AS term, {pick('p_partkey', _RAW_TITLES)} AS raw, {pick('p_partkey', ['53-7065', '', None])} AS soc FROM ", "part")
    return rows.select("p_partkey", taxonomy.is_searchable(F.col("term")).alias("fit"), taxonomy.clean_title(F.col("raw")).alias("clean"), taxonomy.soc_major(F.col("soc")).alias("major"))


_REPORTED = "SELECT 's' || CAST(p_partkey % 20 AS STRING) AS soc_code, CAST(p_partkey % 2 AS INT) AS part, p_partkey AS ord, 'Maker ' || chr(CAST(65 + p_partkey % 17 AS INT)) || chr(CAST(97 + p_partkey % 13 AS INT)) AS title FROM "


@query("rank_terms", f"""WITH r AS ({_REPORTED}part), f AS (SELECT soc_code, lower(title) AS low, min(row(part, ord, title)) AS m FROM r GROUP BY 1, 2), k AS (SELECT soc_code, title, row_number() OVER (PARTITION BY soc_code ORDER BY part, ord, low) - 1 AS rank
  FROM (SELECT r.soc_code, lower(r.title) AS low, arg_min(r.title, r.part * 1000000000 + r.ord) AS title, min(r.part * 1000000000 + r.ord) // 1000000000 AS part, min(r.part * 1000000000 + r.ord) % 1000000000 AS ord FROM r GROUP BY 1, 2)) SELECT soc_code, title AS search_term, rank FROM k WHERE rank < 18""")
def rank_terms(spark, sf):
    return taxonomy.rank_terms(given(spark, sf, _REPORTED, "part")).select("soc_code", "search_term", F.col("rank").cast("long").alias("rank"))


@query("top_occupations", "SELECT naics3, soc_code, rank FROM (SELECT *, row_number() OVER (PARTITION BY naics3 ORDER BY employed DESC, soc_code) - 1 AS rank FROM (SELECT 'n' || (c_nationkey) AS naics3, 's' || c_custkey AS soc_code, c_acctbal AS employed FROM customer)) WHERE rank < 40")
def top_occupations(spark, sf):
    rows = given(spark, sf, "SELECT 'n' || CAST(c_nationkey AS STRING) AS naics3, 's' || CAST(c_custkey AS STRING) AS soc_code, c_acctbal AS employed FROM ", "customer")
    return taxonomy.top_occupations(rows).select("naics3", "soc_code", F.col("rank").cast("long").alias("rank"))


_UNIVERSE = "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'EXPLORATION' ELSE 'CORE' END AS tier, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Retail' END AS client_industry, CAST(10 + p_partkey % 8 AS STRING) || '-' || CAST(p_partkey % 11 AS STRING) AS soc_code, 'Maker ' || chr(CAST(65 + p_partkey % 23 AS INT)) || CASE WHEN p_partkey % 4 = 0 THEN ', Hand' ELSE '' END AS search_term, CAST(p_partkey % 9 AS INT) AS rank FROM "


@query("terms_by_industry", f"WITH t AS ({_UNIVERSE}part) SELECT client_industry, row_number() OVER (PARTITION BY client_industry ORDER BY rank, soc_code, search_term) AS place, search_term FROM t WHERE tier = 'CORE' AND client_industry <> ''")
def terms_by_industry(spark, sf):
    return taxonomy.terms_by_industry(given(spark, sf, _UNIVERSE, "part")).select("client_industry", F.col("place").cast("long").alias("place"), "search_term")


_INDUSTRIES = "SELECT 'n' || CAST(c_nationkey AS STRING) AS naics3, CASE WHEN c_nationkey % 2 = 0 THEN 'Retail' ELSE 'Other' END AS client_industry, CAST(10 + c_custkey % 8 AS STRING) || '-' || CAST(c_custkey % 11 AS STRING) AS soc_code, CAST(c_custkey AS INT) AS rank FROM "


@query("suggest_terms", f"""WITH t AS ({_UNIVERSE}part), i AS ({_INDUSTRIES}customer), m AS (SELECT t.search_term, i.naics3, i.rank AS place, i.soc_code, t.rank FROM i JOIN t USING (soc_code) WHERE i.client_industry = 'Retail' AND substr(soc_code, 1, 2) NOT IN ('15', '11') AND t.rank <= 5 AND NOT contains(search_term, ',')),
f AS (SELECT search_term, min({{'a': naics3, 'b': place, 'c': soc_code, 'd': rank}}) AS seen FROM m GROUP BY 1) SELECT row_number() OVER (ORDER BY seen, search_term) AS place, search_term FROM f""")
def suggest_terms(spark, sf):
    out = taxonomy.suggest_terms("Retail", given(spark, sf, _INDUSTRIES, "customer"), given(spark, sf, _UNIVERSE, "part"), excluded=["11-0000"])
    return out.select(F.col("place").cast("long").alias("place"), "search_term")


@query("title_votes", "WITH v AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS industry, count(*) AS n, min(o_orderkey) AS o FROM orders WHERE o_orderkey % 4 > 0 GROUP BY ALL) SELECT 'c' || c AS company, arg_max(industry, n * 1000000000 - o) AS hint FROM v GROUP BY c")
def title_votes(spark, sf):
    rows = given(spark, sf, "SELECT 'c' || CAST(o_custkey AS STRING) AS company, o_orderkey AS ord, 't' || CAST(o_orderkey % 12 AS STRING) AS title FROM ", "orders")
    named = spark.sql("SELECT 't' || CAST(id AS STRING) AS title, CASE WHEN id % 4 = 0 THEN CAST(NULL AS STRING) WHEN id % 3 = 0 THEN 'A' ELSE 'B' END AS industry FROM range(12)")
    return taxonomy.title_votes(rows, named)


# --- runs of sources ------------------------------------------------------------------------------------------------

_ENDS = "SELECT 's' || CAST(o_custkey % 5 AS STRING) AS source, 'q' || CAST(o_orderkey % 300 AS STRING) AS query, 'US' AS location_scope, " + pick("o_orderkey", ["SOURCE_EXHAUSTED", "ERROR", "ERROR", "ERROR", "RATE_LIMITED", "BLOCKED", "BUDGET_REACHED", "ERROR"]) + " AS stop_reason, " + pick("o_orderkey", [None, "TimeoutError", "PARSE_FAILED", None, None, None, None, None]) + " AS error_type, " + pick("o_orderkey", [None, "it timed out", "no rows", "gone", None, None, None, "HTTP 429"]) + " AS error_message, CAST(o_orderkey % 3 AS BIGINT) AS jobs_returned, CAST(o_orderkey % 2 AS BIGINT) AS jobs_accepted FROM "
_CLASSES = "CASE k WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'PARSE_FAILURE' WHEN 3 THEN 'FETCH_FAILURE' WHEN 4 THEN 'RATE_LIMITED' WHEN 5 THEN 'BLOCKED' WHEN 7 THEN 'RATE_LIMITED' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'EMPTY_RESULT' ELSE 'OK' END END"


@query("load_test", f"""WITH r AS (SELECT *, {_CLASSES} AS class FROM (SELECT *, o_orderkey % 8 AS k, 's' || (o_custkey % 5) AS source FROM orders)), c AS (SELECT source, string_agg(class || '=' || n, ',' ORDER BY class) AS classes FROM (SELECT source, class, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1),
d AS (SELECT source, count(*) FILTER (n > 1) AS repeated_slices FROM (SELECT source, o_orderkey % 300 AS q, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1)
SELECT r.source, count(*) AS queries, sum(o_orderkey % 3)::BIGINT AS jobs_returned, round(count(*) FILTER (class IN ('OK', 'EMPTY_RESULT')) / count(*), 3) AS success_rate, count(*) FILTER (class = 'TIMEOUT') AS timeouts, count(*) FILTER (class = 'PARSE_FAILURE') AS parse_errors,
  count(*) FILTER (o_orderkey % 3 = 0 AND k IN (4, 5, 6)) AS silent_empty, any_value(classes) AS classes, any_value(repeated_slices) AS repeated_slices FROM r JOIN c USING (source) JOIN d USING (source) GROUP BY 1""")
def load_test(spark, sf):
    return coverage.load_test(given(spark, sf, _ENDS, "orders")).select("source", "queries", "jobs_returned", "success_rate", "timeouts", "parse_errors", "silent_empty", "classes", "repeated_slices")


@query("credits_by_provider", "WITH a AS (SELECT 'p' || (o_custkey % 3) AS provider, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 1.5 ELSE 0 END AS credits FROM orders), h AS (SELECT provider, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM (SELECT provider, status, count(*) AS n FROM a GROUP BY ALL) GROUP BY 1) SELECT provider, count(*) AS attempts, CAST(round(sum(credits), 4) AS DOUBLE) AS credits, any_value(statuses) AS statuses FROM a JOIN h USING (provider) GROUP BY 1")
def credits_by_provider(spark, sf):
    rows = given(spark, sf, "SELECT 'p' || CAST(o_custkey % 3 AS STRING) AS provider, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 1.5D END AS credits FROM ", "orders")
    return coverage.credits_by_provider(rows)


@query("source_outcomes", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'SUCCESS' WHEN o_orderkey % 2 = 1 THEN 'ERROR' ELSE 'EMPTY' END AS outcome, CASE WHEN o_orderkey % 7 = 0 THEN 'ERROR' WHEN o_orderkey % 100 >= 50 THEN 'BUDGET_REACHED' ELSE 'SOURCE_EXHAUSTED' END AS slice, CASE WHEN o_orderkey % 7 = 0 THEN 'ERROR' ELSE 'SOURCE_EXHAUSTED' END AS board FROM orders")
def source_outcomes(spark, sf):
    from leadloom.sources.boards import adapter_outcome

    n, error = F.col("o_orderkey") % 100, F.when(F.col("o_orderkey") % 7 == 0, F.lit("x"))
    return table(spark, sf, "orders").select("o_orderkey", coverage.source_outcome(F.col("o_orderkey") % 3, F.col("o_orderkey") % 2).alias("outcome"), adapter_outcome("ats", n, F.lit(50), error).alias("slice"), adapter_outcome("board", n, F.lit(50), error).alias("board"))


@query("actor_windows", "SELECT o_orderkey, CASE WHEN h > 0 THEN h + 24 END AS glassdoor, CASE WHEN h > 0 THEN CASE WHEN h <= 24 THEN 24 WHEN h <= 72 THEN 72 WHEN h <= 168 THEN 168 WHEN h <= 336 THEN 336 ELSE 744 END END AS zip FROM (SELECT o_orderkey, o_orderkey % 900 AS h FROM orders)")
def actor_windows(spark, sf):
    from leadloom.sources.boards import actor_window

    h = F.col("o_orderkey") % 900
    return table(spark, sf, "orders").select("o_orderkey", actor_window("glassdoor", h).alias("glassdoor"), actor_window("zip_recruiter", h).cast("long").alias("zip"))


_ITEM = """'{"title":"' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Welder' END || '","platform_url":"https://g/' || CAST(o_orderkey AS STRING) || '","company_name":"Acme","location":{"raw":"Toledo, OH","country_code":"US"},"description":"<p>Weld <b>things</b></p>","posted_date":"2026-05-30","emails":["a@b.com",""],"official_url":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"https://o"' END || '}'"""
_ZIPPED = """'{"title":"Welder","dataType":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'ad' ELSE 'job' END || '","id":"' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END || '","url":"https://z/' || CAST(o_orderkey AS STRING) || '","company":"Bolt","postedDate":"x"}'"""


@query("actor_postings", """SELECT o_orderkey AS ord, 'glassdoor' AS source_site, 'https://g/' || o_orderkey AS external_id, 'Acme' AS company_name, 'Weld things' AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'https://g/' || o_orderkey ELSE 'https://o' END AS apply_url, 1 AS emails, TIMESTAMP '2026-05-30 00:00:00' AS posted_at FROM orders WHERE o_orderkey % 5 > 0
  UNION ALL SELECT o_orderkey, 'zip_recruiter', CASE WHEN o_orderkey % 2 = 0 THEN 'https://z/' || o_orderkey ELSE o_orderkey::VARCHAR END, 'Bolt', NULL, 'https://z/' || o_orderkey, 0, NULL FROM orders WHERE o_orderkey % 3 > 0""")
def actor_postings(spark, sf):
    from leadloom.sources import boards

    parts = [boards.actor_postings(given(spark, sf, f"SELECT o_orderkey AS ord, {item} AS item FROM ", "orders"), portal) for portal, item in (("glassdoor", _ITEM), ("zip_recruiter", _ZIPPED))]
    shown = [p.select("ord", "source_site", "external_id", "company_name", "description", "apply_url", F.size("observed_emails").alias("emails"), "posted_at") for p in parts]
    return shown[0].unionByName(shown[1])


# --- boards' pages --------------------------------------------------------------------------------------------------

_CARD = """'<div class="snippetPadding"><h3 class="itemTitle"><a href="/job/' || CAST(o_orderkey % 500 AS STRING) || '">Welder</a></h3><span class="colorCompany">Acme</span><span class="colorLocation">Toledo, OH</span><span class="colorDate">May 30</span><div class="jdSnippet">weld</div></div>'"""
_STATE = """'<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"jobs":[{"title":"Machinist","company":"Bolt","botUrl":"/j/' || CAST(o_orderkey AS STRING) || '","dateOnIndeed":1780000000000,"jobTypes":["Full-time","Contract"]},{"company":"none"}]}}}</script>'"""
_TALENT = """'<div data-testid="job-card-unified"><a href="https://t/' || CAST(o_orderkey AS STRING) || '"><h2 class="x JobCard_title__1">Fitter</h2></a><b class="JobCard_company__2">Cog</b><time datetime="2026-05-29T00:00:00Z">2 days ago</time></div>'"""
_BOARD = "SELECT " + pick("o_orderkey", ["postjobfree", "simplyhired", "talent_com", "postjobfree"]) + " AS site, 'q' || CAST(o_custkey AS STRING) AS query, CAST(o_orderkey % 4 + 1 AS INT) AS page_no, 'https://p/' || CAST(o_orderkey AS STRING) AS url, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN {card} WHEN 1 THEN {state} WHEN 2 THEN {talent} ELSE CASE WHEN o_orderkey % 8 = 3 THEN 'Your search did not match any jobs' ELSE '<p>new layout</p>' END END AS html, true AS ok, CAST(NULL AS STRING) AS error, CAST(NULL AS INT) AS status FROM ".format(card=_CARD, state=_STATE, talent=_TALENT)


@query("board_postings", """SELECT 'https://p/' || o_orderkey AS url, CASE o_orderkey % 4 WHEN 0 THEN 'https://www.postjobfree.com/job/' || (o_orderkey % 500) WHEN 1 THEN 'https://www.simplyhired.com/j/' || o_orderkey ELSE 'https://t/' || o_orderkey END AS external_id, CASE o_orderkey % 4 WHEN 0 THEN 'Welder' WHEN 1 THEN 'Machinist' ELSE 'Fitter' END AS title,
  CASE o_orderkey % 4 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Bolt' ELSE 'Cog' END AS company_name, CASE o_orderkey % 4 WHEN 0 THEN '2026-05-30' WHEN 1 THEN '2026-05-28' ELSE '2026-05-29' END AS posted_on, CASE WHEN o_orderkey % 4 = 1 THEN 'Full-time, Contract' END AS employment_type FROM orders WHERE o_orderkey % 4 < 3""")
def board_postings(spark, sf):
    from leadloom.sources import boards

    pages_ = given(spark, sf, _BOARD, "orders").withColumn("query", F.col("url"))
    rows = boards.board_postings(pages_, now())
    return rows.select(F.col("query").alias("url"), "external_id", "title", "company_name", F.date_format("posted_at", "yyyy-MM-dd").alias("posted_on"), "employment_type")


_PAGED = "(SELECT o_orderkey AS k, explode(sequence(1, 7)) AS p FROM {t})"
_WALK = "SELECT 'talent_com' AS site, 'q' || CAST(k AS STRING) AS query, CAST(p AS INT) AS page_no, 'https://t/' AS url, '<p>' AS html, k % 11 > 0 OR p < 3 AS ok, CASE WHEN k % 11 = 0 THEN 'ROBOTS_DISALLOWED' END AS error, CAST(NULL AS INT) AS status FROM " + _PAGED
_SHOWN = "SELECT 'talent_com' AS site, 'q' || CAST(k AS STRING) AS query, CAST(p AS INT) AS page_no, CAST(0 AS INT) AS position, 'r' || CAST(k AS STRING) || '-' || CAST(CASE WHEN p = 5 AND k % 3 = 0 THEN 4 ELSE p END AS STRING) AS external_id, '' AS application_url FROM " + _PAGED + " WHERE NOT (k % 7 = 0 AND p = 1)"


@query("page_walk", """WITH e AS (SELECT o_orderkey AS q, p, CASE WHEN p > 6 THEN 'BUDGET_REACHED' WHEN o_orderkey % 11 = 0 AND p >= 3 THEN 'ROBOTS_RESTRICTED' WHEN o_orderkey % 7 = 0 AND p = 1 THEN 'ERROR' WHEN p = 5 AND o_orderkey % 3 = 0 THEN 'SOURCE_EXHAUSTED' END AS ends FROM orders, range(1, 8) r(p)),
s AS (SELECT q, min(p) AS stop, arg_min(ends, p) AS ends FROM e WHERE ends IS NOT NULL GROUP BY 1)
SELECT 'q' || q AS query, ends AS stop_reason, stop - 1 AS jobs_accepted FROM s""")
def page_walk(spark, sf):
    from leadloom.sources import boards

    t = spread(table(spark, sf, "orders").select("o_orderkey"))
    return boards.page_walk(spark.sql(_WALK, t=t), spark.sql(_SHOWN, t=t), 6, 1000)[1].select("query", "stop_reason", "jobs_accepted")


_OPEN_JOBS = "SELECT o_orderkey AS ord, " + pick("o_orderkey", ["simplyhired", "talent_com"]) + " AS source_site, 'https://d/' || CAST(o_orderkey AS STRING) AS application_url, CASE WHEN o_orderkey % 3 = 0 THEN 'known' ELSE '' END AS description, CASE WHEN o_orderkey % 6 = 0 THEN TIMESTAMP '2026-05-01 00:00:00' END AS posted_at, CAST(NULL AS STRING) AS employment_type, CAST(array() AS array<string>) AS observed_emails, CAST(NULL AS INT) AS applicant_count FROM "
_DETAIL = """SELECT 'https://d/' || CAST(o_orderkey AS STRING) AS url, '<script type="application/ld+json">{"@type":"JobPosting","title":"x","datePosted":"2026-05-20","employmentType":"FULL_TIME","description":"Mail hr' || CAST(o_orderkey AS STRING) || '@x.com"}</script><p>Over 1,200 applicants</p>' AS html FROM """


@query("detail_pages", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 AS site, row_number() OVER (PARTITION BY o_orderkey % 2, o_orderkey % 6 > 0 ORDER BY o_orderkey) AS n FROM orders)
SELECT k AS ord, k % 6 > 0 AND n <= 10 AS looked, CASE WHEN k % 6 = 0 THEN '2026-05-01' WHEN n <= 10 THEN '2026-05-20' END AS posted_on, CASE WHEN k % 3 = 0 THEN 'known' WHEN n <= 10 THEN 'Mail hr' || k || '@x.com' ELSE '' END AS description FROM o""")
def detail_pages(spark, sf):
    from leadloom.sources import boards

    rows = boards.enrich_from_details(given(spark, sf, _OPEN_JOBS, "orders"), given(spark, sf, _DETAIL, "orders"))
    return rows.select("ord", (F.size("observed_emails") > 0).alias("looked"), F.date_format("posted_at", "yyyy-MM-dd").alias("posted_on"), "description")


@query("applicant_counts", "SELECT o_orderkey AS ord, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 ORDER BY o_orderkey LIMIT 50) THEN 1200 END AS applicant_count FROM orders")
def applicant_counts(spark, sf):
    from leadloom.sources import boards

    return boards.applicant_counts(given(spark, sf, _OPEN_JOBS, "orders"), given(spark, sf, _DETAIL, "orders"), "talent_com").select("ord", "applicant_count")


# --- discovery ------------------------------------------------------------------------------------------------------

_SITES = "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, CASE WHEN c_custkey % 3 > 0 THEN 'https://www.c' || CAST(c_custkey AS STRING) || '.com/en' END AS website, 'c' || CAST(c_custkey AS STRING) || '.com' AS domain FROM "
_AT = "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, CAST(o_orderkey AS INT) AS position, CASE WHEN o_orderkey % 4 > 0 THEN 'https://indeed.com/j/' || CAST(o_orderkey AS STRING) END AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'https://indeed.com/cmp/' || CAST(o_custkey AS STRING) END AS company_url FROM "

@query("pages_to_read", """WITH c AS (SELECT c_custkey AS c, c_custkey % 3 > 0 AS site FROM customer), j AS (SELECT o_custkey AS c, least(5, count(*) FILTER (o_orderkey % 4 > 0)) AS jobs, max(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS profile FROM orders GROUP BY 1)
SELECT 'co-' || c AS company_id, coalesce(jobs, 0) AS jobs, coalesce(profile, 0) AS profiles, CASE WHEN site THEN 1 + 18 + 6 ELSE 0 END AS own FROM c LEFT JOIN j USING (c) WHERE site OR coalesce(jobs, 0) + coalesce(profile, 0) > 0""")
def pages_to_read(spark, sf):
    """How many pages of each kind a company has: homepage and /, and /contact and /contact/, are one page each."""
    empty = spark.createDataFrame([], "company_id string, position int, url string")
    hosts = given(spark, sf, "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, explode(array('careers.c' || CAST(c_custkey AS STRING) || '.com', 'mail.c' || CAST(c_custkey AS STRING) || '.com', 'team.c' || CAST(c_custkey AS STRING) || '.com')) AS host FROM ", "customer")
    order = discovery.read_order(discovery.candidate_pages(given(spark, sf, _SITES, "customer"), given(spark, sf, _AT, "orders"), empty, empty, hosts))
    n = lambda stage: F.count_if(F.col("stage") == stage)
    return order.groupBy("company_id").agg(n(1).alias("jobs"), n(2).alias("profiles"), n(3).alias("own"))


_ORDERED = "SELECT 'co-' || CAST(l_orderkey AS STRING) AS company_id, CAST(l_linenumber AS INT) AS page_no, CASE WHEN l_linenumber < 3 THEN 1 WHEN l_linenumber < 4 THEN 2 ELSE 3 END AS stage, 'u' AS url FROM "
_FOUND_PEOPLE = "SELECT 'co-' || CAST(l_orderkey AS STRING) AS company_id, CAST(l_linenumber AS INT) AS page_no, explode(array('Pat ' || CAST(l_partkey % 3 AS STRING), 'Kim ' || CAST(l_suppkey % 2 AS STRING))) AS name, CASE WHEN l_quantity > 10 THEN 'CEO' ELSE 'Welder' END AS title FROM "


@query("pages_read", """WITH p AS (SELECT l_orderkey AS c, l_linenumber AS p, CASE WHEN l_linenumber < 3 THEN 1 WHEN l_linenumber < 4 THEN 2 ELSE 3 END AS s, l_quantity > 10 AS real, 'pat ' || (l_partkey % 3) AS a, 'kim ' || (l_suppkey % 2) AS b FROM lineitem),
n AS (SELECT c, p, s, a AS who FROM p WHERE real UNION SELECT c, p, s, b FROM p WHERE real),
k AS (SELECT p.c, p.p, (SELECT count(DISTINCT who) FROM n WHERE n.c = p.c AND n.s = p.s AND n.p < p.p) >= 3 OR (SELECT count(DISTINCT who) FROM n WHERE n.c = p.c AND n.s < p.s) >= 3 AS enough FROM (SELECT DISTINCT c, p, s FROM p) p)
SELECT 'co-' || c AS company_id, count(*) FILTER (p <= 5 AND p < coalesce((SELECT min(x.p) FROM k x WHERE x.c = k.c AND x.enough), 99)) AS pages FROM k GROUP BY c""")
def pages_read(spark, sf):
    from leadloom.vocab import Settings

    order = given(spark, sf, _ORDERED, "lineitem").distinct()
    read = discovery.pages_read(order, given(spark, sf, _FOUND_PEOPLE, "lineitem"), Settings(contacts_max_pages=5))
    return order.select("company_id").distinct().join(read.groupBy("company_id").agg(F.count("*").alias("pages")), "company_id", "left").fillna(0, ["pages"])


@query("email_ledger", "SELECT 'co-' || o_custkey AS company_id, 'a' || (o_orderkey % 3) || '@x.com' AS email, min(o_orderkey) AS page_no FROM orders GROUP BY ALL")
def email_ledger(spark, sf):
    rows = given(spark, sf, "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, o_orderkey AS page_no, 0 AS position, 'A' || CAST(o_orderkey % 3 AS STRING) || '@x.com ' AS email, 'u' AS url, 3 AS stage FROM ", "orders")
    return discovery.email_ledger(rows).select("company_id", "email", "page_no")


@query("size_from_pages", """WITH p AS (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS phase FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'co-' || c AS company_id, arg_min(k, phase * 1000000000 + k) % 1000 + 10 AS min, CASE WHEN min(phase) = 0 THEN 'PUBLIC_WEB' ELSE 'PUBLIC_WEB_SUBDOMAIN' END AS source FROM p GROUP BY c""")
def size_from_pages(spark, sf):
    rows = given(spark, sf, "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, CAST(o_orderkey % 2 AS INT) AS phase, CAST(o_orderkey AS INT) AS page_no, 'u' AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'We employ ' || CAST(o_orderkey % 1000 + 10 AS STRING) || ' people here.' ELSE 'Founded in 1980.' END AS text FROM ", "orders")
    return discovery.size_from_pages(rows).select("company_id", "min", "source")


@query("within_budget", "SELECT 'co-' || c_custkey AS company_id, row_number() OVER (ORDER BY -(c_custkey % 7), coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 20 END, 99), 'co-' || c_custkey) <= 40 AS searched FROM customer")
def within_budget(spark, sf):
    rows = given(spark, sf, "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, c_custkey % 7 AS hiring_intensity, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 20 AS DOUBLE) END AS min_age_days FROM ", "customer")
    return discovery.within_budget(rows, 40).select("company_id", "searched")


_ASK = "SELECT 'k' || CAST(c_custkey AS STRING) AS dedup_key, 'Summit Tools Inc' AS name, 'Toledo, OH' AS location, CASE WHEN c_custkey % 10 = 0 THEN 'own.com' ELSE '' END AS domain, " + pick("c_custkey", ["QUALIFIED", "NEEDS_REVIEW", "REJECTED"]) + " AS status, c_custkey % 7 AS hiring_intensity, CAST(c_custkey % 20 AS DOUBLE) AS min_age_days FROM "
_STORED = "SELECT 'k' || CAST(c_custkey AS STRING) AS dedup_key, CASE WHEN c_custkey % 4 = 0 THEN 'acme.com' END AS domain, CASE WHEN c_custkey % 4 = 0 THEN 'HIGH' ELSE 'LOW' END AS domain_confidence, 'SEARCH' AS domain_source, CAST(NULL AS STRING) AS domain_evidence_url, CASE WHEN c_custkey % 8 < 4 THEN TIMESTAMP '2026-05-28 00:00:00' ELSE TIMESTAMP '2025-01-01 00:00:00' END AS domain_resolved_at FROM "


@query("resolution_counts", """WITH c AS (SELECT c_custkey AS c, c_custkey % 3 AS q, c_custkey % 4 AS s, c_custkey % 8 < 4 AS young FROM customer WHERE c_custkey % 10 > 0 AND c_custkey % 3 < 2),
t AS (SELECT *, s = 0 AND young AS hit, s = 1 AND young AS gone FROM c), a AS (SELECT *, row_number() OVER (ORDER BY q, -(c % 7), c % 20, 'k' || c) <= 150 AS allowed FROM t WHERE NOT hit AND NOT gone)
SELECT outcome, count(*) AS n FROM (SELECT 'cached' AS outcome FROM t WHERE hit UNION ALL SELECT 'unresolved' FROM t WHERE gone UNION ALL
  SELECT CASE WHEN NOT allowed THEN 'skipped_budget' WHEN c % 5 = 0 THEN 'resolved' WHEN c % 6 = 0 THEN 'resolved' WHEN c % 6 = 1 THEN 'needs_review' ELSE 'unresolved' END FROM a) GROUP BY 1""")
def resolution_counts(spark, sf):
    """Caches first, then source links, then what a search would have found, up to the run's budget."""
    c = table(spark, sf, "customer")
    links = c.where("c_custkey % 5 = 0").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("dedup_key"), F.lit(1).alias("position"), F.lit("https://www.summit.com/x").alias("url"))
    tried = c.where("c_custkey % 6 < 3").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("dedup_key"), F.lit(1).alias("seq"), F.when(F.col("c_custkey") % 6 == 2, F.lit("zzz.com")).otherwise(F.lit("summittools.com")).alias("domain"), F.lit("Welcome").alias("title"), F.when(F.col("c_custkey") % 6 == 0, F.lit("Summit makes tools in Toledo.")).otherwise(F.lit("nothing here")).alias("body"))
    stored = given(spark, sf, _STORED, "customer").where("cast(substring(dedup_key, 2) as long) % 4 < 2")
    return discovery.resolution_counts(discovery.resolve(given(spark, sf, _ASK, "customer"), links, tried, stored, now()))


# --- providers' answers ---------------------------------------------------------------------------------------------

_CO = "'co-' || CAST(c_custkey AS STRING) AS company_id"
_COMPANY_BODY = """SELECT """ + _CO + """, '{"data":{"result":[{"data":[{"id":' || CAST(c_custkey AS STRING) || ',"name":"Acme","website":"acme.com","domainList":["acme.com"],"employeeCount":"' || CASE WHEN c_custkey % 3 = 0 THEN 'many' ELSE '120' END || '","state":"OH"}]},{"data":' || CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE '[{"id":7,"name":"Bolt"}]' END || '}]}}' AS body FROM """
_PERSON_BODY = """SELECT """ + _CO + """, '{"data":{"result":[{"data":[{"id":"p' || CAST(c_custkey AS STRING) || '","firstName":"Ann","lastName":' || CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE '"Lee"' END || ',"jobTitle":"CEO","email":"a@b.com","company":{"id":"9"},"contactAccuracyScore":90,"externalUrls":[{"type":"site","url":"u0"},{"type":"LinkedIn.com","url":"u1"},{"type":"linkedin","url":"u2"}]}]}]}}' AS body FROM """


@query("provider_companies", "SELECT 'co-' || c_custkey AS company_id, c_custkey::VARCHAR AS cand_id, CASE WHEN c_custkey % 3 > 0 THEN 120 END AS employee_count, 'OH' AS state FROM customer UNION ALL SELECT 'co-' || c_custkey, '7', NULL, NULL FROM customer WHERE c_custkey % 2 = 1")
def provider_companies(spark, sf):
    return enrichment.parse_companies(given(spark, sf, _COMPANY_BODY, "customer")).select("company_id", "cand_id", "employee_count", "state")


@query("provider_people", "SELECT 'co-' || c_custkey AS company_id, 'p' || c_custkey AS person_id, CASE WHEN c_custkey % 2 = 0 THEN 'Ann' ELSE 'Ann Lee' END AS name, 'u1' AS profile_url, '9' AS works_at, CAST(0.9 AS DOUBLE) AS confidence FROM customer")
def provider_people(spark, sf):
    return enrichment.parse_people(given(spark, sf, _PERSON_BODY, "customer")).select("company_id", "person_id", "name", "profile_url", "works_at", "confidence")


_CALLS = "SELECT o_orderkey, CAST(" + pick("o_orderkey", [200, 200, 401, 429, 500, None]) + " AS INT) AS code, o_orderkey % 6 = 5 AS timed_out, CAST(o_orderkey % 4 AS INT) AS records FROM "


@query("provider_calls", "SELECT o_orderkey, CASE WHEN k = 2 THEN 'PROVIDER_UNAVAILABLE' WHEN k = 3 THEN 'PROVIDER_RATE_LIMITED' WHEN k = 4 THEN 'PROVIDER_ERROR' WHEN k = 5 THEN 'PROVIDER_TIMEOUT' WHEN n = 0 THEN 'NO_MATCH' ELSE 'SUCCESS' END AS status, k < 2 AS billable, CAST(CASE WHEN k < 2 THEN n ELSE 0 END AS DOUBLE) AS credits FROM (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % 4 AS n FROM orders)")
def provider_calls(spark, sf):
    return given(spark, sf, _CALLS, "orders").select("o_orderkey", enrichment.provider_call(F.col("code"), F.col("timed_out"), F.col("records")).alias("c")).select("o_orderkey", "c.*")


_NAMES = ["Ann Lee", "Bob Ray", "Cy Fox", "Di Orr", "Ed Poe", "Flo Roy", "Gus Kay"]
_PREVIEWS = "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, CAST(o_orderkey AS INT) AS seq, 'p' || CAST(o_orderkey AS STRING) AS person_id, " + pick("o_orderkey", _NAMES) + " AS name, " + pick("o_orderkey", ["CEO", "Plant Manager", "Welder", "HR Manager", "COO"]) + " AS title, o_orderkey % 3 > 0 AS has_email, CAST(o_orderkey % 50 AS DOUBLE) AS score, CASE WHEN o_orderkey % 11 = 0 THEN 'elsewhere' END AS works_at FROM "
_TIER_OF = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 END"


def _strong(spark, sf):
    rows = given(spark, sf, "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, CAST(1 AS BIGINT) AS ord, CASE WHEN c_custkey % 2 = 0 THEN 'Ann Lee' ELSE 'Bob Ray' END AS name, 'ann.lee@c' || CAST(c_custkey AS STRING) || '.com' AS email FROM ", "customer")
    return rows, domains(spark, sf)


@query("worth_enriching", f"""WITH p AS (SELECT o_custkey AS c, o_orderkey AS k, {_TIER_OF} AS tier, o_orderkey % 50 AS score, o_orderkey % 7 AS n FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 <> 2 AND o_orderkey % 11 > 0),
w AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY tier, -score, k) AS r FROM p WHERE NOT (n = 0 AND c % 2 = 0) AND NOT (n = 1 AND c % 2 = 1)) SELECT 'co-' || c AS company_id, 'p' || k AS person_id FROM w WHERE r <= 3""")
def worth_enriching(spark, sf):
    matches = given(spark, sf, "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, 'here' AS provider_company_id FROM ", "customer")
    have, roots = _strong(spark, sf)
    wanted = enrichment.wanted_previews(given(spark, sf, _PREVIEWS, "orders"), matches)
    return enrichment.worth_enriching(wanted, have, roots).select("company_id", "person_id")


@query("people_lookups", f"""WITH a AS (SELECT c_custkey AS c, 0 AS part, 0 AS tier, 1 AS place, NULL AS person_id, 'Kim Doe' AS expected_name FROM customer WHERE c_custkey % 3 = 0),
p AS (SELECT o_custkey, 1, {_TIER_OF}, o_orderkey, 'p' || o_orderkey, NULL FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 <> 2 AND NOT (o_orderkey % 7 = 0 AND o_custkey % 2 = 0) AND NOT (o_orderkey % 7 = 1 AND o_custkey % 2 = 1)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, tier, place) AS seq FROM u) SELECT 'co-' || c AS company_id, seq, person_id, expected_name FROM k WHERE seq <= 3""")
def people_lookups(spark, sf):
    have, roots = _strong(spark, sf)
    asked = given(spark, sf, "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, 1 AS ord, 'Kim Doe' AS name FROM ", "customer").where("cast(substring(company_id, 4) as long) % 3 = 0")
    masked = given(spark, sf, _PREVIEWS, "orders").withColumn("first_name", F.substring_index("name", " ", 1)).withColumn("last_name_obfuscated", F.concat(F.substring(F.substring_index("name", " ", -1), 1, 1), F.lit("***"), F.substring(F.substring_index("name", " ", -1), -1, 1)))
    return enrichment.lookups(asked, masked, have, roots).select("company_id", F.col("seq").cast("long").alias("seq"), "person_id", "expected_name")


_MATCH_BODY = """SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, CAST(o_orderkey AS INT) AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'Kim Doe' END AS expected_name, CASE WHEN o_orderkey % 7 = 0 THEN '{"person":null}' ELSE '{"person":{"id":"p' || CAST(o_orderkey % 9 AS STRING) || '","name":"Kim ' || CASE WHEN o_orderkey % 8 = 0 THEN 'Doe' ELSE 'Roe' END || '","email":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"k@x.com"' END || ',"match_confidence":"none","organization":{"id":"o","primary_domain":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'other.com' ELSE 'c' || CAST(o_custkey AS STRING) || '.com' END || '"}}}' END AS body FROM """


@query("second_provider", """WITH r AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 9 AS p, o_orderkey % 5 > 0 AND (o_orderkey % 4 > 0 OR o_orderkey % 8 = 0) AS fits FROM orders WHERE o_orderkey % 7 > 0),
f AS (SELECT c, p, arg_min(fits, k) AS fits FROM r GROUP BY ALL), n AS (SELECT c, count(*) FILTER (fits) AS kept, count(*) AS n FROM f GROUP BY 1)
SELECT 'co-' || c_custkey AS company_id, CASE WHEN coalesce(kept, 0) > 0 THEN 'PROVIDER_SUCCESS' ELSE 'PROVIDER_NO_MATCH' END AS status, CASE WHEN coalesce(kept, 0) = 0 THEN CASE WHEN coalesce(n, 0) > 0 THEN 'IDENTITY_UNRESOLVED' ELSE 'NO_PERSON_MATCH' END END AS reason FROM customer LEFT JOIN n ON c = c_custkey""")
def second_provider(spark, sf):
    found = enrichment.parse_matches(given(spark, sf, _MATCH_BODY, "orders"))
    return enrichment.second_provider(found, domains(spark, sf))[1].select("company_id", "status", "reason")


@query("match_credits", "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'NO_MATCH' ELSE 'SUCCESS' END AS status, CAST(sum(CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 2 = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS credits, count(*) AS n FROM orders GROUP BY 1")
def match_credits(spark, sf):
    return enrichment.parse_matches(given(spark, sf, _MATCH_BODY, "orders")).groupBy("status").agg(F.sum("credits").alias("credits"), F.count("*").alias("n"))


@query("first_provider", """WITH p AS (SELECT o_custkey AS c, count(*) FILTER (o_orderkey % 4 = 0 AND o_orderkey % 11 > 0) AS full_records, count(*) FILTER (o_orderkey % 4 > 0 AND o_custkey % 2 = 0) AS rest FROM orders GROUP BY 1)
SELECT 'co-' || c_custkey AS company_id, CASE WHEN c_custkey % 5 = 0 OR coalesce(full_records, 0) + coalesce(rest, 0) = 0 THEN 'PROVIDER_NO_MATCH' ELSE 'PROVIDER_SUCCESS' END AS status, CASE WHEN c_custkey % 5 = 0 THEN 'AMBIGUOUS' WHEN coalesce(full_records, 0) + coalesce(rest, 0) = 0 THEN 'NO_POC_FOUND' END AS reason FROM customer LEFT JOIN p ON p.c = c_custkey""")
def first_provider(spark, sf):
    c = table(spark, sf, "customer")
    key = F.concat(F.lit("co-"), F.col("c_custkey").cast("string")).alias("company_id")
    odd = F.col("c_custkey") % 5 == 0
    matches = c.select(key, F.when(odd, F.lit("AMBIGUOUS")).otherwise(F.lit("MATCHED")).alias("reason"), F.when(~odd, F.lit("DOMAIN")).alias("method"), F.when(~odd, F.lit("here")).alias("provider_company_id"))
    seen = given(spark, sf, _PREVIEWS, "orders").join(matches.where("reason = 'MATCHED'").select("company_id"), "company_id", "left_semi")
    none = F.lit(None).cast("string")
    records = seen.where(F.col("seq") % 4 == 0).select("company_id", "seq", "person_id", "name", "title", none.alias("email"), none.alias("profile_url"), "works_at", F.lit(0.5).alias("confidence"))
    full = c.where("c_custkey % 2 = 0").select(key)
    return enrichment.first_provider(matches, seen, records, full)[1].select("company_id", "status", "reason")


_ITEMS = "SELECT 'co-' || CAST(o_custkey AS STRING) AS company_id, o_orderkey AS seq, " + pick("o_orderkey", ["https://www.linkedin.com/in/Ann/", "https://linkedin.com/in/ann?x=1", "https://linkedin.com/in/bob", None]) + " AS profile_url, " + pick("o_orderkey", ["Ann Lee", "Ann B. Lee", "Bob Ray"]) + " AS name, 'a@b.com' AS email, " + pick("o_orderkey", ["OWN", "other.com", "https://facebook.com/x", None, "OWN"]) + " AS company_website FROM "


@query("attach_profiles", "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 >= 2 OR o_orderkey % 3 = 2 THEN 'NOT_ASKED_FOR' WHEN o_orderkey % 5 IN (0, 4) THEN 'ATTACHED' WHEN o_orderkey % 5 = 1 THEN 'DOMAIN_MISMATCH' ELSE 'LINKEDIN_WEBSITE_MISSING' END AS verdict FROM orders")
def attach_profiles(spark, sf):
    items = given(spark, sf, _ITEMS, "orders").withColumn("company_website", F.when(F.col("company_website") == "OWN", F.concat(F.lit("https://www.c"), F.substring("company_id", 4, 20), F.lit(".com/about"))).otherwise(F.col("company_website")))
    asked = given(spark, sf, "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, 'Ann Lee' AS name, 'linkedin.com/in/ann' AS profile_url FROM ", "customer")
    return enrichment.attach_profiles(asked, items, domains(spark, sf)).select("seq", "verdict")


_RUNS = "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, 'company_to_pocs' AS job, CAST(place AS INT) AS place, 'a' || CAST(place AS STRING) AS actor, CASE WHEN c_custkey % 6 = place THEN 'PROVIDER_ERROR' WHEN c_custkey % 6 = 3 AND place = 1 THEN 'PROVIDER_RATE_LIMITED' ELSE 'SUCCESS' END AS status, CASE WHEN c_custkey % 6 = 4 AND place = 2 THEN 2 ELSE 0 END AS attached, 'DOMAIN_MISMATCH' AS reason FROM (SELECT c_custkey, explode(array(1, 2)) AS place FROM "


@query("actor_outcomes", "SELECT 'co-' || c_custkey AS company_id, CASE c_custkey % 6 WHEN 3 THEN 'PROVIDER_RATE_LIMITED' WHEN 4 THEN 'PROVIDER_SUCCESS' WHEN 2 THEN 'PROVIDER_ERROR' ELSE 'PROVIDER_NO_MATCH' END AS status, CASE c_custkey % 6 WHEN 3 THEN 'PROVIDER_RATE_LIMITED:a1' WHEN 2 THEN 'PROVIDER_ERROR:a2' WHEN 4 THEN NULL ELSE 'DOMAIN_MISMATCH:a2' END AS reason FROM customer")
def actor_outcomes(spark, sf):
    runs = spark.sql(_RUNS + "{t})", t=table(spark, sf, "customer"))
    asked = given(spark, sf, "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, 'x.com' AS domain, true AS full, 0 AS profiles FROM ", "customer")
    return enrichment.actor_outcomes(enrichment.choose_actor_runs(runs), asked).select("company_id", "status", "reason")


# --- the waterfall --------------------------------------------------------------------------------------------------

_HAVE = "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, CAST(1 AS BIGINT) AS ord, 'x' || CAST(c_custkey AS STRING) AS contact_id, 'Ann Lee' AS name, 'CEO' AS title, CAST(1 AS INT) AS title_priority, CASE WHEN c_custkey % 3 = 0 THEN 'ann.lee@c' || CAST(c_custkey AS STRING) || '.com' END AS email, CAST(NULL AS STRING) AS profile_url, 1.0D AS rank_score, 'COMPANY_WEBSITE' AS source_type, 'PUBLIC' AS origin FROM "
_ANSWERED = "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, CASE WHEN p = 0 THEN 'ZOOMINFO' ELSE 'APOLLO' END AS provider, CASE WHEN p = 0 AND c_custkey % 4 = 1 THEN 'PROVIDER_NO_MATCH' ELSE 'PROVIDER_SUCCESS' END AS status, CASE WHEN p = 0 AND c_custkey % 4 = 1 THEN 'AMBIGUOUS' END AS reason, 'DOMAIN' AS match_method, '7' AS provider_company_id, 2 AS requests, 1.0D AS credits, true AS billable, CAST(NULL AS STRING) AS call_stop FROM (SELECT c_custkey, explode(array(0, 1)) AS p FROM {t})"
_GIVEN = "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, CASE WHEN p = 0 THEN 'ZOOMINFO' ELSE 'APOLLO' END AS provider, CAST(1 AS BIGINT) AS seq, 'Ann Lee' AS name, 'CEO' AS title, CASE WHEN p = 1 OR c_custkey % 4 = 0 THEN 'a.lee@c' || CAST(c_custkey AS STRING) || '.com' END AS email, CAST(NULL AS STRING) AS profile_url, 'id1' AS person_id, 'x' AS extraction_method, 'u' AS evidence_url FROM (SELECT c_custkey, explode(array(0, 1)) AS p FROM {t}) WHERE p = 1 OR c_custkey % 4 <> 1"


@query("enrichment_attempts", """WITH c AS (SELECT c_custkey AS c, row_number() OVER (ORDER BY c_custkey) AS n, c_custkey % 3 = 0 AS has, c_custkey % 4 AS k FROM customer),
one AS (SELECT *, CASE WHEN n > 25 THEN 'PROVIDER_UNAVAILABLE' WHEN k = 1 THEN 'PROVIDER_NO_MATCH' WHEN has OR k = 0 THEN 'PROVIDER_SUCCESS' ELSE 'PROVIDER_PARTIAL' END AS s1, CASE WHEN n > 25 THEN 'COMPANY_BUDGET_EXHAUSTED' WHEN k = 1 THEN 'AMBIGUOUS' WHEN has OR k = 0 THEN NULL ELSE 'EMAIL_MISSING' END AS r1 FROM c),
two AS (SELECT *, s1 <> 'PROVIDER_SUCCESS' AS asked FROM one), three AS (SELECT *, sum(CASE WHEN asked THEN 1 ELSE 0 END) OVER (ORDER BY n) AS m FROM two)
SELECT 'co-' || c AS company_id, 'ZOOMINFO' AS provider, n <= 25 AS called, s1 AS status, r1 AS reason, NULL AS fallback_reason FROM one
UNION ALL SELECT 'co-' || c, 'APOLLO', asked AND m <= 40, CASE WHEN NOT asked THEN 'NOT_CALLED' WHEN m > 40 THEN 'PROVIDER_UNAVAILABLE' ELSE 'PROVIDER_SUCCESS' END, CASE WHEN NOT asked THEN 'ZOOMINFO PROVIDER_SUCCESS' WHEN m > 40 THEN 'COMPANY_BUDGET_EXHAUSTED' END,
  CASE WHEN asked THEN 'ZOOMINFO ' || s1 || CASE WHEN s1 = 'PROVIDER_PARTIAL' THEN ': no PERSONAL email for Ann Lee' ELSE ': ' || r1 END END FROM three""")
def enrichment_attempts(spark, sf):
    """Two providers over every company, in order of their keys, each up to its budget of companies."""
    t = table(spark, sf, "customer")
    companies = t.select(F.concat(F.lit("co-"), F.col("c_custkey").cast("string")).alias("company_id"), F.col("c_custkey").alias("seq"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain"))
    providers = [enrichment.Provider("ZOOMINFO", 25), enrichment.Provider("APOLLO", 40)]
    _, attempts, _ = enrichment.waterfall(companies, given(spark, sf, _HAVE, "customer"), spark.sql(_ANSWERED, t=t), spark.sql(_GIVEN, t=t), providers, now(), Scratch(spark, "waterfall"))
    return attempts.select("company_id", "provider", "called", "status", "reason", "fallback_reason")


# --- sources, slices and streams ------------------------------------------------------------------------------------

_SLICE = "SELECT 'g' || CAST(o_orderkey AS STRING) AS global_id, 'a' AS ats_id, 'u' AS url, 'v' AS apply_url, " + pick("o_orderkey", ["Machinist", "Welder"]) + " AS title, 'Acme' AS company, 'lever' AS ats_type, " + pick("o_orderkey", ["Mason, OH", "Garden Grove, CA", "Toledo, Ohio, United States", "Cleveland, ohio"]) + " AS location, " + pick("o_orderkey", ["US", "US", "US", "DE", "US"]) + " AS country_iso, o_orderkey % 2 = 0 AS is_remote, CAST(NULL AS STRING) AS employment_type, 'd' AS description, CASE WHEN o_orderkey % 9 = 0 THEN '2025-01-01' ELSE '2026-05-30T10:00:00+00:00' END AS posted_at FROM "


@query("search_slices", "SELECT 'g' || o_orderkey AS global_id, s AS slice FROM orders, (VALUES ('coded'), ('named')) v(s) WHERE o_orderkey % 5 <> 3 AND o_orderkey % 9 > 0 AND CASE s WHEN 'coded' THEN o_orderkey % 4 = 0 ELSE o_orderkey % 4 = 2 END")
def search_slices(spark, sf):
    """One slice that knows a state by its code, and one that knows it by name only."""
    from leadloom.sources import slices

    scratch, rows = Scratch(spark, "slices"), given(spark, sf, _SLICE, "orders")
    paths = {name: scratch.path(name) for name in ("coded", "named")}
    rows.write.parquet(paths["coded"])
    rows.where("location not like '%OH'").write.parquet(paths["named"])
    return slices.search_slices(spark, paths, now(), state="OH", limit=None).select("global_id", "slice")


@query("registry_union", "SELECT source_site, count(*) AS n, min(o) AS first_ord FROM (SELECT 'indeed' AS source_site, c_custkey AS o FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT 'linkedin', 1000000000000000 + c_custkey FROM customer) GROUP BY 1")
def registry_union(spark, sf):
    """Two enabled sources and a disabled one; rows without a title are set aside."""
    from leadloom import schemas
    from leadloom.sources.registry import Registry

    names = [f.split(" ")[0] for f in schemas.RAW_JOB.split(", ")]
    empty = spark.createDataFrame([], schemas.RAW_JOB)

    def source(portal):
        rows = given(spark, sf, f"SELECT c_custkey AS ord, 'JOB_BOARD' AS source_type, 2 AS source_priority, '{portal}' AS source_site, CAST(c_custkey AS STRING) AS external_id, CASE WHEN c_custkey % 3 = 0 AND '{portal}' = 'indeed' THEN '' ELSE 'Welder' END AS title, 'https://x' AS application_url FROM ", "customer")
        return empty.unionByName(rows, allowMissingColumns=True).select(names)

    books = Registry(disabled={"glassdoor"})
    for portal in ("indeed", "linkedin", "glassdoor"):
        books.register(portal, lambda _, portal=portal: source(portal))
    return books.run(spark)[0].groupBy("source_site").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query("hiring_days", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS observed_on, count(*) AS n FROM events GROUP BY ALL")
def hiring_days(spark, sf):
    """Counts of every day: closed ones from a drained stream, the day that is still open from the table."""
    from leadloom.streaming import incremental

    scratch, batch = Scratch(spark, "stream"), table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))
    out = scratch.path("out")
    incremental.run_available(incremental.daily_counts(stream, "user_id", "at", "0 seconds"), out, scratch.path("checkpoint"))
    closed = spark.read.schema("user_id long, observed_on date, n long").parquet(out)
    days = incremental.closed_daily_counts(closed, batch, "user_id", "at")
    return days.select("user_id", F.col("observed_on").cast("string").alias("observed_on"), "n")


@query("budget_stream", "SELECT user_id, count(*) FILTER (k <= 7) AS allowed, count(*) FILTER (k > 7) AS refused FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id) AS k FROM events) GROUP BY 1")
def budget_stream(spark, sf):
    """Seven calls a user, over all triggers of a drained stream."""
    from leadloom.streaming import incremental

    scratch = Scratch(spark, "stream")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").select("user_id", F.xxhash64("*").alias("seq"))
    out = scratch.path("out")
    incremental.run_available(incremental.spend(stream, "user_id", 7), out, scratch.path("checkpoint"))
    rows = spark.read.schema("user_id long, seq long, allowed boolean").parquet(out)
    return rows.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


@query("ttl_stream", """WITH e AS (SELECT DISTINCT user_id, CAST(ts AS TIMESTAMP) AS at FROM events)
SELECT user_id, count(*) AS seen FROM e GROUP BY 1""")
def ttl_stream(spark, sf):
    """Sightings of each user that a day's memory has judged; tests/test_stages.py holds the verdicts to brute force."""
    from leadloom.streaming import incremental

    scratch = Scratch(spark, "stream")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").select("user_id", F.col("ts").cast("timestamp").alias("at")).dropDuplicates(["user_id", "at"])
    out = scratch.path("out")
    incremental.run_available(incremental.remember(stream, "user_id", "at", 1), out, scratch.path("checkpoint"))
    return spark.read.schema("user_id long, at timestamp, known boolean").parquet(out).groupBy("user_id").agg(F.count("*").alias("seen"))


# --- further inputs and counts --------------------------------------------------------------------------------------

_ALIASED = "SELECT o_orderkey, " + pick("o_orderkey", ["indeed", "", None]) + " AS source_site, 'linkedin' AS site, " + pick("o_orderkey", [None, "Welder"]) + " AS job_title, 'https://j/' || CAST(o_orderkey AS STRING) AS job_url, CASE WHEN o_orderkey % 4 = 0 THEN 'https://d' ELSE '' END AS job_url_direct FROM "


@query("alias_rows", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'indeed' ELSE 'linkedin' END AS source_site, CASE WHEN o_orderkey % 2 = 1 THEN 'Welder' END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'https://d' ELSE 'https://j/' || o_orderkey END AS application_url FROM orders")
def alias_rows(spark, sf):
    from leadloom.sources.registry import ALIASES, coalesce_aliases

    return coalesce_aliases(given(spark, sf, _ALIASED, "orders"), ALIASES).select("source_site", "title", "application_url")


@query("attach_sites", "SELECT o_orderkey AS ord, CASE WHEN o_custkey % 3 = 0 THEN 'Known ' || o_custkey ELSE 'N' || o_custkey END AS company_name, CASE WHEN o_orderkey % 5 = 0 THEN 'https://own' WHEN o_custkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'https://k' || o_custkey || '.com' END AS company_website, o_custkey % 3 = 0 AS site_matched FROM orders")
def attach_sites(spark, sf):
    rows = given(spark, sf, "SELECT o_orderkey AS ord, 'N' || CAST(o_custkey AS STRING) AS company_name, CASE WHEN o_orderkey % 5 = 0 THEN 'https://own' END AS company_website FROM ", "orders")
    found = given(spark, sf, "SELECT 'N' || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'https://k' || CAST(c_custkey AS STRING) || '.com' ELSE 'https://www.indeed.com/cmp/x' END AS url, 'Known ' || CAST(c_custkey AS STRING) AS matched_name FROM ", "customer")
    return matching.attach_sites(rows, found)


@query("identity_counts", "SELECT * FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'DOMAIN' WHEN 1 THEN 'NAME_ONLY' ELSE 'SOURCE_ID' END AS name, count(*) AS n FROM customer GROUP BY 1) UNION ALL SELECT 'AMBIGUOUS', count(*) FILTER (c_custkey % 6 = 1) FROM customer UNION ALL SELECT 'CONFLICTS', 7")
def identity_counts(spark, sf):
    rows = given(spark, sf, "SELECT " + pick("c_custkey", ["DOMAIN", "NAME_ONLY", "SOURCE_ID"]) + " AS identity_basis, c_custkey % 6 = 1 AS identity_ambiguous FROM ", "customer")
    return identity.identity_counts(rows, spark.sql("SELECT CAST(7 AS BIGINT) AS n"))


@query("ordered_emails", """WITH e AS (SELECT o_custkey AS c, o_orderkey AS ord, 0 AS i, 'a' || (o_orderkey % 4) || '@x.com' AS email FROM orders UNION ALL SELECT o_custkey, o_orderkey, 1, 'b@x.com' FROM orders), f AS (SELECT c, email, min(ord * 10 + i) AS place FROM e GROUP BY ALL)
SELECT 'c' || c AS company, string_agg(email, ',' ORDER BY place) AS emails FROM f GROUP BY c""")
def ordered_emails(spark, sf):
    rows = given(spark, sf, "SELECT 'c' || CAST(o_custkey AS STRING) AS company, o_orderkey AS ord, array('A' || CAST(o_orderkey % 4 AS STRING) || '@x.com', ' b@x.com', '') AS observed_emails FROM ", "orders")
    return identity.ordered_emails(rows).select("company", F.array_join("emails", ",").alias("emails"))


@query("table_select", "SELECT o_orderkey, o_totalprice, NULL AS no_such FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC LIMIT 30")
def table_select(spark, sf):
    out = tables.select(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "no_such"], {"o_orderstatus": "F"}, "o_totalprice", True, 30)
    return out.withColumn("no_such", F.col("no_such").cast("int"))


@query("exact_bands", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_custkey END AS min, CASE WHEN c_custkey % 4 > 0 THEN c_custkey END AS max FROM customer")
def exact_bands(spark, sf):
    from leadloom.functions import size

    n = F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", size.exact_band(n).alias("b")).select("c_custkey", "b.*")


# --- scans ----------------------------------------------------------------------------------------------------------

_MAP_XML = "SELECT c_custkey, '<urlset><url><loc> https://c' || CAST(c_custkey AS STRING) || '.com/team?a=1&amp;b=2 </loc></url><url><LOC>https://x/' || CAST(c_custkey % 3 AS STRING) || '</LOC></url><loc></loc></urlset>' AS xml FROM "


@query("sitemap_links", "SELECT c_custkey, 'https://c' || c_custkey || '.com/team?a=1&b=2,https://x/' || (c_custkey % 3) AS links FROM customer")
def sitemap_links(spark, sf):
    from leadloom.sources import scans

    return given(spark, sf, _MAP_XML, "customer").select("c_custkey", F.array_join(scans.sitemap_links(F.col("xml")), ",").alias("links"))


_CERTS = """SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, 'acme.com' AS domain, CASE WHEN c_custkey % 5 = 0 THEN 'broken' ELSE '[{"name_value":"*.careers.acme.com\\\\nacme.com"},{"name_value":"HR' || CAST(c_custkey % 3 AS STRING) || '.acme.com"},{"name_value":"x.other.com"}]' END AS body FROM """


@query("certificate_hosts", "SELECT 'co-' || c_custkey AS company_id, h AS host FROM customer, (VALUES (0), (1)) v(k), LATERAL (SELECT CASE k WHEN 0 THEN 'careers.acme.com' ELSE 'hr' || (c_custkey % 3) || '.acme.com' END AS h) WHERE c_custkey % 5 > 0")
def certificate_hosts(spark, sf):
    from leadloom.sources import scans

    return scans.certificate_hosts(given(spark, sf, _CERTS, "customer"))


_RESULTS = "SELECT 'k' || CAST(o_custkey AS STRING) AS dedup_key, CAST(o_orderkey AS INT) AS position, " + pick("o_orderkey", ["https://duck.example/l/?uddg=https%3A%2F%2Facme.com%2Fx", "https://www.indeed.com/cmp/x", "https://brave.com/x", "https://a.co.uk/", "https://b.com/"]) + " AS link FROM "


@query("search_candidates", "WITH r AS (SELECT o_custkey AS c, CASE o_orderkey % 5 WHEN 0 THEN 'acme.com' WHEN 3 THEN 'a.co.uk' WHEN 4 THEN 'b.com' END AS domain, min(o_orderkey) AS p FROM orders WHERE o_orderkey % 5 NOT IN (1, 2) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p) AS seq FROM r) SELECT 'k' || c AS dedup_key, seq, domain FROM k WHERE seq <= 2")
def search_candidates(spark, sf):
    from leadloom.sources import scans

    return scans.search_candidates(given(spark, sf, _RESULTS, "orders"), ["brave.com"], 2).select("dedup_key", F.col("seq").cast("long").alias("seq"), "domain")


@query("page_links")
def page_links(spark, sf):
    """Links of every page as it is; tests/test_stages.py holds them to a plain parser."""
    from leadloom.sources import scans

    return scans.links_of_pages(table(spark, sf, "pages"), "page_id")


@query("circuit_breaker", "SELECT o_orderkey AS seq, coalesce(count(*) OVER w = 3 AND sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) OVER w = 0, false) AS open FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def circuit_breaker(spark, sf):
    from leadloom.sources import scans

    rows = given(spark, sf, "SELECT CAST(o_custkey AS STRING) AS host, o_orderkey AS seq, o_orderkey % 3 = 0 AS ok FROM ", "orders")
    return scans.circuit_open(rows).select("seq", "open")


@query("fetch_errors", "SELECT o_orderkey, CASE WHEN k = 0 THEN 'URL_REJECTED:INTERNAL_HOST' WHEN k = 1 THEN 'HOST_UNRESOLVED' WHEN k = 2 THEN 'ROBOTS_DISALLOWED' WHEN k = 3 THEN 'HOST_CIRCUIT_OPEN' WHEN k = 4 THEN 'NOT_FOUND' WHEN k = 5 THEN 'RATE_LIMITED:429' WHEN k = 6 THEN 'REDIRECT_REJECTED' END AS error, k >= 7 AND o_orderkey % 2 = 0 AS ok FROM (SELECT o_orderkey, o_orderkey % 9 AS k FROM orders)")
def fetch_errors(spark, sf):
    from leadloom.sources import registry, scans

    k = F.col("o_orderkey") % 9
    status = F.when(k == 4, 410).when(k == 5, 429).when(k < 4, F.lit(None)).otherwise(200)
    error = scans.fetch_error(F.when(k == 0, F.lit("http://localhost/")).otherwise(F.lit("https://acme.com/")), k != 1, k != 2, k == 3, status, F.when(k == 6, F.lit("http://10.0.0.1/")))
    rows = table(spark, sf, "orders").withColumn("error", error)
    body = F.when((F.col("o_orderkey") % 2 == 0) & F.col("error").isNull(), F.lit("<p>"))
    return rows.select("o_orderkey", "error", registry.page_ok(body, F.lit(False), status).alias("ok"))


@query("size_statements", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN CASE WHEN c_custkey = 0 THEN 9 ELSE c_custkey END WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey END AS size_min, CASE c_custkey % 6 WHEN 0 THEN c_custkey + 9 WHEN 1 THEN c_custkey WHEN 4 THEN c_custkey END AS size_max, CASE c_custkey % 6 WHEN 0 THEN CASE WHEN c_custkey = 0 THEN '9 employees' ELSE c_custkey || ' to ' || (c_custkey + 9) || ' employees' END WHEN 1 THEN 'team of ' || c_custkey WHEN 2 THEN 'over ' || c_custkey || ' employees' WHEN 4 THEN 'fewer than ' || c_custkey || ' people' END AS snippet FROM customer")
def size_statements(spark, sf):
    """Head counts and the words that state them, of every customer's text."""
    from leadloom.functions import size
    from leadloom.plans.more_queries import _SAID

    rows = given(spark, sf, _SAID, "customer").withColumn("s", size.size_evidence(F.col("t")))
    return rows.select("c_custkey", F.col("s.min").alias("size_min"), F.col("s.max").alias("size_max"), F.col("s.snippet").alias("snippet"))
