"""Every operator as a query over the driver's tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates, email, location, size, text, url
from leadloom.operators import coverage, dedupe, identity, normalize, people, qualify, tables, taxonomy
from leadloom.plans.postings import CTES, NOW, lit, listed, normalized, raw_postings, sql_employer, sql_host, sql_root, table
from leadloom.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
now = lambda: F.lit(NOW).cast("timestamp")
SQL_NOW = f"TIMESTAMP '{NOW}'"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def pattern(phrases: list[str]) -> str:
    return lit(text.phrase_pattern(phrases))


# --- normalization --------------------------------------------------------------------------------------------


@query("norm_company", CTES + "SELECT ord, company_name_normalized FROM norm")
def norm_company(spark, sf):
    return normalized(spark, sf).select("ord", "company_name_normalized")


@query("norm_title", CTES + "SELECT ord, title_normalized FROM norm")
def norm_title(spark, sf):
    return normalized(spark, sf).select("ord", "title_normalized")


@query("norm_location", CTES + "SELECT ord, city, state, country, is_remote, location_key FROM norm")
def norm_location(spark, sf):
    return normalized(spark, sf).select("ord", "city", "state", "country", "is_remote", "location_key")


@query("norm_domain", CTES + "SELECT ord, domain, domain_source FROM norm")
def norm_domain(spark, sf):
    return normalized(spark, sf).select("ord", "domain", "domain_source")


@query("norm_posting", CTES + "SELECT ord, company_name_normalized, title_normalized, domain, domain_source, location_key, date_precision, screen_reason FROM norm")
def norm_posting(spark, sf):
    return normalized(spark, sf).select("ord", "company_name_normalized", "title_normalized", "domain", "domain_source", "location_key", "date_precision", "screen_reason")


_IDS = """list_sort(list_distinct(list_filter([
  CASE WHEN regexp_matches(company_url, 'indeed\\.com/cmp/') THEN 'indeed:' || lower(regexp_extract(company_url, 'indeed\\.com/cmp/([^/?#]+)', 1)) END,
  CASE WHEN regexp_matches(company_url, 'linkedin\\.com/company/') THEN 'linkedin:' || lower(regexp_extract(company_url, 'linkedin\\.com/company/([^/?#]+)', 1)) END,
  CASE WHEN regexp_matches(apply_url, 'jobs\\.lever\\.co/') THEN 'lever:' || lower(regexp_extract(apply_url, 'jobs\\.lever\\.co/([^/?#]+)', 1)) END], lambda s: s IS NOT NULL)))"""


@query("source_ids", CTES + f"SELECT ord, array_to_string({_IDS}, ',') AS source_ids FROM norm")
def source_ids(spark, sf):
    return normalized(spark, sf).select("ord", F.array_join("source_ids", ",").alias("source_ids"))


@query("registrable_domain", f"SELECT page_id, {sql_host('url')} AS host, {sql_root(sql_host('url'))} AS root, coalesce({sql_employer('(' + sql_host('url') + ')')}, false) AS employer FROM pages")
def registrable(spark, sf):
    host = url.extract_host(F.col("url"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), url.registrable_domain(host).alias("root"), url.is_employer_domain(host).alias("employer"))


@query("in_us_state", CTES + "SELECT ord, coalesce(regexp_matches(location, '(^|[^A-Za-z])OH([^A-Za-z]|$)') OR regexp_matches(location, '(?i)\\bohio\\b'), false) AS in_ohio FROM norm")
def in_us_state(spark, sf):
    return raw_postings(spark, sf).select("ord", location.in_us_state(F.col("location"), F.lit("OH")).alias("in_ohio"))


@query("raw_schema_problems", CTES + """SELECT ord, array_to_string(list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'MISSING_TITLE' END,
  CASE WHEN coalesce(trim(application_url), '') = '' THEN 'MISSING_APPLICATION_URL' END, CASE WHEN source_site <> 'indeed' THEN 'SOURCE_SITE_MISMATCH' END], lambda s: s IS NOT NULL), ',') AS problems FROM postings""")
def raw_schema_problems(spark, sf):
    return raw_postings(spark, sf).select("ord", F.array_join(normalize.schema_problems(F.lit("indeed")), ",").alias("problems"))


@query("screen_side_output", CTES + "SELECT screen_reason AS reason, count(*) AS n FROM norm WHERE screen_reason IS NOT NULL GROUP BY 1")
def screen_side_output(spark, sf):
    return normalize.count_by_reason(normalize.screen(normalized(spark, sf))[1], "screen_reason")


_AGE = f"CASE WHEN date_precision = 'DAY' THEN CAST(date_diff('day', CAST(posted_at AS DATE), CAST({SQL_NOW} AS DATE)) AS DOUBLE) ELSE (epoch_us({SQL_NOW}) - epoch_us(posted_at)) / 86400000000.0 END"
FRESH = f""", fresh AS (SELECT *, CASE WHEN posted_at IS NULL THEN CASE WHEN window_hours <= 336 THEN 'UNDATED_WITHIN_SOURCE_WINDOW' ELSE 'MISSING_POSTING_DATE' END
    WHEN age < CASE WHEN date_precision = 'DAY' THEN -1 ELSE -1.0 / 24 END THEN 'FUTURE_POSTING_DATE' WHEN greatest(age, 0) > 14 THEN 'STALE' END AS freshness_reason,
  CASE WHEN age < CASE WHEN date_precision = 'DAY' THEN -1 ELSE -1.0 / 24 END THEN age ELSE greatest(age, 0) END AS age_days FROM (SELECT *, {_AGE} AS age FROM norm))"""
KEEP = "(freshness_reason IS NULL OR freshness_reason = 'UNDATED_WITHIN_SOURCE_WINDOW')"


@query("freshness_verdict", CTES + FRESH + f" SELECT ord, {KEEP} AS fresh_keep, round(CASE WHEN posted_at IS NOT NULL THEN age_days END, 6) AS age_days, freshness_reason FROM fresh")
def freshness_verdict(spark, sf):
    return normalize.freshen(normalized(spark, sf), now()).select("ord", "fresh_keep", F.round("age_days", 6).alias("age_days"), "freshness_reason")


@query("freshness_rollup", CTES + FRESH + " SELECT freshness_reason AS reason, count(*) AS n FROM fresh WHERE freshness_reason IS NOT NULL GROUP BY 1")
def freshness_rollup(spark, sf):
    return normalize.count_by_reason(normalize.freshen(normalized(spark, sf), now()), "freshness_reason")


@query("date_window", "SELECT o_orderkey, CASE WHEN h IS NULL OR h <= 0 THEN NULL WHEN h <= 168 THEN 7 WHEN h <= 336 THEN 14 END AS days FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 400 AS INTEGER) END AS h FROM orders)")
def date_window(spark, sf):
    hours = F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 400).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", dates.window_days(hours).alias("days"))


# --- de-duplication -------------------------------------------------------------------------------------------

PREF = "(posted_at IS NULL), source_priority NULLS LAST, (coalesce(description, '') = '')"
DEDUPE = f""", scope AS (SELECT * FROM norm WHERE screen_reason IS NULL),
same AS (SELECT *, min(ord) OVER g AS grp_ord, first_value(ord) OVER (PARTITION BY source_site, external_id, CASE WHEN external_id IS NULL THEN ord END ORDER BY {PREF}, ord) AS best
  FROM scope WINDOW g AS (PARTITION BY source_site, external_id, CASE WHEN external_id IS NULL THEN ord END)),
uniq AS (SELECT * FROM same WHERE best = ord),
keyed AS (SELECT *, CASE WHEN state IS NULL OR title_normalized = '' THEN ord END AS own FROM uniq),
split AS (SELECT company_name_normalized, title_normalized, location_key FROM keyed WHERE own IS NULL AND domain <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT domain) > 1),
grouped AS (SELECT k.*, CASE WHEN s.location_key IS NOT NULL AND own IS NULL THEN domain ELSE '' END AS gd FROM keyed k LEFT JOIN split s USING (company_name_normalized, title_normalized, location_key)),
sites AS (SELECT company_name_normalized, title_normalized, location_key, own, gd, source_site, count(DISTINCT coalesce(external_id, '')) AS n, min(source_priority) AS p FROM grouped GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_name_normalized, title_normalized, location_key, own, gd ORDER BY n DESC, p, source_site) AS k FROM sites) WHERE k = 1),
judged AS (SELECT g.*, g.source_site = t.source_site AS at_top,
    row_number() OVER (PARTITION BY g.company_name_normalized, g.title_normalized, g.location_key, g.own, g.gd, g.source_site, coalesce(external_id, '') ORDER BY {PREF}, grp_ord) AS k,
    min(grp_ord) OVER (PARTITION BY g.company_name_normalized, g.title_normalized, g.location_key, g.own, g.gd, g.source_site, coalesce(external_id, '')) AS req_first
  FROM grouped g JOIN top t ON g.company_name_normalized = t.company_name_normalized AND g.title_normalized = t.title_normalized AND g.location_key = t.location_key AND g.own IS NOT DISTINCT FROM t.own AND g.gd = t.gd),
won AS (SELECT *, own IS NOT NULL OR (at_top AND k = 1) AS winner FROM judged),
cross_ AS (SELECT *, first_value(CASE WHEN winner THEN ord END) OVER (PARTITION BY company_name_normalized, title_normalized, location_key, own, gd ORDER BY winner DESC, req_first ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head FROM won),
kept AS (SELECT * FROM cross_ WHERE winner)"""


def _scope(spark, sf):
    return normalize.screen(normalized(spark, sf))[0]


#: What de-duplication reads of a posting.
DEDUPE_READS = ["ord", "source_site", "external_id", "posted_at", "source_priority", "description", "company_name_normalized", "title_normalized", "location_key", "state", "domain"]


@query("dedupe_same_source", CTES + DEDUPE + " SELECT best AS kept_ord, count(*) AS copies FROM same GROUP BY 1")
def dedupe_same_source(spark, sf):
    rows = dedupe.same_source(Scratch(spark, "dedupe").save(_scope(spark, sf).select("ord", "source_site", "external_id", "posted_at", "source_priority", "description"), "postings"))
    return rows.groupBy(F.coalesce("dup_of", "ord").alias("kept_ord")).agg(F.count("*").alias("copies"))


@query("dedupe_cross_post", CTES + DEDUPE + " SELECT ord, company_name_normalized, title_normalized, source_site FROM kept")
def dedupe_cross_post(spark, sf):
    return dedupe.dedupe(_scope(spark, sf).select(DEDUPE_READS), Scratch(spark, "dedupe"))[0].select("ord", "company_name_normalized", "title_normalized", "source_site")


@query("dedupe_audit", CTES + DEDUPE + " SELECT ord AS dup_ord, best AS kept_ord, 'SAME_SOURCE_ID' AS reason FROM same WHERE best <> ord UNION ALL SELECT ord, head, 'CROSS_POSTED' FROM cross_ WHERE NOT winner")
def dedupe_audit(spark, sf):
    return dedupe.dedupe(_scope(spark, sf).select(DEDUPE_READS), Scratch(spark, "dedupe"))[1]


@query("first_seen", CTES + " SELECT min(ord) AS ord, source_site FROM postings GROUP BY source_site, coalesce(external_id, application_url)")
def first_seen(spark, sf):
    return coverage.first_seen(raw_postings(spark, sf)).select("ord", "source_site")


# --- companies ------------------------------------------------------------------------------------------------


def identified(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh, kept postings with their company."""
    kept = dedupe.dedupe(_scope(spark, sf), Scratch(spark, "dedupe"))[0]
    fresh = normalize.freshen(kept, now()).where("fresh_keep")
    return identity.identify(fresh, Scratch(spark, "identity"))[0]


def qualified(spark: SparkSession, sf: str) -> DataFrame:
    rows = identified(spark, sf)
    signals = qualify.hiring_signals(rows)
    rollup = qualify.profile(identity.companies(rows).join(signals, "company", "left"))
    return qualify.qualify(rollup.withColumn("industry_state", F.lit("OBSERVED")).withColumn("client_industry", F.lit("Manufacturing")))


@query("company_components")
def company_components(spark, sf):
    return identified(spark, sf).groupBy("company").agg(F.count("*").alias("postings"), F.min("ord").alias("first_ord"))


@query("company_rollup")
def company_rollup(spark, sf):
    out = identity.companies(identified(spark, sf))
    return out.select("company", "company_name", "company_name_normalized", "domain", "identity_basis", "identity_key", "hiring_intensity", F.array_join("states", ",").alias("states"), F.array_join("source_sites", ",").alias("source_sites"), "min_applicant_count", "identity_ambiguous", "dedup_key")


@query("qualify_status")
def qualify_status(spark, sf):
    return qualified(spark, sf).select("company", "status", "score", "size_label", F.array_join("reasons", ",").alias("reasons"), F.array_join("review_flags", ",").alias("review_flags"))


@query("reasons_exploded")
def reasons_exploded(spark, sf):
    return qualify.explode_reasons(qualified(spark, sf), "company").groupBy("outcome", "reason").agg(F.count("*").alias("n"))


_BY_NAME = f"""{CTES}{FRESH}, scope AS (SELECT * FROM fresh WHERE screen_reason IS NULL AND {KEEP})"""


@query("name_rollup", _BY_NAME + """ SELECT company_name_normalized, count(*) AS hiring_intensity, coalesce(array_to_string(list_sort(list_distinct(list(state) FILTER (state IS NOT NULL))), ','), '') AS states,
  array_to_string(list_sort(list_distinct(list(source_site))), ',') AS source_sites, min(applicant_count) AS min_applicant_count, arg_min(location, ord) FILTER (location IS NOT NULL AND location <> '') AS location FROM scope GROUP BY 1""")
def name_rollup(spark, sf):
    rows = normalize.freshen(_scope(spark, sf), now()).where("fresh_keep").withColumn("company", F.col("company_name_normalized"))
    out = rows.groupBy("company").agg(F.count("*").alias("hiring_intensity"), F.array_sort(F.collect_set("state")).alias("s"), F.array_sort(F.collect_set("source_site")).alias("p"), F.min("applicant_count").alias("min_applicant_count"), F.min_by(F.col("location"), F.when(F.coalesce("location", F.lit("")) != "", F.col("ord"))).alias("location"))
    return out.select(F.col("company").alias("company_name_normalized"), "hiring_intensity", F.array_join("s", ",").alias("states"), F.array_join("p", ",").alias("source_sites"), "min_applicant_count", "location")


SIGNALS = f""" SELECT company_name_normalized AS company, count(*) FILTER (regexp_matches(title, {pattern(vocab.TA_ROLES)})) AS ta_role_count, coalesce(bool_or(regexp_matches(title, {pattern(vocab.TA_SENIOR)})), false) AS has_senior_ta,
  arg_min(lower(regexp_extract(description, {pattern(vocab.AGENCY_SELF)}, 0)), ord) FILTER (regexp_matches(description, {pattern(vocab.AGENCY_SELF)})) AS agency_self FROM scope GROUP BY 1"""


@query("ta_signal", _BY_NAME + SIGNALS)
def ta_signal(spark, sf):
    rows = normalize.freshen(_scope(spark, sf), now()).where("fresh_keep").withColumn("company", F.col("company_name_normalized"))
    return qualify.hiring_signals(rows).select("company", "ta_role_count", "has_senior_ta", "agency_self")


@query("growth_hits", _BY_NAME + f""" SELECT company, string_agg(hit, ',' ORDER BY ord, k) AS growth_hits FROM (SELECT company_name_normalized AS company, hit, arg_min(k, (ord, k)) AS k, min(ord) AS ord FROM (
  SELECT company_name_normalized, ord, lower(unnest(h)) AS hit, unnest(range(len(h))) AS k FROM (SELECT company_name_normalized, ord, regexp_extract_all(coalesce(description, ''), {pattern(vocab.GROWTH)}, 0) AS h FROM scope)) GROUP BY 1, 2) GROUP BY 1""")
def growth_hits(spark, sf):
    rows = normalize.freshen(_scope(spark, sf), now()).where("fresh_keep").withColumn("company", F.col("company_name_normalized"))
    return qualify.hiring_signals(rows).where("growth_hits is not null").select("company", F.array_join("growth_hits", ",").alias("growth_hits"))


@query("agency_flag", CTES + f"SELECT ord, CASE WHEN regexp_matches(company_name, {pattern(vocab.AGENCY_NAMES)}) THEN 'NAME:' || lower(regexp_extract(company_name, {pattern(vocab.AGENCY_NAMES)}, 0)) WHEN regexp_matches(description, {pattern(vocab.AGENCY_SELF)}) THEN 'SELF_DESCRIPTION:' || lower(regexp_extract(description, {pattern(vocab.AGENCY_SELF)}, 0)) END AS agency_evidence FROM postings")
def agency_flag(spark, sf):
    named, own = text.first_phrase(F.col("company_name"), vocab.AGENCY_NAMES), text.first_phrase(F.col("description"), vocab.AGENCY_SELF)
    return raw_postings(spark, sf).select("ord", F.coalesce(F.concat(F.lit("NAME:"), named), F.concat(F.lit("SELF_DESCRIPTION:"), own)).alias("agency_evidence"))


_SIZE = "SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN '51 to 200' WHEN 1 THEN '1,001 - 5,000 employees' WHEN 2 THEN '10,000+' WHEN 3 THEN 'Fewer than 10' WHEN 4 THEN '200' WHEN 5 THEN 'more than ' || CAST(c_custkey AS STRING) WHEN 6 THEN '2k' ELSE 'unknown' END AS t FROM "
_SIZES = """SELECT c_custkey, t, CASE c_custkey % 8 WHEN 0 THEN 51 WHEN 1 THEN 1001 WHEN 2 THEN 10000 WHEN 4 THEN 200 WHEN 5 THEN c_custkey WHEN 6 THEN 2000 END AS lo, CASE c_custkey % 8 WHEN 0 THEN 200 WHEN 1 THEN 5000 WHEN 3 THEN 10 WHEN 4 THEN 200 WHEN 6 THEN 2000 END AS hi FROM (""" + _SIZE + "customer)"


@query("size_parse", f"SELECT c_custkey, CAST(lo AS BIGINT) AS size_min, CAST(hi AS BIGINT) AS size_max, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END WHEN lo IS NOT NULL THEN lo || '+' WHEN hi IS NOT NULL THEN '<' || hi END AS label FROM ({_SIZES})")
def size_parse(spark, sf):
    rows = spark.sql(_SIZE + "{customer}", customer=table(spark, sf, "customer")).withColumn("r", size.parse_employee_range(F.col("t")))
    return rows.select("c_custkey", F.col("r.min").alias("size_min"), F.col("r.max").alias("size_max"), size.size_label(F.col("r.min"), F.col("r.max")).alias("label"))


@query("size_verdict", f"SELECT c_custkey, CASE WHEN lo IS NULL AND hi IS NULL THEN 'UNKNOWN' WHEN lo > 200 THEN 'OVERSIZE' WHEN hi < 11 THEN 'UNDERSIZE' WHEN lo >= 11 AND hi <= 200 THEN 'IN_RANGE' ELSE 'SPANS_LIMIT' END AS verdict FROM ({_SIZES})")
def size_verdict(spark, sf):
    rows = spark.sql(_SIZE + "{customer}", customer=table(spark, sf, "customer")).withColumn("r", size.parse_employee_range(F.col("t")))
    return rows.select("c_custkey", size.size_verdict(F.col("r.min"), F.col("r.max"), 11, 200).alias("verdict"))


_FACTS = "SELECT o_orderkey AS company, CAST(o_orderkey % 20 AS DOUBLE) / 1.5 AS min_age_days, o_orderkey % 7 + 1 AS hiring_intensity, CAST(o_orderkey % 5 AS INT) AS g, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 90 AS INT) ELSE NULL END AS min_applicant_count, CAST(o_orderkey % 6 AS INT) AS persistent_days, CASE WHEN o_orderkey % 13 = 0 THEN 'Bolt Staffing' ELSE 'Acme' END AS company_name, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 300 AS BIGINT) END AS size_min, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 300 + 20 AS BIGINT) END AS size_max, CASE WHEN o_orderkey % 5 = 0 THEN 'Retail' ELSE 'Manufacturing' END AS client_industry, 'OBSERVED' AS industry_state, 'Manufacturing' AS search_industry, o_orderkey % 6 AS ta_role_count, o_orderkey % 2 = 0 AS has_senior_ta, o_orderkey % 17 = 0 AS identity_ambiguous FROM "
_SCORE = f"""WITH f AS ({_FACTS}orders), v AS (SELECT *, company_name = 'Bolt Staffing' AS agency,
  CASE WHEN size_min IS NULL THEN 'UNKNOWN' WHEN size_min > 200 THEN 'OVERSIZE' WHEN size_max < 11 THEN 'UNDERSIZE' WHEN size_min >= 11 AND size_max <= 200 THEN 'IN_RANGE' ELSE 'SPANS_LIMIT' END AS sv,
  CASE WHEN ta_role_count >= 4 OR (has_senior_ta AND ta_role_count >= 2) THEN 'MATURE' WHEN ta_role_count >= 2 THEN 'POSSIBLE' ELSE 'NONE' END AS tv FROM f),
w AS (SELECT *, list_filter([CASE WHEN agency THEN 'STAFFING_AGENCY' END, CASE sv WHEN 'OVERSIZE' THEN 'EMPLOYEE_SIZE_ABOVE_MAX' WHEN 'UNDERSIZE' THEN 'EMPLOYEE_SIZE_BELOW_MIN' END, CASE WHEN tv = 'MATURE' THEN 'MATURE_INTERNAL_TA' END], lambda s: s IS NOT NULL) AS r,
  list_filter([CASE sv WHEN 'UNKNOWN' THEN 'EMPLOYEE_SIZE_UNKNOWN' WHEN 'SPANS_LIMIT' THEN 'EMPLOYEE_SIZE_SPANS_LIMIT' END, CASE WHEN client_industry <> 'Manufacturing' THEN 'INDUSTRY_MISMATCH' END, CASE WHEN tv = 'POSSIBLE' THEN 'POSSIBLE_INTERNAL_TA' END, CASE WHEN identity_ambiguous THEN 'AMBIGUOUS_COMPANY_IDENTITY' END], lambda s: s IS NOT NULL) AS fl,
  CASE WHEN agency THEN 0 ELSE 25 END + CASE WHEN sv = 'IN_RANGE' THEN 15 ELSE 0 END + CASE WHEN client_industry = 'Manufacturing' THEN 12 ELSE 0 END
  + CASE WHEN min_age_days <= 2 THEN 15 WHEN min_age_days <= 7 THEN 10 WHEN min_age_days <= 12 THEN 6 ELSE 3 END + CASE WHEN hiring_intensity >= 5 THEN 12 WHEN hiring_intensity >= 3 THEN 9 WHEN hiring_intensity = 2 THEN 6 ELSE 3 END
  + CASE WHEN g >= 3 THEN 10 WHEN g = 2 THEN 7 WHEN g = 1 THEN 4 ELSE 0 END + CASE WHEN min_applicant_count IS NULL THEN 0 WHEN min_applicant_count <= 20 THEN 8 WHEN min_applicant_count <= 60 THEN 3 ELSE 0 END + CASE WHEN persistent_days >= 4 THEN 8 WHEN persistent_days >= 2 THEN 5 ELSE 0 END AS score FROM v)"""


def _facts(spark, sf):
    rows = spark.sql(_FACTS + "{orders}", orders=table(spark, sf, "orders"))
    return qualify.qualify(rows.withColumn("growth_hits", F.slice(F.array(*map(F.lit, "abcd")), 1, F.col("g"))))


@query("score_company", _SCORE + " SELECT company, CAST(score AS DOUBLE) AS score, CASE WHEN len(r) > 0 THEN 'REJECTED' WHEN len(fl) > 0 THEN 'NEEDS_REVIEW' ELSE 'QUALIFIED' END AS status, array_to_string(r, ',') AS reasons, array_to_string(fl, ',') AS review_flags FROM w")
def score_company(spark, sf):
    return _facts(spark, sf).select("company", "score", "status", F.array_join("reasons", ",").alias("reasons"), F.array_join("review_flags", ",").alias("review_flags"))


@query("reason_rows", _SCORE + " SELECT company, outcome, reason FROM (SELECT company, 'REJECTED' AS outcome, unnest(r) AS reason FROM w UNION ALL SELECT company, 'NEEDS_REVIEW', unnest(fl) FROM w)")
def reason_rows(spark, sf):
    return qualify.explode_reasons(_facts(spark, sf), "company").select("company", "outcome", "reason")


@query("size_second_pass", _SCORE + " SELECT company, CASE WHEN len(r) > 0 THEN 'REJECTED' WHEN len(list_filter(fl, lambda s: NOT (sv = 'UNKNOWN' AND company % 8 = 0 AND s = 'EMPLOYEE_SIZE_UNKNOWN'))) > 0 THEN 'NEEDS_REVIEW' ELSE 'QUALIFIED' END AS status, CAST(score + CASE WHEN len(r) = 0 AND sv = 'UNKNOWN' AND company % 8 = 0 THEN 15 ELSE 0 END AS DOUBLE) AS score FROM w")
def size_second_pass(spark, sf):
    rows = _facts(spark, sf).withColumn("dedup_key", F.col("company").cast("string")).withColumn("company_employee_count", F.lit(None).cast("string")).withColumn("size_source", F.lit(None).cast("string"))
    found = table(spark, sf, "orders").where("o_orderkey % 8 = 0").select(F.col("o_orderkey").cast("string").alias("dedup_key"), F.lit(50).cast("long").alias("min"), F.lit(60).cast("long").alias("max"), F.lit("WEB").alias("source")).distinct()
    return qualify.second_pass(rows, found).select("company", "status", "score")


# --- people and addresses -------------------------------------------------------------------------------------

TITLES = ["Owner", "CEO & Founder", "President of Maintenance", "Vice President of Operations", "SVP, Operations", "HR Manager", "Assistant Plant Manager", "Plant Manager", "Product Owner", "Regional President", "Talent Acquisition Lead", "Welder", "COO"]
PEOPLE = (
    "SELECT o_orderkey AS ord, 'co-' || CAST(o_custkey AS STRING) AS company_id, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'Pat Doe' || CAST(o_orderkey % 40 AS STRING) END AS name, "
    "CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES)) + " END AS title, "
    "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'pat.doe@c' || CAST(o_custkey AS STRING) || '.com' WHEN 2 THEN 'HR@mail.c' || CAST(o_custkey AS STRING) || '.com' WHEN 3 THEN 'pat@gmail.com' WHEN 4 THEN 'apply@indeed.com' WHEN 5 THEN 'joe@other.net' ELSE 'x@c' || CAST(o_custkey AS STRING) || '.bamboohr.com' END AS email, "
    "CASE o_orderkey % 3 WHEN 0 THEN 'COMPANY_WEBSITE' WHEN 1 THEN 'ZOOMINFO' ELSE 'PUBLIC_WEB' END AS source_type, CAST(o_orderkey % 50 AS DOUBLE) / 4 AS rank_score FROM "
)
DOMAINS = "SELECT 'co-' || CAST(c_custkey AS STRING) AS company_id, 'c' || CAST(c_custkey AS STRING) || '.com' AS domain FROM "
_NT = r"regexp_replace(trim(regexp_replace(replace(lower(title), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '\b(?:vice president|svp|evp)\b', 'vp', 'g')"


def _words(phrases):
    return lit(r"\b(?:" + "|".join(phrases) + r")\b")


SQL_TIER = f"CASE WHEN regexp_matches({_NT}, {_words(vocab.TITLE_EXCLUSIONS)}) THEN NULL WHEN regexp_matches(regexp_replace({_NT}, {lit(vocab.QUALIFIED_PRESIDENT)}, ' ', 'g'), {_words(vocab.TITLE_TIERS[1])}) THEN 1 " + " ".join(f"WHEN regexp_matches({_NT}, {_words(vocab.TITLE_TIERS[n])}) THEN {n}" for n in (2, 3, 4)) + " END"
_LOCAL, _MHOST = "lower(trim(split_part(email, '@', 1)))", "lower(split_part(email, '@', 2))"
SQL_ROLE = f"coalesce({_LOCAL} IN {listed(vocab.ROLE_LOCALS)} OR regexp_matches({_LOCAL}, '{'|'.join(vocab.ROLE_TOKENS)}'), false)"
SQL_CLASS = f"CASE WHEN email IS NULL THEN NULL WHEN {sql_root(_MHOST)} IN {listed(vocab.PLATFORM_HOSTS)} OR regexp_matches({_MHOST}, '{'|'.join(vocab.ATS_TOKENS)}') THEN 'PORTAL_GENERATED' WHEN {sql_root(_MHOST)} IN {listed(vocab.FREE_MAIL)} OR coalesce(domain, '') = '' THEN 'EXTERNAL_UNVERIFIED' WHEN {sql_root(_MHOST)} <> {sql_root('domain')} THEN 'DOMAIN_MISMATCH' WHEN {SQL_ROLE} THEN 'ROLE' ELSE 'PERSONAL' END"
SQL_STRENGTH = "CASE email_class WHEN 'PERSONAL' THEN 4 WHEN 'ROLE' THEN 3 WHEN 'DOMAIN_MISMATCH' THEN 2 WHEN 'EXTERNAL_UNVERIFIED' THEN 1 WHEN 'PORTAL_GENERATED' THEN 0 ELSE -1 END"
SQL_PEOPLE = f"WITH p AS (SELECT p.*, d.domain FROM ({PEOPLE}orders) p LEFT JOIN ({DOMAINS}customer) d USING (company_id)), c AS (SELECT *, {SQL_TIER} AS tier, {SQL_CLASS} AS email_class FROM p), poc AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY tier, -({SQL_STRENGTH}), CASE source_type WHEN 'COMPANY_WEBSITE' THEN 1 WHEN 'PUBLIC_WEB' THEN 5 ELSE 6 END, -coalesce(rank_score, 0), ord) AS poc_rank FROM c WHERE tier IS NOT NULL AND trim(coalesce(name, '')) <> '')"


def contacts(spark, sf):
    return spark.sql(PEOPLE + "{orders}", orders=table(spark, sf, "orders"))


def domains(spark, sf):
    return spark.sql(DOMAINS + "{customer}", customer=table(spark, sf, "customer"))


@query("title_tier", SQL_PEOPLE + " SELECT ord, tier FROM c")
def title_tier(spark, sf):
    return contacts(spark, sf).select("ord", text.title_tier(F.col("title")).alias("tier"))


@query("role_email", SQL_PEOPLE + f" SELECT ord, CASE WHEN email IS NULL THEN false ELSE {SQL_ROLE} END AS is_role FROM c")
def role_email(spark, sf):
    return contacts(spark, sf).select("ord", email.is_role_email(F.col("email")).alias("is_role"))


@query("email_class", SQL_PEOPLE + " SELECT ord, email_class FROM c")
def email_class(spark, sf):
    return contacts(spark, sf).join(domains(spark, sf), "company_id", "left").select("ord", email.classify_email(F.col("email"), F.col("domain")).alias("email_class"))


@query("poc_rank", SQL_PEOPLE + " SELECT ord, company_id, tier AS title_priority, poc_rank FROM poc")
def poc_rank(spark, sf):
    return people.rank_pocs(contacts(spark, sf), domains(spark, sf)).select("ord", "company_id", "title_priority", "poc_rank")


@query("select_contacts", SQL_PEOPLE + " SELECT ord, company_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY tier, rank_score DESC, ord) AS k FROM (SELECT *, row_number() OVER (PARTITION BY company_id, lower(trim(name)) ORDER BY tier, rank_score DESC, ord) AS b FROM c WHERE tier IS NOT NULL AND trim(name) <> '') WHERE b = 1) WHERE k <= 6")
def select_contacts(spark, sf):
    return people.select_contacts(contacts(spark, sf)).select("ord", "company_id")


@query("hiring_priority", SQL_PEOPLE + " SELECT company_id, min(tier) AS hiring_priority FROM c GROUP BY 1")
def hiring_priority(spark, sf):
    return people.hiring_priority(contacts(spark, sf))


_SEEN = f"""{SQL_PEOPLE}, v AS (SELECT company_id, ord, lower(trim(email)) AS email, name, title, email_class FROM c WHERE email IS NOT NULL AND regexp_matches(email, '^[A-Za-z0-9]')),
u AS (SELECT *, row_number() OVER (PARTITION BY company_id, email ORDER BY ord) AS k FROM v)"""


@query("discover_emails", _SEEN + " SELECT company_id, email, email_class, CASE WHEN email_class <> 'ROLE' THEN name END AS name FROM u WHERE k = 1")
def discover_emails(spark, sf):
    none = contacts(spark, sf).where("false").select("company_id", "ord", "email")
    return people.discover_emails(contacts(spark, sf), none, domains(spark, sf)).select("company_id", "email", "email_class", "name")


_OWN = "count(*) FILTER (email_class IN ('PERSONAL', 'ROLE'))"


@query("email_status", _SEEN + f""", s AS (SELECT company_id, count(*) FILTER (email_class = 'PERSONAL') AS n_personal, count(*) FILTER (email_class = 'ROLE') AS n_role, CASE WHEN {_OWN} > 1 THEN 'MULTIPLE_EMAILS_FOUND'
  WHEN count(*) FILTER (email_class = 'PERSONAL') > 0 THEN 'PERSONAL_EMAIL_FOUND' WHEN count(*) FILTER (email_class = 'ROLE') > 0 THEN 'ROLE_EMAIL_FOUND' ELSE 'LOW_CONFIDENCE_EMAIL_FOUND' END AS email_status FROM u WHERE k = 1 GROUP BY 1)
SELECT d.company_id, coalesce(n_personal, 0) AS n_personal, coalesce(n_role, 0) AS n_role, coalesce(email_status, 'NO_PUBLIC_EMAIL_FOUND') AS email_status FROM ({DOMAINS}customer) d LEFT JOIN s USING (company_id)""")
def email_status(spark, sf):
    none = contacts(spark, sf).where("false").select("company_id", "ord", "email")
    seen = people.discover_emails(contacts(spark, sf), none, domains(spark, sf))
    return people.email_status(seen, domains(spark, sf)).select("company_id", "n_personal", "n_role", "email_status")


@query("only_new_emails", _SEEN + " SELECT company_id, email FROM u WHERE k = 1 AND email NOT IN (SELECT email FROM v WHERE ord % 5 = 0)")
def only_new_emails(spark, sf):
    none = contacts(spark, sf).where("false").select("company_id", "ord", "email")
    seen = people.discover_emails(contacts(spark, sf), none, domains(spark, sf))
    known = contacts(spark, sf).where("ord % 5 = 0 and email is not null").select(F.lower(F.trim("email")).alias("email")).distinct()
    companies = seen.select("company_id", "email").join(known, "email")
    return people.only_new(seen, companies).select("company_id", "email")


PROVIDED = "SELECT o_orderkey AS seq, 'co-' || CAST(o_custkey AS STRING) AS company_id, 'APOLLO' AS provider, 'Pat Doe' || CAST(o_orderkey % 40 AS STRING) AS name, 'CEO' AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'pat.doe@c' || CAST(o_custkey AS STRING) || '.com' ELSE NULL END AS email, CAST(NULL AS STRING) AS person_id FROM {orders} WHERE o_orderkey % 4 = 1 OR o_orderkey % 4 = 2"


@query("match_people", SQL_PEOPLE + f", w AS ({PROVIDED.replace('{orders}', 'orders')}) SELECT w.company_id, w.seq, min(p.ord) AS matched_ord FROM w LEFT JOIN p ON p.company_id = w.company_id AND (lower(p.email) = lower(w.email) OR lower(trim(p.name)) = lower(w.name)) GROUP BY 1, 2")
def match_people(spark, sf):
    # names here are 'Pat DoeN': two words, of which digits aren't part of the key, so the key is made of letters only
    have = contacts(spark, sf).withColumn("person_id", F.lower(F.trim("name"))).withColumn("name", F.lit(None).cast("string"))
    want = spark.sql(PROVIDED, orders=table(spark, sf, "orders")).withColumn("person_id", F.lower("name")).withColumn("name", F.lit(None).cast("string"))
    return people.match_people(have, want).select("company_id", "seq", "matched_ord")


@query("merge_provider")
def merge_provider(spark, sf):
    have = contacts(spark, sf).withColumn("person_id", F.lit(None).cast("string")).withColumn("origin", F.col("source_type"))
    return people.merge_provider(have, spark.sql(PROVIDED, orders=table(spark, sf, "orders")), domains(spark, sf)).groupBy("origin").agg(F.count("*").alias("n"), F.count("replaced_email").alias("replaced"))


@query("disable_prefix", "SELECT o_orderkey AS seq, provider, coalesce(bool_or(status IN ('PROVIDER_RATE_LIMITED', 'PROVIDER_UNAVAILABLE')) OVER (PARTITION BY provider ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS disabled FROM (SELECT o_orderkey, 'p' || (o_custkey % 50) AS provider, CASE WHEN o_orderkey % 41 = 0 THEN 'PROVIDER_RATE_LIMITED' ELSE 'SUCCESS' END AS status FROM orders)")
def disable_prefix(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("provider"), F.when(F.col("o_orderkey") % 41 == 0, "PROVIDER_RATE_LIMITED").otherwise("SUCCESS").alias("status"))
    return people.disable_for_run(rows).select("seq", "provider", "disabled")


@query("budget_prefix", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def budget_prefix(spark, sf):
    return people.budget_prefix(table(spark, sf, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25).select("o_orderkey")


#: Every address's recorded answer by its first sighting, what the store knows of it, and the run's budget of 50 calls in order.
_VERIFY = f"""{SQL_PEOPLE}, a AS (SELECT ord AS seq, lower(trim(email)) AS e, email_class FROM c), f AS (SELECT e, min(seq) AS f FROM a WHERE e IS NOT NULL GROUP BY 1),
r AS (SELECT a.seq, a.e, a.email_class, f.f % 3 = 0 AS cached, f.f % 10 AS k, coalesce(email_class IN ('PERSONAL', 'ROLE'), false) AS trusted FROM a LEFT JOIN f USING (e)),
o AS (SELECT *, e IS NOT NULL AND trusted AND NOT cached AS open_, k = 5 AS pending FROM r), n AS (SELECT e, min(seq) AS n FROM o WHERE open_ GROUP BY 1),
w AS (SELECT o.*, n.n, open_ AND (seq = n.n OR pending) AS asks FROM o LEFT JOIN n USING (e)), l AS (SELECT max(seq) AS last FROM (SELECT seq FROM w WHERE asks ORDER BY seq LIMIT 50))
SELECT seq, CASE WHEN e IS NULL THEN NULL WHEN NOT trusted THEN 'SKIPPED' WHEN cached THEN 'VALID' WHEN n <= last AND NOT pending THEN CASE k % 3 WHEN 0 THEN 'RISKY' WHEN 1 THEN 'INVALID' ELSE 'UNKNOWN' END ELSE 'PENDING' END AS status,
  CASE WHEN e IS NULL THEN NULL WHEN NOT trusted THEN 'EMAIL_CLASS:' || email_class WHEN cached OR (n <= last AND NOT pending) THEN NULL WHEN seq <= last THEN 'UNRECOGNIZED_STATUS:odd' ELSE 'BUDGET_EXHAUSTED' END AS reason FROM w, l"""


@query("verify_emails", _VERIFY)
def verify_emails(spark, sf):
    rows = contacts(spark, sf).join(domains(spark, sf), "company_id", "left").select(F.col("ord").alias("seq"), "company_id", "email", email.classify_email(F.col("email"), F.col("domain")).alias("email_class"))
    first = rows.where("email is not null").groupBy(F.lower(F.trim("email")).alias("email")).agg(F.min("seq").alias("seq"))
    cache = first.where("seq % 3 = 0").select("email", F.lit("VALID").alias("status"), (now() - F.expr("INTERVAL 5 DAYS")).alias("checked_at"))
    old = first.where("seq % 3 = 1").select("email", F.lit("VALID").alias("status"), (now() - F.expr("INTERVAL 31 DAYS")).alias("checked_at"))
    k = (F.col("seq") % 10).cast("int")
    said = F.when(k == 5, F.lit("odd")).otherwise(F.get(F.array(*map(F.lit, ["Catch-All", "invalid", "unknown"])), k % 3))
    recorded = first.select("email", F.lit(200).alias("code"), F.lit(False).alias("timed_out"), F.lit(None).cast("string").alias("error"), said.alias("provider_status"))
    return people.verify(rows, cache.unionByName(old), recorded, now()).select("seq", "status", "reason")


@query("doc_emails", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}'))), ',') AS emails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9]@[A-Za-z0-9]')")
def doc_emails(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").rlike("[A-Za-z0-9]@[A-Za-z0-9]"))
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"({email.ADDRESS})"), 1)
    return docs.select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("emails"))


# --- sources and coverage -------------------------------------------------------------------------------------

OUTCOMES = "SELECT o_orderkey AS ord, 's' || CAST(o_custkey % 7 AS STRING) AS source, CAST(o_orderkey % 9 AS BIGINT) AS pages, CAST(o_orderkey % 90 AS BIGINT) AS jobs_returned, CAST(o_orderkey % 40 AS BIGINT) AS jobs_accepted, CAST(o_orderkey % 4 AS BIGINT) AS duplicates, CASE o_orderkey % 6 WHEN 0 THEN 'SOURCE_EXHAUSTED' WHEN 1 THEN 'BUDGET_REACHED' WHEN 2 THEN 'RATE_LIMITED' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'BLOCKED' ELSE 'SOURCE_LIMIT_REACHED' END AS stop_reason, CASE WHEN o_orderkey % 6 = 3 THEN 'e' || CAST(o_orderkey AS STRING) ELSE NULL END AS error_message FROM "


@query("coverage_rollup", f"""WITH o AS ({OUTCOMES}orders), r AS (SELECT source, string_agg(stop_reason || '=' || n, ',' ORDER BY stop_reason) AS stop_reasons FROM (SELECT source, stop_reason, count(*) AS n FROM o GROUP BY ALL) GROUP BY 1)
SELECT source, count(*) AS queries, sum(pages)::BIGINT AS pages, sum(jobs_returned)::BIGINT AS jobs_returned, sum(jobs_accepted)::BIGINT AS jobs_accepted, sum(duplicates)::BIGINT AS duplicates, count(*) FILTER (stop_reason = 'ERROR') AS errors,
  count(*) FILTER (stop_reason = 'BUDGET_REACHED') AS limited_by_own_budget, count(*) FILTER (stop_reason <> 'BUDGET_REACHED') AS limited_by_source, arg_max(error_message, ord) FILTER (error_message IS NOT NULL) AS last_error, any_value(stop_reasons) AS stop_reasons FROM o JOIN r USING (source) GROUP BY 1""")
def coverage_rollup(spark, sf):
    return coverage.coverage_by_source(spark.sql(OUTCOMES + "{orders}", orders=table(spark, sf, "orders")))


_LOGS = "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'status code 429' WHEN 2 THEN 'Forbidden by CloudFlare' WHEN 3 THEN 'robots said no' WHEN 4 THEN 'status code 500' WHEN 5 THEN 'Too many requests' WHEN 6 THEN 'status code 403' ELSE NULL END AS message, CASE WHEN o_orderkey % 5 = 0 THEN 503 WHEN o_orderkey % 5 = 1 THEN 403 ELSE NULL END AS status FROM "


@query("stop_reasons", f"SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'RATE_LIMITED' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'ROBOTS_RESTRICTED' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'RATE_LIMITED' WHEN 6 THEN 'BLOCKED' ELSE 'SOURCE_EXHAUSTED' END AS from_log, CASE WHEN o_orderkey % 8 = 3 THEN 'ROBOTS_RESTRICTED' WHEN o_orderkey % 5 = 0 OR o_orderkey % 8 = 5 THEN 'RATE_LIMITED' WHEN o_orderkey % 5 = 1 OR o_orderkey % 8 = 2 THEN 'BLOCKED' WHEN coalesce(message, '') <> '' THEN 'ERROR' ELSE 'SOURCE_EXHAUSTED' END AS from_fetch FROM ({_LOGS}orders)")
def stop_reasons(spark, sf):
    rows = spark.sql(_LOGS + "{orders}", orders=table(spark, sf, "orders"))
    return rows.select("o_orderkey", coverage.classify_log(F.col("message")).alias("from_log"), coverage.classify_fetch(F.col("message"), F.col("status")).alias("from_fetch"))


_CALLS = "SELECT 's' || CAST(l_suppkey % 9 AS STRING) AS source, l_orderkey AS title_ord, CASE WHEN l_linenumber = 1 THEN 'COUNTRY' ELSE 'STATE' END AS geo_level, l_linenumber * 100000 + l_partkey AS geo_ord, CASE WHEN l_orderkey % 2 = 0 THEN 'BUDGET_REACHED' ELSE 'ERROR' END AS stop_reason FROM "


@query("fanout_plan", f"""WITH r AS ({_CALLS}lineitem), n AS (SELECT * FROM r WHERE geo_level = 'COUNTRY'), a AS (SELECT * FROM n UNION ALL SELECT * FROM r WHERE geo_level = 'STATE' AND (source, title_ord) IN (SELECT (source, title_ord) FROM n WHERE stop_reason = 'BUDGET_REACHED'))
SELECT source, title_ord, geo_level, geo_ord, call_no FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (geo_level <> 'COUNTRY'), title_ord, geo_ord) AS call_no FROM a) WHERE call_no <= 500""")
def fanout_plan(spark, sf):
    return coverage.execute_plan(spark.sql(_CALLS + "{lineitem}", lineitem=table(spark, sf, "lineitem")), 500).select("source", "title_ord", "geo_level", "geo_ord", "call_no")


@query("completeness", CTES + " SELECT count(*) AS n, round(count(title) / count(*), 3) AS title, round(count(company_website) / count(*), 3) AS company_website, round(count(posted_at) / count(*), 3) AS posted_at FROM postings")
def completeness(spark, sf):
    return coverage.completeness(raw_postings(spark, sf), ["title", "company_website", "posted_at"])


@query("benchmark_runs", "SELECT 'a' || (o_custkey % 5) AS actor, count(DISTINCT o_orderkey % 100) AS runs, count(*) FILTER (o_orderstatus = 'F') AS successes, count(*) AS records, count(*) - count(DISTINCT o_custkey % 1000) AS duplicates, round(avg(o_totalprice), 3) AS mean_runtime, max(o_totalprice) AS max_runtime FROM orders GROUP BY 1")
def benchmark_runs(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat(F.lit("a"), (F.col("o_custkey") % 5).cast("string")).alias("actor"), (F.col("o_orderkey") % 100).alias("run_id"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("ERROR").alias("status"), (F.col("o_custkey") % 1000).alias("key"), F.col("o_totalprice").alias("runtime"))
    return coverage.benchmark_runs(rows)


# --- tables ---------------------------------------------------------------------------------------------------


@query("merge_non_null", "SELECT coalesce(n.k, o.k) AS k, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b FROM (SELECT c_custkey AS k, c_name AS a, c_mktsegment AS b FROM customer WHERE c_custkey % 3 > 0) o FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS a, CASE WHEN c_custkey % 5 = 0 THEN '' END AS b FROM customer WHERE c_custkey % 4 > 0) n ON o.k = n.k")
def merge_non_null(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    new = c.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("a"), F.when(F.col("c_custkey") % 5 == 0, "").alias("b"))
    return tables.merge_non_null(old, new, ["k"])


_EVIDENCE = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'job' ELSE 'note' END AS record_type, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS record_id FROM "


@query("orphan_evidence", f"SELECT id, record_type FROM ({_EVIDENCE}orders) e WHERE record_type = 'note' OR (record_type = 'company' AND record_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) OR (record_type = 'job' AND record_id IN (SELECT s_suppkey FROM supplier))")
def orphan_evidence(spark, sf):
    rows = spark.sql(_EVIDENCE + "{orders}", orders=table(spark, sf, "orders"))
    parents = {"company": table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), "job": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))}
    return tables.prune_orphans(rows, parents).select("id", "record_type")


@query("latest_verification", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_verification(spark, sf):
    return tables.latest(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("ttl_cache_hit", "SELECT c_custkey, coalesce(TIMESTAMP '1998-01-01 00:00:00' - max(o_orderdate) <= INTERVAL 90 DAY, false) AS hit FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def ttl_cache_hit(spark, sf):
    cache = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp").alias("at"))
    at = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return tables.cache_hits(table(spark, sf, "customer").select("c_custkey"), cache, ["c_custkey"], "at", at, 90)


@query("hiring_history", "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS persistent_days FROM events GROUP BY 1")
def hiring_history(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("company"), F.to_date("ts").alias("observed_on"))
    return tables.observed_days(rows).withColumnRenamed("company", "user_id")


#: What the verifier's log says of an address, by its last sighting.
LOGGED = ["VALID", "RISKY", "UNKNOWN", "PENDING"]


def leads(spark: SparkSession, sf: str) -> DataFrame:
    """Final leads over companies made of customers, contacts of orders and jobs of orders."""
    c = table(spark, sf, "customer")
    companies = c.select(F.concat(F.lit("co-"), F.col("c_custkey").cast("string")).alias("company_id"), F.col("c_name").alias("display_name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain"), F.when(F.col("c_custkey") % 3 == 0, "REJECTED").otherwise("QUALIFIED").alias("qualification_status"), F.when(F.col("c_custkey") % 10 > 0, F.col("c_acctbal")).alias("qualification_score"))
    people_ = contacts(spark, sf)
    ranked = people.rank_pocs(people_, domains(spark, sf))
    none = people_.where("false").select("company_id", "ord", "email")
    mails = people.discover_emails(people_, none, domains(spark, sf))
    jobs = people_.select(F.col("ord").alias("id"), "company_id", "title", F.lit(None).cast("string").alias("evidence_url"), "source_type")
    evidence = people_.where("false").select(F.col("ord").alias("id"), F.lit("company").alias("record_type"), F.col("company_id").alias("record_id"), F.lit("").alias("key"), F.lit("").alias("value"), F.lit("").alias("url"))
    told = F.get(F.array(*map(F.lit, LOGGED)), (F.col("ord") % 4).cast("int"))
    logs = people_.where("email is not null").select(F.col("ord").alias("id"), "company_id", "email", told.alias("status"), F.col("ord").alias("created_at"))
    calls = people_.where("false").select(F.col("ord").alias("id"), "company_id", F.lit("").alias("provider"), F.lit("").alias("status"), F.lit(0.0).alias("credit_cost"))
    return tables.final_leads(companies, ranked, mails, jobs, evidence, logs, calls)


_LEADS = f"""{SQL_PEOPLE}, logs AS (SELECT company_id, lower(email) AS e, arg_max(CASE ord % 4 WHEN 0 THEN 'VALID' WHEN 1 THEN 'RISKY' WHEN 2 THEN 'UNKNOWN' ELSE 'PENDING' END, ord) AS verification_status FROM p WHERE email IS NOT NULL GROUP BY 1, 2),
q AS (SELECT poc.*, verification_status FROM poc LEFT JOIN logs ON logs.company_id = poc.company_id AND logs.e = lower(poc.email) WHERE poc_rank <= 100),
s AS (SELECT d.company_id, CASE WHEN count(*) FILTER (q.email IS NOT NULL AND q.email_class = 'PERSONAL' AND verification_status = 'VALID') > 0 THEN 'READY'
  WHEN count(*) FILTER (q.email IS NOT NULL AND q.email_class = 'PERSONAL' AND coalesce(verification_status, 'PENDING') IN ('PENDING', 'UNKNOWN')) > 0 THEN 'PENDING_VERIFICATION' ELSE 'NO_VERIFIED_POC_EMAIL' END AS lead_status, count(q.ord) AS pocs FROM ({DOMAINS}customer) d LEFT JOIN q USING (company_id) GROUP BY 1)"""


@query("lead_status", _LEADS + " SELECT company_id, lead_status, pocs FROM s")
def lead_status(spark, sf):
    return leads(spark, sf).select("company_id", "lead_status", F.coalesce(F.array_size("pocs"), F.lit(0)).cast("long").alias("pocs"))


@query("export_rows", _LEADS + " SELECT s.company_id, lead_status, poc_rank, name AS poc_name, title AS poc_title, email AS poc_email, email_class AS poc_email_class, verification_status AS poc_verification FROM s LEFT JOIN q USING (company_id)")
def export_rows(spark, sf):
    return tables.export_rows(leads(spark, sf)).select("company_id", "lead_status", F.col("poc_rank").cast("long").alias("poc_rank"), "poc_name", "poc_title", "poc_email", "poc_email_class", "poc_verification")


@query("leads_page", _LEADS + " SELECT s.company_id FROM s JOIN customer ON s.company_id = 'co-' || c_custkey WHERE c_custkey % 3 <> 0 ORDER BY CASE WHEN c_custkey % 10 > 0 THEN c_acctbal END DESC NULLS FIRST, s.company_id LIMIT 40 OFFSET 20")
def leads_page(spark, sf):
    return tables.leads_page(leads(spark, sf), "QUALIFIED", None, 20, 40).select("company_id")


# --- taxonomy -------------------------------------------------------------------------------------------------

TERMS = [("CORE", "Manufacturing", "51-4041", "51", "Machinists", "Machinist", 1), ("CORE", "Manufacturing", "51-4121", "51", "Welders", "Welder", 2), ("CORE", "Manufacturing", "11-3051", "11", "Managers", "Plant Manager", 3), ("CORE", "Warehousing & Distribution", "53-7065", "53", "Stockers", "Warehouse Associate", 4), ("CORE", "Warehousing & Distribution", "11-3071", "11", "Managers", "Warehouse Manager", 5), ("CORE", "Retail", "11-1021", "11", "Managers", "Operations Manager", 6)]
NAICS = [("31", "Manufacturing", "Manufacturing"), ("333", "Machinery Manufacturing", "Industrial Equipment/Machinery"), ("3336", "Turbine Machinery Manufacturing", "Industrial Equipment/Machinery"), ("493", "Warehousing and Storage", "Warehousing & Distribution"), ("484", "Truck Transportation", "Logistics & Transportation"), ("531", "Real Estate", "Property Management/Real Estate"), ("722", "Food Services and Drinking Places", None)]


def terms(spark):
    from leadloom.schemas import SEARCH_TERMS

    return spark.createDataFrame(TERMS, SEARCH_TERMS)


@query("title_industry", CTES + ", t AS (SELECT title, trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')) AS low FROM postings GROUP BY ALL) SELECT title, CASE WHEN low IN ('welder') OR contains(low, 'machinist') OR contains(low, 'plant manager') THEN 'Manufacturing' WHEN contains(low, 'warehouse associate') THEN 'Warehousing & Distribution' END AS industry FROM t WHERE title IS NOT NULL")
def title_industry(spark, sf):
    return taxonomy.industry_of_title(raw_postings(spark, sf).where("title is not null").select("title"), terms(spark))


_LABELS = "SELECT CASE p_partkey % 7 WHEN 0 THEN 'Manufacturing' WHEN 1 THEN 'Retail' WHEN 2 THEN 'Industrial Machinery Manufacturing' WHEN 3 THEN 'Truck Transportation' WHEN 4 THEN 'Food Services' WHEN 5 THEN 'Insurance' ELSE 'Warehousing' END AS label FROM "


@query("label_sector", f"SELECT DISTINCT label, CASE label WHEN 'Manufacturing' THEN 'Manufacturing' WHEN 'Retail' THEN 'Retail' WHEN 'Industrial Machinery Manufacturing' THEN 'Industrial Equipment/Machinery' WHEN 'Truck Transportation' THEN 'Logistics & Transportation' WHEN 'Warehousing' THEN 'Warehousing & Distribution' END AS sector FROM ({_LABELS}part)")
def label_sector(spark, sf):
    from leadloom.schemas import NAICS_TITLES

    return taxonomy.sector_of_label(spark.sql(_LABELS + "{part}", part=table(spark, sf, "part")), spark.createDataFrame(NAICS, NAICS_TITLES))


@query("plan_variants", "SELECT title, title_rank, count(*) AS cells FROM (VALUES ('Warehouse Manager', 1), ('Warehouse Associate', 2)) v(title, title_rank), range(52) GROUP BY ALL")
def plan_variants(spark, sf):
    return taxonomy.plan(spark, "Warehousing & Distribution", "Warehouse  Manager", terms(spark)).groupBy("title", "title_rank").agg(F.count("*").alias("cells"))


# --- pages ----------------------------------------------------------------------------------------------------


@query("page_host_rollup", f"SELECT {sql_root(sql_host('url'))} AS root, count(*) AS pages FROM pages GROUP BY 1")
def page_host_rollup(spark, sf):
    return table(spark, sf, "pages").groupBy(url.registrable_domain(url.extract_host(F.col("url"))).alias("root")).agg(F.count("*").alias("pages"))
