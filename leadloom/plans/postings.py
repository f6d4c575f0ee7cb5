"""Job postings derived from the star schema, and normalization written once more in SQL for checking.

The derivation is plain arithmetic and CASE, in text that Spark SQL and DuckDB both run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leadloom import vocab
from leadloom.operators.normalize import normalize

NOW = "2026-06-01 12:00:00"

POSTINGS = """
SELECT ((l.l_orderkey * 10 + l.l_linenumber) * 100000 + l.l_partkey) * 10000 + l.l_suppkey AS ord,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'ATS' ELSE 'JOB_BOARD' END AS source_type,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS source_priority,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'indeed' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'talent_com' ELSE 'greenhouse' END AS source_site,
  CASE WHEN l.l_linenumber % 5 = 0 THEN NULL ELSE 'job-' || CAST(l.l_partkey % 300 AS STRING) END AS external_id,
  CASE WHEN l.l_partkey % 37 = 0 THEN NULL ELSE CASE l.l_partkey % 8 WHEN 0 THEN 'Plant Manager' WHEN 1 THEN 'Welder ' WHEN 2 THEN 'Machinist (1st Shift) -' WHEN 3 THEN 'Technical Recruiters'
    WHEN 4 THEN 'Warehouse  Associate' WHEN 5 THEN 'HR Director' WHEN 6 THEN 'Talent Acquisition Partner &amp; Sourcer' ELSE 'VP, Operations' END END AS title,
  CASE o.o_orderkey % 9 WHEN 0 THEN c.c_name || ' Inc.' WHEN 1 THEN c.c_name || ', LLC' WHEN 2 THEN c.c_name || ' Co., Inc.' WHEN 3 THEN 'The ' || c.c_name WHEN 4 THEN c.c_name || ' & Sons'
    WHEN 5 THEN CASE WHEN c.c_custkey % 11 = 0 THEN c.c_name || ' Staffing Group' ELSE c.c_name END WHEN 6 THEN upper(c.c_name) WHEN 7 THEN '  ' || c.c_name || ' Corp.'
    ELSE CASE WHEN l.l_linenumber = 3 THEN NULL ELSE c.c_name || ' Ltd' END END AS company_name,
  CASE c.c_custkey % 5 WHEN 0 THEN 'https://www.indeed.com/cmp/C-' || CAST(c.c_custkey AS STRING) WHEN 1 THEN 'https://www.linkedin.com/company/c' || CAST(c.c_custkey AS STRING) || '/' ELSE NULL END AS company_url,
  CASE WHEN c.c_custkey % 4 = 0 AND o.o_orderkey % 2 = 0 THEN 'https://www.c' || CAST(c.c_custkey AS STRING) || '.co.uk/about' WHEN c.c_custkey % 4 = 1 THEN 'c' || CAST(c.c_custkey % 50 AS STRING) || '.com'
    WHEN c.c_custkey % 16 = 2 THEN 'https://indeed.comnone/x' ELSE NULL END AS company_website,
  CASE (c.c_nationkey + l.l_linenumber) % 11 WHEN 0 THEN 'Toledo, OH' WHEN 1 THEN 'Toledo, Ohio, United States' WHEN 2 THEN 'COLUMBUS, OH 43215' WHEN 3 THEN 'Remote - US' WHEN 4 THEN 'Toronto, Canada'
    WHEN 5 THEN 'austin, tx, US' WHEN 6 THEN 'US' WHEN 7 THEN 'Hybrid in Boston, MA' WHEN 8 THEN 'Washington, District of Columbia' WHEN 9 THEN 'Fort Worth, TX (North)' ELSE NULL END AS location,
  CASE o.o_orderkey % 7 WHEN 0 THEN 'A rapidly growing plant: second shift, expanding.' WHEN 1 THEN 'Write to Jobs@c' || CAST(c.c_custkey % 50 AS STRING) || '.com or pat.doe@c' || CAST(c.c_custkey AS STRING) || '.com.'
    WHEN 2 THEN 'Our client is seeking a welder. Growth! growth' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'A new facility with process improvement.' END AS description,
  CASE WHEN l.l_partkey % 17 = 0 THEN NULL WHEN l.l_partkey % 5 = 0 THEN TIMESTAMP '2026-06-01 00:00:00' - INTERVAL '1' DAY * CAST(l.l_partkey % 21 AS INT)
    ELSE TIMESTAMP '2026-06-01 12:00:00' - INTERVAL '1' HOUR * CAST((l.l_orderkey * 7 + l.l_linenumber * 13) % 420 - 2 AS INT) END AS posted_at,
  'https://' || CASE WHEN o.o_orderkey % 6 = 0 THEN 'careers.c' || CAST(c.c_custkey AS STRING) || '.com' ELSE 'www.indeed.com' END || '/viewjob?jk=' || CAST(l.l_partkey AS STRING) AS application_url,
  CASE WHEN o.o_orderkey % 10 = 0 THEN 'https://jobs.lever.co/T' || CAST(c.c_custkey % 40 AS STRING) || '/x' ELSE NULL END AS apply_url,
  CASE WHEN c.c_custkey % 23 = 0 THEN 'DE' ELSE NULL END AS country,
  CASE WHEN l.l_linenumber = 2 THEN true ELSE NULL END AS is_remote,
  'Manufacturing' AS search_industry,
  CASE c.c_custkey % 8 WHEN 0 THEN '51 to 200' WHEN 1 THEN '1,001 to 5,000' WHEN 2 THEN '10,000+' WHEN 3 THEN 'fewer than 10' WHEN 4 THEN '200 employees' WHEN 5 THEN '1 to 50' WHEN 6 THEN '2k' ELSE NULL END AS company_employee_count,
  CASE WHEN l.l_partkey % 3 = 0 THEN CAST(l.l_partkey % 90 AS INT) ELSE NULL END AS applicant_count,
  CASE WHEN l.l_linenumber % 3 = 0 THEN 336 WHEN l.l_linenumber % 3 = 1 THEN 360 ELSE NULL END AS window_hours
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores: one that has fewer partitions than cores, as of a table in one small file, is dealt anew; others stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived postings with the columns of a raw job."""
    df = spark.sql(POSTINGS.replace("FROM lineitem l JOIN orders o", "FROM {lineitem} l JOIN {orders} o").replace("JOIN customer c", "JOIN {customer} c"), lineitem=spread(table(spark, sf_dir, "lineitem")), orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    return df.selectExpr("*", "CAST(array() AS array<string>) AS observed_emails", "CAST(NULL AS string) AS ats_platform", "CAST(NULL AS string) AS company_industry", "CAST(map() AS map<string,string>) AS raw", "named_struct('source_date_window_hours', window_hours) AS provenance")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(raw_postings(spark, sf_dir))


# --- the same rules as SQL ---------------------------------------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


TAIL = r"[\s,.\-/|]+$"


def sql_text(x: str) -> str:
    return f"trim({sub(f'lower({x})', '[[:space:]]+', ' ')})"


def sql_title(x: str) -> str:
    return sub(sql_text(f"replace({x}, '&amp;', '&')"), TAIL, "")


def sql_company(x: str) -> str:
    name = sub(sub(sql_text(f"replace({x}, '&', ' and ')"), "['`]", ""), TAIL, "")
    for _ in range(3):
        name = sub(sub(name, r"[\s,]*\b(?:" + "|".join(map(re.escape, vocab.LEGAL_SUFFIXES)) + r")\b\.?$", ""), TAIL, "")
    return sub(f"trim({sub(sub(name, '[^a-z0-9_ ]', ' '), ' +', ' ')})", "^the +", "")


def sql_host(x: str) -> str:
    url = f"CASE WHEN contains(trim({x}), '//') THEN trim({x}) ELSE '//' || trim({x}) END"
    return sub(f"lower(regexp_extract({url}, '^[^/?#]*//(?:[^/?#@]*@)*([^/?#:@]*)', 1))", r"^www\.", "")


def sql_root(h: str) -> str:
    long = rf"([^.]*\.(?:{'|'.join(vocab.SECOND_LEVEL)})\.[^.][^.])$"
    return f"CASE WHEN regexp_matches({h}, {lit(long)}) THEN regexp_extract({h}, {lit(long)}, 1) ELSE regexp_extract({h}, '([^.]*(?:[.][^.]*)?)$', 1) END"


def sql_employer(h: str) -> str:
    glued = "^(?:" + "|".join(map(re.escape, vocab.PLATFORM_HOSTS)) + r")[^.]"
    root = sql_root(h)
    tokens = "|".join(vocab.ATS_TOKENS)
    return f"(regexp_matches({h}, '[.][A-Za-z]{{2,24}}$') AND NOT regexp_matches({h}, '{tokens}') AND NOT regexp_matches({h}, {lit(glued)}) AND NOT regexp_matches({root}, {lit(glued)}) AND {root} NOT IN {listed(vocab.PLATFORM_HOSTS)} AND {root} NOT IN {listed(vocab.FREE_MAIL)})"


def sql_domain(x: str) -> str:
    """The employer domain of a URL column, '' without one."""
    return f"coalesce((SELECT CASE WHEN {sql_employer('h')} AND {sql_employer('(' + sql_root('h') + ')')} THEN {sql_root('h')} ELSE '' END FROM (SELECT {sql_host(x)} AS h)), '')"


def sql_state(x: str) -> str:
    names = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in vocab.US_STATES.items()) + "}"
    parts = f"list_filter(list_transform(string_split(trim({sub(x, '[[:space:]]+', ' ')}), ','), lambda p: trim(trim(trim(p), '.'))), lambda p: p <> '')"
    one = f"CASE WHEN lower(p) IN {listed(vocab.COUNTRY_PARTS)} THEN NULL WHEN upper(p) IN {listed(vocab.STATE_CODES)} THEN upper(p) ELSE {names}[lower(p)] END"
    return f"(SELECT list_filter(list_transform(list_concat(list_reverse(q[2:]), q[1:1]), lambda p: {one}), lambda s: s IS NOT NULL)[1] FROM (SELECT {parts} AS q))"


PLACED = f"""
SELECT *, CASE WHEN state IS NOT NULL AND first <> '' AND coalesce(first_state <> state, true) AND lower(first) NOT IN {listed(vocab.COUNTRY_PARTS)}
     THEN CASE WHEN first = upper(first) OR first = lower(first) THEN upper(first[1]) || lower(first[2:]) ELSE first END END AS city,
  CASE WHEN country_in IS NOT NULL THEN upper(country_in) WHEN state IS NOT NULL OR contains(low, 'united states') OR list_has_any(regexp_extract_all(replace(low, '.', ''), '[a-z]+'), ['us', 'usa']) THEN 'US'
     WHEN {" OR ".join(f"contains(low, {lit(m)})" for m in vocab.NON_US_MARKERS)} THEN 'NON_US' END AS country,
  coalesce(remote_in, false) OR regexp_matches(low, '\\bremote\\b') AS is_remote
FROM (SELECT *, lower(place) AS low, {sql_state('place')} AS state, {sql_state('first')} AS first_state FROM (
  SELECT *, trim({sub("split_part(place, ',', 1)", '(?i)^(?:hybrid|remote|on-?site|onsite) +(?:in|-) +', '')}) AS first
  FROM (SELECT * EXCLUDE (country, is_remote), country AS country_in, is_remote AS remote_in, trim({sub(sub("coalesce(location, '')", r'\b[0-9]{5}(?:-[0-9]{4})?\b', ''), '[[:space:]]+', ' ')}, ' ,') AS place FROM postings)))
"""

#: CTEs that every SQL text over postings begins with: postings, and norm with the normalized columns.
CTES = f"""
WITH postings AS ({POSTINGS}),
placed AS ({PLACED}),
mailed AS (SELECT *, list_transform(regexp_extract_all(coalesce(description, ''), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}'), lambda e: regexp_replace(lower(e), '[.,;:)]+$', '')) AS mails FROM placed),
domains AS (SELECT *, {sql_domain('company_website')} AS d1, {sql_domain('company_url')} AS d2, {sql_domain('application_url')} AS d3, {sql_domain('apply_url')} AS d4,
  {sql_domain("split_part(mails[1], '@', 2)")} AS d5, {sql_domain("split_part(mails[2], '@', 2)")} AS d6 FROM mailed),
norm AS (SELECT ord, source_type, source_priority, source_site, external_id, title, company_name, company_url, company_website, location, description, posted_at, application_url, apply_url, search_industry,
  company_employee_count, applicant_count, window_hours, mails, city, state, country, is_remote,
  coalesce({sql_company('company_name')}, '') AS company_name_normalized, coalesce({sql_title('title')}, '') AS title_normalized,
  CASE WHEN d1 <> '' THEN d1 WHEN d2 <> '' THEN d2 WHEN d3 <> '' THEN d3 WHEN d4 <> '' THEN d4 WHEN d5 <> '' THEN d5 ELSE d6 END AS domain,
  CASE WHEN d1 <> '' THEN 'COMPANY_WEBSITE' WHEN d2 <> '' THEN 'COMPANY_URL' WHEN d3 <> '' THEN 'APPLICATION_URL' WHEN d4 <> '' THEN 'APPLY_URL' WHEN d5 <> '' OR d6 <> '' THEN 'OBSERVED_EMAIL' ELSE 'NONE' END AS domain_source,
  lower(CASE WHEN state IS NOT NULL AND city IS NOT NULL THEN city || ', ' || state WHEN state IS NOT NULL THEN state WHEN is_remote THEN 'remote' ELSE '' END) AS location_key,
  CASE WHEN coalesce({sql_company('company_name')}, '') = '' THEN 'NO_COMPANY_NAME' WHEN country <> 'US' THEN 'NOT_US' END AS screen_reason,
  CASE WHEN posted_at IS NULL THEN NULL WHEN date_trunc('day', posted_at) = posted_at THEN 'DAY' ELSE 'TIME' END AS date_precision
FROM domains)
"""
