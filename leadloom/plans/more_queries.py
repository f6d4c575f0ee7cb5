"""Queries over matching, pages, streams and single expressions; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates, size, text
from leadloom.operators import matching, people
from leadloom.plans.postings import lit, sql_root, table
from leadloom.plans.queries import now, query
from leadloom.scratch import Scratch
from leadloom.sources import html, registry
from leadloom.streaming import incremental

# --- expressions ----------------------------------------------------------------------------------------------

_AGES = "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'just posted' WHEN 1 THEN CAST(o_orderkey % 50 AS STRING) || 'm+' WHEN 2 THEN CAST(o_orderkey % 20 AS STRING) || ' days ago' WHEN 3 THEN CAST(o_orderkey % 9 AS STRING) || 'w' WHEN 4 THEN '3 months ago' WHEN 5 THEN 'yesterday' ELSE 'unclear' END AS t FROM "


@query("relative_age", "SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN (o_orderkey % 50) * 60 WHEN 2 THEN (o_orderkey % 20) * 86400 WHEN 3 THEN (o_orderkey % 9) * 604800 WHEN 4 THEN 3 * 2592000 WHEN 5 THEN 86400 END AS DOUBLE) AS seconds FROM orders")
def relative_age(spark, sf):
    rows = spark.sql(_AGES + "{orders}", orders=table(spark, sf, "orders"))
    return rows.select("o_orderkey", ((F.unix_micros(now()) - F.unix_micros(dates.relative_age(F.col("t"), now()))) / 1_000_000).alias("seconds"))


_TS = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2026-09-02' WHEN 1 THEN '2026-09-11T18:34:38-05:00' WHEN 2 THEN '09/15/2026' WHEN 3 THEN 'Yesterday' ELSE '2026-09-16T00:00:00.5+00:00' END AS t FROM "


@query("coerce_dates", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2026-09-02 00:00:00' WHEN 1 THEN '2026-09-11 23:34:38' WHEN 2 THEN '2026-09-15 00:00:00' WHEN 4 THEN '2026-09-16 00:00:00' END AS at, CASE o_orderkey % 5 WHEN 0 THEN 'DAY' WHEN 2 THEN 'DAY' WHEN 3 THEN NULL ELSE 'TIME' END AS precision FROM orders")
def coerce_dates(spark, sf):
    at = dates.coerce_timestamp(F.col("t"))
    return spark.sql(_TS + "{orders}", orders=table(spark, sf, "orders")).select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), dates.precision(at).alias("precision"))


_SAID = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'We have ' || CAST(c_custkey AS STRING) || ' to ' || CAST(c_custkey + 9 AS STRING) || ' employees.' WHEN 1 THEN 'A team of ' || CAST(c_custkey AS STRING) || '.' WHEN 2 THEN 'over ' || CAST(c_custkey AS STRING) || ' employees worldwide' WHEN 3 THEN '$5 million in revenue, ' || CAST(c_custkey AS STRING) || ' employees' WHEN 4 THEN 'fewer than ' || CAST(c_custkey AS STRING) || ' people' ELSE '40 locations' END AS t FROM "


@query("stated_size", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey END AS size_min, CASE c_custkey % 6 WHEN 0 THEN c_custkey + 9 WHEN 1 THEN c_custkey WHEN 4 THEN c_custkey END AS size_max FROM customer WHERE c_custkey > 0")
def stated_size(spark, sf):
    rows = spark.sql(_SAID + "{customer} WHERE c_custkey > 0", customer=table(spark, sf, "customer")).withColumn("s", size.extract_employee_size(F.col("t")))
    return rows.select("c_custkey", F.col("s.min").alias("size_min"), F.col("s.max").alias("size_max"))


@query("doc_phrase_hits", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {lit(text.phrase_pattern(['mit license', 'general public license', 'apache license']))}), lambda s: lower(s)))), ',') AS hits FROM documents WHERE regexp_matches(text, {lit(text.phrase_pattern(['mit license', 'general public license', 'apache license']))})")
def doc_phrase_hits(spark, sf):
    hits = text.all_phrases(F.col("text"), ["mit license", "general public license", "apache license"])
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(hits), ",").alias("hits")).where("hits <> ''")


@query("provider_status", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'VALID' WHEN 1 THEN 'RISKY' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'RISKY' ELSE 'UNKNOWN' END AS status, CASE o_orderkey % 5 WHEN 0 THEN 'PROVIDER_RATE_LIMITED' WHEN 1 THEN 'PROVIDER_UNAVAILABLE' WHEN 2 THEN 'PROVIDER_ERROR' WHEN 3 THEN 'PROVIDER_TIMEOUT' ELSE 'SUCCESS' END AS outcome FROM orders")
def provider_status(spark, sf):
    from leadloom.functions import email

    said = F.get(F.array(*map(F.lit, ["valid", "Catch-All ", "INVALID", "do_not_mail", "unknown", "new"])), (F.col("o_orderkey") % 6).cast("int"))
    code = F.get(F.array(*map(F.lit, [429, 403, 500, 200, 200])), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", email.provider_status(said).alias("status"), people.http_status_to_provider(code, F.col("o_orderkey") % 5 == 3).alias("outcome"))


@query("waterfall_need", """SELECT o_orderkey, CASE WHEN k = 0 THEN CASE WHEN b THEN 'full' END WHEN k = 2 AND m > 0 THEN 'people' WHEN k IN (3, 4) AND b THEN 'full' END AS need,
  CASE WHEN k = 0 THEN CASE WHEN b THEN 'PRIMARY' ELSE 'NOTHING_MISSING' END WHEN k = 1 THEN 'ZOOMINFO PROVIDER_SUCCESS' WHEN k = 2 AND m = 1 THEN 'ZOOMINFO PROVIDER_PARTIAL: no PERSONAL email for Ann' WHEN k = 2 AND m = 2 THEN 'ZOOMINFO PROVIDER_PARTIAL: no PERSONAL email for Ann, ?'
    WHEN k = 3 AND b THEN 'ZOOMINFO PROVIDER_NO_MATCH: AMBIGUOUS' WHEN k = 4 AND b THEN 'ZOOMINFO PROVIDER_ERROR' ELSE 'NOTHING_MISSING' END AS reason
  FROM (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % 4 < 2 AS b, o_orderkey % 3 AS m FROM orders)""")
def waterfall_need(spark, sf):
    from leadloom.operators import enrichment

    k = (F.col("o_orderkey") % 6).cast("int")
    status = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, ["PROVIDER_SUCCESS", "PROVIDER_PARTIAL", "PROVIDER_NO_MATCH", "PROVIDER_ERROR"])), k)
    missing = F.slice(F.array(F.lit("Ann"), F.lit(None).cast("string")), F.lit(1), (F.col("o_orderkey") % 3).cast("int"))
    below, reason = F.col("o_orderkey") % 4 < 2, F.when(k == 3, F.lit("AMBIGUOUS"))
    provider = F.when(status.isNotNull(), F.lit("ZOOMINFO"))
    later = enrichment.decide(False, status, provider, reason, below, missing)
    w = F.when(k == 0, enrichment.decide(True, status, provider, reason, below, missing)).otherwise(later)
    return table(spark, sf, "orders").withColumn("w", w).select("o_orderkey", "w.need", "w.reason")


# --- matching -------------------------------------------------------------------------------------------------

_NAMES = "SELECT 'Acme' || CAST(c_custkey AS STRING) || ' Tools Inc' AS name, CASE c_custkey % 4 WHEN 0 THEN 'Toledo, OH' WHEN 1 THEN 'Austin, TX' WHEN 2 THEN NULL ELSE 'Boston, MA' END AS location FROM "
_DIRECTORY = "SELECT 'Acme' || CAST(c_custkey AS STRING) || ' Tools' AS dir_name, CASE WHEN c_custkey % 10 = 0 THEN 'acme' || CAST(c_custkey AS STRING) || ' tools inc' ELSE 's' || CAST(c_custkey AS STRING) END AS slug, 'https://acme' || CAST(c_custkey AS STRING) || '.com' AS dir_url, CASE c_custkey % 3 WHEN 0 THEN 'Toledo, OH' WHEN 1 THEN NULL ELSE 'Dallas, Texas' END AS dir_location FROM "


@query("match_directory", """SELECT name, CASE WHEN c % 7 = 0 THEN 'NO_MATCH' WHEN c % 10 = 0 OR agrees THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN c % 7 > 0 AND (c % 10 = 0 OR agrees) THEN 'https://acme' || c || '.com' END AS url,
  CASE WHEN c % 7 = 0 THEN 'NO_CANDIDATE' WHEN c % 10 = 0 THEN 'SLUG' WHEN agrees THEN 'NAME_AND_LOCATION' WHEN c % 4 <> 2 AND c % 3 <> 1 THEN 'LOCATION_CONTRADICTS' ELSE 'NAME_ONLY' END AS reason
  FROM (SELECT 'Acme' || c_custkey || ' Tools Inc' AS name, c_custkey AS c, (c_custkey % 4 = 0 AND c_custkey % 3 = 0) OR (c_custkey % 4 = 1 AND c_custkey % 3 = 2) AS agrees FROM customer)""")
def match_directory(spark, sf):
    c = table(spark, sf, "customer")
    return matching.match_directory(spark.sql(_NAMES + "{c}", c=c), spark.sql(_DIRECTORY + "{c} WHERE c_custkey % 7 > 0", c=c)).select("name", "status", "url", "reason")


@query("match_provider_company", """SELECT 'co-' || c AS company_id, CASE WHEN c % 4 = 3 THEN 'NO_MATCH' WHEN c % 2 = 0 THEN CASE WHEN c % 3 = 0 THEN 'MATCHED' ELSE 'DOMAIN_MISMATCH' END ELSE CASE WHEN c % 5 = 0 THEN 'MATCHED' ELSE 'NO_MATCH' END END AS reason,
  CASE WHEN c % 4 = 3 THEN NULL WHEN c % 2 = 0 AND c % 3 = 0 THEN 'DOMAIN' WHEN c % 2 = 1 AND c % 5 = 0 THEN 'NAME_AND_STATE' END AS method FROM (SELECT c_custkey AS c FROM customer)""")
def match_provider_company(spark, sf):
    c = F.col("c_custkey")
    key = F.concat(F.lit("co-"), c.cast("string")).alias("company_id")
    base = table(spark, sf, "customer")
    companies = base.select(key, F.when(c % 2 == 0, F.concat(F.lit("c"), c.cast("string"), F.lit(".com"))).otherwise(F.lit("")).alias("domain"), F.lit("Acme Inc").alias("name"), F.array(F.lit("OH")).alias("states"))
    found = base.where("c_custkey % 4 <> 3").select(key, c.cast("string").alias("cand_id"), F.when(c % 5 == 0, F.lit("ACME, LLC")).otherwise(F.lit("Bolt")).alias("cand_name"), F.when(c % 3 == 0, F.concat(F.lit("https://www.c"), c.cast("string"), F.lit(".com/x"))).otherwise(F.lit("other.com")).alias("website"), F.lit("Ohio").alias("state"))
    return matching.match_provider_company(companies, found).select("company_id", "reason", "method")


@query("linkedin_identity", """SELECT 'co-' || c AS company_id, CASE WHEN c % 6 IN (0, 5) THEN 'NO_COMPANY' WHEN c % 6 = 1 THEN 'CONFIRMED' WHEN c % 6 = 2 THEN 'DOMAIN_MISMATCH' WHEN c % 6 = 3 THEN 'LINKEDIN_WEBSITE_MISSING' ELSE 'AMBIGUOUS' END AS identity FROM (SELECT c_custkey AS c FROM customer)""")
def linkedin_identity(spark, sf):
    c, base = F.col("c_custkey"), table(spark, sf, "customer")
    key, own = F.concat(F.lit("co-"), c.cast("string")).alias("company_id"), F.concat(F.lit("c"), c.cast("string"), F.lit(".com"))
    employers = base.select(key, F.when(c % 6 != 0, own).alias("domain"))
    page = F.concat(F.lit("https://www.linkedin.com/company/C"), c.cast("string"), F.lit("/"))
    site = F.when(c % 6 == 1, own).when(c % 6 == 2, F.lit("other.com")).when(c % 6 == 4, own)
    items = base.where("c_custkey % 6 <> 5").select(key, page.alias("profile_company_url"), site.alias("company_website"))
    second = base.where("c_custkey % 6 = 4").select(key, F.lit("linkedin.com/company/second").alias("profile_company_url"), own.alias("company_website"))
    return matching.linkedin_identity(employers, items.unionByName(second)).select("company_id", "identity")


@query("resolve_domains", """SELECT 'co-' || c AS company_id, CASE WHEN c % 3 = 0 THEN 'ACCEPTED' WHEN c % 3 = 1 THEN 'REVIEW' ELSE 'UNRESOLVED' END AS decision, CASE c % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT c_custkey AS c FROM customer)""")
def resolve_domains(spark, sf):
    c, base = F.col("c_custkey"), table(spark, sf, "customer")
    key = F.concat(F.lit("co-"), c.cast("string")).alias("company_id")
    rows = base.select(key, F.lit(1).alias("seq"), F.lit("Summit Tools Inc").alias("name"), F.lit("Toledo, OH").alias("location"), F.when(c % 3 == 2, F.lit("zzz.com")).otherwise(F.lit("summittools.com")).alias("domain"), F.lit("Welcome").alias("title"), F.when(c % 3 == 0, F.lit("Summit makes tools in Toledo.")).otherwise(F.lit("nothing here")).alias("body"))
    return matching.resolve_domains(rows).select("company_id", "decision", "confidence")


@query("unwrap_redirect", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'https://acme.com/a+b' WHEN 1 THEN 'https://acme.com/' ELSE 'https://plain.com/?x=1' END AS url FROM orders")
def unwrap_redirect(spark, sf):
    wrapped = F.get(F.array(F.lit("https://duck.example/l/?uddg=https%3A%2F%2Facme.com%2Fa+b&x=1"), F.lit("https://bing.example/ck/a?!&&u=a1aHR0cHM6Ly9hY21lLmNvbS8"), F.lit("https://plain.com/?x=1")), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", matching.unwrap_redirect(wrapped).alias("url"))


# --- pages ----------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>|\s+', ' ', 'g')"


@query("page_visible_text", f"SELECT page_id, length(trim({_STRIP})) AS n_chars FROM pages")
def page_visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(registry.visible(F.col("html"))).cast("long").alias("n_chars"))


_ANY = lambda c, marks: "(" + " OR ".join(f"contains({c}, {lit(m)})" for m in marks) + ")"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query("page_blocked", rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, CASE page_id % 7 WHEN 0 THEN 407 WHEN 1 THEN 200 END AS status, page_id % 3 = 0 AS rendered FROM pages),
m AS (SELECT *, lower(substr(html, 1, 4000)) AS head, lower(regexp_extract(substr(html, 1, 4000), '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(regexp_replace({_BARE}, '^\s+|\s+$', '', 'g')) AS shown, lower(substr(regexp_replace(html, '^\s+', ''), 1, 200)) AS opening FROM p)
SELECT page_id, coalesce(status IN (401, 403, 407, 429, 503), false) OR NOT regexp_matches(html, '\S') OR {_ANY('head', vocab.BLOCK_STRONG)} OR {_ANY('title', vocab.BLOCK_WEAK)}
  OR (NOT rendered AND NOT (starts_with(opening, '{{') OR starts_with(opening, '[') OR {_ANY('opening', vocab.DOCUMENT_ROOTS)}) AND (shown < 500 OR (shown < 1200 AND {_ANY('head', vocab.BLOCK_WEAK)}))) AS blocked FROM m""")
def page_blocked(spark, sf):
    status = F.when(F.col("page_id") % 7 == 0, 407).when(F.col("page_id") % 7 == 1, 200)
    return table(spark, sf, "pages").select("page_id", registry.access_wall(F.col("html"), status, F.col("page_id") % 3 == 0).alias("blocked"))


@query("page_people")
def page_people(spark, sf):
    """People of every page, after one person and one mailto are added to it."""
    more = F.concat("html", F.lit('<div class="vcard"><span class="fn">Pat Plant</span><span class="title">Plant Manager</span><a href="mailto:pat@acme.com">m</a></div>'))
    return html.contacts_of_pages(table(spark, sf, "pages").select("page_id", more.alias("html")), "page_id")


@query("page_emails", "SELECT page_id, 0 AS position, 'pat@acme.com' AS email FROM pages")
def page_emails(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("html", "@", " "), F.lit('<a href="mailto:Pat%40acme.com?x=1">m</a>')).alias("html"))
    return html.emails_of_pages(rows, "page_id")


@query("page_addresses")
def page_addresses(spark, sf):
    """Addresses of every page as it is; a page without any has one row of nulls."""
    pages = table(spark, sf, "pages")
    return pages.select("page_id").join(html.emails_of_pages(pages, "page_id"), "page_id", "left")


@query("page_postings", f"SELECT page_id, 'Welder' AS title, 'Acme' AS company_name, 'Toledo, OH' AS location, {sql_root(lit('acme.com'))} AS root FROM pages")
def page_postings(spark, sf):
    from leadloom.functions import url

    script = '<script type="application/ld+json">[{"@type":"JobPosting","title":"Welder","hiringOrganization":{"name":"Acme","sameAs":"https://www.acme.com"},"jobLocation":{"address":{"addressLocality":"Toledo","addressRegion":"OH"}}}]</script>'
    rows = html.postings_of_pages(table(spark, sf, "pages").select("page_id", F.concat(F.lit(script), "html").alias("html")), "page_id")
    return rows.select("page_id", "title", "company_name", "location", url.normalize_domain(F.col("company_website")).alias("root"))


# --- streams --------------------------------------------------------------------------------------------------


@query("hiring_daily_stream", "SELECT user_id, CAST(d AS VARCHAR) AS observed_on, count(*) AS n FROM (SELECT user_id, CAST(ts AS DATE) AS d FROM events) WHERE d < (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY ALL")
def hiring_daily_stream(spark, sf):
    """Counts of every closed day, from a drained stream; the last day's window is still open."""
    scratch = Scratch(spark, "stream")
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))
    out = scratch.path("out")
    incremental.run_available(incremental.daily_counts(stream, "user_id", "at", "0 seconds"), out, scratch.path("checkpoint"))
    return spark.read.schema("user_id long, observed_on date, n long").parquet(out).select("user_id", F.col("observed_on").cast("string").alias("observed_on"), "n")


@query("dedupe_within_watermark", "SELECT DISTINCT 'u' || user_id AS source_site, event_type AS external_id FROM events")
def dedupe_within_watermark(spark, sf):
    scratch = Scratch(spark, "stream")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    rows = stream.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_site"), F.col("event_type").alias("external_id"), F.col("ts").cast("timestamp").alias("posted_at"))
    out = scratch.path("out")
    incremental.run_available(incremental.admit(rows, 40), out, scratch.path("checkpoint"))
    return spark.read.schema("source_site string, external_id string, posted_at timestamp").parquet(out).select("source_site", "external_id")

