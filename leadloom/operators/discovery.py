"""Finding people, sizes and domains on recorded pages: which pages a run would read, in which order, and when it stops.

A company's pages are few (budgets bound them), so its order is a window inside the company; companies never meet but
for the budgets of a run, which are a top-k of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates, pages, size, text, url
from leadloom.operators import matching
from leadloom.vocab import Settings

#: Pages that a posting, its profiles, a homepage and a sitemap may contribute.
JOB_URLS, PROFILE_URLS, HOME_LINKS, SITEMAP_PAGES = 5, 4, 6, 3
SUBDOMAIN_PATHS = ["/contact", "/team", "/about"]


def _first(rows: DataFrame, n: int, order: str = "position") -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(order, "url")
    return rows.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= n)


def _base(site: Column) -> Column:
    return F.regexp_replace(F.when(site.contains("//"), site).otherwise(F.concat(F.lit("https://"), site)), r"^([a-z]+://[^/?#]*).*$", "$1")


def candidate_pages(companies: DataFrame, postings: DataFrame, links: DataFrame, sitemap: DataFrame, hosts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(company_id, stage, part, seq, url): the pages that may name a company's people, in the order in which they are read.

    companies(company_id, website, domain); postings(company_id, position, url, company_url); links and sitemap
    (company_id, position, url) as the homepage and the sitemap list them; hosts(company_id, host) known subdomains.
    First the postings, then the profiles that postings name, then the company's own site: homepage, its links, usual
    paths, sitemap, subdomains.  Links and sitemap count only on the site's own host and where they speak of people.
    """
    made = lambda rows, stage, part: rows.select("company_id", F.lit(stage).alias("stage"), F.lit(part).alias("part"), "seq", "url")
    jobs = _first(postings.where("url is not null").select("company_id", "position", "url"), JOB_URLS)
    named = postings.where("coalesce(company_url, '') <> ''").groupBy("company_id", F.col("company_url").alias("url")).agg(F.min("position").alias("position"))
    own = companies.where("coalesce(website, '') <> ''").select("company_id", _base(F.col("website")).alias("base"), url.extract_host(F.col("website")).alias("own_host"), "domain")
    home = own.select("company_id", F.lit(1).alias("seq"), F.col("base").alias("url"))

    def inside(rows: DataFrame, n: int) -> DataFrame:
        met = rows.join(own.select("company_id", "own_host"), "company_id").where(url.extract_host(F.col("url")) == F.col("own_host")).where(pages.names_contacts(F.col("url")))
        once = met.groupBy("company_id", F.regexp_replace("url", "#.*$", "").alias("url")).agg(F.min("position").alias("position"))
        return _first(once, n)

    paths = own.select("company_id", "base", F.posexplode(F.array(*map(F.lit, vocab.COMPANY_SITE_PATHS))).alias("seq", "path")).select("company_id", "seq", F.concat("base", "path").alias("url"))
    ranked = hosts.join(own.select("company_id", "domain"), "company_id").withColumn("rank", pages.subdomain_rank(F.col("host"), F.col("domain"))).where("rank is not null")
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("rank", "host"))
    best = ranked.dropDuplicates(["company_id", "host"]).withColumn("k", place).where(F.col("k") <= s.subdomain_max_hosts)
    subs = best.select("company_id", "k", "host", F.posexplode(F.array(*map(F.lit, SUBDOMAIN_PATHS))).alias("i", "path")).select("company_id", (F.col("k") * 10 + F.col("i")).alias("seq"), F.concat(F.lit("https://"), "host", "path").alias("url"))
    parts = [made(jobs, 1, 0), made(_first(named, PROFILE_URLS), 2, 0), made(home, 3, 0), made(inside(links, HOME_LINKS), 3, 1), made(paths, 3, 2), made(inside(sitemap, SITEMAP_PAGES), 3, 3), made(subs, 3, 4)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_order(candidates: DataFrame) -> DataFrame:
    """candidates with page_no, the place in a company's order; a page that an earlier one equals but for its spelling is left out."""
    keyed = candidates.withColumn("key", url.visit_key(F.col("url")))
    firsts = keyed.groupBy("company_id", "key").agg(F.min(F.struct("stage", "part", "seq", "url")).alias("r")).select("company_id", "r.*")
    return firsts.withColumn("page_no", F.row_number().over(Window.partitionBy("company_id").orderBy("stage", "part", "seq", "url")))


def pages_read(ordered: DataFrame, people: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The pages of ``ordered`` that a run reads, and budget_exhausted, from people(company_id, page_no, name, title) on each.

    Reading ends when a stage, or all stages before, have given enough distinct people with a title of the tiers, or
    when the company's budget of pages is spent.
    """
    real = people.where(text.title_tier(F.col("title")).isNotNull() & (F.trim(F.coalesce("name", F.lit(""))) != "")).select("company_id", "page_no", F.lower(F.trim("name")).alias("who"))
    at = real.join(ordered.select("company_id", "page_no", "stage"), ["company_id", "page_no"])
    in_stage = at.groupBy("company_id", "stage", "who").agg(F.min("page_no").alias("page_no")).groupBy("company_id", "stage", "page_no").agg(F.count("*").alias("mine"))
    in_all = at.groupBy("company_id", "who").agg(F.min("page_no").alias("page_no"), F.min("stage").alias("stage")).groupBy("company_id", "stage").agg(F.count("*").alias("here"))
    rows = ordered.join(in_stage, ["company_id", "stage", "page_no"], "left")
    earlier = Window.partitionBy("company_id", "stage").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("mine").over(earlier), F.lit(0)))
    stages = ordered.select("company_id", "stage").distinct().join(in_all, ["company_id", "stage"], "left")
    past = Window.partitionBy("company_id").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(stages.withColumn("past", F.coalesce(F.sum("here").over(past), F.lit(0))).drop("here"), ["company_id", "stage"])
    enough = (F.col("before") >= s.contacts_target) | (F.col("past") >= s.contacts_target)
    stop = rows.where(enough).groupBy("company_id").agg(F.min("page_no").alias("stop"))
    rows = rows.join(stop, "company_id", "left").where(F.col("stop").isNull() | (F.col("page_no") < F.col("stop")))
    spent = F.max("page_no").over(Window.partitionBy("company_id")) > s.contacts_max_pages
    return rows.withColumn("budget_exhausted", spent).where(F.col("page_no") <= s.contacts_max_pages).select(*ordered.columns, "budget_exhausted")


def email_ledger(sightings: DataFrame) -> DataFrame:
    """The first sighting of each address of a company: sightings(company_id, page_no, position, email, url, stage)."""
    first = F.min(F.struct("page_no", "position", "url", "stage")).alias("r")
    return sightings.groupBy("company_id", F.lower(F.trim("email")).alias("email")).agg(first).select("company_id", "email", "r.*")


def size_from_pages(rows: DataFrame) -> DataFrame:
    """(company_id, min, max, source, url, snippet) of the first page that states a head count: rows(company_id, phase, page_no, url, text).

    Phase 0 is the company's main site, 1 its subdomains, which count only where the site says nothing.
    """
    found = rows.withColumn("e", size.size_evidence(F.col("text"))).where("e.snippet is not null")
    first = found.groupBy("company_id").agg(F.min(F.struct("phase", "page_no", "url", "e")).alias("r"))
    source = F.when(F.col("r.phase") == 0, F.lit("PUBLIC_WEB")).otherwise(F.lit("PUBLIC_WEB_SUBDOMAIN"))
    return first.select("company_id", "r.e.min", "r.e.max", source.alias("source"), F.col("r.url").alias("url"), "r.e.snippet")


def company_order(companies: DataFrame) -> DataFrame:
    """companies and seq: the strongest hiring first, then the freshest posting; numbers of a budget's length only matter."""
    order = [-F.coalesce("hiring_intensity", F.lit(0)), F.coalesce("min_age_days", F.lit(99.0)), F.col("company_id")]
    return companies.withColumn("seq", F.struct(order[0].alias("a"), order[1].alias("b"), order[2].alias("c")))


def within_budget(companies: DataFrame, n: int) -> DataFrame:
    """companies and searched: the first n by company_order; a top-k, not a sort of all."""
    ordered = company_order(companies)
    top = ordered.orderBy("seq").limit(n).agg(F.max("seq").alias("last"))  # one row
    return ordered.join(F.broadcast(top)).withColumn("searched", F.coalesce(F.col("seq") <= F.col("last"), F.lit(False))).drop("seq", "last")


def company_emails(contacts: DataFrame, postings: DataFrame, ledger: DataFrame, domains: DataFrame) -> DataFrame:
    """A company's observed addresses: of its people, then on its postings(company_id, ord, emails), then on pages read, in the form of people.discover_emails."""
    from leadloom.operators.people import discover_emails

    of_jobs = postings.select("company_id", F.col("ord").cast("long").alias("ord"), F.posexplode("emails").alias("i", "email"))
    of_jobs = of_jobs.select("company_id", F.struct(F.lit(0).alias("a"), F.col("ord").alias("b"), F.col("i").alias("c")).alias("ord"), "email")
    of_pages = ledger.select("company_id", F.struct(F.lit(1).alias("a"), F.col("page_no").cast("long").alias("b"), F.col("position").cast("int").alias("c")).alias("ord"), "email")
    people = contacts.withColumn("ord", F.struct(F.lit(-1).alias("a"), F.col("ord").cast("long").alias("b"), F.lit(0).alias("c")))
    return discover_emails(people, of_jobs.unionByName(of_pages), domains)


def resolve(companies: DataFrame, source_urls: DataFrame, candidates: DataFrame, stored: DataFrame, now: Column, s: Settings = Settings()) -> DataFrame:
    """(dedup_key, domain, confidence, source, evidence_url, decision, how) of every company whose postings gave no domain.

    companies(dedup_key, name, location, domain, status, hiring_intensity, min_age_days); stored(dedup_key, domain,
    domain_confidence, domain_source, domain_evidence_url, domain_resolved_at) are facts of earlier runs; source_urls
    (dedup_key, position, url) are sites that postings name; candidates(dedup_key, seq, domain, title, body) are what a
    search would have found.  A verified domain young enough is reused; a recent failure is not searched again; the
    rest is resolved from source links, else from the search, whose number a run limits, the most promising first.
    Rejected companies and those with a domain are left alone.  how: CACHED, NEGATIVE_CACHE, RESOLVED, SKIPPED_BUDGET.
    """
    open_ = companies.where("coalesce(domain, '') = '' and coalesce(status, '') <> 'REJECTED'")
    known = open_.join(stored.select("dedup_key", F.struct("domain", "domain_confidence", "domain_source", "domain_evidence_url", "domain_resolved_at").alias("k")), "dedup_key", "left")
    young = dates.within_days(F.col("k.domain_resolved_at"), now, s.domain_cache_days)
    hit = F.coalesce(F.col("k.domain_confidence").isin("HIGH", "MEDIUM") & url.is_employer_domain(F.col("k.domain")) & young, F.lit(False))
    gone = F.coalesce(F.col("k.domain_confidence") == "LOW", F.lit(False)) & dates.within_days(F.col("k.domain_resolved_at"), now, s.domain_negative_days)
    known = known.withColumn("hit", hit).withColumn("gone", ~hit & gone)
    rank = F.when(F.col("status") == "QUALIFIED", 0).when(F.col("status") == "NEEDS_REVIEW", 1).otherwise(2)
    worth = F.struct(rank.alias("a"), (-F.coalesce("hiring_intensity", F.lit(0))).alias("b"), F.coalesce("min_age_days", F.lit(99.0)).alias("c"), F.col("dedup_key").alias("d"))
    asked = known.where("not hit and not gone").withColumn("worth", worth)
    last = asked.orderBy("worth").limit(s.domain_max_per_run).agg(F.max("worth").alias("last"))  # one row
    asked = asked.join(F.broadcast(last)).withColumn("allowed", F.col("worth") <= F.col("last"))
    links = source_urls.withColumn("d", url.normalize_domain(F.col("url"))).where("d <> ''").groupBy("dedup_key").agg(F.min(F.struct("position", "d", "url")).alias("l"))
    tried = candidates.join(asked.where("allowed").select("dedup_key", "name", "location"), "dedup_key").withColumnRenamed("dedup_key", "company_id")
    best = matching.resolve_domains(tried, s.domain_max_candidates).withColumnRenamed("company_id", "dedup_key").select("dedup_key", F.struct("domain", "confidence", "decision").alias("b"))
    rows = asked.join(links, "dedup_key", "left").join(best, "dedup_key", "left")
    none = F.lit(None).cast("string")
    made = lambda domain, confidence, source, link, decision, how: F.struct(domain.alias("domain"), confidence.alias("confidence"), source.alias("source"), link.alias("evidence_url"), decision.alias("decision"), F.lit(how).alias("how"))
    found = (
        F.when(~F.col("allowed"), made(none, none, none, none, none, "SKIPPED_BUDGET"))
        .when(F.col("l").isNotNull(), made(F.col("l.d"), F.lit("HIGH"), F.lit("SOURCE_URL"), F.col("l.url"), F.lit("ACCEPTED"), "RESOLVED"))
        .when(F.col("b").isNull(), made(none, F.lit("LOW"), F.lit("SEARCH"), none, F.lit("UNRESOLVED"), "RESOLVED"))
        .otherwise(made(F.when(F.col("b.decision") != "UNRESOLVED", F.col("b.domain")), F.col("b.confidence"), F.lit("SEARCH"), none, F.col("b.decision"), "RESOLVED"))
    )
    fresh = rows.select("dedup_key", found.alias("f")).select("dedup_key", "f.*")
    reused = known.where("hit").select("dedup_key", made(F.col("k.domain"), F.col("k.domain_confidence"), F.coalesce("k.domain_source", F.lit("CACHE")), F.col("k.domain_evidence_url"), F.lit("ACCEPTED"), "CACHED").alias("f")).select("dedup_key", "f.*")
    silent = known.where("gone").select("dedup_key", made(none, none, none, none, none, "NEGATIVE_CACHE").alias("f")).select("dedup_key", "f.*")
    return fresh.unionByName(reused).unionByName(silent)


def resolution_counts(resolved: DataFrame) -> DataFrame:
    """(outcome, n): cached, resolved, needs_review, unresolved and skipped_budget of a run's domain stage."""
    outcome = (
        F.when(F.col("how") == "CACHED", F.lit("cached")).when(F.col("how") == "SKIPPED_BUDGET", F.lit("skipped_budget")).when(F.col("decision") == "ACCEPTED", F.lit("resolved"))
        .when(F.col("decision") == "REVIEW", F.lit("needs_review")).otherwise(F.lit("unresolved"))
    )
    return resolved.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
