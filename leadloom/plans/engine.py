"""The engine: plan, run, leads and export as one object over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import schemas, vocab
from leadloom.functions import email, pages, text
from leadloom.operators import coverage, dedupe, discovery, enrichment, identity, normalize, people, projections, qualify, tables, taxonomy
from leadloom.scratch import Scratch
from leadloom.sources import html
from leadloom.vocab import Settings

STOPS = ("after_normalize", "after_dedupe", "after_freshness", "after_identity", "after_qualify")


@dataclass
class Run:
    """What a run has made: kept rows by stage and what each stage set aside."""

    stages: dict[str, DataFrame] = field(default_factory=dict)
    screened: DataFrame | None = None
    duplicates: DataFrame | None = None
    stale: DataFrame | None = None
    conflicts: DataFrame | None = None

    def metrics(self) -> dict[str, int]:
        """Rows of every stage, counted now."""
        named = self.stages | {"screened": self.screened, "duplicates": self.duplicates, "stale": self.stale}
        return {k: v.count() for k, v in named.items() if v is not None}


@dataclass
class Recorded:
    """Recorded answers that the stages after qualification read; what is None is empty.

    pages(url, html) hold bodies that could be read; links and sitemap(company_id, position, url) and hosts(company_id,
    host) what sites list; candidates(dedup_key, seq, domain, title, body) a search's results; stored as
    discovery.resolve takes it; outcomes, provided and calls as enrichment.waterfall takes them; answers(email, code,
    timed_out, error, provider_status) and checked(email, status, checked_at) of the verifier, now and before.
    """

    pages: DataFrame | None = None
    links: DataFrame | None = None
    sitemap: DataFrame | None = None
    hosts: DataFrame | None = None
    candidates: DataFrame | None = None
    stored: DataFrame | None = None
    outcomes: DataFrame | None = None
    provided: DataFrame | None = None
    calls: DataFrame | None = None
    answers: DataFrame | None = None
    checked: DataFrame | None = None


#: Schemas of what a Recorded may hold.
RECORDED = {
    "pages": "url string, html string", "links": "company_id string, position int, url string", "sitemap": "company_id string, position int, url string", "hosts": "company_id string, host string",
    "candidates": "dedup_key string, seq int, domain string, title string, body string",
    "stored": "dedup_key string, domain string, domain_confidence string, domain_source string, domain_evidence_url string, domain_resolved_at timestamp",
    "outcomes": enrichment.OUTCOMES, "provided": enrichment.PROVIDED, "calls": "company_id string, provider string, created_at timestamp",
    "answers": "email string, code int, timed_out boolean, error string, provider_status string", "checked": "email string, status string, checked_at timestamp",
}
PROVIDERS = [enrichment.Provider("ZOOMINFO"), enrichment.Provider("APOLLO"), enrichment.Provider("APIFY", 5, None)]


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings = Settings(), terms: DataFrame | None = None):
        self.spark, self.settings, self.terms = spark, settings, terms

    def sectors(self) -> list[str]:
        return list(vocab.SECTORS)

    def plan(self, sector: str, job: str) -> DataFrame:
        terms = self.terms if self.terms is not None else self.spark.createDataFrame([], schemas.SEARCH_TERMS)
        return taxonomy.plan(self.spark, sector, job, terms, self.settings.title_variants)

    def run(self, raw: DataFrame, now: Column, stop_at: str | None = None, size_evidence: DataFrame | None = None, history: DataFrame | None = None, industries: DataFrame | None = None) -> Run:
        """Raw postings to qualified companies, in the fixed order of stages; ``stop_at`` leaves the rest out.

        size_evidence(dedup_key, min, max, source), history(company, persistent_days) and industries(label, sector)
        are optional facts; without a sector of its observed label a company's industry is unknown.
        """
        if stop_at is not None and stop_at not in STOPS:
            raise ValueError(f"stop_at is one of {STOPS}")
        out, scratch = Run(), Scratch(self.spark, "run")
        out.stages["normalized"], out.screened = normalize.screen(scratch.save(normalize.normalize(raw), "normalized"))
        if stop_at == "after_normalize":
            return out
        out.stages["kept"], out.duplicates = dedupe.dedupe(out.stages["normalized"], scratch)
        if stop_at == "after_dedupe":
            return out
        aged = normalize.freshen(out.stages["kept"], now, self.settings.freshness_max_days)
        out.stages["fresh"], out.stale = aged.where("fresh_keep"), aged.where("not fresh_keep")
        if stop_at == "after_freshness":
            return out
        rows, out.conflicts = identity.identify(out.stages["fresh"], scratch)
        out.stages["identified"] = rows = scratch.save(rows, "identified")
        companies = identity.companies(rows)
        if stop_at == "after_identity":
            out.stages["companies"] = companies
            return out
        facts = companies.join(qualify.hiring_signals(rows), "company", "left")
        if history is not None:
            facts = facts.join(history, "company", "left")
        observed = F.coalesce(F.col("company_industry"), F.lit("")) != ""
        facts = facts.withColumn("industry_state", F.when(observed, F.lit("OBSERVED")).otherwise(F.lit("UNKNOWN")))
        if industries is not None:
            facts = facts.join(industries.select(F.col("label").alias("company_industry"), F.col("sector").alias("client_industry")), "company_industry", "left")
        else:
            facts = facts.withColumn("client_industry", F.when(F.col("company_industry").isin(vocab.SECTORS), F.col("company_industry")))
        judged = qualify.qualify(qualify.profile(facts), self.settings)
        if size_evidence is not None:
            judged = qualify.second_pass(judged, size_evidence, self.settings)
        out.stages["qualified"] = judged
        return out

    def complete(self, run: Run, now: Column, recorded: Recorded = Recorded(), providers: list[enrichment.Provider] | None = None) -> Run:
        """A run's qualified companies to leads: domains, stored rows, people, addresses, enrichment, verification.

        Only QUALIFIED companies are searched for people, enriched and verified, within the run's budgets; the others
        keep their rows.  Adds to ``stages``: resolved, companies, jobs, reasons, contacts, emails, attempts,
        verified, evidence, leads and final.
        """
        scratch, s = Scratch(self.spark, "complete"), self.settings
        known = lambda name: getattr(recorded, name) if getattr(recorded, name) is not None else self.spark.createDataFrame([], RECORDED[name])
        judged = run.stages["qualified"].withColumn("company_id", projections.company_id(F.col("domain"), F.col("identity_key"), F.col("company_name_normalized")))
        judged = scratch.save(judged, "judged")
        ids = judged.select("company", "company_id", "dedup_key", "status")
        rows = run.stages["identified"]
        sites = rows.where("coalesce(company_website, '') <> ''").join(ids.select("company", "dedup_key"), "company").select("dedup_key", F.col("ord").alias("position"), F.col("company_website").alias("url"))
        asked = judged.select("dedup_key", F.coalesce("company_name", "company_name_normalized").alias("name"), "location", "domain", "status", "hiring_intensity", "min_age_days")
        run.stages["resolved"] = resolved = scratch.save(discovery.resolve(asked, sites, known("candidates"), known("stored"), now, s), "resolved")
        website = rows.where("coalesce(company_website, '') <> ''").groupBy("company").agg(F.min_by("company_website", "ord").alias("company_website"))
        run.stages["companies"] = companies = scratch.save(projections.company_rows(judged.join(website, "company", "left"), resolved, now), "companies")
        run.stages["jobs"] = jobs = scratch.save(projections.job_rows(rows, ids, now), "jobs")
        run.stages["reasons"] = projections.reason_rows(judged)
        run.stages["leads"] = leads = scratch.save(projections.lead_rows(companies, jobs), "leads")
        accepted = leads.where("status = 'QUALIFIED'").join(judged.select("company_id", "hiring_intensity", "min_age_days"), "company_id")
        chosen = discovery.within_budget(accepted, s.contacts_max_companies).where("searched")
        run.stages["contacts"], sightings = self._people(chosen, rows, jobs, ids, known, scratch)
        contacts = run.stages["contacts"]
        domains = leads.select("company_id", "domain")
        posted = rows.join(ids.select("company", "company_id"), "company").join(chosen.select("company_id"), "company_id", "left_semi").select("company_id", "ord", F.col("observed_emails").alias("emails"))
        run.stages["emails"] = seen = scratch.save(discovery.company_emails(contacts.withColumn("ord", F.col("place")), posted, discovery.email_ledger(sightings), domains), "emails")
        order = discovery.company_order(accepted).select("company_id", "domain", "seq")
        have = contacts.select("company_id", F.col("place").cast("long").alias("ord"), "contact_id", "name", "title", "title_priority", "email", "profile_url", "rank_score", "source_type", "origin")
        found, run.stages["attempts"], more = enrichment.waterfall(order, have, known("outcomes"), known("provided"), PROVIDERS if providers is None else providers, now, scratch, s, known("calls"))
        found = found.withColumn("contact_id", F.coalesce("contact_id", projections.key_id(F.col("company_id"), F.col("name"), F.col("title"))))
        extra = more.select("company_id", F.monotonically_increasing_id().alias("ord"), "email")
        later = people.discover_emails(found.select("company_id", "ord", "email", "name", "title"), extra, domains)
        run.stages["emails"] = seen = scratch.save(seen.unionByName(people.only_new(later, seen).select(seen.columns)), "all-emails")
        classed = found.join(domains, "company_id").withColumn("email_class", email.classify_email(F.lower("email"), F.col("domain"))).join(order.select("company_id", F.col("seq").alias("turn")), "company_id")
        to_check = classed.select(F.struct("turn", "ord").alias("seq"), "company_id", "contact_id", "email", "email_class")
        run.stages["verified"] = checked = scratch.save(people.verify(to_check, known("checked"), known("answers"), now, s), "verified")
        logs = checked.where("status is not null").select(F.xxhash64("contact_id").alias("id"), "company_id", "email", "status", now.alias("created_at"))
        pocs = people.rank_pocs(found.join(contacts.select("company_id", F.col("place").cast("long").alias("ord"), "discovery_stage"), ["company_id", "ord"], "left").select("company_id", "ord", "contact_id", "name", "title", "email", "source_type", "rank_score", "discovery_stage", "origin", "profile_url"), domains)
        jobs_ = jobs.select(F.col("ord").alias("id"), "company_id", "title", "evidence_url", "source_type")
        proof = projections.posting_evidence(jobs).unionByName(projections.contact_evidence(contacts)).unionByName(projections.email_evidence(seen.withColumn("evidence_url", F.lit(None).cast("string")).withColumn("source_type", F.lit("PUBLIC_WEB"))).drop("raw_payload"))
        run.stages["evidence"] = proof = proof.unionByName(projections.provenance_evidence(found.select("contact_id", "fields")))
        listed = proof.withColumn("id", projections.key_id(F.col("record_id"), F.col("key"), F.col("value"))).withColumn("record_type", F.lower("record_type"))
        spent = run.stages["attempts"].select(F.col("step").alias("id"), "company_id", "provider", "status", F.col("credits").alias("credit_cost"))
        head = companies.select("company_id", "display_name", "domain", "website", "location", "client_industry", "employee_size_min", "employee_size_max", "employee_size_source", "domain_confidence", "domain_source", "qualification_status", "qualification_score", "qualification_reasons", "review_flags", "hiring_intensity", "min_applicant_count")
        run.stages["final"] = tables.final_leads(head, pocs, seen, jobs_, listed, logs, spent)
        return run

    def _people(self, chosen: DataFrame, rows: DataFrame, jobs: DataFrame, ids: DataFrame, known, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """(stored people, sightings of addresses) of the companies chosen, from the pages that a run reads."""
        s = self.settings
        posted = jobs.join(chosen.select("company_id"), "company_id", "left_semi").join(rows.select("ord", "company_url"), "ord").select("company_id", F.col("ord").alias("position"), F.col("evidence_url").alias("url"), "company_url")
        order = discovery.read_order(discovery.candidate_pages(chosen.select("company_id", "website", "domain"), posted, known("links"), known("sitemap"), known("hosts"), s))
        told = scratch.save(order.join(known("pages"), "url"), "pages")
        told = told.withColumn("k", F.concat_ws("\u0001", "company_id", F.col("page_no").cast("string")))
        seen = html.contacts_of_pages(told.select("k", "html"), "k").join(told.drop("html"), "k")
        seen = seen.where((F.col("method") != "TEXT") | ((F.col("stage") == 3) & pages.is_people_page(F.col("url"))))
        seen = scratch.save(seen, "people")
        read = scratch.save(discovery.pages_read(told.drop("html", "k"), seen, s), "read")
        seen = seen.join(read.select("company_id", "page_no"), ["company_id", "page_no"], "left_semi")
        titles = jobs.select("company_id", "title")
        wanted = people.hiring_priority(titles, "company_id")
        made = seen.join(wanted, "company_id", "left").withColumn("source", pages.source_of_url(F.col("url")))
        confidence = people.contact_confidence(F.col("method"), F.col("title").isNotNull(), F.col("priority"), F.col("email").isNotNull())
        made = made.withColumn("rank_score", people.contact_score(F.col("priority"), F.col("hiring_priority"), confidence, F.col("email").isNotNull(), F.col("stage")))
        made = made.select("company_id", "name", "title", "email", "profile_url", "rank_score", F.col("stage").alias("discovery_stage"), "url", F.lower("method").alias("extraction"), "source.source_type", "source.source_priority", (F.col("page_no") * 10_000 + F.col("position")).alias("ord"))
        best = people.select_contacts(made, s.contacts_max).withColumn("title_priority", text.title_tier(F.col("title")))
        stored = scratch.save(projections.contact_rows(best).join(best.select("company_id", "name", "title", F.col("ord").alias("place")), ["company_id", "name", "title"]), "contacts")
        mails = html.emails_of_pages(told.join(read.select("company_id", "page_no"), ["company_id", "page_no"], "left_semi").select("k", "html"), "k").join(told.drop("html"), "k")
        return stored, mails.select("company_id", "page_no", "position", "email", "url", "stage")

    def sources(self, registry) -> DataFrame:
        """(portal, enabled) of a registry's sources in order."""
        named = [(place, portal, portal not in registry.disabled) for place, portal in enumerate(registry.sources)]
        return self.spark.createDataFrame(named, "place int, portal string, enabled boolean")

    def report(self, run: Run) -> DataFrame:
        """One row of JSON: what each stage kept, set aside and spent."""
        counts = {}
        if run.screened is not None:
            counts["NORMALIZE"] = normalize.count_by_reason(run.screened, "screen_reason")
        if run.duplicates is not None:
            counts["DEDUPE"] = normalize.count_by_reason(run.duplicates, "reason")
        if run.stale is not None:
            counts["FRESHNESS"] = normalize.count_by_reason(run.stale, "freshness_reason")
        if "qualified" in run.stages:
            counts["QUALIFICATION"] = run.stages["qualified"].groupBy("status").agg(F.count("*").alias("n"))
        if "attempts" in run.stages:
            spent = coverage.credits_by_provider(run.stages["attempts"])
            counts["ENRICHMENT"] = spent.select("provider", F.col("attempts").alias("n"))
        if "final" in run.stages:
            counts["LEADS"] = tables.lead_status_counts(run.stages["final"].where("qualification_status = 'QUALIFIED'"))
        return projections.report(counts)

    def company_emails(self, run: Run, company_id: str) -> DataFrame:
        """A company's observed addresses."""
        return run.stages["emails"].where(F.col("company_id") == company_id)

    def persist(self, run: Run, base: str, dry_run: bool = False) -> dict[str, int]:
        """Merge a completed run's rows into the stored tables; rows by table.  A dry run only counts.

        Keyed tables get a new version each, in which nulls never erase; evidence and reasons are appended.
        """
        of = {"companies": "companies", "jobs": "jobs", "contacts": "contacts", "evidence": "evidence", "qualification_reasons": "reasons", "enrichment_logs": "attempts", "email_verification_logs": "verified"}
        counts = {}
        for name, stage in of.items():
            rows = run.stages.get(stage)
            if rows is None:
                continue
            counts[name] = rows.count()
            if dry_run:
                continue
            rows = rows.drop("seq", "dedup_key")
            if name in schemas.TABLE_KEYS:
                keys = schemas.TABLE_KEYS[name]
                last = self._last_version(f"{base}/{name}")
                old = self.spark.read.parquet(f"{base}/{name}/v={last}") if last >= 0 else rows.limit(0)
                newest = rows.dropDuplicates(keys)
                tables.merge_non_null(old, newest.drop("ord"), keys).write.mode("overwrite").parquet(f"{base}/{name}/v={last + 1}")
            else:
                rows.write.mode("append").parquet(f"{base}/{name}")
        return counts

    def _last_version(self, path: str) -> int:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or []
        return max((int(f.getPath().getName().partition("=")[2]) for f in found), default=-1)

    def stored(self, base: str, name: str) -> DataFrame:
        """A stored table's newest state."""
        last = self._last_version(f"{base}/{name}")
        return self.spark.read.parquet(f"{base}/{name}/v={last}" if last >= 0 else f"{base}/{name}")

    def create_tables(self, base: str) -> None:
        """An empty table for each stored kind that isn't there yet."""
        for name, keys in schemas.TABLE_KEYS.items():
            self.spark.createDataFrame([], ", ".join(f"{k} string" for k in keys)).write.mode("ignore").parquet(f"{base}/{name}")

    def health(self, base: str) -> dict[str, bool]:
        out = {}
        for name in schemas.TABLES:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
            out[name] = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return out

    def export_csv(self, leads: DataFrame, path: str, status: str = "QUALIFIED", lead_status: str | None = None) -> None:
        rows = leads if status == "ALL" else leads.where(F.col("qualification_status") == status)
        tables.export_csv(rows if lead_status is None else rows.where(F.col("lead_status") == lead_status), path)
