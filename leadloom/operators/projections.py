"""What a run stores: rows of the ten tables, made from the stages' results.

Identifiers are hashes of natural keys, so a stage that runs again makes the same rows.  Nothing is stored without
the stage that decided it; facts that are not known stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DESCRIPTION_CHARS = 20_000
#: How near a source of evidence is; 3 is the public web, 4 a paid provider.
PUBLIC_WEB, PAID = 3, 4


def key_id(*parts: Column) -> Column:
    """A stable identifier of a natural key; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def company_id(domain: Column, identity_key: Column, name: Column) -> Column:
    """The identifier of a company by its domain and name, or by its identity key without a domain."""
    return F.when(F.coalesce(domain, F.lit("")) != "", key_id(domain, F.coalesce(F.nullif(name, F.lit("")), F.lit("NO_NAME")))).otherwise(key_id(F.lit("NO_DOMAIN"), identity_key))


def discarded_rows(postings: DataFrame, stage: str, reason: str) -> DataFrame:
    """A qualification_reasons row for each posting that a stage set aside, and its counter ``STAGE:REASON``.

    The counter takes a reason up to its first colon.  details is JSON of what tells the posting.
    """
    known = {"company": "company_name", "title": "title", "url": "evidence_url", "source_site": "source_site", "posting_date": "posting_date"}
    details = F.to_json(F.struct(*(F.col(c).cast("string").alias(k) for k, c in known.items() if c in postings.columns)))
    rows = postings.where(F.col(reason).isNotNull())
    return rows.select("ord", F.lit(stage).alias("stage"), F.col(reason).alias("reason"), F.concat(F.lit(f"{stage}:"), F.substring_index(reason, ":", 1)).alias("counter"), details.alias("details"))


def reason_rows(judged: DataFrame) -> DataFrame:
    """(company_id, position, stage, reason, outcome): every reason behind a verdict, rejections before open questions."""
    tagged = lambda c, outcome: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda r: F.struct(r.alias("reason"), F.lit(outcome).alias("outcome")))
    rows = judged.select("company_id", F.posexplode(F.concat(tagged("reasons", "REJECTED"), tagged("review_flags", "NEEDS_REVIEW"))).alias("position", "r"))
    return rows.select("company_id", "position", F.lit("QUALIFICATION").alias("stage"), "r.reason", "r.outcome")


def company_rows(judged: DataFrame, resolved: DataFrame | None, now: Column) -> DataFrame:
    """The companies table from judged companies and resolved(dedup_key, domain, confidence, source, evidence_url, decision).

    The natural key keeps the domain that postings gave; a resolved one is a fact beside it.  A search that failed is
    kept as LOW with its time, so that it is not repeated soon, and never as a domain.
    """
    rows = judged
    if resolved is None:
        rows = rows.withColumn("found", F.lit(None).cast("struct<domain:string,confidence:string,source:string,evidence_url:string,decision:string>"))
    else:
        rows = rows.join(resolved.select("dedup_key", F.struct("domain", "confidence", "source", "evidence_url", "decision").alias("found")), "dedup_key", "left")
    taken, failed = F.col("found.decision") == "ACCEPTED", F.col("found.decision") == "UNRESOLVED"
    agency = F.col("agency_evidence").isNotNull()
    domain = F.nullif(F.col("domain"), F.lit(""))
    return rows.select(
        "company_id", "dedup_key", F.coalesce(F.nullif("company_name_normalized", F.lit("")), F.lit("NO_NAME")).alias("normalized_name"),
        F.coalesce(domain, F.lit("NO_DOMAIN")).alias("normalized_domain"), "identity_basis", "identity_key", F.col("company_name").alias("display_name"),
        F.coalesce(F.when(taken, F.col("found.domain")), domain).alias("domain"), F.when(taken, F.col("found.confidence")).when(failed, F.lit("LOW")).alias("domain_confidence"),
        F.when(taken, F.col("found.source")).when(failed, F.lit("SEARCH")).alias("domain_source"), F.when(taken, F.col("found.evidence_url")).alias("domain_evidence_url"),
        F.when(taken | failed, now).alias("domain_resolved_at"), _have(rows, "company_website").alias("website"), "location", F.col("status").alias("qualification_status"),
        F.col("score").alias("qualification_score"), F.col("reasons").alias("qualification_reasons"), "review_flags", "hiring_intensity", "min_applicant_count", "source_priority",
        F.col("company_industry").alias("industry"), "client_industry", F.when(F.col("industry_state") == "OBSERVED", F.lit("OBSERVED")).alias("industry_source"),
        F.col("size_min").alias("employee_size_min"), F.col("size_max").alias("employee_size_max"), F.col("size_source").alias("employee_size_source"),
        F.coalesce("ta_role_count", F.lit(0)).alias("internal_ta_size"), F.when(F.col("ta_verdict") == "MATURE", F.lit("MATURE")).otherwise(F.lit("OK")).alias("internal_ta_verdict"),
        agency.alias("is_staffing_agency"), (~agency).alias("is_direct_employer"), F.to_json(F.struct("source_sites", "source_ids")).alias("raw_payload"), now.alias("last_seen_at"),
    )


def _have(rows: DataFrame, c: str, kind: str = "string") -> Column:
    return F.col(c) if c in rows.columns else F.lit(None).cast(kind)


def job_rows(identified: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The jobs table: fresh postings with their company's identifier; a posting without an id is known by its link."""
    rows = identified.join(ids.select("company", "company_id"), "company")
    external = F.coalesce(F.nullif("external_id", F.lit("")), "application_url")
    return rows.select(
        key_id(F.col("company_id"), F.col("source_type"), F.col("source_site"), external).alias("job_id"), "company_id", "ord", external.alias("external_id"), "title", "title_normalized",
        "location", "location_key", "state", F.nullif(F.substring("description", 1, DESCRIPTION_CHARS), F.lit("")).alias("description"), "posting_date", "posted_at", "date_precision",
        F.round("age_days", 3).alias("age_days"), "application_url", "evidence_url", _have(rows, "ats_platform").alias("ats_platform"), F.col("fresh_keep").alias("is_fresh"), "freshness_reason",
        "applicant_count", "source_type", "source_site", "source_priority", now.alias("last_seen_at"),
    )


def posting_evidence(jobs: DataFrame) -> DataFrame:
    """An evidence row for each dated posting."""
    return jobs.where("posting_date is not null").select(F.lit("JOB").alias("record_type"), F.col("job_id").alias("record_id"), F.lit("posting_date").alias("key"), F.col("posting_date").cast("string").alias("value"), F.col("evidence_url").alias("url"), "source_type", "source_priority")


def size_evidence_rows(evidence: DataFrame) -> DataFrame:
    """An evidence row for each company whose size a page stated: evidence(company_id, min, max, source, url)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return evidence.where("url is not null").select(F.lit("COMPANY").alias("record_type"), F.col("company_id").alias("record_id"), F.lit("employee_size").alias("key"), F.concat(text("min"), F.lit("-"), text("max")).alias("value"), "url", F.col("source").alias("source_type"), F.lit(PUBLIC_WEB).alias("source_priority"))


def history_rows(companies: DataFrame, on: Column) -> DataFrame:
    """The hiring history's row of a day for each company."""
    return companies.select("company_id", on.alias("observed_on"), F.col("hiring_intensity").alias("open_jobs"), F.col("hiring_intensity").alias("fresh_jobs"))


def persistent_runs(companies: DataFrame, history: DataFrame) -> DataFrame:
    """companies and persistent_hiring_runs: the distinct days on which each was seen hiring, null without any."""
    days = history.groupBy("company_id").agg(F.count_distinct("observed_on").alias("persistent_hiring_runs"))
    return companies.drop("persistent_hiring_runs").join(days, "company_id", "left")


def lead_rows(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """A lead for each company that is not rejected: its site, freshest job and first evidence, in the order of its postings."""
    link = F.col("evidence_url").isNotNull()
    seen = jobs.groupBy("company_id").agg(F.count("*").alias("job_count"), F.min("age_days").alias("freshest_job_age_days"), F.min_by("evidence_url", F.when(link, F.col("ord"))).alias("evidence_url"), F.array_sort(F.collect_set("source_site")).alias("source_sites"))
    rows = companies.where("qualification_status <> 'REJECTED'").join(seen, "company_id", "left")
    site = F.coalesce(F.nullif("website", F.lit("")), F.when(F.col("domain").isNotNull(), F.concat(F.lit("https://"), "domain")))
    lo, hi = F.col("employee_size_min").cast("string"), F.col("employee_size_max").cast("string")
    size = F.when(lo.isNotNull() & hi.isNotNull(), F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit("-"), hi))).when(lo.isNotNull(), F.concat(lo, F.lit("+"))).when(hi.isNotNull(), F.concat(F.lit("<"), hi))
    return rows.select(
        "company_id", "normalized_name", "display_name", "domain", site.alias("website"), "location", F.col("qualification_status").alias("status"), F.col("qualification_score").alias("score"), "job_count",
        "freshest_job_age_days", "client_industry", "industry_source", size.alias("employee_size"), "employee_size_source", F.col("min_applicant_count").alias("applicant_count"), "review_flags", "evidence_url", "source_sites",
    )


def contact_rows(selected: DataFrame) -> DataFrame:
    """The contacts table from selected people(company_id, name, title, title_priority, email, rank_score, discovery_stage, profile_url, source_type, source_priority, url, extraction)."""
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))
    return selected.select(
        key_id(F.col("company_id"), F.col("name"), F.col("title")).alias("contact_id"), "company_id", "name", "title", "title_priority", "email", "rank_score", "discovery_stage", "profile_url",
        "source_type", "source_priority", host.alias("source"), F.col("url").alias("source_url"), "extraction", F.lit("PUBLIC").alias("origin"),
    )


def contact_evidence(contacts: DataFrame) -> DataFrame:
    """An evidence row for each stored contact: ``name | title`` and where it was seen."""
    value = F.concat(F.coalesce("name", F.lit("None")), F.lit(" | "), F.coalesce("title", F.lit("None")))
    return contacts.select(F.lit("CONTACT").alias("record_type"), F.col("contact_id").alias("record_id"), F.lit("contact").alias("key"), value.alias("value"), F.col("source_url").alias("url"), "source_type", "source_priority")


def email_evidence(observed: DataFrame) -> DataFrame:
    """An evidence row for each observed address(company_id, email, email_class, evidence_url, source_type); one provider's are paid, the rest public."""
    rank = F.when(F.col("source_type") == "ZOOMINFO", PAID).otherwise(PUBLIC_WEB)
    return observed.select(F.lit("COMPANY").alias("record_type"), F.col("company_id").alias("record_id"), F.lit("company_email").alias("key"), F.col("email").alias("value"), F.col("evidence_url").alias("url"), "source_type", rank.alias("source_priority"), F.to_json(F.struct(F.col("email_class").alias("email_type"))).alias("raw_payload"))


def provenance_evidence(contacts: DataFrame) -> DataFrame:
    """An evidence row for each field that a provider newly supplied: contacts(contact_id, fields map<field, struct<provider, value, evidence_url>>)."""
    rows = contacts.select("contact_id", F.explode("fields").alias("field", "s"))
    return rows.select(F.lit("CONTACT").alias("record_type"), F.col("contact_id").alias("record_id"), F.concat(F.lower("s.provider"), F.lit("_"), "field").alias("key"), F.col("s.value").alias("value"), F.col("s.evidence_url").alias("url"), F.col("s.provider").alias("source_type"), F.lit(PAID).alias("source_priority"))


def merge_provenance(old: Column, new: Column) -> Column:
    """A map of field to source where what is newly supplied takes the place of what was known."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def strip_nulls(c: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(c, lambda _, v: v.isNotNull())


def with_duplicates(kept: DataFrame, duplicates: DataFrame, postings: DataFrame) -> DataFrame:
    """kept postings and ``duplicates``: what was dropped for each, in order, as structs of site, id and link.

    Copies of one opening are few, but one that is copied without end would make one array; so only the first
    hundred are listed, and n_duplicates counts all of them.
    """
    told = duplicates.join(postings.select(F.col("ord").alias("dup_ord"), "source_site", "external_id", "application_url"), "dup_ord")
    place = F.row_number().over(Window.partitionBy("kept_ord").orderBy("dup_ord"))
    first = told.withColumn("k", place).where("k <= 100").groupBy("kept_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "reason", "source_site", "external_id", "application_url"))), lambda s: F.struct(s["reason"].alias("reason"), s["source_site"].alias("source_site"), s["external_id"].alias("external_id"), s["application_url"].alias("application_url"))).alias("duplicates"))
    n = duplicates.groupBy("kept_ord").agg(F.count("*").alias("n_duplicates"))
    out = kept.join(first.join(n, "kept_ord").withColumnRenamed("kept_ord", "ord"), "ord", "left")
    return out.fillna(0, ["n_duplicates"])


def report(counts: dict[str, DataFrame]) -> DataFrame:
    """One row of JSON: the counters of each stage, from frames of (reason, n)."""
    out = None
    for stage, rows in counts.items():
        one = rows.select(F.lit(stage).alias("stage"), F.col(rows.columns[0]).cast("string").alias("reason"), F.col(rows.columns[1]).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    by = out.groupBy("stage").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("counts"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("stage", "counts"))), lambda p: F.concat(F.lit('"'), p["stage"], F.lit('":'), p["counts"]))
    return by.agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("report"))  # a handful of stages


def audit_rows(counts: DataFrame, stage: str, at: Column) -> DataFrame:
    """An audit_logs row for each counter(reason, n) of a stage."""
    return counts.select(F.lit(stage).alias("stage"), F.col(counts.columns[0]).alias("event"), F.col(counts.columns[1]).cast("long").alias("n"), at.alias("at"))
