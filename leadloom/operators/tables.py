"""Stored tables: keyed merge, orphan removal, latest rows, caches, and the lead document with its exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates


def merge_non_null(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert where null never erases: one full outer join on the keys, nulls in keys meeting nulls.

    Of several new rows with one key the last by ``ord`` wins where new has that column.  Empty strings,
    false and empty arrays do overwrite.
    """
    if "ord" in new.columns:
        w = Window.partitionBy(*keys).orderBy(F.col("ord").desc())
        new = new.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "ord")
    columns = old.columns + [c for c in new.columns if c not in old.columns]
    a, b = old.select(*(F.col(c).alias(f"a_{c}") for c in old.columns), F.lit(True).alias("a__")), new.select(*(F.col(c).alias(f"b_{c}") for c in new.columns))
    on = None
    for k in keys:
        same = F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
        on = same if on is None else on & same
    both = a.join(b, on, "full_outer")
    pick = lambda c: F.coalesce(*([F.col(f"b_{c}")] if c in new.columns else []), *([F.col(f"a_{c}")] if c in old.columns else [])).alias(c)
    return both.select(*map(pick, columns))


def prune_orphans(evidence: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """Evidence whose record still exists; types without a parent table stay, a null record of a known type goes."""
    out = evidence.where(~F.coalesce(F.col("record_type").isin(*parents), F.lit(False)))
    for kind, table in parents.items():
        out = out.unionByName(evidence.where(F.col("record_type") == kind).join(table.select(F.col("id").alias("record_id")), "record_id", "left_semi").select(evidence.columns))
    return out


def latest(rows: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """The newest row of each key; ties go to the greatest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), F.col(tie).desc())
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def cache_hits(wanted: DataFrame, cache: DataFrame, keys: list[str], at: str, now: Column, days: int) -> DataFrame:
    """wanted and hit: whether a cached row of the same key is young enough."""
    newest = cache.groupBy(*keys).agg(F.max(at).alias("__at"))
    return wanted.join(newest, keys, "left").withColumn("hit", dates.within_days(F.col("__at"), now, days)).drop("__at")


def select(rows: DataFrame, columns: list[str] | None = None, filters: dict | None = None, order_by: str | None = None, descending: bool = True, limit: int | None = None, strict: bool = False) -> DataFrame:
    """Rows of a stored table by equality, newest first by default, nulls first as a descending store has them.

    A null in a filter matches nulls.  A column that the table lacks is refused if ``strict``; otherwise a filter on it
    gives no row, and a selected one is null.
    """
    filters = filters or {}
    missing = [c for c in [*(columns or []), *filters, *([order_by] if order_by else [])] if c not in rows.columns]
    if missing and strict:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    for c, value in filters.items():
        rows = rows.where(F.lit(False)) if c in missing else rows.where(F.col(c).eqNullSafe(F.lit(value)))
    if order_by and order_by not in missing:
        rows = rows.orderBy(F.col(order_by).desc_nulls_first() if descending else F.col(order_by).asc_nulls_last())
    rows = rows.limit(limit) if limit is not None else rows
    return rows.select(*(F.col(c) if c not in missing else F.lit(None).alias(c) for c in columns)) if columns else rows


def hiring_history(identified: DataFrame, on: Column) -> DataFrame:
    """A row a company and day: open jobs."""
    return identified.groupBy("company").agg(F.count("*").alias("open_jobs")).withColumn("observed_on", on)


def observed_days(history: DataFrame) -> DataFrame:
    return history.groupBy("company").agg(F.count_distinct("observed_on").alias("persistent_days"))


def _capped(rows: DataFrame, parent: str, order: str, cap: int) -> DataFrame:
    w = Window.partitionBy(parent).orderBy(order)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= cap)


def _nested(rows: DataFrame, parent: str, columns: list[str], name: str, cap: int, order: str = "id") -> DataFrame:
    kept = _capped(rows, parent, order, cap)
    return kept.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", *columns))), lambda s: F.struct(*(s[c].alias(c) for c in columns))).alias(name))


def final_leads(companies: DataFrame, pocs: DataFrame, emails: DataFrame, jobs: DataFrame, evidence: DataFrame, verification: DataFrame, enrichment: DataFrame) -> DataFrame:
    """One nested document a company: children are capped in order of id, gathered once each and joined on the company.

    pocs come from rank_pocs with ``id``; a poc's verification is the newest log of its address.
    """
    none = F.lit(None).cast("string")
    logged = verification if "sub_status" in verification.columns else verification.withColumn("sub_status", none)
    newest = latest(logged.withColumn("e", F.lower("email")), ["company_id", "e"], "created_at", "id").select("company_id", "e", F.col("status").alias("verification_status"), F.col("sub_status").alias("verification_sub_status"), F.col("created_at").cast("string").alias("verified_at"))
    people = pocs.withColumn("e", F.lower("email")).join(newest, ["company_id", "e"], "left")
    for c in ("contact_id", "discovery_stage", "origin", "profile_url"):
        people = people if c in people.columns else people.withColumn(c, none)
    seen = evidence.where("record_type = 'contact' and url is not null").select(F.col("record_id").alias("contact_id"), "url", "id")
    seen = _capped(seen, "contact_id", "id", 50).groupBy("contact_id").agg(F.array_sort(F.collect_set("url")).alias("evidence_urls"))
    people = people.join(seen, "contact_id", "left")
    told = ["poc_rank", "name", "title", "title_priority", "email", "email_class", "verification_status", "verification_sub_status", "verified_at", "source_type", "discovery_stage", "origin", "profile_url", "evidence_urls"]
    nest_pocs = _nested(people, "company_id", told, "pocs", 100, "poc_rank")
    parts = [
        nest_pocs,
        _nested(emails, "company_id", ["email", "email_class"], "emails", 200, "obs_ord"),
        _nested(jobs, "company_id", ["title", "evidence_url", "source_type"], "jobs", 50),
        _nested(evidence.where("record_type = 'company'").withColumnRenamed("record_id", "company_id"), "company_id", ["key", "value", "url"], "evidence", 50),
        _nested(enrichment, "company_id", ["provider", "status", "credit_cost"], "enrichment", 100),
    ]
    out = companies
    for part in parts:
        out = out.join(part, "company_id", "left")
    return out.withColumn("lead_status", lead_status(F.col("pocs")))


def lead_status(pocs: Column) -> Column:
    """READY with a verified personal address of a ranked person, PENDING_VERIFICATION with one that is not settled yet, else NO_VERIFIED_POC_EMAIL.

    pocs is an array of structs with email_class and verification_status; INVALID and RISKY addresses are settled.
    """
    personal = lambda p: p["email"].isNotNull() & (p["email_class"] == "PERSONAL")
    some = lambda test: F.coalesce(F.exists(pocs, lambda p: F.coalesce(personal(p) & test(p["verification_status"]), F.lit(False))), F.lit(False))
    ready, open_ = some(lambda v: v == "VALID"), some(lambda v: v.isNull() | v.isin("PENDING", "UNKNOWN"))
    return F.when(ready, F.lit("READY")).when(open_, F.lit("PENDING_VERIFICATION")).otherwise(F.lit("NO_VERIFIED_POC_EMAIL"))


def lead_status_counts(leads: DataFrame) -> DataFrame:
    """(lead_status, leads) of a run, every status included."""
    every = leads.sparkSession.createDataFrame([(s,) for s in vocab.LEAD_STATUSES], "lead_status string")
    found = leads.groupBy("lead_status").agg(F.count("*").alias("leads"))
    return every.join(found, "lead_status", "left").fillna(0, ["leads"])


def leads_page(leads: DataFrame, status: str | None = None, lead_status: str | None = None, offset: int = 0, limit: int = 500) -> DataFrame:
    """A page of leads by score, null scores first, ties by company; filters apply before the page is cut."""
    if status and status != "ALL":
        leads = leads.where(F.col("qualification_status") == status)
    if lead_status:
        leads = leads.where(F.col("lead_status") == lead_status)
    return leads.orderBy(F.col("qualification_score").desc_nulls_first(), "company_id").offset(offset).limit(min(limit, 500))


def export_rows(leads: DataFrame) -> DataFrame:
    """A row a ranked person, or one for a lead without any; lists joined by '; ', empty ones null."""
    flat = leads.select(*(c for c in leads.columns if c not in ("pocs", "emails", "jobs", "evidence", "enrichment")), F.explode_outer("pocs").alias("p"), "emails", "jobs")
    listed = lambda c: F.nullif(F.array_join(c, "; "), F.lit(""))
    return flat.select(
        "company_id", "display_name", "domain", "qualification_status", "qualification_score", "lead_status",
        F.col("p.poc_rank").alias("poc_rank"), F.col("p.name").alias("poc_name"), F.col("p.title").alias("poc_title"), F.col("p.email").alias("poc_email"),
        F.col("p.email_class").alias("poc_email_class"), F.col("p.verification_status").alias("poc_verification"),
        listed(F.transform("emails", lambda e: e["email"])).alias("company_emails"), listed(F.array_distinct(F.transform("jobs", lambda j: j["title"]))).alias("job_titles"),
    )


#: The columns of the export, in order.
CSV_COLUMNS = [
    "lead_status", "company_name", "domain", "website", "location", "client_industry", "employee_size_min", "employee_size_max", "employee_size_source", "domain_confidence", "domain_source",
    "qualification_status", "qualification_score", "qualification_reasons", "review_flags", "hiring_intensity", "min_applicant_count", "job_titles", "job_evidence_urls", "company_emails",
    "poc_rank", "contact_name", "contact_title", "contact_priority", "contact_email", "email_class", "verification_status", "verification_sub_status", "verified_at", "contact_source_type",
    "contact_discovery_stage", "contact_origin", "contact_evidence_urls", "contact_profile_url",
]


def joined(c: Column) -> Column:
    """A list as text, parts parted by '; '; null for an empty one."""
    return F.nullif(F.array_join(c, "; "), F.lit(""))


def csv_rows(leads: DataFrame) -> DataFrame:
    """The export's columns as text: a row a ranked person, or one for a lead without any.  Facts that leads lack are null."""
    have = lambda c: F.col(c) if c in leads.columns else F.lit(None)
    facts = {c: have(c) for c in CSV_COLUMNS[2:13] + ["hiring_intensity", "min_applicant_count"]} | {
        "lead_status": F.col("lead_status"), "company_name": F.coalesce("display_name", have("normalized_name").cast("string")),
        "qualification_reasons": joined(have("qualification_reasons").cast("array<string>")), "review_flags": joined(have("review_flags").cast("array<string>")),
        "job_titles": joined(F.array_sort(F.array_distinct(F.filter(F.transform("jobs", lambda j: j["title"]), lambda t: F.coalesce(t, F.lit("")) != "")))),
        "job_evidence_urls": joined(F.filter(F.transform("jobs", lambda j: j["evidence_url"]), lambda u: F.coalesce(u, F.lit("")) != "")),
        "company_emails": joined(F.transform(F.filter("emails", lambda e: F.coalesce(e["email"], F.lit("")) != ""), lambda e: F.concat(e["email"], F.lit(" ("), F.coalesce(e["email_class"], F.lit("None")), F.lit(")")))),
    }
    rows = leads.select(*(c.alias(n) for n, c in facts.items()), F.explode_outer("pocs").alias("p"))
    person = {
        "poc_rank": "poc_rank", "contact_name": "name", "contact_title": "title", "contact_priority": "title_priority", "contact_email": "email", "email_class": "email_class", "verification_status": "verification_status",
        "verification_sub_status": "verification_sub_status", "verified_at": "verified_at", "contact_source_type": "source_type", "contact_discovery_stage": "discovery_stage", "contact_origin": "origin", "contact_profile_url": "profile_url",
    }
    out = {n: F.col(n) for n in facts} | {n: F.col(f"p.{c}") for n, c in person.items()} | {"contact_evidence_urls": joined(F.col("p.evidence_urls"))}
    return rows.select(*(out[c].cast("string").alias(c) for c in CSV_COLUMNS))


def export_csv(leads: DataFrame, path: str) -> None:
    csv_rows(leads).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
