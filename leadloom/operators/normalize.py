"""Raw postings to normalized postings, and the two screens before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import dates, location, text, url
from leadloom.functions.email import extract_emails


def schema_problems(portal: Column | None = None) -> Column:
    """Problem codes of a raw posting in a fixed order; an empty array is a sound row."""
    missing = lambda c, code: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(code))
    found = [missing("source_type", "MISSING_SOURCE_TYPE"), missing("source_site", "MISSING_SOURCE_SITE"), missing("title", "MISSING_TITLE"), missing("application_url", "MISSING_APPLICATION_URL")]
    found.append(F.when(F.col("source_type").isNotNull() & ~F.col("source_type").isin("JOB_BOARD", "ATS"), F.lit("UNKNOWN_SOURCE_TYPE")))
    if portal is not None:
        found.append(F.when(F.col("source_site") != portal, F.lit("SOURCE_SITE_MISMATCH")))
    return F.array_compact(F.array(*found))


def normalize(raw: DataFrame, exact_fold: bool = False) -> DataFrame:
    """One row a row: raw columns and the normalized names, domain, location, date, source ids and screen reason."""
    place = location.normalize_location(F.col("location"), F.col("country"), F.col("is_remote"))
    emails = F.array_distinct(F.concat(F.coalesce(F.col("observed_emails"), F.array().cast("array<string>")), extract_emails(F.col("description"))))
    posted = F.col("posted_at") if dict(raw.dtypes)["posted_at"] == "timestamp" else dates.coerce_timestamp(F.col("posted_at"))
    out = raw.withColumn("observed_emails", emails).withColumn("posted_at", posted).withColumn("place", place)
    domain = url.resolve_domain(F.col("company_website"), F.col("company_url"), F.col("application_url"), F.col("apply_url"), F.col("observed_emails"))
    out = out.withColumn("dom", domain)
    name = text.normalize_company_name(F.col("company_name"), exact_fold)
    out = out.select(
        *(c for c in out.columns if c not in ("place", "dom", "country", "is_remote")),
        F.coalesce(name, F.lit("")).alias("company_name_normalized"),
        F.coalesce(text.normalize_title(F.col("title"), exact_fold), F.lit("")).alias("title_normalized"),
        F.col("dom.domain").alias("domain"),
        F.col("dom.source").alias("domain_source"),
        F.col("place.city").alias("city"),
        F.col("place.state").alias("state"),
        F.col("place.country").alias("country"),
        F.col("place.remote").alias("is_remote"),
        F.col("place.key").alias("location_key"),
        F.to_date("posted_at").alias("posting_date"),
        dates.precision(F.col("posted_at")).alias("date_precision"),
        url.source_ids(F.col("company_url"), F.col("application_url"), F.col("apply_url"), F.col("ats_platform"), F.col("raw")["ats_id"] if "raw" in raw.columns else None).alias("source_ids"),
    )
    reason = F.when(F.col("company_name_normalized") == "", F.lit("NO_COMPANY_NAME")).when(F.coalesce(F.col("country") != "US", F.lit(False)), F.lit("NOT_US"))
    return out.withColumn("screen_reason", reason).withColumn("evidence_url", F.coalesce("application_url", "apply_url"))


def screen(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings in scope, postings screened out with their reason)."""
    return normalized.where("screen_reason is null"), normalized.where("screen_reason is not null")


def freshen(postings: DataFrame, now: Column, max_days: int = 14) -> DataFrame:
    """postings and fresh_keep, age_days, freshness_reason."""
    hours = F.col("provenance.source_date_window_hours") if "provenance" in postings.columns else F.lit(None).cast("int")
    out = postings.withColumn("f", dates.freshness(F.col("posted_at"), now, hours, max_days))
    return out.select(*postings.columns, F.col("f.keep").alias("fresh_keep"), F.col("f.age_days").alias("age_days"), F.col("f.reason").alias("freshness_reason"))


def count_by_reason(rows: DataFrame, reason: str) -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
