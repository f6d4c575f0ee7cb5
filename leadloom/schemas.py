"""Explicit schemas; no table is read by inference."""

from __future__ import annotations

PROVENANCE = "struct<run_key:string,source_id:string,source_class:string,handler:string,portal:string,sector:string,query_title:string,title_origin:string,soc_code:string,geo_code:string,geo_level:string,fetched_at:string,source_date_window_hours:int>"
RAW_JOB = (
    "ord long, source_type string, source_priority int, source_site string, external_id string, title string, company_name string, company_url string, "
    "company_website string, location string, description string, posted_at timestamp, application_url string, apply_url string, ats_platform string, "
    "country string, employment_type string, is_remote boolean, company_industry string, search_industry string, company_employee_count string, "
    "company_revenue string, company_addresses string, applicant_count int, observed_emails array<string>, raw map<string,string>, provenance " + PROVENANCE
)
ATS_SLICE = "global_id string, ats_id string, url string, apply_url string, title string, company string, ats_type string, location string, country_iso string, is_remote boolean, employment_type string, description string, posted_at string"
PAGES = "url string, status int, html string, engine string, blocked boolean, error string"
SOURCE_OUTCOMES = "ord long, source string, query string, location_scope string, pages long, offset long, jobs_returned long, jobs_accepted long, duplicates long, stop_reason string, error_type string, error_message string, runtime_seconds double"
CONTACTS = "ord long, company_id string, name string, title string, email string, source_type string, discovery_stage int, rank_score double, origin string"
PROVIDER_CONTACTS = "seq long, company_id string, provider string, name string, title string, email string, profile_url string, person_id string"
SEARCH_TERMS = "tier string, client_industry string, soc_code string, soc_major string, soc_title string, search_term string, rank int"
NAICS_TITLES = "naics_code string, naics_title string, client_industry string"

#: Natural keys of the stored tables; the other three are append-only.
TABLE_KEYS = {
    "companies": ["normalized_domain", "normalized_name"],
    "jobs": ["company_id", "source_type", "source_site", "external_id"],
    "contacts": ["company_id", "name", "title"],
    "company_hiring_history": ["company_id", "observed_on"],
}
TABLES = [*TABLE_KEYS, "evidence", "qualification_reasons", "enrichment_logs", "email_verification_logs", "discovery_runs", "audit_logs"]
