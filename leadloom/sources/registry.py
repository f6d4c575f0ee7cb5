"""Sources as functions from a session to raw postings, and their ordered union.

A source reads recorded rows; limits, validation and first-sighting rules are DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates, location
from leadloom.operators.coverage import first_seen
from leadloom.operators.normalize import schema_problems
from leadloom.schemas import ATS_SLICE, RAW_JOB

Source = Callable[[SparkSession], DataFrame]


@dataclass
class Registry:
    """Enabled sources in order of registration."""

    sources: dict[str, Source] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def register(self, portal: str, source: Source) -> None:
        self.sources[portal] = source

    def unknown_disabled(self) -> list[str]:
        return sorted(self.disabled - set(self.sources))

    def run(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(sound postings, rejected postings with their problems); ``ord`` follows registration, then the source's own order."""
        rows = None
        for place, (portal, source) in enumerate(self.sources.items()):
            if portal in self.disabled:
                continue
            one = source(spark).withColumn("ord", F.lit(place * 10**15) + F.coalesce("ord", F.lit(0))).withColumn("problems", schema_problems(F.lit(portal)))
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        if rows is None:
            rows = spark.createDataFrame([], RAW_JOB + ", problems array<string>")
        return first_seen(rows.where(F.size("problems") == 0).drop("problems")), rows.where(F.size("problems") > 0)


def coalesce_aliases(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their names here, from the first of their aliases that is there and not empty."""
    out = []
    for name, options in aliases.items():
        have = [F.nullif(F.col(o).cast("string"), F.lit("")) for o in options if o in rows.columns]
        out.append((F.coalesce(*have) if have else F.lit(None).cast("string")).alias(name))
    return rows.select(*out)


#: Names that sources use for raw-job fields.
ALIASES = {
    "source_site": ["source_site", "site"], "title": ["title", "job_title"], "company_name": ["company_name", "company"], "company_url": ["company_url"],
    "company_website": ["company_website", "company_url_direct"], "location": ["location"], "description": ["description"], "posted_at": ["posted_at", "date_posted"],
    "application_url": ["application_url", "job_url_direct", "job_url", "url"], "apply_url": ["apply_url"], "external_id": ["external_id", "id", "ats_id"],
    "employment_type": ["employment_type", "job_type"], "company_industry": ["company_industry"], "company_employee_count": ["company_employee_count", "company_num_employees"],
}


def ats_slice(spark: SparkSession, path: str, now: Column, title: str | None = None, state: str | None = None, days: int = 14, limit: int | None = None) -> DataFrame:
    """Open US postings of a vendor's slice: 13 columns, pushed filters on country and coarse date, then exact dates.

    Rows without a date, or with one that isn't ISO, are kept.  A state matches as a token or by name.
    """
    cutoff = F.date_format(F.date_sub(F.to_date(now), days + 1), "yyyy-MM-dd")
    iso = F.col("posted_at").rlike(r"^\d{4}-\d{2}-\d{2}")
    rows = spark.read.schema(ATS_SLICE).parquet(path).where("country_iso = 'US'").where(F.col("posted_at").isNull() | ~iso | (F.col("posted_at") >= cutoff))
    exact = dates.coerce_timestamp(F.when(iso, F.col("posted_at")))
    rows = rows.where(exact.isNull() | (F.unix_micros(exact) >= F.unix_micros(now) - days * 86_400_000_000))
    if title:
        rows = rows.where(F.contains(F.lower("title"), F.lit(title.lower())))
    if state:
        rows = rows.where(location.in_us_state(F.col("location"), F.lit(state)))
    return rows.limit(limit) if limit else rows


def ats_to_raw(rows: DataFrame, portal: str) -> DataFrame:
    """A slice as raw postings of one portal."""
    return rows.select(
        F.xxhash64("global_id").bitwiseAND(F.lit(0x3FFFFFFFFFFFF)).alias("ord"), F.lit("ATS").alias("source_type"), F.lit(1).alias("source_priority"), F.lit(portal).alias("source_site"),
        F.coalesce("global_id", "ats_id").alias("external_id"), "title", F.col("company").alias("company_name"), "location", "description", dates.coerce_timestamp(F.col("posted_at")).alias("posted_at"),
        F.col("url").alias("application_url"), "apply_url", F.col("ats_type").alias("ats_platform"), F.col("country_iso").alias("country"), "employment_type", "is_remote",
        F.create_map(F.lit("ats_id"), F.col("ats_id")).alias("raw"),
    )


def visible(html: Column) -> Column:
    """Text outside tags, scripts and styles, with blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>|\s+", " "))


def blocked_page(html: Column, status: Column, title: Column) -> Column:
    """A quick look at a page whose title is known apart from it: by status and a few marks.  ``access_wall`` is the full rule."""
    head = F.lower(F.substring(html, 1, 4000))
    strong = head.rlike("captcha|cf-challenge|access denied|are you a robot|unusual traffic|perimeterx|datadome")
    weak = F.lower(F.coalesce(title, F.lit(""))).rlike("just a moment|attention required|blocked|forbidden|verify")
    data = html.rlike(r"^\s*(?:\{|\[|<\?xml)")
    return F.coalesce(status.isin(401, 403, 429, 503), F.lit(False)) | (~data & (strong | (weak & (F.length(visible(html)) < 500))))


def _any(c: Column, marks: list[str]) -> Column:
    return c.rlike("|".join(map(re.escape, marks)))


def access_wall(html: Column, status: Column, rendered: Column | None = None) -> Column:
    """Whether a page is an access wall or holds nothing: by status, by marks near its start or in its title, or by too little text.

    A page that a browser has rendered is as short as it looks; JSON documents and sitemaps are short by nature.
    """
    text = F.coalesce(html, F.lit(""))
    start = F.substring(text, 1, vocab.BLOCK_HEAD)
    head = F.lower(start)
    title = F.lower(F.regexp_extract(start, r"(?is)<title[^>]*>(.*?)</title>", 1))
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style|noscript)\b.*?</\1>", " "), "<[^>]+>", " ")
    shown = F.length(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""))
    opening = F.lower(F.substring(F.regexp_replace(F.substring(text, 1, 2000), r"(?U)^\s+", ""), 1, 200))
    document = opening.startswith("{") | opening.startswith("[") | _any(opening, vocab.DOCUMENT_ROOTS)
    walled = F.coalesce(status.isin(vocab.BLOCK_STATUS), F.lit(False)) | ~text.rlike(r"(?U)\S") | _any(head, vocab.BLOCK_STRONG) | _any(title, vocab.BLOCK_WEAK)
    thin = (shown < vocab.LEAST_TEXT) | ((shown < vocab.WEAK_TEXT) & _any(head, vocab.BLOCK_WEAK))
    seen = F.coalesce(rendered, F.lit(False)) if rendered is not None else F.lit(False)
    return walled | (~seen & ~document & thin)


def page_ok(html: Column, blocked: Column, status: Column) -> Column:
    """Whether a recorded page can be read: it has a body, is no wall and its status is no error."""
    return (F.coalesce(F.length(html), F.lit(0)) > 0) & ~F.coalesce(blocked, F.lit(False)) & (status.isNull() | (status < 400))


def applicant_count(page: Column) -> Column:
    """Applicants that a posting's page states, or null."""
    n = F.regexp_extract(F.lower(page), r"(?:over |first )?(\d{1,3}(?:,\d{3})*|\d+)\s+applicants?", 1)
    return F.replace(n, F.lit(","), F.lit("")).try_cast("int")
