"""Recorded result pages of job boards: parsing by site, the page walk and its budgets, detail pages, and actors' items.

Pages are rows; fetching them is somebody else's business.  A page gives postings by its site's own data first, then by
JSON-LD, then by the cards that it shows.  Which of a query's pages a run would have read follows from what they hold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import dates
from leadloom.functions.email import extract_emails
from leadloom.functions.pages import epoch_millis, month_day
from leadloom.operators.coverage import classify_fetch
from leadloom.sources import html as pages_
from leadloom.sources.html import Node


@dataclass(frozen=True)
class Board:
    """A board's address, the words with which it says that there is nothing, and how its cards are marked.

    A mark is an attribute, a value and whether the value may be a part; several marks are tried in order.
    """

    base: str
    none: tuple[str, ...]
    card: tuple
    title: tuple
    company: tuple
    location: tuple
    age: tuple
    text: tuple = ()
    age_kind: str = "relative"
    repeats_last_page: bool = True


_test = lambda value: ("data-testid", value, False)
_class = lambda value: ("class", value, False)
_part = lambda value: ("class", value, True)
#: How the boards mark their pages.
BOARDS = {
    "simplyhired": Board(
        "https://www.simplyhired.com", ("did not find any",), (_test("searchSerpJob"), _class("SerpJob-jobCard")), (_test("searchSerpJobTitle"), _class("jobposting-title")), (_test("companyName"), _class("jobposting-company")),
        (_test("searchSerpJobLocation"), _class("jobposting-location")), (_test("searchSerpJobDateStamp"), _test("detailText")), repeats_last_page=False,
    ),
    "talent_com": Board("https://www.talent.com", ("no results for",), (_test("job-card-unified"),), (_part("JobCard_title"),), (_part("JobCard_company"),), (_part("JobCard_location"),), (("", "time", False),), (_part("JobCard_snippet"), _part("JobCard_description")), "stamp"),
    "postjobfree": Board("https://www.postjobfree.com", ("did not match any jobs",), (_class("snippetPadding"),), (_class("itemTitle"),), (_class("colorCompany"),), (_class("colorLocation"),), (_class("colorDate"),), (_class("jdSnippet"),), "month_day"),
}

COLUMNS = ["external_id", "title", "company_name", "company_website", "location", "description", "posted_text", "posted_kind", "employment_type", "application_url", "extraction"]


def _marked(node: Node, mark: tuple) -> bool:
    attribute, value, part = mark
    if not attribute:
        return node.tag == value
    if attribute == "class":
        return value in node.attrs.get("class", "") if part else value.lower() in node.classes()
    return node.attrs.get(attribute) == value


def _find(node: Node, marks: tuple) -> Node | None:
    nodes = list(node.walk())[1:]
    return next((n for m in marks for n in nodes if _marked(n, m)), None)


def _row(**known) -> dict:
    return dict.fromkeys(COLUMNS) | known


def next_data(root: Node, base: str) -> list[dict] | None:
    """The postings that a page carries as its application's state, or None where it carries none."""
    script = next((n for n in root.walk() if n.tag == "script" and n.attrs.get("id") == "__NEXT_DATA__"), None)
    try:
        listed = json.loads("".join(c for c in script.children if isinstance(c, str)))["props"]["pageProps"]["jobs"]
    except (AttributeError, KeyError, TypeError, ValueError):
        return None
    out = []
    for item in listed or []:
        if isinstance(item, dict) and item.get("title"):
            link = urljoin(base, item["botUrl"]) if item.get("botUrl") else None
            kinds = item.get("jobTypes")
            stamp = item.get("dateOnIndeed")
            out.append(_row(external_id=link or item.get("jobKey"), title=str(item["title"]), company_name=item.get("company") or None, location=item.get("location") or None, posted_text=str(stamp) if stamp else None, posted_kind="millis", employment_type=", ".join(map(str, kinds)) if isinstance(kinds, list) and kinds else None, application_url=link, extraction="next-data"))
    return out


def cards(root: Node, board: Board, page_url: str) -> list[dict]:
    """The postings that a page shows as cards with a title and a company."""
    out = []
    for card in (n for n in root.walk() if any(_marked(n, m) for m in board.card)):
        title, company = _find(card, board.title), _find(card, board.company)
        if title is None or company is None:
            continue
        link = next((n.attrs["href"] for n in card.walk() if n.tag == "a" and n.attrs.get("href")), None)
        url = urljoin(board.base, link) if link else page_url
        place, age, text = _find(card, board.location), _find(card, board.age), _find(card, board.text) if board.text else None
        stamp, kind = (age.text() if age else None), board.age_kind
        if kind == "stamp":
            stamp, kind = (age.attrs["datetime"], "iso") if age and age.attrs.get("datetime") else (stamp, "relative")
        out.append(_row(external_id=url, title=title.text(), company_name=company.text(), location=(place.text() or None) if place else None, description=(text.text() or None) if text else None, posted_text=stamp or None, posted_kind=kind, application_url=url, extraction="card"))
    return out


def structured(html: str, board: Board, page_url: str) -> list[dict]:
    """The postings that a page states as JSON-LD, with a title and a company."""
    out = []
    for p in pages_.postings(html):
        if p["title"] and p["company_name"]:
            url = urljoin(board.base, p["application_url"]) if (p["application_url"] or "").startswith("/") else p["application_url"] or page_url
            out.append(_row(external_id=p["external_id"] or url, title=p["title"], company_name=p["company_name"], company_website=p["company_website"], location=p["location"], description=p["description"], posted_text=p["posted_at"], posted_kind="iso", employment_type=p["employment_type"], application_url=url, extraction="jsonld"))
    return out


def parse_page(site: str, html: str | None, page_url: str) -> list[dict]:
    """A result page's postings; unknown sites give those of JSON-LD only, null and broken pages none."""
    board = BOARDS.get(site)
    if board is None:
        return structured(html or "", Board("", (), (), (), (), (), ()), page_url)
    root = pages_.parse(html)
    found = next_data(root, board.base)
    return found if found is not None else structured(html or "", board, page_url) or cards(root, board, page_url)


def board_postings(pages: DataFrame, now: Column) -> DataFrame:
    """pages(site, query, page_no, url, html) to postings with their place; posted_at from whatever the page said."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(site, query, no, i, r) for site, query, no, url, html in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True) for i, r in enumerate(parse_page(site, html, url))]
            data = {"site": pa.array([r[0] for r in out], pa.string()), "query": pa.array([r[1] for r in out], pa.string()), "page_no": pa.array([r[2] for r in out], pa.int32()), "position": pa.array([r[3] for r in out], pa.int32())}
            yield pa.record_batch(data | {c: pa.array([None if r[4][c] is None else str(r[4][c]) for r in out], pa.string()) for c in COLUMNS})

    schema = "site string, query string, page_no int, position int, " + ", ".join(f"{c} string" for c in COLUMNS)
    found = pages.select("site", "query", F.col("page_no").cast("int"), "url", "html").mapInArrow(rows, schema)
    kind, said = F.col("posted_kind"), F.col("posted_text")
    at = F.when(kind == "millis", epoch_millis(said)).when(kind == "iso", dates.coerce_timestamp(said)).when(kind == "month_day", month_day(said, now)).otherwise(dates.relative_age(said, now))
    return found.withColumn("posted_at", at).drop("posted_text", "posted_kind")


def page_walk(pages: DataFrame, postings: DataFrame, max_pages: int = 25, max_results: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(postings read, outcomes): what a run takes from recorded pages(site, query, page_no, url, html, ok, error, status).

    Pages of a query are read in order until one cannot be read, holds nothing, repeats only what is known (unless the
    board's pages overlap), or a budget is spent.  Nothing on the first page, without the board's own words for it, is
    a page that could not be parsed.  A posting counts once a run, where it is first seen.
    """
    page, at = ["site", "query", "page_no"], ["query", "page_no", "position"]
    rows = postings.withColumn("key", F.coalesce(F.nullif("external_id", F.lit("")), F.nullif("application_url", F.lit(""))))
    firsts = rows.where("key is not null").groupBy("site", "key").agg(F.min(F.struct(*at)).alias("at")).select("site", "key", "at.*")
    shown = rows.select(*page, F.lit(1).alias("found"), F.lit(0).alias("fresh")).unionByName(firsts.select(*page, F.lit(0).alias("found"), F.lit(1).alias("fresh")))
    by_page = shown.groupBy(*page).agg(F.sum("found").alias("found"), F.sum("fresh").alias("fresh"))
    quiet = F.lit(False)
    for site, board in BOARDS.items():
        for mark in board.none:
            quiet = quiet | ((F.col("site") == site) & F.lower(F.coalesce("html", F.lit(""))).contains(mark))
    overlapping = F.col("site").isin([s for s, b in BOARDS.items() if not b.repeats_last_page])
    walk = pages.select("site", "query", F.col("page_no").cast("int").alias("page_no"), "ok", "error", "status", quiet.alias("says_none"))
    walk = walk.join(by_page.hint("merge"), page, "left").fillna(0, ["found", "fresh"])  # the planner's sizes know nothing of a source's rows
    order = Window.partitionBy("site", "query").orderBy("page_no")
    before = F.coalesce(F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lost, unparsed = ~F.coalesce("ok", F.lit(False)), (F.col("found") == 0) & (F.col("page_no") == 1) & ~F.col("says_none")
    ends = (
        F.when(F.col("page_no") > max_pages, F.lit("BUDGET_REACHED")).when(before >= max_results, F.lit("BUDGET_REACHED")).when(lost, classify_fetch(F.col("error"), F.col("status")))
        .when(unparsed, F.lit("ERROR")).when((F.col("found") == 0) | ((F.col("fresh") == 0) & ~overlapping), F.lit("SOURCE_EXHAUSTED"))
    )
    walk = walk.withColumn("ends", ends).withColumn("unread", (F.col("page_no") > max_pages) | (before >= max_results))
    walk = walk.withColumn("unparsed", ~lost & unparsed)
    run = Window.partitionBy("site", "query")
    walk = walk.withColumn("stop", F.min(F.when(F.col("ends").isNotNull(), F.struct("page_no", "ends", "unread", "unparsed", "error"))).over(run))
    read = F.col("stop").isNull() | (F.col("page_no") < F.col("stop.page_no")) | ((F.col("page_no") == F.col("stop.page_no")) & ~F.col("stop.unread"))
    walk = walk.withColumn("read", F.coalesce(read, F.lit(False)))
    each = walk.groupBy(*page).agg(F.max("read").alias("read"), F.max(F.expr("read and ok and found > 0")).alias("taken"), F.max("found").alias("found"), F.max("fresh").alias("fresh"), F.max("stop").alias("stop"))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("taken"), c)), F.lit(0))
    out = each.groupBy("site", "query").agg(
        F.max("stop").alias("stop"), F.max("page_no").alias("last"), F.coalesce(F.max(F.when(F.col("read"), F.col("page_no"))), F.lit(0)).alias("pages"),
        total(F.col("found")).alias("jobs_returned"), total(F.col("fresh")).alias("jobs_accepted"), total(F.col("found") - F.col("fresh")).alias("duplicates"),
    )
    reason = F.when(F.col("stop").isNotNull(), F.col("stop.ends")).when(F.col("last") >= max_pages, F.lit("BUDGET_REACHED")).otherwise(F.lit("SOURCE_EXHAUSTED"))
    outcomes = out.select("site", "query", reason.alias("stop_reason"), F.when(F.col("stop.unparsed"), F.lit("PARSE_FAILED")).alias("error_type"), F.col("stop.error").alias("error_message"), "pages", "jobs_returned", "jobs_accepted", "duplicates")
    kept = firsts.join(each.where("taken").select(*page).hint("merge"), page, "left_semi")
    accepted = rows.dropDuplicates(["site", "key", *at]).join(kept.hint("merge"), ["site", "key", *at], "left_semi").drop("key")
    return accepted, outcomes


def detail_parts(html: str | None) -> dict:
    """What a posting's own page adds: its date, type and text; the text of JSON-LD before that of the page."""
    found = next(iter(pages_.postings(html)), None)
    text = (found or {}).get("description")
    if not text:
        root = pages_.parse(html)
        says = lambda n: any("description" in n.attrs.get(a, "").lower() for a in ("class", "id", "data-testid"))
        body = next((n for n in root.walk() if n.tag == "main" or says(n)), None)
        text = body.text() if body else None
    return {"posted_text": (found or {}).get("posted_at"), "employment_type": (found or {}).get("employment_type"), "description": (text or "")[:20_000] or None}


def enrich_from_details(postings: DataFrame, pages: DataFrame, budget: int = 10, source: str = "source_site") -> DataFrame:
    """postings with gaps filled from their own pages(url, html): date, type, text and the addresses in it.

    Only postings with a link that lack a text or a date are looked up, the first ``budget`` of each source in the
    order ``ord``; known facts are never replaced.
    """
    open_ = F.col("application_url").isNotNull() & ((F.coalesce("description", F.lit("")) == "") | F.col("posted_at").isNull())
    picked = postings.where(open_).select("ord", "application_url", F.row_number().over(Window.partitionBy(source).orderBy("ord")).alias("k")).where(F.col("k") <= budget)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [detail_parts(h) for h in batch.column(1).to_pylist()]
            yield pa.record_batch({"ord": batch.column(0)} | {f"d_{c}": pa.array([p[c] for p in parts], pa.string()) for c in ("posted_text", "employment_type", "description")})

    found = picked.join(pages.select(F.col("url").alias("application_url"), "html"), "application_url").select("ord", "html").mapInArrow(rows, "ord long, d_posted_text string, d_employment_type string, d_description string")
    found = found.dropDuplicates(["ord"])
    out = postings.join(found, "ord", "left")
    more = F.array_distinct(F.concat(F.coalesce("observed_emails", F.array().cast("array<string>")), extract_emails(F.col("d_description"))))
    filled = {
        "posted_at": F.coalesce("posted_at", dates.coerce_timestamp(F.col("d_posted_text"))), "employment_type": F.coalesce(F.nullif("employment_type", F.lit("")), "d_employment_type", "employment_type"),
        "description": F.coalesce(F.nullif("description", F.lit("")), "d_description", "description"), "observed_emails": F.when(F.col("d_description").isNotNull(), more).otherwise(F.col("observed_emails")),
    }
    return out.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in postings.columns))


def applicant_counts(postings: DataFrame, pages: DataFrame, portal: str = "linkedin", budget: int = 50) -> DataFrame:
    """postings with applicant_count from their own pages(url, html), for the first ``budget`` of a portal that have none."""
    from leadloom.sources.registry import applicant_count, visible

    picked = postings.where((F.col("source_site") == portal) & F.col("applicant_count").isNull() & F.col("application_url").isNotNull()).select("ord", "application_url").orderBy("ord").limit(budget)
    said = picked.join(pages.select(F.col("url").alias("application_url"), "html"), "application_url").groupBy("ord").agg(F.max(applicant_count(visible(F.col("html")))).alias("__n"))
    out = postings.join(said, "ord", "left")
    return out.select(*(F.coalesce("applicant_count", "__n").alias("applicant_count") if c == "applicant_count" else F.col(c) for c in postings.columns))


# --- actors' items ----------------------------------------------------------------------------------------------------

_GLASSDOOR = (
    "platform_url string, title string, company_name string, company_url string, company_website string, location struct<raw:string,country_code:string>, description string, posted_date string, official_url string, job_type string, "
    "is_remote boolean, company_industry string, employee_count string, company_revenue string, company_addresses string, applicant_count int, emails array<string>"
)
_ZIP = "dataType string, id string, url string, title string, company string, companyUrl string, location string, country string, description string, postedDate string, applyUrl string, employmentType string, industry string"
#: The windows that one actor offers, in hours.
ZIP_WINDOWS = [("today", 24), ("3days", 72), ("week", 168), ("2weeks", 336), ("month", 744)]


def _stripped(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"(?U)\s+", " ")), F.lit(""))


def actor_postings(items: DataFrame, portal: str) -> DataFrame:
    """items(ord, item), an actor's items as JSON text, to raw postings of ``glassdoor`` or ``zip_recruiter``; items without a title are left out."""
    empty = F.array().cast("array<string>")
    if portal == "glassdoor":
        rows = items.select("ord", F.from_json("item", _GLASSDOOR).alias("i")).where("coalesce(i.title, '') <> ''")
        own = {
            "external_id": "i.platform_url", "title": "i.title", "company_name": "i.company_name", "company_url": "i.company_url", "company_website": "i.company_website", "location": "i.location.raw", "country": "i.location.country_code",
            "application_url": "i.platform_url", "employment_type": "i.job_type", "company_industry": "i.company_industry", "company_employee_count": "i.employee_count", "company_revenue": "i.company_revenue", "company_addresses": "i.company_addresses",
        }
        made = {"apply_url": F.coalesce(F.nullif("i.official_url", F.lit("")), "i.platform_url"), "is_remote": F.col("i.is_remote"), "applicant_count": F.col("i.applicant_count"), "observed_emails": F.filter(F.coalesce("i.emails", empty), lambda e: F.coalesce(e, F.lit("")) != ""), "posted_at": dates.coerce_timestamp(F.col("i.posted_date"))}
    elif portal == "zip_recruiter":
        rows = items.select("ord", F.from_json("item", _ZIP).alias("i")).where("coalesce(i.title, '') <> '' and coalesce(i.dataType, 'job') = 'job'")
        own = {"title": "i.title", "company_name": "i.company", "company_website": "i.companyUrl", "location": "i.location", "country": "i.country", "application_url": "i.url", "employment_type": "i.employmentType", "company_industry": "i.industry"}
        made = {"external_id": F.coalesce(F.nullif("i.id", F.lit("")), "i.url"), "apply_url": F.coalesce(F.nullif("i.applyUrl", F.lit("")), "i.url"), "observed_emails": empty, "posted_at": dates.coerce_timestamp(F.col("i.postedDate"))}
    else:
        raise ValueError(f"no actor serves {portal!r}")
    made |= {"description": _stripped(F.col("i.description")), "source_type": F.lit("JOB_BOARD"), "source_priority": F.lit(2), "source_site": F.lit(portal)}
    return rows.select("ord", *(F.col(v).alias(k) for k, v in own.items()), *(v.alias(k) for k, v in made.items()))


def actor_window(portal: str, hours: Column) -> Column:
    """The posting window that an actor enforces for so many hours: a day more for dates, else the smallest fixed one, the longest beyond all."""
    if portal == "glassdoor":
        return F.when(F.coalesce(hours, F.lit(0)) > 0, hours + 24)
    out = None
    for _, width in ZIP_WINDOWS:
        out = F.when(hours <= width, width) if out is None else out.when(hours <= width, width)
    return F.when(F.coalesce(hours, F.lit(0)) > 0, out.otherwise(ZIP_WINDOWS[-1][1]))


def adapter_outcome(kind: str, returned: Column, limit: Column, error: Column) -> Column:
    """How an adapter's call ended: an error, our own limit reached by a slice or an actor, or everything there was."""
    full = returned >= limit if kind in ("ats", "apify") else F.lit(False)
    return F.when(F.coalesce(error, F.lit("")) != "", F.lit("ERROR")).when(F.coalesce(full, F.lit(False)), F.lit("BUDGET_REACHED")).otherwise(F.lit("SOURCE_EXHAUSTED"))
