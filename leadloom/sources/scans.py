"""Candidates from recorded pages: links, sitemaps, certificates and search results, and what a fetcher would have refused."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import pages as urls
from leadloom.functions import url
from leadloom.operators.matching import unwrap_redirect
from leadloom.sources import html as pages_

#: Failures in a row after which a host is not asked again.
FAILURES = 3


def links(html: str | None) -> list[str]:
    """The targets of a page's links in order, without mail, telephone, script and in-page ones."""
    found = (n.attrs.get("href", "").strip() for n in pages_.parse(html).walk() if n.tag == "a")
    return [h for h in found if h and not h.lower().startswith(("mailto:", "tel:", "#", "javascript:"))]


def links_of_pages(pages: DataFrame, key: str = "url") -> DataFrame:
    """(key, position, link) of every link on ``pages(key, html)``; null and broken pages give none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, i, link) for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, link in enumerate(links(page))]
            yield pa.record_batch({key: pa.array([r[0] for r in out], batch.schema.field(0).type), "position": pa.array([r[1] for r in out], pa.int32()), "link": pa.array([r[2] for r in out], pa.string())})

    return pages.select(key, "html").mapInArrow(rows, f"{key} {pages.schema[key].dataType.simpleString()}, position int, link string")


def sitemap_links(xml: Column) -> Column:
    """The places that a sitemap, or an index of them, lists, in order."""
    found = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)
    return F.filter(F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: u != "")


def certificate_hosts(answers: DataFrame, limit: int = 100) -> DataFrame:
    """(company_id, host) below a domain in answers(company_id, domain, body), certificates' names as JSON; each once, ``limit`` a company in order."""
    names = F.from_json("body", "array<struct<name_value:string>>")
    rows = answers.select("company_id", "domain", F.explode(F.coalesce(names, F.array().cast("array<struct<name_value:string>>"))).alias("n"))
    rows = rows.select("company_id", "domain", F.explode(F.split(F.coalesce("n.name_value", F.lit("")), "\n")).alias("raw"))
    host = F.lower(F.regexp_replace(F.trim("raw"), r"^[*.]+", ""))
    inside = rows.select("company_id", host.alias("host"), "domain").where(F.endswith("host", F.concat(F.lit("."), "domain"))).select("company_id", "host").distinct()
    return inside.withColumn("k", F.row_number().over(Window.partitionBy("company_id").orderBy("host"))).where(F.col("k") <= limit).drop("k")


def search_candidates(results: DataFrame, engines: list[str], limit: int = 4) -> DataFrame:
    """(dedup_key, seq, domain, url) from results(dedup_key, position, link): employers' domains in order of their first result.

    Wrapped links are unwrapped; links to search engines, platforms and free mail are nobody's domain.
    """
    rows = results.withColumn("target", unwrap_redirect(F.col("link"))).withColumn("domain", url.normalize_domain(F.col("target"))).where((F.col("domain") != "") & ~F.col("domain").isin(engines))
    firsts = rows.groupBy("dedup_key", "domain").agg(F.min(F.struct("position", "target")).alias("r"))
    place = F.row_number().over(Window.partitionBy("dedup_key").orderBy("r.position", "domain"))
    return firsts.withColumn("seq", place).where(F.col("seq") <= limit).select("dedup_key", "seq", "domain", F.col("r.target").alias("url"))


def circuit_open(attempts: DataFrame, failures: int = FAILURES) -> DataFrame:
    """attempts(host, seq, ok) and open: whether a host's last attempts before were all failures, so that it would not be asked.

    A host's attempts are in one window; budgets keep them few.
    """
    before = Window.partitionBy("host").orderBy("seq").rowsBetween(-failures, -1)
    return attempts.withColumn("open", F.coalesce((F.count("*").over(before) == failures) & (F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(before) == 0), F.lit(False)))


def fetch_error(link: Column, resolves: Column, robots: Column, open_: Column, status: Column, redirect: Column) -> Column:
    """The code with which a fetch of a page would have ended, or null: refused before it is sent, or by what came back."""
    refused = urls.url_refused(link)
    return (
        F.when(refused.isNotNull(), F.concat(F.lit("URL_REJECTED:"), refused)).when(~F.coalesce(resolves, F.lit(True)), F.lit("HOST_UNRESOLVED")).when(~F.coalesce(robots, F.lit(True)), F.lit("ROBOTS_DISALLOWED"))
        .when(F.coalesce(open_, F.lit(False)), F.lit("HOST_CIRCUIT_OPEN")).when(status.isin(404, 410), F.lit("NOT_FOUND")).when(status.isin(429, 503), F.concat(F.lit("RATE_LIMITED:"), status.cast("string")))
        .when(redirect.isNotNull() & urls.url_refused(redirect).isNotNull(), F.lit("REDIRECT_REJECTED"))
    )
