"""Hosts, employer domains and source identifiers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.base import let


def extract_host(c: Column) -> Column:
    """Lower-case host without user, port and ``www.``; '' where there is none."""
    url = F.trim(F.coalesce(c, F.lit("")))
    url = F.when(url.contains("//"), url).otherwise(F.concat(F.lit("//"), url))
    place = F.regexp_extract(url, r"^(?:[^/?#]*)//([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(F.substring_index(place, "@", -1), r"^([^:]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"^www\.", "")


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three below a two-letter zone with a second level such as ``co``."""
    second = "|".join(vocab.SECOND_LEVEL)
    long = F.regexp_extract(host, rf"([^.]*\.(?:{second})\.[^.]{{2}})$", 1)
    return F.when(long != "", long).otherwise(F.substring_index(host, ".", -2))


def _corrupted(host: Column) -> Column:
    """A platform's name with more glued on, like ``indeed.comnone``."""
    return host.rlike("^(?:" + "|".join(map(re.escape, vocab.PLATFORM_HOSTS)) + r")[^.]")


def is_employer_domain(host: Column) -> Column:
    return let(host, lambda h: let(registrable_domain(h), lambda root: _sound(h, root)))


def _sound(host: Column, root: Column) -> Column:
    fits = host.rlike(r"\.[A-Za-z]{2,24}$") & ~host.rlike("|".join(vocab.ATS_TOKENS)) & ~_corrupted(host) & ~_corrupted(root)
    return F.coalesce(fits & ~root.isin(vocab.PLATFORM_HOSTS) & ~root.isin(vocab.FREE_MAIL), F.lit(False))


def normalize_domain(url: Column) -> Column:
    """The employer's registrable domain, or '' for platforms and anything else.

    The whole host is judged before it is cut to its root, and so is the root.
    """
    cut = lambda host, root: F.when(_sound(host, root) & root.rlike(r"\.[A-Za-z]{2,24}$") & ~root.rlike("|".join(vocab.ATS_TOKENS)), root).otherwise(F.lit(""))
    return let(extract_host(url), lambda h: let(registrable_domain(h), lambda root: cut(h, root)))


def email_host(email: Column) -> Column:
    return F.when(email.contains("@"), F.lower(F.trim(F.substring_index(email, "@", -1))))


def domain_from_email(email: Column) -> Column:
    return normalize_domain(email_host(email))


def resolve_domain(website: Column, company_url: Column, application_url: Column, apply_url: Column, emails: Column) -> Column:
    """struct(domain, source) from the strongest evidence; ('', 'NONE') without any.

    Weaker evidence is only looked at where the stronger has given nothing.
    """
    named = lambda domain, source: F.struct(domain.alias("domain"), F.lit(source).alias("source"))
    some = lambda value, source: let(normalize_domain(value), lambda d: F.when(d != "", named(d, source)))
    links = [F.when(F.coalesce(u, F.lit("")) != "", some(u, source)) for u, source in zip((website, company_url, application_url, apply_url), vocab.DOMAIN_SOURCES, strict=False)]
    hosts = F.transform(emails, lambda e: normalize_domain(email_host(e)))
    mailed = F.when(F.size(F.coalesce(emails, F.array().cast("array<string>"))) > 0, let(F.get(F.filter(hosts, lambda d: d != ""), F.lit(0)), lambda d: F.when(d.isNotNull(), named(d, vocab.DOMAIN_SOURCES[4]))))
    return F.coalesce(*links, mailed, named(F.lit(""), "NONE"))


def source_ids(company_url: Column, application_url: Column, apply_url: Column, platform: Column | None = None, ats_id: Column | None = None) -> Column:
    """Sorted distinct ``family:identifier`` strings; a link that fits no family is matched once."""
    any_family = "(?i)" + "|".join(f"(?:{pattern})" for _, pattern in vocab.SOURCE_ID_PATTERNS)
    empty = F.array().cast("array<string>")

    def of_link(url: Column) -> Column:
        found = []
        for family, pattern in vocab.SOURCE_ID_PATTERNS:
            raw = F.regexp_extract(url, f"(?i){pattern}", 1)
            name = F.lower(F.trim(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)))
            found.append(F.when(raw != "", F.concat(F.lit(f"{family}:"), name)))
        return F.when(url.rlike(any_family), F.array_compact(F.array(*found))).otherwise(empty)

    parts = [of_link(u) for u in (company_url, application_url, apply_url)]
    if platform is not None and ats_id is not None:
        parts.append(F.when((platform == "paylocity") & ats_id.contains(":"), F.array(F.concat(F.lit("paylocity:"), F.lower(F.substring_index(ats_id, ":", 1))))).otherwise(empty))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def visit_key(url: Column) -> Column:
    """Host without www, path without a slash at its end, and query: pages with one key are one page."""
    rest = F.regexp_replace(F.lower(url), r"^[a-z]+://(?:www\.)?", "")
    head, query = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(url, r"(\?[^#]*)", 1)
    return F.concat(F.regexp_replace(head, "/+$", ""), query)
